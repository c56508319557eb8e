"""Evaluation passages inside a training corpus.

Texts are compared as sequences of words reduced to their ASCII letters and digits in lower case, so letter
case, punctuation, line breaks, mark-up and characters damaged by a wrong encoding don't count. A word with
nothing left but with letters of another script is a symbol of its own, WILD and those letters; signs alone are
WILD, which matches itself, weakly. Documents with such words that no item has may be damaged: they are searched
once more with all these words as WILD.

A shard is a run of documents with about SHARD words. Each shard gets an FM-index over its words: the suffix
array by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix with rank tables, and every
SAMPLE-th suffix position. All phrases of SHORT successive item words (SEED in damaged documents) are searched backwards at once through the
wavelet ranks, their occurrences located by walking to the next sampled position. Hits of one item that lie
close to one diagonal of a document make a candidate if enough words agree there, and a local alignment decides: at least
`min_words` successive words of the item (or all of it) with a few altered, added or missing. What is found in
a document becomes character spans, merged where they touch, ready for removal.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from functools import reduce as fold
from html import unescape
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"<[^<>\n]{1,120}>|(?:[A-Za-z0-9\x80-\U0010ffff]++|&[A-Za-z]{2,8};|(?<=[a-z])-[ \t]*\r?\n[ \t]*(?=[a-z]))++")
NOT_KEPT = re.compile(r"&[A-Za-z]+;|[^A-Za-z0-9]+")
JOINED = re.compile("(?<=[\x21-\x7e])[\xa0–—](?=[\x21-\x7e])")
BLANKS = re.compile(r"&(?:nbsp|amp|lt|gt|quot);")
SPACES = re.compile("[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
WILD, SEED, SHORT, SHARD, SAMPLE = "~", 5, 4, 250_000, 8
ODD = WILD + "\0"  # any word of another script that no item has
KNOWN = 1 << 20  # words whose codes a task remembers
SIGNS = {"Po", "Pd", "Ps", "Pe", "Pi", "Pf", "Pc", "Sm", "Sc", "Sk", "Zs"}  # what text has without being damaged
NEAR = 8  # words by which the hits of a candidate may leave the diagonal
COVER, FIGURES, ENOUGH = 9, 2.0, 17  # words that hits of SEED words cover, with so much weight of figures, or words that do without
SOME = 8  # words that hits of SHORT words cover in 20 with any three altered, at least
ALTERED = 3  # words altered in 20 with which a passage is still found


def reduce(word: str) -> str:
    return word.lower() if word.isalnum() and word.isascii() else NOT_KEPT.sub("", word).lower() or WILD


def prepare(text: str) -> str:
    """The text with odd spaces and entities that part words as plain spaces; lengths stay."""
    if "&" in text:
        text = BLANKS.sub(lambda m: " " * len(m[0]), text)
    return text if text.isascii() else JOINED.sub(" ", SPACES.sub(" ", text))


@lru_cache(1 << 16)
def own(word: str) -> str:
    """WILD with the letters of a word that has no ASCII ones; WILD alone where it has only signs."""
    plain = unicodedata.normalize("NFKC", unescape(word)).casefold()
    if letters := "".join(c for c in plain if c.isalnum() or unicodedata.category(c)[0] == "M"):
        return WILD + letters
    return WILD if all(unicodedata.category(c) in SIGNS or c in "°¦" for c in plain) else WILD + "?"


def spelled(text: str) -> list[str]:
    return [own(w) if (r := reduce(w)) == WILD else r for w in WORD.findall(prepare(text)) if w[0] != "<"]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; after the first rounds only what still ties is sorted."""
    n = len(s)
    rank = s.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    key = rank[order]
    rank[order] = np.r_[0, np.cumsum(key[1:] != key[:-1])]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))  # a rank is the first place of its group
    step = 1
    tied = np.flatnonzero(np.repeat(np.diff(np.r_[first, n]) > 1, np.diff(np.r_[first, n])))
    while len(tied):
        at = order[tied]
        nxt = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        group = rank[at]
        again = np.argsort(group * (n + 1) + nxt, kind="stable")
        at, group, nxt = at[again], group[again], nxt[again]
        order[tied] = at
        new = np.r_[True, (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])]
        starts = np.flatnonzero(new)
        size = np.diff(np.r_[starts, len(at)])
        rank[at] = np.repeat(tied[starts], size)
        tied = tied[np.repeat(size > 1, size)]
        step *= 2
    return order


class FMIndex:
    """Over whole numbers below 2**bits; the text must end with a number that is found nowhere else."""

    def __init__(self, s: np.ndarray, bits: int):
        order = suffix_array(s)
        self.n = len(s)
        bwt = s[order - 1]  # of place 0 the last
        self.before = np.r_[0, np.cumsum(np.bincount(s, minlength=1 << bits))]
        self.bits, self.ones, self.zeros = bits, [], []
        level = bwt.copy()
        for b in range(bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.sampled = np.full(self.n, -1, np.int64)
        keep = order % SAMPLE == 0
        self.sampled[keep] = order[keep]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        start = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - i)) & 1
            a, b = ones[start], ones[at]
            start, at = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, at - b)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place of the transform and its rank there."""
        symbol, start, at = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            a, b = ones[start], ones[at]
            bit = ones[at + 1] - b
            symbol = symbol * 2 + bit
            start, at = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, at - b)
        return symbol, at - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of all occurrences of the rows of `phrases`."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, column]
            base = self.before[c]
            lo[alive], hi[alive] = base + self.rank(c, lo[alive]), base + self.rank(c, hi[alive])
            alive = alive[hi[alive] > lo[alive]]
            if not len(alive):
                return alive, alive
        count = hi[alive] - lo[alive]
        phrase = np.repeat(alive, count)
        row = np.repeat(lo[alive] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        position, steps, open_ = np.empty(len(row), np.int64), 0, np.arange(len(row))
        while len(open_):
            here = self.sampled[row[open_]]
            known = here >= 0
            position[open_[known]] = here[known] + steps
            open_ = open_[~known]
            symbol, rank = self.access(row[open_])
            row[open_] = self.before[symbol] + rank
            steps += 1
        return phrase, position


def align(item: np.ndarray, doc: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> tuple[int, int, int, int]:
    """Best local alignment: first and last place in item and in doc. A match scores its weight, anything else costs
    the penalty."""

    def forward(a: np.ndarray, w: np.ndarray, d: np.ndarray, anchored: bool) -> tuple[int, int, float]:
        ramp = np.arange(len(d) + 1) * penalty
        floor = -np.inf if anchored else 0.0
        row = -ramp if anchored else np.zeros(len(d) + 1)
        best = (-1, -1, 0.0)
        for i in range(len(a)):
            new = np.maximum(row - penalty, floor)
            new[1:] = np.maximum(new[1:], row[:-1] + np.where(d == a[i], w[i], -penalty))
            row = np.maximum.accumulate(new + ramp) - ramp
            j = int(row.argmax())
            if row[j] > best[2]:
                best = (i, j - 1, float(row[j]))
        return best

    i1, j1, _ = forward(item, weight, doc, False)
    if i1 < 0:
        return 0, -1, 0, -1
    i0, j0, _ = forward(item[i1::-1], weight[i1::-1], doc[j1::-1] if j1 >= 0 else doc[:0], True)
    a, b = i1 - i0, j1 - j0
    return a, i1, b, j1


def agreement(item: np.ndarray, doc: np.ndarray, of_word: np.ndarray, figures: np.ndarray) -> tuple[float, float]:
    """The shares of the item's words and of its weight of figures that are among the doc's, each as often as it is
    there. A word agrees with all its parts."""
    order = np.argsort(item, kind="stable")
    own = item[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    there = np.sort(doc)
    same = np.empty(len(own), bool)
    same[order] = nth < np.searchsorted(there, own, "right") - np.searchsorted(there, own)
    whole = np.ones(of_word[-1] - of_word[0] + 1, bool)
    whole[of_word[~same] - of_word[0]] = False
    share = float(whole.mean())
    return share, float(figures[same].sum() / figures.sum()) if figures.any() else 2 * share - 1


def holds(words_: int, identity: float, figures: float, least: float) -> bool:
    """Whether an aligned passage is the item's text and not just common wording with other names and numbers in
    it. Short passages have room for fewer altered words, those of 20 for ALTERED at the default `least`."""
    return (identity + figures) / 2 >= least and figures >= 0.5 and identity >= least + max(0, 30 - words_) * 0.01 - 1e-9


def stretch(item: np.ndarray, doc: np.ndarray, of_word: np.ndarray, ends: tuple[int, int, int, int], needed: int) -> tuple[int, int, int, int]:
    """The aligned passage carried on at its ends, over altered words to agreeing ones, until it has the words needed.
    An alignment leaves out an agreeing word behind an altered one, as both weigh the same."""
    a, b, x, y = ends
    left = ALTERED
    while of_word[b] - of_word[a] + 1 < needed:
        before = next((k for k in range(1, min(a, x, left + 1) + 1) if item[a - k] == doc[x - k]), 0)
        after = next((k for k in range(1, min(len(item) - 1 - b, len(doc) - 1 - y, left + 1) + 1) if item[b + k] == doc[y + k]), 0)
        if before and (before <= after or not after):
            a, x, left = a - before, x - before, left - before + 1
        elif after:
            b, y, left = b + after, y + after, left - after + 1
        else:
            break
    return a, b, x, y


class Seeds:
    """Phrases of `length` successive words of items, each once, and where they stand: rows of item, place, words."""

    def __init__(self, rows: list[tuple[int, ...]], length: int):
        self.length = length
        self.rows = np.array(rows, np.int64).reshape(-1, length + 2)
        self.phrases, which = np.unique(self.rows[:, 2:], axis=0, return_inverse=True)
        self.by_phrase = np.argsort(which.ravel(), kind="stable")
        self.phrase_start = np.searchsorted(which.ravel()[self.by_phrase], np.arange(len(self.phrases) + 1))


def phrases(codes: list[np.ndarray], which: list[int], length: int, keep: Callable = lambda s: True) -> list[tuple[int, ...]]:
    return [(k, i, *s) for k in which for i in range(len(codes[k]) - length + 1) if keep(s := codes[k][i : i + length].tolist())]


class Items:
    """The evaluation items, ready for search. Made from at most the rows that the caller bounds. `seeds` are of the
    words as they are, `damaged` of the items with words in other scripts, these taken as WILD."""

    def __init__(self, rows: list[tuple[int, str]], min_words: int):
        self.wild = 2
        self.vocabulary: dict[str, int] = {WILD: self.wild, ODD: self.wild + 1}
        self.keys, self.codes, self.of_word, self.needed = [], [], [], []
        for key, text in rows:
            spoken, of_word = [], []
            for n, chunk in enumerate((text or "").split()):
                parts = [WILD if w == WILD + "?" else w for w in spelled(chunk)]
                spoken += parts
                of_word += [n] * len(parts)
            if not spoken:
                continue
            code = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in spoken])
            self.keys.append(key), self.codes.append(code), self.of_word.append(np.array(of_word))
            self.needed.append(min(min_words, of_word[-1] + 1))
        figure = np.array([0.0, 0.0, *(min(len(w), 3) / 3 if any(c.isdigit() for c in w) and len(w) > 1 and w[0] != WILD else 0.0 for w in self.vocabulary)])
        self.figures = [figure[c] for c in self.codes]
        self.offset = np.cumsum([0, *(len(c) + 1 for c in self.codes)])
        self.sums = np.concatenate([np.r_[0, np.cumsum(t)] for t in self.figures] or [np.zeros(1)])
        self.least = np.array([min(FIGURES, 0.15 * t.sum()) for t in self.figures])
        self.start = np.cumsum([0, *(len(c) for c in self.codes)])
        self.flat, self.word, self.figure = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.codes, self.of_word, self.figures))
        self.parts = np.array([(np.searchsorted(w, w + 20) - np.arange(len(w))).max() for w in self.of_word])
        self.reduced = np.array([0, 1, *(self.wild if w[0] == WILD else c for w, c in self.vocabulary.items())])
        self.seeds = Seeds(phrases(self.codes, range(len(self.codes)), SHORT), SHORT)
        whole = [[k for k, c in enumerate(self.codes) if len(c) == n and (c != self.wild).any()] for n in range(1, SHORT)]
        self.whole = [Seeds(phrases(self.codes, ks, n), n) for n, ks in enumerate(whole, 1) if ks]  # items shorter than a seed
        tells = lambda s: (wild := s.count(self.wild)) < 3 or wild == 3 and max(figure[s]) == 1
        lettered = [k for k, c in enumerate(self.codes) if (self.reduced[c] != c).any()]
        self.damaged = Seeds(phrases([self.reduced[c] for c in self.codes], lettered, SEED, tells), SEED)
        self.bits = max(2, int(len(self.vocabulary) + 2).bit_length())

    def weight(self, code: np.ndarray) -> np.ndarray:
        return np.where(code == self.wild, 0.5, 1.0)


def places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, so many."""
    return np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())


def plausible(items: Items, which: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of the candidates (item, first and last diagonal) have 20 words of the item, or 30, that can agree as well as
    holds() wants, with 0.4 of the figures among them. A word agrees if all its parts are near the diagonals."""
    order = np.argsort(low - high, kind="stable")  # the widest first
    item, low, width = which[order], low[order], (high - low)[order]
    size = items.start[item + 1] - items.start[item]
    flat = places(items.start[item], size)
    # each candidate's stretch of the documents is laid out once, and the item's words beside it, so that the diagonals
    # are shifted views of the one against the other
    reach = width + 2 * ALTERED + 2
    block = size + reach
    ends = np.cumsum(block)
    pad = np.full(int(block.max()) + ALTERED + 1, -2, np.int32)
    there = np.concatenate([pad, codes.astype(np.int32), pad])[places(low - ALTERED - 1 + len(pad), block)]
    want, same = np.full(len(there), -1, np.int32), np.zeros(len(there), bool)
    want[places(ends - block, size)] = items.flat[flat]
    for step in range(int(reach[0]) + 1):
        n = ends[np.count_nonzero(reach >= step) - 1]
        same[: n - step] |= there[step:n] == want[: n - step]
    count = np.array([w[-1] + 1 for w in items.of_word])[item]
    # most agree in too few words wherever these are; only the others are counted by stretches of the item
    some = np.flatnonzero(np.add.reduceat(same, ends - block, dtype=np.int64) >= np.minimum(count, 20) - ALTERED)
    item, size, count = item[some], size[some], count[some]
    flat, same = places(items.start[item], size), same[places((ends - block)[some], size)]
    out = np.zeros(len(order), bool)
    if not len(some):
        return out
    first = np.r_[0, np.cumsum(count)[:-1]]
    word = items.word[flat] + np.repeat(first, size)
    whole = np.ones(count.sum(), np.int64)
    whole[word[~same]] = 0
    figure = items.figure[flat]
    sums = [np.r_[0, np.bincount(word, w, len(whole)).cumsum()] for w in (figure, figure * same)]
    total, good = np.r_[0, whole.cumsum()], np.zeros(len(item), bool)
    for n, least in ((20, 20 - ALTERED), (30, 22)):
        length = np.minimum(count, n) if n == 20 else np.where(count >= n, n, count + 1)
        begin = places(first, count - length + 1)
        of = np.repeat(np.arange(len(item)), count - length + 1)
        end = begin + length[of]
        fits = total[end] - total[begin] >= (length - n + least)[of]
        fits &= sums[1][end] - sums[1][begin] >= 0.4 * (sums[0][end] - sums[0][begin]) - 1e-9
        good[of[fits]] = True
    out[order[some]] = good
    return out


class Codes(dict):
    """The codes of words as they stand in a text: -1 of mark-up, 0 of what no item has, ODD's of that in other scripts."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN:
            self.clear()
        if word[0] == "<":
            code = -1
        else:
            w = own(word) if (r := reduce(word)) == WILD else r
            code = self.vocabulary.get(w, self.vocabulary[ODD] if w[0] == WILD else 0)
        self[word] = code
        return code

    def of(self, text: str) -> np.ndarray:
        found = WORD.findall(prepare(text))
        codes = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        return codes[codes >= 0]


def occurrences(seeds: Seeds, index: FMIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, place in it, position in the shard) of every seed found."""
    phrase, position = index.search(seeds.phrases)
    times = seeds.phrase_start[phrase + 1] - seeds.phrase_start[phrase]
    seed = seeds.by_phrase[np.repeat(seeds.phrase_start[phrase] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())] if len(phrase) else phrase
    return seeds.rows[seed, 0], seeds.rows[seed, 1], np.repeat(position, times)


def fm_index(items: Items, codes: np.ndarray) -> FMIndex:
    """Words 1 are the documents' ends, word 0 what no item has; the last is the shard's own end."""
    return FMIndex(np.r_[codes, (1 << items.bits) - 1], items.bits)


def candidates(items: Items, seeds: Seeds, index: FMIndex, codes: np.ndarray, doc_of: np.ndarray, doc_start: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(doc, item, first, last word of the doc to align) by the shard's FM-index."""
    item, at, position = occurrences(seeds, index)
    if not len(item):
        return []
    doc = doc_of[position]
    order = np.lexsort((at, position - at, item, doc))
    doc, item, at, position = doc[order], item[order], at[order], position[order]
    diagonal = position - at
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > NEAR)]
    starts = np.flatnonzero(new)
    found = []
    pair = np.cumsum(new) - 1
    span = np.lexsort((at, pair))
    p, a = pair[span], at[span]
    fresh = np.r_[True, p[1:] != p[:-1]]
    base = items.offset[item[span]]
    begin = np.where(fresh, a, np.maximum(a, np.r_[0, a[:-1] + seeds.length]))
    figures = np.bincount(p, items.sums[base + a + seeds.length] - items.sums[base + begin], minlength=len(starts))
    covered = np.bincount(p, a + seeds.length - begin, minlength=len(starts))
    least = np.minimum(COVER, np.array([len(c) for c in items.codes])[item[starts]] // 2)
    loose = seeds.length == SHORT
    if loose:  # what the hits cover from each of them on, in as many parts as 20 words of the item have
        place = p * (1 << 32) + a
        until = np.searchsorted(place, place + items.parts[item[span]] - seeds.length, "right")
        total = np.r_[0, np.cumsum(a + seeds.length - begin)]
        near = total[until] - total[:-1] + begin - a
        some = np.minimum(SOME, np.array([len(c) for c in items.codes])[item[starts]] // 2)
        good = np.flatnonzero(np.maximum.reduceat(near, np.flatnonzero(fresh)) >= some)
        ends = np.r_[starts[1:], len(doc)][good] - 1  # in order of the diagonals
        if len(good):
            good = good[plausible(items, item[starts[good]], codes, diagonal[starts[good]], diagonal[ends])]
    else:
        good = np.flatnonzero((covered >= least) & (figures >= items.least[item[starts]]) | (covered >= ENOUGH))
    for k in good:
        s = starts[k]
        e = starts[k + 1] if k + 1 < len(starts) else len(doc)
        n = len(items.codes[item[s]])
        lo, hi = doc_start[doc[s]], doc_start[doc[s] + 1] - 1
        found.append((int(doc[s]), int(item[s]), max(int(diagonal[s:e].min()) - NEAR * 2, lo), min(int(diagonal[s:e].max()) + n + NEAR * 4, hi)))
    return found


LEAK = "doc_id bigint, item_id bigint, words int, identity double, figures double, span_start int, span_end int"


def _search(sent, least: float):
    def collect(items: Items, seeds: Seeds, codes: np.ndarray, of_items: list[np.ndarray], sizes: np.ndarray, docs: np.ndarray, hits: dict, whole: list[Seeds]) -> None:
        start = np.r_[0, np.cumsum(sizes)]
        index, doc_of = fm_index(items, codes), np.repeat(np.arange(len(sizes)), sizes)
        for short in whole:
            for i, p in zip(*(x.tolist() for x in occurrences(short, index)[::2])):
                d = int(doc_of[p])
                hits.setdefault((int(docs[d]), i), (int(items.of_word[i][-1]) + 1, 1.0, 1.0, p - start[d], p + short.length - 1 - start[d]))
        for d, i, lo, hi in candidates(items, seeds, index, codes, doc_of, start):
            code, key = of_items[i], (int(docs[d]), i)
            for penalty in (1.0, 2.0):  # the second parts a passage from common wording that happens to stand beside it
                a, b, x, y = align(code, codes[lo:hi], items.weight(code), penalty)
                if b < a:
                    break
                a, b, x, y = stretch(code, codes[lo:hi], items.of_word[i], (a, b, x, y), items.needed[i])
                same, figures = agreement(code[a : b + 1], codes[lo + x : lo + y + 1], items.of_word[i][a : b + 1], items.figures[i][a : b + 1])
                n = int(items.of_word[i][b] - items.of_word[i][a]) + 1
                if n >= items.needed[i] and holds(n, same, figures, least):
                    if n > hits.get(key, (0,))[0]:
                        hits[key] = (n, same, figures, lo + x - start[d], lo + y - start[d])
                    break

    def shard(items: Items, rows: list[tuple[int, str, np.ndarray]]) -> pa.RecordBatch:
        codes = np.concatenate([x for *_, c in rows for x in (c, [1])])
        sizes = np.array([len(c) + 1 for *_, c in rows])
        ends = np.cumsum(sizes)
        strange = np.r_[0, np.cumsum(codes == items.vocabulary[ODD])]
        odd = strange[ends] > strange[ends - sizes]
        codes[codes == items.vocabulary[ODD]] = items.wild
        hits: dict[tuple[int, int], tuple] = {}
        collect(items, items.seeds, codes, items.codes, sizes, np.arange(len(rows)), hits, items.whole)
        if odd.any() and len(items.damaged.rows):
            part = items.reduced[codes[np.repeat(odd, sizes)]]
            collect(items, items.damaged, part, [items.reduced[c] for c in items.codes], sizes[odd], np.flatnonzero(odd), hits, [])
        out = []
        for (d, i), (n, same, figures, x, y) in hits.items():
            key, text, _ = rows[d]
            at = [m.span() for m in WORD.finditer(prepare(text)) if m[0][0] != "<"]
            out.append((key, items.keys[i], n, same, figures, at[x][0], at[y][1]))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32())
        names = ["doc_id", "item_id", "words", "identity", "figures", "span_start", "span_end"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = cloudpickle.loads(sent.value)
        if not items.keys:
            return
        rows, size, table = [], 0, Codes(items.vocabulary)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = table.of(text) if text else ()
                if len(found):
                    rows.append((key, text, found))
                    size += len(found) + 1
                if size >= SHARD:
                    yield shard(items, rows)
                    rows, size = [], 0
        if rows:
            yield shard(items, rows)

    return run


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = 20, least: float = 0.75, group_chars: int = 20_000_000) -> DataFrame:
    """doc_id, item_id, words (successive words of the item found), identity and figures (shares of
    its words, and of its words with digits, that agree) and the
    characters span_start to span_end of the document, once per pair that leaks.

    Null and empty texts hold nothing; an item shorter than min_words must be there as a whole, one shorter than SHORT
    words unaltered; one of signs alone is never found. Copies of a document leak each. A text longer than SHARD is a
    shard of its own and is read whole. Items go to every task, made ready once by the driver; where their texts have
    more than group_chars characters, they are dealt to groups of about so many by a hash of the id, and the corpus is
    searched once for each group. Other columns are not read."""
    spark = documents.sparkSession
    listed = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    chars = listed.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 20)).first()[0] or 0
    groups = int(-(-chars // group_chars)) or 1
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = []
    for g in range(groups):
        rows = listed.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(Items([(r[0], r[1]) for r in rows], min_words)))
        found.append(docs.mapInArrow(_search(sent, least), LEAK))
    return fold(DataFrame.unionByName, found)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def removal_spans(leaks: DataFrame) -> DataFrame:
    """doc_id, span_start, span_end, items: the merged spans of each document, with the items they hold. A document
    has at most one span an item, so a group is bounded by the items."""
    start = F.array_sort(F.collect_list(F.struct("span_start", "span_end", "item_id")))

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["span_end"]).alias("e"), F.array_union(last["items"], F.array(x["item_id"])).alias("items"))
        alone = F.struct(x["span_start"].alias("s"), x["span_end"].alias("e"), F.array(x["item_id"]).alias("items"))
        return F.when(F.size(acc) == 0, F.array(alone)).when(x["span_start"] <= last["e"] + 1, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(alone)))

    empty = F.array().cast("array<struct<s:int,e:int,items:array<bigint>>>")
    spans = leaks.groupBy("doc_id").agg(start.alias("all")).select("doc_id", F.explode(F.aggregate("all", empty, step)).alias("x"))
    return spans.select("doc_id", F.col("x.s").alias("span_start"), F.col("x.e").alias("span_end"), F.array_sort("x.items").alias("items"))
