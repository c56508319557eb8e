"""Text decoded with a wrong encoding: finding it and undoing it.

A text is read in units (lines and sentences). A unit is intact or went through one of CHAINS, each a list of
steps (wrong, right): bytes written in `right` were read as `wrong`. Which one is latent. The evidence are the
runs of non-ASCII characters with the letters beside them: a chain that can be undone on a run changes the
likelihood of the run under a model of character pairs. Expectation-maximization alternates

E: the posterior of every unit's chain from that evidence and the share of each chain in the unit's pool, its source
   and field,
M: the shares per pool (weak evidence of many records counts together), and the pair model, from which what
   is held to be damaged is taken out and to which its repaired form is added.

The pair model starts from all documents. Units that no chain can explain to within KEEP of the intact reading
have no part in later rounds; they stay intact. All tables the driver gets are hashed into fixed numbers of
buckets. Characters quoted alone (“Ã©”) are talk about damage and no evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import source_key
from skyloom.session import cut

RUN = re.compile(r"[^\x00-\x7f]+")
UNIT = re.compile(r"[^\r\n.。!?]+[.。!?]*[\r\n]*|[.。!?\r\n]+")
QUOTES = "“”„‟«»‘’‚‹›\"'`"
PAIRS, SINGLES, SOURCES = 1 << 18, 1 << 16, 1 << 10
KEEP, PRIOR, ROUNDS = 12.0, 0.01, 3  # a KEEP of 4, 12 and 30 finds the same documents at sf0.1
LOST = "�"

#: name: steps from the damaged text back to the original
CHAINS = {
    "utf8>west": [("west", "utf-8")], "utf8>west twice": [("west", "utf-8"), ("west", "utf-8")], "utf8>mac": [("mac_roman", "utf-8")],
    "utf8>cp437": [("cp437", "utf-8")], "utf8>cp850": [("cp850", "utf-8")], "utf8>cp1250": [("cp1250", "utf-8")], "utf8>cp1251": [("cp1251", "utf-8")],
    "utf8>cp1253": [("cp1253", "utf-8")], "utf8>iso2": [("iso8859-2", "utf-8")], "utf8>koi8": [("koi8-r", "utf-8")], "utf8>cp866": [("cp866", "utf-8")],
    "utf8>cp932": [("cp932", "utf-8")], "utf8>gbk": [("gb18030", "utf-8")], "utf8>big5": [("big5", "utf-8")], "utf8>euc-jp": [("euc_jp", "utf-8")],
    "cp1251>west": [("west", "cp1251")], "koi8>west": [("west", "koi8-r")], "cp866>west": [("west", "cp866")], "koi8>cp1251": [("cp1251", "koi8-r")],
    "cp866>cp1251": [("cp1251", "cp866")], "cp1251>koi8": [("koi8-r", "cp1251")], "cp1251>cp866": [("cp866", "cp1251")], "koi8>cp866": [("cp866", "koi8-r")],
    "cp1250>west": [("west", "cp1250")], "iso2>west": [("west", "iso8859-2")], "iso2>cp1250": [("cp1250", "iso8859-2")], "cp852>west": [("west", "cp852")], "cp852>cp1250": [("cp1250", "cp852")],
    "west>cp1250": [("cp1250", "west")], "west>cp1251": [("cp1251", "west")], "cp437>west": [("west", "cp437")], "cp850>west": [("west", "cp850")],
    "west>cp437": [("cp437", "west")], "west>cp850": [("cp850", "west")], "mac>west": [("west", "mac_roman")], "west>mac": [("mac_roman", "west")],
    "cp932>west": [("west", "cp932")], "euc-jp>west": [("west", "euc_jp")], "gbk>west": [("west", "gb18030")], "euc-jp>cp932": [("cp932", "euc_jp")], "lost": [],
}
NAMES = list(CHAINS)


def _table(encoding: str) -> dict[str, int]:
    """Character to byte, as browsers have it: a byte that means nothing is the control character of its number."""
    table = {chr(b): b for b in range(128, 160)}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode("cp1252" if encoding == "west" else encoding)] = b
        except UnicodeDecodeError:
            pass
    return table


WIDE = ("cp932", "gb18030", "big5", "euc_jp")
TABLES = {e: _table(e) for steps in CHAINS.values() for e, _ in steps if e not in WIDE}


def _bytes(run: str, encoding: str) -> bytes | None:
    """The bytes that read as `run`; for the wide encodings FF where that is unknown."""
    if encoding not in WIDE:
        table = TABLES[encoding]
        return bytes(map(table.__getitem__, run)) if all(map(table.__contains__, run)) else None
    out = b""
    for c in run:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if c == LOST:
                out += b"\xff"
            elif "\x80" <= c < "\xa0":
                out += bytes([ord(c)])
            else:
                return None
    return out


def undo(run: str, chain: str) -> str | None:
    """The run before the chain, None if it can't come from it. At most a third may stay lost."""
    if LOST in run and chain == "lost":
        return run
    if not CHAINS[chain]:
        return None
    for wrong, right in CHAINS[chain]:
        raw = _bytes(run, wrong)
        if raw is None:
            return None
        if wrong in WIDE and right == "utf-8":
            new = raw.decode("utf-8", "replace")
            if new.count(LOST) * 3 > len(new):
                return None
            run = new
            continue
        try:
            run = "".join(INVERSE[right][b] for b in raw) if right in INVERSE else raw.decode(right)
        except (UnicodeDecodeError, KeyError):
            return None
    return run


INVERSE = {e: {b: c for c, b in _table(e).items() if not "\x80" <= c < "\xa0"} | {b: chr(b) for b in range(128)} for e in ("west", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "cp437", "cp850", "cp852", "mac_roman")}


def undo_unit(unit: str, chain: str) -> str | None:
    """The whole unit before a chain from a wide encoding, whose characters may hold ASCII bytes."""
    if len(CHAINS[chain]) != 1 or CHAINS[chain][0][0] in WIDE or CHAINS[chain][0][1] not in WIDE:
        return None
    wrong, right = CHAINS[chain][0]
    table = TABLES[wrong]
    try:
        return bytes(ord(c) if c < "\x80" else table[c] for c in unit).decode(right)
    except (KeyError, UnicodeDecodeError):
        return None


def runs(unit: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, token) of the evidence in a unit; a token is a run with the character before and after."""
    for m in RUN.finditer(unit):
        start, end = m.span()
        while start < end and unit[start] in QUOTES and (start == 0 or not unit[start - 1].isalpha()):
            start += 1
        while start < end and unit[end - 1] in QUOTES and (end == len(unit) or not unit[end].isalpha()):
            end -= 1
        if start == end:
            start, end = m.span()
        before, after = unit[start - 1] if start else "\n", unit[end] if end < len(unit) else "\n"
        if before in QUOTES and after in QUOTES and end - start <= 12:
            continue
        yield start, end, before.lower() + unit[start:end] + after.lower()


def evidence(unit: str) -> tuple[tuple[tuple[int, int, str], ...], tuple[str, ...]]:
    """The runs of a unit and their tokens."""
    found = tuple(runs(unit)) if not unit.isascii() else ()
    return found, tuple(t for *_, t in found)


def _pairs(token: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the character pairs, of their first and of their second characters."""
    c = np.frombuffer(token.encode("utf-32-le"), np.uint32).astype(np.int64)
    a, b = c[:-1], c[1:]
    return ((a * 0x9E3779B1) ^ (b * 0x85EBCA6B) ^ (a >> 5)) % PAIRS, (a * 0x9E3779B1 >> 7) % SINGLES, (b * 0x9E3779B1 >> 7) % SINGLES


class Model:
    """Counts of hashed character pairs."""

    def __init__(self, pair: np.ndarray, first: np.ndarray, second: np.ndarray):
        self.pairs, self.firsts, self.seconds = (np.maximum(x, 0).tolist() for x in (pair, first, second))
        self.total = max(sum(self.seconds), 1.0)
        self.known: dict[tuple[str, ...], dict[int, float]] = {}
        self.score = lru_cache(200_000)(self._score)
        self.effects = lru_cache(200_000)(self._effects)

    def _score(self, token: str) -> float:
        codes, total, logs = list(map(ord, token)), 1.0, 0.0
        for a, b in pairwise(codes):
            back = (self.seconds[(b * 0x9E3779B1 >> 7) % SINGLES] + 0.02) / (self.total + 0.02 * SINGLES)
            total *= (self.pairs[((a * 0x9E3779B1) ^ (b * 0x85EBCA6B) ^ (a >> 5)) % PAIRS] + 3 * back) / (self.firsts[(a * 0x9E3779B1 >> 7) % SINGLES] + 3)
            if total < 1e-200:
                logs, total = logs + math.log(total), 1.0
        return logs + math.log(total)

    def _effects(self, token: str) -> list[tuple[int, float]]:
        """(chain, gain in log likelihood) of each chain that can be undone on the run."""
        found, own = [], None
        for i, name in enumerate(NAMES):
            new = undo(token[1:-1], name)
            if new is None:
                continue
            if own is None:
                own = self.score(token)
            if name == "lost":
                found.append((i, 12.0))
            elif new != token[1:-1]:
                lost = new.count(LOST)
                bad = sum("\x80" <= c < "\xa0" for c in new)
                found.append((i, self.score(token[0] + new.replace(LOST, "") + token[-1]) - own - 4.0 * lost - 8.0 * bad))
        return found

    def gains(self, tokens: tuple[str, ...]) -> dict[int, float]:
        """Of a unit; units that repeat are reckoned once."""
        total = self.known.get(tokens)
        if total is None:
            if len(self.known) > 200_000:
                self.known.clear()
            total = self.known[tokens] = self._gains(tokens)
        return total

    def _gains(self, tokens: tuple[str, ...]) -> dict[int, float]:
        total: dict[int, float] = {}
        for t in tokens:
            for i, gain in self.effects(t):
                total[i] = total.get(i, 0.0) + gain
        return total


def posterior(gains: dict[int, float], shares: np.ndarray) -> tuple[int, float, dict[int, float]]:
    """The likeliest chain, the probability of any damage, and that of each chain."""
    logs = {i: g + math.log(shares[i]) for i, g in gains.items()}
    top = max([0.0, *logs.values()])
    odds = {i: math.exp(x - top) for i, x in logs.items()}
    total = math.exp(math.log(max(1 - shares.sum(), 1e-6)) - top) + sum(odds.values())
    each = {i: x / total for i, x in odds.items()}
    return max(each, key=each.get, default=-1), sum(each.values()), each


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = [np.zeros(n) for n in (PAIRS, SINGLES, SINGLES)]
    tokens: Counter[str] = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            if text and not text.isascii():
                tokens.update(t for unit in UNIT.findall(text) if not unit.isascii() for t in evidence(unit)[1])
        if len(tokens) > 100_000:
            _add(tables, tokens)
            tokens.clear()
    _add(tables, tokens)
    yield _sparse(tables)


def _add(tables: list[np.ndarray], tokens: dict[str, float]) -> None:
    for t, n in tokens.items():
        for table, at in zip(tables, _pairs(t)):
            np.add.at(table, at, n)


def _sparse(tables: list[np.ndarray]) -> pa.RecordBatch:
    at = [np.flatnonzero(t) for t in tables]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([np.full(len(a), i, np.int32) for i, a in enumerate(at)])), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate([t[a] for t, a in zip(tables, at)]))],
        names=["kind", "bucket", "n"],
    )


TABLE = "kind int, bucket int, n double"


def _collect(stats: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    tables = [np.zeros(n) for n in sizes]
    rows = stats.groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    for i, table in enumerate(tables):
        mine = rows[rows.kind == i]
        table[mine.bucket.to_numpy()] = mine.n.to_numpy()
    return tables


SUSPECT = "doc_id bigint, field string, pool int, text string, units array<array<string>>"


def _suspects(model):
    """Documents with the evidence of those units that some chain may explain."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*model.value)
        for b in batches:
            hit, units = [], []
            for i, text in enumerate(b.column(3).to_pylist()):
                if not text or text.isascii():
                    continue
                tokens = [evidence(unit)[1] for unit in UNIT.findall(text) if not unit.isascii()]
                if own := [x for x in tokens if max(m.gains(x).values(), default=-KEEP) > -KEEP]:
                    hit.append(i)
                    units.append(own)
            taken = b.take(pa.array(hit, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(units, pa.list_(pa.list_(pa.string())))], names=["doc_id", "field", "pool", "text", "units"])

    return keep


def _expect(model, shares):
    """Statistics of an E step: kinds 0 to 2 what changes in the pair model, 3 chains per source."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, share = Model(*model.value), shares.value
        tables = [np.zeros(n) for n in (PAIRS, SINGLES, SINGLES, SOURCES * len(NAMES))]
        for b in batches:
            moved: Counter[str] = Counter()
            alike = Counter((s, tuple(tokens)) for s, units in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for tokens in units)
            for (s, tokens), n in alike.items():
                for i, p in posterior(m.gains(tokens), share[s])[2].items():
                    tables[3][s * len(NAMES) + i] += n * p
                    if p > 0.01:
                        for t in tokens:
                            if (new := undo(t[1:-1], NAMES[i])) is not None:
                                moved[t] -= n * p
                                moved[t[0] + new.replace(LOST, "") + t[-1]] += n * p
            _add(tables, moved)
        yield _sparse(tables)

    return step


REPAIR = "doc_id bigint, field string, damaged_units int, chains array<string>, probability double, restored boolean, text string"


def _repair(model, shares):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, share = Model(*model.value), shares.value
        for b in batches:
            rows, judgements = [], {}
            for key, field, pool, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                own, parts, chains, intact = share[pool], [], [], 0.0
                judged = judgements.setdefault(pool, {})
                for unit in UNIT.findall(text):
                    found, tokens = evidence(unit)
                    if tokens not in judged:
                        judged[tokens] = posterior(m.gains(tokens), own)[:2] if found else (-1, 0.0)
                    best, p = judged[tokens]
                    intact += math.log1p(-min(p, 1 - 1e-9))
                    if p > 0.5:
                        if NAMES[best] == "lost":  # part of it may still come back
                            others = {i: g for i, g in m.gains(tokens).items() if NAMES[i] != "lost" and g > 8}
                            best = max(others, key=others.get, default=best)
                        chains.append(NAMES[best])
                        at, pieces = 0, []
                        whole = undo_unit(unit, NAMES[best])
                        if whole is not None:
                            parts.append(whole)
                            continue
                        for start, end, t in found:
                            new = undo(t[1:-1], NAMES[best])
                            if new is not None and dict(m.effects(t)).get(best, 0.0) > -4:
                                pieces += [unit[at:start], new]
                                at = end
                        unit = "".join(pieces) + unit[at:]
                    parts.append(unit)
                if chains:
                    fixed = "".join(parts)
                    rows.append((key, field, len(chains), sorted(set(chains)), 1 - math.exp(intact), LOST not in fixed, fixed))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.float64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "field", "damaged_units", "chains", "probability", "restored", "text"])

    return step


def repair_encoding(documents: DataFrame, key: str = "doc_id", texts: tuple[str, ...] = ("text",), source: str = "source") -> DataFrame:
    """The damaged records only, one row for each damaged field: doc_id, field, damaged_units, the chains, the probability that any unit is damaged,
    restored (false where characters are lost for good) and the repaired text.

    Null, empty and ASCII texts are intact. Texts are read whole, whatever their length; equal texts get equal
    results within a source and field, which pool their evidence (in SOURCES buckets by hash). Null sources are one
    source. Other columns aren't read. An empty table gives none."""
    spark = documents.sparkSession
    pool = lambda field: F.pmod(F.xxhash64(source_key(F.col(source)), F.lit(field)), F.lit(SOURCES)).cast("int").alias("pool")
    parts = [documents.select(F.col(key).cast("bigint").alias("doc_id"), F.lit(t).alias("field"), pool(t), F.col(t).alias("text")) for t in texts]
    docs = reduce(DataFrame.unionByName, parts)
    base = _collect(docs.select("text").mapInArrow(_count, TABLE), [PAIRS, SINGLES, SINGLES])
    units = docs.groupBy("pool").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) / 90.0 + 1).alias("n"))
    sizes = np.zeros(SOURCES)
    for r in units.collect():  # at most SOURCES rows
        sizes[r["pool"]] = r["n"]
    shares = np.full((SOURCES, len(NAMES)), PRIOR / len(NAMES))
    model = base
    send = spark.sparkContext.broadcast
    found = docs.mapInArrow(_suspects(send(tuple(model))), SUSPECT)
    # The rounds see a few of the documents, and each task learns the effects of the chains anew: fewer, larger tasks.
    suspects = cut(found)
    suspects = suspects.coalesce(max(2, suspects.rdd.getNumPartitions() // 3))
    for _ in range(ROUNDS):
        stats = suspects.select("pool", "units").mapInArrow(_expect(send(tuple(model)), send(shares)), TABLE)
        *moved, chains = _collect(stats, [PAIRS, SINGLES, SINGLES, SOURCES * len(NAMES)])
        model = [x + y for x, y in zip(base, moved)]
        chains = chains.reshape(SOURCES, len(NAMES))
        everywhere = (chains.sum(axis=0) + PRIOR) / (sizes.sum() + len(NAMES))
        shares = (chains + 50 * everywhere) / (sizes[:, None] + 50)
        shares = np.clip(shares, 1e-7, 0.5 / len(NAMES) + 0.5 * shares)
    return suspects.mapInArrow(_repair(send(tuple(model)), send(shares)), REPAIR)
