"""Freely typed values to the entries of a reference list.

A typed value is first cleaned: compatibility forms, letter case, accents, letters of other alphabets that look
Latin, quotes, observing remarks. What is left is either a designation with a number ("HD 400684", "Gl 12658 B",
"V6054 Kel"), which must agree exactly in catalogue, number and component after the usual slips (leading zeros,
letter O for zero), or a name of words. Designations of other catalogues are read as their letters and numbers, and
names in other scripts as they stand.

All of them are looked up in one index by symmetric deletion: every string left when some of the first PREFIX letters
are deleted, together with all the numbers, is a key of the entry; two letters at most of a name, one of a designation.
A typed value has the same keys, so what lies within as many edits shares one, and candidates come from an equi-join on
hashed keys. That numbers and the component letter agree, and how far words may differ, is then tested exactly. A name
whose last word is cut short has keys of its own, made of the words before it and the initial. The index goes to
every task when its measured size is under `broadcast_rows`; beyond it, it is joined by shuffle, with frequent keys
(short remains of many names) spread. Candidates are ranked by weighted
Damerau-Levenshtein distance and then by how often the reference entry occurs; a tie between different targets
is reported as ambiguous, what has no candidate as unmatched.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators.skew import spread_join
from skyloom.session import cut

PREFIX, EDITS = 7, 2
SAMPLED = 16  # one typed value of so many shows which keys are frequent
KEYS = 37  # keys that an entry has at most: 29 remains of a name and 8 of its head
# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("абвгеёзікмнорстухѕјԁԛԝυοαερκιντχ", "abbree3ikmhopctyxsjdqwuoaepkivtx")
PREFIXES = re.compile(r"^(?:\([^)]*\)\s*|(?:obj|object|target|std|star|sci|name|field)\s*[:=]\s*|(?:std|star|sci|name)[\s_]+)")
SUFFIXES = re.compile(r"(?:\s*\[[^\]]*\]|\s*\([^)]*\)|[\s_-]+(?:-\s*)?(?:exp|seq|night|repeat|frame|s)[\s_]*\d+|\s*#\s*\d+)$")
GAP = r"[\s_.\-]*"
NUM = r"([0-9oil]+)"
FORMS = [
    (re.compile(rf"^(hd|hip){GAP}{NUM}{GAP}([a-z]?)$"), lambda m: f"{m[1]} {number(m[2])} {m[3]}"),
    (re.compile(rf"^(?:gj|gl|gliese){GAP}([0-9oil]+(?:\.[0-9oil]+)?){GAP}([a-z]?)$"), lambda m: f"gj {number(m[1])} {m[2]}"),
    (re.compile(rf"^tyc{GAP}{NUM}[\s_\-]+{NUM}[\s_\-]+{NUM}$"), lambda m: f"tyc {number(m[1])}-{number(m[2])}-{number(m[3])}"),
    (re.compile(rf"^(?:gaia{GAP}(?:e?dr([0-9]))?|g(?:e?dr([0-9]))){GAP}(?:source)?{GAP}([0-9oil]{{8,}})$"), lambda m: f"gaia dr{m[1] or m[2] or 3} {number(m[3])}"),
    (re.compile(rf"^(?:v{GAP}\*{GAP})?v{GAP}{NUM}{GAP}([a-z]{{3}})$"), lambda m: f"v {number(m[1])} {m[2]}"),
    (re.compile(rf"^\*?{GAP}{NUM}{GAP}([a-z]{{3}})$"), lambda m: f"* {number(m[1])} {m[2]}"),
]
# The Greek letters, their names and the abbreviations that star catalogues use.
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
LETTERS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SHORT = "alf bet gam del eps zet eta tet iot kap lam mu nu ksi omi pi rho sig tau ups phi chi psi ome".split()
BAYER = {**dict(zip(GREEK, SHORT)), **dict(zip(LETTERS, SHORT)), **dict(zip(SHORT, SHORT))}
BAYER_FORM = re.compile(r"^\*?[\s_.\-]*([α-ω]|[a-z]{2,7}?)\.?[\s_.\-]*([a-z]{3})$")
WORDS = re.compile(r"[a-z]+")
TOKENS = re.compile(r"(\+?)([0-9]+(?:\.[0-9]+)?|[^\W\d_]+)")


def number(s: str) -> str:
    whole, dot, part = s.replace("o", "0").replace("i", "1").replace("l", "1").partition(".")
    return (whole.lstrip("0") or "0") + dot + part


def clean(value: str) -> str:
    s = unicodedata.normalize("NFKD", value).casefold().replace("ς", "σ")
    s = re.sub(r"(?<![^\W_])([α-ω])(?=[\s_.\-]*[a-z]{3}(?![a-z]))", lambda m: BAYER[m[1]] + " ", s).translate(LOOKALIKES)
    s = "".join(c for c in s if not unicodedata.combining(c))
    while True:
        before = s
        s = s.strip(" \t\r\n'\"`“”‘’«»​﻿")
        s = SUFFIXES.sub("", PREFIXES.sub("", s))
        if s == before:
            return s


def parse(value: str | None) -> tuple[str, str] | None:
    """('code', key) of a designation of a known catalogue, ('mixed', its letters and numbers) of others with numbers,
    ('name', its words) of a name, ('other', the cleaned value) of what is left, None of blanks and signs. A comma
    between two words means that they are swapped."""
    s = clean(value) if value else ""
    for form, key in FORMS:
        if m := form.match(s):
            return "code", key(m).strip()
    if (m := BAYER_FORM.match(s)) and m[1] in BAYER:
        return "code", f"* {BAYER[m[1]]} {m[2]}"
    if not any(map(str.isalnum, s)):
        return None
    if re.search(r"[0-9]", s):
        tokens = TOKENS.findall(s)
        return "mixed", " ".join(sign + number(t) if t[0].isdigit() else t for sign, t in tokens)
    words = WORDS.findall(s)
    if re.fullmatch(r"[a-z]+\s*,\s*[a-z]+", s):
        words.reverse()
    if sum(map(len, words)) >= 4 and len(words) <= 4 and not any(c.isalpha() and not c.isascii() for c in s):
        return "name", " ".join(words)
    return "other", " ".join(s.split())


def remains(s: str, most: int) -> set[str]:
    """What is left of the first PREFIX letters when up to `most` of them are deleted."""
    s = s[:PREFIX]
    return {"".join(c for i, c in enumerate(s) if i not in gone) for n in range(most + 1) for gone in combinations(range(len(s)), n)}


def deletions(form: str, key: str, typed: bool) -> set[int]:
    """Hashes of the keys under which a value is looked up, or an entry found. A designation of a known catalogue is
    typed as that catalogue has it, so its own key suffices."""
    tokens = key.split(" ")
    numbers = " ".join(t for t in tokens if t[-1].isdigit())
    letters = "".join(t for t in tokens if not t[-1].isdigit())
    keys = {f"{x}|{numbers}" for x in remains(letters, (0 if form == "code" and typed else 1) if numbers else EDITS)}
    if form == "name" and len(tokens) > 1:
        keys |= {f"{x}>{tokens[-1][0]}" for x in remains("".join(tokens[:-1]), 1)}
    return {xxhash.xxh64_intdigest(x) - (1 << 63) for x in keys}


def edits(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein distance, infinite above `most`: a transposition of neighbours and a
    doubled or undoubled letter count 0.8, other edits 1."""
    if abs(len(a) - len(b)) > most + 1:
        return float("inf")
    old, row = [], [float(i) for i in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        older, old, row = old, row, [float(i)]
        for j, y in enumerate(b, 1):
            best = min(
                old[j] + (0.8 if i > 1 and a[i - 2] == x else 1), row[j - 1] + (0.8 if j > 1 and b[j - 2] == y else 1), old[j - 1] + (x != y)
            )
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 0.8)
            row.append(best)
        if min(row) > most:
            return float("inf")
    return row[-1] if row[-1] <= most else float("inf")


def cost(typed: str, entry: str) -> float:
    """What separates a typed value from an entry. Spaces don't count in names. A last word cut short, down to an
    initial, costs 0.5 besides the edits of the words before it. Where there are numbers, all of them and all single
    letters must be the same; one other word may be misspelt, and one of up to three letters only by a swap or
    a double. Names of fewer than four characters must be the same."""
    if typed == entry:
        return 0.0
    if any(map(str.isdigit, typed)) or any(map(str.isdigit, entry)):
        a, b = typed.split(" "), entry.split(" ")
        odd = [(x, y) for x, y in zip(a, b) if x != y]
        if len(a) != len(b) or len(odd) != 1 or min(map(len, odd[0])) < 2 or odd[0][0][-1].isdigit() or odd[0][1][-1].isdigit():
            return float("inf")
        c = edits(*odd[0], 1)
        return c if c < 1 or min(map(len, odd[0])) > 3 else float("inf")
    if min(len(typed), len(entry)) < 4:
        return float("inf")
    whole = edits(typed.replace(" ", ""), entry.replace(" ", ""), EDITS)
    head, _, tail = typed.rpartition(" ")
    head0, _, tail0 = entry.rpartition(" ")
    if head and head0 and len(tail) < len(tail0) and tail0.startswith(tail):
        whole = min(whole, edits(head.replace(" ", ""), head0.replace(" ", ""), 1) + 0.5)
    return whole


PARSED = "value string, form string, key string"


def _parse_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [parse(v) or (None, None) for v in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([f[i] for f in found], pa.string()) for i in range(2)]], names=["value", "form", "key"])


def _delete(typed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(1).to_pylist()
            hashes = [deletions(f, k, typed) for f, k in zip(b.column(0).to_pylist(), keys)]
            at = np.repeat(np.arange(len(keys)), [len(x) for x in hashes])
            flat = np.fromiter((h for x in hashes for h in x), np.int64, len(at))
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(at)), pa.array(flat)], names=["typed" if typed else "entry", "hash"])

    return run


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        typed, entry = (b.column(i).to_pylist() for i in range(2))
        found = [(t, e, c) for t, e in zip(typed, entry) if (c := cost(t, e)) <= EDITS + 0.5]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.float64())], names=["typed", "entry", "cost"])


def plausible(typed: Column, entry: Column) -> Column:
    """What cost() may accept, by built-in functions: every pair it accepts passes. Two transpositions are four plain
    edits; before a last word that is cut short, one is two."""
    head, head0 = (F.regexp_replace(F.regexp_replace(x, " [^ ]*$", ""), " ", "") for x in (typed, entry))
    tail, tail0 = F.substring_index(typed, " ", -1), F.substring_index(entry, " ", -1)
    whole = F.levenshtein(F.replace(typed, F.lit(" "), F.lit("")), F.replace(entry, F.lit(" "), F.lit("")), 2 * EDITS) >= 0
    return whole | (typed.contains(" ") & entry.contains(" ") & F.startswith(tail0, tail) & (F.levenshtein(head, head0, 2) >= 0))


def similar_names(typed: DataFrame, entries: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """(typed, entry, cost) for all distinct keys of `typed` and `entries` (columns form and key) that cost() accepts."""
    spark = typed.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # partitioned by number, so that few small rows are not put into one task before they are multiplied
    keys = typed.select("form", "key").distinct().repartition(parts, "key")
    asked, some = (df.mapInArrow(_delete(True), "typed string, hash bigint") for df in (keys, keys.filter(F.pmod(F.xxhash64("key"), F.lit(SAMPLED)) == 0)))
    index = entries.select("form", "key").distinct().repartition(parts, "key").mapInArrow(_delete(False), "entry string, hash bigint")
    small = entries.select("form", "key").distinct().limit(broadcast_rows // KEYS + 1).count() * KEYS <= broadcast_rows
    met = asked.join(F.broadcast(index), "hash") if small else spread_join(asked, index, ["hash"], counted=(some, 1 / SAMPLED))
    pairs = met.filter(plausible(F.col("typed"), F.col("entry"))).select("typed", "entry").distinct()
    return pairs.mapInArrow(_costs, "typed string, entry string, cost double")


def map_values(values: DataFrame, column: str, reference: DataFrame, entry: str, target: str, broadcast_rows: int = 200_000) -> DataFrame:
    """One row per distinct non-null value of `column`: value, status ('matched', 'ambiguous', 'unmatched'),
    target (of reference.target), entry (the spelling in the list) and cost.

    Null, empty and placeholder values are unmatched or absent (null). A reference entry that is null or cannot
    be read takes no part, repeated ones count as frequency. An entry of several targets is ambiguous. A value
    of any length is read whole. Columns besides those named are ignored, whatever their names."""
    listed = reference.select(F.col(entry).alias("value"), F.col(target).alias("target")).filter("value IS NOT NULL AND target IS NOT NULL")
    names = listed.groupBy("value", "target").count().mapInArrow(_parse_reference, "entry string, target bigint, times bigint, form string, key string")
    lists = cut(names.groupBy("form", "key", "target").agg(F.min("entry").alias("entry"), F.sum("times").alias("times")))
    typed = cut(values.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct().mapInArrow(_parse_all, PARSED))  # both are read several times
    known, words0 = typed.filter("key IS NOT NULL"), lists.withColumnRenamed("key", "entry_key")
    near = similar_names(known, lists, broadcast_rows).withColumnRenamed("entry", "entry_key").withColumnRenamed("typed", "key")
    spelled = known.join(near, "key").join(words0.drop("form"), "entry_key")
    cols = ["value", "target", "entry", "cost", "times"]
    close = F.col("cost") <= F.min("cost").over(Window.partitionBy("value")) + 0.15
    best = spelled.select(*cols, close.alias("close")).groupBy("value").agg(
        F.min_by(F.struct("target", "entry", "cost"), F.struct("cost", -F.col("times"), "target")).alias("best"),
        # whether another target costs as little: the least and the greatest of those close say so, without a list
        (F.min(F.when(F.col("close"), F.col("target"))) != F.max(F.when(F.col("close"), F.col("target")))).alias("rival"),
    )
    judged = best.select("value", F.when(F.col("rival"), "ambiguous").otherwise("matched").alias("status"), "best")
    return typed.select("value").join(judged, "value", "left").select(
        "value", F.coalesce("status", F.lit("unmatched")).alias("status"),
        F.when(F.col("status") == "matched", F.col("best.target")).alias("target"), F.col("best.entry").alias("entry"), F.col("best.cost").alias("cost"),
    )


def _parse_reference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(v, t, n, *p) for v, t, n in zip(*(b.column(i).to_pylist() for i in range(3))) if (p := parse(v))]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["entry", "target", "times", "form", "key"])


def target_names(holdings: DataFrame, stars: DataFrame) -> DataFrame:
    """raw_target_name, status, star_id, alias, cost: each distinct target name of the holdings rows with the star
    whose name_aliases entry it spells."""
    aliases = stars.select("star_id", F.explode("name_aliases").alias("alias"))
    return map_values(holdings, "raw_target_name", aliases, "alias", "star_id").select(
        F.col("value").alias("raw_target_name"), "status", F.col("target").alias("star_id"), F.col("entry").alias("alias"), "cost"
    )
