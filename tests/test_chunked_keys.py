import random
from itertools import groupby

from pyspark.sql import functions as F

from skyloom.operators.chunked_keys import _pieces, key_sequences, number_rows

SCHEMA = "k string, t bigint, id bigint, v string, _key string, n_rows string"


def brute(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] is not None, r[3] or "")
    out = {}
    for key, group in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", *order(r))), key=lambda r: r[0]):
        g = list(group)
        gaps = [b[1] - a[1] for a, b in zip(g, g[1:]) if a[1] is not None and b[1] is not None]
        out[key] = (len(g), sum(a[3] != b[3] for a, b in zip(g, g[1:])), max(gaps, default=None), g[0][1], g[-1][1], g[0][3], g[-1][3])
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = key_sequences(df, ["k"], F.col("t"), F.col("id"), F.col("v"), **kw).collect()
    return {r["k"]: tuple(r)[1:] for r in got}


def test_uneven_keys_against_brute_force(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), i, rng.choice(["p", "q", None])) for i in range(900)]
    rows += rows[:50]  # repeated rows count each
    assert run(spark, rows, chunk_rows=37, most_ranges=5) == brute(rows)
    assert run(spark, rows, chunk_rows=10_000) == brute(rows)


def test_many_chunks_merge_in_two_levels(spark):
    rows = [("k", i, i, "pq"[i % 2]) for i in range(3000)]
    assert run(spark, rows, chunk_rows=2, most_ranges=40) == {"k": (3000, 2999, 1, 0, 2999, "p", "q")}


def test_empty_single_and_tied(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", None, 1, None)]) == {"a": (1, 0, None, None, None, None, None)}
    assert run(spark, [("a", 5, i, "v") for i in range(20)], chunk_rows=3) == {"a": (20, 0, 0, 5, 5, "v", "v")}


def test_numbers_are_exact(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id"))
    got = number_rows(df, ["k"], [F.col("id")], chunk_rows=70).select("_key.k", "id", "_number").collect()
    assert all(r["_number"] == r["id"] // 3 for r in got) and len(got) == 500


def test_one_time_value_with_most_rows_is_cut(spark):
    """Nine tenths of the rows share key and time: no window partition exceeds chunk_rows, with few ranges as well."""
    df = spark.range(5000).select(F.struct(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("k0")).alias("_key"), F.lit(7).alias("_at"), F.col("id").alias("_tie"))
    for ranges in (3, 1000):
        sizes = _pieces(df, [F.col("_at"), F.col("_tie")], 100, ranges).groupBy("_key", "_piece").count()
        assert sizes.agg(F.max("count"), F.sum("count")).first()[:] == (100, 5000)
    rows = [("hot" if i % 10 else None, 7, i, "pq"[i // 3 % 2]) for i in range(1000)]
    assert run(spark, rows, chunk_rows=20) == brute(rows)
    assert run(spark, rows, chunk_rows=20, most_ranges=2) == brute(rows)
