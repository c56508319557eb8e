"""Per-key results over keys of any unevenness, by exact offset chunking.

The rows of every key are numbered exactly (0, 1, 2, ... in a given total order) without ever
gathering a key in one task:

1. The rows are partitioned by ranges of (key, order), one range for each `chunk_rows` rows, and sorted. A range may
   begin and end anywhere within a key, also between rows of equal time, as the order goes down to its last
   column. The sorted ranges are written to the shared folder: they are the input partitions of the method, and a
   recomputed task finds the same ones.
2. A row's place in its partition cuts the partition into pieces of chunk_rows rows. Rows are counted per (key, piece)
   with map-side combine, and the counts are prefix-summed per key: every (key, piece) learns the number its
   first row has within the key.
3. row_number within (key, piece) plus that offset is the row's number; number // chunk_rows is its chunk.
4. Each (key, chunk) is folded into small states, at most one for each piece that it touches, and the states of a
   key are merged in the order of their numbers, FAN_IN chunks at a time, joining the last row of a state with the
   first of the next.

No window holds more than chunk_rows rows, whatever share of the table a key or a single time value owns, and
whatever the sample from which the ranges are chosen missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import cut

FAN_IN = 1024
WITHIN = (1 << 33) - 1  # the bits of monotonically_increasing_id that count within a partition


def _pieces(df: DataFrame, order: list[Column], chunk_rows: int, most_ranges: int) -> DataFrame:
    """df (with _key) in sorted ranges, with _at, which grows along (key, order), and _piece, the _at at which the row's piece
    starts. Beyond most_ranges ranges, ranges grow and hold several pieces. Spark chooses the ranges by a sample of 100 keys for
    each, a million at most in all, which is what the driver gets."""
    ranges = max(1, min(most_ranges, -(-df.count() // chunk_rows)))
    by = [F.col("_key").asc_nulls_first(), *[c.asc_nulls_first() for c in order]]
    sorted_ = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    placed = cut(sorted_.withColumn("_at_", F.monotonically_increasing_id()))
    return placed.withColumn("_piece", F.col("_at_") - F.pmod(F.col("_at_").bitwiseAND(F.lit(WITHIN)), F.lit(chunk_rows)))


def _offsets(pieces: DataFrame) -> DataFrame:
    counts = pieces.groupBy("_key", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_key", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))


def number_rows(df: DataFrame, keys: list[str], order: list[Column], chunk_rows: int = 50_000, most_ranges: int = 20_000) -> DataFrame:
    """df with _key (struct of the keys) and _number, the row's 0-based place within its key by `order`.

    `order` must be total for a repeatable result; rows that tie on all of it are numbered arbitrarily but still
    exactly once. A null key is a key of its own; null order values come first."""
    pieces = _pieces(df.withColumn("_key", F.struct(*keys)), order, chunk_rows, most_ranges)
    within = Window.partitionBy("_key", "_piece").orderBy("_at_")
    numbered = pieces.withColumn("_row", F.row_number().over(within)).join(_offsets(pieces), ["_key", "_piece"])
    return numbered.withColumn("_number", F.col("_offset") + F.col("_row") - 1).drop("_offset", "_row", "_piece", "_at_")


def _merge(states: DataFrame, level: str) -> DataFrame:
    """One state for each (_key, level), from those of its members in order."""

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(
            acc["last_at"].isNotNull() & x["first_at"].isNotNull(), x["first_at"] - acc["last_at"]
        )
        return F.struct(
            x["_part"].alias("_part"),
            (acc["n_rows"] + x["n_rows"]).alias("n_rows"),
            (acc["n_changes"] + x["n_changes"] + F.when(acc["last_value"].eqNullSafe(x["first_value"]), 0).otherwise(1)).cast("bigint").alias("n_changes"),
            F.greatest(acc["max_gap"], x["max_gap"], gap).alias("max_gap"),
            acc["first_at"].alias("first_at"),
            x["last_at"].alias("last_at"),
            acc["first_value"].alias("first_value"),
            x["last_value"].alias("last_value"),
        )

    fields = ["_part", "n_rows", "n_changes", "max_gap", "first_at", "last_at", "first_value", "last_value"]
    ordered = F.array_sort(F.collect_list(F.struct(*fields)))
    folded = F.aggregate(F.slice(F.col("_all"), 2, F.size("_all")), F.col("_all")[0], step)
    merged = states.groupBy("_key", level).agg(ordered.alias("_all")).select("_key", level, folded.alias("s"))
    return merged.select("_key", F.col(level).alias("_part"), *[f"s.{x}" for x in fields[1:]])


def key_sequences(
    df: DataFrame, keys: list[str], at: Column, tie: Column, value: Column, chunk_rows: int = 50_000, most_ranges: int = 20_000
) -> DataFrame:
    """For every key: n_rows; n_changes, how often `value` differs between successive rows in the order
    (at, tie); max_gap, the largest difference of successive non-null `at` (a bigint); and first and last at
    and value. Columns: the keys and those names.

    Null keys form keys of their own, a change from or to null counts, an `at` of null comes first and opens
    no gap. Repeated rows count each. An empty table gives no rows. Other columns of df are not read."""
    narrow = df.select(
        F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("_key"),
        at.cast("bigint").alias("_at"), tie.alias("_tie"), value.alias("_value"),
    )
    pieces = _pieces(narrow, [F.col("_at"), F.col("_tie"), F.col("_value")], chunk_rows, most_ranges).drop("_tie")
    inside = Window.partitionBy("_key", "_piece").orderBy("_at_")
    stepped = pieces.select(
        "_key", "_piece", "_at", "_value", F.row_number().over(inside).alias("_row"),
        F.lag("_at").over(inside).alias("_at0"), F.lag("_value").over(inside).alias("_value0"),
    )
    numbered = stepped.join(_offsets(pieces), ["_key", "_piece"]).withColumn("_number", F.col("_offset") + F.col("_row") - 1)
    follows = (F.col("_row") > 1) & (F.pmod("_number", F.lit(chunk_rows)) != 0)  # the row before is in the same state
    states = numbered.groupBy("_key", "_piece", F.floor(F.col("_number") / chunk_rows).alias("_chunk")).agg(
        F.min("_number").alias("_part"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(follows & ~F.col("_value").eqNullSafe(F.col("_value0")), 1)).alias("n_changes"),
        F.max(F.when(follows, F.col("_at") - F.col("_at0"))).alias("max_gap"),
        F.min_by("_at", "_number").alias("first_at"), F.max_by("_at", "_number").alias("last_at"),
        F.min_by("_value", "_number").alias("first_value"), F.max_by("_value", "_number").alias("last_value"),
    )
    parts = states.withColumn("_group", F.floor(F.col("_chunk") / FAN_IN))
    merged = _merge(_merge(parts, "_group").withColumn("_all_", F.lit(0)), "_all_")
    return merged.select(
        *[F.col(f"_key.k{i}").alias(k) for i, k in enumerate(keys)],
        "n_rows", "n_changes", "max_gap", "first_at", "last_at", "first_value", "last_value",
    )
