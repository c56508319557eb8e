"""Joins whose large side may hold a few very frequent keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

PARTS = 2000


def spread_join(
    big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", parts: int = PARTS, least: int = 10_000, counted: tuple[DataFrame, float] | None = None
) -> DataFrame:
    """big join small on equal keys ('inner' or 'left'), where a key may own any share of big.

    One aggregation first counts the keys, a key with a null as well. Keys with more than 1/parts of big's rows and more
    than `least`, fewer than `parts` of them, are frequent. Their rows in big are dealt to as many numbers as they have such
    shares, and their rows in small are repeated for each number, so no task gets more than about 1/parts of big for one
    key. Rows are dealt by a hash of their columns. Null keys match nothing: an inner join leaves them out, a left join
    deals frequent ones like any other, without a partner in small. With no frequent key it is a plain join. The result
    is the same either way.

    Where big is dear to make, `counted` gives rows like a share of it, from which its frequent keys are estimated."""
    if how not in ("inner", "left"):
        raise ValueError(how)
    seen, (sample, share) = Observation(), counted or (big, 1.0)
    counts = sample.select(*keys).observe(seen, F.count(F.lit(1)).alias("n")).groupBy(*keys).agg((F.count(F.lit(1)) / share).cast("bigint").alias("_n"))
    if how == "inner":
        counts = counts.na.drop(subset=keys)
    top = counts.filter(F.col("_n") > least).orderBy(F.desc("_n")).limit(parts).collect()  # holds all with over 1/parts
    heavy_at = max(least, int((seen.get or {}).get("n", 0) / share) // parts) if top else least
    listed = [(*r[:-1], -(-r["_n"] // heavy_at)) for r in top if r["_n"] > heavy_at]
    if not listed:
        return big.join(small, keys, how)
    schema = ", ".join(f"`{k}` {big.schema[k].dataType.simpleString()}" for k in keys) + ", _deal int"
    known = F.broadcast(big.sparkSession.createDataFrame(listed, schema))
    same = reduce(and_, [big[k].eqNullSafe(known[k]) for k in keys])
    deal = F.coalesce("_deal", F.lit(1))
    number = F.pmod(F.xxhash64(*[big[c] for c in big.columns]), F.lit(1 << 40))  # of the row, so a recomputed task deals alike
    dealt = big.join(known, same, "left").select(*[big[c] for c in big.columns], F.pmod(number, deal).cast("int").alias("_salt"))
    repeated = small.join(known, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), deal - 1))).drop("_deal")
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")

