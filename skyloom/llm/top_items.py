"""The N best items of every group.

One row_number window per group, ordered by score and then by identifiers, with a filter on the rank: the
optimiser's group limit keeps at most N rows of a group in each task before the shuffle and again after it,
so a group of any size costs N rows a task. The order is total, so each run gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_items(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of every group by `order`, all if there are fewer; with their rank when a name for it
    is given. A null group value is a group of its own; where nulls of a score go is said by `order`. Rows that
    tie on all of `order` are interchangeable. Empty tables give none."""
    name = rank or "_rank"
    while rank is None and name in df.columns:
        name = f"_{name}"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def current_rows(holdings: DataFrame) -> DataFrame:
    """Of each delivered observation (archive_code, archive_obs_id) the row with the latest updated_at and,
    among equals, the largest id. Nulls in the key equal each other; a null updated_at is the earliest."""
    latest = [F.col("updated_at").desc_nulls_last(), F.col("id").desc_nulls_last()]
    return top_items(holdings, ["archive_code", "archive_obs_id"], latest, 1)


def latest_observations(holdings: DataFrame, n: int = 5) -> DataFrame:
    """Per star the n latest current observations: star_id, id, obs_date, archive_code, archive_obs_id, place.
    Ties in obs_date go to the smaller archive_code, then the smaller archive_obs_id, in byte order, nulls
    last. Rows without star_id or obs_date have no place."""
    cols = ["id", "star_id", "archive_code", "archive_obs_id", "obs_date", "updated_at"]
    dated = current_rows(holdings.select(*cols)).filter("star_id IS NOT NULL AND obs_date IS NOT NULL")
    order = [F.col("obs_date").desc(), F.col("archive_code").asc_nulls_last(), F.col("archive_obs_id").asc_nulls_last(), F.col("id").asc()]
    return top_items(dated.drop("updated_at"), ["star_id"], order, n, "place")
