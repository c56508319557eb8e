import datetime

from pyspark.sql import functions as F

from skyloom.operators import merge as G
from skyloom.operators.skew import spread_join

T = datetime.datetime
H = "id bigint, archive_code string, archive_obs_id string, star_id bigint, instrument string, obs_date date, match_status string, raw_target_name string, reduction_status string, first_seen_at timestamp, updated_at timestamp"


def row(i, a, o, star=None, status="matched", name=None, inst="I", day=datetime.date(2010, 7, 28), red="raw", t=1):
    return (i, a, o, star, inst, day, status, name, red, T(2020, 1, t), T(2020, 1, t))


def test_upsert_is_idempotent_and_keeps_first_seen(spark):
    old = spark.createDataFrame([row(1, "a", "x"), row(2, "a", "y")], H)
    new = spark.createDataFrame([row(None, "a", "y", 7, t=5, red=None), row(None, "a", "z", 8, t=6), row(None, "a", "z", 9, t=7)], H)
    once = G.assign_ids(G.upsert(old, new, [F.col("updated_at")]), "id", G.KEY)
    again = G.assign_ids(G.upsert(once, new, [F.col("updated_at")]), "id", G.KEY)
    want = [(1, "x", None, "raw", 1), (2, "y", 7, "unknown", 1), (3, "z", 9, "raw", 6)]
    for df in (once, again):
        assert sorted((r["id"], r["archive_obs_id"], r["star_id"], r["reduction_status"], r["first_seen_at"].day) for r in df.collect()) == want
    assert G.upsert(old.limit(0), new.limit(0), [F.col("updated_at")]).count() == 0


def test_raw_rows_give_way(spark):
    h = spark.createDataFrame([row(1, "raw", "a", 5), row(2, "red", "b", 5), row(3, "raw", "c", 6), row(4, "raw", "d", 5, day=None), row(5, "raw", "e", 5), row(6, "raw", "f", 5, inst="J"), row(7, "raw", "g", 5, status="skipped")], H)
    votes = spark.createDataFrame([("raw", "e")], "archive_code string, archive_obs_id string")
    assert sorted(r["id"] for r in G.reconcile_raw(h, votes, "raw", "red").collect()) == [2, 3, 4, 5, 6, 7]


def test_votes(spark):
    h = spark.createDataFrame([row(i, "a", f"o{i}", status="skipped", name=" flat ") for i in range(5)] + [row(9, "a", "o9", status="skipped", name="HD 1"), row(10, "a", "m", name="HD 1")], H)
    v = "vote_id bigint, archive_code string, archive_obs_id string, raw_target_name string, outcome string, submitter string, submitted_at timestamp"
    day = T(2024, 1, 1)
    lines = [
        (1, "a", None, "flat", "not_a_star", "u", day), (2, "a", None, "HD 1", "not_a_star", "u", day), (3, "a", "o9", None, "not_a_star", "u", day), (4, "a", "o1", None, "nonsense", "u", day),
        (5, "a", "o1", "flat", "not_a_star", "u", day), (6, "a", None, "flat", "attach_gaia_source", "w", day), (7, "a", "o2", None, "not_a_star", "x", day), (8, "a", None, None, "not_a_star", "x", day),
    ]
    none = spark.createDataFrame([("a", "o2", "x")], "archive_code string, archive_obs_id string, submitter string")
    got = sorted((r["archive_obs_id"], r["submitter"], r["vote_id"]) for r in G.import_votes(spark.createDataFrame(lines, v), h, none, most=4).collect())
    assert got == [("o0", "w", 6), ("o1", "w", 6), ("o2", "w", 6), ("o3", "w", 6), ("o4", "w", 6), ("o9", "u", 2)]


def test_new_stars_and_aliases(spark):
    s = spark.createDataFrame([(1, 70, "gaia", ["A", None]), (2, None, "bsc5", None)], "star_id bigint, gaia_source_id bigint, source_catalog string, name_aliases array<string>")
    f = spark.createDataFrame([(70, ["B", "A"]), (71, ["C"]), (71, ["C", "D"])], "gaia_source_id bigint, name_aliases array<string>")
    got = {r["star_id"]: (r["gaia_source_id"], r["name_aliases"]) for r in G.add_stars(s, f).collect()}
    assert got == {1: (70, ["A", None, "B"]), 2: (None, None), 3: (71, ["C", "D"])}
    ids = spark.createDataFrame([("HD 1|Gaia DR3 123| HR 9",), ("",), (None,)], "x string").select(G.resolve_id(F.col("x"), "Gaia DR3 "), G.resolve_id(F.col("x"), "HR ")).collect()
    assert [tuple(r) for r in ids] == [(123, 9), (None, None), (None, None)]


def test_spread_join_equals_join(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c"), (None, "d")], "k bigint, v string")
    for how in ("inner", "left"):
        key = lambda df: sorted((r["id"], r["v"] or "") for r in df.collect())
        assert key(spread_join(big, small, ["k"], how, parts=20, least=1)) == key(big.join(small, ["k"], how))


def test_spread_join_deals_null_keys(spark):
    """Nearly all keys are null and no other is frequent: no task gets them all, and none is lost."""
    big = spark.range(20_000).select(F.when(F.col("id") % 100 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    small = spark.range(0, 20_000, 200).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = spread_join(big, small, ["k"], "left", parts=8, least=100)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 11_000 and joined.filter("w IS NOT NULL").count() == 100
        assert spread_join(big, small, ["k"], "inner", parts=8, least=100).count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
