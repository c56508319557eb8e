import random

from pyspark.sql import functions as F

from skyloom.operators import match
from skyloom.operators.match import fallback_match, merge_candidates, pick_best
from skyloom.operators.merge import register_winners

STARS = "star_id bigint, gaia_source_id bigint, source_catalog string, ra double, dec double, ref_epoch double, pmra double, pmdec double, phot_g_mean_mag double, name_aliases array<string>"
GUESS = "t_id bigint, star_id bigint, gaia_source_id bigint, theta_arcsec double, reason string"


def test_winners_are_picked_once(spark):
    """What follows the guesses, filters too, doesn't reach into the plan that picks them."""
    tracked = spark.createDataFrame([(5, 70, "gaia", 1.0, 1.0, 2016.0, 0.0, 0.0, 9.0, [])], STARS)
    pool = spark.createDataFrame([(71, 2.0, 2.0)], "source_id bigint, ra double, dec double")
    guesses = spark.createDataFrame([(1, 5, 70, 1.0, "only one"), (2, None, 71, 1.0, "only one"), (3, None, 71, 2.0, "brightest"), (4, None, None, None, "all too faint")], GUESS)
    picked = guesses.filter(F.abs(F.hash("reason", F.lit("picked"))) >= 0)
    grown, filled = register_winners(tracked, picked, pool)
    plan = filled.filter("gaia_source_id IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert "picked" not in plan
    ids = {r["gaia_source_id"]: r["star_id"] for r in grown.collect()}
    assert set(ids) == {70, 71} and ids[70] == 5
    assert {r["t_id"]: r["star_id"] for r in filled.collect()} == {1: 5, 2: ids[71], 3: ids[71], 4: None}


def test_fast_sources_compete(spark):
    """A source that drifts out of the half degree about its place between its epoch and the record's date is a candidate."""
    years = 2016.0 - 1850.0
    pool = spark.createDataFrame([(71, 100.0, 0.0, 2016.0, 0.0, 30_000.0, 9.0)], "source_id bigint, ra double, dec double, ref_epoch double, pmra double, pmdec double, phot_g_mean_mag double")
    target = spark.createDataFrame([(1, "unit", 100.0, -30.0 * years / 3600, 1850.0)], "t_id bigint, archive_code string, t_ra double, t_dec double, t_year double")
    tracked = spark.createDataFrame([], STARS).drop("name_aliases")
    got = fallback_match(target, tracked, pool, 1850.0, 2050.0).collect()
    assert [(r["t_id"], r["gaia_source_id"], r["reason"]) for r in got] == [(1, 71, "only one")]


POOL = "source_id bigint, ra double, dec double, ref_epoch double, pmra double, pmdec double, phot_g_mean_mag double"
TARGET = "t_id bigint, archive_code string, t_ra double, t_dec double, t_year double"
HERE = (100.0, 10.0, 2016.0, 20.0, None)


def test_sources_of_one_place_are_not_multiplied(spark, monkeypatch):
    """Of sources that share place, epoch and motion those that can decide are paired with a target, however many there are."""
    seen = []
    monkeypatch.setattr(match, "pick_best", lambda near, key: seen.append(near.groupBy(*key).count().collect()) or pick_best(near, key))
    stars = [(i, 1000 + i, "gaia", *HERE, 9.0 + i / 10) for i in range(40)] + [(100 + i, None, "bsc5", 101.0, *HERE[1:], None) for i in range(40)]
    pool = [(1000 + i, *HERE, 9.0 + i / 10) for i in range(40)] + [(3000 + i, 102.0, *HERE[1:], 9.0 + 3 * i) for i in range(40)]
    targets = [(t, "unit", 100.0 + t % 3, 10.0, 2010.0) for t in range(9)]
    got = match.fallback_match(spark.createDataFrame(targets, TARGET), spark.createDataFrame(stars, STARS.removesuffix(", name_aliases array<string>")), spark.createDataFrame(pool, POOL), 1850.0, 2050.0).collect()
    want = [(None, None, "lead too small"), (100, None, "bright catalogue"), (None, 3000, "brightest")]
    assert {r["t_id"]: (r["star_id"], r["gaia_source_id"], r["reason"]) for r in got} == {t: want[t % 3] for t in range(9)}
    assert len(seen[0]) == 9 and max(r["count"] for r in seen[0]) <= 3


def test_guesses_are_those_of_all_pairs(spark):
    """Against all pairs merged as they are: shared places, ids held twice, here and elsewhere, and sources without id."""
    rng = random.Random(5)
    place = lambda: (100.0 + rng.choice([0.0, 0.002, 0.004]) + rng.choice([0, 40]), 10.0 + rng.choice([0.0, 0.003]), 2016.0, rng.choice([0.0, None, 900.0]), 0.0)
    mag = lambda: rng.choice([None, float("nan"), 9.0, 11.0, 11.5, 14.0, 17.0, 19.0])
    stars = [(i, rng.choice([None, *range(60)]), rng.choice(["gaia", "gaia", "gaia", None, "bsc5" if i % 9 == 0 else "gaia"]), *place(), mag()) for i in range(25)]
    pool = [(rng.choice([None, *range(60)]), *place(), mag()) for _ in range(25)]
    far = [(900, None, "gaia", None, 1.0, 2016.0, 0.0, 0.0, 5.0), (901, 77, "gaia", 100.0, 10.0, 2016.0, float("nan"), 0.0, 5.0)]
    stars, pool = spark.createDataFrame(stars + far, STARS.removesuffix(", name_aliases array<string>")), spark.createDataFrame(pool, POOL)
    for radius in (4.0, 9.0, 60.0):
        rows = [(t, "gtc" if t % 2 else "unit", 100.0 + rng.uniform(-0.001, 0.005) + rng.choice([0, 40]), 10.0 + rng.uniform(-0.001, 0.004), rng.choice([None, 1990.0, 2020.0])) for t in range(60)]
        targets = spark.createDataFrame(rows, TARGET)
        got = match.fallback_match(targets, stars, pool, 1850.0, 2050.0, radius)
        cols = ["t_id", "archive_code", "star_id", "gaia_source_id", "source_catalog", F.col("sep_arcsec").alias("separation_arcsec"), "phot_g_mean_mag"]
        live = pool.withColumnRenamed("source_id", "gaia_source_id").withColumns({"star_id": F.lit(None).cast("bigint"), "source_catalog": F.lit("gaia_untracked")})
        near, live = (match.radial_pairs(targets.withColumn("t_radius", F.lit(radius)), df.filter("NOT isnan(coalesce(pmra, 0))"), radius, 1850.0, 2050.0).select(*cols) for df in (stars, live))
        want = pick_best(merge_candidates(near, live, ["t_id"]), ["t_id"]).selectExpr("t_id", "winner.star_id", "winner.gaia_source_id", "winner.sep", "reason")
        read = lambda df: {r[0]: (r[1], r[2], r[3] and round(r[3], 6), r[4]) for r in df.collect()}
        assert read(got) == read(want) and len(read(got)) > 20
