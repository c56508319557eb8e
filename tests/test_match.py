import datetime

from skyloom.operators.match import match_records, merge_candidates, pick_best, radial_pairs

STAR = "star_id bigint, gaia_source_id bigint, source_catalog string, ra double, dec double, ref_epoch double, pmra double, pmdec double, name_aliases array<string>, parallax double"
REC = "id bigint, archive_code string, instrument string, obs_date date, gaia_source_id bigint, ra double, dec double, raw_target_name string, star string"
DAY = datetime.date(2016, 1, 1)
SEC = 1 / 3600


def stars(spark):
    rows = [
        (1, 900, 100.0, -30.0, 0.0, 0.0, ["GJ 169.1 A"]), (2, 901, 200.0, 0.0, 0.0, 0.0, None), (3, 902, 200.0, 0.4 * SEC, 0.0, 0.0, []),
        (4, 903, 150.0, 10.0, 8000.0, 0.0, ["V* Mira", None]), (5, None, 50.0, 89.9999, 0.0, 0.0, ["HD 1"]), (6, 905, 50.0, 60.0, None, None, ["HD 1"]),
    ]
    return spark.createDataFrame([(i, g, "gaia", ra, de, 2016.0, a, b, n, 1.0) for i, g, ra, de, a, b, n in rows], STAR)


def run(spark, *recs):
    rows = [(i, *r, "x") for i, r in enumerate(recs)]
    got = match_records(spark.createDataFrame(rows, REC), stars(spark), ["id"]).orderBy("id").collect()
    assert len(got) == len(recs)
    return [(r["match_method"].split("_")[0], r["match_status"], r["star_id"], None if r["theta_arcsec"] is None else round(r["theta_arcsec"], 2)) for r in got]


def test_cascade(spark):
    got = run(
        spark,
        ("unit", None, DAY, 900, None, None, None),  # id known
        ("unit", None, DAY, 999, 100.0, -30.0, "GJ 169.1 A"),  # id unknown: nothing else is tried
        ("unit", None, DAY, None, 100.0, -30 + 0.3 * SEC, None),  # one star near
        ("unit", None, DAY, None, 200.0, 0.2 * SEC, None),  # two stars near
        ("unit", None, DAY, None, 10.0, 10.0, None),  # none near
        ("unit", None, DAY, None, 100.0, -30 + 50 * SEC, "Gl169.1A"),  # name, not far
        ("unit", None, DAY, None, 200.0, 50.0, "MIRA"),  # name, far away, nothing near
        ("unit", None, DAY, None, 10.0, 10.0, "unrelated"),
        ("unit", None, None, None, None, None, "NAME Mira"),  # name is enough
        ("unit", None, DAY, None, 100.0, -99.0, None),  # no such place
        ("unit", None, DAY, None, float("nan"), 1.0, ""),
        ("unit", None, datetime.date(2020, 1, 1), None, 150 + 32 * SEC / 0.98480775, 10.0, None),  # moved 32 arcsec
        ("noirlab", "chiron", DAY, None, 100.0, -30 + 30 * SEC, None), ("noirlab", "goodman", DAY, None, 100.0, -30 + 30 * SEC, None), ("eso", "FEROS", DAY, None, 100.0, -30 + 80 * SEC, None),
        ("unit", None, DAY, None, 230.0, 89.9999, None),  # across the pole
        ("unit", None, None, None, None, None, "hd1"),  # an alias of two stars: the greater id
    )
    assert got == [
        ("direct", "matched", 1, None), ("direct", "skipped", None, None), ("positional", "matched", 1, 0.3), ("positional", "needs_review", None, 0.2), ("positional", "skipped", None, None),
        ("name", "matched", 1, None), ("positional", "needs_review", None, None), ("positional", "skipped", None, None), ("name", "matched", 4, None), ("positional", "skipped", None, None),
        ("positional", "skipped", None, None), ("positional", "matched", 4, got[11][3]), ("positional", "matched", 1, 30.0), ("positional", "skipped", None, None), ("positional", "matched", 1, 80.0),
        ("positional", "matched", 5, 0.72), ("name", "matched", 6, None),
    ]
    assert got[11][3] < 0.5


def test_no_records(spark):
    assert run(spark) == []


def test_plan_has_no_nested_loop(spark):
    t = spark.createDataFrame([(1, 1.0, 1.0, 2016.0, 5.0)], "id bigint, t_ra double, t_dec double, t_year double, t_radius double")
    plan = radial_pairs(t, stars(spark).drop("gaia_source_id", "source_catalog", "name_aliases"), 5.0, 2000.0, 2020.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


CAND = "id bigint, archive_code string, star_id bigint, gaia_source_id bigint, source_catalog string, separation_arcsec double, phot_g_mean_mag double"


def test_pick_best(spark):
    groups = {
        1: [("bsc5", 9, None), ("bsc5", 5, None), ("gaia", 1, 8)], 2: [("gaia", 2, 19)], 3: [("gaia", 9, 12)], 4: [("gaia", 9, 12), ("gaia", 2, 19)], 5: [("gaia", 9, 12), ("gaia", 8, 13)],
        6: [("gaia", 9, 12), ("gaia", 8, 15)], 7: [("gaia", 9, 12), ("gaia", 2, 15)], 8: [("gaia", 9, 12), ("gaia", 2, None)],
    }
    rows = [(k, "unit", 10 * k + i, None, c, float(s), None if m is None else float(m)) for k, v in groups.items() for i, (c, s, m) in enumerate(v)]
    got = {r["id"]: (r["winner"] and r["winner"]["star_id"], r["reason"]) for r in pick_best(spark.createDataFrame(rows, CAND), ["id"]).collect()}
    assert got == {
        1: (11, "bright catalogue"), 2: (None, "all too faint"), 3: (30, "only one"), 4: (None, "a fainter one is much closer"), 5: (None, "lead too small"),
        6: (60, "brightest"), 7: (None, "another is much closer"), 8: (None, "a fainter one is much closer"),
    }


def test_tracked_candidates_stay(spark):
    a = spark.createDataFrame([(1, "u", 5, 70, "gaia", 1.0, 9.0), (1, "u", 6, None, "bsc5", 1.0, None), (1, "u", 7, None, "bsc5", 2.0, None)], CAND)
    b = spark.createDataFrame([(1, "u", None, 70, "gaia_untracked", 1.0, 9.0), (1, "u", None, 71, "gaia_untracked", 2.0, 9.0)], CAND)
    assert sorted((r["star_id"] or 0, r["gaia_source_id"] or 0) for r in merge_candidates(a, b, ["id"]).collect()) == [(0, 71), (5, 70), (6, 0), (7, 0)]
