"""The pixel join against all pairs, and how far rings reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.operators.match import pixel_pairs, radial_pairs

T = "t_id bigint, t_ra double, t_dec double, t_year double"
POOL = "source_id bigint, ra double, dec double, ref_epoch double, pmra double, pmdec double"


def moved(pool, t):
    a, d = np.radians(pool[1]), np.radians(pool[2])
    years = (t[3] - pool[3]) * geo.MAS
    e, n = (pool[4] or 0) * years, (pool[5] or 0) * years
    v = np.array([np.cos(d) * np.cos(a) - np.sin(a) * e - np.sin(d) * np.cos(a) * n, np.cos(d) * np.sin(a) + np.cos(a) * e - np.sin(d) * np.sin(a) * n, np.sin(d) + np.cos(d) * n])
    return v / np.linalg.norm(v)


def unit(t):
    a, d = np.radians(t[1]), np.radians(t[2])
    return np.array([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)])


def test_pixel_pairs_are_all_pairs(spark):
    r = np.random.default_rng(3)
    pool, targets = [], []
    for i in range(150):
        ra, dec = r.uniform(0, 360), [r.uniform(-90, 90), 89.99, -89.999, 0.0, 41.81][i % 5]
        pool.append((i, ra, dec, 2016.0, *(float(x) for x in r.normal(0, [20, 400, 12_000, 1e6][i % 4 if i < 120 else 0], 2))))
        year = float(r.uniform(1850, 2050))
        x = moved(pool[-1], (0, 0, 0, year)) + r.normal(0, 60 / geo.ARCSEC, 3)
        x /= np.linalg.norm(x)
        targets.append((i, float(np.degrees(np.arctan2(x[1], x[0])) % 360), float(np.degrees(np.arcsin(x[2]))), year))
    pool.append((900, 10.0, 10.0, 2016.0, None, None))
    targets.append((901, 10.0, 10.0 + 50 / 3600, 1858.9))
    want = {(t[0], p[0]) for t in targets for p in pool if np.linalg.norm(unit(t) - moved(p, t)) * geo.ARCSEC <= 120}
    got = [tuple(x) for x in pixel_pairs(spark.createDataFrame(targets, T), spark.createDataFrame(pool, POOL), 120.0, 1850.0, 2050.0).select("t_id", "source_id").collect()]
    assert sorted(got) == sorted(want) and len(want) > 60


@pytest.mark.parametrize("level", [0, 1, 4, 9])
def test_rings_reach_their_width(spark, level):
    r = np.random.default_rng(level)
    rows = []
    for _ in range(3000):
        z, a = r.uniform(-1, 1), r.uniform(0, 2 * np.pi)
        if r.random() < 0.3:
            z = np.sign(z) * (1 - r.uniform(0, 1) ** 2 * 1e-3)
        u = np.array([np.sqrt(1 - z * z) * np.cos(a), np.sqrt(1 - z * z) * np.sin(a), z])
        w = r.normal(0, 1, 3)
        w -= w @ u * u
        by = geo.ring_width(level) / geo.ARCSEC
        v = np.cos(by) * u + np.sin(by) * w / np.linalg.norm(w)
        rows.append([float(x) for p in (u, v) for x in (np.degrees(np.arctan2(p[1], p[0])) % 360, np.degrees(np.arcsin(np.clip(p[2], -1, 1))))])
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = df.select(geo.healpix(F.col("a"), F.col("b"), level).alias("p"), geo.healpix(F.col("c"), F.col("d"), level).alias("q")).toPandas()
    of, near = geo.rings(got.p.to_numpy(), level)
    ringed = set(zip(of.tolist(), near.tolist()))
    assert all((i, q) in ringed for i, q in enumerate(got.q.tolist()))


def test_a_pair_needs_no_sine(spark):
    """What tests each candidate stays small enough for Java to compile it, and gives the angle of the moved vectors."""
    targets, pool = spark.createDataFrame([(1, 10.0, 10.0, 1900.0), (2, 10.0, 10.0, None)], T), spark.createDataFrame([(5, 10.0, 10.001, 2016.0, 300.0, -40.0), (6, 10.0, 10.001, None, None, None)], POOL)
    for pairs in (pixel_pairs(targets, pool, 120.0, 1850.0, 2050.0), radial_pairs(targets.withColumn("t_radius", F.lit(120.0)), pool, 120.0, 1850.0, 2050.0)):
        tests = [x for x in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
        assert tests and all("COS(" not in x and x.count("SQRT(") <= 3 for x in tests)
        star = geo.moved_vector(F.col("ra"), F.col("dec"), F.col("pmra"), F.col("pmdec"), F.col("t_year") - F.col("ref_epoch"))
        want = geo.vector_separation(geo.unit_vector(F.col("t_ra"), F.col("t_dec")), star)
        got = pairs.select("sep_arcsec", want.alias("want")).collect()
        assert len(got) == 4 and all(abs(r["sep_arcsec"] - r["want"]) < 1e-9 for r in got)
