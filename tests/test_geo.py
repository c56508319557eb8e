import random

import numpy as np

from pyspark.sql import functions as F

from skyloom.functions import geo


def test_healpix_hierarchy_and_area(spark):
    rng = random.Random(5)
    rows = [(rng.uniform(0, 360), float(90 - 180 * 0)) for _ in range(3)] + [(rng.uniform(0, 360), __import__("math").degrees(__import__("math").asin(rng.uniform(-1, 1)))) for _ in range(6000)]
    df = spark.createDataFrame(rows, "ra double, dec double").select(*[geo.healpix(F.col("ra"), F.col("dec"), k).alias(f"p{k}") for k in (0, 1, 5, 7)])
    got = df.collect()
    assert all(0 <= r["p7"] < 12 * 4**7 and r["p7"] >> 4 == r["p5"] and r["p5"] >> 8 == r["p1"] and r["p1"] >> 2 == r["p0"] for r in got)
    counts = [sum(r["p0"] == i for r in got) for i in range(12)]
    assert min(counts) > 400 and max(counts) < 620  # equal areas


def test_rings_are_mutual():
    for level in (1, 3, 7):
        n = 12 * 4**level
        for p in {0, 1, n - 1, n // 2, *random.Random(2).sample(range(n), min(n, 60))}:
            around = list(geo.rings(np.array([p]), level)[1])
            assert 7 <= len(around) <= 9 and p in around
            assert all(p in geo.rings(np.array([q]), level)[1] for q in around)


def test_source_id_range(spark):
    r = spark.range(1).select(geo.source_id_range(F.lit(5).cast("bigint"), 7).alias("x"), geo.source_id_range(F.lit(6).cast("bigint"), 7).alias("y")).first()
    assert r["x"]["last"] + 1 == r["y"]["first"] and r["x"]["first"] == 5 << 45


def test_motion_and_nulls(spark):
    df = spark.createDataFrame([(10.0, 80.0, 1000.0, 0.0), (10.0, 80.0, None, None), (None, 1.0, 1.0, 1.0)], "ra double, dec double, pmra double, pmdec double")
    v = geo.moved_vector(F.col("ra"), F.col("dec"), F.col("pmra"), F.col("pmdec"), F.lit(10.0))
    a, b, c = [r[0] for r in df.select(geo.vector_separation(geo.unit_vector(F.col("ra"), F.col("dec")), v)).collect()]
    assert abs(a - 10) < 1e-6 and b < 1e-9 and c is None
    assert df.select(geo.cosine_separation_deg(F.col("ra"), F.col("dec"), F.lit(0.0), F.lit(0.0))).collect()[2][0] is None
