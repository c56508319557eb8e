import math
import random

import numpy as np

from skyloom.operators.rtree import RTree
from skyloom.operators.sky_join import PER_LEAF, QuadTree, sky_neighbours, unit

STARS = "star_id bigint, ra double, dec double, id string, kind string, leaf int"
ROWS = "id bigint, raw_ra double, raw_dec double, ra double, salt int"
FIELDS = "field_id bigint, field_name string, shape string, center_ra double, center_dec double, radius_deg double, ra_min double, ra_max double, dec_min double, dec_max double"


def close(a, b, radius):
    u, v = unit(np.array([a[0]]), np.array([a[1]]))[0], unit(np.array([b[0]]), np.array([b[1]]))[0]
    return np.linalg.norm(u - v) <= 2 * math.sin(math.radians(radius / 3600) / 2)


def usable(r):
    return None not in r[1:] and not any(map(math.isnan, r[1:])) and -90 <= r[2] <= 90 and abs(r[1]) < 1e9


def holds(f, ra, dec):
    if f[2] == "circle":
        return close((ra, dec), (f[3], f[4]), f[5] * 3600)
    return f[8] <= dec <= f[9] and (ra >= f[6] or ra <= f[7] if f[6] > f[7] else f[6] <= ra <= f[7])


def run(spark, stars, rows, fields, **kw):
    s = spark.createDataFrame([(*x, "a", "b", 1) for x in stars], STARS)
    r = spark.createDataFrame([(*x, 1.0, 2) for x in rows], ROWS)
    f = spark.createDataFrame(fields, FIELDS)
    got = [tuple(x) for x in sky_neighbours(s, r, f, **kw).collect()]
    assert len(got) == len(set(got))
    want = {("star_star", a[0], b[0]) for a in stars for b in stars if usable(a) and usable(b) and a[0] < b[0] and close(a[1:], b[1:], kw["radius_arcsec"])}
    good = [x for x in rows if usable(x) and x[0] is not None]
    want |= {("row_star", x[0], b[0]) for x in good for b in stars if usable(b) and close((x[1] % 360, x[2]), b[1:], kw["radius_arcsec"])}
    want |= {("row_field", x[0], f[0]) for x in good for f in fields if None not in (f[3:6] if f[2] == "circle" else f[6:]) and holds(f, x[1] % 360, x[2])}
    assert set(got) == want
    return want


def test_against_brute_force_with_poles_wrap_and_dirt(spark):
    rng = random.Random(3)
    place = lambda: rng.choice([(rng.uniform(0, 360), rng.choice([89.99, -89.99]) + rng.uniform(-0.009, 0.009)), (rng.uniform(-0.02, 0.02) % 360, rng.uniform(-0.02, 0.02)), (rng.uniform(0, 360), rng.uniform(-90, 90)), (200 + rng.uniform(0, 0.03), 10 + rng.uniform(0, 0.03))])
    stars = [(i, *place()) for i in range(150)] + [(150, 0.0, 90.0), (151, 180.0, -90.0), (152, None, 1.0), (153, 10.0, float("nan"))]
    rows = [(i, *place()) for i in range(300)] + [(900, -0.001, 0.0), (901, 359.9999, 0.0), (902, 360.0, 0.0), (903, 720.0, 0.0), (904, None, 2.0), (905, float("nan"), 2.0), (906, 1.0, 95.0), (None, 1.0, 1.0), (907, 5.0, 90.0)]
    fields = [
        (1, "a", "circle", 0.0, 89.0, 3.0, None, None, None, None), (2, "b", "circle", 359.5, 0.0, 2.0, None, None, None, None),
        (3, "c", "box", None, None, None, 350.0, 10.0, -5.0, 5.0), (4, "d", "box", None, None, None, 200.0, 200.02, 10.0, 10.02), (5, "e", "box", None, None, None, None, 1.0, 0.0, 1.0),
        (6, "f", "box", None, None, None, 5.0, 5.0, 80.0, 90.0),
    ]
    found = run(spark, stars, rows, fields, radius_arcsec=60.0, leaf_rows=20)
    assert len({k for k, *_ in found}) == 3
    assert run(spark, stars, rows, fields, radius_arcsec=60.0, leaf_rows=3000) == found


def test_one_place_with_most_rows_is_divided(spark):
    stars = [(1, 100.0, 20.0), (2, 100.001, 20.0)]
    rows = [(i, 100.0, 20.0) for i in range(400)]
    assert len(run(spark, stars, rows, [], radius_arcsec=10.0, leaf_rows=25)) == 801


def test_empty_tables(spark):
    assert run(spark, [], [], [], radius_arcsec=10.0) == set()
    run(spark, [(1, 2.0, 3.0)], [], [], radius_arcsec=10.0)


def test_rtree_finds_what_brute_force_finds():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 600):
        lo = rng.random((n, 2))
        hi = lo + rng.random((n, 2)) * 0.05
        q = rng.random((80, 2))
        got = {(a, b) for x, y in RTree(lo, hi, 4).probe(q - 0.03, q + 0.03) for a, b in zip(x, y)}
        want = {(i, j) for i in range(80) for j in range(n) if (lo[j] <= q[i] + 0.03).all() and (hi[j] >= q[i] - 0.03).all()}
        assert got == want


def test_crowded_stars_and_rows_are_both_divided(spark):
    rng = random.Random(5)
    spot = lambda i: (i, 100.0 + rng.uniform(-0.001, 0.001), 20.0 + rng.uniform(-0.001, 0.001))
    stars, rows = [spot(i) for i in range(60)], [spot(i) for i in range(200)]
    fields = [(8, "a", "circle", 100.0, 20.0, 0.0007, None, None, None, None)]
    run(spark, stars, rows, fields, radius_arcsec=2.0, leaf_rows=25)
    tree = QuadTree.fit(*(np.array([x[i] for x in stars + rows]) for i in (1, 2)), np.r_[np.ones(60, int), np.zeros(200, int)], 25, 2 / 3600)
    assert max(tree.rows) > 1 and max(tree.columns) > 1


def test_leaves_of_a_uniform_sky_stay_even_at_a_billion_rows():
    """The sample that 10^9 rows give: no leaf weighs over twice leaf_rows, and stars have few copies."""
    rng, total, leaf_rows = np.random.default_rng(2), 10**9, 20_000
    n = total * PER_LEAF // leaf_rows
    sky = lambda k: (rng.uniform(0, 360, k), np.degrees(np.arcsin(rng.uniform(-1, 1, k))))
    star = (np.arange(n) % 7 == 0).astype(np.int64)
    tree = QuadTree.fit(*sky(n), star, PER_LEAF, 10 / 3600)
    ra, dec = sky(4_000_000)
    leaf = tree.leaf(tree.codes(ra, dec))
    weight = np.bincount(leaf, minlength=len(tree.start)) * total / len(ra) * 8 / 7
    assert np.quantile(weight, 0.999) < 2 * leaf_rows and tree.rows.max() == 1
    stars = 100_000
    assert len(tree.circles(ra[:stars], dec[:stars], 10 / 3600)[0]) < 1.1 * stars
