import datetime
import random

import numpy as np

from skyloom.llm.linkage import fit_logistic, key_signatures, link_rows, place_signatures, train

H = "id bigint, star_id bigint, match_status string, raw_target_name string, raw_ra double, raw_dec double, obs_date date, cell int, key string"
S = "star_id bigint, gaia_source_id bigint, ra double, dec double, ref_epoch double, pmra double, pmdec double, name_aliases array<string>, form string"
SEC = 1 / 3600
DAY = datetime.date(2016, 1, 1)


def test_logistic_and_calibration():
    rng = np.random.default_rng(1)
    x = np.stack([np.ones(6000), rng.normal(size=6000)], axis=1)
    y = (rng.random(6000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 1])))).astype(float)
    assert np.abs(fit_logistic(x, y) - [0.5, 2]).max() < 0.2
    held = np.arange(6000) % 3 == 0
    p = 1 / (1 + np.exp(-(x @ train(x, y, held))))
    for lo in (0.0, 0.25, 0.5, 0.75):
        own = held & (p >= lo) & (p < lo + 0.25)
        assert abs(p[own].mean() - y[own].mean()) < 0.06


def shared(kind, form, a, b):
    x, y = (key_signatures([form] * len(k), k, kind) for k in (a, b))
    return (x == y).any(axis=1)


def test_blocking_recall_by_name():
    rng = random.Random(1)
    name = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(8))
    a = [name() for _ in range(300)]
    b = []
    for x in a:
        i = rng.randrange(len(x) - 1)
        b.append(rng.choice([x[:i] + x[i + 1 :], x[:i] + "q" + x[i:], x[:i] + x[i + 1] + x[i] + x[i + 2 :], x[:9]]))
    assert shared("name", "name", a, b).sum() >= 294
    assert shared("name", "name", [name() for _ in range(500)], [name() for _ in range(500)]).sum() < 10


def test_blocking_by_designation():
    assert shared("code", "code", ["hd 400684 b", "tyc 1-2-3", "gaia dr3 700"], ["hd 400684 b", "tyc 1-2-3", "gaia dr3 700"]).all()
    assert not shared("code", "code", [f"hd {i}" for i in range(1000)], [f"hd {i + 1}" for i in range(1000)]).any()


def test_blocking_recall_by_place():
    """Two places up to 7 arcsec apart, which is what place_limit and DRIFT allow, over the whole sky, its poles and ra 0."""
    rng = np.random.default_rng(3)
    n, cell = 20_000, 240 / 3600
    ra = np.r_[rng.uniform(0, 360, n), rng.uniform(-0.02, 0.02, n) % 360, rng.uniform(0, 360, n)]
    dec = np.r_[np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-80, 80, n), rng.choice([-1, 1], n) * (90 - rng.uniform(0.002, 0.2, n))]
    by, way = 7 / 3600 * np.sqrt(rng.random(3 * n)), rng.uniform(0, 2 * np.pi, 3 * n)
    dec1 = np.clip(dec + by * np.sin(way), -90, 90)
    ra1 = (ra + by * np.cos(way) / np.maximum(np.cos(np.radians(dec)), 1e-6)) % 360
    met = (place_signatures(ra, dec, cell) == place_signatures(ra1, dec1, cell)).any(axis=1)
    assert met[: 2 * n].mean() > 0.999 and met[2 * n :].mean() > 0.98


def test_links(spark):
    rng = random.Random(2)
    stars = [(i, 900 + i, rng.uniform(0, 360), rng.uniform(-60, 60), 2016.0, 0.0, 0.0, [f"HD {1000 + i}", f"NAME Star{chr(97 + i % 26) * 3} Word{chr(97 + i // 26) * 4}"], "x") for i in range(60)]
    stars += [(60, 960, 10.0, 20.0, 2016.0, 9000.0, 0.0, ["HD 7"], "x"), (61, None, 11.0, 20.0, 1991.25, None, None, ["HD 8"], "x"), (62, 962, 50.0, 0.0, 2016.0, 0.0, 0.0, None, "x"), (63, 963, 50.0, 1 * SEC, 2016.0, 0.0, 0.0, [None], "x"),
              (64, 964, 0.0001 * SEC, 5.0, 2016.0, 0.0, 0.0, [], "x"), (65, 965, 77.0, 89.99999, 2016.0, 0.0, 0.0, [], "x")]
    at = {s[0]: s for s in stars}
    old = [(1000 + k, s[0], "matched", s[7][0] if k % 2 else None, s[2], s[3] + 0.3 * SEC, DAY, 1, "k") for k, s in enumerate(stars[:60] * 4)]
    late = datetime.date(2020, 1, 1)
    new = [
        (1, None, "skipped", "hd_1003 exp2", at[3][2], at[3][3] + 30 * SEC, DAY), (2, None, "skipped", "HD 1003", at[3][2], at[3][3] + 1, DAY), (3, None, "skipped", "HD 1003", None, 5.0, None), (4, None, "x", "hd1003", 0.0, 0.0, DAY),
        (5, None, "x", None, at[5][2], at[5][3] + 1.5 * SEC, DAY), (6, None, "x", None, at[5][2], at[5][3] + 3 * SEC, DAY), (7, None, "x", None, 50.0, 0.5 * SEC, DAY), (8, None, None, "HD 8", None, None, DAY),
        (9, None, "x", None, float(10 + 36 * SEC / np.cos(np.radians(20))), 20.0, late), (10, None, "x", None, 10.0, 20.0, late), (11, None, "x", None, float(np.radians(at[7][2])), float(np.radians(at[7][3])), DAY),
        (12, None, "x", "", 359.99999, 5.0, DAY), (13, None, "x", None, 257.0, 89.99999, DAY), (14, None, "x", "Staraaa Wordaaaa", float("nan"), 95.0, DAY), (15, None, "x", "focus", 999.0, -99.0, DAY), (16, None, "x", None, at[5][2], at[5][3], None),
        (17, None, "x", None, at[5][2] - 360, at[5][3], DAY), (18, None, "rejected", "Starbbb Wordaaa", None, None, None),
    ]
    bare = link_rows(spark.createDataFrame([(*r, 1, "k") for r in new], H), spark.createDataFrame(stars, S)).collect()
    assert len(bare) == 11 and all(r["confidence"] is None for r in bare)  # no labels, no probability
    old += [(5000 + k, (k + 1) % 60, "matched", stars[k][7][0], stars[k][2], stars[k][3], DAY, 1, "k") for k in range(0, 60, 5)]  # wrong labels
    rows = old + [(*r, 1, "k") for r in new]
    got = {r["id"]: (r["gaia_source_id"], r["confidence"]) for r in link_rows(spark.createDataFrame(rows, H), spark.createDataFrame(stars, S)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 903, 3: 903, 4: 903, 5: 905, 9: 960, 11: 907, 12: 964, 13: 965, 14: 900, 17: 905, 18: 901}
    assert all(0.5 <= p <= 1 for _, p in got.values())


def test_empty(spark):
    h, s = spark.createDataFrame([], H), spark.createDataFrame([], S)
    assert link_rows(h, s).count() == 0
    assert link_rows(spark.createDataFrame([(1, None, None, "HD 1", 1.0, 1.0, DAY, 1, "k")], H), s).count() == 0
