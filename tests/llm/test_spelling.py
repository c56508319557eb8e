import random

import pytest

from skyloom.llm.spelling import EDITS, cost, deletions, edits, map_values, parse


@pytest.mark.parametrize(
    "typed, form",
    [
        ("HD 400684", ("code", "hd 400684")), (" hd_00400684 [night 8]", ("code", "hd 400684")), ("ＨＤ-４００６８４", ("code", "hd 400684")), ("hd  4o0684", ("code", "hd 400684")), ("HD 400684 B", ("code", "hd 400684 b")),
        ("Gliese_5148.1B_s7", ("code", "gj 5148.1 b")), ("gl 5136", ("code", "gj 5136")), ('"GDR3 7000482162400973721"', ("code", "gaia dr3 7000482162400973721")),
        ("gaia dr3 source 7000459665386841", ("code", "gaia dr3 7000459665386841")), ("TYC10001-3712-1 #5", ("code", "tyc 10001-3712-1")), ("v6054  kel", ("code", "v 6054 kel")), ("*127 Ned", ("code", "* 127 ned")),
        ("*υ Mox #9", ("code", "* ups mox")), ("kappa Gwy", ("code", "* kap gwy")), ("* alf Ost", ("code", "* alf ost")), ("NAME Sosunudo Malede", ("name", "sosunudo malede")), ("Tizota, Dokizipo (9x300s)", ("name", "dokizipo tizota")),
        ("lilénélo sifabé", ("name", "lilenelo sifabe")), ("Fоpоfоpе Lоmоnе", ("name", "fopofope lomone")), ("", None), (None, None), ("???", None), ("focus 12", ("mixed", "focus 12")), ("QSO J0727+83.1", ("mixed", "qso j 727 +83.1")), ("LHS-1140 b", ("mixed", "lhs 1140 b")), ("Сириус", ("other", "cиpиyc")), ("x", ("other", "x")),
    ],
)
def test_parse(typed, form):
    assert parse(typed) == form


def test_edits_and_deletions():
    assert edits("abcd", "abdc", 2) == 0.8 and edits("abcd", "abccd", 2) == 0.8 and edits("abcd", "axcd", 2) == 1 and edits("abcd", "wxyz", 2) == float("inf")
    assert cost("mogarora d", "mogarora dimugu") == 0.5 and cost("mogaroradimugu", "mogarora dimugu") == 0 and cost("sazofila hylvon", "sazofila mavini") > 2.5
    rng = random.Random(1)
    for _ in range(400):  # names within the edits always share a deletion
        a = b = "".join(rng.choice("abcde") for _ in range(rng.randint(4, 14)))
        for _ in range(EDITS):
            i = rng.randrange(len(b))
            b = rng.choice([b[:i] + b[i + 1 :], b[:i] + rng.choice("abcde") + b[i:], b[:i] + rng.choice("abcde") + b[i + 1 :], b[:i] + b[i : i + 2][::-1] + b[i + 2 :]]) or "a"
        assert deletions("name", a, True) & deletions("name", b, False)


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_map_values_against_brute_force(spark, broadcast_rows):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bdfgk") + rng.choice("aeiou") for _ in range(4))
    entries = [(f"NAME {word().title()} {word().title()}", i) for i in range(60)] + [("HD 7", 90), ("HD 7", 90), (None, 1), ("x", None), ("Same Name", 70), ("Same Name", 71)]
    typed = [e[5:] for e, i in entries[:30]] + [e[5:-1] + "x" for e, i in entries[:20]] + ["hd_007", "HD 8", None, "", " ", "Wholly Different", "same name", "z" * 50_000]
    df = spark.createDataFrame([(t, 1, 2) for t in typed + typed[:5]], "raw string, target int, entry int")
    ref = spark.createDataFrame([(e, t, "q") for e, t in entries], "alias string, star bigint, value string")
    got = {r["value"]: (r["status"], r["target"]) for r in map_values(df, "raw", ref, "alias", "star", broadcast_rows).collect()}
    assert set(got) == {t for t in typed if t is not None}
    for t in got:
        p = parse(t)
        costs = sorted((0.0 if p[0] == "code" else cost(p[1], q[1]), i) for e, i in entries if e and i is not None and (q := parse(e)) and p and (p[0] != "code" or p == q))
        costs = [c for c in costs if c[0] <= EDITS + 0.5]
        want = ("unmatched", None) if not costs else ("ambiguous", None) if any(i != costs[0][1] and c <= costs[0][0] + 0.15 for c, i in costs) else ("matched", costs[0][1])
        assert got[t] == want, t


def test_empty(spark):
    none = spark.createDataFrame([], "raw string")
    ref = spark.createDataFrame([], "alias string, star bigint")
    assert map_values(none, "raw", ref, "alias", "star").count() == 0
    assert [tuple(r)[:3] for r in map_values(spark.createDataFrame([("HD 1",)], "raw string"), "raw", ref, "alias", "star").collect()] == [("HD 1", "unmatched", None)]


def test_any_entry_is_found_as_it_stands_and_numbers_stay_exact(spark):
    entries = [("LHS 1140", 1), ("BD+05 1668", 2), ("BD-05 1668", 3), ("Сириус А", 4), ("HD 77 B", 5), ("tau ceti", 6), ("Wolf 359", 7), ("α", 8)]
    typed = {"lhs-1140": 1, "LHS 1141": None, "BD+05 1668": 2, "bd-05 1668": 3, "сириус а": 4, "HDD 77 B": 5, "HR 77 B": None, "HDD 77 C": None, "tau c": 6, "Wolff 359": 7, "Wolg 359": 7, "Golg 359": None, "α": 8, "β": None}
    df, ref = spark.createDataFrame([(t,) for t in typed], "raw string"), spark.createDataFrame(entries, "alias string, star bigint")
    for rows in (1_000_000, 0):
        assert {r["value"]: r["target"] for r in map_values(df, "raw", ref, "alias", "star", rows).collect()} == typed
