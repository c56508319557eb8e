"""Queries over all rows, also those that their SQL leaves out, against plain Python."""

import datetime as dt
import re

from skyloom.plans import registry

TEXTS = ["12", "1.5e3", "tessaly/1996/340", "1d", "2F", "0x1p3", "nan", "-7.25", "", None, "x 1"]
NAMES = ["HD  1", "NAME Été Bleu", "Gl 5", "* Ωmega  x", "HIP\t4", "Звезда 7", "", None, "V* AB", "name b", "gl\u00e9 1"]
DATES = [dt.date(1858, 11, 17), dt.date(1959, 12, 31), dt.date(1960, 1, 1), dt.date(2050, 3, 4), None, dt.date(1999, 7, 8), dt.date(2049, 1, 2), dt.date(1858, 1, 2), dt.date(1930, 5, 6), dt.date(2101, 1, 1), dt.date(1858, 2, 3)]


def number(t):
    return float(t) if t and re.fullmatch(r"[+-]?[0-9.]+(e[0-9]+)?", t) else None


def key(n, prefixes, gap):
    return None if n is None else re.sub(r"\s+", gap, re.sub(rf"^({prefixes})\s+", "", n.strip(" "), flags=re.I))


def date(i, d):
    if d is None:
        return None
    if i % 3 == 0:
        return d
    if i % 3 == 1:
        return d.replace(year=d.year % 100 + (2000 if d.year % 100 < 50 else 1900))
    return d if 1900 <= d.year < 2100 else None


def test_all_rows(spark, tmp_path):
    rows = list(zip(range(11), TEXTS, NAMES, DATES))
    spark.createDataFrame([(*r, None, None) for r in rows], "id bigint, archive_obs_id string, raw_target_name string, obs_date date, raw_ra double, raw_dec double").write.parquet(str(tmp_path / "spectroscopy_holdings.parquet"))
    got = lambda name: {r[0]: r[1] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("x01_clean_float") == {i: number(t) for i, t, _, _ in rows}
    match = {i: key(n, r"NAME|V\*|Cl\*|\*", "") for i, _, n, _ in rows}
    assert got("f01_match_key") == {i: k if k is None else re.sub("^GL", "GJ", k.upper()) for i, k in match.items()}
    search = {i: key(n, r"NAME|\*", " ") for i, _, n, _ in rows}
    assert got("f02_search_key") == {i: k if k is None else k.lower() for i, k in search.items()}
    assert got("x18_flexible_date") == {i: date(i, d) for i, _, _, d in rows}
