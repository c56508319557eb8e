import datetime

import pytest
from pyspark.sql import functions as F

from skyloom.sources.catalog import ARCHIVES, RAW_OBSERVATION
from skyloom.sources.connectors import MAPS, raw_columns, record_log, to_records
from skyloom.sources.responses import record, respond, wire

ODD = ['a "b", c', "<x> & y", "Été Ωmega", " two  words ", "semi;colon", None, "100%_\\"]


def test_every_archive_has_a_map():
    assert set(MAPS) == {a for a, s in ARCHIVES.items() if s.access != "stub"}


@pytest.mark.parametrize("kind", ["votable", "json", "csv", "html", "listing", "fixed", "fits"])
def test_responses_come_back_as_they_were(spark, tmp_path, kind):
    """All pages of an answer, with odd characters and nulls; a column that the answer lacks is null, one not wanted is left out."""
    rows = [(f"k{i}", x, "z") for i, x in enumerate(ODD * 3)]
    log = spark.createDataFrame(rows, "key string, x string, other string")
    record(log, str(tmp_path / "r"), kind, page_rows=6)
    got = {r["key"]: (r["x"], r["gone"]) for r in respond(spark, str(tmp_path / "r"), kind, ["key", "x", "gone"]).collect()}
    tidy = lambda x: x and x.rstrip() if kind in ("fixed", "fits") else x
    assert {k: (tidy(a), b) for k, (a, b) in got.items()} == {k: (tidy(x), None) for k, x, _ in rows}


def test_empty_log(spark, tmp_path):
    for kind in ("votable", "json", "csv", "html"):
        record(spark.createDataFrame([], "key string, x string"), str(tmp_path / kind), kind)
        assert respond(spark, str(tmp_path / kind), kind, ["key", "x"]).count() == 0


@pytest.mark.parametrize("archive", sorted(MAPS))
def test_nulls_and_one_row(spark, archive):
    """A record with everything and one with nothing but an id, through the columns of the archive's log."""
    full = ("a", "o 1", "http://u", "I", datetime.date(2020, 1, 1), "P", 12, 10.5, -20.25, "HD 5", "reduced")
    bare = ("a", "o2", *[None] * 9)
    log = record_log(spark.createDataFrame([full, bare], RAW_OBSERVATION), archive)
    assert set(log.columns) == set(raw_columns(archive))
    if archive == "salt_hrs":
        log = log.withColumn("metadata", F.from_json("metadata", "array<struct<key:string,value:string>>"))
    got = to_records(log, archive, "https://x.example/{id}").collect()
    best = max(got, key=lambda r: sum(x is not None for x in r))
    assert best["archive_code"] == archive and best["archive_obs_id"] and (best["obs_date"] in (None, full[4])) and all(r["archive_url"] for r in got if "archive_url" not in MAPS[archive].fields)
    if "ra" in MAPS[archive].fields:
        assert abs(best["ra"] - 10.5) < 1e-4 and abs(best["dec"] + 20.25) < 1e-4


def test_values(spark):
    one = lambda archive, schema, *rows: [r.asDict() for r in to_records(spark.createDataFrame(rows, schema), archive, "https://x/{id}.html").collect()]
    core = "dp_id string, instrument_name string, t_min double, proposal_id string, s_ra string, s_dec double, target_name string, calib_level int"
    r = one("eso", core, ("A B", " UVES ", 58849.9, "p", "nan", 5.0, "", 2))[0]
    assert (r["archive_url"], r["instrument"], r["obs_date"], r["ra"], r["dec"], r["raw_target_name"], r["reduction_status"]) == ("https://x/A+B.html", "UVES", datetime.date(2020, 1, 1), None, 5.0, None, "reduced")
    r = one("lbt", "file_name string, instrument string, date_obs string, propid string, object string, ra string, dec string", (None, "PEPSI", "2020-02-03T01:00", "x", "Gaia DR3 77", "01:30:00", "-00:30:00"), ("f", "PEPSI", "2020-02-03", "x", "None", "00:00:00", "00:00:00"))
    assert [(x["archive_obs_id"], x["gaia_source_id"], x["ra"], x["dec"], x["raw_target_name"]) for x in r] == [("pepsi-2020-02-03T01:00", 77, 22.5, -0.5, "Gaia DR3 77"), ("f", None, None, None, None)]
    m = "obs_id string, access_url string, instrument_name string, t_min double, s_ra double, s_dec double, target_name string, calib_level int"
    r = one("mast", m, *[("o", u, "STIS", 1.0, 2.0, 3.0, "t", 1) for u in ("a.fits", "b_vo.fits", "c.fits")])
    assert [x["archive_url"] for x in r] == ["b_vo.fits"]
    assert len(one("desi", "targetid bigint, source_id bigint", (1, 999999), (2, 5), (3, None))) == 1
    assert one("asiago", "id int, instrument string, date_obs string, program string, ra_rad double, dec_rad double, object string", (1, "B", "bad", None, 3.141592653589793, None, "x"))[0]["ra"] == 180
