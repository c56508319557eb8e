"""Queries of the sources and sinks, of spectrum files and of what grows the catalogue, each written and read again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import derive as D
from skyloom.operators import merge as G
from skyloom.operators import serve as V
from skyloom.plans.derived import HOLDINGS, a, h, s
from skyloom.plans.matching import key_sql, records, sep, vec
from skyloom.session import load, shared_dir
from skyloom.sources import fits, tables, tap
from skyloom.sources.responses import record, respond
from skyloom.sources.spectra import LAYOUTS, read_spectra, write_spectrum

QUERIES, SQL = {}, {}
C = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


# sources and sinks
@query("s01_jdbc", "SELECT star_id, gaia_source_id, bsc_hr_number, ra, dec, input_name FROM stars")
def s01(spark, d):
    """The stars in a database and back, in parts by ranges of their key. Derby, which comes with Spark, stands in for a
    server: its database is one file in the shared folder, which every executor opens."""
    columns = ["star_id", "gaia_source_id", "bsc_hr_number", "ra", "dec", "input_name"]
    url = tables.derby_archive(s(spark, d).select(*columns), folder(spark, "database"), "stars")
    return tables.read_jdbc(spark, url, "stars", "star_id", 4).toDF(*columns)


@query("s02_views", "SELECT archive_code, display_name, count(*) AS n FROM spectroscopy_holdings JOIN archives USING (archive_code) GROUP BY ALL")
def s02(spark, d):
    tables.register_views(spark, d, ["archives", "spectroscopy_holdings"])
    return spark.sql("SELECT archive_code, display_name, count(*) AS n FROM spectroscopy_holdings JOIN archives USING (archive_code) GROUP BY ALL")


@query("s03_json_documents", "SELECT archive_code, match_status, count(*) AS n FROM spectroscopy_holdings GROUP BY ALL")
def s03(spark, d):
    """A document with nested lists, read as one row and unfolded."""
    at = folder(spark, "document")
    per = h(spark, d).groupBy("archive_code", "match_status").agg(F.count(F.lit(1)).alias("n"))
    nested = per.groupBy("archive_code").agg(F.collect_list(F.struct("match_status", "n")).alias("counts"))
    spark.createDataFrame([(tables.summary_json({"archives": nested}),)], "value string").coalesce(1).write.text(at)
    read = tables.read_documents(spark, at, "archives array<struct<archive_code:string,counts:array<struct<match_status:string,n:bigint>>>>")
    return read.select(F.explode("archives").alias("x")).select("x.archive_code", F.explode("x.counts").alias("y")).select("archive_code", "y.match_status", "y.n")


@query("s04_optional", "SELECT archive_code, display_name, 0::BIGINT AS n FROM archives")
def s04(spark, d):
    counts = tables.optional(spark, f"{d}/no_such_table.parquet", "archive_code string, n bigint")
    return a(spark, d).select("archive_code", "display_name").join(counts, "archive_code", "left").na.fill(0, ["n"])


VALID = """archive_code IS NOT NULL AND trim(coalesce(submitter, '')) <> '' AND length(submitter) <= 100
    AND outcome IN ('attach_gaia_source', 'attach_bright_star', 'not_a_real_target', 'not_a_star', 'confirmed_absent_from_gaia')
  AND trim(coalesce(archive_obs_id, '')) <> '' AND (outcome <> 'attach_gaia_source' OR proposed_gaia_source_id IS NOT NULL)
    AND (outcome <> 'attach_bright_star' OR proposed_bsc_hr_number IS NOT NULL)"""


@query("s05_vote_lines", "SELECT archive_code, archive_obs_id, outcome, submitter FROM skip_classifications")
def s05(spark, d):
    """Lines of JSON among lines that are none."""
    at = folder(spark, "lines")
    lines = load(spark, d, "skip_classifications").select(F.to_json(F.struct("archive_code", "archive_obs_id", "outcome", "submitter")).alias("value"))
    lines.unionByName(spark.createDataFrame([("{broken",), ("",), ("[]",), ("null",)], "value string")).write.text(at)
    return tables.read_votes(spark, at).select("archive_code", "archive_obs_id", "outcome", "submitter")


@query("s11_append_votes", f"SELECT id, CASE WHEN {VALID} THEN 'kept' ELSE 'refused' END AS state FROM skip_classifications")
def s11(spark, d):
    """Votes checked and appended in two lots; the refused ones are told by their absence."""
    at, votes = folder(spark, "votes"), load(spark, d, "skip_classifications")
    lines = votes.select("archive_code", "archive_obs_id", F.lit(None).cast("string").alias("raw_target_name"), "outcome", "submitter", "submitted_at", "proposed_gaia_source_id", "proposed_bsc_hr_number", C("id").cast("string").alias("note"))
    for part in ("submitted_at < '2025-05-17'", "submitted_at >= '2025-05-17' OR submitted_at IS NULL"):
        tables.append_votes(lines.filter(part), at, G.OUTCOMES)
    kept = tables.read_votes(spark, at).select(C("note").cast("bigint").alias("id"), F.lit("kept").alias("state"))
    return votes.select("id").join(kept, "id", "left").na.fill("refused", ["state"])


@query("s06_publish", "SELECT archive_code, display_name FROM archives")
def s06(spark, d):
    """Three versions of a table; readers get the last."""
    root = folder(spark, "published")
    for n in (3, 5, 100):
        tables.publish(a(spark, d).select("archive_code", "display_name").orderBy("archive_code").limit(n), root, "archives")
    return tables.current(spark, root, "archives")


@query("s07_sorted_parquet", f"SELECT id, raw_dec FROM {HOLDINGS} WHERE raw_dec BETWEEN -10 AND 10")
def s07(spark, d):
    """Holdings sorted by declination, of which a band is read by the row groups that hold it."""
    at = folder(spark, "sorted")
    tables.write_sorted(h(spark, d).select("id", "raw_dec"), at, "raw_dec", 16)
    return spark.read.parquet(at).filter("raw_dec BETWEEN -10 AND 10")


@query("t03_sorted_export", "SELECT star_id, row_number() OVER (ORDER BY gaia_source_id NULLS FIRST, star_id) AS place FROM stars")
def t03(spark, d):
    """The order in which the sorted table lies: file by file, row by row."""
    at = folder(spark, "ordered")
    s(spark, d).select("star_id", "gaia_source_id").repartitionByRange(8, C("gaia_source_id").asc_nulls_first(), "star_id").sortWithinPartitions(C("gaia_source_id").asc_nulls_first(), "star_id").write.parquet(at)
    lie = spark.read.parquet(at).select("star_id", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("i"))
    from pyspark.sql import Window

    return lie.select("star_id", F.row_number().over(Window.orderBy("file", "i")).cast("bigint").alias("place"))


@query("t08_top_n_remote", "SELECT star_id FROM stars WHERE ra > 10 AND phot_g_mean_mag < 12 ORDER BY star_id LIMIT 30")
def t08(spark, d):
    """The page that a service gives for TOP n, by the same words in SQL."""
    tables.register_views(spark, d, ["stars"])
    text = tap.adql(["star_id"], "stars", 30, ["ra > 10", "phot_g_mean_mag < 12"], "star_id")
    return spark.sql(text.replace("SELECT TOP 30", "SELECT") + " LIMIT 30")


@query("s08_summary_json", "SELECT match_status, count(*) AS n FROM spectroscopy_holdings GROUP BY 1")
def s08(spark, d):
    per = h(spark, d).groupBy("match_status").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(r["match_status"], r["n"]) for r in json.loads(tables.summary_json({"counts": per}))["counts"]], "match_status string, n bigint")


@query("s09_csv", "SELECT id, archive_obs_id, instrument, obs_date FROM spectroscopy_holdings")
def s09(spark, d):
    at = folder(spark, "csv")
    V.to_csv(h(spark, d), ["id", "archive_obs_id", "instrument", "obs_date"], at)
    return spark.read.option("header", True).option("escape", '"').schema("id bigint, archive_obs_id string, instrument string, obs_date date").csv(at)


@query("q11_holdings_csv",
       "SELECT h.id, display_name, instrument FROM spectroscopy_holdings h JOIN archives USING (archive_code) WHERE instrument = (SELECT instrument FROM spectroscopy_holdings WHERE instrument IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, instrument LIMIT 1)")
def q11(spark, d):
    """All rows of one instrument as a stream of CSV lines, and what a bad request is answered."""
    rows = h(spark, d)
    most = rows.filter("instrument IS NOT NULL").groupBy("instrument").count().orderBy(F.desc("count"), "instrument").first()[0]
    for bad, code in (("", 400), ("no such instrument", 404)):
        assert V.instrument_csv(rows, a(spark, d), bad)[0] == code
    _, lines = V.instrument_csv(rows, a(spark, d), most)
    return spark.read.option("header", True).option("escape", '"').schema("id bigint, display_name string, instrument string").csv(spark.sparkContext.parallelize(list(lines), 4))


@query("s12_tap_pages", "SELECT star_id, ra, dec, nullif(input_name, '') AS input_name FROM stars")
def s12(spark, d):
    """Pages of a service by a rising mark. The service is a function that answers ADQL from the stars in memory."""
    held = s(spark, d).select("star_id", "ra", "dec", "input_name").orderBy("star_id").toPandas()
    size = len(held) // 3 + 1

    def fetch(text: str) -> bytes:
        after = int(text.split("star_id > ")[1].split(" ")[0]) if ">" in text else -1
        return fits.write_votable(held[held.star_id > after].head(size).to_dict("list"))

    got = [page for page, _ in tap.pages(fetch, ["star_id", "ra", "dec", "input_name"], "stars", "star_id", size)]
    rows = [(int(i), float(x), float(y), n or None) for p in got for i, x, y, n in zip(p["star_id"], p["ra"], p["dec"], p["input_name"])]
    return spark.createDataFrame(rows, "star_id bigint, ra double, dec double, input_name string")


@query("s13_distilled",
       f"SELECT archive_obs_id || '.' || id AS specobjid, round(raw_ra, 9) AS ra, date_diff('day', DATE '1858-11-17', obs_date)::DOUBLE AS mjd FROM {HOLDINGS} WHERE obs_date BETWEEN '2010-01-01' AND '2012-12-31'")
def s13(spark, d):
    """A bulk FITS table distilled once into Parquet sorted by date, of which a window is read."""
    bulk, at = folder(spark, "bulk"), folder(spark, "distilled")
    days = F.datediff("obs_date", F.lit("1858-11-17").cast("date"))
    log = h(spark, d).select(F.concat("archive_obs_id", F.lit("."), C("id").cast("string")).alias("specobjid"), C("raw_ra").cast("string").alias("ra"), days.cast("string").alias("mjd"))
    record(log, bulk, "fits")
    rows = respond(spark, bulk, "fits", ["specobjid", "ra", "mjd"]).select("specobjid", F.round(C("ra").try_cast("double"), 9).alias("ra"), C("mjd").try_cast("double").alias("mjd"))
    tables.write_sorted(rows, at, "mjd", 8)
    return spark.read.parquet(at).filter("mjd BETWEEN 55197 AND 56292")


@query("s16_access_log", "SELECT event_type AS key, count(*) AS n FROM events WHERE event_type <> '' GROUP BY 1")
def s16(spark, d):
    """A log of tab-separated lines counted in three runs, each from where the one before ended."""
    log, root = folder(spark, "log"), folder(spark, "counts")
    events = load(spark, d, "events")
    line = F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "event_type", C("user_id").cast("string"))
    middle = events.agg(F.percentile_approx(F.unix_micros(C("ts").cast("timestamp")), 0.5)).first()[0]
    early = F.unix_micros(C("ts").cast("timestamp")) <= middle
    for part in (early, ~early):
        events.filter(part).select(line.alias("value")).unionByName(spark.createDataFrame([("no line",), ("",)], "value string")).write.mode("append").text(log)
        tables.count_accesses(spark, log, root, "accesses")
    return tables.count_accesses(spark, log, root, "accesses").select("key", "n")


@query("st08_log_stream", "SELECT event_type AS key, count(*) AS n FROM events WHERE event_type <> '' GROUP BY 1")
def st08(spark, d):
    """The same log as a stream, with complete counts."""
    log, name = folder(spark, "log"), f"accesses_{uuid.uuid4().hex}"
    load(spark, d, "events").repartition(3).select(F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "event_type").alias("value")).write.text(log)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(log)
    counts = stream.select(F.get(F.split("value", "\t"), F.lit(1)).alias("key")).filter("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", folder(spark, "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("st07_one_vote_each", "SELECT DISTINCT archive_code, archive_obs_id, submitter FROM skip_classifications")
def st07(spark, d):
    """Votes that come again in a second file of the stream are dropped. Its state is one key for each vote ever given: votes are
    few, and one that comes again years later must not count."""
    at, name = folder(spark, "votes"), f"votes_{uuid.uuid4().hex}"
    votes = load(spark, d, "skip_classifications").select("archive_code", "archive_obs_id", "submitter")
    for _ in range(2):
        votes.coalesce(1).write.mode("append").parquet(at)
    from skyloom.streaming.sync import one_vote_each

    stream = one_vote_each(spark.readStream.schema(votes.schema).option("maxFilesPerTrigger", 1).parquet(at))
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", folder(spark, "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


# joins that archives with normalised tables make
@query("j21_remote_joins", "SELECT id, instrument, program_id, obs_date FROM spectroscopy_holdings WHERE instrument IS NOT NULL AND program_id IS NOT NULL")
def j21(spark, d):
    """Observations, planes and proposals, joined by the text that the service would get."""
    rows = h(spark, d)
    parts = {"observation": ["obs_date"], "plane": ["instrument"], "proposal": ["program_id"]}
    names = {}
    for n, (part, cols) in enumerate(parts.items()):
        names[part] = f"{part}_{uuid.uuid4().hex}"
        kept = rows if not n else rows.filter(f"{cols[0]} IS NOT NULL")
        kept.select("id", *cols).createOrReplaceTempView(names[part])
    views = list(names.values())
    text = tap.inner_join([f"{views[0]}.id", "instrument", "program_id", "obs_date"], views, "id")
    return spark.sql(text)


# spectrum files
def files(spark: SparkSession, d: str, archive: str) -> DataFrame:
    """The embeddings as spectra, each in a file of the archive's layout."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [write_spectrum(archive, np.abs(np.array(x, float)) + 1) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["vec_id", "content"])

    return load(spark, d, "embeddings").select("vec_id", "embedding").mapInArrow(write, "vec_id bigint, content binary")


NAMES = {"sdss_plate": "sdss_legacy_optical"}  # a layout of an archive that has two


def parsed(layout: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        target = F.lit("77") if LAYOUTS[layout].row == "target" else C("vec_id").cast("string")
        url = F.lit("http://x/spPlate-0266.fits?fiber=2" if layout == "sdss_plate" else "u")
        rows = files(spark, d, layout).select(F.lit(NAMES.get(layout, layout)).alias("archive_code"), target.alias("archive_obs_id"), url.alias("archive_url"), F.lit("Spitzer/IRS").alias("instrument"), "content", "vec_id")
        read = read_spectra(rows, keep=["vec_id"])
        points = read.select("vec_id", F.explode("segments").alias("g")).select("vec_id", "g.label", F.posexplode(F.arrays_zip("g.wavelength", "g.flux")).alias("point", "p"))
        return points.select("vec_id", "label", "point", F.round("p.wavelength", 5).alias("wavelength"), F.round(C("p.flux") * (1e-6 if LAYOUTS[layout].jansky else 1), 7).alias("flux"))

    return run


def parsed_sql(layout: str) -> str:
    spec = LAYOUTS[layout]
    wave = "power(10, 3.7::DOUBLE + 0.0001::DOUBLE*i)" if spec.arms[0].wave.startswith("log10") else "(5000.0::DOUBLE + i)"
    flux = f"(f*1e-23*2.99792458e18/({wave}*{wave})*1e17)*1e-6" if spec.jansky else "f"
    labels = ", ".join(f"('{x.label}')" for x in spec.arms)
    return f"""SELECT vec_id, label, i::INT AS point, round({wave}, 5) AS wavelength, round({flux}, 7) AS flux
      FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x: abs(x::DOUBLE) + 1)) AS f, generate_subscripts(embedding, 1) - 1 AS i
        FROM embeddings), (VALUES {labels}) v(label)"""


for number, group in enumerate(
    [
        ["lamost"], ["gaia_rvs"], ["sdss_v_apogee"], ["desi"], ["sdss_v_optical", "sdss_legacy_optical"], ["sdss_plate"], ["mast_jwst"], ["eso"], ["lamost_mrs"], ["elodie", "rave"],
        ["irsa_missions"], ["feros_gavo", "flashheros_gavo", "ondrejov", "heros_ondrejov"], ["sophie"], ["hermes_mercator"], ["carmenes_tac", "carmenes_reiners2018"], ["cfht_cadc"],
    ], 1
):
    for layout in group:
        query(f"y{number:02d}_{layout}", parsed_sql(layout))(parsed(layout))


# what grows and mends the catalogue
POOL = "pool AS (SELECT gaia_source_id, name_aliases FROM stars WHERE source_catalog = 'gaia')"


@query("m10_discover", f"""WITH {POOL}, r AS (SELECT CASE
    WHEN match_method = 'direct_gaia_column' THEN gaia_source_id END AS gid, match_method, raw_target_name FROM spectroscopy_holdings LEFT
    JOIN (SELECT star_id, gaia_source_id FROM stars) USING (star_id)),
  al AS (SELECT {key_sql('n')} AS k, max(gaia_source_id) AS g FROM (SELECT gaia_source_id, unnest(name_aliases) AS n FROM pool) WHERE n IS NOT NULL GROUP BY 1),
  w AS (SELECT gid AS g, 'direct' AS how FROM r WHERE gid IS NOT NULL UNION SELECT g, 'named' FROM al WHERE k <> ''
    AND k IN (SELECT {key_sql('raw_target_name')} FROM r WHERE gid IS NULL AND match_method IS DISTINCT FROM 'direct_gaia_column'
    AND raw_target_name IS NOT NULL))
  SELECT g AS gaia_source_id, min(how) AS how FROM w WHERE g IN (SELECT gaia_source_id FROM pool) GROUP BY 1""")
def m10(spark, d):
    """A catalogue of bright stars alone meets all records: what they name of the rest is discovered."""
    pool = s(spark, d).filter("source_catalog = 'gaia'").select("gaia_source_id", "name_aliases")
    found, _ = G.discover_stars(records(spark, d), s(spark, d).filter("source_catalog = 'bsc5'"), pool)
    return found.select("gaia_source_id", "how")


@query("m11_upsert_stars", """WITH f AS (SELECT gaia_source_id, CASE WHEN length(input_name) % 2 = 0 THEN NULL
    ELSE upper(input_name) END AS input_name, ra + 0.5::DOUBLE AS ra FROM stars WHERE gaia_source_id IS NOT NULL
    UNION ALL SELECT 5000000000000000000 + bsc_hr_number, 'new', 1.5 FROM stars WHERE bsc_hr_number IS NOT NULL)
  SELECT s.gaia_source_id, coalesce(f.input_name, s.input_name) AS input_name, coalesce(f.ra, s.ra) AS ra FROM stars s LEFT JOIN f USING (gaia_source_id)
  UNION ALL SELECT gaia_source_id, input_name, ra FROM f WHERE gaia_source_id NOT IN (SELECT gaia_source_id FROM stars WHERE gaia_source_id IS NOT NULL)""")
def m11(spark, d):
    """Every star found again: what is null keeps the old value; and new ones."""
    stars = s(spark, d)
    name = F.when(F.length("input_name") % 2 == 0, None).otherwise(F.upper("input_name"))
    again = stars.filter("gaia_source_id IS NOT NULL").select("gaia_source_id", name.alias("input_name"), (C("ra") + 0.5).alias("ra"))
    new = stars.filter("bsc_hr_number IS NOT NULL").select((F.lit(5 * 10**18) + C("bsc_hr_number")).alias("gaia_source_id"), F.lit("new").alias("input_name"), F.lit(1.5).alias("ra"))
    return G.upsert_stars(stars, again.unionByName(new), "gaia_source_id").select("gaia_source_id", "input_name", "ra")


@query("m11_bright_stars", """SELECT bsc_hr_number, array_to_string(list_distinct_order, ';') AS aliases FROM (SELECT bsc_hr_number, list_append(
    coalesce(list_filter(name_aliases, lambda x, i: list_position(name_aliases, x) = i OR (x IS NULL
      AND NOT list_contains(list_transform(name_aliases[:i-1], lambda y: y IS NULL), true))), []), 'HR ' || bsc_hr_number) AS list_distinct_order
  FROM stars WHERE bsc_hr_number IS NOT NULL)""")
def m11b(spark, d):
    stars = s(spark, d)
    found = stars.filter("bsc_hr_number IS NOT NULL").select("bsc_hr_number", F.array(F.concat(F.lit("HR "), C("bsc_hr_number").cast("string"))).alias("name_aliases"))
    return G.upsert_stars(stars, found, "bsc_hr_number").filter("bsc_hr_number IS NOT NULL").select("bsc_hr_number", F.array_join("name_aliases", ";").alias("aliases"))


@query("m12_cone_fallback", f"""WITH c AS (SELECT star_id, CASE WHEN has_gaia_rvs THEN gaia_source_id END AS g, CASE WHEN has_xp_continuous THEN '*'
    ELSE 'G' END AS kind, ra, dec FROM stars),
  p AS (SELECT gaia_source_id, ra, dec FROM stars WHERE gaia_source_id IS NOT NULL),
  n AS (SELECT c.star_id, count(*) AS k, min(p.gaia_source_id) AS g FROM c JOIN p ON abs(c.dec - p.dec) < 0.01
    AND {sep(vec('c.ra', 'c.dec'), vec('p.ra', 'p.dec'))} <= 10 WHERE c.g IS NULL AND c.kind = '*' GROUP BY 1)
  SELECT c.star_id::VARCHAR AS name, CASE WHEN kind = '*' THEN coalesce(c.g, CASE WHEN k = 1 THEN n.g END) END AS gaia_source_id,
    CASE WHEN kind <> '*' THEN NULL WHEN c.g IS NOT NULL THEN 'identifier' WHEN k = 1 THEN 'place' END AS how FROM c LEFT JOIN n USING (star_id)""")
def m12b(spark, d):
    """Names by the identifiers of a resolver, where these lack the id by a cone that must hold just one source; what is no star
    isn't resolved."""
    stars = s(spark, d)
    known = stars.select(
        C("star_id").cast("string").alias("name"), F.when(C("has_gaia_rvs"), F.concat(F.lit("HD 1|Gaia DR3 "), C("gaia_source_id").cast("string"))).otherwise("HD 1").alias("identifiers"),
        F.when(C("has_xp_continuous"), "*").otherwise("G").alias("kind"), "ra", "dec",
    )
    pool = stars.filter("gaia_source_id IS NOT NULL").select(C("gaia_source_id").alias("source_id"), "ra", "dec")
    return G.resolve_names(known.select("name"), known, pool, 10.0)


@query("m22_backfill_status", """SELECT id, CASE WHEN reduction_status = 'unknown' THEN CASE WHEN archive_code = 'nordlys' THEN 'reduced'
    WHEN lower(archive_url) LIKE '%.fits' THEN 'raw' WHEN lower(archive_url) LIKE '%.gz' THEN 'reduced' ELSE 'unknown' END
    ELSE reduction_status END AS reduction_status FROM spectroscopy_holdings""")
def m22(spark, d):
    return G.backfill_status(h(spark, d), {"nordlys": "reduced"}, {".fits": "raw", ".gz": "reduced"}).select("id", "reduction_status")


@query("m23_backfill_photometry", """WITH v AS (SELECT gaia_source_id, min(phot_g_mean_mag + 0.5::FLOAT) AS bp FROM stars
    WHERE gaia_source_id IS NOT NULL GROUP BY 1)
  SELECT star_id, coalesce(phot_bp_mean_mag, v.bp) AS phot_bp_mean_mag FROM stars LEFT JOIN v USING (gaia_source_id)""")
def m23(spark, d):
    values = s(spark, d).filter("gaia_source_id IS NOT NULL").select("gaia_source_id", (C("phot_g_mean_mag") + F.lit(0.5).cast("float")).cast("float").alias("phot_bp_mean_mag"))
    return G.backfill(s(spark, d), values, "gaia_source_id", ["phot_bp_mean_mag"]).select("star_id", "phot_bp_mean_mag")


@query("m23_rewrite_urls",
       "SELECT id, CASE WHEN archive_code = 'nordlys' THEN regexp_replace(archive_url, '^https?://', 'https://mirror.') ELSE archive_url END AS archive_url FROM spectroscopy_holdings")
def m23b(spark, d):
    return G.rewrite_urls(h(spark, d), "^https?://", "https://mirror.", C("archive_code") == "nordlys").select("id", "archive_url")


@query("m24_seed_bright", "SELECT bsc_hr_number, round(ra, 4) AS ra, round(dec, 4) AS dec, input_name FROM stars WHERE bsc_hr_number IS NOT NULL")
def m24(spark, d):
    """A fixed-width bright-star list, read into an empty catalogue."""
    at = folder(spark, "bright")
    line = lambda c, n: F.rpad(F.coalesce(c.cast("string"), F.lit("")), n, " ")
    bright = s(spark, d).filter("bsc_hr_number IS NOT NULL")
    bright.select(F.concat(line(C("bsc_hr_number"), 8), line(C("ra"), 24), line(C("dec"), 24), line(C("input_name"), 80)).alias("value")).write.text(at)
    seeded = G.seed_bright_stars(spark, at, {"bsc_hr_number": (1, 8), "ra": (9, 32), "dec": (33, 56), "input_name": (57, 136)}, s(spark, d).limit(0))
    return seeded.select("bsc_hr_number", F.round("ra", 4).alias("ra"), F.round("dec", 4).alias("dec"), F.col("input_name"))


# serving
@query("q01_full", """WITH p AS (SELECT star_id FROM stars WHERE gaia_source_id = (SELECT min(gaia_source_id) FROM stars
    JOIN spectroscopy_holdings USING (star_id)))
  SELECT id, display_name, instrument, obs_date, row_number() OVER (ORDER BY display_name, instrument NULLS FIRST, obs_date NULLS FIRST, id)::INT AS place
  FROM spectroscopy_holdings SEMI JOIN p USING (star_id) JOIN archives USING (archive_code) WHERE reduction_status = 'reduced'""")
def q01(spark, d):
    """A star by its catalogue id, its reduced holdings in the order shown."""
    first = s(spark, d).join(h(spark, d).select("star_id").distinct(), "star_id").agg(F.min("gaia_source_id")).first()[0]
    return V.star_page(h(spark, d), a(spark, d), s(spark, d), str(first), reduction="reduced").select("id", "display_name", "instrument", "obs_date", "place")


@query("q02_cone_with_holdings", """WITH c AS (SELECT star_id FROM stars WHERE dec BETWEEN 10.4 AND 50.4
    AND degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sin(radians(dec))*sin(radians(30.4::DOUBLE)) + cos(radians(dec))*cos(radians(30.4::DOUBLE))*cos(radians(ra - 157.8::DOUBLE)))))) <= 20)
  SELECT star_id, display_name, instrument, count(*) AS n FROM spectroscopy_holdings SEMI JOIN c USING (star_id) JOIN archives USING (archive_code)
    WHERE reduction_status = 'reduced' GROUP BY ALL""")
def q02(spark, d):
    """All stars of a cone with what the archives have of them, for the filters of the page."""
    return V.cone_page(h(spark, d), a(spark, d), s(spark, d), 157.8, 30.4, 20.0, reduction="reduced")


@query("q04_batch_rows", """WITH e AS (SELECT unnest(['HD 400684', 'GJ 5136', 'no such star']) AS entry), f AS (SELECT entry, min(star_id) AS star_id
    FROM e LEFT JOIN (SELECT star_id, unnest(list_append(coalesce(name_aliases, []), input_name)) AS n FROM stars) ON lower(n) = lower(entry)
    GROUP BY 1),
  g AS (SELECT entry, f.star_id, CASE WHEN f.star_id IS NULL THEN 'not resolved' WHEN count(h.id) = 0 THEN 'not tracked' ELSE 'tracked' END AS status
    FROM f LEFT JOIN spectroscopy_holdings h ON h.star_id = f.star_id GROUP BY entry, f.star_id)
  SELECT entry, status, g.star_id, h.id, h.obs_date FROM g LEFT JOIN spectroscopy_holdings h ON h.star_id = g.star_id""")
def q04(spark, d):
    """A row for each holding of each name, and one for a name without any."""
    entries = V.batch_lines("HD 400684\nGJ 5136\n no such star ", h(spark, d)).select("entry")
    return V.batch_rows(entries, s(spark, d), h(spark, d)).select("entry", "status", "star_id", "id", "obs_date")


@query("q07_series_gaps", """WITH c AS (SELECT star_id, year(obs_date)::INT AS yr, CASE WHEN month(obs_date) <= 6 THEN 1
    ELSE 2 END AS half, count(*) AS n FROM spectroscopy_holdings WHERE star_id IS NOT NULL AND obs_date IS NOT NULL GROUP BY ALL),
  p AS (SELECT DISTINCT yr, half FROM c), t AS (SELECT star_id, yr, half, n FROM c QUALIFY row_number() OVER (PARTITION BY yr, half
    ORDER BY n DESC, star_id) <= 20), w AS (SELECT DISTINCT star_id FROM t)
  SELECT star_id, string_agg(coalesce(t.n::VARCHAR, '-'), ',' ORDER BY yr, half) AS series FROM w CROSS JOIN p LEFT JOIN t USING (star_id, yr, half)
    GROUP BY 1""")
def q07(spark, d):
    """The leaders' counts by half-year, a gap where a star is not among the leaders."""
    counts = D.leaderboard_counts(h(spark, d))
    return V.series(D.top_period(counts), D.periods_of(counts), "star_id", "n").select("star_id", F.array_join(F.transform("series", lambda x: x.cast("string")), ",", "-").alias("series"))


@query("q14_cone_summary", """WITH c AS (SELECT star_id, gaia_source_id, phot_g_mean_mag, 3600*degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sin(radians(dec))*sin(radians(30.4::DOUBLE)) + cos(radians(dec))*cos(radians(30.4::DOUBLE))*cos(radians(ra - 157.8::DOUBLE)))))) AS sep
    FROM stars WHERE dec BETWEEN 25.4 AND 35.4)
  SELECT count(*) AS n, min(phot_g_mean_mag) AS brightest, round(min(sep), 3) AS nearest FROM c WHERE sep <= 18000""")
def q14(spark, d):
    return V.cone_summary(s(spark, d), 157.8, 30.4, 5.0).select("n", "brightest", F.round("nearest", 3).alias("nearest"))
