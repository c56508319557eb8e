"""Queries of the feeds, the streams and the fallback matcher."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import text
from skyloom.operators import match as M
from skyloom.plans.derived import HOLDINGS, h, s
from skyloom.plans.matching import NEAR, SPAN, TARGETS, targets
from skyloom.session import load, shared_dir
from skyloom.operators.merge import register_winners, write_merged
from skyloom.sources.catalog import PAGINGS
from skyloom.sources.feed import register
from skyloom.sources.tables import Snapshots, optional_current
from skyloom.streaming import sync

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


RECORD = "archive_code, archive_obs_id, archive_url, instrument, obs_date, program_id, raw_ra AS ra, raw_dec AS dec, raw_target_name, reduction_status"


def archive_codes(spark: SparkSession, d: str) -> list[str]:
    return [r[0] for r in load(spark, d, "archives").select("archive_code").orderBy("archive_code").collect()]


@query("c00_feed_batch", f"SELECT {RECORD} FROM {HOLDINGS}")
def c00(spark, d):
    """Every archive's log as one batch."""
    register(spark)
    read = lambda a: spark.read.format("archive_feed").options(path=f"{d}/spectroscopy_holdings.parquet", archive=a).load()
    return read("*").drop("gaia_source_id")


def pagings(codes: list[str], only: list[str] | None = None) -> dict[str, str]:
    """A paging class for each archive, all classes in turn."""
    use = only or PAGINGS
    return {a: use[i % len(use)] for i, a in enumerate(codes)}


def drained(spark: SparkSession, d: str, classes: dict[str, str], mark: str, pages: int, width: float) -> DataFrame:
    """All pages of the feeds of all archives, as a stream has written them; the largest archive has about `pages`."""
    rows = load(spark, d, "spectroscopy_holdings")
    size = rows.groupBy("archive_code").count().agg(F.max("count")).first()[0] // pages + 1
    out = folder(spark, "pages")

    def sink(page: DataFrame, n: int) -> None:
        page.write.mode("overwrite").parquet(f"{out}/page={n}")

    options = {f"paging.{a}": c for a, c in classes.items()}
    stream = sync.feed(spark, f"{d}/spectroscopy_holdings.parquet", ",".join(classes), mark=mark, page_size=str(size), width=str(width), **options)
    sync.drain(stream, sink, folder(spark, "cursor"))
    return spark.read.schema(stream.schema).parquet(out).drop("gaia_source_id", "page")


@query("st01_resumable_pages", f"SELECT {RECORD} FROM {HOLDINGS}")
def st01(spark, d):
    """Every archive drained by id, by all classes of paging."""
    top = load(spark, d, "spectroscopy_holdings").agg(F.max("id")).first()[0]
    return drained(spark, d, pagings(archive_codes(spark, d)), "id", 4, top / 4)


@query("st02_gap_windows", f"SELECT {RECORD} FROM {HOLDINGS} WHERE obs_date IS NOT NULL")
def st02(spark, d):
    """Windows of four years over dates with gaps of decades: the placeholder of 1858 lies a century before the rest."""
    return drained(spark, d, pagings(archive_codes(spark, d), ["window", "adaptive window"]), "obs_date", 4, 1461)


@query("st04_boundary_ties", f"SELECT {RECORD} FROM {HOLDINGS} WHERE obs_date IS NOT NULL")
def st04(spark, d):
    """Pages that end anywhere within a date, which many rows share."""
    return drained(spark, d, pagings(archive_codes(spark, d), ["watermark", "watermark with ids", "per instrument"]), "obs_date", 5, 7)


@query("st05_half_year_buckets",
       "SELECT year(obs_date)::INT AS yr, CASE WHEN month(obs_date) <= 6 THEN 1 ELSE 2 END AS half, count(*) AS n FROM spectroscopy_holdings WHERE obs_date IS NOT NULL GROUP BY ALL")
def st05(spark, d):
    name = f"halves_{uuid.uuid4().hex}"
    size = str(load(spark, d, "spectroscopy_holdings").count() // 4 + 1)
    stream = sync.period_counts(sync.feed(spark, f"{d}/spectroscopy_holdings.parquet", ",".join(archive_codes(spark, d)), paging="id", mark="id", page_size=size))
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", folder(spark, "cursor")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def appended(out: str):
    return lambda archive, page: page.write.mode("append").parquet(out)


@query("m16_sync_run", """SELECT archive_code, CASE WHEN archive_code IN ('weave', '4most') THEN 'failed'
    ELSE 'success' END AS last_run_status, coalesce(n, 0) AS rows_seen_last_run
  FROM (SELECT archive_code FROM archives UNION ALL VALUES ('weave'), ('4most')) LEFT JOIN (SELECT archive_code, count(*) AS n
    FROM spectroscopy_holdings GROUP BY 1) USING (archive_code)""")
def m16(spark, d):
    """All archives in one run, two of which always fail, and the table of what became of each."""
    codes, state = archive_codes(spark, d), sync.SyncState(spark, folder(spark, "state"))
    size = load(spark, d, "spectroscopy_holdings").count() // 4 + 1
    fetch = sync.fetch_from(spark, f"{d}/spectroscopy_holdings.parquet", dict.fromkeys(codes, "id"), size, "id")
    sync.run_archives(state, ["weave", *codes, "4most"], fetch, lambda archive, page: None)
    return optional_current(spark, state.root, state.name).select("archive_code", "last_run_status", "rows_seen_last_run")


@query("m17_reconcile_late", f"""SELECT DISTINCT {RECORD} FROM {HOLDINGS} WHERE archive_code IN ('nordlys', 'rillon', 'ombra') AND obs_date IS NOT NULL""")
def m17(spark, d):
    """Rows that arrive late lie behind the cursor. The first run sees the rows of before a day; the second, over the whole
    log, only those beyond the cursor; the re-walk under a cursor of its own, three pages a run, brings all others."""
    codes, path = ["nordlys", "rillon", "ombra"], f"{d}/spectroscopy_holdings.parquet"
    early, out = folder(spark, "log"), folder(spark, "late")
    rows = load(spark, d, "spectroscopy_holdings").filter(F.col("archive_code").isin(codes))
    rows.filter("first_seen_at < '2025-05-01'").coalesce(1).write.parquet(early)
    size = rows.filter("archive_code = 'nordlys'").count() // 5 + 1
    main, again = (sync.SyncState(spark, folder(spark, n)) for n in ("main", "again"))
    page_of = lambda at: sync.fetch_from(spark, at, dict.fromkeys(codes, "watermark"), size, "obs_date")
    for log in (early, path):
        sync.run_archives(main, codes, page_of(log), appended(out))
    for _ in range(3):
        sync.run_archives(again, codes, page_of(path), appended(out), page_cap=3, wrap=True)
    return spark.read.parquet(out).drop("gaia_source_id").distinct()


@query("m06_ids_unique", """SELECT archive_code, count(DISTINCT archive_obs_id) AS n_rows, count(DISTINCT archive_obs_id) AS n_ids, true AS unique_over_all
    FROM spectroscopy_holdings GROUP BY 1""")
def m06_ids(spark, d):
    """The archives come in two batches, then the first again with a failing write in between: no id is given twice, no row
    twice, and the rows from before stay."""
    rows = h(spark, d)
    order = [F.col(c) for c in ("updated_at", "id0")]
    # the ids are given anew; the old one only says which of several deliveries is the latest
    table = Snapshots(spark, folder(spark, "table"), sync.HOLDINGS.replace("id bigint, ", "id bigint, id0 bigint, ", 1))
    batch = rows.withColumnRenamed("id", "id0")
    first, second = batch.filter("archive_code < 'nordlys'"), batch.filter("archive_code >= 'nordlys'")
    write_merged(table, first, order)
    write_merged(table, second, order)
    try:
        write_merged(table, first.withColumn("obs_date", F.raise_error(F.lit("a page that can't be read")).cast("date")), order)
    except Exception:  # noqa: BLE001
        pass
    write_merged(table, first, order)
    held = table.read()
    whole = held.agg((F.count(F.lit(1)) == F.countDistinct("id")).alias("unique_over_all"))
    return held.groupBy("archive_code").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids")).crossJoin(F.broadcast(whole))


FALLBACK = f"""WITH {TARGETS.format(w='skipped')}, {NEAR}, cn AS (SELECT * FROM n
    WHERE sep <= 60), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY phot_g_mean_mag, sep) AS rk FROM cn WHERE phot_g_mean_mag <= 18),
  w AS (SELECT id, count(*) AS k, max(gaia_source_id) FILTER (WHERE rk = 1) AS ws, max(sep) FILTER (WHERE rk = 1) AS wsep, max(phot_g_mean_mag) FILTER (WHERE rk = 2) - max(phot_g_mean_mag) FILTER (WHERE rk = 1) AS lead, min(sep) AS fsep
    FROM f GROUP BY 1),
  b AS (SELECT id, min(star_id) AS bs FROM cn WHERE source_catalog = 'bsc5' GROUP BY 1), x AS (SELECT id, min(sep) AS nsep FROM cn GROUP BY 1)
  SELECT id, CASE WHEN bs IS NULL AND (k = 1 AND nsep*3 >= wsep OR k > 1 AND lead >= 2 AND fsep*3 >= wsep) THEN ws END AS gaia_source_id,
    CASE WHEN bs IS NOT NULL THEN 'bright catalogue' WHEN k IS NULL THEN 'all too faint' WHEN k = 1
      AND nsep*3 < wsep THEN 'a fainter one is much closer' WHEN k = 1 THEN 'only one' WHEN lead < 2 THEN 'lead too small'
      WHEN fsep*3 < wsep THEN 'another is much closer' ELSE 'brightest' END AS reason
  FROM x LEFT JOIN w USING (id) LEFT JOIN b USING (id)"""


@query("m08_fallback", FALLBACK)
def m08(spark, d):
    cols = [*M.MOTION, "gaia_source_id", "source_catalog", "phot_g_mean_mag"]
    tracked = s(spark, d).select(*cols)
    pool = s(spark, d).filter("gaia_source_id IS NOT NULL").select(F.col("gaia_source_id").alias("source_id"), "ra", "dec", "ref_epoch", "pmra", "pmdec", "phot_g_mean_mag")
    out = M.fallback_match(targets(spark, d, "match_status = 'skipped'", 60.0), tracked, pool, *SPAN)
    return out.select(F.col("t_id").alias("id"), "gaia_source_id", "reason")


@query("m08_register", f"SELECT id, gaia_source_id, true AS registered FROM ({FALLBACK}) WHERE gaia_source_id IS NOT NULL")
def m08b(spark, d):
    """A catalogue of bright stars alone: the sources that win are put into it, each once."""
    cols = [*M.MOTION, "gaia_source_id", "source_catalog", "phot_g_mean_mag"]
    tracked = s(spark, d).filter("source_catalog = 'bsc5'")
    pool = s(spark, d).filter("gaia_source_id IS NOT NULL").select(F.col("gaia_source_id").alias("source_id"), "ra", "dec", "ref_epoch", "pmra", "pmdec", "phot_g_mean_mag")
    out = M.fallback_match(targets(spark, d, "match_status = 'skipped'", 60.0), tracked.select(*cols), pool, *SPAN)
    grown, filled = register_winners(tracked, out, pool)
    known = grown.groupBy("star_id").agg(F.max("gaia_source_id").alias("held"), F.count(F.lit(1)).alias("k"))
    return filled.filter("gaia_source_id IS NOT NULL").join(known, "star_id", "left").select(F.col("t_id").alias("id"), "gaia_source_id", F.coalesce((F.col("held") == F.col("gaia_source_id")) & (F.col("k") == 1), F.lit(False)).alias("registered"))


@query("j17_pixel_join", f"WITH {TARGETS.format(w='needs_review')}, {NEAR} SELECT id, star_id, round(sep, 3) AS sep_arcsec FROM n WHERE sep <= 120")
def j17(spark, d):
    t = targets(spark, d, "match_status = 'needs_review'", 120.0)
    return M.pixel_pairs(t, s(spark, d).select(*M.MOTION), 120.0, *SPAN).select(F.col("t_id").alias("id"), "star_id", F.round("sep_arcsec", 3).alias("sep_arcsec"))


@query("x07_packed_position", """SELECT star_id, round(15*(floor(ra/15) + floor((ra*4)%60)/60 + floor((ra*240)%60)/3600), 6) AS ra, round(CASE
    WHEN dec < 0 THEN -1 ELSE 1 END*(floor(abs(dec)) + floor((abs(dec)*60)%60)/60 + floor((abs(dec)*3600)%60)/3600), 6) AS dec FROM stars""")
def x07(spark, d):
    ra, dec = F.col("ra"), F.abs("dec")
    packed = F.format_string("J%02d%02d%02d%s%02d%02d%02d", F.floor(ra / 15), F.floor(ra * 4 % 60), F.floor(ra * 240 % 60), F.when(F.col("dec") < 0, "-").otherwise("+"), F.floor(dec), F.floor(dec * 60 % 60), F.floor(dec * 3600 % 60))
    a, b = text.packed(packed)
    return s(spark, d).select("star_id", F.round(a, 6).alias("ra"), F.round(b, 6).alias("dec"))


@query("x11_argmin_product",
       "SELECT archive_code, archive_obs_id, arg_min(archive_url, rk || '|' || lpad(id::VARCHAR, 12, '0')) AS archive_url FROM (SELECT *, CASE reduction_status WHEN 'reduced' THEN 0 WHEN 'raw' THEN 1 ELSE 2 END AS rk FROM spectroscopy_holdings) GROUP BY 1, 2")
def x11(spark, d):
    rank = F.when(F.col("reduction_status") == "reduced", 0).when(F.col("reduction_status") == "raw", 1).otherwise(2)
    rows = load(spark, d, "spectroscopy_holdings")
    return rows.groupBy("archive_code", "archive_obs_id").agg(F.min_by("archive_url", F.struct(rank, "id")).alias("archive_url"))
