"""Ingest as Structured Streaming: pages into the holdings table, drained, resumed, re-walked."""

from __future__ import annotations

import datetime
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.derive import dated
from skyloom.operators.match import match_records
from skyloom.operators.merge import KEY, add_stars, discover_stars, write_merged
from skyloom.sources.catalog import ARCHIVES, RAW_OBSERVATION
from skyloom.sources.feed import Log, next_page, register, to_batch
from skyloom.sources.tables import Snapshots, current, optional_current, publish

HOLDINGS = (
    "id bigint, star_id bigint, archive_code string, archive_obs_id string, archive_url string, instrument string, obs_date date, program_id string, "
    "match_method string, match_status string, theta_arcsec float, reduction_status string, raw_target_name string, raw_ra double, raw_dec double, "
    "first_seen_at timestamp, updated_at timestamp"
)


def feed(spark: SparkSession, path: str, archive: str, **options: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("archive_feed").options(path=path, archive=archive, **options).load()


def to_holdings(records: DataFrame, stars: DataFrame) -> DataFrame:
    """Matched records in the shape of holdings; of several records of one observation the last by url stays."""
    one = records.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in records.columns if c not in KEY]), "archive_url").alias("r")).select(*KEY, "r.*")
    matched = match_records(one, stars, KEY)
    return matched.select(
        "star_id", *KEY, "archive_url", "instrument", "obs_date", "program_id", "match_method", "match_status", F.col("theta_arcsec").cast("float").alias("theta_arcsec"),
        "reduction_status", "raw_target_name", F.col("ra").alias("raw_ra"), F.col("dec").alias("raw_dec"), F.current_timestamp().alias("first_seen_at"), F.current_timestamp().alias("updated_at"),
    )


def table(spark: SparkSession, path: str) -> Snapshots:
    return Snapshots(spark, path, HOLDINGS)


def write_batch(spark: SparkSession, path: str, stars: DataFrame):
    """A foreachBatch sink that upserts a page by its key, so that a page delivered twice changes nothing."""

    def sink(page: DataFrame, _: int) -> None:
        write_merged(table(spark, path), to_holdings(page, stars), [F.col("updated_at")])

    return sink


def drain(stream: DataFrame, sink, checkpoint: str, most_runs: int | None = None) -> int:
    """Runs the stream page by page until a run has nothing new; gives the number of pages. Its checkpoint holds
    the cursor: the same folder resumes, a new one walks the whole history again. Where most_runs is given and runs out before, it raises."""
    pages = 0
    while True:
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        done = sum(p["numInputRows"] for p in q.recentProgress)
        if not done:
            return pages
        pages += 1
        if pages == most_runs:
            raise RuntimeError(f"not drained after {pages} pages; the checkpoint resumes")


STATE = "archive_code string, sync_cursor string, last_run_at timestamp, last_run_status string, last_run_notes string, rows_seen_last_run bigint"


class SyncState:
    """Where every archive's run stands, as a published table: the cursor is stored after its page was written, so a run
    that fails or is killed resumes at the page it was at, and pages written twice change nothing."""

    def __init__(self, spark: SparkSession, root: str, name: str = "sync_state"):
        self.spark, self.root, self.name = spark, root, name

    def rows(self) -> dict[str, dict]:
        held = optional_current(self.spark, self.root, self.name)
        return {r["archive_code"]: r.asDict() for r in held.collect()} if held is not None else {}

    def store(self, rows: dict[str, dict]) -> None:
        publish(self.spark.createDataFrame([tuple(r[f.split(" ")[0]] for f in STATE.split(", ")) for r in rows.values()], STATE).coalesce(1), self.root, self.name)


def run_archives(state: SyncState, archives: list[str], fetch, sink, page_cap: int | None = None, wrap: bool = False, now=None) -> list[str]:
    """Runs the archives one after the other until each has nothing new or page_cap pages; gives those that failed.

    fetch(archive, cursor) gives a page's rows as a DataFrame, their number and the next cursor; sink(archive, page) writes
    it. A failure is noted with the archive's last good cursor and doesn't stop the others. A run under a cursor of its
    own that is to find what came late uses wrap: at the end it starts over, and at the cap it keeps its place."""
    failed, known = [], state.rows()
    for archive in archives:
        old = known.get(archive, {})
        cursor, seen, pages = json.loads(old.get("sync_cursor") or "{}"), 0, 0
        status, notes = "success", None
        try:
            while True:
                page, n, after = fetch(archive, cursor)
                if not n:
                    cursor = {} if wrap else cursor
                    break
                if page_cap is not None and pages == page_cap:
                    status = "partial"
                    break
                sink(archive, page)
                cursor, seen, pages = after, seen + n, pages + 1
        except Exception as e:  # noqa: BLE001
            failed.append(archive)
            status, notes = "failed", str(e).splitlines()[0][:500] if str(e) else type(e).__name__
        known[archive] = {
            "archive_code": archive, "sync_cursor": json.dumps(cursor, sort_keys=True), "last_run_at": now or datetime.datetime.now(datetime.timezone.utc),
            "last_run_status": status, "last_run_notes": notes, "rows_seen_last_run": seen,
        }
    state.store(known)
    return failed


def discovering_sink(spark: SparkSession, path: str, catalogue: str, pool: DataFrame):
    """sink() for run_archives: what a page names of pool and the catalogue (a published table of stars) lacks is put into it
    first, then the page is matched against the catalogue as it is now and upserted. Gives what each page discovered in
    `sink.counters`. A page delivered twice discovers nothing new."""

    def sink(archive: str, page: DataFrame) -> None:
        stars = current(spark, catalogue, "stars")
        found, counters = discover_stars(page, stars, pool)
        sink.counters.append({"archive_code": archive, **counters.first().asDict()})
        if sink.counters[-1]["new"]:
            publish(add_stars(stars, found.drop("how")), catalogue, "stars")
            stars = current(spark, catalogue, "stars")
        write_merged(table(spark, path), to_holdings(page, stars), [F.col("updated_at")])

    sink.counters = []
    return sink


def fetch_from(spark: SparkSession, path: str, paging: dict[str, str], size: int, mark: str = "mark", width: float = 7.0):
    """fetch() for run_archives over a recorded log."""

    def fetch(archive: str, cursor: dict) -> tuple[DataFrame | None, int, dict]:
        if ARCHIVES.get(archive, (None,))[0] == "stub":
            raise NotImplementedError(f"{archive} has released nothing")
        page, after = next_page(Log(path, archive, mark), paging.get(archive, "watermark"), cursor, size, width)
        return (spark.createDataFrame(pa.Table.from_batches([to_batch(page)]), RAW_OBSERVATION) if len(page) else None), len(page), after

    return fetch


def period_counts(stream: DataFrame) -> DataFrame:
    """Rows per half-year, for complete or update mode."""
    return dated(stream.filter("obs_date IS NOT NULL")).groupBy("yr", "half").agg(F.count(F.lit(1)).alias("n"))


def one_vote_each(stream: DataFrame) -> DataFrame:
    """The first vote of each submitter on an observation, whatever is delivered again."""
    return stream.dropDuplicates([*KEY, "submitter"])


__all__ = ["RAW_OBSERVATION", "drain", "feed", "one_vote_each", "period_counts", "to_holdings", "write_batch"]
