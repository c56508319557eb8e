import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skyloom.operators.merge import write_merged
from skyloom.sources.catalog import ARCHIVES, PAGINGS
from skyloom.sources.feed import FIELDS, Log, next_page, register, to_batch
from skyloom.sources.tables import Cached, Snapshots, append_votes, count_accesses, current, optional, publish, read_votes, retry, summary_json, write_sorted
from skyloom.streaming.sync import SyncState, discovering_sink, drain, feed, fetch_from, one_vote_each, period_counts, run_archives, table, write_batch


def log(tmp_path, marks, instruments=("I",)):
    n = len(marks)
    rows = {f: [None] * n for f in FIELDS} | {
        "archive_code": ["eso"] * n, "archive_obs_id": [f"o{i:03d}" for i in range(n)], "archive_url": [f"u{i}" for i in range(n)], "instrument": [instruments[i % len(instruments)] for i in range(n)],
        "obs_date": [datetime.date(2020, 1 + i % 12, 1) for i in range(n)], "gaia_source_id": [i for i in range(n)], "mark": [float(m) for m in marks],
    }
    types = {"gaia_source_id": pa.int64(), "ra": pa.float64(), "dec": pa.float64(), "obs_date": pa.date32(), "mark": pa.float64()}
    path = str(tmp_path / "log.parquet")
    pq.write_table(pa.table({k: pa.array(v, types.get(k, pa.string())) for k, v in rows.items()}), path)
    return path


@pytest.mark.parametrize("paging", PAGINGS)
def test_every_paging_reads_each_row_once(tmp_path, paging):
    marks = [1, 1, 1, 1, 2, 2, 50, 51, 51, 51, 400, 400.5]
    source, cursor, seen = Log(log(tmp_path, marks, ("I", "J")), "eso"), {}, []
    for _ in range(40):
        page, cursor = next_page(source, paging, cursor, 3)
        if not len(page):
            break
        seen += page["archive_obs_id"].to_pylist()
    assert sorted(seen) == [f"o{i:03d}" for i in range(len(marks))] and len(next_page(source, paging, cursor, 3)[0]) == 0


def test_stream_drains_resumes_and_upserts(spark, tmp_path):
    path = log(tmp_path, range(7))
    stars = spark.createDataFrame([(i, i, 1.0, 1.0, 2016.0, 0.0, 0.0, ["x"]) for i in range(4)], "star_id bigint, gaia_source_id bigint, ra double, dec double, ref_epoch double, pmra double, pmdec double, name_aliases array<string>")
    out, sink = str(tmp_path / "holdings"), None
    sink = write_batch(spark, out, stars)
    assert drain(feed(spark, path, "eso", page_size="3"), sink, str(tmp_path / "c1")) == 3
    assert drain(feed(spark, path, "eso", page_size="3"), sink, str(tmp_path / "c1")) == 0
    assert drain(feed(spark, path, "eso", page_size="3"), sink, str(tmp_path / "c2")) == 3  # the whole history again
    rows = table(spark, out).read().collect()
    assert len(rows) == 7 == len({r["id"] for r in rows}) and sum(r["match_status"] == "matched" for r in rows) == 4


def test_streaming_aggregate_and_dedup(spark, tmp_path):
    path = log(tmp_path, range(12))
    q = period_counts(feed(spark, path, "eso", page_size="5")).writeStream.outputMode("complete").format("memory").queryName("halves").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["yr"], r["half"]): r["n"] for r in spark.table("halves").collect()} == {(2020, 1): 6, (2020, 2): 6}
    votes = spark.createDataFrame([("a", "o", "u"), ("a", "o", "u")], "archive_code string, archive_obs_id string, submitter string")
    assert one_vote_each(votes).count() == 1


def test_batch_reader_and_catalog(spark, tmp_path):
    register(spark)
    path = log(tmp_path, range(5))
    assert spark.read.format("archive_feed").options(path=path, archive="eso").load().count() == 5
    assert spark.read.format("archive_feed").options(path=path, archive="koa").load().count() == 0
    assert len(ARCHIVES) == 59 and sum(a.access == "stub" for a in ARCHIVES.values()) == 2


def test_tables(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "x")
    write_sorted(df, str(tmp_path / "s"), "x", 4)
    publish(df, str(tmp_path), "t")
    publish(df.limit(3), str(tmp_path), "t")
    assert current(spark, str(tmp_path), "t").count() == 3
    assert optional(spark, str(tmp_path / "none"), "a int").columns == ["a"]
    (tmp_path / "v.jsonl").write_text('{"archive_code": "a", "submitter": "u"}\nnot json\n\n')
    votes = read_votes(spark, str(tmp_path / "v.jsonl"))
    assert votes.count() == 1
    append_votes(votes, str(tmp_path / "log"))
    append_votes(votes, str(tmp_path / "log"))
    assert read_votes(spark, str(tmp_path / "log")).count() == 2
    assert summary_json({"a": df.limit(1)}) == '{"a": [{"x": 0}]}'
    calls, waits = [], []
    with pytest.raises(ValueError):
        retry(lambda: calls.append(1) or int("x"), sleep=waits.append)
    assert len(calls) == 5 and waits == [15, 30, 60, 120]


def test_log_skips_row_groups_and_counts_dates(tmp_path):
    path = str(tmp_path / "sorted.parquet")
    n = 1000
    t = pa.table({"archive_code": ["a"] * n, "archive_obs_id": [f"{i:04d}" for i in range(n)], "obs_date": pa.array([datetime.date(2000, 1, 1) + datetime.timedelta(i // 10) for i in range(n)]), "raw_ra": [float("nan")] * n})
    pq.write_table(t, path, row_group_size=50)
    source, cursor, seen, scanned = Log(path, "a", "obs_date"), {}, [], []
    scan = source.scan
    source.scan = lambda *x, **y: (scanned.append(1) or z for z in scan(*x, **y))
    while len((step := next_page(source, "watermark", cursor, 120))[0]):
        page, cursor = step
        assert to_batch(page).column("ra").null_count == len(page)
        seen += page["archive_obs_id"].to_pylist()
    assert seen == t["archive_obs_id"].to_pylist() and len(scanned) < 20 * 4 and isinstance(cursor["mark"], int)


def test_run_archives_isolates_failures_and_keeps_places(spark, tmp_path):
    state, written = SyncState(spark, str(tmp_path / "state")), []
    pages = {"a": [1, 2, 3], "b": [1, 2], "c": [1]}

    def fetch(archive, cursor):
        at = cursor.get("at", 0)
        if archive == "b" and at == 1:
            raise OSError("down")
        own = pages[archive]
        return (None, own[at], {"at": at + 1}) if at < len(own) else (None, 0, cursor)

    assert run_archives(state, ["a", "b", "c"], fetch, lambda a, p: written.append(a)) == ["b"]
    rows = state.rows()
    assert {k: (r["last_run_status"], r["rows_seen_last_run"], r["sync_cursor"]) for k, r in rows.items()} == {"a": ("success", 6, '{"at": 3}'), "b": ("failed", 1, '{"at": 1}'), "c": ("success", 1, '{"at": 1}')}
    assert run_archives(state, ["a"], fetch, lambda a, p: written.append("again")) == [] and "again" not in written
    again = SyncState(spark, str(tmp_path / "again"))
    places = []
    for _ in range(3):
        run_archives(again, ["a"], fetch, lambda a, p: None, page_cap=2, wrap=True)
        places.append((again.rows()["a"]["sync_cursor"], again.rows()["a"]["last_run_status"]))
    assert places == [('{"at": 2}', "partial"), ("{}", "success"), ('{"at": 2}', "partial")]


def test_ids_stay_unique_and_a_failure_loses_nothing(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), "id bigint, archive_code string, archive_obs_id string, first_seen_at timestamp, reduction_status string")
    page = lambda a, *ids: spark.createDataFrame([(a, i, None, None) for i in ids], "archive_code string, archive_obs_id string, first_seen_at timestamp, reduction_status string")
    write_merged(table, page("a", "1", "2", "3"), [F.col("archive_obs_id")])
    write_merged(table, page("b", "1", "2"), [F.col("archive_obs_id")])
    before = {tuple(r) for r in table.read().select("id", "archive_code", "archive_obs_id").collect()}
    assert len({r[0] for r in before}) == 5
    with pytest.raises(Exception):
        write_merged(table, page("a", "9").withColumn("reduction_status", F.raise_error(F.lit("x")).cast("string")), [F.col("archive_obs_id")])
    assert {tuple(r) for r in table.read().select("id", "archive_code", "archive_obs_id").collect()} == before
    write_merged(table, page("a", "3", "4"), [F.col("archive_obs_id")])
    after = {tuple(r) for r in table.read().select("id", "archive_code", "archive_obs_id").collect()}
    assert before < after and len({r[0] for r in after}) == 6


def test_access_log_counts_once(spark, tmp_path):
    log, root = tmp_path / "log.tsv", str(tmp_path / "counts")
    log.write_text("2024-01-01T00:00:00\ta\tx\n\nbad\n2024-01-01T00:00:01\tb\tx\n")
    key = lambda: {r["key"]: r["n"] for r in count_accesses(spark, str(log), root, "n").collect()}
    assert key() == {"a": 1, "b": 1} == key()
    log.write_text(log.read_text() + "2024-01-01T00:00:02\ta\tx\n")
    assert key() == {"a": 2, "b": 1}


def test_run_discovers_matches_and_records(spark, tmp_path):
    path = log(tmp_path, range(5))
    schema = "star_id bigint, source_catalog string, gaia_source_id bigint, ra double, dec double, ref_epoch double, pmra double, pmdec double, name_aliases array<string>"
    star = lambda g: (g + 100, "gaia", g, 1.0 + g, 1.0, 2016.0, 0.0, 0.0, [f"HD {g}"])
    pool = spark.createDataFrame([star(g) for g in (0, 1, 2, 9)], schema).drop("star_id", "source_catalog")
    publish(spark.createDataFrame([star(1)], schema), str(tmp_path / "cat"), "stars")
    sink = discovering_sink(spark, str(tmp_path / "held"), str(tmp_path / "cat"), pool)
    state, fetch = SyncState(spark, str(tmp_path / "state")), fetch_from(spark, path, {"eso": "watermark"}, 3)
    assert run_archives(state, ["eso"], fetch, sink) == []
    assert [(c["direct"], c["known"], c["new"]) for c in sink.counters] == [(3, 1, 2), (2, 0, 2)]
    stars = {r["gaia_source_id"]: r["star_id"] for r in current(spark, str(tmp_path / "cat"), "stars").collect()}
    assert set(stars) == {0, 1, 2} and stars[1] == 101 and len(set(stars.values())) == 3
    held = {r["archive_obs_id"]: (r["star_id"], r["match_status"]) for r in table(spark, str(tmp_path / "held")).read().collect()}
    assert held == {f"o{i:03d}": (stars.get(i), "matched" if i in stars else "skipped") for i in range(5)}


def test_cached_results_expire(spark):
    now, made = [0.0], []
    cache = Cached(60, most=2, clock=lambda: now[0])
    get = lambda key: cache.get(key, lambda: made.append(key) or spark.range(2))
    assert [r["id"] for r in get("a")] == [0, 1] and get("a") and made == ["a"]
    now[0] = 59.9
    get("a"), get("b")
    now[0] = 60.0
    get("a")
    assert made == ["a", "b", "a"]
    get("c"), get("b")
    assert made == ["a", "b", "a", "c", "b"] and len(cache.held) == 2
