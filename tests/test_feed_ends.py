"""The stream's planned pages against next_page, and its rows by partitions against the log."""

import datetime
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.datasource import DataSourceStreamReader

from skyloom.sources.catalog import PAGINGS
from skyloom.sources.feed import ArchiveFeed, Ends, FeedStream, Log, next_page
from skyloom.streaming.sync import feed, period_counts

BASE = datetime.date(2020, 1, 1)


def written(path, n=400, by_mark=False, seed=1):
    r = random.Random(seed)
    rows = [(r.choice("abc"), f"o{i:04d}", r.choice(["I", "J", None]), r.choice([None, -50_000, *range(40)])) for i in range(n)]
    rows.sort(key=(lambda x: (x[3] is not None, x[3] or 0)) if by_mark else (lambda x: x[1]))
    t = pa.table({
        "archive_code": [x[0] for x in rows], "archive_obs_id": [x[1] for x in rows], "instrument": pa.array([x[2] for x in rows], pa.string()),
        "obs_date": pa.array([None if x[3] is None else BASE + datetime.timedelta(x[3]) for x in rows], pa.date32()),
        "id": pa.array([int(x[1][1:]) for x in rows], pa.int64()), "at": pa.array([None if x[3] is None else x[3] + 0.25 for x in rows], pa.float64()),
        "raw_ra": [float("nan")] * n,
    })
    pq.write_table(t, path, row_group_size=64)
    return t


@pytest.mark.parametrize("mark", ["obs_date", "id", "at"])
@pytest.mark.parametrize("paging", PAGINGS)
@pytest.mark.parametrize("by_mark", [False, True])
def test_planned_ends_are_those_of_next_page(tmp_path, paging, mark, by_mark):
    path = str(tmp_path / "log.parquet")
    written(path, by_mark=by_mark)
    cursors = {a: {} for a in "abcd"}
    for _ in range(60):
        ends = Ends(Log(path, "", mark), {a: (paging, c, 25) for a, c in cursors.items()}, 7.0).cursors()
        want = {a: next_page(Log(path, a, mark), paging, c, 25, 7.0)[1] for a, c in cursors.items()}
        assert ends == want
        if ends == cursors:
            break
        cursors = ends
    assert ends == cursors


@pytest.mark.parametrize("mark", ["obs_date", "id"])
def test_stream_reads_each_row_once_by_row_groups(tmp_path, mark):
    path = str(tmp_path / "log.parquet")
    t = written(path)
    options = {"path": path, "archive": "a,b,c", "mark": mark, "page_size": "20", "paging.a": "per instrument", "paging.b": "adaptive window", "paging.c": "watermark"}
    stream, start, seen = FeedStream(options), {a: "{}" for a in "abc"}, []
    while (end := stream.latestOffset()) != start:
        parts = stream.partitions(start, end)
        assert len(parts) == 7  # one for each row group: no row comes from the driver
        seen += [x for p in parts for b in stream.read(p) for x in b.column("archive_obs_id").to_pylist()]
        again = FeedStream(options)  # a query that resumes from here plans the same page
        assert again.partitions(start, start) == [] and again.latestOffset() == end
        start = end
    want = [o for o, m in zip(t["archive_obs_id"].to_pylist(), t[mark].to_pylist()) if m is not None]
    assert sorted(seen) == sorted(want) and json.loads(start["c"])["mark"] is not None


def test_a_page_of_ties_is_cut_by_id(tmp_path):
    path = str(tmp_path / "log.parquet")
    n = 300
    pq.write_table(pa.table({"archive_code": ["a"] * n, "archive_obs_id": [f"{(i * 7) % n:04d}" for i in range(n)], "obs_date": [BASE] * n}), path, row_group_size=40)
    cursor, sizes = {}, []
    for _ in range(4):
        end = Ends(Log(path, "", "obs_date"), {"a": ("watermark", cursor, 100)}, 7.0).cursors()["a"]
        sizes.append(end["id"])
        cursor = end
    assert sizes == ["0099", "0199", "0299", "0299"]


def test_half_years_are_counted_from_tasks(spark, tmp_path):
    """A page as large as the log, counted by a stream: the driver plans it, and no row is read there."""
    path = str(tmp_path / "log.parquet")
    t = written(path)
    stream = ArchiveFeed({"path": path, "archive": "a,b,c", "mark": "id", "page_size": "1000", "paging": "id"}).streamReader(None)
    assert isinstance(stream, DataSourceStreamReader) and len(stream.partitions(stream.initialOffset(), stream.latestOffset())) == 7
    counts = period_counts(feed(spark, path, "a,b,c", paging="id", mark="id", page_size="150"))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("halves_by_tasks").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {}
    for day in t["obs_date"].to_pylist():
        if day is not None:
            want[day.year, 1 + (day.month > 6)] = want.get((day.year, 1 + (day.month > 6)), 0) + 1
    assert {(r["yr"], r["half"]): r["n"] for r in spark.table("halves_by_tasks").collect()} == want


def test_pages_of_ties_are_read_by_row_groups(tmp_path):
    """Pages that end within a date, for rows with and without an instrument: each comes once, in a task of its row group."""
    path, n = str(tmp_path / "log.parquet"), 240
    rows = {"archive_code": ["a"] * n, "archive_obs_id": [f"{(i * 7) % n:04d}" for i in range(n)], "obs_date": [BASE] * n, "instrument": pa.array([["I", None, "J"][i % 3] for i in range(n)], pa.string())}
    pq.write_table(pa.table(rows), path, row_group_size=40)
    for paging in ("watermark", "watermark with ids", "per instrument"):
        stream, start, seen = ArchiveFeed({"path": path, "archive": "a", "mark": "obs_date", "page_size": "30", "paging": paging}).streamReader(None), {"a": "{}"}, []
        while (end := stream.latestOffset()) != start:
            own = [[x for b in stream.read(p) for x in b.column("archive_obs_id").to_pylist()] for p in stream.partitions(start, end)]
            assert len(own) == 6 and max(map(len, own)) <= 40 and sum(map(len, own)) == (90 if paging == "per instrument" else 30) or seen
            seen += sum(own, [])
            start = end
        assert sorted(seen) == sorted(rows["archive_obs_id"])


def test_the_driver_holds_two_pages_of_marks(tmp_path, monkeypatch):
    path = str(tmp_path / "log.parquet")
    n = 200_000
    pq.write_table(pa.table({"archive_code": ["a"] * n, "archive_obs_id": [str(i) for i in range(n)], "id": list(range(n))[::-1]}), path, row_group_size=10_000)
    held, least = [], Ends._least
    monkeypatch.setattr(Ends, "_least", staticmethod(lambda values, k: held.append(sum(map(len, values))) or least(values, k)))
    stream = ArchiveFeed({"path": path, "archive": "a", "mark": "id", "page_size": "5000", "paging": "id"}).streamReader(None)
    assert json.loads(stream.latestOffset()["a"]) == {"mark": 4999, "id": "195000"}
    assert max(held) <= 2 * 5000 + 10_000


@pytest.mark.parametrize("kind", ["int64", "date32[day]", "timestamp[us]", "double"])
def test_the_driver_holds_no_page_of_marks(tmp_path, monkeypatch, kind):
    path, n, back = str(tmp_path / "log.parquet"), 50_000, 0 if kind == "timestamp[us]" else 20_000
    x = pa.array([(i * 7919) % n - back for i in range(n)], pa.int32())
    marks = x.cast(pa.date32()) if kind[:4] == "date" else x.cast(pa.int64()).cast({"int64": pa.int64(), "timestamp[us]": pa.timestamp("us"), "double": pa.float64()}[kind])
    pq.write_table(pa.table({"archive_code": ["a"] * n, "archive_obs_id": [f"{i:05d}" for i in range(n)], "at": marks}), path, row_group_size=5_000)
    held, least = [], Ends._least
    monkeypatch.setattr(Ends, "_least", staticmethod(lambda values, k: held.append(sum(map(len, values))) or least(values, k)))
    cursor = {}
    for end in (9_999, 29_999, 49_999, 49_999):
        cursor = Ends(Log(path, "", "at"), {"a": ("watermark", cursor, 20_000 if cursor else 10_000)}, 7.0).cursors()["a"]
        assert cursor["mark"] == end - back
    assert max(held) == 1
