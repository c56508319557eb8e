"""Archive logs as a Spark data source: a batch reader and a resumable stream of pages.

An archive's log is a recorded table in Parquet, a file or a folder, with the columns of RAW_OBSERVATION and its ordering
columns; a live client would take the recorded table's place. What orders and resumes depends on the archive's
paging class, by the names in PAGINGS:

watermark, watermark with ids, window, adaptive window, once: compound mark (time, id) in one comparison, so rows
that tie on the time at a page's edge are neither lost nor read twice; the windows are half-open, jump over gaps to
the next mark, and an adaptive one halves when it overflows and widens after one that doesn't.
id, row, page, list: the id, row, page or list position alone.
per instrument: one mark per instrument.

A page is read in two steps: the marks and ids after the cursor say where it ends, then the rows between. Both steps
push the range of marks into Parquet and skip row groups by their statistics, and where the log is
sorted by the mark the first step ends with the row group in which the page ends. In a stream only the first step is
the driver's, for all archives in one pass, and it holds marks alone; executors read the rows, a task for each
row group. Rows with a null mark are in no page. The offset is a JSON object with a cursor per archive, which is what the stream's checkpoint keeps. A page ends
at the last row read, and an empty page means that an archive has nothing new.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from skyloom.sources.catalog import ARCHIVES, RAW_OBSERVATION

FIELDS = [x.split(" ")[0] for x in RAW_OBSERVATION.split(", ")]
TYPES = {"string": pa.string(), "date": pa.date32(), "bigint": pa.int64(), "double": pa.float64()}
SCHEMA = pa.schema([(n, TYPES[t]) for n, t in (x.split(" ") for x in RAW_OBSERVATION.split(", "))])
NARROWEST, WIDEST = 1, 365
WINDOWS = ("window", "adaptive window")
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def to_batch(table: pa.Table) -> pa.RecordBatch:
    """Rows of a log in the shape of RAW_OBSERVATION: what is missing is null, and so is NaN."""
    columns = []
    for f in SCHEMA:
        at = f.name if f.name in table.column_names else f"raw_{f.name}"
        x = table[at].cast(f.type) if at in table.column_names else pa.chunked_array([pa.nulls(len(table), f.type)])
        columns.append(pc.if_else(pc.is_nan(x), pa.scalar(None, f.type), x) if f.type == pa.float64() else x)
    return pa.Table.from_arrays(columns, schema=SCHEMA).combine_chunks().to_batches(max_chunksize=max(len(table), 1))[0] if len(table) else pa.RecordBatch.from_pylist([], SCHEMA)


def typed(mark, kind: pa.DataType) -> pa.Scalar:
    """A mark from JSON in the type of its column."""
    if pa.types.is_date(kind):
        return pa.scalar(int(mark), pa.int32()).cast(pa.date32()).cast(kind)
    if pa.types.is_timestamp(kind):
        return pa.scalar(int(mark), pa.timestamp("us", kind.tz)).cast(kind)
    return pa.scalar(mark, kind)


def _counts(kind: pa.DataType) -> bool:
    return pa.types.is_signed_integer(kind) or pa.types.is_date32(kind) or pa.types.is_timestamp(kind) or pa.types.is_float32(kind) or pa.types.is_float64(kind)


def _keys(marks: pa.Array) -> np.ndarray:
    """Marks without nulls as unsigned numbers of the same order."""
    if pa.types.is_floating(marks.type):
        x = (marks.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
        x = np.where(x < 0, x ^ np.int64(2**63 - 1), x)
    else:
        x = (marks.cast(pa.int32()) if pa.types.is_date32(marks.type) else marks).cast(pa.int64()).to_numpy(zero_copy_only=False)
    return x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _mark(key: int, kind: pa.DataType) -> pa.Scalar:
    """The mark that _keys made a key of."""
    x = int((np.uint64(key) ^ np.uint64(1 << 63)).view(np.int64))
    if pa.types.is_floating(kind):
        return pa.scalar(float(np.int64(x if x >= 0 else x ^ (2**63 - 1)).view(np.float64)), kind)
    return pa.scalar(x, pa.int32() if pa.types.is_date32(kind) else pa.int64()).cast(kind)


class Log:
    """A recorded log with a mark that orders it: a number, text, date or time in a column of the log."""

    def __init__(self, path: str, archive: str, mark: str = "mark"):
        data = ds.dataset(path, format="parquet")
        self.mark, self.names = mark, data.schema.names
        self.type = data.schema.field(mark).type
        self.mine = ds.field("archive_code") == archive if "archive_code" in self.names else ds.scalar(True)
        groups = [g for f in data.get_fragments() for g in f.split_by_row_group()]
        self.groups = sorted(((*self._range(g), i, g) for i, g in enumerate(groups)), key=lambda x: (x[0] is not None, x[0] or 0, x[2]))

    def _range(self, group) -> tuple:
        seen = (group.row_groups[0].statistics or {}).get(self.mark, {})
        low, high = (self.plain(pa.scalar(seen[x]).cast(self.type)) if seen.get(x) is not None else None for x in ("min", "max"))
        return low, high

    def plain(self, x: pa.Scalar):
        """A mark as JSON has it: dates are days and times microseconds since 1970."""
        if not x.is_valid:
            return None
        if pa.types.is_date(self.type):
            return (x.as_py() - EPOCH.date()).days
        if pa.types.is_timestamp(self.type):
            v = x.as_py()
            return int((v if v.tzinfo else v.replace(tzinfo=EPOCH.tzinfo)).timestamp() * 1_000_000 + 0.5)
        return x.as_py()

    def typed(self, mark) -> pa.Scalar:
        return typed(mark, self.type)

    def scan(self, keep: ds.Expression, low=None, high=None, columns: list[str] | None = None) -> Iterator[tuple[object, pa.Table]]:
        """(lowest mark of the later row groups, rows kept) by row group, of those that may hold marks from low to high."""
        low = low if low is None else self.plain(self.typed(low))  # a date is its day's first moment
        todo = [g for g in self.groups if (low is None or g[1] is None or g[1] >= low) and (high is None or g[0] is None or g[0] <= high)]
        for i, (*_, group) in enumerate(todo):
            yield (todo[i + 1][0] if i + 1 < len(todo) else float("inf")), group.to_table(filter=self.mine & keep, columns=columns)

    def read(self, keep: ds.Expression, low=None, high=None) -> pa.Table:
        columns = [c for c in self.names if c in FIELDS or c.removeprefix("raw_") in FIELDS or c == self.mark]
        tables = [t for _, t in self.scan(keep, low, high, columns)]
        return pa.concat_tables(tables).sort_by([(self.mark, "ascending"), ("archive_obs_id", "ascending")]) if tables else self.empty()

    def empty(self) -> pa.Table:
        return pa.table({n: pa.array([], TYPES.get(str(self.type), self.type) if n == self.mark else pa.string()) for n in (self.mark, "archive_obs_id")})

    def beyond(self, mark, obs_id) -> ds.Expression:
        at = ds.field(self.mark)
        if mark is None:
            return at.is_valid()
        return (at > self.typed(mark)) | ((at == self.typed(mark)) & (ds.field("archive_obs_id") > (obs_id or "")))

    def after(self, mark, obs_id, size: int, *instrument: str | None) -> tuple[pa.Table, list | None]:
        """The `size` rows that follow (mark, id), with all that tie with the last, and the last's mark and id."""
        keep = self.beyond(mark, obs_id)
        for name in instrument:
            keep = keep & (ds.field("instrument").is_null() if name is None else ds.field("instrument") == name)
        order = [(self.mark, "ascending"), ("archive_obs_id", "ascending")]
        least = None
        for later, t in self.scan(keep, mark, columns=[self.mark, "archive_obs_id"]):
            least = t if least is None else pa.concat_tables([least, t])
            if len(least) > size:
                least = least.take(pc.select_k_unstable(least, size, order))
            if len(least) == size and later is not None and later != float("inf") and self.plain(pc.max(least[self.mark])) < later:
                break
        if least is None or not len(least):
            return self.empty(), None
        last = least.sort_by(order).slice(len(least) - 1)
        end = [self.plain(last[self.mark][0]), last["archive_obs_id"][0].as_py()]
        return self.read(keep & ~self.beyond(*end), mark, end[0]), end

    def window(self, low, high) -> pa.Table:
        at = ds.field(self.mark)
        return self.read((at >= self.typed(low)) & (at < self.typed(high)), low, high)

    def span(self, low=None) -> tuple | None:
        """The first and the last mark, from low on; None without any."""
        at = ds.field(self.mark)
        keep, out = (at >= self.typed(low)) if low is not None else at.is_valid(), None
        for _, t in self.scan(keep, low, columns=[self.mark]):
            if len(t):
                both = [self.plain(f(t[self.mark])) for f in (pc.min, pc.max)]
                out = both if out is None else [min(out[0], both[0]), max(out[1], both[1])]
        return out

    def instruments(self) -> list[str | None]:
        """None stands for the rows without an instrument."""
        found = {x for _, t in self.scan(ds.scalar(True), columns=["instrument"]) for x in pc.unique(t["instrument"]).to_pylist()}
        return sorted(found, key=lambda x: (x is not None, x or ""))


def next_page(log: Log, paging: str, cursor: dict, size: int, width: float = 7.0) -> tuple[pa.Table, dict]:
    """The page after a cursor and the cursor after the page."""
    if paging == "once":
        return (log.empty(), cursor) if cursor.get("done") else (log.read(ds.field(log.mark).is_valid()), {"done": True})
    if paging == "per instrument":
        marks, pages = dict(cursor.get("marks", {})), []
        for name in log.instruments():
            key = json.dumps(name)
            page, end = log.after(*marks.get(key, [None, None]), size, name)
            if end:
                marks[key] = end
                pages.append(page)
        return (pa.concat_tables(pages), {"marks": marks}) if pages else (log.empty(), cursor)
    if paging in WINDOWS:
        widest = width
        span = log.span(cursor.get("start"))
        if span is None:
            return log.empty(), cursor
        start, width = max(span[0], cursor.get("start", span[0])), cursor.get("width", width)
        while True:
            page = log.window(start, start + width)
            if paging == "window":
                return page, {"start": start + width, "width": width}
            if len(page) < size or width <= NARROWEST:
                return page, {"start": start + width, "width": min(width * 2, max(WIDEST, widest))}
            width = max(width / 2, NARROWEST)
    page, end = log.after(cursor.get("mark"), cursor.get("id"), size)
    return (page, {"mark": end[0], "id": end[1]}) if end else (page, cursor)


class Ends:
    """Where the next pages of several archives end: the cursors that next_page gives, by passes over the marks that serve
    all archives. asked: paging class, cursor and page size of each. Marks that are numbers, dates or times are counted in BINS bins
    for each archive, or instrument, in passes over ever narrower ranges, so that no page is held; of texts at most two pages
    are. Of the ids at most a page's that share its last mark are held."""

    BINS = 16_384

    def __init__(self, log: Log, asked: dict[str, tuple[str, dict, int]], width: float):
        self.log, self.asked, self.width = log, asked, width

    def cursors(self) -> dict[str, dict]:
        out = {a: {"done": True} if paging == "once" else cursor for a, (paging, cursor, _) in self.asked.items()}
        self.asked = {a: x for a, x in self.asked.items() if x[0] != "once"}
        if not self.asked:
            return out
        lows, edges = self._counted_marks() if _counts(self.log.type) else self._marks()
        for a, low in self._starts(lows).items():
            out[a] = low
        marks = {}
        for (a, name), end in self._ids(edges).items():
            if self.asked[a][0] == "per instrument":
                marks.setdefault(a, dict(self.asked[a][1].get("marks", {})))[name] = end
            else:
                out[a] = {"mark": end[0], "id": end[1]}
        return out | {a: {"marks": m} for a, m in marks.items()}

    def _rows(self, low=None, high=None, ended=None, keep: ds.Expression | None = None, ids: bool = True) -> Iterator[tuple[str, pa.RecordBatch]]:
        """The marks and, where asked for, ids, archive by archive, of the row groups that may hold marks from low to high, until
        ended(mark) of the least mark that is left."""
        low = low if low is None else self.log.plain(self.log.typed(low))
        names = self.log.names
        by_instrument = any(x[0] == "per instrument" for x in self.asked.values())
        columns = [self.log.mark, *["archive_obs_id"] * (ids and self.log.mark != "archive_obs_id"), *[c for c in ("archive_code", *["instrument"] * by_instrument) if c in names and c != self.log.mark]]
        for first, last, _, group in self.log.groups:
            if low is not None and last is not None and last < low or high is not None and first is not None and first > high:
                continue
            if ended is not None and first is not None and ended(first):
                return
            for b in group.to_batches(columns=columns, filter=keep, batch_size=65_536, batch_readahead=2, fragment_readahead=1):
                if not len(b):
                    continue
                if "archive_code" not in names:
                    yield from ((a, b) for a in self.asked)
                    continue
                codes = b.column(columns.index("archive_code")).dictionary_encode()
                for k, a in enumerate(codes.dictionary.to_pylist()):
                    if a in self.asked:
                        yield a, b.filter(pc.equal(codes.indices, pa.scalar(k, codes.indices.type)))

    def _parts(self, a: str, rows: pa.RecordBatch) -> Iterator[tuple[str | None, list, pa.RecordBatch]]:
        """(key, mark and id of the cursor, rows) of an archive, by instrument where it is paged so."""
        paging, cursor, _ = self.asked[a]
        if paging != "per instrument":
            yield None, [cursor.get("mark"), cursor.get("id")], rows
            return
        names = rows["instrument"]
        for name in pc.unique(names).to_pylist():
            same = pc.is_null(names) if name is None else pc.fill_null(pc.equal(names, name), False)
            yield (key := json.dumps(name)), cursor.get("marks", {}).get(key, [None, None]), rows.filter(same)

    def _beyond(self, rows: pa.RecordBatch, mark, obs_id) -> pa.Array:
        at = rows[self.log.mark]
        good = pc.invert(pc.is_nan(at)) if pa.types.is_floating(at.type) else pc.is_valid(at)
        if mark is None:
            return good
        m = self.log.typed(mark)
        return pc.and_kleene(good, pc.or_kleene(pc.greater(at, m), pc.and_kleene(pc.equal(at, m), pc.greater(rows["archive_obs_id"], obs_id or ""))))

    @staticmethod
    def _least(values: list[pa.Array], n: int) -> pa.Array:
        t = pa.table({"x": pa.chunked_array(values)})
        return (t.take(pc.select_k_unstable(t, n, [("x", "ascending")])) if len(t) > n else t)["x"].combine_chunks()

    def _counted_marks(self) -> tuple[dict, dict]:
        """What _marks gives, by counts: each pass finds the bin that holds a page's last mark, until the bin is one mark wide."""
        kind, firsts, edges = self.log.type, {}, {}
        ends = [x for g in self.log.groups for x in g[:2]]
        ranged = (pa.types.is_signed_integer(kind) or pa.types.is_date32(kind)) and None not in ends
        lo, hi = (int(_keys(pa.array([f(ends)], pa.int64()))[0]) for f in (min, max)) if ranged and ends else (0, (1 << 64) - 1)
        seeks: dict[tuple, list] = {}  # least and greatest key that the last mark may have, and its rank among those
        open_: dict[tuple, list] | None = None
        known = all(x[0] not in WINDOWS and x[0] != "per instrument" for x in self.asked.values())
        starts = [c.get("start", c.get("mark")) for _, c, _ in self.asked.values()]
        low = None if None in starts else min(starts)  # an archive by instruments has neither
        resumed = any(c.get("marks") or c.get("mark") is not None for _, c, _ in self.asked.values())
        while open_ is None or open_:
            counts: dict[tuple, np.ndarray] = {}
            width = lambda k: (seeks[k][1] - seeks[k][0]) // self.BINS + 1

            def ended(first, counts=counts, width=width) -> bool:
                if not (ranged and known and len(counts) == len(self.asked if open_ is None else open_)):
                    return False
                at = int(_keys(pa.array([first], pa.int64()))[0])
                return all(at > seeks[k][0] and c[: (at - seeks[k][0]) // width(k)].sum() >= seeks[k][2] for k, c in counts.items())

            high = self.log.plain(_mark(max(x[1] for x in open_.values()), kind)) if open_ and ranged else None
            for a, rows in self._rows(low, high, ended=ended, ids=resumed):
                paging, cursor, size = self.asked[a]
                if paging in WINDOWS:
                    if open_ is None:
                        at = rows[self.log.mark]
                        if "start" in cursor:
                            at = at.filter(pc.greater_equal(at, self.log.typed(cursor["start"])))
                        first = self.log.plain(pc.min(at.drop_null()))
                        if first is not None and first == first:
                            firsts[a] = min(first, firsts.get(a, first))
                    continue
                for name, start, part in self._parts(a, rows):
                    if open_ is not None and (a, name) not in open_:
                        continue
                    marks = part[self.log.mark].filter(self._beyond(part, *start))
                    if not len(marks):
                        continue
                    k = a, name
                    least, most, _ = seeks.setdefault(k, [lo, hi, size])
                    x = _keys(marks)
                    x = x[(x >= np.uint64(least)) & (x <= np.uint64(most))]
                    own = np.bincount(((x - np.uint64(least)) // np.uint64(width(k))).astype(np.int64), minlength=self.BINS)
                    counts[k] = counts[k] + own if k in counts else own
            for k, c in counts.items():
                least, most, rank = seeks[k]
                upto = np.cumsum(c)
                rank = min(rank, int(upto[-1]))
                at = int(np.searchsorted(upto, rank))
                rank, w = rank - (int(upto[at - 1]) if at else 0), width(k)
                seeks[k] = [least + at * w, min(most, least + at * w + w - 1), rank]
                if seeks[k][0] == seeks[k][1]:
                    edges[k] = _mark(seeks[k][0], kind), rank
            open_ = {k: x for k, x in seeks.items() if k not in edges}
        return firsts, edges

    def _marks(self) -> tuple[dict, dict]:
        """(the first mark of each archive paged by windows, the last mark of the page of all others with how many of its
        rows have that mark)."""
        firsts: dict[str, object] = {}
        held: dict[tuple, list] = {}
        count: dict[tuple, int] = {}
        cut: dict[tuple, object] = {}  # the last mark of a page that is full
        known = all(x[0] not in WINDOWS and x[0] != "per instrument" for x in self.asked.values())

        def ended(first) -> bool:
            for k in [k for k in count if count[k] >= self.asked[k[0]][2]]:
                held[k] = [self._least(held[k], self.asked[k[0]][2])]
                count[k], cut[k] = len(held[k][0]), self.log.plain(pc.max(held[k][0]))
            return known and len(cut) == len(self.asked) and all(x < first for x in cut.values())

        starts = [c.get("start", c.get("mark")) for _, c, _ in self.asked.values()]
        low = None if None in starts else min(starts)  # an archive by instruments has neither
        resumed = any(c.get("marks") or c.get("mark") is not None for _, c, _ in self.asked.values())
        for a, rows in self._rows(low, ended=ended, ids=resumed):
            paging, cursor, size = self.asked[a]
            if paging in WINDOWS:
                at = rows[self.log.mark]
                if "start" in cursor:
                    at = at.filter(pc.greater_equal(at, self.log.typed(cursor["start"])))
                first = self.log.plain(pc.min(at.drop_null()))
                if first is not None and first == first:
                    firsts[a] = min(first, firsts.get(a, first))
                continue
            for name, start, part in self._parts(a, rows):
                marks = part[self.log.mark].filter(self._beyond(part, *start))
                if not len(marks):
                    continue
                k = a, name
                held.setdefault(k, []).append(marks)
                count[k] = count.get(k, 0) + len(marks)
                if count[k] > 2 * size:
                    held[k] = [self._least(held[k], size)]
                    count[k] = len(held[k][0])
        edges = {}
        for k, values in held.items():
            least = self._least(values, self.asked[k[0]][2])
            last = pc.max(least)
            edges[k] = last, pc.sum(pc.equal(least, last)).as_py()
        return firsts, edges

    def _ids(self, edges: dict) -> dict[tuple, list]:
        """The last mark and id of each page. Of the rows with its last mark the page has those with the least ids."""
        if not edges:
            return {}
        held: dict[tuple, list] = {}
        count: dict[tuple, int] = {}
        marks = [m for m, _ in edges.values()]
        plain = [self.log.plain(m) for m in marks]
        keep = ds.field(self.log.mark).isin(pa.array([m.as_py() for m in marks], marks[0].type).unique())
        for a, rows in self._rows(min(plain), max(plain), keep=keep):
            if self.asked[a][0] in WINDOWS:
                continue
            for name, start, part in self._parts(a, rows):
                if (k := (a, name)) not in edges:
                    continue
                mark, n = edges[k]
                tied = pc.and_kleene(pc.equal(part[self.log.mark], mark), self._beyond(part, *start))
                held.setdefault(k, []).append(part["archive_obs_id"].filter(tied))
                count[k] = count.get(k, 0) + len(held[k][-1])
                if count[k] > 2 * n + 65_536:
                    held[k] = [self._least(held[k], n)]
                    count[k] = len(held[k][0])
        return {k: [self.log.plain(edges[k][0]), pc.max(self._least(ids, edges[k][1])).as_py()] for k, ids in held.items()}

    def _starts(self, firsts: dict) -> dict[str, dict]:
        """The cursors after the windows that begin at the first marks; adaptive ones are halved until a page holds them."""
        out, open_ = {}, {}
        for a, first in firsts.items():
            paging, cursor, _ = self.asked[a]
            start, width = max(first, cursor.get("start", first)), cursor.get("width", self.width)
            if paging == "window":
                out[a] = {"start": start + width, "width": width}
                continue
            widths = [width]
            while widths[-1] > NARROWEST:
                widths.append(max(widths[-1] / 2, NARROWEST))
            open_[a] = start, widths, [0] * len(widths)
        if open_:
            low, high = min(s for s, *_ in open_.values()), max(s + w[0] for s, w, _ in open_.values())
            for a, rows in self._rows(low, high, ids=False):
                if a not in open_:
                    continue
                start, widths, n = open_[a]
                at = rows[self.log.mark]
                at = at.filter(pc.greater_equal(at, self.log.typed(start)))
                for i, w in enumerate(widths):
                    n[i] += pc.sum(pc.less(at, self.log.typed(start + w))).as_py() or 0
        for a, (start, widths, n) in open_.items():
            size = self.asked[a][2]
            w = next(w for w, m in zip(widths, n) if m < size or w <= NARROWEST)
            out[a] = {"start": start + w, "width": min(w * 2, max(WIDEST, self.width))}
        return out


def between(paging: str, start: dict, end: dict, mark: str, kind: pa.DataType) -> ds.Expression:
    """The rows of the pages between two cursors of an archive."""
    at, obs_id = ds.field(mark), ds.field("archive_obs_id")

    def page(a: list, b: list) -> ds.Expression:
        last = typed(b[0], kind)
        upto = (at < last) | ((at == last) & (obs_id <= b[1]))
        if a[0] is None:
            return upto
        first = typed(a[0], kind)
        return ((at > first) | ((at == first) & (obs_id > (a[1] or "")))) & upto

    if paging == "once":
        return at.is_valid()
    if paging in WINDOWS:
        upto = at < typed(end["start"], kind)
        return (at >= typed(start["start"], kind)) & upto if "start" in start else upto
    if paging != "per instrument":
        return page([start.get("mark"), start.get("id")], [end["mark"], end["id"]])
    own = ds.scalar(False)
    for name, b in end["marks"].items():
        a, value = start.get("marks", {}).get(name, [None, None]), json.loads(name)
        if a != b:
            own = own | ((ds.field("instrument").is_null() if value is None else ds.field("instrument") == value) & page(a, b))
    return own


class FeedStream(DataSourceStreamReader):
    """Pages of one or more archives. The driver looks up where the next page of each ends; executors read the rows."""

    def __init__(self, options: dict):
        self.archives, self.path = options["archive"].split(","), options["path"]
        self.options, self.mark = dict(options), options.get("mark", "mark")
        self.at: dict | None = None  # the last offset given

    def initialOffset(self) -> dict:
        return {a: "{}" for a in self.archives}

    def _paging(self, archive: str) -> str:
        spec = ARCHIVES.get(archive)
        return self.options.get(f"paging.{archive}") or self.options.get("paging") or (spec.paging if spec else "watermark")

    def _size(self, archive: str) -> int:
        spec = ARCHIVES.get(archive)
        return int(self.options.get("page_size") or (spec.page if spec else 20_000))

    def latestOffset(self) -> dict:
        start = self.at or self.initialOffset()
        asked = {a: (self._paging(a), json.loads(start.get(a, "{}")), self._size(a)) for a in self.archives}
        ends = Ends(Log(self.path, "", self.mark), asked, float(self.options.get("width", 7))).cursors()
        self.at = {a: json.dumps(ends[a], sort_keys=True) for a in self.archives}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.at is None:  # a query that resumes goes on from the last offset it planned
            self.at = end
        moved = [(a, self._paging(a), start.get(a, "{}"), end[a]) for a in self.archives if a in end and start.get(a, "{}") != end[a]]
        if not moved:
            return []
        return [InputPartition((f.path, g.id, moved)) for f in ds.dataset(self.path, format="parquet").get_fragments() for g in f.row_groups]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        file, group, moved = partition.value
        fragment = next(ds.dataset(file, format="parquet").get_fragments()).subset(row_group_ids=[group])
        schema = fragment.physical_schema
        for b in _pages(fragment, schema, moved, self.mark):
            yield to_batch(pa.Table.from_batches([b]))


def _pages(fragment, schema: pa.Schema, moved: list[tuple], mark: str) -> Iterator[pa.RecordBatch]:
    """What the archives that moved from one cursor to another have in a row group."""
    keep = ds.scalar(False)
    for archive, paging, start, end in moved:
        own = between(paging, json.loads(start), json.loads(end), mark, schema.field(mark).type)
        keep = keep | (own & (ds.field("archive_code") == archive) if "archive_code" in schema.names else own)
    columns = [c for c in schema.names if c in FIELDS or c.removeprefix("raw_") in FIELDS]
    for b in fragment.to_batches(filter=keep, columns=columns, batch_size=32_768, batch_readahead=2, fragment_readahead=1):
        if len(b):
            yield b


class Group(InputPartition):
    def __init__(self, file: str, group: int):
        super().__init__((file, group))
        self.file, self.group = file, group


class FeedBatch(DataSourceReader):
    """A whole log, one task for each row group that may hold the archive; * is all archives."""

    def __init__(self, options: dict):
        self.archive, self.path = options["archive"], options["path"]

    def partitions(self) -> list[InputPartition]:
        out = []
        for f in ds.dataset(self.path, format="parquet").get_fragments():
            for g in f.row_groups:
                seen = (g.statistics or {}).get("archive_code")
                if not seen or self.archive == "*" or seen["min"] <= self.archive <= seen["max"]:
                    out.append(Group(f.path, g.id))
        return out or [Group("", -1)]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        if partition.group < 0:
            return
        fragment = next(ds.dataset(partition.file, format="parquet").get_fragments()).subset(row_group_ids=[partition.group])
        names = fragment.physical_schema.names
        keep = ds.field("archive_code") == self.archive if "archive_code" in names and self.archive != "*" else None
        for b in fragment.to_batches(filter=keep, columns=[c for c in names if c in FIELDS or c.removeprefix("raw_") in FIELDS]):
            if len(b):
                yield to_batch(pa.Table.from_batches([b]))


class ArchiveFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_feed"

    def schema(self) -> str:
        return RAW_OBSERVATION

    def reader(self, schema) -> DataSourceReader:
        if ARCHIVES.get(self.options["archive"], (None,))[0] == "stub":
            raise NotImplementedError(f"{self.options['archive']} has released nothing")
        return FeedBatch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveFeed)
