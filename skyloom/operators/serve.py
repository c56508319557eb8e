"""What a user asks of the snapshot: stars by id or name, their holdings, batches, filters, reviews, exports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.names import search_key
from skyloom.operators.derive import star_name_index
from skyloom.operators.match import cone_search


def find_star(stars: DataFrame, query: str) -> DataFrame:
    """The star meant by an id or a name: a catalogue id, else a bright-star number, else 'hr n', else a name."""
    q = query.strip()
    hr = q[3:].strip() if q.lower().startswith("hr ") else ""
    tries = []
    if q.isdigit():
        tries += [F.col("gaia_source_id") == int(q), F.col("bsc_hr_number") == int(q)] if int(q) < 2**31 else [F.col("gaia_source_id") == int(q)]
    if hr.isdigit():
        tries.append(F.col("bsc_hr_number") == int(hr))
    if tries:
        rank = reduce(lambda acc, t: acc.when(t[1], t[0]), enumerate(tries[1:], 1), F.when(tries[0], 0))
        return stars.filter(reduce(lambda a, b: a | b, tries)).withColumn("_rank", rank).orderBy("_rank", "star_id").limit(1).drop("_rank")
    key = stars.sparkSession.range(1).select(search_key(F.lit(q)).alias("k")).first()[0]
    hit = star_name_index(stars).filter(F.col("normalized_name") == key).orderBy(F.col("gaia_source_id").asc_nulls_last(), "bsc_hr_number").limit(1)
    same = stars["gaia_source_id"].eqNullSafe(hit["gaia_source_id"]) & stars["bsc_hr_number"].eqNullSafe(hit["bsc_hr_number"])
    return stars.join(F.broadcast(hit), same, "left_semi")


def holdings_for(holdings: DataFrame, archives: DataFrame, star: DataFrame) -> DataFrame:
    return holdings.join(F.broadcast(star.select("star_id")), "star_id", "left_semi").join(archives.select("archive_code", "display_name"), "archive_code")


def star_page(holdings: DataFrame, archives: DataFrame, stars: DataFrame, query: str, **filters) -> DataFrame:
    """The holdings of the star that is meant, with their place in the order shown: archive, instrument, date, id. Filters are
    those of filter_holdings. One star's rows are numbered by one window, which spills where they are many."""
    rows = filter_holdings(holdings_for(holdings, archives, find_star(stars, query)), **filters)
    order = Window.orderBy("display_name", F.col("instrument").asc_nulls_first(), F.col("obs_date").asc_nulls_first(), "id")
    return rows.withColumn("place", F.row_number().over(order))


def cone_page(holdings: DataFrame, archives: DataFrame, stars: DataFrame, ra: float, dec: float, radius_deg: float, **filters) -> DataFrame:
    """What the archives hold of every star within a cone: star_id, display_name, instrument, n."""
    inside = cone_search(stars.select("star_id", "ra", "dec"), ra, dec, radius_deg, None).select("star_id")
    rows = holdings.join(inside, "star_id", "left_semi").join(archives.select("archive_code", "display_name"), "archive_code")
    return filter_holdings(rows, **filters).groupBy("star_id", "display_name", "instrument").agg(F.count(F.lit(1)).alias("n"))


def cone_summary(stars: DataFrame, ra: float, dec: float, radius_deg: float) -> DataFrame:
    """How many stars a cone holds, the brightest magnitude and the nearest's distance in arcsec."""
    inside = cone_search(stars, ra, dec, radius_deg, None)
    return inside.agg(F.count(F.lit(1)).alias("n"), F.min("phot_g_mean_mag").alias("brightest"), (F.min("sep_deg") * 3600).alias("nearest"))


def series(values: DataFrame, periods: DataFrame, key: str, value: str) -> DataFrame:
    """An array for each key with its value in every period in time, null where it has none. Periods (yr, half) are a few
    hundred at most."""
    at = periods.agg(F.array_sort(F.collect_list(F.struct("yr", "half"))).alias("_all"))
    of = values.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("yr", "half"), F.col(value)))).alias("_map"))
    return of.crossJoin(F.broadcast(at)).select(key, F.transform("_all", lambda p: F.try_element_at("_map", p)).alias("series"))


def overlaps(low: Column, high: Column, want_low: float | None, want_high: float | None) -> Column:
    """Whether two ranges meet; an open end of the wanted one is 0 or infinite."""
    return (low <= (float("inf") if want_high is None else want_high)) & (high >= (0.0 if want_low is None else want_low))


def filter_holdings(holdings: DataFrame, dims: DataFrame | None = None, archive: str | None = None, instrument: str | None = None, reduction: str | None = None, wave: tuple[float | None, float | None] | None = None) -> DataFrame:
    """Rows that pass all filters given. With a wavelength filter, what is not in dims (display_name, instrument, wave_min,
    wave_max) fails."""
    tests = [F.col(c) == v for c, v in (("archive_code", archive), ("instrument", instrument), ("reduction_status", reduction)) if v is not None]
    kept = holdings.filter(reduce(lambda a, b: a & b, tests)) if tests else holdings
    if wave is None:
        return kept
    good = dims.filter(overlaps(F.col("wave_min"), F.col("wave_max"), *wave)).select("display_name", "instrument").distinct()
    return kept.join(good, ["display_name", "instrument"], "left_semi")


def batch_lines(text: str, df: DataFrame) -> DataFrame:
    """Non-blank trimmed lines of a text, each once, in order: pos, entry."""
    lines = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(text), r"\r?\n")).alias("pos", "entry")).select("pos", F.btrim("entry", F.lit(" \t")).alias("entry"))
    return lines.filter("entry <> ''").groupBy("entry").agg(F.min("pos").alias("pos"))


def batch_lookup(entries: DataFrame, stars: DataFrame, holdings: DataFrame) -> DataFrame:
    """entry, status ('not resolved', 'tracked'), star_id and n_holdings for each entry, a name."""
    keyed = entries.select("entry", search_key(F.col("entry")).alias("normalized_name"))
    names = F.array_append(F.coalesce("name_aliases", F.array().cast("array<string>")), F.col("input_name"))
    listed = stars.select("star_id", F.explode(names).alias("n")).filter("trim(n) <> ''").groupBy(search_key(F.col("n")).alias("normalized_name")).agg(F.min("star_id").alias("star_id"))
    found = keyed.join(listed, "normalized_name", "left")
    counts = holdings.join(found.select("star_id").distinct(), "star_id", "left_semi").groupBy("star_id").agg(F.count(F.lit(1)).alias("n"))
    return found.join(counts, "star_id", "left").select(
        "entry", F.when(F.col("star_id").isNull(), "not resolved").otherwise("tracked").alias("status"), "star_id", F.coalesce("n", F.lit(0)).alias("n_holdings")
    )


def batch_rows(entries: DataFrame, stars: DataFrame, holdings: DataFrame, most: int = 2000) -> DataFrame:
    """A row for each holding of each entry, and one for an entry without: entry, status ('not resolved', 'not tracked' where
    the star has no holdings, 'tracked'), star_id and the columns of holdings. More than `most` entries are refused."""
    if entries.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} names")
    found = batch_lookup(entries, stars, holdings)
    status = F.when(F.col("star_id").isNull(), "not resolved").when(F.col("n_holdings") == 0, "not tracked").otherwise("tracked")
    return found.withColumn("status", status).drop("n_holdings").join(holdings, "star_id", "left")


def instrument_csv(holdings: DataFrame, archives: DataFrame, instrument: str, columns: tuple[str, ...] = ("id", "display_name", "instrument")) -> tuple[int, Iterator[str]]:
    """(200, lines) of an instrument's holdings; 400 without a name, 404 where there are none."""
    if not (instrument or "").strip():
        return 400, iter(())
    rows = holdings.filter(F.col("instrument") == instrument)
    if rows.isEmpty():
        return 404, iter(())
    return 200, csv_lines(rows.join(archives.select("archive_code", "display_name"), "archive_code"), list(columns))


def per_star_groups(rows: DataFrame) -> DataFrame:
    """How many observations each archive and instrument has and since when. The observations themselves are rows of
    star_page, as a star may own a tenth of the table."""
    return rows.groupBy("display_name", "instrument").agg(F.count(F.lit(1)).alias("n"), F.min("obs_date").alias("first_date"))


def review_queue(queue: DataFrame, votes: DataFrame, reviewer: str) -> DataFrame:
    """The queue without what the reviewer has voted on, whatever the case of the name."""
    mine = votes.filter(F.lower(F.trim("submitter")) == reviewer.strip().lower()).select("archive_code", "archive_obs_id").distinct()
    single = queue.select("archive_code", "group_key", F.explode("archive_obs_ids").alias("archive_obs_id"))
    seen = single.join(mine, ["archive_code", "archive_obs_id"], "left_semi").select("archive_code", "group_key").distinct()
    return queue.join(seen, ["archive_code", "group_key"], "left_anti")


def with_votes(queue: DataFrame, voters: DataFrame) -> DataFrame:
    """The queue with n_votes, the most voters that an observation of the group has."""
    single = queue.select("archive_code", "group_key", F.explode("archive_obs_ids").alias("archive_obs_id"))
    most = single.join(voters, ["archive_code", "archive_obs_id"]).groupBy("archive_code", "group_key").agg(F.max("n_voters").alias("n_votes"))
    return queue.join(most, ["archive_code", "group_key"], "left").na.fill(0, ["n_votes"])


def review_page(queue: DataFrame, votes: DataFrame, reviewer: str, seed: str, offset: int, size: int) -> DataFrame:
    """A page of the shuffled queue as a reviewer sees it, with place from 1."""
    ordered = weighted_order(review_queue(queue, votes, reviewer), "n_votes", seed, "place")
    return ordered.filter((F.col("place") > offset) & (F.col("place") <= offset + size))


def weighted_order(queue: DataFrame, n_votes: str, seed: str, place: str) -> DataFrame:
    """A weighted shuffle without replacement: named groups first, then by -ln(u) / weight, where u comes from the
    seed and the group and weight is the size halved by every vote. The queue has a top of a few thousand groups, so one
    window numbers them."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), "archive_code", "group_key")), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    weight = F.greatest(F.col("n_records"), F.lit(1)) / F.pow(F.lit(2.0), F.col(n_votes))
    order = Window.orderBy(F.desc(F.col("raw_target_name").isNotNull()), "_k")
    return queue.withColumn("_k", -F.log(u) / weight).withColumn(place, F.row_number().over(order)).drop("_k")


def at_offset(df: DataFrame, order: list[str], offset: int) -> DataFrame:
    """The one row at offset modulo the number of rows."""
    n = df.count()
    return df.orderBy(*order).offset(offset % n).limit(1) if n else df.limit(0)


def pack_rows(intervals: DataFrame, key: list[str], low: str, high: str, ties: list[str] = []) -> DataFrame:  # noqa: B006
    """Interval charts: `row` puts each interval of a group, by start, end and `ties`, into the first row whose last one has ended.
    Inherently sequential within a group; groups are the few instruments of one star."""
    names = intervals.columns

    def pack(table: pa.Table) -> pa.Table:
        starts, stops = table.column(low).to_pylist(), table.column(high).to_pylist()
        order = sorted(range(len(starts)), key=lambda i: (starts[i], stops[i], *(table.column(t)[i].as_py() for t in ties)))
        ends: list[float] = []
        row = [0] * len(starts)
        for i in order:
            place = next((r for r, e in enumerate(ends) if e <= starts[i]), len(ends))
            ends[place : place + 1] = [stops[i]]
            row[i] = place
        return table.append_column("row", pa.array(row, pa.int32()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in intervals.select(*names).schema) + ", row int"
    return intervals.groupBy(*key).applyInArrow(pack, schema)


def colour_index(df: DataFrame, category: str, order: list[str], colours: int = 8) -> DataFrame:
    """Each category's place by first appearance, modulo the number of colours. The categories are few."""
    first = df.groupBy(category).agg(F.min(F.struct(*order)).alias("_f"))
    return first.withColumn("colour", (F.row_number().over(Window.orderBy("_f")) - 1) % colours).drop("_f")


def to_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """The named columns, in that order, as CSV with a header, written in parallel."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def csv_lines(df: DataFrame, columns: list[str]) -> Iterator[str]:
    """CSV lines one by one, a partition at a time."""
    yield ",".join(columns)
    line = F.to_csv(F.struct(*columns))
    for row in df.select(line.alias("x")).toLocalIterator():
        yield row[0]


def option_counts(holdings: DataFrame, column: str) -> DataFrame:
    return holdings.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 0")

