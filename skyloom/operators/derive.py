"""Derived tables of the holdings snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.geo import clamp
from skyloom.functions.names import common_name, group_key, known_as, search_key

TOP = 20


def dated(df: DataFrame) -> DataFrame:
    """With yr and half, the half-year period of obs_date."""
    return df.withColumns({"yr": F.year("obs_date"), "half": F.when(F.month("obs_date") <= 6, 1).otherwise(2)})


def category() -> Column:
    """How a row was matched, or why it was not. match_method keeps what was tried, so it counts for matches only."""
    return F.when(F.col("match_status") == "matched", F.col("match_method")).otherwise(F.col("match_status"))


def label() -> Column:
    return common_name(F.col("name_aliases"), F.col("input_name"), F.col("gaia_source_id"))


def sample_order(key: Column, salt: str = "") -> Column:
    """A repeatable stand-in for a random order."""
    return F.md5(F.concat(key.cast("string"), F.lit(salt)))


def archive_status(holdings: DataFrame, archives: DataFrame, state: DataFrame) -> DataFrame:
    """Counts by category next to the dates and the last sync of each archive. One pass over holdings."""
    per = holdings.groupBy("archive_code", category().alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min("obs_date").alias("lo"), F.max("obs_date").alias("hi"))
    of = Window.partitionBy("archive_code")
    spanned = per.withColumns({"min_obs_date": F.min("lo").over(of), "max_obs_date": F.max("hi").over(of)}).drop("lo", "hi")
    runs = state.select("archive_code", "last_run_at", "last_run_status", "rows_seen_last_run")
    return archives.select("archive_code", "display_name").join(runs, "archive_code", "left").join(spanned, "archive_code", "left")


def instrument_counts(holdings: DataFrame, archives: DataFrame) -> DataFrame:
    per = holdings.filter("instrument IS NOT NULL").groupBy("archive_code", "instrument").agg(F.count(F.lit(1)).alias("n"))
    named = per.join(archives.select("archive_code", "display_name"), "archive_code")
    return named.groupBy("display_name", "instrument").agg(F.sum("n").alias("n"))


def instrument_sky_sample(holdings: DataFrame, instruments: int = 12, each: int = 2000) -> DataFrame:
    placed = holdings.filter("instrument IS NOT NULL AND raw_ra IS NOT NULL AND raw_dec IS NOT NULL AND NOT isnan(raw_ra) AND NOT isnan(raw_dec)")
    most = placed.groupBy("instrument").count().orderBy(F.desc("count"), "instrument").limit(instruments).select("instrument")
    order = Window.partitionBy("instrument").orderBy(sample_order(F.col("id")), "id")
    chosen = placed.select("id", "instrument", "raw_ra", "raw_dec").join(F.broadcast(most), "instrument", "left_semi")
    return chosen.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= each).select("instrument", "raw_ra", "raw_dec")


def sky_sample(stars: DataFrame, size: int = 30_000) -> DataFrame:
    good = stars.filter("ra IS NOT NULL AND dec IS NOT NULL AND phot_g_mean_mag IS NOT NULL")
    return good.orderBy(sample_order(F.col("star_id")), "star_id").limit(size).select(
        "gaia_source_id", "ra", "dec", "phot_g_mean_mag", known_as(F.col("name_aliases"), F.col("input_name"), F.col("gaia_source_id")).alias("known_as")
    )


def star_name_index(stars: DataFrame) -> DataFrame:
    ids = ["gaia_source_id", "bsc_hr_number"]
    names = F.array_append(F.coalesce("name_aliases", F.array().cast("array<string>")), F.col("input_name"))
    listed = stars.select(*ids, F.explode(names).alias("name")).filter("name IS NOT NULL AND trim(name) <> ''")
    return listed.select(search_key(F.col("name")).alias("normalized_name"), *ids).distinct()


def leaderboard_counts(holdings: DataFrame) -> DataFrame:
    known = holdings.filter("obs_date IS NOT NULL AND star_id IS NOT NULL")
    return dated(known).groupBy("star_id", "yr", "half").agg(F.count(F.lit(1)).alias("n"))


def top_period(counts: DataFrame, top: int = TOP) -> DataFrame:
    order = Window.partitionBy("yr", "half").orderBy(F.desc("n"), "star_id")
    return counts.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= top).drop("rk")


def periods_of(counts: DataFrame) -> DataFrame:
    """The periods present, numbered in time; a few hundred rows."""
    return counts.select("yr", "half").distinct().withColumn("p", F.row_number().over(Window.orderBy("yr", "half")))


def top_cumulative(counts: DataFrame, top: int = TOP) -> DataFrame:
    """The top stars by running total in every period, without a star by period grid.

    A running total lasts from its period to the one before the star's next. The top-th largest total of the rows
    that start in a period bounds the winners' totals of that and all later periods from below, so a row is
    only unfolded into the periods in which it reaches the bound."""
    ps = periods_of(counts)
    last = ps.agg(F.max("p").alias("last"))
    own = Window.partitionBy("star_id").orderBy("p")
    runs = (
        counts.join(F.broadcast(ps), ["yr", "half"]).crossJoin(F.broadcast(last))
        .withColumn("cum_n", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("until", F.coalesce(F.lead("p").over(own) - 1, F.col("last")))
        .select("star_id", "p", "until", "cum_n")
    )
    nth = runs.withColumn("rk", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("cum_n"), "star_id"))).filter(F.col("rk") == top)
    floor_ = Window.orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    bounds = ps.select(F.col("p").alias("q")).join(nth.select(F.col("p").alias("q"), F.col("cum_n").alias("c")), "q", "left").select("q", F.coalesce(F.max("c").over(floor_), F.lit(0)).alias("bound"))
    table = F.broadcast(bounds.agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "bound"))), lambda x: x["bound"]).alias("bounds")))
    open_ = runs.crossJoin(table).select("star_id", "cum_n", F.explode(F.filter(F.sequence("p", "until"), lambda q: F.col("cum_n") >= F.get("bounds", q - 1))).alias("p"))
    order = Window.partitionBy("p").orderBy(F.desc("cum_n"), "star_id")
    best = open_.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= top)
    return best.join(F.broadcast(ps), "p").select("star_id", "yr", "half", "cum_n")


def star_labels(stars: DataFrame) -> DataFrame:
    return stars.select("star_id", "gaia_source_id", "bsc_hr_number", label().alias("label"))


def leaderboard(holdings: DataFrame, stars: DataFrame, top: int = TOP) -> DataFrame:
    counts = leaderboard_counts(holdings)
    within, total = top_period(counts, top), top_cumulative(counts, top)
    cast = within.select("star_id").union(total.select("star_id")).distinct()
    grid = cast.crossJoin(F.broadcast(periods_of(counts).select("yr", "half")))
    key = ["star_id", "yr", "half"]
    filled = grid.join(within.withColumnRenamed("n", "within_n"), key, "left").join(total.withColumnRenamed("cum_n", "cumulative_n"), key, "left")
    return star_labels(stars).join(filled, "star_id")


def diversity_counts(holdings: DataFrame, archives: DataFrame) -> DataFrame:
    known = dated(holdings.filter("obs_date IS NOT NULL AND star_id IS NOT NULL AND instrument IS NOT NULL"))
    distinct = known.select("star_id", "yr", "half", "archive_code", "instrument").distinct()
    return distinct.join(archives.select("archive_code", "display_name"), "archive_code").select(
        "star_id", "yr", "half", F.concat_ws("::", "display_name", "instrument").alias("instrument_key")
    ).distinct()


def log_widths(ranges: DataFrame) -> DataFrame:
    """instrument_key, log_width of (display_name, instrument, wave_min, wave_max) in nm."""
    good = ranges.filter("wave_min > 0 AND wave_max > wave_min")
    return good.select(F.concat_ws("::", "display_name", "instrument").alias("instrument_key"), F.log10(F.col("wave_max") / F.col("wave_min")).alias("log_width"))


def diversity_deltas(counts: DataFrame, widths: DataFrame) -> DataFrame:
    """How many instruments, and how much log wavelength, are new for a star in a period."""
    first = counts.join(F.broadcast(periods_of(counts)), ["yr", "half"]).groupBy("star_id", "instrument_key").agg(F.min("p").alias("p"))
    return first.join(widths, "instrument_key", "left").groupBy("star_id", "p").agg(
        F.count(F.lit(1)).alias("new_instruments"), F.sum(F.coalesce("log_width", F.lit(0.0))).alias("new_loglam")
    )


def diversity(holdings: DataFrame, archives: DataFrame, stars: DataFrame, widths: DataFrame, top: int = TOP) -> DataFrame:
    counts = diversity_counts(holdings, archives)
    own = Window.partitionBy("star_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    running = diversity_deltas(counts, widths).withColumns({"c": F.sum("new_instruments").over(own), "l": F.sum("new_loglam").over(own)})
    last = running.groupBy("star_id").agg(F.max_by("c", "p").alias("c"), F.max_by("l", "p").alias("l"))
    by = lambda x: last.orderBy(F.desc(x), "star_id").limit(top).select("star_id")
    cast = by("c").union(by(F.round("l", 9))).distinct()
    grid = cast.crossJoin(F.broadcast(periods_of(counts))).join(running, ["star_id", "p"], "left")
    filled = grid.select("star_id", "yr", "half", F.last("c", True).over(own).alias("cum_instrument_count"), F.last("l", True).over(own).alias("cum_loglam_covered"))
    return star_labels(stars).join(filled, "star_id")


def observed_counts(holdings: DataFrame) -> DataFrame:
    return holdings.filter("star_id IS NOT NULL").groupBy("star_id").agg(F.count(F.lit(1)).alias("n"))


def cmd_stars(holdings: DataFrame, stars: DataFrame, size: int = 30_000) -> DataFrame:
    good = stars.filter("phot_bp_mean_mag IS NOT NULL AND phot_rp_mean_mag IS NOT NULL AND phot_g_mean_mag IS NOT NULL AND parallax > 0")
    return good.join(observed_counts(holdings), "star_id").orderBy(F.desc("n"), "star_id").limit(size).select(
        "gaia_source_id", (F.col("phot_bp_mean_mag") - F.col("phot_rp_mean_mag")).alias("bp_rp"),
        (F.col("phot_g_mean_mag") + 5 * F.log10("parallax") - 10).alias("abs_g_mag"), label().alias("label"),
    )


def most_observed(holdings: DataFrame, stars: DataFrame, top: int = TOP, since: Column | None = None) -> DataFrame:
    """Stars with most rows, of rows from `since` on if given. Counts come before the join, so it is narrow."""
    rows = holdings if since is None else holdings.filter(F.col("obs_date") >= since)
    counted = observed_counts(rows).join(stars, "star_id").orderBy(F.desc("n"), "star_id").limit(top)
    return counted.select("gaia_source_id", "bsc_hr_number", label().alias("known_as"), "n")


def counts_by_archive(holdings: DataFrame, archives: DataFrame) -> DataFrame:
    per = holdings.groupBy("archive_code").agg(F.count(F.lit(1)).alias("k"))
    return per.join(archives, "archive_code").groupBy("display_name").agg(F.sum("k").alias("n"))


def nearest(stars: DataFrame, top: int = TOP) -> DataFrame:
    return stars.filter("parallax > 0").orderBy(F.desc("parallax"), "star_id").limit(top).select(
        "gaia_source_id", "bsc_hr_number", label().alias("known_as"), (1000.0 / F.col("parallax").cast("double")).alias("distance_pc")
    )


def fastest(stars: DataFrame, top: int = TOP) -> DataFrame:
    moving = stars.filter("pmra IS NOT NULL AND pmdec IS NOT NULL").withColumn("total_pm", F.sqrt(F.col("pmra") * F.col("pmra") + F.col("pmdec") * F.col("pmdec")))
    return moving.orderBy(F.desc("total_pm"), "star_id").limit(top).select("gaia_source_id", "bsc_hr_number", label().alias("known_as"), "total_pm")


def spectral_class(colour: Column) -> Column:
    # Upper edges of bp - rp and the classes below them.
    edges = [(0.0, "O/B (hot)"), (0.3, "A"), (0.6, "F"), (0.9, "G"), (1.5, "K")]
    out = F.when(colour < edges[0][0], edges[0][1])
    for edge, name in edges[1:]:
        out = out.when(colour < edge, name)
    return out.otherwise("M (cool)")


def spectral_types(stars: DataFrame) -> DataFrame:
    colour = (F.col("phot_bp_mean_mag") - F.col("phot_rp_mean_mag")).cast("double")
    return stars.filter("phot_bp_mean_mag IS NOT NULL AND phot_rp_mean_mag IS NOT NULL").groupBy(spectral_class(colour).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def latest_with_status(holdings: DataFrame, archives: DataFrame, status: str, top: int = TOP) -> DataFrame:
    rows = holdings.filter(F.col("match_status") == status).orderBy(F.desc("updated_at"), F.desc("id")).limit(top)
    cols = ["display_name", "raw_target_name", "raw_ra", "raw_dec", "obs_date", "theta_arcsec", "reduction_status"]
    return rows.join(archives, "archive_code").select(*[c for c in cols if c != "theta_arcsec" or status == "needs_review"])


def triage_queue(holdings: DataFrame, archives: DataFrame, keep: int = 50, top: int = 2000) -> DataFrame:
    """Unmatched rows by archive and name, the newest `keep` observations of each, and how far their positions
    spread. Lists are made of at most `keep` rows a group, found by a ranked window whose group limit works before
    the shuffle; everything else is a plain aggregate with map-side combine."""
    skipped = holdings.filter(F.col("match_status") == "skipped").withColumn("group_key", group_key(F.col("raw_target_name"), F.col("archive_obs_id")))
    key = ["archive_code", "group_key"]
    d, r = F.radians("raw_dec"), F.radians("raw_ra")
    vectors = {"vx": F.cos(d) * F.cos(r), "vy": F.cos(d) * F.sin(r), "vz": F.sin(d)}
    whole = skipped.withColumns(vectors).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_records"), F.count("vx").alias("nv"), *[F.sum(v).alias(v) for v in vectors],
        F.max("updated_at").alias("updated_at"), F.min("obs_date").alias("obs_date"), F.min("instrument").alias("instrument"), F.max(F.trim("raw_target_name")).alias("name"),
    )
    named = F.when(F.col("name") != "", F.col("name"))
    chosen = whole.withColumn("raw_target_name", named).orderBy(F.desc(F.col("raw_target_name").isNotNull()), F.desc("n_records"), *key).limit(top)
    rank = Window.partitionBy(*key).orderBy(F.desc("updated_at"), F.desc("id"))
    newest = (
        skipped.select(*key, "id", "updated_at", "archive_obs_id", "archive_url", "raw_ra", "raw_dec").withColumn("rn", F.row_number().over(rank)).filter(F.col("rn") <= keep)
        .groupBy(*key).agg(
            F.array_sort(F.collect_list(F.struct("rn", "archive_obs_id", "archive_url"))).alias("all"),
            F.max(F.when(F.col("rn") == 1, F.col("raw_ra"))).alias("raw_ra"), F.max(F.when(F.col("rn") == 1, F.col("raw_dec"))).alias("raw_dec"),
        )
    )
    length = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")) / F.col("nv")
    spread = F.when(F.col("nv") >= 2, F.degrees(F.acos(clamp(length, 0.0, 1.0))))
    return newest.join(F.broadcast(chosen), key).join(archives.select("archive_code", "display_name"), "archive_code").select(
        "archive_code", "display_name", "group_key", "raw_target_name", "n_records",
        F.transform("all", lambda x: x["archive_obs_id"]).alias("archive_obs_ids"), F.transform("all", lambda x: x["archive_url"]).alias("archive_urls"),
        "raw_ra", "raw_dec", spread.alias("position_spread_deg"), "updated_at", "obs_date", "instrument",
    )


def set_overlap(sets: DataFrame, column: str, ways: int, names: list[str]) -> DataFrame:
    """How many sets hold each pair or triple of members, a pair of one with itself included. A set has few members,
    so they are combined within the row and no pair of rows ever meets."""
    df = sets
    for i, name in enumerate(names[:ways]):
        df = df.withColumn(name, F.explode(column))
        if i:
            df = df.filter(F.col(names[i - 1]) <= F.col(name))
    return df.groupBy(*names[:ways]).agg(F.count(F.lit(1)).alias("n_overlap"))


def archive_sets(holdings: DataFrame) -> DataFrame:
    matched = holdings.filter("match_status = 'matched' AND star_id IS NOT NULL")
    return matched.groupBy("star_id").agg(F.collect_set("archive_code").alias("codes")).select("codes")


def archive_overlap(holdings: DataFrame, archives: DataFrame, ways: int = 2) -> DataFrame:
    pairs = set_overlap(archive_sets(holdings), "codes", ways, ["archive_a", "archive_b", "archive_c"])
    if ways == 3:
        return pairs
    for x in "ab":
        pairs = pairs.join(archives.select(F.col("archive_code").alias(f"archive_{x}"), F.col("display_name").alias(f"display_{x}")), f"archive_{x}")
    return pairs


def instrument_overlap(holdings: DataFrame, ways: int = 2, top: int = TOP) -> DataFrame:
    matched = holdings.filter("match_status = 'matched' AND instrument IS NOT NULL")
    most = matched.groupBy("instrument").count().orderBy(F.desc("count"), "instrument").limit(top).select("instrument")
    kept = matched.filter("star_id IS NOT NULL").select("star_id", "instrument").join(F.broadcast(most), "instrument", "left_semi")
    sets = kept.groupBy("star_id").agg(F.collect_set("instrument").alias("insts")).select("insts")
    return set_overlap(sets, "insts", ways, ["instrument_a", "instrument_b", "instrument_c"])


def by_position(holdings: DataFrame) -> DataFrame:
    cols = ["id", "star_id", "archive_code", "instrument", "obs_date", "match_status", "raw_target_name", "raw_ra", "raw_dec"]
    return holdings.filter("raw_ra IS NOT NULL AND raw_dec IS NOT NULL AND NOT isnan(raw_ra) AND NOT isnan(raw_dec)").select(*cols)


def treemap(per_instrument: DataFrame) -> DataFrame:
    """Leaf sizes log10(n + 1), rescaled so that the leaves of an archive sum to log10 of its own total + 1."""
    of = Window.partitionBy("display_name")
    weight = F.log10(F.col("n") + 1.0)
    return per_instrument.select("display_name", "instrument", "n", (weight * F.log10(F.sum("n").over(of) + 1.0) / F.sum(weight).over(of)).alias("weight"))


def status_pivot(status: DataFrame, categories: list[str]) -> DataFrame:
    """One row per archive with a column for each category, 0 where there is none, and the total."""
    wide = status.groupBy("archive_code", "display_name").agg(
        *[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n"))), F.lit(0)).alias(c) for c in categories], F.coalesce(F.sum("n"), F.lit(0)).alias("total")
    )
    return wide


def merge_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old totals plus those of new rows."""
    fresh = new.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return old.unionByName(fresh).groupBy(key).agg(F.sum("n").alias("n"))


def voters(votes: DataFrame) -> DataFrame:
    key = ["archive_code", "archive_obs_id"]
    return votes.groupBy(*key).agg(F.countDistinct(F.lower(F.trim("submitter"))).alias("n_voters"))


def date_ordinals(holdings: DataFrame) -> DataFrame:
    """A suffix where a star has several rows of one archive and date: the row's ordinal among them."""
    key = ["star_id", "archive_code", "obs_date"]
    of = Window.partitionBy(*key)
    rows = holdings.filter("star_id IS NOT NULL AND obs_date IS NOT NULL").select("id", *key)
    numbered = rows.withColumns({"k": F.count(F.lit(1)).over(of), "ordinal": F.row_number().over(of.orderBy("id"))})
    return numbered.select("id", *key, F.when(F.col("k") > 1, F.col("ordinal")).alias("ordinal"))
