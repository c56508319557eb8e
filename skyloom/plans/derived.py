"""Queries over the derived tables, each with its SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import derive as D
from skyloom.session import load

QUERIES, SQL = {}, {}
#: the day that counts as today, so that results repeat
TODAY = datetime.date(2024, 6, 30)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def h(spark: SparkSession, d: str) -> DataFrame:
    """The holdings, with NaN positions as null, as they would be had a feed brought them."""
    rows = load(spark, d, "spectroscopy_holdings")
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("raw_ra", "raw_dec")})


def s(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "stars")


def a(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "archives")


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """A wavelength range for every instrument, made from the lengths of the names as the data has none."""
    pairs = D.instrument_counts(h(spark, d), a(spark, d))
    low, high = 300 + 10 * (F.length("instrument") % 7), 500 + 25 * (F.length("display_name") % 9)
    return pairs.select("display_name", "instrument", low.cast("double").alias("wave_min"), high.cast("double").alias("wave_max"))


HOLDINGS = "(SELECT * REPLACE (CASE WHEN NOT isnan(raw_ra) THEN raw_ra END AS raw_ra, CASE WHEN NOT isnan(raw_dec) THEN raw_dec END AS raw_dec) FROM spectroscopy_holdings)"
LABEL = "coalesce(trim(substr(list_filter(name_aliases, lambda x: x LIKE 'NAME %')[1], 6)), name_aliases[1], input_name, gaia_source_id::VARCHAR)"
KNOWN = "coalesce(name_aliases[1], input_name, gaia_source_id::VARCHAR)"
CATEGORY = "CASE WHEN match_status = 'matched' THEN match_method ELSE match_status END"
PERIOD = "year(obs_date)::INT AS yr, CASE WHEN month(obs_date) <= 6 THEN 1 ELSE 2 END AS half"
COUNTS = f"c AS (SELECT star_id, {PERIOD}, count(*) AS n FROM spectroscopy_holdings WHERE star_id IS NOT NULL AND obs_date IS NOT NULL GROUP BY ALL)"
PS = "ps AS (SELECT yr, half, row_number() OVER (ORDER BY yr, half) AS p FROM (SELECT DISTINCT yr, half FROM c))"
WITHIN = "w AS (SELECT star_id, yr, half, n FROM c QUALIFY row_number() OVER (PARTITION BY yr, half ORDER BY n DESC, star_id) <= 20)"
CUM = """g AS (SELECT star_id, p, yr, half, sum(coalesce(n, 0)) OVER (PARTITION BY star_id ORDER BY p)::BIGINT AS cum_n
    FROM (SELECT DISTINCT star_id FROM c) CROSS JOIN ps LEFT JOIN c USING (star_id, yr, half)),
  t AS (SELECT star_id, yr, half, cum_n FROM g WHERE cum_n > 0 QUALIFY row_number() OVER (PARTITION BY p ORDER BY cum_n DESC, star_id) <= 20)"""
DIVERSITY = f"""c AS (SELECT DISTINCT star_id, {PERIOD}, display_name || '::' || instrument AS k
      FROM spectroscopy_holdings JOIN archives USING (archive_code) WHERE star_id IS NOT NULL AND obs_date IS NOT NULL AND instrument IS NOT NULL), {PS},
    f AS (SELECT star_id, k, min(p) AS p FROM c JOIN ps USING (yr, half) GROUP BY ALL),
    wd AS (SELECT DISTINCT display_name || '::' || instrument AS k, log10((500 + 25*(len(display_name)%9))::DOUBLE / (300 + 10*(len(instrument)%7))::DOUBLE) AS lw
      FROM spectroscopy_holdings JOIN archives USING (archive_code) WHERE instrument IS NOT NULL
        AND 500 + 25*(len(display_name)%9) > 300 + 10*(len(instrument)%7)),
    dl AS (SELECT star_id, p, count(*) AS new_instruments, sum(coalesce(lw, 0::DOUBLE)) AS new_loglam FROM f LEFT JOIN wd USING (k) GROUP BY ALL)"""
SPREAD = "CASE WHEN count(vx) >= 2 THEN degrees(acos(least(1.0::DOUBLE, greatest(0.0::DOUBLE, sqrt(sum(vx)**2 + sum(vy)**2 + sum(vz)**2) / count(vx))))) END"


@query("g01_archive_status", f"""
  WITH k AS (SELECT archive_code, {CATEGORY} AS category, count(*) AS n FROM spectroscopy_holdings GROUP BY ALL),
    r AS (SELECT archive_code, min(obs_date) AS min_obs_date, max(obs_date) AS max_obs_date FROM spectroscopy_holdings GROUP BY ALL)
  SELECT archive_code, display_name, last_run_at, last_run_status, rows_seen_last_run, category, n, min_obs_date, max_obs_date
  FROM archives LEFT JOIN archive_sync_state USING (archive_code) LEFT JOIN k USING (archive_code) LEFT JOIN r USING (archive_code)""")
def g01(spark, d):
    return D.archive_status(h(spark, d), a(spark, d), load(spark, d, "archive_sync_state"))


@query("g02_instruments",
       "SELECT display_name, instrument, count(*) AS n FROM spectroscopy_holdings JOIN archives USING (archive_code) WHERE instrument IS NOT NULL GROUP BY ALL")
def g02(spark, d):
    return D.instrument_counts(h(spark, d), a(spark, d))


@query("g03_instrument_sky_sample", f"""
  WITH p AS (SELECT * FROM {HOLDINGS} WHERE instrument IS NOT NULL AND raw_ra IS NOT NULL AND raw_dec IS NOT NULL),
    t AS (SELECT instrument FROM p GROUP BY 1 ORDER BY count(*) DESC, instrument LIMIT 12)
  SELECT instrument, raw_ra, raw_dec FROM p SEMI JOIN t USING (instrument)
  QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY md5(id::VARCHAR), id) <= 2000""")
def g03(spark, d):
    return D.instrument_sky_sample(h(spark, d))


@query("g04_sky_sample", f"""SELECT gaia_source_id, ra, dec, phot_g_mean_mag, {KNOWN} AS known_as FROM stars
  WHERE ra IS NOT NULL AND dec IS NOT NULL AND phot_g_mean_mag IS NOT NULL ORDER BY md5(star_id::VARCHAR), star_id LIMIT 30000""")
def g04(spark, d):
    return D.sky_sample(s(spark, d))


@query("g05_star_name_index", r"""
  SELECT DISTINCT lower(regexp_replace(regexp_replace(trim(n), '^(NAME|\*)\s+', '', 'i'), '\s+', ' ', 'g')) AS normalized_name, gaia_source_id, bsc_hr_number
  FROM (SELECT gaia_source_id, bsc_hr_number, unnest(list_append(coalesce(name_aliases, []), input_name)) AS n FROM stars) WHERE trim(n) <> ''""")
def g05(spark, d):
    return D.star_name_index(s(spark, d))


@query("g06_leaderboard_counts", f"WITH {COUNTS} FROM c")
def g06(spark, d):
    return D.leaderboard_counts(h(spark, d))


@query("g07_top_period", f"WITH {COUNTS}, {WITHIN} FROM w")
def g07(spark, d):
    return D.top_period(D.leaderboard_counts(h(spark, d)))


@query("g08_top_cumulative", f"WITH {COUNTS}, {PS}, {CUM} FROM t")
def g08(spark, d):
    return D.top_cumulative(D.leaderboard_counts(h(spark, d)))


@query("g09_leaderboard", f"""WITH {COUNTS}, {PS}, {WITHIN}, {CUM}
  SELECT star_id, gaia_source_id, bsc_hr_number, {LABEL} AS label, yr, half, n AS within_n, cum_n AS cumulative_n
  FROM (SELECT star_id FROM w UNION SELECT star_id FROM t) CROSS JOIN (SELECT yr, half FROM ps) LEFT JOIN w USING (star_id, yr, half) LEFT
    JOIN t USING (star_id, yr, half) JOIN stars USING (star_id)""")
def g09(spark, d):
    return D.leaderboard(h(spark, d), s(spark, d))


@query("g10_diversity_counts", f"WITH {DIVERSITY} SELECT star_id, yr, half, k AS instrument_key FROM c")
def g10(spark, d):
    return D.diversity_counts(h(spark, d), a(spark, d))


@query("g11_diversity_deltas", f"WITH {DIVERSITY} SELECT star_id, p::INT AS p, new_instruments, round(new_loglam, 6) AS new_loglam FROM dl")
def g11(spark, d):
    out = D.diversity_deltas(D.diversity_counts(h(spark, d), a(spark, d)), D.log_widths(ranges(spark, d)))
    return out.withColumn("new_loglam", F.round("new_loglam", 6))


@query("g12_diversity", f"""WITH {DIVERSITY},
    cu AS (SELECT star_id, p, sum(new_instruments) OVER x::BIGINT AS c, sum(new_loglam) OVER x AS l FROM dl WINDOW x AS (PARTITION BY star_id ORDER BY p)),
    la AS (SELECT star_id, arg_max(c, p) AS c, round(arg_max(l, p), 9) AS l FROM cu GROUP BY 1),
    ca AS (SELECT * FROM (SELECT star_id FROM la ORDER BY c DESC, star_id LIMIT 20) UNION SELECT * FROM (SELECT star_id FROM la
      ORDER BY l DESC, star_id LIMIT 20))
  SELECT star_id, gaia_source_id, bsc_hr_number, {LABEL} AS label, yr, half,
    last_value(cu.c IGNORE NULLS) OVER x AS cum_instrument_count, round(last_value(cu.l IGNORE NULLS) OVER x, 6) AS cum_loglam_covered
  FROM ca CROSS JOIN ps LEFT JOIN cu USING (star_id, p) JOIN stars USING (star_id) WINDOW x AS (PARTITION BY star_id ORDER BY p)""")
def g12(spark, d):
    out = D.diversity(h(spark, d), a(spark, d), s(spark, d), D.log_widths(ranges(spark, d)))
    return out.withColumn("cum_loglam_covered", F.round("cum_loglam_covered", 6))


@query("g13_cmd_stars", f"""
 
    SELECT gaia_source_id, round((phot_bp_mean_mag - phot_rp_mean_mag)::DOUBLE, 4) AS bp_rp, round(phot_g_mean_mag + 5 * log10(parallax::DOUBLE) - 10, 4) AS abs_g_mag, {LABEL} AS label
  FROM stars JOIN (SELECT star_id, count(*) AS n FROM spectroscopy_holdings GROUP BY 1) USING (star_id)
  WHERE phot_bp_mean_mag IS NOT NULL AND phot_rp_mean_mag IS NOT NULL AND phot_g_mean_mag IS NOT NULL AND parallax > 0 ORDER BY n DESC, star_id LIMIT 30000""")
def g13(spark, d):
    out = D.cmd_stars(h(spark, d), s(spark, d))
    return out.withColumns({"bp_rp": F.round(F.col("bp_rp").cast("double"), 4), "abs_g_mag": F.round("abs_g_mag", 4)})


@query("g14_totals", """SELECT (SELECT count(*)
    FROM stars) AS total_stars, count(*) AS total_holdings, count(*) FILTER (WHERE match_status = 'needs_review') AS needs_review_total
    FROM spectroscopy_holdings""")
def g14(spark, d):
    rows = h(spark, d).agg(F.count(F.lit(1)).alias("total_holdings"), F.count(F.when(F.col("match_status") == "needs_review", 1)).alias("needs_review_total"))
    return s(spark, d).agg(F.count(F.lit(1)).alias("total_stars")).crossJoin(rows)


MOST = f"""SELECT gaia_source_id, bsc_hr_number, {LABEL} AS known_as, n FROM stars JOIN
  (SELECT star_id, count(*) AS n FROM spectroscopy_holdings WHERE {{w}} GROUP BY 1) USING (star_id) ORDER BY n DESC, star_id LIMIT 20"""


@query("g15_most_observed", MOST.format(w="true"))
def g15(spark, d):
    return D.most_observed(h(spark, d), s(spark, d))


@query("g15_trending", MOST.format(w=f"obs_date >= DATE '{TODAY}' - INTERVAL 5 YEAR"))
def g15b(spark, d):
    return D.most_observed(h(spark, d), s(spark, d), since=F.add_months(F.lit(TODAY), -60))


@query("g16_by_archive", "SELECT display_name, count(*) AS n FROM spectroscopy_holdings JOIN archives USING (archive_code) GROUP BY 1")
def g16(spark, d):
    return D.counts_by_archive(h(spark, d), a(spark, d))


@query("g16_by_method", "SELECT match_method, count(*) AS n FROM spectroscopy_holdings WHERE match_status = 'matched' GROUP BY 1")
def g16b(spark, d):
    return h(spark, d).filter("match_status = 'matched'").groupBy("match_method").agg(F.count(F.lit(1)).alias("n"))


@query("g17_nearest",
       f"SELECT gaia_source_id, bsc_hr_number, {LABEL} AS known_as, 1000.0::DOUBLE / parallax::DOUBLE AS distance_pc FROM stars WHERE parallax > 0 ORDER BY parallax DESC, star_id LIMIT 20")
def g17(spark, d):
    return D.nearest(s(spark, d))


@query("g17_fastest", f"""SELECT gaia_source_id, bsc_hr_number, {LABEL} AS known_as, round(sqrt(pmra*pmra + pmdec*pmdec), 6) AS total_pm FROM stars
  WHERE pmra IS NOT NULL AND pmdec IS NOT NULL ORDER BY sqrt(pmra*pmra + pmdec*pmdec) DESC, star_id LIMIT 20""")
def g17b(spark, d):
    return D.fastest(s(spark, d)).withColumn("total_pm", F.round("total_pm", 6))


@query("g17_spectral_types", """SELECT CASE WHEN c < 0 THEN 'O/B (hot)' WHEN c < 0.3::DOUBLE THEN 'A' WHEN c < 0.6::DOUBLE THEN 'F'
    WHEN c < 0.9::DOUBLE THEN 'G' WHEN c < 1.5::DOUBLE THEN 'K' ELSE 'M (cool)' END AS bucket, count(*) AS n
  FROM (SELECT (phot_bp_mean_mag - phot_rp_mean_mag)::DOUBLE AS c FROM stars WHERE phot_bp_mean_mag IS NOT NULL AND phot_rp_mean_mag IS NOT NULL) GROUP BY 1""")
def g17c(spark, d):
    return D.spectral_types(s(spark, d))


LATEST = """SELECT display_name, raw_target_name, raw_ra, raw_dec, obs_date, {x} reduction_status
  FROM (SELECT * FROM {h} WHERE match_status = '{v}' ORDER BY updated_at DESC, id DESC LIMIT 20) JOIN archives USING (archive_code)"""


@query("g18_needs_review", LATEST.format(v="needs_review", x="theta_arcsec,", h=HOLDINGS))
def g18(spark, d):
    return D.latest_with_status(h(spark, d), a(spark, d), "needs_review")


@query("g18_skipped", LATEST.format(v="skipped", x="", h=HOLDINGS))
def g18b(spark, d):
    return D.latest_with_status(h(spark, d), a(spark, d), "skipped")


@query("g18_skipped_by_archive",
       "SELECT archive_code, display_name, count(*) AS n FROM spectroscopy_holdings JOIN archives USING (archive_code) WHERE match_status = 'skipped' GROUP BY ALL")
def g18c(spark, d):
    per = h(spark, d).filter("match_status = 'skipped'").groupBy("archive_code").agg(F.count(F.lit(1)).alias("n"))
    return per.join(a(spark, d).select("archive_code", "display_name"), "archive_code")


@query("g19_triage_queue", f"""
  WITH r AS (SELECT *, coalesce(nullif(trim(raw_target_name), ''), 'obs:' || archive_obs_id) AS group_key,
      row_number() OVER (PARTITION BY archive_code, coalesce(nullif(trim(raw_target_name), ''), 'obs:' || archive_obs_id)
        ORDER BY updated_at DESC, id DESC) AS rn,
      cos(radians(raw_dec))*cos(radians(raw_ra)) AS vx, cos(radians(raw_dec))*sin(radians(raw_ra)) AS vy, sin(radians(raw_dec)) AS vz
    FROM {HOLDINGS} WHERE match_status = 'skipped'),
  q AS (SELECT archive_code, group_key, max(nullif(trim(raw_target_name), '')) AS raw_target_name, count(*) AS n_records,
      list(archive_obs_id ORDER BY rn) FILTER (WHERE rn <= 50) AS ids, list(archive_url ORDER BY rn) FILTER (WHERE rn <= 50) AS urls,
      max(raw_ra) FILTER (WHERE rn = 1) AS raw_ra, max(raw_dec) FILTER (WHERE rn = 1) AS raw_dec, round({SPREAD}, 4) AS position_spread_deg,
      max(updated_at) AS updated_at, min(obs_date) AS obs_date, min(instrument) AS instrument FROM r GROUP BY 1, 2)
 
    SELECT archive_code, display_name, group_key, raw_target_name, n_records, array_to_string(ids, ',') AS archive_obs_ids, array_to_string(urls, ',') AS archive_urls,
    raw_ra, raw_dec, position_spread_deg, updated_at, obs_date, instrument
  FROM (SELECT * FROM q ORDER BY (raw_target_name IS NOT NULL) DESC, n_records DESC, archive_code, group_key LIMIT 2000) JOIN archives USING (archive_code)""")
def g19(spark, d):
    q = D.triage_queue(h(spark, d), a(spark, d))
    return q.withColumns({"archive_obs_ids": F.array_join("archive_obs_ids", ","), "archive_urls": F.array_join("archive_urls", ","), "position_spread_deg": F.round("position_spread_deg", 4)})


@query("g20_access_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def g20(spark, d):
    events, edge = load(spark, d, "events"), F.lit("2024-01-15").cast("timestamp")
    old = events.filter(F.col("ts") < edge).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return D.merge_counts(old, events.filter(F.col("ts") >= edge), "event_type")


SETS = "p AS (SELECT star_id, array_agg(DISTINCT {c}) AS m FROM spectroscopy_holdings WHERE match_status = 'matched' AND star_id IS NOT NULL {w} GROUP BY 1)"
BEST = "b AS (SELECT instrument FROM spectroscopy_holdings WHERE match_status = 'matched' AND instrument IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, instrument LIMIT 20)"
IN_BEST = "AND instrument IN (FROM b)"
UN = "(SELECT unnest(m) AS {k}a, m AS m FROM p)"


@query("g21_archive_overlap", f"""WITH {SETS.format(c='archive_code', w='')}, x AS (SELECT unnest(m) AS a, m FROM p), y AS (SELECT a, unnest(m) AS b FROM x)
  SELECT a AS archive_a, b AS archive_b, any_value(u.display_name) AS display_a, any_value(v.display_name) AS display_b, count(*) AS n_overlap
  FROM y JOIN archives u ON a = u.archive_code JOIN archives v ON b = v.archive_code WHERE a <= b GROUP BY 1, 2""")
def g21(spark, d):
    return D.archive_overlap(h(spark, d), a(spark, d))


TRIPLE = "x AS (SELECT unnest(m) AS a, m FROM p), y AS (SELECT a, unnest(m) AS b, m FROM x), z AS (SELECT a, b, unnest(m) AS c FROM y WHERE a <= b)"


@query("g21_archive_overlap_triple",
       f"WITH {SETS.format(c='archive_code', w='')}, {TRIPLE} SELECT a AS archive_a, b AS archive_b, c AS archive_c, count(*) AS n_overlap FROM z WHERE b <= c GROUP BY ALL")
def g21b(spark, d):
    return D.archive_overlap(h(spark, d), a(spark, d), 3)


@query("g22_instrument_overlap",
       f"WITH {BEST}, {SETS.format(c='instrument', w=IN_BEST)}, {TRIPLE} SELECT a AS instrument_a, b AS instrument_b, count(*) AS n_overlap FROM y WHERE a <= b GROUP BY ALL")
def g22(spark, d):
    return D.instrument_overlap(h(spark, d))


@query("g22_instrument_overlap_triple",
       f"WITH {BEST}, {SETS.format(c='instrument', w=IN_BEST)}, {TRIPLE} SELECT a AS instrument_a, b AS instrument_b, c AS instrument_c, count(*) AS n_overlap FROM z WHERE b <= c GROUP BY ALL")
def g22b(spark, d):
    return D.instrument_overlap(h(spark, d), 3)


@query("g23_by_position",
       f"SELECT id, star_id, archive_code, instrument, obs_date, match_status, raw_target_name, raw_ra, raw_dec FROM {HOLDINGS} WHERE raw_ra IS NOT NULL AND raw_dec IS NOT NULL")
def g23(spark, d):
    return D.by_position(h(spark, d))


@query("g27_overlap_totals",
       f"WITH {SETS.format(c='archive_code', w='')}, x AS (SELECT unnest(m) AS a FROM p) SELECT a AS archive_code, count(*) AS n_stars FROM x GROUP BY 1")
def g27(spark, d):
    return D.archive_overlap(h(spark, d), a(spark, d)).filter("archive_a = archive_b").select(F.col("archive_a").alias("archive_code"), F.col("n_overlap").alias("n_stars"))


@query("g28_treemap", """WITH i AS (SELECT display_name, instrument, count(*) AS n FROM spectroscopy_holdings JOIN archives USING (archive_code)
    WHERE instrument IS NOT NULL GROUP BY ALL)
  SELECT display_name, instrument, n, round(log10(n + 1) * log10(sum(n) OVER w + 1) / sum(log10(n + 1)) OVER w, 6) AS weight
    FROM i WINDOW w AS (PARTITION BY display_name)""")
def g28(spark, d):
    return D.treemap(D.instrument_counts(h(spark, d), a(spark, d))).withColumn("weight", F.round("weight", 6))


CATEGORIES = ["direct_gaia_column", "name_resolved", "positional_easy_match", "needs_review", "skipped", "rejected"]


@query("g29_status_pivot", f"""WITH k AS (SELECT archive_code, {CATEGORY} AS category FROM spectroscopy_holdings)
  SELECT archive_code, display_name, {', '.join(f"count(*) FILTER (WHERE category = '{c}') AS {c}" for c in CATEGORIES)}, count(category) AS total
  FROM archives LEFT JOIN k USING (archive_code) GROUP BY ALL""")
def g29(spark, d):
    return D.status_pivot(g01(spark, d), CATEGORIES)


@query("g30_voters", "SELECT archive_code, archive_obs_id, count(DISTINCT lower(trim(submitter))) AS n_voters FROM skip_classifications GROUP BY ALL")
def g30(spark, d):
    return D.voters(load(spark, d, "skip_classifications"))


@query("g31_best_product", """SELECT archive_code, archive_obs_id, arg_min(id, (CASE reduction_status WHEN 'reduced' THEN 0 WHEN 'raw' THEN 1
    ELSE 2 END) * 1000000000000 + id) AS id
  FROM spectroscopy_holdings GROUP BY ALL""")
def g31(spark, d):
    rank = F.when(F.col("reduction_status") == "reduced", 0).when(F.col("reduction_status") == "raw", 1).otherwise(2)
    return h(spark, d).groupBy("archive_code", "archive_obs_id").agg(F.min_by("id", F.struct(rank, "id")).alias("id"))


@query("g32_date_ordinals", """SELECT id, star_id, archive_code, obs_date, CASE
    WHEN count(*) OVER w > 1 THEN row_number() OVER (PARTITION BY star_id, archive_code, obs_date ORDER BY id) END::INT AS ordinal
  FROM spectroscopy_holdings WHERE star_id IS NOT NULL AND obs_date IS NOT NULL WINDOW w AS (PARTITION BY star_id, archive_code, obs_date)""")
def g32(spark, d):
    return D.date_ordinals(h(spark, d))
