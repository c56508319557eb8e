"""Queries of single functions, predicates, sets, orders and row idioms, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import geo, names, text
from skyloom.operators import derive as D
from skyloom.operators import serve as V
from skyloom.operators import spectra as P
from skyloom.operators.match import match_radius
from skyloom.plans.derived import HOLDINGS, KNOWN, LABEL, a, h, ranges, s
from skyloom.plans.matching import YEAR, key_sql, moved, sep, vec
from skyloom.session import load

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def simple(name: str, table, columns, sql: str | None, where: str | None = None) -> None:
    """A query that selects the expressions that columns() gives by name from one table."""

    def f(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d)
        return (df.filter(where) if where else df).select(*[c.alias(n) for n, c in columns().items()])

    query(name, sql)(f)


def t(name: str):
    return lambda spark, d: load(spark, d, name)


C = F.col
SKEY = r"lower(regexp_replace(regexp_replace(trim({x}), '^(NAME|\*)\s+', '', 'i'), '\s+', ' ', 'g'))"

# names and labels
simple("f01_match_key", h, lambda: {"id": C("id"), "k": names.match_key(C("raw_target_name"))},
       f"SELECT id, {key_sql('raw_target_name')} AS k FROM spectroscopy_holdings")
simple("f02_search_key", h, lambda: {"id": C("id"), "k": names.search_key(C("raw_target_name"))},
       f"SELECT id, {SKEY.format(x='raw_target_name')} AS k FROM spectroscopy_holdings")
simple("f03_common_name", s, lambda: {"star_id": C("star_id"), "label": D.label()}, f"SELECT star_id, {LABEL} AS label FROM stars")
simple("f04_known_as", s, lambda: {"star_id": C("star_id"), "label": names.known_as(C("name_aliases"), C("input_name"), C("gaia_source_id"))},
       f"SELECT star_id, {KNOWN} AS label FROM stars")
simple("f05_julian_year", h, lambda: {"id": C("id"), "y": F.round(geo.julian_year(C("obs_date")), 8)},
       f"SELECT id, round({YEAR}, 8) AS y FROM spectroscopy_holdings")
simple("f06_cosine_separation", s, lambda: {"star_id": C("star_id"), "x": F.round(geo.cosine_separation_deg(C("ra"), C("dec"), F.lit(157.8), F.lit(30.4)), 5)},
       "SELECT star_id, round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sin(radians(dec))*sin(radians(30.4::DOUBLE)) + cos(radians(dec))*cos(radians(30.4::DOUBLE))*cos(radians(ra - 157.8::DOUBLE)))))), 5) AS x FROM stars")
simple("f07_separation", s, lambda: {"star_id": C("star_id"), "x": F.round(geo.separation(C("ra"), C("dec"), F.lit(157.8), F.lit(30.4)), 4)},
       f"SELECT star_id, round({sep(vec('ra', 'dec'), vec('157.8::DOUBLE', '30.4::DOUBLE'))}, 4) AS x FROM stars")
simple("f08_propagated", s, lambda: {"star_id": C("star_id"), **{n: F.round(x, 9) for n, x in zip("xyz", geo.moved_vector(C("ra"), C("dec"), C("pmra"), C("pmdec"), 1985.5 - C("ref_epoch")))}},
       "SELECT star_id, " + ", ".join(f"round({x}, 9) AS {n}" for n, x in zip("xyz", moved("", "(1985.5::DOUBLE - ref_epoch)"))) + " FROM stars")
simple("f09_match_radius", h, lambda: {"id": C("id"), "r": match_radius(C("archive_code"), C("instrument"))},
       "SELECT id, CASE WHEN archive_code = 'noirlab' AND instrument = 'chiron' THEN 60 WHEN archive_code = 'eso' AND instrument = 'FEROS' THEN 100 ELSE 1 END::DOUBLE AS r FROM spectroscopy_holdings")
simple("f10_search_radius", h, lambda: {"id": C("id"), "r": F.round(match_radius(C("archive_code"), C("instrument")) + 10.3 * F.abs(geo.julian_year(C("obs_date")) - 2016.0), 6)},
       f"SELECT id, round(1 + 10.3::DOUBLE*abs({YEAR} - 2016), 6) AS r FROM spectroscopy_holdings")
BITS = " + ".join(f"((({{x}} >> {i}) & 1) << {2 * i})" for i in range(7))
F12 = f"""WITH a AS (SELECT star_id, sin(radians(dec)) AS z, (ra - 360*floor(ra/360))/90 AS t FROM stars),
  b AS (SELECT star_id, abs(z) <= 2.0::DOUBLE/3 AS belt, z >= 0 AS north, floor(128*(0.5::DOUBLE + t) - 96*z)::BIGINT AS jp, floor(128*(0.5::DOUBLE + t) + 96*z)::BIGINT AS jm,
      least(floor(t), 3)::BIGINT AS q, t - least(floor(t), 3) AS tp, 128*sqrt(3*(1 - abs(z))) AS w FROM a),
  c AS (SELECT *, least(floor(tp*w), 127)::BIGINT AS cp, least(floor((1 - tp)*w), 127)::BIGINT AS cm FROM b),
  d AS (SELECT star_id, CASE WHEN belt THEN CASE WHEN jp // 128 = jm // 128 THEN jp // 128 % 4 + 4 WHEN jp // 128 < jm // 128 THEN jp // 128
    ELSE jm // 128 + 8 END WHEN north THEN q ELSE q + 8 END AS face,
      CASE WHEN belt THEN jm % 128 WHEN north THEN 127 - cm ELSE cp END AS x, CASE WHEN belt THEN 127 - jp % 128 WHEN north THEN 127 - cp
        ELSE cm END AS y FROM c)
  SELECT star_id, face*16384 + {BITS.format(x='x')} + 2*({BITS.format(x='y')}) AS pix FROM d"""
simple("f12_healpix", s, lambda: {"star_id": C("star_id"), "pix": geo.healpix(C("ra"), C("dec"), 7)}, F12)
simple("f13_source_id_range", s, lambda: {"star_id": C("star_id"), "first": geo.source_id_range(F.pmod(C("star_id"), F.lit(196608)), 7)["first"], "last": geo.source_id_range(F.pmod(C("star_id"), F.lit(196608)), 7)["last"]},
       "SELECT star_id, (star_id % 196608) << 45 AS first, ((star_id % 196608 + 1) << 45) - 1 AS last FROM stars")
simple("f15_aitoff", s, lambda: {"star_id": C("star_id"), "x": F.round(geo.aitoff(C("ra"), C("dec"))["x"], 7), "y": F.round(geo.aitoff(C("ra"), C("dec"))["y"], 7)}, """
  SELECT star_id, round(2*cos(d)*sin(l/2)/k, 7) AS x, round(sin(d)/k, 7) AS y FROM (SELECT *, CASE WHEN acos(cos(d)*cos(l/2)) = 0 THEN 1
    ELSE sin(acos(cos(d)*cos(l/2)))/acos(cos(d)*cos(l/2)) END AS k
    FROM (SELECT star_id, radians(dec) AS d, radians(CASE WHEN ra > 180 THEN 360 - ra ELSE -ra END) AS l FROM stars))""")
simple("f17_star_numbers", s, lambda: {"star_id": C("star_id"), "distance_pc": F.round(F.when(C("parallax") > 0, 1000.0 / C("parallax").cast("double")), 5), "total_pm": F.round(F.hypot("pmra", "pmdec"), 5)},
       "SELECT star_id, round(CASE WHEN parallax > 0 THEN 1000/parallax::DOUBLE END, 5) AS distance_pc, round(sqrt(pmra*pmra + pmdec*pmdec), 5) AS total_pm FROM stars")
simple("f18_log_width", ranges, lambda: {"display_name": C("display_name"), "instrument": C("instrument"), "w": F.round(F.when(C("wave_max") > C("wave_min"), F.log10(C("wave_max") / C("wave_min"))), 8)}, """
  SELECT DISTINCT display_name, instrument, round(CASE
    WHEN 500 + 25*(len(display_name)%9) > 300 + 10*(len(instrument)%7) THEN log10((500 + 25*(len(display_name)%9))::DOUBLE/(300 + 10*(len(instrument)%7))) END, 8) AS w
  FROM spectroscopy_holdings JOIN archives USING (archive_code) WHERE instrument IS NOT NULL""")
simple("f19_numbers_range", h, lambda: {"id": C("id"), "low": text.numbers_range(C("archive_obs_id"))["low"], "high": text.numbers_range(C("archive_obs_id"))["high"]}, r"""
  SELECT id, list_min(n) AS low, list_max(n) AS high
    FROM (SELECT id, list_transform(regexp_extract_all(archive_obs_id, '(\d+(?:\.\d+)?)', 1), lambda x: x::DOUBLE) AS n
    FROM spectroscopy_holdings)""")
simple("f22_digits", h, lambda: {"id": C("id"), "n": F.when(C("archive_obs_id").rlike("^[0-9]+$"), C("archive_obs_id").try_cast("bigint"))},
       "SELECT id, CASE WHEN regexp_full_match(archive_obs_id, '[0-9]+') THEN try_cast(archive_obs_id AS BIGINT) END AS n FROM spectroscopy_holdings")
simple("f24_list_join", s, lambda: {"star_id": C("star_id"), "names": F.array_join("name_aliases", "; ")},
       "SELECT star_id, array_to_string(name_aliases, '; ') AS names FROM stars")
simple("f25_group_key", h, lambda: {"id": C("id"), "k": names.group_key(C("raw_target_name"), C("archive_obs_id"))},
       "SELECT id, coalesce(nullif(trim(raw_target_name), ''), 'obs:' || archive_obs_id) AS k FROM spectroscopy_holdings")
simple("f26_json_get", t("archive_sync_state"), lambda: {"archive_code": C("archive_code"), "last_id": F.get_json_object("sync_cursor", "$.last_id").try_cast("bigint"), "t": F.get_json_object("sync_cursor", "$.last_t_min").try_cast("double")},
       "SELECT archive_code, try_cast(json_extract_string(sync_cursor, '$.last_id') AS BIGINT) AS last_id, try_cast(json_extract_string(sync_cursor, '$.last_t_min') AS DOUBLE) AS t FROM archive_sync_state")
simple("f27_url_encode", h, lambda: {"id": C("id"), "u": F.concat(F.lit("https://x.example/?q="), F.url_encode("raw_target_name"))},
       "SELECT id, 'https://x.example/?q=' || replace(replace(replace(url_encode(raw_target_name), '%20', '+'), '%2A', '*'), '~', '%7E') AS u FROM spectroscopy_holdings")
simple("f28_display_size", s, lambda: {"star_id": C("star_id"), "size": geo.clamp(12 - C("phot_g_mean_mag").cast("double"), 1.5, 10.0)},
       "SELECT star_id, CASE WHEN phot_g_mean_mag IS NOT NULL THEN greatest(1.5::DOUBLE, least(10::DOUBLE, 12 - phot_g_mean_mag::DOUBLE)) END AS size FROM stars")
simple("f29_truncate_seconds", t("events"), lambda: {"event_id": C("event_id"), "ts": F.date_trunc("second", C("ts").cast("timestamp"))},
       "SELECT event_id, date_trunc('second', ts) AS ts FROM events")
simple("f30_product_priority", h, lambda: {"id": C("id"), "stamp": F.regexp_extract("archive_obs_id", r"(\d{4}-\d{2}-\d{2})", 1), "rank": F.when(C("archive_url").contains("get?"), 0).when(C("archive_url").contains("obs?"), 1).otherwise(2)},
       r"SELECT id, regexp_extract(archive_obs_id, '(\d{4}-\d{2}-\d{2})', 1) AS stamp, CASE WHEN contains(archive_url, 'get?') THEN 0 WHEN contains(archive_url, 'obs?') THEN 1 ELSE 2 END AS rank FROM spectroscopy_holdings")

# arrays: the embeddings serve as fluxes over a made-up wavelength grid
def flux():
    return F.transform("embedding", lambda x: x.cast("double"))


def wave():
    return F.transform("embedding", lambda x, i: F.lit(5000.0) + i)


simple("f31_jansky_flux", t("embeddings"), lambda: {"vec_id": C("vec_id"), "total": F.round(F.aggregate(P.jansky_flux(flux(), wave()), F.lit(0.0), lambda acc, x: acc + x) * 1e12, 6)},
       "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE*1e-23*2.99792458e18/((4999.0::DOUBLE + i)*(4999.0::DOUBLE + i))))*1e12, 6) AS total FROM embeddings")
simple("f32_display_scale", t("embeddings"), lambda: {"vec_id": C("vec_id"), "scale": F.round(P.display_scale(flux()), 6)},
       "SELECT vec_id, round(list_sort(list_transform(list_filter(embedding, lambda x: x <> 0), lambda x: abs(x::DOUBLE)))[len(list_filter(embedding, lambda x: x <> 0))//2 + 1], 6) AS scale FROM embeddings")
simple("f33_finite_points", t("embeddings"), lambda: {"vec_id": C("vec_id"), "n": F.size(P.finite(wave(), F.transform(flux(), lambda x: F.when(x > 0, x))))},
       "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::INT AS n FROM embeddings")
simple("t09_downsample", t("embeddings"), lambda: {"vec_id": C("vec_id"), "n": F.size(P.downsample(C("embedding"), 10)), "total": F.round(F.aggregate(P.downsample(flux(), 10), F.lit(0.0), lambda acc, x: acc + x), 5)}, """
  SELECT vec_id, len(k)::INT AS n, round(list_sum(k), 5) AS total
    FROM (SELECT vec_id, list_transform(list_filter(embedding, lambda x, i: (i - 1) % greatest(1, ceil(len(embedding)/10.0)::INT) = 0), lambda x: x::DOUBLE) AS k
    FROM embeddings)""")

# predicates
simple("pred01_equal", s, lambda: {"star_id": C("star_id")}, "SELECT star_id FROM stars WHERE star_id = 42", "star_id = 42")
simple("pred02_in_list", s, lambda: {"star_id": C("star_id")}, "SELECT star_id FROM stars WHERE star_id IN (3, 5, 8, 13)", "star_id IN (3, 5, 8, 13)")
simple("pred03_between", s, lambda: {"star_id": C("star_id")}, "SELECT star_id FROM stars WHERE dec BETWEEN -5 AND 5", "dec BETWEEN -5 AND 5")
simple("pred04_not_blank", h, lambda: {"id": C("id")},
       "SELECT id FROM spectroscopy_holdings WHERE raw_target_name IS NOT NULL AND trim(raw_target_name) <> ''", "raw_target_name IS NOT NULL AND trim(raw_target_name) <> ''")
simple("pred05_like", h, lambda: {"id": C("id")},
       "SELECT id FROM spectroscopy_holdings WHERE archive_obs_id LIKE 'NOR.%' AND reduction_status NOT IN ('raw') AND match_status <> 'skipped'", "archive_obs_id LIKE 'NOR.%' AND reduction_status NOT IN ('raw') AND match_status <> 'skipped'")
simple("pred06_range_overlap", ranges, lambda: {"display_name": C("display_name"), "instrument": C("instrument"), "meets": V.overlaps(C("wave_min"), C("wave_max"), 340.0, None)}, """
  SELECT DISTINCT display_name, instrument, 500 + 25*(len(display_name)%9) >= 340 AS meets FROM spectroscopy_holdings
    JOIN archives USING (archive_code) WHERE instrument IS NOT NULL""")
simple("pred08_no_position", h, lambda: {"id": C("id")},
       "SELECT id FROM spectroscopy_holdings WHERE (raw_ra IS NOT NULL AND raw_dec IS NOT NULL AND obs_date IS NOT NULL AND raw_dec BETWEEN -90 AND 90) IS NOT TRUE", "NOT coalesce(raw_ra IS NOT NULL AND raw_dec IS NOT NULL AND obs_date IS NOT NULL AND raw_dec BETWEEN -90 AND 90, false)")
simple("pred10_category", h, lambda: {"id": C("id"), "category": D.category()},
       "SELECT id, CASE WHEN match_status = 'matched' THEN match_method ELSE match_status END AS category FROM spectroscopy_holdings")
simple("pred11_half_year", lambda spark, d: D.dated(h(spark, d)), lambda: {"id": C("id"), "yr": C("yr"), "half": C("half")},
       "SELECT id, year(obs_date)::INT AS yr, CASE WHEN month(obs_date) <= 6 THEN 1 ELSE 2 END AS half FROM spectroscopy_holdings")
simple("pred12_recent", h, lambda: {"id": C("id")},
       "SELECT id FROM spectroscopy_holdings WHERE obs_date >= DATE '2019-06-30'", "obs_date >= add_months(DATE '2024-06-30', -60)")


@query("pred07_filters", """WITH r AS (SELECT DISTINCT archive_code, instrument FROM spectroscopy_holdings JOIN archives USING (archive_code)
    WHERE 300 + 10*(len(instrument)%7) <= 330 AND 500 + 25*(len(display_name)%9) >= 320)
  SELECT id FROM spectroscopy_holdings SEMI JOIN r USING (archive_code, instrument) WHERE reduction_status = 'raw'""")
def p07(spark, d):
    rows = h(spark, d).join(a(spark, d).select("archive_code", "display_name"), "archive_code")
    return V.filter_holdings(rows, ranges(spark, d), reduction="raw", wave=(320.0, 330.0)).select("id")


@query("pred09_case_buckets", """SELECT star_id, CASE WHEN c < 0 THEN 'O/B (hot)' WHEN c < 0.3::DOUBLE THEN 'A' WHEN c < 0.6::DOUBLE THEN 'F'
    WHEN c < 0.9::DOUBLE THEN 'G' WHEN c < 1.5::DOUBLE THEN 'K' ELSE 'M (cool)' END AS k
    FROM (SELECT star_id, (phot_bp_mean_mag - phot_rp_mean_mag)::DOUBLE AS c FROM stars)""")
def p09(spark, d):
    return s(spark, d).select("star_id", D.spectral_class((C("phot_bp_mean_mag") - C("phot_rp_mean_mag")).cast("double")).alias("k"))


@query("pred13_having", "SELECT instrument, count(*) AS n FROM spectroscopy_holdings WHERE instrument IS NOT NULL GROUP BY 1")
def p13(spark, d):
    return V.option_counts(h(spark, d), "instrument")


# joins
@query("j01_dimension_join", "SELECT id, display_name FROM spectroscopy_holdings JOIN archives USING (archive_code)")
def j01(spark, d):
    return h(spark, d).join(a(spark, d), "archive_code").select("id", "display_name")


@query("j02_star_join", "SELECT id, gaia_source_id FROM spectroscopy_holdings JOIN stars USING (star_id)")
def j02(spark, d):
    return h(spark, d).select("id", "star_id").join(s(spark, d).select("star_id", "gaia_source_id"), "star_id").select("id", "gaia_source_id")


@query("j03_left_chain",
       "SELECT archive_code, last_run_status, n FROM archives LEFT JOIN archive_sync_state USING (archive_code) LEFT JOIN (SELECT archive_code, count(*) AS n FROM spectroscopy_holdings WHERE match_status = 'rejected' GROUP BY 1) USING (archive_code)")
def j03(spark, d):
    n = h(spark, d).filter("match_status = 'rejected'").groupBy("archive_code").agg(F.count(F.lit(1)).alias("n"))
    return a(spark, d).join(load(spark, d, "archive_sync_state"), "archive_code", "left").join(n, "archive_code", "left").select("archive_code", "last_run_status", "n")


@query("j05_small_cross", "SELECT a.archive_code, f.field_id FROM archives a CROSS JOIN sky_fields f")
def j05(spark, d):
    return a(spark, d).select("archive_code").crossJoin(F.broadcast(load(spark, d, "sky_fields").select("field_id")))


@query("j07_semi_join",
       "SELECT id FROM spectroscopy_holdings WHERE archive_code IN (SELECT archive_code FROM spectroscopy_holdings GROUP BY 1 ORDER BY count(*) DESC, archive_code LIMIT 3)")
def j07(spark, d):
    top = h(spark, d).groupBy("archive_code").count().orderBy(F.desc("count"), "archive_code").limit(3)
    return h(spark, d).join(F.broadcast(top.select("archive_code")), "archive_code", "left_semi").select("id")


@query("j10_id_join", "SELECT v.id, star_id FROM skip_classifications v LEFT JOIN stars ON gaia_source_id = proposed_gaia_source_id")
def j10(spark, d):
    ids = s(spark, d).filter("gaia_source_id IS NOT NULL").select(C("gaia_source_id").alias("proposed_gaia_source_id"), "star_id")
    return load(spark, d, "skip_classifications").join(ids, "proposed_gaia_source_id", "left").select("id", "star_id")


@query("j19_dictionary_join",
       "SELECT DISTINCT h.archive_code, h.instrument, coalesce(w, 0) AS w FROM spectroscopy_holdings h LEFT JOIN (SELECT DISTINCT instrument, len(instrument) AS w FROM spectroscopy_holdings WHERE instrument LIKE '%ECH') USING (instrument)")
def j19(spark, d):
    pairs = h(spark, d).select("archive_code", "instrument").distinct()
    dims = pairs.filter("instrument LIKE '%ECH'").select("instrument", F.length("instrument").cast("bigint").alias("w")).distinct()
    return pairs.join(dims, "instrument", "left").select("archive_code", "instrument", F.coalesce("w", F.lit(0)).alias("w"))


@query("j22_aligned_zip",
       "SELECT a.star_id, b.star_id AS next_id FROM (SELECT star_id, row_number() OVER (ORDER BY star_id) AS i FROM stars) a JOIN (SELECT star_id, row_number() OVER (ORDER BY star_id) - 1 AS i FROM stars) b USING (i)")
def j22(spark, d):
    from skyloom.operators.chunked_keys import number_rows

    one = number_rows(s(spark, d).select("star_id").withColumn("k", F.lit(0)), ["k"], [C("star_id")]).select("star_id", C("_number").alias("i"))
    return one.join(one.select(C("star_id").alias("next_id"), (C("i") - 1).alias("i")), "i").select("star_id", "next_id")


# windows, order, sets
@query("w02_period_numbers",
       "SELECT yr, half, row_number() OVER (ORDER BY yr, half)::INT AS p FROM (SELECT DISTINCT year(obs_date)::INT AS yr, CASE WHEN month(obs_date) <= 6 THEN 1 ELSE 2 END AS half FROM spectroscopy_holdings WHERE star_id IS NOT NULL AND obs_date IS NOT NULL)")
def w02(spark, d):
    return D.periods_of(D.leaderboard_counts(h(spark, d)))


W03 = "WITH c AS (SELECT star_id, year(obs_date)::INT AS yr, count(*) AS n FROM spectroscopy_holdings WHERE star_id IS NOT NULL AND obs_date IS NOT NULL GROUP BY ALL) "


def yearly(spark, d):
    return h(spark, d).filter("star_id IS NOT NULL AND obs_date IS NOT NULL").groupBy("star_id", F.year("obs_date").alias("yr")).agg(F.count(F.lit(1)).alias("n"))


@query("w03_running_sum", W03 + "SELECT star_id, yr, (sum(n) OVER (PARTITION BY star_id ORDER BY yr))::BIGINT AS total FROM c")
def w03(spark, d):
    return yearly(spark, d).select("star_id", "yr", F.sum("n").over(Window.partitionBy("star_id").orderBy("yr").rowsBetween(Window.unboundedPreceding, 0)).alias("total"))


@query("w04_last_row", W03 + "SELECT star_id, yr, n FROM c QUALIFY row_number() OVER (PARTITION BY star_id ORDER BY yr DESC) = 1")
def w04(spark, d):
    return yearly(spark, d).groupBy("star_id").agg(F.max("yr").alias("yr"), F.max_by("n", "yr").alias("n"))


@query("w05_forward_fill", W03 + ", g AS (SELECT star_id, y AS yr FROM (SELECT star_id FROM c GROUP BY 1 ORDER BY sum(n) DESC, star_id LIMIT 10) CROSS JOIN range(2000, 2026) r(y)) SELECT star_id, yr::INT AS yr, last_value(n IGNORE NULLS) OVER (PARTITION BY star_id ORDER BY yr) AS n FROM g LEFT JOIN c USING (star_id, yr)")
def w05(spark, d):
    c = yearly(spark, d)
    top = c.groupBy("star_id").agg(F.sum("n").alias("k")).orderBy(F.desc("k"), "star_id").limit(10).select("star_id")
    grid = top.withColumn("yr", F.explode(F.sequence(F.lit(2000), F.lit(2025))))
    of = Window.partitionBy("star_id").orderBy("yr").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(c, ["star_id", "yr"], "left").select("star_id", "yr", F.last("n", True).over(of).alias("n"))


@query("t01_top_n", "SELECT star_id, phot_g_mean_mag FROM stars ORDER BY phot_g_mean_mag NULLS LAST, star_id LIMIT 25")
def t01(spark, d):
    return s(spark, d).select("star_id", "phot_g_mean_mag").orderBy(C("phot_g_mean_mag").asc_nulls_last(), "star_id").limit(25)


@query("t02_boolean_first", "SELECT id FROM spectroscopy_holdings ORDER BY (raw_target_name IS NOT NULL) DESC, updated_at DESC, id LIMIT 40")
def t02(spark, d):
    return h(spark, d).orderBy(F.desc(C("raw_target_name").isNotNull()), F.desc("updated_at"), "id").limit(40).select("id")


QUEUE_VOTES = """v AS (SELECT archive_code, archive_obs_id, count(DISTINCT lower(trim(submitter))) AS n FROM skip_classifications GROUP BY ALL),
  q AS (SELECT archive_code, coalesce(nullif(trim(raw_target_name), ''), 'obs:' || archive_obs_id) AS group_key, archive_obs_id, nullif(trim(raw_target_name), '') AS name,
      row_number() OVER (PARTITION BY archive_code, coalesce(nullif(trim(raw_target_name), ''), 'obs:' || archive_obs_id)
        ORDER BY updated_at DESC, id DESC) AS rn
    FROM spectroscopy_holdings WHERE match_status = 'skipped'),
  g AS (SELECT archive_code, group_key, max(name) AS name, count(*) AS n_records, list(archive_obs_id ORDER BY rn) FILTER (WHERE rn <= 50) AS ids
    FROM q GROUP BY 1, 2),
  t AS (SELECT * FROM g JOIN archives USING (archive_code) WHERE (archive_code, group_key) IN (SELECT archive_code, group_key FROM g
    ORDER BY (name IS NOT NULL) DESC, n_records DESC, archive_code, group_key LIMIT 2000)),
  nv AS (SELECT archive_code, group_key, coalesce(max(v.n), 0) AS n_votes FROM (SELECT archive_code, group_key, unnest(ids) AS archive_obs_id FROM t)
    LEFT JOIN v USING (archive_code, archive_obs_id) GROUP BY 1, 2)"""


@query("t06_weighted_order", f"""WITH {QUEUE_VOTES}
  SELECT archive_code, group_key, n_records, n_votes, row_number() OVER (ORDER BY (name IS NOT NULL) DESC,
    -ln((('0x' || substr(md5('seed' || archive_code || group_key), 1, 8))::UINTEGER::DOUBLE + 1)/4294967297) / (n_records / power(2::DOUBLE, n_votes)))::INT AS place
  FROM t JOIN nv USING (archive_code, group_key)""")
def t06(spark, d):
    queue = V.with_votes(D.triage_queue(h(spark, d), a(spark, d)), D.voters(load(spark, d, "skip_classifications")))
    return V.weighted_order(queue, "n_votes", "seed", "place").select("archive_code", "group_key", "n_records", "n_votes", "place")


@query("t07_offset_wrap", "SELECT star_id FROM stars ORDER BY star_id OFFSET (SELECT 1000003 % count(*) FROM stars) LIMIT 1")
def t07(spark, d):
    return V.at_offset(s(spark, d).select("star_id"), ["star_id"], 1_000_003)


@query("u01_union_all", "SELECT star_id FROM stars WHERE dec > 60 UNION ALL SELECT star_id FROM stars WHERE phot_g_mean_mag < 8")
def u01(spark, d):
    return s(spark, d).filter("dec > 60").select("star_id").unionByName(s(spark, d).filter("phot_g_mean_mag < 8").select("star_id"))


@query("u02_union", "SELECT star_id FROM stars WHERE dec > 60 UNION SELECT star_id FROM stars WHERE phot_g_mean_mag < 8")
def u02(spark, d):
    return u01(spark, d).distinct()


@query("u03_array_union",
       "SELECT star_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(coalesce(name_aliases, []), lambda x: x IS NOT NULL), ['A', 'B', 'A']))), ';') AS names FROM stars")
def u03(spark, d):
    kept = F.filter(F.coalesce("name_aliases", F.array().cast("array<string>")), lambda x: x.isNotNull())
    return s(spark, d).select("star_id", F.array_join(F.array_sort(F.array_union(kept, F.array(F.lit("A"), F.lit("B"), F.lit("A")))), ";").alias("names"))


# idioms of the connectors
simple("x01_clean_float", h, lambda: {"id": C("id"), "x": text.clean_float(C("archive_obs_id"))},
       "SELECT id, CASE WHEN isnan(x) THEN NULL ELSE x END AS x FROM (SELECT id, try_cast(archive_obs_id AS DOUBLE) AS x FROM spectroscopy_holdings)")
simple("x02_reduction_status", h, lambda: {"id": C("id"), "x": text.reduction_status((C("id") % 4).cast("string"))},
       "SELECT id, CASE WHEN id % 4 <= 1 THEN 'raw' ELSE 'reduced' END AS x FROM spectroscopy_holdings")
simple("x03_mjd_date", h, lambda: {"id": C("id"), "x": text.mjd_date(40000 + (C("id") % 20000) + 0.7)},
       "SELECT id, DATE '1858-11-17' + (40000 + id % 20000)::INT AS x FROM spectroscopy_holdings")
simple("x04_jd_date", h, lambda: {"id": C("id"), "x": text.jd_date(2440000.5 + (C("id") % 20000).cast("double"))},
       "SELECT id, DATE '1858-11-17' + (40000 + id % 20000)::INT AS x FROM spectroscopy_holdings")
simple("x05_millis_date", h, lambda: {"id": C("id"), "x": text.millis_date(C("id") * 1_000_003)},
       "SELECT id, epoch_ms(id * 1000003)::DATE AS x FROM spectroscopy_holdings")


def sexagesimal_dec():
    return F.format_string("%s%02d:%02d:%02d", F.when(C("dec") < 0, "-").otherwise("+"), F.floor(F.abs("dec")), F.floor(F.abs(C("dec")) * 60 % 60), F.floor(F.abs(C("dec")) * 3600 % 60))


simple("x06_sexagesimal", s, lambda: {"star_id": C("star_id"), "x": F.round(text.sexagesimal(sexagesimal_dec(), False), 7)},
       "SELECT star_id, round(CASE WHEN dec < 0 THEN -1 ELSE 1 END*(floor(abs(dec)) + floor((abs(dec)*60)%60)/60 + floor((abs(dec)*3600)%60)/3600), 7) AS x FROM stars")
simple("x08_degrees", s, lambda: {"star_id": C("star_id"), "x": F.round(F.degrees(F.radians("ra")), 8)},
       "SELECT star_id, round(degrees(radians(ra)), 8) AS x FROM stars")
simple("x09_sentinels", h, lambda: {"id": C("id"), "ra": text.no_sentinel(C("raw_ra"), 0.0, 999.0, -99.0), "dec": text.within(C("raw_dec"), -90, 90)},
       f"SELECT id, CASE WHEN raw_ra NOT IN (0, 999, -99) THEN raw_ra END AS ra, CASE WHEN raw_dec BETWEEN -90 AND 90 THEN raw_dec END AS dec FROM {HOLDINGS}")
simple("x14_typed_id", h, lambda: {"id": C("id"), "x": F.regexp_extract("raw_target_name", r"^Gaia DR3 (\d+)$", 1).try_cast("bigint")},
       r"SELECT id, try_cast(regexp_extract(raw_target_name, '^Gaia DR3 (\d+)$', 1) AS BIGINT) AS x FROM spectroscopy_holdings")
simple("x15_cleanup", h, lambda: {"id": C("id"), "x": F.substring_index("instrument", "-", 1), "y": F.regexp_replace("archive_obs_id", r"\.fits$", "")},
       r"SELECT id, split_part(instrument, '-', 1) AS x, regexp_replace(archive_obs_id, '\.fits$', '') AS y FROM spectroscopy_holdings")
simple("x22_template", h, lambda: {"id": C("id"), "x": F.format_string("%s-%06d.fits", C("archive_code"), C("id") % 1000000)},
       "SELECT id, archive_code || '-' || lpad((id % 1000000)::VARCHAR, 6, '0') || '.fits' AS x FROM spectroscopy_holdings")


@query("x10_sane_watermark", "SELECT archive_code, max(obs_date) AS mark FROM spectroscopy_holdings WHERE obs_date < DATE '2025-01-01' GROUP BY 1")
def x10(spark, d):
    return h(spark, d).filter("obs_date < DATE '2025-01-01'").groupBy("archive_code").agg(F.max("obs_date").alias("mark"))


@query("x12_keep_last",
       "SELECT archive_code, archive_obs_id, id FROM spectroscopy_holdings QUALIFY row_number() OVER (PARTITION BY archive_code, archive_obs_id ORDER BY updated_at DESC, id DESC) = 1")
def x12(spark, d):
    key = ["archive_code", "archive_obs_id"]
    return h(spark, d).groupBy(*key).agg(F.max(F.struct("updated_at", "id"))["id"].alias("id"))


@query("x13_unpivot", f"SELECT id, 'ra' AS axis, raw_ra AS v FROM {HOLDINGS} UNION ALL SELECT id, 'dec', raw_dec FROM {HOLDINGS}")
def x13(spark, d):
    return h(spark, d).selectExpr("id", "stack(2, 'ra', raw_ra, 'dec', raw_dec) AS (axis, v)")


@query("x16_centroid", "SELECT field_id, round((ra_min + ra_max)/2, 8) AS x, round((dec_min + dec_max)/2, 8) AS y FROM sky_fields WHERE shape = 'box'")
def x16(spark, d):
    corner = lambda x, y: F.array(x, y)
    box = F.array(corner("ra_min", "dec_min"), corner("ra_max", "dec_min"), corner("ra_max", "dec_max"), corner("ra_min", "dec_max"), corner("ra_min", "dec_min"))
    c = text.centroid(box)
    return load(spark, d, "sky_fields").filter("shape = 'box'").select("field_id", F.round(c["x"], 8).alias("x"), F.round(c["y"], 8).alias("y"))


@query("x17_pairs_map", "SELECT star_id, ra AS x FROM stars")
def x17(spark, d):
    items = F.array(F.struct(F.lit("ra").alias("key"), C("ra").alias("value")), F.struct(F.lit("dec").alias("key"), C("dec").alias("value")))
    return s(spark, d).select("star_id", text.pairs_map(items)["ra"].alias("x"))


SHORT_YEAR = "CASE WHEN year(obs_date) % 100 < 50 THEN 2000 ELSE 1900 END + year(obs_date) % 100"


@query("x18_flexible_date", f"""SELECT id, CASE id % 3 WHEN 0 THEN obs_date
    WHEN 1 THEN try_cast(printf('%04d-%02d-%02d', {SHORT_YEAR}, month(obs_date), day(obs_date)) AS DATE)
  ELSE CASE WHEN year(obs_date) BETWEEN 1900 AND 2099 THEN obs_date END END AS x FROM spectroscopy_holdings""")
def x18(spark, d):
    return flexible_dates(h(spark, d))


def flexible_dates(rows: DataFrame) -> DataFrame:
    iso, short = F.date_format("obs_date", "yyyy-MM-dd"), F.date_format("obs_date", "dd/MM/yy")
    typed = F.when(C("id") % 3 == 0, iso).when(C("id") % 3 == 1, short).otherwise("?")
    return rows.select("id", text.flexible_date(typed, F.concat(F.lit("w"), F.date_format("obs_date", "yyyyMMdd"), F.lit(".fit"))).alias("x"))


@query("x19_fixed_width", "SELECT id, archive_code AS a, nullif(trim(substr(coalesce(instrument, ''), 1, 10)), '') AS i FROM spectroscopy_holdings")
def x19(spark, d):
    line = F.concat(F.rpad("archive_code", 16, " "), F.rpad(F.coalesce("instrument", F.lit("")), 10, " "))
    return h(spark, d).select("id", *text.fixed_width(line, {"a": (1, 16), "i": (17, 26)}))


@query("x20_row_regex",
       "SELECT doc_id, len(regexp_extract_all(text, 'HD ([0-9]+)', 1))::INT AS n, regexp_extract_all(text, 'HD ([0-9]+)', 1)[1] AS first FROM documents WHERE text IS NOT NULL")
def x20(spark, d):
    found = F.regexp_extract_all("text", F.lit("HD ([0-9]+)"), 1)
    return load(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(found).alias("n"), F.get(found, F.lit(0)).alias("first"))


@query("x21_sky_grid",
       "SELECT i::INT AS i, j AS j FROM range(0, 17) r(i), LATERAL (SELECT unnest(range(0, greatest(1, ceil(36*cos(radians(i*10.0::DOUBLE - 80)) - 1e-9)::BIGINT))) AS j)")
def x21(spark, d):
    n = F.greatest(F.lit(1), F.ceil(36 * F.cos(F.radians(C("i") * 10.0 - 80)) - 1e-9))
    return spark.range(17).select(C("id").cast("int").alias("i")).select("i", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("j"))


# serving
@query("q01_star_holdings",
       "SELECT h.id, display_name, instrument, obs_date FROM spectroscopy_holdings h JOIN archives USING (archive_code) WHERE star_id = (SELECT star_id FROM stars WHERE list_contains(name_aliases, 'HD 400684') LIMIT 1)")
def q01(spark, d):
    return V.holdings_for(h(spark, d), a(spark, d), V.find_star(s(spark, d), " hd  400684")).select("id", "display_name", "instrument", "obs_date")


@query("q04_batch_lookup",
       "WITH e AS (SELECT unnest(['HD 400684', 'GJ 5136', 'no such star']) AS entry), f AS (SELECT entry, min(star_id) AS star_id FROM e LEFT JOIN (SELECT star_id, unnest(list_append(coalesce(name_aliases, []), input_name)) AS n FROM stars) ON lower(n) = lower(entry) GROUP BY 1) SELECT entry, CASE WHEN f.star_id IS NULL THEN 'not resolved' ELSE 'tracked' END AS status, f.star_id, count(h.id) AS n_holdings FROM f LEFT JOIN spectroscopy_holdings h ON h.star_id = f.star_id GROUP BY ALL")
def q04(spark, d):
    return V.batch_lookup(V.batch_lines("HD 400684\nGJ 5136\n\n no such star \nHD 400684", h(spark, d)).select("entry"), s(spark, d), h(spark, d))


@query("q07_series",
       "SELECT star_id, count(*) AS n_points, sum(n)::BIGINT AS total FROM (SELECT star_id, year(obs_date) AS y, count(*) AS n FROM spectroscopy_holdings WHERE star_id IS NOT NULL AND obs_date IS NOT NULL GROUP BY ALL) GROUP BY 1")
def q07(spark, d):
    series = yearly(spark, d).groupBy("star_id").agg(F.map_from_entries(F.collect_list(F.struct("yr", "n"))).alias("series"))
    return series.select("star_id", F.size("series").cast("bigint").alias("n_points"), F.aggregate(F.map_values("series"), F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("total"))


@query("q12_review_queue", f"""WITH {QUEUE_VOTES}, m AS (SELECT DISTINCT archive_code, archive_obs_id FROM skip_classifications
    WHERE lower(trim(submitter)) = 'skywatch_000'),
  s AS (SELECT DISTINCT archive_code, group_key FROM (SELECT archive_code, group_key, unnest(ids) AS archive_obs_id FROM t) SEMI
    JOIN m USING (archive_code, archive_obs_id)),
  o AS (SELECT archive_code, group_key, n_records, n_votes, (row_number() OVER (ORDER BY (name IS NOT NULL) DESC,
    -ln((('0x' || substr(md5('day 1' || archive_code || group_key), 1, 8))::UINTEGER::DOUBLE + 1)/4294967297) / (n_records / power(2::DOUBLE, n_votes))))::INT AS place
    FROM t JOIN nv USING (archive_code, group_key) ANTI JOIN s USING (archive_code, group_key))
  SELECT archive_code, group_key, n_records, n_votes, place FROM o WHERE place > 20 AND place <= 40""")
def q12(spark, d):
    votes = load(spark, d, "skip_classifications")
    queue = V.with_votes(D.triage_queue(h(spark, d), a(spark, d)), D.voters(votes))
    return V.review_page(queue, votes, "SkyWatch_000", "day 1", 20, 20).select("archive_code", "group_key", "n_records", "n_votes", "place")


@query("q15_options", "SELECT archive_code, count(*) AS n FROM spectroscopy_holdings GROUP BY 1")
def q15(spark, d):
    return V.option_counts(h(spark, d), "archive_code")


@query("g25_holdings_groups",
       "SELECT star_id, display_name, instrument, count(*) AS n, min(obs_date) AS first_date FROM spectroscopy_holdings JOIN archives USING (archive_code) WHERE star_id = 42 GROUP BY ALL")
def g25(spark, d):
    star = s(spark, d).filter("star_id = 42")
    return V.per_star_groups(V.holdings_for(h(spark, d), a(spark, d), star)).select(F.lit(42).cast("bigint").alias("star_id"), "display_name", "instrument", "n", "first_date")


@query("g26_counts_per_id", "SELECT star_id, count(*) AS n FROM spectroscopy_holdings WHERE star_id IN (1, 2, 3, 42) GROUP BY 1")
def g26(spark, d):
    return h(spark, d).filter(C("star_id").isin(1, 2, 3, 42)).groupBy("star_id").agg(F.count(F.lit(1)).alias("n"))


@query("f20_packed_rows", """WITH RECURSIVE i AS (SELECT display_name, instrument, (300 + 10*(len(instrument)%7))::DOUBLE AS wave_min, (500 + 25*(len(display_name)%9))::DOUBLE AS wave_max
    FROM spectroscopy_holdings JOIN archives USING (archive_code) WHERE instrument IS NOT NULL GROUP BY display_name, instrument),
  n AS (SELECT *, row_number() OVER (PARTITION BY display_name ORDER BY wave_min, wave_max, instrument) AS k FROM i),
  r AS (SELECT display_name, instrument, wave_min, wave_max, k, 0 AS "row", [wave_max] AS ends FROM n WHERE k = 1
    UNION ALL
      SELECT n.display_name, n.instrument, n.wave_min, n.wave_max, n.k, coalesce(list_position(list_transform(ends, lambda e: e <= n.wave_min), true) - 1, len(ends))::INT,
      CASE WHEN list_contains(list_transform(ends, lambda e: e <= n.wave_min), true) THEN list_transform(ends, lambda e, j: CASE
        WHEN j = list_position(list_transform(ends, lambda e2: e2 <= n.wave_min), true) THEN n.wave_max ELSE e END)
        ELSE list_append(ends, n.wave_max) END
      FROM r JOIN n ON n.display_name = r.display_name AND n.k = r.k + 1)
  SELECT display_name, instrument, wave_min, wave_max, "row"::INT AS "row" FROM r""")
def f20(spark, d):
    return V.pack_rows(ranges(spark, d), ["display_name"], "wave_min", "wave_max", ["instrument"])


@query("f21_colours",
       "SELECT archive_code, ((row_number() OVER (ORDER BY f) - 1) % 8)::INT AS colour FROM (SELECT archive_code, min(id) AS f FROM spectroscopy_holdings GROUP BY 1)")
def f21(spark, d):
    return V.colour_index(h(spark, d), "archive_code", ["id"])


LINES = " HD 1\n\nHD 2\r\nHD 1\n\t HD 3"


@query("f23_batch_lines",
       "SELECT trim(line, ' ' || chr(9)) AS entry, min(pos)::INT AS pos FROM (SELECT unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT string_split(' HD 1' || chr(10) || chr(10) || 'HD 2' || chr(10) || 'HD 1' || chr(10) || chr(9) || ' HD 3', chr(10)) AS l)) WHERE trim(line, ' ' || chr(9)) <> '' GROUP BY 1")
def f23(spark, d):
    return V.batch_lines(LINES, h(spark, d))


@query("f14_rings")
def f14(spark, d):
    rows = s(spark, d).select("star_id", geo.healpix(C("ra"), C("dec"), 7).alias("pixel"))
    return geo.with_rings(rows, "pixel", "near", 7)


POLE = "radians(192.85948::DOUBLE) AS a0, radians(27.12825::DOUBLE) AS d0, radians(122.93192::DOUBLE - i) AS dl"


@query("f16_galactic_plane", f"""WITH g AS (SELECT i AS id, {POLE} FROM range(0, 361) r(i)),
  e AS (SELECT id, asin(cos(d0)*cos(dl)) AS de, degrees(atan2(sin(dl), -sin(d0)*cos(dl)) + a0) AS r0 FROM g),
  c AS (SELECT id, de, radians(CASE WHEN r > 180 THEN 360 - r ELSE -r END) AS l FROM (SELECT id, de, r0 - 360*floor(r0/360) AS r FROM e)),
  p AS (SELECT id, 2*cos(de)*sin(l/2)/k AS x, sin(de)/k AS y FROM (SELECT *, sin(acos(cos(de)*cos(l/2)))/acos(cos(de)*cos(l/2)) AS k FROM c))
 
    SELECT id, round(x, 7) AS x, round(y, 7) AS y, coalesce(power(x - lag(x) OVER (ORDER BY id), 2) + power(y - lag(y) OVER (ORDER BY id), 2) > 0.25, false) AS breaks
    FROM p""")
def f16(spark, d):
    at = spark.range(361).select("id", geo.galactic_to_icrs(C("id").cast("double"), F.lit(0.0)).alias("p"))
    xy = at.select("id", geo.aitoff(C("p.ra"), C("p.dec")).alias("q")).select("id", "q.x", "q.y")
    before = Window.orderBy("id")
    gap = F.pow(C("x") - F.lag("x").over(before), 2) + F.pow(C("y") - F.lag("y").over(before), 2) > 0.25
    return xy.select("id", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"), F.coalesce(gap, F.lit(False)).alias("breaks"))


@query("f34_bin_size", """SELECT vec_id, round(13*list_sort(st)[(len(st) + 1)//2]/2 + 13*list_sort(st)[len(st)//2 + 1]/2, 12) AS bin_size
  FROM (SELECT vec_id, list_transform(range(1, len(embedding)), lambda i: log10(5000.0::DOUBLE + i) - log10(4999.0::DOUBLE + i)) AS st FROM embeddings)""")
def f34b(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.round(P.bin_size_of(wave()), 12).alias("bin_size"))


@query("f34_continuum")
def f34(spark, d):
    """Every point of every spectrum divided by its continuum."""
    spectra = load(spark, d, "embeddings").select("vec_id", wave().alias("wave"), F.transform(flux(), lambda x: F.abs(x) + 1).alias("flux"))
    return P.normalise(spectra, "wave", "flux").select("vec_id", F.posexplode("flux").alias("point", "flux"))
