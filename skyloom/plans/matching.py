"""Queries of the matcher, the radial joins, the merges and the votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.operators import match as M
from skyloom.operators import merge as G
from skyloom.plans.derived import h, s
from skyloom.session import load

QUERIES, SQL = {}, {}
NO_ID = 999_999_999_999_999_999


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def records(spark: SparkSession, d: str) -> DataFrame:
    """The holdings rows as they came: a catalogue id where the archive gives one, an unknown one where it is lost."""
    ids = s(spark, d).select("star_id", F.col("gaia_source_id").alias("g"))
    gid = F.when(F.col("match_method") == "direct_gaia_column", F.coalesce("g", F.lit(NO_ID)))
    return h(spark, d).join(ids, "star_id", "left").select(
        "id", "archive_code", "instrument", "obs_date", gid.alias("gaia_source_id"), F.col("raw_ra").alias("ra"), F.col("raw_dec").alias("dec"), "raw_target_name"
    )


def vec(ra: str, dec: str) -> list[str]:
    return [f"cos(radians({dec}))*cos(radians({ra}))", f"cos(radians({dec}))*sin(radians({ra}))", f"sin(radians({dec}))"]


def moved(p: str, dt: str) -> list[str]:
    e, n = (f"(coalesce({p}{c}, 0)*coalesce({dt}, 0)*pi()/648000000)" for c in ("pmra", "pmdec"))
    ra, de = f"radians({p}ra)", f"radians({p}dec)"
    size = f"sqrt(1 + {e}*{e} + {n}*{n})"
    x = f"(cos({de})*cos({ra}) - sin({ra})*{e} - sin({de})*cos({ra})*{n})/{size}"
    y = f"(cos({de})*sin({ra}) + cos({ra})*{e} - sin({de})*sin({ra})*{n})/{size}"
    return [x, y, f"(sin({de}) + cos({de})*{n})/{size}"]


def sep(u: list[str], v: list[str]) -> str:
    return f"2*asin(least(1.0::DOUBLE, sqrt({' + '.join(f'(({x}) - ({y}))**2' for x, y in zip(u, v))})/2))*648000/pi()"


def key_sql(x: str) -> str:
    k = rf"upper(regexp_replace(regexp_replace(trim({x}), '^(NAME|V\*|Cl\*|\*)\s+', '', 'i'), '\s+', '', 'g'))"
    return f"CASE WHEN {k} LIKE 'GL%' THEN 'GJ' || substr({k}, 3) ELSE {k} END"


YEAR = "2000 + (date_diff('day', DATE '2000-01-01', obs_date) - 0.5::DOUBLE)/365.25::DOUBLE"
USABLE = "({r} IS NOT NULL AND {d} IS NOT NULL AND NOT isnan({r}) AND NOT isnan({d}) AND {d} BETWEEN -90 AND 90)"
RECORDS = f"""r AS (SELECT id, archive_code, instrument, obs_date, raw_ra AS ra, raw_dec AS dec, raw_target_name, {YEAR} AS yr,
    CASE WHEN match_method = 'direct_gaia_column' THEN coalesce(gaia_source_id, {NO_ID}) END AS gid, {USABLE.format(r='raw_ra', d='raw_dec')}
      AND obs_date IS NOT NULL AS placed
  FROM spectroscopy_holdings LEFT JOIN (SELECT star_id, gaia_source_id FROM stars) USING (star_id))"""
NAMED = f"""al AS (SELECT {key_sql('n')} AS k, max(star_id) AS star_id FROM (SELECT star_id, unnest(name_aliases) AS n FROM stars) WHERE n IS NOT NULL
    GROUP BY 1),
  nm AS (SELECT r.id, s.star_id, coalesce(r.placed AND {sep(vec('r.ra', 'r.dec'), moved('s.', '(r.yr - s.ref_epoch)'))} > 600, false) AS far
    FROM r JOIN al ON {key_sql('r.raw_target_name')} = al.k JOIN stars s ON s.star_id = al.star_id WHERE r.gid IS NULL AND al.k <> '')"""
PLACED = f"""tr AS (SELECT r.*, nm.star_id AS nstar, coalesce(nm.far, false) AS far FROM r LEFT JOIN nm USING (id)),
  pr AS (SELECT t.id, count(*) AS n, min(th) AS theta, arg_min(star_id, th) AS pstar FROM (
      SELECT tr.id, s.star_id, {sep(vec('tr.ra', 'tr.dec'), moved('s.', '(tr.yr - s.ref_epoch)'))} AS th FROM tr JOIN stars s
      ON tr.gid IS NULL AND tr.placed AND (tr.nstar IS NULL OR tr.far) AND abs(tr.dec - s.dec) < 0.3 + abs(coalesce(s.pmdec, 0))*200/3600000) t
        WHERE th <= 1 GROUP BY 1)"""


@query("m01_match_records", f"""WITH {RECORDS}, {NAMED}, {PLACED}
  SELECT tr.id, CASE WHEN gid IS NOT NULL THEN 'direct_gaia_column' WHEN nstar IS NOT NULL AND NOT far THEN 'name_resolved'
    ELSE 'positional_easy_match' END AS match_method,
    CASE WHEN gid IS NOT NULL THEN CASE WHEN g.star_id IS NULL THEN 'skipped' ELSE 'matched' END WHEN nstar IS NOT NULL AND NOT far THEN 'matched'
      WHEN NOT placed THEN 'skipped'
      WHEN pr.n = 1 THEN 'matched' WHEN pr.n > 1 OR far THEN 'needs_review' ELSE 'skipped' END AS match_status,
    CASE WHEN gid IS NOT NULL THEN g.star_id WHEN nstar IS NOT NULL AND NOT far THEN nstar WHEN pr.n = 1 THEN pstar END AS star_id,
    round(CASE WHEN gid IS NULL AND (nstar IS NULL OR far) THEN theta END, 3) AS theta_arcsec
  FROM tr LEFT JOIN stars g ON g.gaia_source_id = tr.gid LEFT JOIN pr USING (id)""")
def m01(spark, d):
    out = M.match_records(records(spark, d), s(spark, d), ["id"])
    return out.select("id", "match_method", "match_status", "star_id", F.round("theta_arcsec", 3).alias("theta_arcsec"))


@query("m02_direct", f"WITH {RECORDS} SELECT id, star_id FROM r LEFT JOIN stars ON gaia_source_id = gid WHERE gid IS NOT NULL")
def m02(spark, d):
    r = records(spark, d).filter("gaia_source_id IS NOT NULL").select("id", "gaia_source_id")
    return r.join(s(spark, d).select("gaia_source_id", "star_id"), "gaia_source_id", "left").select("id", "star_id")


@query("m03_name_plausible", f"WITH {RECORDS}, {NAMED} SELECT id, star_id, far AS turned_down FROM nm")
def m03(spark, d):
    r = records(spark, d).filter("gaia_source_id IS NULL").withColumn("k", M.match_key(F.col("raw_target_name"))).select("id", "k", F.col("ra").alias("t_ra"), F.col("dec").alias("t_dec"), "obs_date")
    j = r.join(M.alias_table(s(spark, d)).withColumnRenamed("key", "k"), "k").join(s(spark, d).select(*M.MOTION), "star_id")
    star = geo.moved_vector(F.col("ra"), F.col("dec"), F.col("pmra"), F.col("pmdec"), geo.julian_year(F.col("obs_date")) - F.col("ref_epoch"))
    far = geo.usable(F.col("t_ra"), F.col("t_dec")) & F.col("obs_date").isNotNull() & (geo.vector_separation(geo.unit_vector(F.col("t_ra"), F.col("t_dec")), star) > M.NAME_RADIUS)
    return j.select("id", "star_id", F.coalesce(far, F.lit(False)).alias("turned_down"))


def targets(spark: SparkSession, d: str, where: str, radius: float) -> DataFrame:
    rows = h(spark, d).filter(where).filter(geo.usable(F.col("raw_ra"), F.col("raw_dec")) & F.col("obs_date").isNotNull())
    return rows.select(F.col("id").alias("t_id"), F.col("archive_code"), F.col("raw_ra").alias("t_ra"), F.col("raw_dec").alias("t_dec"), geo.julian_year(F.col("obs_date")).alias("t_year"), F.lit(radius).alias("t_radius"))


TARGETS = f"""t AS (SELECT id, archive_code, raw_ra AS ra, raw_dec AS dec, {YEAR} AS yr FROM spectroscopy_holdings
  WHERE match_status = '{{w}}' AND {USABLE.format(r='raw_ra', d='raw_dec')} AND obs_date IS NOT NULL)"""
NEAR = f"""n AS (SELECT t.id, t.archive_code, s.star_id, s.gaia_source_id, s.source_catalog, s.phot_g_mean_mag, {sep(vec('t.ra', 't.dec'), moved('s.', '(t.yr - s.ref_epoch)'))} AS sep
  FROM t JOIN stars s ON abs(t.dec - s.dec) < 0.3 + abs(coalesce(s.pmdec, 0))*200/3600000)"""
SPAN = (1850.0, 2050.0)  # years that hold all dates of the test data, the placeholder of 1858 as well


@query("j12_radial_join", f"WITH {TARGETS.format(w='skipped')}, {NEAR} SELECT id, star_id, round(sep, 3) AS sep_arcsec FROM n WHERE sep <= 60")
def j12(spark, d):
    pairs = M.radial_pairs(targets(spark, d, "match_status = 'skipped'", 60.0), s(spark, d).select(*M.MOTION), 60.0, *SPAN)
    return pairs.select(F.col("t_id").alias("id"), "star_id", F.round("sep_arcsec", 3).alias("sep_arcsec"))


@query("j11_radial_candidates", f"""WITH t AS (SELECT id, raw_ra AS ra, raw_dec AS dec FROM spectroscopy_holdings WHERE match_status = 'needs_review'
    AND {USABLE.format(r='raw_ra', d='raw_dec')})
  SELECT DISTINCT s.star_id FROM t JOIN stars s ON abs(t.dec - s.dec) < 0.01 AND {sep(vec('t.ra', 't.dec'), vec('s.ra', 's.dec'))} <= 30""")
def j11(spark, d):
    t = h(spark, d).filter("match_status = 'needs_review'").filter(geo.usable(F.col("raw_ra"), F.col("raw_dec")))
    t = t.select(F.col("raw_ra").alias("t_ra"), F.col("raw_dec").alias("t_dec"), F.lit(None).cast("double").alias("t_year"), F.lit(30.0).alias("t_radius"))
    still = s(spark, d).select("star_id", "ra", "dec", F.lit(2016.0).alias("ref_epoch"), F.lit(0.0).alias("pmra"), F.lit(0.0).alias("pmdec"))
    return M.radial_pairs(t, still, 30.0, 2016.0, 2016.0).select("star_id").distinct()


@query("j13_star_star", f"""WITH b AS (SELECT * FROM stars WHERE source_catalog = 'bsc5'), g AS (SELECT * FROM stars WHERE source_catalog = 'gaia')
  SELECT b.star_id AS new_star, g.star_id AS old_star, round({sep(moved('b.', '(g.ref_epoch - b.ref_epoch)'), vec('g.ra', 'g.dec'))}, 3) AS sep_arcsec
  FROM b JOIN g ON abs(b.dec - g.dec) < 0.2 + abs(coalesce(b.pmdec, 0))*30/3600000
    AND {sep(moved('b.', '(g.ref_epoch - b.ref_epoch)'), vec('g.ra', 'g.dec'))} <= 120""")
def j13(spark, d):
    old = s(spark, d).filter("source_catalog = 'gaia'").select(F.col("star_id").alias("old_star"), F.col("ra").alias("t_ra"), F.col("dec").alias("t_dec"), F.col("ref_epoch").alias("t_year"), F.lit(120.0).alias("t_radius"))
    new = s(spark, d).filter("source_catalog = 'bsc5'").select(*M.MOTION)
    return M.radial_pairs(old, new, 120.0, 1991.0, 2016.0).select(F.col("star_id").alias("new_star"), "old_star", F.round("sep_arcsec", 3).alias("sep_arcsec"))


CONE = "degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sin(radians({d}))*sin(radians(30.4::DOUBLE)) + cos(radians({d}))*cos(radians(30.4::DOUBLE))*cos(radians({r} - 157.8::DOUBLE))))))"


@query("j14_cone_search",
       f"SELECT star_id, round({CONE.format(r='ra', d='dec')}, 6) AS sep_deg FROM stars WHERE dec BETWEEN 10.4 AND 50.4 AND {CONE.format(r='ra', d='dec')} <= 20 ORDER BY {CONE.format(r='ra', d='dec')} LIMIT 200")
def j14(spark, d):
    return M.cone_search(s(spark, d).select("star_id", "ra", "dec"), 157.8, 30.4, 20.0).select("star_id", F.round("sep_deg", 6).alias("sep_deg"))


@query("j15_unmatched_cone", f"""SELECT id, archive_url, program_id FROM spectroscopy_holdings WHERE match_status = 'skipped' AND raw_dec BETWEEN 25.4
    AND 35.4 AND NOT isnan(raw_ra) AND {CONE.format(r='raw_ra', d='raw_dec')} <= 5""")
def j15(spark, d):
    narrow = h(spark, d).filter("match_status = 'skipped' AND NOT isnan(raw_ra)").select("id", "raw_ra", "raw_dec")
    ids = M.cone_search(narrow, 157.8, 30.4, 5.0, None, ("raw_ra", "raw_dec")).select("id")
    return h(spark, d).select("id", "archive_url", "program_id").join(ids, "id", "left_semi")


@query("j16_brightest_in_radius", f"""WITH {TARGETS.format(w='needs_review')}, {NEAR}, b AS (SELECT id, arg_min(star_id, phot_g_mean_mag*1e9 + star_id) AS star_id, min(phot_g_mean_mag) AS g
    FROM n WHERE sep <= 60 AND phot_g_mean_mag IS NOT NULL GROUP BY 1)
  SELECT id, star_id FROM b WHERE g <= 15""")
def j16(spark, d):
    cols = [*M.MOTION, "phot_g_mean_mag"]
    pairs = M.radial_pairs(targets(spark, d, "match_status = 'needs_review'", 60.0), s(spark, d).select(*cols), 60.0, *SPAN).filter("phot_g_mean_mag IS NOT NULL")
    best = pairs.groupBy(F.col("t_id").alias("id")).agg(F.min_by("star_id", F.struct("phot_g_mean_mag", "star_id")).alias("star_id"), F.min("phot_g_mean_mag").alias("g"))
    return best.filter("g <= 15").select("id", "star_id")


@query("j13_new_vs_old", f"""WITH b AS (SELECT * FROM stars WHERE source_catalog = 'bsc5'), g AS (SELECT * FROM stars WHERE source_catalog = 'gaia')
  SELECT b.star_id AS new_star, g.star_id AS old_star FROM b
  JOIN g ON abs(b.dec - g.dec) < 0.2 + abs(coalesce(b.pmdec, 0))*30/3600000 AND {sep(moved('b.', '(g.ref_epoch - b.ref_epoch)'), vec('g.ra', 'g.dec'))} <= 5""")
def j13b(spark, d):
    """New stars, moved to the epoch of each old one, within 5 arcsec of it."""
    old = s(spark, d).filter("source_catalog = 'gaia'").select(
        F.col("star_id").alias("old_star"), F.col("ra").alias("t_ra"), F.col("dec").alias("t_dec"), F.col("ref_epoch").alias("t_year"), F.lit(5.0).alias("t_radius")
    )
    new = s(spark, d).filter("source_catalog = 'bsc5'").select(*M.MOTION)
    return M.radial_pairs(old, new, 5.0, 1991.0, 2016.0).select(F.col("star_id").alias("new_star"), "old_star")


@query("j16_bright_match", f"""WITH b AS (SELECT * FROM stars WHERE source_catalog = 'bsc5'), g AS (SELECT * FROM stars WHERE source_catalog = 'gaia' AND phot_g_mean_mag IS NOT NULL),
  n AS (SELECT b.star_id AS t_id, b.phot_g_mean_mag AS own, g.star_id, g.phot_g_mean_mag AS mag FROM b
    JOIN g ON abs(b.dec - g.dec) < 0.3 + abs(coalesce(g.pmdec, 0))*30/3600000 AND {sep(vec('b.ra', 'b.dec'), moved('g.', '(b.ref_epoch - g.ref_epoch)'))} <= 15
      AND {sep(vec('b.ra', 'b.dec'), vec('g.ra', 'g.dec'))} <= 300),
  k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY t_id ORDER BY mag, star_id) = 1)
  SELECT t_id, star_id FROM k WHERE own IS NULL OR mag::DOUBLE <= own::DOUBLE + 3""")
def j16b(spark, d):
    """The bright-star list against the catalogue, on the list's own date."""
    bright = s(spark, d).filter("source_catalog = 'bsc5'").select(
        F.col("star_id").alias("t_id"), F.col("ra").alias("t_ra"), F.col("dec").alias("t_dec"), F.col("ref_epoch").alias("t_year"), F.col("phot_g_mean_mag").cast("double").alias("t_mag")
    )
    pool = s(spark, d).filter("source_catalog = 'gaia'").select(*M.MOTION, "phot_g_mean_mag")
    return M.brightest_match(bright, pool, 1990.0, 2017.0).select("t_id", "star_id")


@query("g24_radius_simulation", f"""WITH {TARGETS.format(w='skipped')}, {NEAR}, k AS (SELECT id, {', '.join(f'count(*) FILTER (WHERE sep <= {r}) AS n{r}' for r in (1, 5, 20, 60))} FROM t LEFT JOIN n USING (id) GROUP BY 1)
  {' UNION ALL '.join(f'SELECT {r}::DOUBLE AS radius, count(*) FILTER (WHERE n{r} = 0) AS none, count(*) FILTER (WHERE n{r} = 1) AS one, count(*) FILTER (WHERE n{r} > 1) AS many FROM k' for r in (1, 5, 20, 60))}""")
def g24(spark, d):
    return M.radius_simulation(targets(spark, d, "match_status = 'skipped'", 60.0), s(spark, d).select(*M.MOTION), [1.0, 5.0, 20.0, 60.0], *SPAN)


CAND = f"{TARGETS.format(w='skipped')}, {NEAR}, cn AS (SELECT * FROM n WHERE sep <= 120)"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    stars = s(spark, d).select(*M.MOTION, "gaia_source_id", "source_catalog", "phot_g_mean_mag")
    pairs = M.radial_pairs(targets(spark, d, "match_status = 'skipped'", 120.0), stars, 120.0, *SPAN)
    return pairs.select(F.col("t_id").alias("id"), "archive_code", "star_id", "gaia_source_id", "source_catalog", F.col("sep_arcsec").alias("separation_arcsec"), "phot_g_mean_mag")


@query("m07_pick_best", f"""WITH {CAND}, f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY phot_g_mean_mag, sep) AS rk FROM cn
    WHERE phot_g_mean_mag <= 18),
  w AS (SELECT id, count(*) AS k, max(star_id) FILTER (WHERE rk = 1) AS ws, max(sep) FILTER (WHERE rk = 1) AS wsep, max(phot_g_mean_mag) FILTER (WHERE rk = 2) - max(phot_g_mean_mag) FILTER (WHERE rk = 1) AS lead, min(sep) AS fsep
    FROM f GROUP BY 1),
  b AS (SELECT id, arg_min(star_id, sep) AS bs FROM cn WHERE source_catalog = 'bsc5' GROUP BY 1), x AS (SELECT id, min(sep) AS nsep FROM cn GROUP BY 1)
  SELECT id, CASE WHEN bs IS NOT NULL THEN bs WHEN k = 1 AND nsep*3 >= wsep THEN ws WHEN k > 1 AND lead >= 2 AND fsep*3 >= wsep THEN ws END AS star_id,
    CASE WHEN bs IS NOT NULL THEN 'bright catalogue' WHEN k IS NULL THEN 'all too faint' WHEN k = 1
      AND nsep*3 < wsep THEN 'a fainter one is much closer' WHEN k = 1 THEN 'only one'
      WHEN lead < 2 THEN 'lead too small' WHEN fsep*3 < wsep THEN 'another is much closer' ELSE 'brightest' END AS reason
  FROM x LEFT JOIN w USING (id) LEFT JOIN b USING (id)""")
def m07(spark, d):
    return M.pick_best(candidates(spark, d), ["id"]).select("id", F.col("winner.star_id").alias("star_id"), "reason")


@query("j18_merge_candidates", f"""WITH {CAND}, tl AS (SELECT id, star_id, gaia_source_id, sep, 0 AS k FROM cn UNION ALL
    SELECT id, NULL, gaia_source_id, sep, 1 FROM cn WHERE gaia_source_id IS NOT NULL)
  SELECT id, star_id, gaia_source_id FROM tl QUALIFY row_number() OVER (PARTITION BY id, gaia_source_id ORDER BY k, sep) = 1 OR (k = 0
    AND gaia_source_id IS NULL)""")
def j18(spark, d):
    tracked = candidates(spark, d)
    live = tracked.filter("gaia_source_id IS NOT NULL").withColumn("star_id", F.lit(None).cast("bigint"))
    return M.merge_candidates(tracked, live, ["id"]).select("id", "star_id", "gaia_source_id")


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, edge = h(spark, d), F.lit("2024-02-15").cast("timestamp")
    once = rows.filter(F.col("updated_at") < edge).groupBy(*G.KEY).agg(F.max("id").alias("id"))
    return rows.join(once.select("id"), "id", "left_semi"), rows.filter(F.col("updated_at") >= edge).drop("id")


@query("m06_upsert", """WITH e AS (SELECT *, 0 AS k FROM spectroscopy_holdings WHERE updated_at < '2024-02-15'
    QUALIFY row_number() OVER (PARTITION BY archive_code, archive_obs_id ORDER BY id DESC) = 1),
  b AS (SELECT * REPLACE (NULL::BIGINT AS id), id AS bid, 1 AS k FROM spectroscopy_holdings WHERE updated_at >= '2024-02-15'),
  u AS (SELECT *, NULL::BIGINT AS bid FROM e UNION ALL BY NAME SELECT * FROM b)
  SELECT archive_code, archive_obs_id, star_id, match_status, reduction_status, updated_at, min(first_seen_at) OVER w AS first_seen_at, min(CASE
    WHEN k = 0 THEN id END) OVER w AS id
  FROM u WINDOW w AS (PARTITION BY archive_code, archive_obs_id) QUALIFY row_number() OVER (PARTITION BY archive_code, archive_obs_id
    ORDER BY k DESC, updated_at DESC, archive_url DESC, star_id DESC NULLS LAST, match_status DESC, reduction_status DESC) = 1""")
def m06(spark, d):
    existing, batch = halves(spark, d)
    order = [F.col(c) for c in ("updated_at", "archive_url", "star_id", "match_status", "reduction_status")]
    return G.upsert(existing, batch, order).select(*G.KEY, "star_id", "match_status", "reduction_status", "updated_at", "first_seen_at", "id")


PAIR = ("austral_raw", "nordlys")


@query("m18_reconcile_raw", f"""SELECT id FROM spectroscopy_holdings r WHERE NOT (archive_code = '{PAIR[0]}' AND match_status = 'matched'
  AND EXISTS (FROM spectroscopy_holdings x WHERE x.archive_code = '{PAIR[1]}' AND x.match_status = 'matched' AND x.star_id = r.star_id
    AND x.obs_date = r.obs_date AND x.instrument = r.instrument)
  AND NOT EXISTS (FROM skip_classifications v WHERE v.archive_code = r.archive_code AND v.archive_obs_id = r.archive_obs_id))""")
def m18(spark, d):
    return G.reconcile_raw(h(spark, d), load(spark, d, "skip_classifications"), *PAIR).select("id")


@query("j20_update_from", """SELECT h.id, CASE WHEN h.reduction_status = 'unknown' AND u.n IS NOT NULL THEN 'reduced'
    ELSE h.reduction_status END AS reduction_status
  FROM spectroscopy_holdings h LEFT JOIN (SELECT archive_code, archive_obs_id, count(*) AS n FROM spectroscopy_holdings
    WHERE reduction_status = 'reduced' GROUP BY ALL) u USING (archive_code, archive_obs_id)""")
def j20(spark, d):
    known = h(spark, d).filter("reduction_status = 'reduced'").select(*G.KEY, "reduction_status").distinct()
    return G.update_from(h(spark, d), known, G.KEY, "reduction_status", F.col("reduction_status") == "unknown").select("id", "reduction_status")


@query("m09_add_stars", """WITH f AS (SELECT gaia_source_id + CASE WHEN star_id % 3 = 0 THEN 1000000000000000000
    ELSE 0 END AS gid, 'NEW ' || star_id AS n FROM stars WHERE gaia_source_id IS NOT NULL)
  SELECT gaia_source_id, CASE WHEN n IS NULL THEN array_to_string(name_aliases, ';')
    ELSE array_to_string(list_append(list_distinct_keep, n), ';') END AS aliases FROM
    (SELECT gaia_source_id, name_aliases, n, coalesce(list_filter(name_aliases, lambda x, i: list_position(name_aliases, x) = i OR (x IS NULL
      AND NOT list_contains(list_transform(name_aliases[:i-1], lambda y: y IS NULL), true))), []) AS list_distinct_keep FROM stars LEFT
      JOIN f ON gid = gaia_source_id)
  UNION ALL SELECT gid, n FROM f WHERE gid NOT IN (SELECT gaia_source_id FROM stars WHERE gaia_source_id IS NOT NULL)""")
def m09(spark, d):
    base = s(spark, d)
    gid = F.col("gaia_source_id") + F.when(F.col("star_id") % 3 == 0, F.lit(10**18)).otherwise(F.lit(0))
    found = base.filter("gaia_source_id IS NOT NULL").select(gid.alias("gaia_source_id"), F.array(F.concat(F.lit("NEW "), F.col("star_id").cast("string"))).alias("name_aliases"), "ra", "dec")
    return G.add_stars(base, found).select("gaia_source_id", F.array_join("name_aliases", ";").alias("aliases"))


@query("m12_resolve_names", """SELECT star_id, try_cast(substr(list_filter(string_split(ids, '|'), lambda x: x LIKE 'Gaia DR3 %')[1], 10) AS BIGINT) AS gaia_id, try_cast(substr(list_filter(string_split(ids, '|'), lambda x: x LIKE 'HD %')[1], 4) AS BIGINT) AS hd
  FROM (SELECT star_id, array_to_string(name_aliases, '|') AS ids FROM stars)""")
def m12(spark, d):
    ids = F.array_join("name_aliases", "|")
    return s(spark, d).select("star_id", G.resolve_id(ids, "Gaia DR3 ").alias("gaia_id"), G.resolve_id(ids, "HD ").alias("hd"))


@query("m19_replay_changes", f"""WITH {RECORDS}, {NAMED}, {PLACED}, nw AS (SELECT tr.id, CASE WHEN gid IS NOT NULL THEN g.star_id
    WHEN nstar IS NOT NULL AND NOT far THEN nstar WHEN pr.n = 1 THEN pstar END AS ns,
    CASE WHEN gid IS NOT NULL THEN CASE WHEN g.star_id IS NULL THEN 'skipped' ELSE 'matched' END WHEN nstar IS NOT NULL AND NOT far THEN 'matched'
      WHEN NOT placed THEN 'skipped' WHEN pr.n = 1 THEN 'matched' WHEN pr.n > 1 OR far THEN 'needs_review' ELSE 'skipped' END AS st
    FROM tr LEFT JOIN stars g ON g.gaia_source_id = tr.gid LEFT JOIN pr USING (id))
  SELECT id, star_id AS old_star, match_status AS old_status, ns AS new_star, st AS new_status FROM spectroscopy_holdings JOIN nw USING (id)
    WHERE match_status = 'skipped' AND (star_id IS DISTINCT FROM ns OR match_status IS DISTINCT FROM st)""")
def m19(spark, d):
    old = h(spark, d).filter("match_status = 'skipped'")
    new = M.match_records(records(spark, d).join(old.select("id"), "id", "left_semi"), s(spark, d), ["id"])
    return G.replay_changes(old, new)


def vote_lines(spark: SparkSession, d: str) -> DataFrame:
    """Vote lines made from the classifications: every third names the target, the others the observation."""
    v, rows = load(spark, d, "skip_classifications"), h(spark, d)
    name = rows.groupBy(*G.KEY).agg(F.max("raw_target_name").alias("n"))
    by_name = (F.col("id") % 3 == 0) & (F.trim(F.coalesce("n", F.lit(""))) != "")
    return v.join(name, G.KEY, "left").select(
        F.col("id").alias("vote_id"), "archive_code", "outcome", "submitter", "submitted_at", F.when(by_name, F.col("n")).alias("raw_target_name"), F.when(~by_name, F.col("archive_obs_id")).alias("archive_obs_id")
    )


@query("m20_import_votes", """WITH nm AS (SELECT archive_code, archive_obs_id, max(raw_target_name) AS n FROM spectroscopy_holdings GROUP BY ALL),
  v AS (SELECT id AS vote_id, archive_code, outcome, submitter, submitted_at, archive_obs_id AS o, CASE WHEN id % 3 = 0
    AND trim(coalesce(n, '')) <> '' THEN trim(n) END AS k FROM skip_classifications LEFT JOIN nm USING (archive_code, archive_obs_id)),
  sk AS (SELECT archive_code, archive_obs_id, trim(raw_target_name) AS k, count(*) OVER (PARTITION BY archive_code, trim(raw_target_name)) AS m
    FROM spectroscopy_holdings WHERE match_status = 'skipped' AND trim(raw_target_name) <> ''),
  al AS (SELECT vote_id, archive_code, archive_obs_id, outcome, submitter, submitted_at FROM v JOIN sk USING (archive_code, k)
    WHERE m <= 5 OR outcome LIKE 'attach%'
    UNION ALL SELECT vote_id, archive_code, o, outcome, submitter, submitted_at FROM v WHERE k IS NULL)
  FROM al ANTI JOIN (SELECT DISTINCT archive_code, archive_obs_id, submitter FROM skip_classifications
    WHERE submitted_at < '2025-05-17') USING (archive_code, archive_obs_id, submitter)
    WHERE outcome IN ('attach_gaia_source', 'attach_bright_star', 'not_a_real_target', 'not_a_star', 'confirmed_absent_from_gaia')
    AND submitter IS NOT NULL AND submitted_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY archive_code, archive_obs_id, submitter ORDER BY vote_id) = 1""")
def m20(spark, d):
    existing = load(spark, d, "skip_classifications").filter("submitted_at < '2025-05-17'")
    return G.import_votes(vote_lines(spark, d), h(spark, d), existing, most=5)


@query("j09_name_join", f"WITH {RECORDS}, {NAMED} SELECT r.id, al.star_id FROM r JOIN al ON {key_sql('raw_target_name')} = k WHERE k <> ''")
def j09(spark, d):
    rows = records(spark, d).select("id", M.match_key(F.col("raw_target_name")).alias("key"))
    return rows.join(M.alias_table(s(spark, d)), "key").select("id", "star_id")


@query("st09_rate_limit", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 600 SECOND PRECEDING
    AND CURRENT ROW) AS calls FROM events""")
def st09(spark, d):
    from pyspark.sql import Window

    of = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-600_000_000, 0)
    ev = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.select("event_id", F.count(F.lit(1)).over(of).alias("calls"))



