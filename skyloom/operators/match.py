"""Matching observation records to catalogue stars: by id, by name, by place on the date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.functions.names import match_key
from skyloom.operators.skew import spread_join
from skyloom.session import cut

# Match radii in arcsec, by archive and instrument, and the one for all others.
RADIUS, NAME_RADIUS = 1.0, 600.0
RADII = {("noirlab", "chiron"): 60.0, ("eso", "FEROS"): 100.0}
# The faintest G magnitude an archive observes, and the one for all others.
FAINTEST = {
    "dao": 13.0, "lick": 15.1, "irtf_spex": 16.4, "asiago": 15.8, "irtf_legacy": 18.0, "cfht_cadc": 16.3, "eso_raw": 19.0, "gtc": 21.0,
    "eso": 19.2, "koa": 20.4, "mast": 19.5, "gemini": 20.3, "ing": 19.8, "noirlab": 19.4, "oirsa": 20.8,
}
FAINTEST_OTHER, MAG_LEAD, CLOSER = 18.0, 2.0, 3.0
MOTION = ["star_id", "ra", "dec", "ref_epoch", "pmra", "pmdec"]


def lookup(values: dict, keys: list[Column], other: float) -> Column:
    """A small table of fixed values as an expression."""
    out = F.lit(other)
    for key, value in values.items():
        same = F.lit(True)
        for col, k in zip(keys, key if isinstance(key, tuple) else (key,)):
            same = same & F.coalesce(col == k, F.lit(False))
        out = F.when(same, value).otherwise(out)
    return out


def match_radius(archive: Column, instrument: Column) -> Column:
    return lookup(RADII, [archive, instrument], RADIUS)


def faintest(archive: Column) -> Column:
    return lookup(FAINTEST, [archive], FAINTEST_OTHER)


def _cells(center: list[Column], reach: Column, size: Column) -> Column:
    """The grid cells (x, y, z) that a box about a unit vector touches, 1 to 8 of them if the cell is over twice the reach."""
    def ends(v: Column) -> Column:
        return F.array_distinct(F.array(F.floor((v - reach) / size), F.floor((v + reach) / size)))

    x, y, z = (ends(v) for v in center)
    return F.flatten(F.flatten(F.transform(x, lambda i: F.transform(y, lambda j: F.transform(z, lambda k: F.struct(i.alias("i"), j.alias("j"), k.alias("k")))))))


def _reach(radius_arcsec: float, first_year: float, last_year: float) -> Column:
    """How far, in arcsec, from its catalogue place a star may be within the radius of a target of those years."""
    drift = F.sqrt(F.pow(F.coalesce("pmra", F.lit(0.0)), 2) + F.pow(F.coalesce("pmdec", F.lit(0.0)), 2)) / 1000
    years = F.greatest(F.abs(F.lit(first_year) - F.col("ref_epoch")), F.abs(F.lit(last_year) - F.col("ref_epoch")))
    return F.lit(radius_arcsec) + drift * F.coalesce(years, F.lit(0.0))


POINTED, MOVING = ["_ux", "_uy", "_uz"], ["_sx", "_sy", "_sz", "_mx", "_my", "_mz", "_mm"]


def _pointed(targets: DataFrame) -> DataFrame:
    return targets.withColumns(dict(zip(POINTED, geo.unit_vector(F.col("t_ra"), F.col("t_dec")))))


def _moving(stars: DataFrame) -> DataFrame:
    return stars.withColumns(dict(zip(MOVING, geo.motion(*(F.col(c) for c in ("ra", "dec", "pmra", "pmdec"))))))


def _within(pairs: DataFrame, radius: Column) -> DataFrame:
    """The pairs of _pointed targets and _moving stars within radius, with sep_arcsec: all sines are taken before the join."""
    sep = geo.moved_separation([F.col(c) for c in POINTED], [F.col(c) for c in MOVING], F.col("t_year") - F.col("ref_epoch"))
    return pairs.withColumn("sep_arcsec", sep).filter(F.col("sep_arcsec") <= radius).drop(*POINTED, *MOVING)


def radial_pairs(targets: DataFrame, stars: DataFrame, most_arcsec: float, first_year: float, last_year: float) -> DataFrame:
    """targets joined to the stars within their own radius on their own date.

    targets: any columns with t_ra, t_dec, t_year (null: the star's catalogue place) and t_radius, at most
    most_arcsec; t_year lies between first_year and last_year. Stars as in MOTION and any others. Adds sep_arcsec.

    Each star is entered in the cells that its search radius and its own drift over those years touch, so one
    equi-join yields all candidates and the exact test decides. Stars that drift far use wider cells, by powers
    of 8; targets look into every width that occurs. No place on the sky is special, no pair comes twice."""
    arc = 1 / geo.ARCSEC
    reach = _reach(most_arcsec, first_year, last_year) * arc * 1.001 + 1e-12
    base = max(most_arcsec, 1.0) * arc * 4
    wide = F.greatest(F.lit(0), F.ceil(F.log(reach * 2.01 / base) / F.log(F.lit(8.0)))).cast("int")
    entered = stars.filter("ra IS NOT NULL AND dec IS NOT NULL").withColumns({"_reach": reach, "_w": wide})
    widths = [r[0] for r in entered.select("_w").distinct().orderBy("_w").collect()] or [0]  # a log of the sky's size, so few
    size = lambda w: F.lit(base) * F.pow(F.lit(8.0), w)
    catalogue = _moving(entered).withColumn("_c", F.explode(_cells(geo.unit_vector(F.col("ra"), F.col("dec")), F.col("_reach"), size(F.col("_w"))))).drop("_reach")
    u = [F.col(c) for c in POINTED]
    looked = _pointed(targets).withColumn("_w", F.explode(F.array(*[F.lit(w) for w in widths]))).withColumn(
        "_c", F.struct(*[F.floor(v / size(F.col("_w"))).alias(n) for v, n in zip(u, "ijk")])
    )
    pairs = spread_join(looked, catalogue, ["_w", "_c"]).drop("_w", "_c")
    return _within(pairs, F.col("t_radius"))


def alias_table(stars: DataFrame) -> DataFrame:
    """key, star_id: of stars that share a key the greatest id wins."""
    named = stars.select("star_id", F.explode("name_aliases").alias("alias")).filter("alias IS NOT NULL")
    return named.groupBy(match_key(F.col("alias")).alias("key")).agg(F.max("star_id").alias("star_id")).filter("key <> ''")


def match_records(records: DataFrame, stars: DataFrame, key: list[str]) -> DataFrame:
    """records with star_id, match_method, match_status and theta_arcsec.

    records: the key columns, unique, and archive_code, instrument, obs_date, gaia_source_id, ra, dec,
    raw_target_name. A record with a catalogue id is matched by it or skipped. Else a name known to the catalogue
    decides, unless the record's place is over 10 arcmin from the star on that date. Else the place decides: one
    star within the match radius is a match, several need review, none is skipped, or needs review if a name
    was turned down. Without a usable place and date the record is skipped."""
    year = geo.julian_year(F.col("obs_date"))
    own = records.withColumn("_year", year).withColumn("_placed", geo.usable(F.col("ra"), F.col("dec")) & F.col("obs_date").isNotNull())
    own = own.withColumn("_radius", match_radius(F.col("archive_code"), F.col("instrument"))).withColumn("_key", F.when(F.col("gaia_source_id").isNull(), match_key(F.col("raw_target_name"))))
    by_id = stars.filter("gaia_source_id IS NOT NULL").select("gaia_source_id", F.col("star_id").alias("_direct"))
    motion = stars.select(*[F.col(c).alias(f"n_{c}") for c in MOTION])
    named = alias_table(stars).join(motion, F.col("star_id") == F.col("n_star_id")).drop("star_id").withColumnRenamed("key", "_key")
    tried = spread_join(spread_join(own, by_id, ["gaia_source_id"], "left"), named, ["_key"], "left")
    star = geo.moved_vector(F.col("n_ra"), F.col("n_dec"), F.col("n_pmra"), F.col("n_pmdec"), F.col("_year") - F.col("n_ref_epoch"))
    far = F.coalesce(F.col("_placed") & (geo.vector_separation(geo.unit_vector(F.col("ra"), F.col("dec")), star) > NAME_RADIUS), F.lit(False))
    tried = tried.withColumn("_name_star", F.when(~far, F.col("n_star_id"))).withColumn("_turned", far & F.col("n_star_id").isNotNull()).drop(*[f"n_{c}" for c in MOTION])
    tried = cut(tried)  # read four times below
    rest = tried.filter(F.col("gaia_source_id").isNull() & F.col("_name_star").isNull() & F.col("_placed"))
    span = rest.agg(F.min("_year"), F.max("_year"), F.max("_radius")).first()
    found = radial_pairs(
        rest.select(*key, F.col("ra").alias("t_ra"), F.col("dec").alias("t_dec"), F.col("_year").alias("t_year"), F.col("_radius").alias("t_radius")),
        stars.select(*MOTION), span[2] or RADIUS, span[0] or 2016.0, span[1] or 2016.0,
    )
    best = found.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("sep_arcsec").alias("_theta"), F.min_by("star_id", "sep_arcsec").alias("_near"))
    joined = tried.join(best, key, "left")
    direct, by_name = F.col("gaia_source_id").isNotNull(), F.col("_name_star").isNotNull()
    n = F.coalesce("_n", F.lit(0))
    status = (
        F.when(direct, F.when(F.col("_direct").isNotNull(), "matched").otherwise("skipped")).when(by_name, "matched")
        .when(~F.col("_placed"), "skipped").when(n == 1, "matched").when((n > 1) | F.col("_turned"), "needs_review").otherwise("skipped")
    )
    method = F.when(direct, "direct_gaia_column").when(by_name, "name_resolved").otherwise("positional_easy_match")
    placed_only = ~direct & ~by_name
    return joined.select(
        *records.columns, F.when(direct, F.col("_direct")).when(by_name, F.col("_name_star")).when(n == 1, F.col("_near")).alias("star_id"),
        method.alias("match_method"), status.alias("match_status"), F.when(placed_only & (n > 0), F.col("_theta")).alias("theta_arcsec"),
    )


def pick_best(candidates: DataFrame, key: list[str], archive: str = "archive_code") -> DataFrame:
    """The candidate to believe in for every key, with the reason; winner is null where none is.

    candidates: key, archive, star_id, gaia_source_id, source_catalog, separation_arcsec, phot_g_mean_mag. Bright-catalogue
    stars win, the nearest of them. Else those not too faint for the archive count: a single one wins unless any
    other is over 3 times closer; of several the brightest wins if it leads by 2 mag and no other of them is over
    3 times closer. A group is what lies within the search radius of one place."""
    c = F.struct(F.col("separation_arcsec").alias("sep"), F.col("phot_g_mean_mag").alias("mag"), "star_id", "gaia_source_id", "source_catalog")
    all_ = candidates.groupBy(*key).agg(F.array_sort(F.collect_list(c)).alias("all"), F.max(faintest(F.col(archive))).alias("limit"))
    bright = F.filter("all", lambda x: x["source_catalog"] == "bsc5")
    fit = F.filter("all", lambda x: x["mag"] <= F.col("limit"))
    by_mag = F.array_sort(F.transform("fit", lambda x: F.struct(x["mag"].alias("mag"), x["sep"].alias("sep"), x["star_id"].alias("star_id"), x["gaia_source_id"].alias("gaia_source_id"), x["source_catalog"].alias("source_catalog"))))
    closer = lambda xs: F.exists(xs, lambda x: x["sep"] * CLOSER < F.col("w.sep"))
    sized = all_.withColumns({"bright": bright, "fit": fit}).withColumn("by_mag", by_mag).withColumn("w", F.get("by_mag", F.lit(0))).withColumn("n", F.size("fit"))
    lead = F.get("by_mag", F.lit(1))["mag"] - F.col("w.mag")
    reason = (
        F.when(F.size("bright") > 0, "bright catalogue").when(F.col("n") == 0, "all too faint")
        .when((F.col("n") == 1) & closer("all"), "a fainter one is much closer").when(F.col("n") == 1, "only one")
        .when(lead < MAG_LEAD, "lead too small").when(closer("by_mag"), "another is much closer").otherwise("brightest")
    )
    judged = sized.withColumn("reason", reason)
    fields = ["star_id", "gaia_source_id", "source_catalog", "sep", "mag"]
    pack = lambda x: F.struct(*[F.col(f"{x}.{f}") if isinstance(x, str) else x[f].alias(f) for f in fields])
    winner = F.when(F.col("reason") == "bright catalogue", pack(F.get("bright", F.lit(0)))).when(F.col("reason").isin("only one", "brightest"), pack("w"))
    return judged.select(*key, winner.alias("winner"), "reason")


def merge_candidates(tracked: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Candidates of both kinds; of one id the tracked one stays, and tracked ones without id all stay."""
    both = tracked.withColumn("_rank", F.lit(0)).unionByName(live.withColumn("_rank", F.lit(1)))
    order = Window.partitionBy(*key, "gaia_source_id").orderBy("_rank", "separation_arcsec")
    numbered = both.withColumn("_rn", F.row_number().over(order))
    return numbered.filter((F.col("_rn") == 1) | ((F.col("_rank") == 0) & F.col("gaia_source_id").isNull())).drop("_rn", "_rank")


def cone_search(df: DataFrame, ra: float, dec: float, radius_deg: float, limit: int | None = 200, cols: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """Rows within a cone, nearest first. The band of declination is a plain comparison, so it reaches the scan."""
    x, y = F.col(cols[0]), F.col(cols[1])
    sep = geo.cosine_separation_deg(x, y, F.lit(ra), F.lit(dec))
    inside = df.filter(y.between(dec - radius_deg, dec + radius_deg)).withColumn("sep_deg", sep).filter(F.col("sep_deg") <= radius_deg)
    return inside if limit is None else inside.orderBy("sep_deg").limit(limit)


def radius_simulation(targets: DataFrame, stars: DataFrame, radii: list[float], first_year: float, last_year: float) -> DataFrame:
    """For each radius, how many targets have no, one or several stars within it: one join at the largest."""
    pairs = radial_pairs(targets.withColumn("t_radius", F.lit(max(radii))), stars, max(radii), first_year, last_year)
    counts = pairs.groupBy("t_id").agg(*[F.count(F.when(F.col("sep_arcsec") <= r, 1)).alias(f"n{i}") for i, r in enumerate(radii)])
    hits = F.explode(F.array(*[F.struct(F.lit(r).alias("radius"), F.col(f"n{i}").alias("n")) for i, r in enumerate(radii)]))
    some = counts.select(hits.alias("x")).groupBy("x.radius").agg(F.count(F.when(F.col("x.n") == 1, 1)).alias("one"), F.count(F.when(F.col("x.n") > 1, 1)).alias("many"))
    total = targets.agg(F.count(F.lit(1)).alias("total"))
    base = targets.sparkSession.createDataFrame([(float(r),) for r in radii], "radius double")
    return base.join(some, "radius", "left").crossJoin(total).select(
        "radius", (F.col("total") - F.coalesce("one", F.lit(0)) - F.coalesce("many", F.lit(0))).alias("none"), F.coalesce("one", F.lit(0)).alias("one"), F.coalesce("many", F.lit(0)).alias("many")
    )


def pixel_pairs(targets: DataFrame, pool: DataFrame, radius_arcsec: float, first_year: float, last_year: float) -> DataFrame:
    """targets (t_ra, t_dec, t_year and any others) with the catalogue sources within the radius on their date, by
    nested pixels. pool: source_id, ra, dec, ref_epoch, pmra, pmdec and others; t_year lies between the two years.

    Each source is entered in its pixel and the ring around it, of a level whose pixels are wider than the radius and the
    source's own drift over those years; every target looks into its own pixel at each level that occurs. Sources that
    drift far use levels with pixels 8 times as wide, and 8 times again; beyond the widest, one pixel is the sky."""
    deepest = geo.ring_level(2 * radius_arcsec)
    levels = [*range(deepest, -1, -3), -1]
    reach = _reach(radius_arcsec, first_year, last_year)
    level = F.lit(-1)
    for n in reversed(levels[:-1]):
        level = F.when(reach <= geo.ring_width(n), n).otherwise(level)
    entered = pool.filter("ra IS NOT NULL AND dec IS NOT NULL").filter(~F.isnan(reach)).withColumn("_level", level)
    entered = _moving(entered)
    occur = [r[0] for r in entered.select("_level").distinct().orderBy("_level").collect()] or [deepest]  # at most as many as levels
    ringed = [
        geo.with_rings(entered.filter(F.col("_level") == n).withColumn("_own", geo.healpix(F.col("ra"), F.col("dec"), n)), "_own", "_pixel", n).drop("_own")
        if n >= 0 else entered.filter(F.col("_level") == n).withColumn("_pixel", F.lit(0).cast("bigint"))
        for n in occur
    ]
    finest = geo.healpix(F.col("t_ra"), F.col("t_dec"), deepest)
    own = F.array(*[F.struct(F.lit(n).alias("_level"), (F.shiftright("_pixel", 2 * (deepest - n)) if n >= 0 else F.lit(0).cast("bigint")).alias("_pixel")) for n in occur])
    looked = _pointed(targets).withColumn("_pixel", finest).withColumn("_at", F.explode(own)).drop("_pixel").select("*", "_at._level", "_at._pixel").drop("_at")
    pairs = spread_join(looked, reduce(DataFrame.unionByName, ringed), ["_level", "_pixel"]).drop("_level", "_pixel")
    return _within(pairs, F.lit(radius_arcsec))


def brightest_match(targets: DataFrame, pool: DataFrame, first_year: float, last_year: float, radius_arcsec: float = 15.0, net_arcsec: float = 300.0, most_fainter: float = 3.0) -> DataFrame:
    """t_id, star_id, sep_arcsec: for each bright target (t_id, t_ra, t_dec, t_year, t_mag) the brightest star of pool within the
    radius on the target's date, of those that the catalogue lists within the net about it, unless it is more than
    most_fainter magnitudes fainter than the target. Stars without a magnitude take no part; a target without one takes
    the brightest as it is."""
    pairs = radial_pairs(targets.withColumn("t_radius", F.lit(radius_arcsec)), pool.filter("phot_g_mean_mag IS NOT NULL"), radius_arcsec, first_year, last_year)
    listed = geo.vector_separation(geo.unit_vector(F.col("t_ra"), F.col("t_dec")), geo.unit_vector(F.col("ra"), F.col("dec")))
    best = pairs.filter(listed <= net_arcsec).groupBy("t_id").agg(F.max("t_mag").alias("t_mag"), F.min_by(F.struct("star_id", "sep_arcsec", "phot_g_mean_mag"), F.struct("phot_g_mean_mag", "star_id")).alias("b"))
    return best.filter(F.coalesce(F.col("b.phot_g_mean_mag") <= F.col("t_mag") + most_fainter, F.lit(True))).select("t_id", "b.star_id", "b.sep_arcsec")


def _rivals(stars: DataFrame, pool: DataFrame, first_year: float, last_year: float, radius_arcsec: float) -> DataFrame:
    """The tracked stars (_rank 0) and the pool's sources (_rank 1) that can decide a fallback match, cut, as MOTION, gaia_source_id,
    source_catalog and phot_g_mean_mag. _free says that no target can have another candidate of the same id.

    Sources that share place, epoch and motion are equally far from any target. Of those with one id the tracked one stays; of
    the free ones with any ids the two brightest and the first of the bright catalogue, which alone decide in pick_best."""
    cols = [*MOTION, "gaia_source_id", "source_catalog", "phot_g_mean_mag"]
    live = pool.withColumnRenamed("source_id", "gaia_source_id").withColumns({"star_id": F.lit(None).cast("bigint"), "source_catalog": F.lit("gaia_untracked")})
    both = stars.select(*cols, F.lit(0).alias("_rank")).unionByName(live.select(*cols, F.lit(1).alias("_rank")))
    both = both.filter("ra IS NOT NULL AND dec IS NOT NULL").filter(_reach(radius_arcsec, first_year, last_year) < float("inf"))  # nor NaN
    place = MOTION[1:]
    alike = Window.partitionBy("gaia_source_id", *place).orderBy("_rank", "star_id", "phot_g_mean_mag")
    known = both.filter("gaia_source_id IS NOT NULL").repartition("gaia_source_id").withColumn("_rn", F.row_number().over(alike)).filter("_rn = 1").drop("_rn")
    known = known.withColumn("_free", F.count(F.lit(1)).over(Window.partitionBy("gaia_source_id")) == 1)
    both = known.unionByName(both.filter("gaia_source_id IS NULL").withColumn("_free", F.col("_rank") == 0))
    here = Window.partitionBy("_free", *place)
    bright = F.coalesce(F.col("source_catalog") == "bsc5", F.lit(False))
    ranked = both.withColumns({
        "_by_mag": F.row_number().over(here.orderBy(F.asc_nulls_last("phot_g_mean_mag"), "star_id", "gaia_source_id")),
        "_by_catalog": F.row_number().over(here.orderBy(F.desc(bright), "phot_g_mean_mag", "star_id", "gaia_source_id")),
    })
    return cut(ranked.filter("NOT _free OR _by_mag <= 2 OR _by_catalog = 1").drop("_by_mag", "_by_catalog"))


def fallback_match(targets: DataFrame, stars: DataFrame, pool: DataFrame, first_year: float, last_year: float, radius_arcsec: float = 60.0) -> DataFrame:
    """A guess for records that nothing else matched, always for review: t_id, star_id or the gaia_source_id of a
    source not yet in the catalogue, theta_arcsec and the reason. Tracked stars and the pool's sources compete."""
    cols = ["t_id", "archive_code", "star_id", "gaia_source_id", "source_catalog", F.col("sep_arcsec").alias("separation_arcsec"), "phot_g_mean_mag"]
    rivals = _rivals(stars, pool, first_year, last_year, radius_arcsec)
    looked = targets.withColumn("t_radius", F.lit(radius_arcsec))
    near = radial_pairs(looked, rivals.filter("_free").drop("_free", "_rank"), radius_arcsec, first_year, last_year).select(*cols)
    if not rivals.filter("NOT _free").isEmpty():
        # tracked stars without id outdo sources without id, and are candidates already
        shared = radial_pairs(looked, rivals.filter("NOT _free OR gaia_source_id IS NULL"), radius_arcsec, first_year, last_year)
        tracked, live = (shared.filter(F.col("_rank") == n).select(*cols, "_free") for n in (0, 1))
        near = near.unionByName(merge_candidates(tracked, live, ["t_id"]).filter("NOT _free").drop("_free"))
    best = pick_best(near, ["t_id"])
    return best.select("t_id", F.col("winner.star_id").alias("star_id"), F.col("winner.gaia_source_id").alias("gaia_source_id"), F.col("winner.sep").alias("theta_arcsec"), "reason")
