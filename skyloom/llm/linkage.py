"""Matching observation rows to catalogue stars that share no key.

Candidates come from blocking by MinHash, one blocking for all attributes. Each attribute of a row or star is a set of
shingles, signed by bands of minima over hashed shingles, and what shares a band with it is a candidate:

a name: its trigrams,
a designation with numbers: its numbers, and each number with the token before and after it,
a place and a date: the cells of GRIDS shifted grids on the sky that hold the position. A star moves, so it is signed where
it is on as many dates of the years observed as it takes to be never further than DRIFT of a cell from one of them.

Nothing else is compared, and frequent bands are spread over tasks. Pairs get features: whether there is a name and a
place, the weighted edit distance of the names, the separation on the date of the observation under the best of the
conventions (degrees, radians). A logistic model is fitted
to weak labels, the stars that an earlier matcher gave to at most `label_rows` rows; a third of them is held out
to calibrate its probabilities. A row's best candidate is reported if its probability is at least 1/2 and it
alone passes the exact limits on name and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.llm.spelling import SAMPLED, _costs, _parse_reference, parse, plausible
from skyloom.operators.skew import spread_join
from skyloom.session import cut

#: bands and minima in each, by attribute
SIGNED = {"name": (48, 3), "code": (4, 1), "place": (8, 2)}
GRAM, GRIDS, DRIFT = 3, 12, 1 / 48
STAR = ["star_id", "gaia_source_id", "ra", "dec", "ref_epoch", "pmra", "pmdec"]
FEATURES = ["one", "named", "edit", "placed", "apart", "named_apart", "undated"]


def shingles(form: str, key: str) -> set[str]:
    """Of a typed or listed value, as parse() gives it."""
    if form in ("code", "mixed"):
        tokens = ["", *key.split(" "), ""]
        numbers = [i for i, t in enumerate(tokens) if t[:1].isdigit() or t[:1] == "+"]
        if not numbers:
            return {key}
        return {tokens[i] for i in numbers} | {f"{tokens[i - 1]} {tokens[i]}" for i in numbers if tokens[i - 1]} | {f"{tokens[i]} {tokens[i + 1]}" for i in numbers if tokens[i + 1]}
    s = f"^{key.replace(' ', '')}$"
    return {s[i : i + GRAM] for i in range(max(1, len(s) - GRAM + 1))}


def signatures(hashed: np.ndarray, kind: str) -> np.ndarray:
    """(sets, bands) hashes of the minima of each row of `hashed`, the shingles of a set, any of them repeated."""
    bands, rows = SIGNED[kind]
    rng = np.random.default_rng(20)
    flip, factor = (rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) for _ in range(2))
    factor |= np.uint64(1)
    least = np.full((len(hashed), bands * rows), ~np.uint64(0))
    for column in hashed.T:
        np.minimum(least, (column[:, None] ^ flip) * factor, out=least)
    tag = (np.arange(bands, dtype=np.uint64) + np.uint64(1000 * list(SIGNED).index(kind))) * np.uint64(0x9E3779B97F4A7C15)
    return ((least.reshape(len(hashed), bands, rows) * factor[:rows]).sum(axis=2) ^ tag).view(np.int64)


def key_signatures(forms: list[str], keys: list[str], kind: str) -> np.ndarray:
    sets = [[xxhash.xxh64_intdigest(x) for x in shingles(f, k)] for f, k in zip(forms, keys)]
    width = max(map(len, sets), default=1)
    return signatures(np.array([s + s[:1] * (width - len(s)) for s in sets], np.uint64).reshape(-1, width), kind)


def _kind(form: str) -> str:
    return "code" if form in ("code", "mixed") else "name"


def _sign_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """form, key to key, band."""
    for b in batches:
        forms, keys = (b.column(i).to_pylist() for i in range(2))
        for kind in ("name", "code"):
            mine = [i for i, f in enumerate(forms) if _kind(f) == kind]
            for at in range(0, len(mine), 5000):
                part = mine[at : at + 5000]
                bands = key_signatures([forms[i] for i in part], [keys[i] for i in part], kind)
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(np.repeat(part, bands.shape[1]))), pa.array(bands.ravel())], names=["key", "band"])


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("raw_target_name")
        found = [parse(v) or (None, None) for v in b.column(at).to_pylist()]
        columns = [c for i, c in enumerate(b.columns) if i != at]
        names = [n for i, n in enumerate(b.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([f for f, _ in found], pa.string()), pa.array([k for _, k in found], pa.string())], names=[*names, "form", "key"])


def name_candidates(typed: DataFrame, listed: DataFrame) -> DataFrame:
    """key, entry and cost of the list entries like each distinct typed (form, key). All numbers of both agree."""
    parts = max(int(typed.sparkSession.conf.get("spark.sql.shuffle.partitions")), typed.sparkSession.sparkContext.defaultParallelism)
    # partitioned by number, so that few small rows are not put into one task before they are multiplied
    keys, entries = (df.select("form", "key").distinct().repartition(parts, "key") for df in (typed.filter("key IS NOT NULL"), listed))
    asked, some, names = (df.mapInArrow(_sign_keys, "key string, band bigint") for df in (keys, keys.filter(F.pmod(F.xxhash64("key"), F.lit(SAMPLED)) == 0), entries))
    met = spread_join(asked.withColumnRenamed("key", "typed"), names.withColumnRenamed("key", "entry"), ["band"], counted=(some, 1 / SAMPLED))
    pairs = met.filter(plausible(F.col("typed"), F.col("entry"))).select("typed", "entry").distinct()
    return pairs.mapInArrow(_costs, "typed string, entry string, cost double").withColumnRenamed("typed", "key")


def place_signatures(ra: np.ndarray, dec: np.ndarray, cell: float) -> np.ndarray:
    """Bands of positions in degrees, over GRIDS grids with cells of `cell` degrees, shifted against each other."""
    rng = np.random.default_rng(21)
    hashed = []
    for grid, (up, along) in enumerate(rng.random((GRIDS, 2))):
        row = np.floor((dec + 90) / cell + up)
        columns = np.maximum(1, np.floor(360 * np.cos(np.radians(np.clip((row + 0.5 - up) * cell - 90, -90, 90))) / cell))
        column = np.floor(ra % 360 / 360 * columns + along) % columns
        x = (row.astype(np.uint64) << np.uint64(32)) + column.astype(np.uint64) + np.uint64(grid << 58)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        hashed.append((x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB))
    return signatures(np.stack(hashed, axis=1), "place")


def _with_bands(b: pa.RecordBatch, at: np.ndarray, ra: np.ndarray, dec: np.ndarray, cell: float) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(at), 20_000):
        bands = place_signatures(ra[k : k + 20_000], dec[k : k + 20_000], cell)
        rows = np.repeat(at[k : k + 20_000], bands.shape[1])
        yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows)).columns, pa.array(bands.ravel())], names=[*b.schema.names, "band"])


def _sign_rows(cell: float):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ra, dec = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("at_ra", "at_dec"))
            yield from _with_bands(b, np.arange(len(ra)), ra, dec, cell)

    return sign


def _sign_stars(first: float, last: float, cell: float):
    """Stars with the bands of all places where they are in the years first to last. A path across a pole is followed by its
    unit vector."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ra, dec, epoch, pmra, pmdec = (np.nan_to_num(b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float)) for c in ("ra", "dec", "ref_epoch", "pmra", "pmdec"))
            steps = np.maximum(1, np.ceil(np.hypot(pmra, pmdec) / 3.6e6 * (last - first) / (2 * DRIFT * cell))).astype(np.int64)
            at = np.repeat(np.arange(len(ra)), steps)
            k = np.arange(len(at)) - np.repeat(np.cumsum(steps) - steps, steps)
            years = first + (k + 0.5) / steps[at] * (last - first) - epoch[at]
            a, d = np.radians(ra[at]), np.radians(dec[at])
            e, n = (np.radians(x[at] / 3.6e6) * years for x in (pmra, pmdec))
            v = [np.cos(d) * np.cos(a) - np.sin(a) * e - np.sin(d) * np.cos(a) * n, np.cos(d) * np.sin(a) + np.cos(a) * e - np.sin(d) * np.sin(a) * n, np.sin(d) + np.cos(d) * n]
            yield from _with_bands(b, at, np.degrees(np.arctan2(v[1], v[0])) % 360, np.degrees(np.arctan2(v[2], np.hypot(v[0], v[1]))), cell)

    return sign


def places(ra: Column, dec: Column) -> Column:
    """The positions that a typed pair may mean, as array of (ra, dec) in degrees: as degrees, and as radians where it
    can be. Placeholders (both 0), missing and impossible values mean none."""
    good = geo.usable(ra, dec) & F.coalesce((F.abs(ra) <= 360) & ~((ra == 0) & (dec == 0)), F.lit(False))
    degrees = F.struct(F.pmod(ra, F.lit(360.0)).alias("ra"), dec.alias("dec"))
    radians = F.struct(F.pmod(F.degrees(ra), F.lit(360.0)).alias("ra"), F.degrees(dec).alias("dec"))
    as_radians = F.coalesce(good & ra.between(-3.1416, 6.2832) & dec.between(-1.5708, 1.5708), F.lit(False))
    none = F.array().cast("array<struct<ra:double,dec:double>>")
    return F.when(as_radians, F.array(degrees, F.when(F.abs(F.degrees(dec)) <= 90, radians).otherwise(degrees))).when(good, F.array(degrees)).otherwise(none)


def apart(place_list: Column) -> Column:
    """Arcseconds between the star of the pair on the row's date and the nearest of the row's places; null without."""
    star = geo.moved_vector(F.col("ra"), F.col("dec"), F.col("pmra"), F.col("pmdec"), F.col("year") - F.col("ref_epoch"))
    distances = F.transform(place_list, lambda p: geo.vector_separation(geo.unit_vector(p["ra"], p["dec"]), star))
    return F.array_min(distances)


def features(pairs: DataFrame) -> DataFrame:
    log = F.log10(F.least(F.col("sep"), F.lit(648000.0)) + 0.1)
    placed, named = F.col("sep").isNotNull().cast("double"), F.col("cost").isNotNull().cast("double")
    return pairs.withColumns(
        {
            "one": F.lit(1.0), "named": named, "edit": F.coalesce("cost", F.lit(0.0)), "placed": placed, "apart": F.coalesce(log, F.lit(0.0)),
            "named_apart": named * F.coalesce(log, F.lit(0.0)), "undated": F.col("year").isNull().cast("double"),
        }
    )


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights by Newton steps on the penalised likelihood."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(x: np.ndarray, y: np.ndarray, held_out: np.ndarray) -> np.ndarray | None:
    """Weights whose sigmoid is calibrated: the model is fitted to two thirds, and its score scaled and shifted to
    the rest. None where fewer than 50 labels, or labels of one kind, are no ground for a probability."""
    if len(y) < 50 or y.min() == y.max():
        return None
    w = fit_logistic(x[~held_out], y[~held_out])
    if len(np.unique(y[held_out])) < 2:
        return w
    score = x[held_out] @ w
    shift, scale = fit_logistic(np.stack([np.ones_like(score), score], axis=1), y[held_out])
    w = w * max(scale, 0.05)
    w[0] += shift
    return w


def link_rows(
    holdings: DataFrame, stars: DataFrame, label_rows: int = 20_000, name_limit: float = 600.0, place_limit: float = 2.0, earliest_year: float = 1900.0,
    cell_arcsec: float = 240.0,
) -> DataFrame:
    """id, star_id, gaia_source_id, confidence, sep_arcsec, name_cost of every row of holdings without star_id whose
    star is found and has a gaia_source_id.

    A row that names a known star is matched by the name if no other star's name is as near, and if none of its
    places is usable or one is within name_limit arcsec of the star. A row without such a name is matched by its
    place if it has a date and just one star is within place_limit. Null, empty or unknown names are no names;
    dates before earliest_year are placeholders and count as null. Repeated rows are matched each; ids and stars
    that are null are left out. Empty tables give no rows. Other columns aren't read. cell_arcsec is the size of the
    cells that shingle places, many times place_limit; the denser the catalogue, the smaller. Without enough labels for
    a model confidence is null, and the exact limits alone decide."""
    spark = holdings.sparkSession
    cols = ["id", "star_id", "match_status", "raw_target_name", "raw_ra", "raw_dec", "obs_date"]
    labelled = F.col("star_id").isNotNull() & F.coalesce(F.col("match_status") == "matched", F.lit(False))
    year = geo.julian_year(F.col("obs_date"))
    base = holdings.select(*cols).filter("id IS NOT NULL")
    n = base.filter(labelled).count()
    share = min(1.0, label_rows / max(n, 1))
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    taken = base.filter(F.col("star_id").isNull() | (labelled & (u < share))).select(
        "id", F.col("star_id").alias("known"), "raw_target_name", F.when(year >= earliest_year, year).alias("year"),
        places(F.col("raw_ra").cast("double"), F.col("raw_dec").cast("double")).alias("places"),
    )
    schema = "id bigint, known bigint, year double, places array<struct<ra:double,dec:double>>, form string, key string"
    rows = taken.select("id", "known", "year", "places", "raw_target_name").mapInArrow(_parse_rows, schema)
    rows = cut(rows.filter("key IS NOT NULL OR size(places) > 0"))
    catalogue = stars.select(*STAR).filter("star_id IS NOT NULL AND ra IS NOT NULL AND dec IS NOT NULL")
    aliases = stars.select("star_id", F.explode("name_aliases").alias("alias")).filter("alias IS NOT NULL AND star_id IS NOT NULL")
    listed = aliases.distinct().select("alias", "star_id", F.lit(1).cast("bigint").alias("n")).mapInArrow(
        _parse_reference, "entry string, star_id bigint, n bigint, form string, key string"
    ).select("form", "key", "star_id").distinct()
    near = name_candidates(rows, listed)
    named = near.join(listed.select(F.col("key").alias("entry"), "star_id"), "entry").groupBy("key", "star_id").agg(F.min("cost").alias("cost"))
    ranked = Window.partitionBy("key").orderBy("cost", "star_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rival = F.when(F.col("star_id") == F.first("star_id").over(ranked), F.nth_value("cost", 2).over(ranked)).otherwise(F.first("cost").over(ranked))
    by_name = named.withColumn("rival", rival).join(catalogue, "star_id")
    with_names = cut(spread_join(rows.drop("form"), by_name, ["key"], "left").withColumn("sep", apart(F.col("places"))))
    unnamed = with_names.filter("star_id IS NULL AND size(places) > 0 AND year IS NOT NULL").select("id", "known", "year", "places")
    span = unnamed.agg(F.min("year"), F.max("year")).first()
    first, last = (span[0], span[1]) if span[0] is not None else (2016.0, 2016.0)
    cell = cell_arcsec / 3600
    placed = unnamed.select("id", "known", "year", F.explode("places").alias("p")).select("id", "known", "year", F.col("p.ra").alias("at_ra"), F.col("p.dec").alias("at_dec"))
    row_schema = "id bigint, known bigint, year double, at_ra double, at_dec double, band bigint"
    signed_rows, some = (df.mapInArrow(_sign_rows(cell), row_schema) for df in (placed, placed.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0)))
    star_schema = "star_id bigint, gaia_source_id bigint, ra double, dec double, ref_epoch double, pmra double, pmdec double, band bigint"
    signed_stars = catalogue.mapInArrow(_sign_stars(first, last, cell), star_schema)
    star = geo.moved_vector(*(F.col(c) for c in ("ra", "dec", "pmra", "pmdec")), F.col("year") - F.col("ref_epoch"))
    sep = F.min(geo.vector_separation(geo.unit_vector(F.col("at_ra"), F.col("at_dec")), star)).alias("sep")  # of several bands and conventions
    near_by = spread_join(signed_rows, signed_stars, ["band"], counted=(some, 1 / SAMPLED)).groupBy("id", "known", "year", "star_id", "gaia_source_id").agg(sep)
    by_place = near_by.filter(F.col("sep") <= cell_arcsec).withColumns({"cost": F.lit(None).cast("double"), "rival": F.lit(None).cast("double")})
    shared = ["id", "known", "year", "star_id", "gaia_source_id", "sep", "cost", "rival"]
    pairs = cut(features(with_names.filter("star_id IS NOT NULL").select(*shared).unionByName(by_place.select(*shared))))
    sample = pairs.filter("known IS NOT NULL").select("id", (F.col("known") == F.col("star_id")).cast("double").alias("y"), *FEATURES).toPandas()
    sample = sample.sort_values(["id", *FEATURES])
    held = sample.id.to_numpy() % 3 == 0
    weights = train(sample[FEATURES].to_numpy(float), sample.y.to_numpy(float), held)
    score = F.lit(None).cast("double") if weights is None else sum((F.col(f) * float(w) for f, w in zip(FEATURES, weights)), F.lit(0.0))
    by_names = F.col("cost").isNotNull()
    fits = F.when(by_names, F.coalesce(F.col("sep") <= name_limit, F.lit(True))).otherwise(F.col("sep") <= place_limit)
    clear = F.coalesce(~by_names | F.col("rival").isNull() | (F.col("cost") + 0.15 < F.col("rival")), F.lit(True))
    judged = pairs.filter("known IS NULL").withColumns({"confidence": 1 / (1 + F.exp(-score)), "fits": fits, "clear": clear})
    best = judged.filter("fits").groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(by_names.cast("int")).alias("n_named"),
        F.max_by(F.struct("star_id", "gaia_source_id", "confidence", "sep", "cost", "clear"), F.struct(F.coalesce("confidence", F.lit(0.0)), -F.coalesce("cost", F.lit(0.0)), -F.col("star_id"))).alias("b"),
    )
    sure = best.filter("b.clear AND coalesce(b.confidence, 1) >= 0.5 AND b.gaia_source_id IS NOT NULL AND (n = 1 OR n_named > 0)")
    return sure.select("id", "b.star_id", "b.gaia_source_id", "b.confidence", F.col("b.sep").alias("sep_arcsec"), F.col("b.cost").alias("name_cost"))
