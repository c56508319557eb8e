"""Upserts, reconciliation, catalogue growth and votes, as plans that give the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions.names import group_key, match_key
from skyloom.functions.text import fixed_width
from skyloom.operators.match import radial_pairs
from skyloom.session import cut
from skyloom.sources.tables import Snapshots

KEY = ["archive_code", "archive_obs_id"]
# The outcomes a vote may have, and those that a vote by name may give to any number of rows.
OUTCOMES = ["attach_gaia_source", "attach_bright_star", "not_a_real_target", "not_a_star", "confirmed_absent_from_gaia"]
UNCAPPED = ["attach_gaia_source", "attach_bright_star"]


def upsert(existing: DataFrame, batch: DataFrame, order: list[Column]) -> DataFrame:
    """existing with the rows of batch put in by KEY. A key's last row in `order` wins, batch over existing; it keeps
    the earliest first_seen_at and, if it existed, its id. New rows get ids after the greatest. A missing
    reduction_status becomes 'unknown'."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    of = Window.partitionBy(*KEY)
    last = of.orderBy(F.col("_new").desc(), *[c.desc_nulls_last() for c in order])
    kept = (
        both.withColumns({"_rn": F.row_number().over(last), "_seen": F.min("first_seen_at").over(of), "_id": F.min(F.when(F.col("_new") == 0, F.col("id"))).over(of)})
        .filter("_rn = 1").withColumns({"first_seen_at": F.col("_seen"), "id": F.col("_id"), "reduction_status": F.coalesce("reduction_status", F.lit("unknown"))})
    )
    return kept.select(*existing.columns)


def assign_ids(df: DataFrame, column: str, order: list[str], chunks: int = 4096, above: int = 0) -> DataFrame:
    """Fills null ids with numbers after the greatest, and after `above` where df is a part of a table, in a repeatable
    order and without one global window: rows are numbered within hash parts, and each part starts where the parts
    before it end."""
    part = F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int")
    new = df.filter(F.col(column).isNull()).withColumn("_part", part)
    sizes = new.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = df.agg(F.greatest(F.coalesce(F.max(column), F.lit(0)), F.lit(above)).alias("_top"))
    numbered = new.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(sizes.select("_part", "_start")), "_part").crossJoin(F.broadcast(top))
    filled = numbered.withColumn(column, F.col("_top") + F.col("_start") + F.col("_rn")).select(*df.columns)
    return df.filter(F.col(column).isNotNull()).unionByName(filled)


def write_merged(table: Snapshots, batch: DataFrame, order: list[Column]) -> None:
    """Upserts batch into the table: only the touched archives are read and replaced, all at once. New ids follow the
    greatest that any archive has."""
    batch = cut(batch)
    touched = [r[0] for r in batch.select(table.part).distinct().collect()]
    if touched:
        table.replace(cut(assign_ids(upsert(table.read(touched), batch, order), table.key, KEY, above=table.top())), touched)


def superseded(holdings: DataFrame, votes: DataFrame, raw: str, reduced: str) -> DataFrame:
    """Matched rows of the raw archive whose star, instrument and date the reduced archive has too and that no
    vote refers to. A null never equals anything."""
    same = ["star_id", "instrument", "obs_date"]
    matched = holdings.filter("match_status = 'matched'")
    better = matched.filter(F.col("archive_code") == reduced).select(*same).distinct()
    victims = matched.filter(F.col("archive_code") == raw).join(better, same, "left_semi")
    return victims.join(votes.select(*KEY), KEY, "left_anti")


def reconcile_raw(holdings: DataFrame, votes: DataFrame, raw: str, reduced: str) -> DataFrame:
    return holdings.join(superseded(holdings, votes, raw, reduced).select("id"), "id", "left_anti")


def update_from(df: DataFrame, updates: DataFrame, key: list[str], column: str, guard: Column) -> DataFrame:
    """df with `column` from updates where the key is there and the guard holds."""
    new = updates.select(*key, F.col(column).alias("_new"))
    joined = df.join(new, key, "left")
    return joined.withColumn(column, F.when(guard & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(column))).select(*df.columns)


def add_stars(stars: DataFrame, found: DataFrame) -> DataFrame:
    """stars with those of found (gaia_source_id, name_aliases and any other columns) that are new, and with the
    aliases of the known ones joined, known aliases first. Several rows of one id are one star."""
    lists = found.groupBy("gaia_source_id").agg(F.array_distinct(F.flatten(F.array_sort(F.collect_set("name_aliases")))).alias("_more"))
    merged = stars.join(lists, "gaia_source_id", "left").withColumn(
        "name_aliases", F.when(F.col("_more").isNull(), F.col("name_aliases")).otherwise(F.array_distinct(F.concat(F.coalesce("name_aliases", F.array().cast("array<string>")), F.col("_more"))))
    )
    one = found.withColumn("_rn", F.row_number().over(Window.partitionBy("gaia_source_id").orderBy(F.size("name_aliases").desc()))).filter("_rn = 1").drop("_rn", "name_aliases")
    new = one.join(lists.withColumnRenamed("_more", "name_aliases"), "gaia_source_id").join(stars.select("gaia_source_id"), "gaia_source_id", "left_anti")
    whole = merged.select(*stars.columns).unionByName(new.withColumn("source_catalog", F.lit("gaia")).select(*[c for c in [*new.columns, "source_catalog"] if c in stars.columns]), allowMissingColumns=True)
    return assign_ids(whole, "star_id", ["gaia_source_id"])


def resolve_id(identifiers: Column, prefix: str) -> Column:
    """The number after prefix among identifiers joined by |, such as 'Gaia DR3 ' or 'HR '."""
    tokens = F.transform(F.split(identifiers, r"\|"), lambda x: F.trim(x))
    hits = F.filter(tokens, lambda x: x.startswith(prefix))
    return F.get(hits, F.lit(0)).substr(F.lit(len(prefix) + 1), F.lit(30)).try_cast("bigint")


def is_star(kind: Column) -> Column:
    """Whether a resolver's object type, such as 'V*' or 'PM*', is a star's."""
    return F.coalesce(F.trim(kind).endswith("*"), F.lit(False))


def resolve_names(asked: DataFrame, catalogue: DataFrame, pool: DataFrame, radius_arcsec: float = 3.0) -> DataFrame:
    """name, gaia_source_id and how ('identifier', 'place' or null) for every name asked (column name).

    catalogue: name, identifiers (joined by |), kind, ra, dec. Only stars count. A star whose identifiers hold a catalogue
    id has that; else the one source of pool (source_id, ra, dec) within the radius of it, if there is just one."""
    known = catalogue.filter(is_star(F.col("kind"))).select("name", resolve_id(F.col("identifiers"), "Gaia DR3 ").alias("_id"), "ra", "dec")
    one = known.groupBy("name").agg(F.min_by(F.struct("_id", "ra", "dec"), F.struct(F.col("_id").isNull(), "_id", "ra", "dec")).alias("k")).select("name", "k.*")
    found = asked.select("name").distinct().join(one, "name", "left")
    open_ = found.filter("_id IS NULL AND ra IS NOT NULL AND dec IS NOT NULL").select("name", F.col("ra").alias("t_ra"), F.col("dec").alias("t_dec"), F.lit(None).cast("double").alias("t_year"), F.lit(radius_arcsec).alias("t_radius"))
    still = pool.select(F.col("source_id"), "ra", "dec", F.lit(2016.0).alias("ref_epoch"), F.lit(0.0).alias("pmra"), F.lit(0.0).alias("pmdec"))
    near = radial_pairs(open_, still, radius_arcsec, 2016.0, 2016.0).groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("source_id").alias("_near"))
    return found.join(near, "name", "left").select(
        "name", F.coalesce("_id", F.when(F.col("_n") == 1, F.col("_near"))).alias("gaia_source_id"),
        F.when(F.col("_id").isNotNull(), "identifier").when(F.col("_n") == 1, "place").alias("how"),
    )


def discover_stars(records: DataFrame, stars: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, counters) of a batch: stars of pool (gaia_source_id, name_aliases and any others) that its records name by
    id, or by a name where they have none, and that the catalogue lacks. Counters: direct, named, known and new ids."""
    ids = records.filter("gaia_source_id IS NOT NULL").select("gaia_source_id").distinct().withColumn("how", F.lit("direct"))
    names = records.filter("gaia_source_id IS NULL").select(match_key(F.col("raw_target_name")).alias("_key")).filter("_key <> ''").distinct()
    listed = pool.select("gaia_source_id", F.explode("name_aliases").alias("alias")).filter("alias IS NOT NULL").groupBy(match_key(F.col("alias")).alias("_key")).agg(F.max("gaia_source_id").alias("gaia_source_id"))
    named = listed.join(names, "_key", "left_semi").select("gaia_source_id").distinct().withColumn("how", F.lit("named"))
    wanted = ids.unionByName(named).groupBy("gaia_source_id").agg(F.min("how").alias("how"))
    tracked = stars.filter("gaia_source_id IS NOT NULL").select("gaia_source_id").distinct().withColumn("_tracked", F.lit(True))
    judged = wanted.join(tracked, "gaia_source_id", "left")
    found = pool.join(judged.filter("_tracked IS NULL").select("gaia_source_id", "how"), "gaia_source_id")
    counters = judged.agg(
        F.count(F.when(F.col("how") == "direct", 1)).alias("direct"), F.count(F.when(F.col("how") == "named", 1)).alias("named"),
        F.count("_tracked").alias("known"), F.count(F.when(F.col("_tracked").isNull(), 1)).alias("new"),
    )
    return found, counters


def upsert_stars(stars: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """stars with the rows of found (unique by key, gaia_source_id or bsc_hr_number): a known star takes found's values, but
    keeps its id and what found leaves null, such as the name it was asked for by, and has the aliases of both. New ones
    get ids after the greatest."""
    columns = [c for c in found.columns if c in stars.columns and c not in (key, "star_id")]
    new = found.filter(F.col(key).isNotNull()).select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_there"))
    joined = stars.join(new, key, "left")
    empty = F.array().cast("array<string>")
    value = lambda c: F.array_distinct(F.concat(F.coalesce(F.col(c), empty), F.coalesce(F.col(f"_new_{c}"), empty))) if c == "name_aliases" else F.coalesce(F.col(f"_new_{c}"), F.col(c))
    kept = joined.select(*[F.when(F.col("_there"), value(c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stars.columns])
    added = found.join(stars.filter(F.col(key).isNotNull()).select(key), key, "left_anti").filter(F.col(key).isNotNull()).select(key, *columns)
    return assign_ids(kept.unionByName(added, allowMissingColumns=True), "star_id", [key])


def seed_bright_stars(spark: SparkSession, path: str, fields: dict[str, tuple[int, int]], stars: DataFrame) -> DataFrame:
    """stars with those of a fixed-width list of bright stars, by their number; lines without one are left out. A list that
    was loaded before changes nothing but values."""
    lines = spark.read.text(path).select(*fixed_width(F.col("value"), fields))
    kinds = {f.name: f.dataType.simpleString() for f in stars.schema}
    found = lines.select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in fields]).filter("bsc_hr_number IS NOT NULL").dropDuplicates(["bsc_hr_number"])
    return upsert_stars(stars, found, "bsc_hr_number").withColumn("source_catalog", F.coalesce("source_catalog", F.lit("bsc5")))


def register_winners(stars: DataFrame, guesses: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stars, guesses) of fallback_match: sources of pool that won without being in the catalogue yet are in it afterwards, once
    each, and the guesses have their star_id."""
    guesses = cut(guesses)  # read twice below, and a filter on its columns would be pushed into all that picked them
    won = guesses.filter("star_id IS NULL AND gaia_source_id IS NOT NULL").select("gaia_source_id").distinct()
    found = pool.withColumnRenamed("source_id", "gaia_source_id").join(won, "gaia_source_id", "left_semi").withColumn("name_aliases", F.array().cast("array<string>"))
    grown = cut(add_stars(stars, found))
    ids = grown.filter("gaia_source_id IS NOT NULL").select("gaia_source_id", F.col("star_id").alias("_id"))
    filled = guesses.join(ids, "gaia_source_id", "left").withColumn("star_id", F.coalesce("star_id", "_id")).drop("_id")
    return grown, filled.select(*guesses.columns)


def backfill(df: DataFrame, values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with `columns` from values where they are null and the key is there. Of several values of a key the least."""
    one = values.groupBy(key).agg(*[F.min(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(one, key, "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def backfill_status(df: DataFrame, constants: dict[str, str], suffixes: dict[str, str]) -> DataFrame:
    """Where reduction_status is 'unknown': the constant of the archive, else that of the address's ending."""
    known = F.create_map(*[F.lit(x) for kv in constants.items() for x in kv])[F.col("archive_code")] if constants else F.lit(None)
    ending = F.lit(None).cast("string")
    for suffix, status in reversed(suffixes.items()):
        ending = F.when(F.lower("archive_url").endswith(suffix), status).otherwise(ending)
    return df.withColumn("reduction_status", F.when(F.col("reduction_status") == "unknown", F.coalesce(known, ending, F.col("reduction_status"))).otherwise(F.col("reduction_status")))


def rewrite_urls(df: DataFrame, pattern: str, replacement: str, guard: Column) -> DataFrame:
    return df.withColumn("archive_url", F.when(guard, F.regexp_replace("archive_url", pattern, replacement)).otherwise(F.col("archive_url")))


def import_votes(votes: DataFrame, holdings: DataFrame, existing: DataFrame, most: int = 1000) -> DataFrame:
    """New classification rows from vote lines: archive_code, outcome, submitter, submitted_at, and one of
    raw_target_name and archive_obs_id. A vote by name goes to all rows now skipped under it, unless they are more
    than `most` and the outcome names no star. One vote per row and submitter; the first line wins."""
    valid = votes.filter(
        F.col("archive_code").isNotNull() & F.col("submitter").isNotNull() & F.col("submitted_at").isNotNull() & F.col("outcome").isin(OUTCOMES)
        & (F.col("raw_target_name").isNotNull() != F.col("archive_obs_id").isNotNull())
    ).withColumn("_name", F.trim("raw_target_name"))
    skipped = holdings.filter("match_status = 'skipped'").select(*KEY, F.trim("raw_target_name").alias("_name")).filter("_name <> ''")
    wanted = skipped.join(valid.filter("_name <> ''").select("archive_code", "_name").distinct(), ["archive_code", "_name"], "left_semi")
    sizes = wanted.groupBy("archive_code", "_name").agg(F.count(F.lit(1)).alias("_n"))
    named = valid.filter("_name <> ''").drop("archive_obs_id").join(sizes, ["archive_code", "_name"])
    spread = named.filter((F.col("_n") <= most) | F.col("outcome").isin(UNCAPPED)).join(wanted, ["archive_code", "_name"])
    cols = ["vote_id", *KEY, "outcome", "submitter", "submitted_at"]
    rows = spread.select(*cols).unionByName(valid.filter("archive_obs_id IS NOT NULL").select(*cols))
    first = Window.partitionBy(*KEY, "submitter").orderBy("vote_id")
    once = rows.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    return once.join(existing.select(*KEY, "submitter").distinct(), [*KEY, "submitter"], "left_anti")


def replay_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows whose star or status a second matching changed: id, both stars and both statuses."""
    a = old.select("id", F.col("star_id").alias("old_star"), F.col("match_status").alias("old_status"))
    b = new.select("id", F.col("star_id").alias("new_star"), F.col("match_status").alias("new_status"))
    return a.join(b, "id").filter(~F.col("old_star").eqNullSafe(F.col("new_star")) | ~F.col("old_status").eqNullSafe(F.col("new_status")))


def pending_groups(holdings: DataFrame) -> DataFrame:
    return holdings.filter("match_status = 'skipped'").select("archive_code", group_key(F.col("raw_target_name"), F.col("archive_obs_id")).alias("group_key")).distinct()
