"""Name keys and labels as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_key(name: Column) -> Column:
    """Key for matching names: designation prefixes and all white space removed, upper case, GL read as GJ."""
    bare = F.upper(F.regexp_replace(F.regexp_replace(F.trim(name), r"^(?i)(NAME|V\*|Cl\*|\*)\s+", ""), r"\s+", ""))
    return F.when(bare.startswith("GL"), F.concat(F.lit("GJ"), F.substring(bare, 3, 1_000_000))).otherwise(bare)


def search_key(name: Column) -> Column:
    """Key for searching names: a leading NAME or * removed, single spaces, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), r"^(?i)(NAME|\*)\s+", ""), r"\s+", " "))


def common_name(aliases: Column, input_name: Column, key: Column) -> Column:
    """The first alias marked NAME, else the first alias, else the name given, else the id."""
    marked = F.transform(F.filter(aliases, lambda x: x.startswith("NAME ")), lambda x: F.trim(F.substring(x, 6, 1_000_000)))
    return F.coalesce(F.get(marked, F.lit(0)), F.get(aliases, F.lit(0)), input_name, key.cast("string"))


def known_as(aliases: Column, input_name: Column, key: Column) -> Column:
    return F.coalesce(F.get(aliases, F.lit(0)), input_name, key.cast("string"))


def group_key(name: Column, obs_id: Column) -> Column:
    """What a reviewer groups unmatched rows by: the trimmed name, else the observation."""
    trimmed = F.trim(name)
    return F.coalesce(F.when(trimmed != "", trimmed), F.concat(F.lit("obs:"), obs_id))
