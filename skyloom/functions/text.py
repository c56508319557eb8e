"""Idioms for turning archive logs into records: sentinels, dates, coordinates, packed and scraped text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_float(x: Column) -> Column:
    """A double; what is no number is null, so are Java's literals with a type letter (1d, 2f) or in hexadecimal."""
    y = x.try_cast("double")
    return F.when(~F.isnan(y) & ~x.cast("string").rlike(r"[0-9.][dDfF]\s*$|0[xX]"), y)


def reduction_status(level: Column) -> Column:
    n = level.try_cast("int")
    return F.when(n <= 1, "raw").when(n > 1, "reduced")


def mjd_date(mjd: Column) -> Column:
    return F.date_add(F.lit("1858-11-17").cast("date"), F.floor(mjd).cast("int"))


def jd_date(jd: Column) -> Column:
    return mjd_date(jd - 2400000.5)


def millis_date(ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(ms))


def sexagesimal(text: Column, hours: bool) -> Column:
    """Degrees of 'h m s' or 'd m s', parts split by colons or blanks; the sign is the text's own, so -00 keeps it.
    Null where a part is missing, no number or out of range."""
    parts = F.split(F.trim(text), r"[:\s]+")
    d, m, s = (F.get(parts, F.lit(i)).try_cast("double") for i in range(3))
    size = F.abs(d) + m / 60 + s / 3600
    good = (F.size(parts) == 3) & (m >= 0) & (m < 60) & (s >= 0) & (s < 60) & (size <= (24 if hours else 90))
    sign = F.when(F.trim(text).startswith("-"), -1.0).otherwise(1.0)
    return F.when(good, sign * size * (15 if hours else 1))


def packed(text: Column) -> tuple[Column, Column]:
    """(ra, dec) in degrees of JHHMMSS.s+DDMMSS."""
    form = r"^J(\d\d)(\d\d)(\d\d(?:\.\d+)?)([+-]\d\d)(\d\d)(\d\d(?:\.\d+)?)$"
    g = [F.regexp_extract(text, form, i) for i in range(1, 7)]
    return sexagesimal(F.concat_ws(":", *g[:3]), True), sexagesimal(F.concat_ws(":", *g[3:]), False)


def no_sentinel(x: Column, *sentinels: float) -> Column:
    return F.when(~x.isin(*sentinels), x)


def within(x: Column, low: float, high: float) -> Column:
    return F.when(x.between(low, high), x)


def flexible_date(text: Column, file_name: Column) -> Column:
    """The date in the text, as yyyy-MM-dd or dd/MM/yy (years below 50 are 20yy), else yyyymmdd in the file name."""
    short = r"^(\d{1,2})/(\d{1,2})/(\d{2})$"
    d, m, y = (F.regexp_extract(text, short, i).try_cast("int") for i in (1, 2, 3))
    century = F.when(y < 50, 2000 + y).otherwise(1900 + y)
    named = F.regexp_extract(file_name, r"((?:19|20)\d{6})", 1)
    return F.coalesce(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.format_string("%04d-%02d-%02d", century, m, d), "yyyy-MM-dd"), F.try_to_date(named, "yyyyMMdd"))


def numbers_range(text: Column) -> Column:
    """(low, high) of all numbers in a text."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    return F.struct(F.array_min(found).alias("low"), F.array_max(found).alias("high"))


def centroid(polygon: Column) -> Column:
    """Mean of an array of [x, y] without its closing vertex."""
    n = F.size(polygon) - 1
    open_ = F.slice(polygon, F.lit(1), n)
    total = lambda i: F.aggregate(open_, F.lit(0.0), lambda acc, p: acc + F.get(p, F.lit(i)))
    return F.struct((total(0) / n).alias("x"), (total(1) / n).alias("y"))


def fixed_width(line: Column, fields: dict[str, tuple[int, int]]) -> list[Column]:
    """Trimmed fields of a line by (first, last) column from 1; blanks are null."""
    out = []
    for name, (first, last) in fields.items():
        x = F.trim(F.substring(line, first, last - first + 1))
        out.append(F.when(x != "", x).alias(name))
    return out


def pairs_map(items: Column) -> Column:
    """A map from an array of key/value structs, the last value of a key."""
    return F.map_from_entries(F.transform(items, lambda x: F.struct(x["key"], x["value"])))
