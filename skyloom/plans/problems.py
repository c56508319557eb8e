"""The p1_ and p2_ queries and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.chunked_keys import key_sequences
from skyloom.operators.sky_join import sky_neighbours
from skyloom.session import load


def _sequences(spark: SparkSession, d: str, keys: list[str], value: str) -> DataFrame:
    rows = load(spark, d, "spectroscopy_holdings")
    return key_sequences(rows, keys, F.unix_micros("first_seen_at"), F.col("id"), F.col(value))


def _report(spark: SparkSession, d: str, keys: list[str], value: str) -> DataFrame:
    return _sequences(spark, d, keys, value).select(
        *keys, "n_rows", "n_changes", F.col("max_gap").alias("max_gap_us"), F.col("first_at").alias("first_us"), F.col("last_at").alias("last_us")
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _sequences(spark, d, ["archive_code", "match_status"], "reduction_status")
    total = load(spark, d, "spectroscopy_holdings").agg(F.count(F.lit(1)).alias("_total"))
    return pairs.crossJoin(F.broadcast(total)).filter(F.col("n_rows") * 40 >= F.col("_total")).select("archive_code", "match_status")


def p1_by_pair(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, ["archive_code", "match_status"], "reduction_status")


def p1_by_archive(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, ["archive_code"], "match_status")


def p1_by_status(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, ["match_status"], "archive_code")


def _report_sql(keys: str, value: str) -> str:
    return f"""
    WITH s AS (
      SELECT *, lag({value}) OVER w AS v0, lag(epoch_us(first_seen_at)) OVER w AS t0, row_number() OVER w AS i
      FROM spectroscopy_holdings WINDOW w AS (PARTITION BY {keys} ORDER BY first_seen_at, id))
    SELECT {keys}, count(*) AS n_rows, count(*) FILTER (WHERE i > 1 AND {value} IS DISTINCT FROM v0) AS n_changes,
      max(epoch_us(first_seen_at) - t0) AS max_gap_us, min(epoch_us(first_seen_at)) AS first_us, max(epoch_us(first_seen_at)) AS last_us
    FROM s GROUP BY {keys}"""


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sky_neighbours(load(spark, d, "stars"), load(spark, d, "spectroscopy_holdings"), load(spark, d, "sky_fields"))


QUERIES = {
    "p1_found": p1_found, "p1_by_pair": p1_by_pair, "p1_by_archive": p1_by_archive, "p1_by_status": p1_by_status,
    "p2_found": p2_found,
}
_UNIT = "cos(radians({d}))*cos(radians({r})) AS {p}x, cos(radians({d}))*sin(radians({r})) AS {p}y, sin(radians({d})) AS {p}z"
_SEP = "(a.ux-b.ux)*(a.ux-b.ux)+(a.uy-b.uy)*(a.uy-b.uy)+(a.uz-b.uz)*(a.uz-b.uz) <= power(2*sin(radians(10.0/3600)/2), 2)"
SQL = {
    "p1_found": """SELECT archive_code, match_status FROM spectroscopy_holdings GROUP BY ALL
      HAVING count(*) * 40 >= (SELECT count(*) FROM spectroscopy_holdings)""",
    "p1_by_pair": _report_sql("archive_code, match_status", "reduction_status"),
    "p1_by_archive": _report_sql("archive_code", "match_status"),
    "p1_by_status": _report_sql("match_status", "archive_code"),
    "p2_found": f"""
    WITH s AS (SELECT star_id, {_UNIT.format(d="dec", r="ra", p="u")} FROM stars),
      h0 AS (SELECT id, raw_ra - 360*floor(raw_ra/360) AS ra, raw_dec AS de FROM spectroscopy_holdings
             WHERE raw_ra IS NOT NULL AND raw_dec IS NOT NULL AND NOT isnan(raw_ra) AND raw_dec BETWEEN -90 AND 90),
      h AS (SELECT *, {_UNIT.format(d="de", r="ra", p="u")} FROM h0),
      f AS (SELECT *, {_UNIT.format(d="center_dec", r="center_ra", p="u")} FROM sky_fields)
    SELECT 'star_star' AS kind, a.star_id AS id_a, b.star_id AS id_b FROM s a JOIN s b
      ON floor(a.uz*1000) BETWEEN floor(b.uz*1000)-1 AND floor(b.uz*1000)+1 AND a.star_id < b.star_id AND {_SEP}
    UNION SELECT 'row_star', a.id, b.star_id FROM h a JOIN (SELECT s.*, floor(uz*1000)+k AS zone FROM s, (VALUES (-1),(0),(1)) v(k)) b
      ON floor(a.uz*1000) = b.zone AND {_SEP}
    UNION SELECT 'row_field', a.id, b.field_id FROM h a JOIN f b ON CASE WHEN shape='circle'
      THEN {_SEP.split("<=")[0]} <= power(2*sin(radians(radius_deg)/2), 2)
      ELSE de BETWEEN dec_min AND dec_max AND CASE WHEN ra_min > ra_max THEN ra >= ra_min OR ra <= ra_max ELSE ra BETWEEN ra_min AND ra_max END END""",
}
