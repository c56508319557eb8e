"""A query for every archive: records written as the archive's service answers, and read back through its connector."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.plans.derived import HOLDINGS, h, s
from skyloom.session import shared_dir
from skyloom.sources.catalog import ARCHIVES, RAW_OBSERVATION
from skyloom.sources.connectors import MAPS, comes_back, raw_columns, record_log, to_records
from skyloom.sources.responses import record, respond, wire

QUERIES, SQL = {}, {}
FIELDS = [x.split(" ")[0] for x in RAW_OBSERVATION.split(", ")]
NESTED = {"salt_hrs": {"metadata": "array<struct<key:string,value:string>>"}}
#: records to bring through: every delivered row, under an id of its own, with the catalogue id of its star
RECORDS = f"""SELECT archive_obs_id || '.' || id AS archive_obs_id, archive_url, instrument, obs_date, program_id, gaia_source_id, raw_ra AS ra, raw_dec AS dec, raw_target_name, reduction_status
    FROM {HOLDINGS} LEFT JOIN (SELECT star_id, gaia_source_id FROM stars) USING (star_id)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    rows = h(spark, d).join(s(spark, d).select("star_id", "gaia_source_id"), "star_id", "left")
    key = F.concat("archive_obs_id", F.lit("."), F.col("id").cast("string")).alias("archive_obs_id")
    return rows.select(key, "archive_url", "instrument", "obs_date", "program_id", "gaia_source_id", F.col("raw_ra").alias("ra"), F.col("raw_dec").alias("dec"), "raw_target_name", "reduction_status")


def rounded(name: str, value: str) -> str:
    return f"round({value}, 8) AS {name}" if name in ("ra", "dec") else f"{value} AS {name}"


def through(archive: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        nested = NESTED.get(archive, {})
        path = f"{shared_dir(spark)}/{archive}-{uuid.uuid4().hex}"
        record(record_log(records(spark, d), archive), path, wire(archive), tuple(nested))
        log = respond(spark, path, wire(archive), list(raw_columns(archive)), nested)
        return to_records(log, archive).selectExpr(*[rounded(f, f) for f in FIELDS])

    return query


def through_sql(archive: str) -> str:
    m = MAPS[archive]
    fields = ", ".join(rounded(f, f"({comes_back(archive, f)})::{t}") for f, t in (x.split(" ") for x in RAW_OBSERVATION.replace("string", "VARCHAR").split(", ")))
    several = ", (VALUES ('VIS'), ('NIR')) v(p)" if m.unpivot else ""
    return f"SELECT {fields} FROM ({RECORDS}) r{several} WHERE {m.kept}"


for number, (name, spec) in enumerate(ARCHIVES.items(), 1):
    if spec.access != "stub":
        QUERIES[f"c{number:02d}_{name}"] = through(name)
        SQL[f"c{number:02d}_{name}"] = through_sql(name)
