"""Other sources and sinks: snapshot views, sorted tables, JSON lines, atomic publishing."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOTE = "archive_code string, archive_obs_id string, raw_target_name string, outcome string, submitter string, submitted_at timestamp, proposed_gaia_source_id bigint, proposed_bsc_hr_number int, note string"


def register_views(spark: SparkSession, folder: str, names: list[str]) -> None:
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one of the schema if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """Vote lines of JSON; lines that are none are dropped, and counted by the caller if wanted."""
    line = F.from_json("value", VOTE, {"mode": "PERMISSIVE"})
    return spark.read.text(path).select(line.alias("v")).select("v.*").filter("archive_code IS NOT NULL OR submitter IS NOT NULL")


def append_votes(votes: DataFrame, path: str, outcomes: list[str] | None = None) -> None:
    """Appends votes as JSON lines; with `outcomes` only those that are valid. Every append is a file of its own that
    appears when it is whole, so appends need no lock."""
    kept = valid_votes(votes, outcomes).filter("error IS NULL").drop("error") if outcomes else votes
    kept.write.mode("append").json(path)


def write_sorted(df: DataFrame, path: str, by: str, partitions: int | None = None) -> None:
    """Parquet in the order of a column, so that row groups can be skipped by its range."""
    spread = df.repartitionByRange(partitions, by) if partitions else df.repartitionByRange(by)
    spread.sortWithinPartitions(by).write.mode("overwrite").parquet(path)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside `path` and moves it there, on any file system that Spark reaches."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    target, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{time.time_ns()}.next")
    conf = spark._jsc.hadoopConfiguration()
    out = target.getFileSystem(conf).create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf).rename(fresh, target, how)


def _get(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none; any other failure is raised."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(fs.open(at))).decode()


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def publish(df: DataFrame, root: str, name: str, keep: int = 2) -> str:
    """Writes a new version beside the old and then points to it; readers see the old or the new, never half. The
    `keep` latest versions stay."""
    spark, pointer = df.sparkSession, f"{root}/{name}.current"
    version = f"{name}.{time.time_ns()}"
    df.write.parquet(f"{root}/{version}")
    known = [version, *json.loads(_get(spark, pointer) or "[]")]
    _put(spark, pointer, json.dumps(known[:keep]))
    for old in known[keep:]:
        _drop(spark, f"{root}/{old}")
    return version


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{json.loads(_get(spark, f'{root}/{name}.current'))[0]}")


def optional_current(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The published table, None if none was."""
    return current(spark, root, name) if _get(spark, f"{root}/{name}.current") is not None else None


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a tab-separated access log: at (timestamp), key, value; lines that are none are left out."""
    parts = F.split("value", "\t")
    line = spark.read.text(path).select(F.get(parts, F.lit(0)).try_cast("timestamp").alias("at"), F.get(parts, F.lit(1)).alias("key"), F.get(parts, F.lit(2)).alias("value"))
    return line.filter("at IS NOT NULL AND key <> ''")


def count_accesses(spark: SparkSession, log: str, root: str, name: str) -> DataFrame:
    """Counts per key, kept as a published table with the time up to which lines are counted: a run adds the lines after
    that time, up to the latest that the log has, and a second run without new lines changes nothing."""
    old = optional_current(spark, root, name)
    mark = old.agg(F.max("counted_to")).first()[0] if old is not None else None
    lines = read_log(spark, log)
    latest = lines.agg(F.max("at")).first()[0]
    fresh = lines if mark is None else lines.filter(F.col("at") > F.lit(mark))
    if latest is not None and (mark is None or latest > mark):
        counts = fresh.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        both = counts if old is None else old.select("key", "n").unionByName(counts)
        publish(both.groupBy("key").agg(F.sum("n").alias("n")).withColumn("counted_to", F.lit(latest)), root, name)
    held = optional_current(spark, root, name)
    return held if held is not None else spark.createDataFrame([], "key string, n bigint, counted_to timestamp")


def read_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row for each JSON document of a file, nested lists as arrays of structs."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table of a database. With a numeric key the table is read in as many parts by ranges of it, whose limits are its
    least and greatest value, so no part of the table is left out and the parts are read side by side."""
    reader = lambda: spark.read.format("jdbc").option("url", url).options(**options)
    if key is None:
        return reader().option("dbtable", table).load()
    low, high = reader().option("query", f'SELECT min("{key}") AS "low", max("{key}") AS "high" FROM {table}').load().first()
    if low is None:
        return reader().option("dbtable", table).load()
    limits = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(int(high) + 1), "numPartitions": str(partitions)}
    return reader().option("dbtable", table).options(**limits).load()


def derby_archive(df: DataFrame, folder: str, table: str) -> str:
    """Puts df in a Derby database and the database in one file in `folder`, which all executors share; gives its JDBC URL.

    Derby without a server belongs to one process, but any number of them may open such a file, as it can only be read. The
    executors write the rows as text, and the driver has Derby load each part, so no rows pass through the driver's memory
    but Derby's pages. `folder` must be a mounted one. Derby knows no NaN; the rows must hold none."""
    spark, at = df.sparkSession, folder.removeprefix("file://").removeprefix("file:")
    os.makedirs(at, exist_ok=True)
    text, own = f"{at}/{table}-text", tempfile.mkdtemp(prefix="derby-")
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) if t == "string" else F.col(c).cast("string") for c, t in df.dtypes]
    df.select(F.concat_ws(",", *[F.coalesce(x, F.lit("")) for x in quoted])).write.text(f"file://{os.path.abspath(text)}")  # nothing at all is null
    url = f"jdbc:derby:directory:{own}/db"
    spark.createDataFrame([], df.schema).limit(0).write.jdbc(f"{url};create=true", table)  # Spark's own types, and no task
    sql = spark._jvm.java.sql
    con = sql.DriverManager.getConnection(url)
    call = con.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
    for part in sorted(x for x in os.listdir(text) if x.endswith(".txt") and os.path.getsize(f"{text}/{x}")):
        call.setString(1, table.upper())
        call.setString(2, f"{text}/{part}")
        call.execute()
    con.close()
    try:
        sql.DriverManager.getConnection(f"{url};shutdown=true")
    except Exception as e:  # noqa: BLE001
        if "08006" not in str(e.java_exception.getSQLState()):  # which says that it was shut down
            raise
    shutil.rmtree(text)
    file = f"{at}/{table}-{uuid.uuid4().hex}.jar"
    with zipfile.ZipFile(file, "w", zipfile.ZIP_STORED) as z:  # uncompressed, so that pages are found without reading all before
        for top, _, names in os.walk(f"{own}/db"):
            for n in names:
                if not n.endswith(".lck"):
                    z.write(f"{top}/{n}", os.path.relpath(f"{top}/{n}", own))
    shutil.rmtree(own)
    return f"jdbc:derby:jar:({file})db"


def valid_votes(votes: DataFrame, outcomes: list[str]) -> DataFrame:
    """votes with error, null where a vote may be kept: the archive, the submitter and a known outcome must be there, just one
    of name and observation, and a catalogue id where the outcome attaches a star."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return votes.withColumn(
        "error",
        F.when(blank("archive_code"), "no archive").when(blank("submitter"), "no submitter").when(F.col("submitter").rlike("[\\p{Cntrl}]") | (F.length("submitter") > 100), "bad submitter")
        .when(~F.coalesce(F.col("outcome").isin(outcomes), F.lit(False)), "unknown outcome")
        .when(blank("raw_target_name") == blank("archive_obs_id"), "name or observation, not both")
        .when((F.col("outcome") == "attach_gaia_source") & F.col("proposed_gaia_source_id").isNull(), "no catalogue id")
        .when((F.col("outcome") == "attach_bright_star") & F.col("proposed_bsc_hr_number").isNull(), "no bright-star number"),
    )


class Snapshots:
    """A Parquet table partitioned by one column, of which parts are replaced at once: new parts are written into a
    folder of their own, then a manifest that names the folders of all parts takes the old one's place. A reader has
    the parts of one manifest; the folders of the one before stay for readers that still use it. One writer at a time.
    The manifest also keeps the greatest id ever given, so ids are unique over all parts and none is given twice."""

    def __init__(self, spark: SparkSession, root: str, schema: str, part: str = "archive_code", key: str = "id"):
        self.spark, self.root, self.schema, self.part, self.key = spark, root, schema, part, key

    def manifest(self) -> dict:
        return json.loads(_get(self.spark, f"{self.root}/_manifest") or '{"parts": {}, "top": 0, "old": []}')

    def read(self, parts: list[str] | None = None) -> DataFrame:
        held = self.manifest()["parts"]
        paths = [p for k, v in held.items() if parts is None or k in parts for p in v]
        names = [f.split(" ")[0] for f in self.schema.split(", ")]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{p}" for p in paths]).select(*names)

    def top(self) -> int:
        return self.manifest()["top"]

    def replace(self, df: DataFrame, parts: list[str]) -> None:
        """Puts df, which holds all rows of `parts`, in the place of those parts."""
        held, version = self.manifest(), f"v{time.time_ns()}"
        place = F.create_map(*[x for i, p in enumerate(parts) for x in (F.lit(p), F.lit(i))])
        df.withColumn("_part", place[F.col(self.part)]).repartition("_part", F.pmod(F.xxhash64(self.key), F.lit(16))).write.partitionBy("_part").parquet(f"{self.root}/{version}")
        top = df.agg(F.max(self.key)).first()[0] or 0
        fresh = {p: [f"{version}/_part={i}"] for i, p in enumerate(parts) if self._exists(f"{version}/_part={i}")}
        gone = [x for p in parts for x in held["parts"].get(p, [])]
        live = {**{k: v for k, v in held["parts"].items() if k not in parts}, **fresh}
        _put(self.spark, f"{self.root}/_manifest", json.dumps({"parts": live, "top": max(top, held["top"]), "old": gone}))
        for path in held["old"]:
            _drop(self.spark, f"{self.root}/{path}")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)


def summary_json(parts: dict[str, DataFrame]) -> str:
    """One JSON object with each small table as a list of objects."""
    return json.dumps({n: [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()] for n, df in parts.items()})


class Cached:
    """Small results kept for a while: get(key, make) gives what make() gave at most `seconds` ago. A DataFrame's rows are
    collected, so only what is small belongs here; at most `most` keys are kept, the oldest go first."""

    def __init__(self, seconds: float, most: int = 1000, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock, self.held = seconds, most, clock, {}

    def get(self, key, make: Callable):
        now = self.clock()
        at, value = self.held.get(key, (None, None))
        if at is None or now - at >= self.seconds:
            value = make()
            value = value.collect() if isinstance(value, DataFrame) else value
            self.held.pop(key, None)
            self.held[key] = (now, value)
            while len(self.held) > self.most:
                self.held.pop(next(iter(self.held)))
        return value


def retry(f: Callable, times: int = 5, first: float = 15.0, sleep: Callable[[float], None] = time.sleep):
    """f(), again after 15, 30, 60, ... seconds when it fails, `times` times in all."""
    for i in range(times):
        try:
            return f()
        except Exception:  # noqa: BLE001
            if i == times - 1:
                raise
            sleep(first * 2**i)
    return None
