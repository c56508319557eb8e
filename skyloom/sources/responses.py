"""What the archives' services answer: VOTables, JSON, CSV, HTML tables, fixed-width text, directory listings and FITS
tables, read in parallel as rows of text columns, and recorded, so that a recording can stand in for a service.

A response is a folder of pages. Every page is a whole answer of its kind, with its own header; the names of the
columns come from there. An absent value is null in every kind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.sources import fits
from skyloom.sources.catalog import ARCHIVES

#: how the answers of each kind of service are written, and the archives that differ
WIRES = {"tap": "votable", "ssa": "votable", "rest_json": "json", "graphql": "json", "cas_sql": "csv", "sql_api": "csv", "bulk_file": "fits", "html_form": "html", "directory_listing": "listing"}
OWN = {"elodie": "fixed", "sophie": "fixed", "hpol": "csv", "carmenes": "html", "carmenes_tac": "html", "carmenes_reiners2018": "html"}
WIDTH = 120  # characters of a fixed-width column
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}


def wire(archive: str) -> str:
    return OWN.get(archive, WIRES[ARCHIVES[archive].access])


def escape(x: Column) -> Column:
    for a, b in ENTITIES.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescape(x: Column) -> Column:
    for a, b in reversed(ENTITIES.items()):
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


def _row(kind: str, names: list[str], nested: list[str]) -> Column:
    cell = {c: F.col(f"`{c}`") for c in names}
    if kind == "votable":
        return F.concat(F.lit("<TR>"), *[F.coalesce(F.concat(F.lit("<TD>"), escape(x), F.lit("</TD>")), F.lit("<TD/>")) for x in cell.values()], F.lit("</TR>"))
    if kind in ("html", "listing"):
        return F.concat(F.lit("<tr>"), *[F.coalesce(F.concat(F.lit('<td class="v">'), escape(x), F.lit("</td>")), F.lit("<td></td>")) for x in cell.values()], F.lit("</tr>"))
    if kind == "csv":
        return F.concat_ws(",", *[F.coalesce(F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for x in cell.values()])
    if kind == "json":
        flat = F.to_json(F.struct(*[x.alias(c) for c, x in cell.items() if c not in nested]))
        return F.concat(F.substring(flat, F.lit(1), F.length(flat) - 1), *[F.concat(F.lit(f',"{c}":'), F.coalesce(cell[c], F.lit("null"))) for c in nested], F.lit("}"))
    return F.concat(*[F.rpad(F.coalesce(x, F.lit("")), WIDTH, " ") for x in cell.values()])


def _page(kind: str, names: list[str], rows: Column) -> Column:
    if kind == "votable":
        fields = "".join(f'<FIELD name="{c}" datatype="char" arraysize="*"/>' for c in names)
        return F.concat(F.lit(f'<?xml version="1.0"?><VOTABLE version="1.3"><RESOURCE type="results"><TABLE>{fields}<DATA><TABLEDATA>\n'), F.array_join(rows, "\n"), F.lit("\n</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>"))
    if kind in ("html", "listing"):
        head = "".join(f"<th>{c}</th>" for c in names)
        return F.concat(F.lit(f"<html><body><h1>Results</h1><table border=1>\n<tr>{head}</tr>\n"), F.array_join(rows, "\n"), F.lit("\n</table></body></html>"))
    if kind == "csv":
        return F.concat(F.lit(",".join(names) + "\n"), F.array_join(rows, "\n"))
    if kind == "json":
        return F.concat(F.lit("["), F.array_join(rows, ",\n"), F.lit("]"))
    return F.concat(F.lit("".join(c.ljust(WIDTH) for c in names) + "\n"), F.array_join(rows, "\n"))


def record(log: DataFrame, path: str, kind: str, nested: tuple[str, ...] = (), page_rows: int = 5000) -> None:
    """Writes a log of text columns as the pages of a response. Columns in `nested` hold JSON."""
    names = log.columns
    pages = max(1, -(-log.count() // page_rows))
    if kind == "fits":
        log.repartition(pages).mapInArrow(_fits_pages(path, names), "written string").count()
        return
    page = F.pmod(F.xxhash64(*names), F.lit(pages)).alias("page")
    texts = log.select(page, _row(kind, names, list(nested)).alias("row")).groupBy("page").agg(_page(kind, names, F.collect_list("row")).alias("value"))
    texts.repartition(pages, "page").drop("page").write.option("maxRecordsPerFile", 1).text(path)


def _fits_pages(path: str, names: list[str]):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        columns = [[(x or "").encode() for x in table.column(i).to_pylist()] for i in range(len(names))]
        kinds = [(n, f"S{max(map(len, c)) or 1}") for n, c in zip(names, columns)]
        data = np.zeros(len(table), kinds)
        for n, c in zip(names, columns):
            data[n] = c
        head = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": data.dtype.itemsize, "NAXIS2": len(data), "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(names)}
        for i, (n, t) in enumerate(kinds, 1):
            head |= {f"TTYPE{i}": n, f"TFORM{i}": f"{t[1:]}A"}
        store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}") if not path.startswith("file:/") or path.startswith("file://") else fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1))
        store.create_dir(at)
        with store.open_output_stream(f"{at}/{uuid.uuid4().hex}.fits") as f:
            f.write(fits.write([({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0}, b""), (head, data.tobytes())]))
        yield pa.RecordBatch.from_arrays([pa.array([at])], names=["written"])

    return write


def respond(spark: SparkSession, path: str, kind: str, names: list[str], nested: dict[str, str] | None = None) -> DataFrame:
    """The rows of a response as text columns `names`, those in `nested` of the type given. Columns that the pages lack are
    null, others in them are left out."""
    if kind == "json":
        schema = ", ".join(f"`{c}` {(nested or {}).get(c, 'string')}" for c in names)
        return spark.read.schema(schema).option("multiLine", True).json(path)
    if kind == "csv":
        raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("comment", "#").option("nullValue", "").csv(path)
        return raw.select(*[F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in names])
    if kind == "fits":
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_fits_rows(names), ", ".join(f"`{c}` string" for c in names))
    if kind == "votable":
        shape = spark.read.format("xml").option("rowTag", "FIELD").schema("_name string").load(path)
        seen = [r[0] for r in shape.limit(1000).collect()]
        rows = spark.read.format("xml").option("rowTag", "TR").option("ignoreSurroundingSpaces", False).schema("TD array<string>").load(path)
        at, cells = list(dict.fromkeys(seen)), F.col("TD")
    elif kind == "fixed":
        lines = spark.read.text(path).withColumnRenamed("value", "line").filter("trim(line) <> ''")
        head = lines.filter(F.col("line").startswith(names[0].ljust(WIDTH))).limit(1).collect()
        at = head[0][0].split() if head else []
        rows = lines.filter(~F.col("line").startswith(names[0].ljust(WIDTH)))
        cells = F.array(*[F.rtrim(F.substring("line", 1 + i * WIDTH, WIDTH)) for i in range(len(at))])
    else:
        page = spark.read.option("wholetext", True).text(path)
        found = page.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1)).alias("tr"))
        head = found.filter(F.col("tr").contains("<th")).limit(1).select(F.regexp_extract_all("tr", F.lit(r"(?s)<th[^>]*>(.*?)</th>"), 1)).collect()
        at = head[0][0] if head else []
        rows = found.filter(~F.col("tr").contains("<th"))
        cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1), unescape)
    value = lambda c: F.get(F.col("cells"), F.lit(at.index(c))) if c in at else F.lit(None).cast("string")
    return rows.select(cells.alias("cells")).select(*[F.when(value(c) != "", value(c)).alias(c) for c in names])


def _fits_rows(names: list[str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                table = fits.read(raw)[1].table()
                columns = [[x.decode().rstrip("\0 ") or None for x in table[c]] if c in table.dtype.names else [None] * len(table) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

    return read
