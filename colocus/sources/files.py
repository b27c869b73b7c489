"""Typed file scans and sinks; the folder for intermediate files."""

from __future__ import annotations

import csv
import io
import json
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colocus.sources.store import open_file


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share; a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="colocus-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def read_csv(spark: SparkSession, path: str | list[str], schema: str, columns: list[str] | None = None, sep: str = ",", null: str = "") -> DataFrame:
    """CSV (plain or compressed, by extension) with a header and a fixed schema; only ``columns`` are parsed."""
    df = spark.read.schema(schema).csv(path, header=True, sep=sep, nullValue=null, enforceSchema=True)
    return df.select(*columns) if columns else df


def dialect(head: bytes, whole: bool, separators: str = ";,\t|") -> tuple[str, list[str]] | None:
    """Separator and header names from the first bytes of a delimited file (``whole``: these are all); None for an empty one.

    The separator is the one that cuts every record into the same number of
    fields, the most if several do; quoted separators and line breaks do not
    count. A file with one field a record has a comma.
    """
    text = head.decode("utf-8-sig", "replace")
    best: tuple[int, str, list[str]] | None = None
    for sep in separators:
        try:
            records = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
        except csv.Error:
            continue
        if not whole and len(records) > 1:
            records = records[:-1]  # the last one may be cut off
        if records and (best is None or len(records[0]) > best[0]) and len({len(r) for r in records}) == 1:
            best = (len(records[0]), sep if len(records[0]) > 1 else ",", [c.strip() for c in records[0]])
    if best is None and text.strip():
        raise ValueError("no separator cuts all records into the same number of fields")
    return best and (best[1], best[2])


def dialects(spark: SparkSession, path: str, head: int = 1 << 16) -> DataFrame:
    """path, separator, header, fault of every delimited file under a path, from ``head`` bytes of each; compressed ones end in .gz."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u for batch in stream for u in batch.column(0).to_pylist()):
            with open_file(uri) as file:
                raw = file.read(head)
                whole = len(raw) < head
            fault, found = None, None
            try:
                if uri.endswith(".gz"):
                    d = zlib.decompressobj(31)
                    raw = d.decompress(raw, head)
                    whole = whole and d.eof
                found = dialect(raw, whole)
            except (ValueError, zlib.error) as wrong:
                fault = str(wrong)
            sep, header = found or (None, None)
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([sep], pa.string()), pa.array([header], pa.list_(pa.string())), pa.array([fault], pa.string())], names=["path", "separator", "header", "fault"])

    files = spark.read.format("binaryFile").load(path).select("path")  # lists files; their content is not read
    return files.mapInArrow(run, "path string, separator string, header array<string>, fault string")


def read_sniffed(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, null: str = "") -> DataFrame:
    """Delimited files of any of the separators as one typed table.

    Every file's header must be the schema's names in their order; a file that
    has another, or no clear separator, is an error that names it. Empty files
    have no rows. The driver holds the paths of the files, not more.
    """
    want = [f.name for f in spark.createDataFrame([], schema).schema]
    found = dialects(spark, path).filter("separator IS NOT NULL OR fault IS NOT NULL")
    odd = lambda r: r["fault"] or (r["header"] != want and f"its header is {r['header']}")
    by: dict[str, list[str]] = {}
    for r in found.toLocalIterator():
        if wrong := odd(r):
            raise ValueError(f"{r['path']}: {wrong}")
        by.setdefault(r["separator"], []).append(r["path"])
    parts = [read_csv(spark, sorted(paths), schema, columns, sep, null) for sep, paths in sorted(by.items())]
    if not parts:
        parts = [spark.createDataFrame([], schema).select(*(columns or want))]
    return reduce(DataFrame.unionByName, parts)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").csv(path, header=True, compression=compression)


def six_digits(df: DataFrame) -> DataFrame:
    """Doubles as text with six significant digits, for text sinks."""
    return df.select(*[F.format_string("%.6g", c).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def markdown(df: DataFrame, digits: int = 3) -> list[str]:
    """Lines of a small result as a markdown table; for reports, whose rows are few by nature."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = [[show(v) for v in r] for r in df.collect()]
    return ["| " + " | ".join(x) + " |" for x in (df.columns, ["---"] * len(df.columns), *rows)]


def summary_json(record: dict) -> str:
    return json.dumps(record, indent=1, sort_keys=True, default=str)
