"""Programs as data: documents read through Spark's file systems, compiled where they lie.

A table of documents is compiled row by row on the executors (``compile_documents``); a directory, with the modules its
programs import, is read into memory first (``read_directory``), since programs are small.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webloom.plans.compiler import compile_text, diagnose
from webloom.plans.program import Program

_DIAGNOSTIC = "array<struct<code:string,severity:string,message:string,path:string,file:string,line:int,column:int,offset:int>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, source): every ``.kdl`` document below a folder of any file system that Spark reads, whole, as bytes."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.kdl").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("content").alias("source"))


def read_directory(spark: SparkSession, path: str, max_bytes: int = 64 << 20) -> dict[str, bytes]:
    """The documents below a folder by their paths relative to it."""
    found = read_documents(spark, path).withColumn("n", F.octet_length("source"))
    size = found.agg(F.sum("n")).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the documents below {path} have {size} bytes, more than {max_bytes}")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    return {r["path"].split(root + "/", 1)[1]: bytes(r["source"]) for r in found.select("path", "source").collect()}


def compile_directory(spark: SparkSession, path: str, name: str) -> Program:
    """The program ``name`` of a folder; imports are read relative to it."""
    files = read_directory(spark, path)
    return compile_text(files[name], name, files)


def compile_documents(df: DataFrame, key: str = "path", source: str = "source", modules: Mapping[str, str | bytes] | None = None) -> DataFrame:
    """(key, ok, ir, diagnostics) of each document, text or bytes; ``ir`` is null unless it compiles. ``modules``: documents that may
    be imported, by path. A null document is an empty one."""
    if key in ("ok", "ir", "diagnostics"):
        raise ValueError(f"the key has the name of a result, rename it first: {key}")
    files = {k: v.encode() if isinstance(v, str) else v for k, v in (modules or {}).items()}
    kind = T.StructType([T.StructField(key, df.schema[key].dataType), *T.StructType.fromDDL(f"ok boolean, ir string, diagnostics {_DIAGNOSTIC}").fields])
    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                program, found = diagnose(text or "", "program.kdl", files.__getitem__)
                said = [{"code": d.code, "severity": d.severity, "message": d.message, "path": d.path, "file": d.span.file, "line": d.span.start[1], "column": d.span.start[2], "offset": d.span.start[0]} for d in found]
                out.append({key: k, "ok": program is not None, "ir": program.ir_json() if program else None, "diagnostics": said})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.select(F.col(f"`{key}`"), F.col(f"`{source}`")).mapInArrow(run, kind)
