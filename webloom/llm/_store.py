"""Where operators put intermediate tables: the folder that all executors and the driver share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import _text

_made: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset and the master local, as in tests, below a
    folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='webloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/webloom-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in _made:
        _delete(spark, path)


def settled(df: DataFrame, *paths: str) -> DataFrame:
    """``df`` computed and checkpointed in the shared folder, and the tables below ``paths`` that it was made
    from deleted. Spark deletes the checkpoint with the last plan that reads it, if
    spark.cleaner.referenceTracking.cleanCheckpoints says so."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    out = df.checkpoint()
    for path in paths:
        _delete(spark, path)
        if path in _made:
            _made.remove(path)
    return out


def written(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet and read again: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(block: _text.Block, level: int = 3) -> pa.Array:
    """Each document's bytes, compressed."""
    c = zstandard.ZstdCompressor(level=level)
    data = block.buf.tobytes()
    return pa.array([c.compress(data[a:b]) for a, b in zip(block.offs[:-1].tolist(), block.offs[1:].tolist(), strict=True)], pa.binary())


def unpacked(blobs: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the documents that ``packed`` compressed."""
    d = zstandard.ZstdDecompressor()
    texts = [d.decompress(z) if z is not None else b"" for z in blobs]
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offs


def with_texts(found: DataFrame) -> DataFrame:
    """Texts in place of the columns ``z`` and ``missing`` (whether it was null)."""
    others = [c for c in found.columns if c not in ("z", "missing")]
    fields = found.select(*others).withColumn("text", F.lit("")).schema

    def unpack(batches):
        d = zstandard.ZstdDecompressor()
        for b in batches:
            z, missing = b.column(len(others)).to_pylist(), b.column(len(others) + 1).to_pylist()
            texts = pa.array([None if m else d.decompress(x).decode() for x, m in zip(z, missing, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(others))], texts], [*others, "text"])

    fields["text"].nullable = True
    return found.select(*others, "z", "missing").mapInArrow(unpack, fields)
