"""Small inputs dealt to all cores.

A file is read by as many tasks as it has row groups, so a small table in one row group keeps one core busy, whatever is done
with its rows. Where the work per row is worth far more than moving it, such a table is dealt out once. Tables of as many
files as there are cores, or of a size that fills them with full partitions, are left as they are, and so are streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def _bytes(text: str) -> int:
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    text = text.lower().removesuffix("b")
    return int(text[:-1]) << units[text[-1]] if text[-1:] in units else int(text)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores if its files are fewer and smaller than these could read."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    if not 0 < files < cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) else df
