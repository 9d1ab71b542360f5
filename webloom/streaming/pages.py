"""Programs over streams of pages. Extraction is stateless per page, so the batch plan runs as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from webloom.operators.extract import extract
from webloom.plans.program import Program


def read_pages(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """New files of pages in a folder as a stream."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def extract_stream(program: Program, pages: DataFrame, html: str = "html", **options) -> DataFrame:
    """As ``extract``, over a stream."""
    if not pages.isStreaming:
        raise ValueError("not a stream")
    return extract(program, pages, html, **options)


def distinct_urls(pages: DataFrame, url: str, event_time: str, delay: str) -> DataFrame:
    """Each URL once within the watermark; state is bounded by ``delay``."""
    return pages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([url])


def write_batches(results: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], available_now: bool = True) -> StreamingQuery:
    """Hand each batch to ``sink``, which must be idempotent in the batch's number."""
    writer = results.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
