"""Quality scores by a byte-level convolutional network over whole documents.

Learned filters run over overlapping chunks that cover the document; each chunk is max-pooled, the chunks
are combined (maximum and mean of every filter) and a softmax gives one probability. The network is fitted
on the driver on a bounded sample of labelled rows; it is applied in batches and shuffles nothing.

Defined results: all chunks of a very long text count; null and empty text get the score of an empty window; without labels, or with labels of one
class only, every score is that class's (0.5 without any); labels that contradict each other for a key are
left out; repeated rows give repeated results; a null key stays null and is never learnt from; no other
column is read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import _text
from webloom.llm.bytecnn import ByteCNN
from webloom.llm.language_id import all_windows, bounded, remainder


def train_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", *, max_rows: int = 4000, max_bytes: int = 16 << 20, length: int = 256, steps: int = 800, batch: int = 16
) -> ByteCNN:
    """Fit on all chunks of the whole texts of a bounded sample of labelled keys: those first in the order of a hash of the
    keys, ``max_rows`` at most, and of these as many as have ``max_bytes`` of text together. Labels are 0 and 1."""
    votes = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("k is not null and y in (0, 1)")
    agreed = votes.groupBy("k").agg(F.min("y").alias("label"), F.max("y").alias("other")).where("label = other").drop("other")
    kind = f"k {dict(labels.dtypes)[key]}, label int"
    first = agreed.orderBy(F.xxhash64("k"), "k").limit(max_rows).collect()
    classes = sorted({r["label"] for r in first})
    net = ByteCNN(classes, length=length, over_document=True)
    if len(classes) < 2:
        return net
    spark = docs.sparkSession
    sizes = docs.select(F.col(f"`{key}`").alias("k"), F.octet_length(F.col(f"`{text}`")).cast("long").alias("size")).join(F.broadcast(spark.createDataFrame(first, kind)), "k")
    sizes = sizes.groupBy("k", "label").agg(F.sum("size").alias("size")).orderBy(F.xxhash64("k"), "k").collect()
    sample = [(r["k"], r["label"]) for r in bounded(sizes, max_bytes)]
    if not sample:
        return net
    examples, targets = all_windows(docs, spark.createDataFrame(sample, kind), key, text, net)
    return net.fit(examples, np.array(targets), steps=steps, batch=batch)


def score_quality(docs: DataFrame, net: ByteCNN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the probability of label 1."""
    kind = dict(docs.dtypes)[key]
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def work(block: _text.Block) -> dict:
        net = sent.value
        if len(net.classes) < 2:
            score = np.full(block.n, float(net.classes[0]) if net.classes else 0.5)
        else:
            windows, bounds, _ = net.windows(block.buf, block.offs)
            score = net.probabilities(windows, bounds)[:, 1].astype(np.float64)
        return {"key": block.columns["key"], "score": score}

    return _text.map_blocks(docs, {"key": key, "text": text}, work, f"key {kind}, score double").withColumnRenamed("key", key)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 4) != 2)
    scored = score_quality(docs, train_quality(docs, labels))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
