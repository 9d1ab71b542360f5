"""Language identification by a byte convolutional network trained on labelled text.

The network (``bytecnn``) is fitted on the driver on a bounded sample of labelled rows and applied, in
batches, to fixed-length windows that cover every whole text; a text's probabilities are its windows', each
weighed by its bytes. Nothing is shuffled when it is applied.

Defined results: all windows of a very long text count, each by its bytes; null text, and text without a letter, is ``und`` with score 0; without any labelled row
every text is; one label only gives that label with score 1; repeated rows give repeated results; equal
probabilities go to the label first in order; a null key stays null and is never learnt from; no other
column is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import _text
from webloom.llm.bytecnn import ByteCNN

UNKNOWN = "und"


def bounded(rows: list, max_bytes: int) -> list:
    """The first of these rows (with ``size``) whose texts have ``max_bytes`` bytes together at most; one at least."""
    out, total = [], 0
    for r in rows:
        total += r["size"] or 0
        if out and total > max_bytes:
            break
        out.append(r)
    return out


def all_windows(docs: DataFrame, sample: DataFrame, key: str, text: str, net: ByteCNN) -> tuple[list[np.ndarray], list]:
    """All windows of the whole text, and the label, of each row of ``docs`` that has a row of ``sample`` (key, label;
    bounded by the caller, so it may be broadcast)."""
    label = dict(sample.dtypes)["label"]
    picked = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), "k")

    def work(block: _text.Block) -> dict:
        windows, bounds, _ = net.windows(block.buf, block.offs)
        out = [windows[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return {"k": block.columns["k"], "label": block.columns["label"], "w": pa.array(out, pa.binary())}

    kind = dict(picked.dtypes)["k"]
    rows = _text.map_blocks(picked, {"k": "k", "text": "text", "label": "label"}, work, f"k {kind}, label {label}, w binary").collect()
    rows = sorted(rows, key=lambda r: (str(r["k"]), str(r["label"]), bytes(r["w"])))
    return [np.frombuffer(bytes(r["w"]), np.uint8).reshape(-1, net.length) for r in rows], [r["label"] for r in rows]


def train_language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", *, max_rows: int = 3000, max_bytes: int = 8 << 20, length: int = 256, steps: int = 450, batch: int = 64) -> ByteCNN:
    """Fit on all windows of the whole texts of a bounded sample of labelled rows: those first in the order of a hash of
    their keys, ``max_rows`` at most, and of these as many as have ``max_bytes`` of text together. Every window is seen
    once at least, whatever ``steps``."""
    rows = docs.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull())
    sample = rows.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("string").alias("label"), F.octet_length(F.col(f"`{text}`")).cast("long").alias("size"))
    sample = sample.groupBy("k", "label").agg(F.sum("size").alias("size")).orderBy(F.xxhash64("k"), "k", "label").limit(max_rows).collect()
    sample = [(r["k"], r["label"]) for r in bounded(sample, max_bytes)]
    classes = sorted({k for _, k in sample})
    net = ByteCNN(classes, length=length, fold_case=True)
    if len(classes) < 2:
        return net
    picked = docs.sparkSession.createDataFrame(sample, f"k {dict(docs.dtypes)[key]}, label string")
    examples, labels = all_windows(docs, picked, key, text, net)
    windows = [w[None] for e in examples for w in e if w.any()]
    index = {c: i for i, c in enumerate(classes)}
    targets = np.array([index[k] for e, k in zip(examples, labels, strict=True) for w in e if w.any()])
    return net.fit(windows, targets, steps=max(steps, -(-len(windows) // batch)), batch=batch)


def identify_languages(docs: DataFrame, net: ByteCNN, key: str = "doc_id", text: str = "text", *, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, lang_pred, score, probabilities, kept): ``probabilities`` in the order of ``net.classes``."""
    kind = dict(docs.dtypes)[key]
    sent = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias("letters"), _text.kept(keep))

    def work(block: _text.Block) -> dict:
        net = sent.value
        n = len(net.classes)
        if n > 1:
            windows, bounds, sizes = net.windows(block.buf, block.offs)
            p = net.probabilities(windows, bounds) * np.maximum(sizes, 1)[:, None]
            p = np.add.reduceat(p, bounds[:-1])
            p = (p / p.sum(axis=1, keepdims=True)).astype(np.float64)
        else:
            p = np.ones((block.n, n))
        letters = block.columns["letters"].to_numpy(zero_copy_only=False).astype(bool) & (n > 0)
        best = p.argmax(axis=1) if n else np.zeros(block.n, int)
        return {
            "key": block.columns["key"],
            "kept": block.columns["kept"],
            "lang_pred": [net.classes[b] if x else UNKNOWN for b, x in zip(best.tolist(), letters.tolist(), strict=True)],
            "score": np.where(letters, p.max(axis=1, initial=0), 0.0),
            "probabilities": [r if x else [] for r, x in zip(p.tolist(), letters.tolist(), strict=True)],
        }

    out = _text.map_blocks(rows, {c: c for c in rows.columns}, work, f"key {kind}, lang_pred string, score double, probabilities array<double>, kept {dict(rows.dtypes)['kept']}")
    return out.withColumnRenamed("key", key)


def remainder(key: str, n: int):
    """The key's CRC-32, as text, modulo ``n``; null for a null key."""
    return F.crc32(F.col(f"`{key}`").cast("string")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    net = train_language_id(docs.where(remainder("doc_id", 3) != 1))
    found = identify_languages(docs, net)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
