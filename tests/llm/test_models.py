"""Held-out accuracy of the trained models, odd inputs, and the pipeline."""

import sys
import zlib
from pathlib import Path

import pyarrow.parquet as pq

from webloom.llm import language_id, quality_model

sys.path.insert(0, str(Path(__file__).parent))
SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    lang = dict(zip(t["doc_id"].to_pylist(), t["lang"].to_pylist(), strict=True))
    got = language_id.op1_language_id(spark, SF).collect()
    assert len(got) == len(lang) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(held) > 0.96 * len(held)


def test_language_odd_inputs(spark, odd, odd_rows, none):
    net = language_id.train_language_id(odd.withColumn("lang", odd["lang"]))
    got = language_id.identify_languages(odd, net, keep=("key", "row")).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (1, 2, 3, 40))
    assert by[4]["lang_pred"] == "en" and by[4]["score"] == 1
    empty = language_id.train_language_id(none)
    assert language_id.identify_languages(none, empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_languages(odd, empty).collect()} == {"und"}


def test_quality_accuracy(spark):
    t = pq.read_table(f"{SF}/labels.parquet")
    label = dict(zip(t["doc_id"].to_pylist(), t["quality"].to_pylist(), strict=True))
    got = quality_model.op7_quality_classifier(spark, SF).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r["predicted"] == label[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in label]
    assert sum(held) > 0.94 * len(held)


def test_quality_odd_inputs(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1), (8, 0), (8, 1), (10, 0), (None, 1), (12, None), (99, 1)], "doc_id long, quality int")
    net = quality_model.train_quality(odd, labels, steps=5)
    assert quality_model.score_quality(odd, net).count() == len(odd_rows)
    one = quality_model.train_quality(odd, labels.where("quality = 1 and doc_id <> 8"))
    assert {r["score"] for r in quality_model.score_quality(odd, one).collect()} == {1.0}
    nothing = quality_model.train_quality(none, labels.limit(0))
    assert {r["score"] for r in quality_model.score_quality(odd, nothing).collect()} == {0.5}
    assert quality_model.score_quality(none, net).count() == 0


def test_windows_cover_everything():
    import numpy as np

    from webloom.llm.bytecnn import ByteCNN

    net = ByteCNN([0, 1], length=32)
    data = np.arange(1, 201, dtype=np.uint8)
    offs = np.array([0, 0, 3, 100, 200])
    windows, bounds, sizes = net.windows(data, offs)
    for i in range(4):
        own = windows[bounds[i] : bounds[i + 1]]
        grams = {tuple(w[j : j + 5].tolist()) for w in own for j in range(28)}
        text = data[offs[i] : offs[i + 1]].tolist()
        assert all(tuple(text[j : j + 5]) in grams for j in range(len(text) - 4))
        assert set(own[own > 0].tolist()) == set(text)


def test_pipeline(spark, sf):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert 0.5 * len(docs) < len(rows) < len(docs) and all(r["round_trip"] for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)


def test_pipeline_stages_on_odd_rows(spark, odd_rows, sf):
    """Nulls in any column, empty and very long texts, repeated rows; extra columns whose names clash; no rows."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(d, t, None if d == 4 else "en", None, None) for d, t in (r[:2] for r in odd_rows)], "doc_id long, text string, lang string, source string, n_chars long")
    clashing = docs.select("*", *[F.lit(1).alias(c) for c in ("key", "row", "kept", "n", "z", "score", "lang_pred", "bands", "runs", "items", "matches", "ids")])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, sf)
        assert out.count() <= docs.count()
        if name != "sentencepiece":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.drop_near_duplicates(spark, docs, sf).where("doc_id = 1 and text is null").count() == 1
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, sf).collect()}
    assert not kept & {1, 2, 3, 40} and 7 in kept


def test_pipeline_stages_against_brute_force(spark, sf):
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece
    from test_exact import WORD, brute_components, brute_hits, brute_passages

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    stages = dict(corpus_pipeline.STAGES)
    got = {r["doc_id"]: r["text"] for r in stages["line_dedup"](spark, docs, sf).collect()}
    want = {d: t for (d, _), (t, n) in zip(rows, brute_passages(rows), strict=True) if not (n and not WORD.search(t))}
    assert got == want
    got = {r["doc_id"] for r in stages["near_dedup"](spark, docs, sf).collect()}
    assert got == {d for d, n, c in brute_components(rows, 5) if d == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r["doc_id"] for r in stages["decontamination"](spark, docs, sf).collect()}
    assert got == {d for d, n, hit, _ in brute_hits(rows, items, 13) if not (hit and 20 * hit >= n)}
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = {r["doc_id"]: r["ids"] for r in stages["sentencepiece"](spark, docs, sf).collect()}
    assert got == {d: sp.encode(t) for d, t in rows}


def test_network_against_loops():
    """Forward pass and gradients of a small network, byte by byte and by differences."""
    import numpy as np

    from webloom.llm.bytecnn import ByteCNN

    rng = np.random.default_rng(3)
    for over in (False, True):
        net = ByteCNN([0, 1, 2], length=12, widths=(2, 3), filters=2, dim=3, over_document=over)
        net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
        examples = [rng.integers(1, 30, (n if over else 1, 12)).astype(np.uint8) for n in (1, 3, 2)]
        labels = np.array([0, 2, 1])

        def loss(net=net, examples=examples, labels=labels, over=over):
            p, total = net.params, 0.0
            for e, y in zip(examples, labels, strict=True):
                pooled = []
                for window in e:
                    row = []
                    for f in range(net.mask.shape[1]):
                        best = max(
                            sum(p["embed"][window[t + j]][d] * p["conv"][j * net.dim + d, f] for j in range(3) for d in range(net.dim)) for t in range(len(window) - 2)
                        )
                        row.append(max(0.0, best + p["bias"][f]))
                    pooled.append(row)
                h = np.array(pooled)
                x = np.concatenate([h.max(axis=0), h.mean(axis=0)]) if over else h[0]
                z = x @ p["out"] + p["out_bias"]
                total -= z[y] - np.log(np.exp(z).sum())
            return total / len(examples)

        windows, bounds = np.concatenate(examples), np.concatenate([[0], np.cumsum([len(e) for e in examples])])
        probabilities = net.probabilities(windows, bounds)[np.arange(3), labels]
        assert abs(-np.log(probabilities).mean() - loss()) < 1e-5
        grads = net._gradients(examples, labels)
        for name, g in grads.items():
            for at in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(12)]:
                if name == "conv" and not net.mask[at] or name == "embed" and at[0] == 0:
                    continue
                old, eps = net.params[name][at], 1e-5
                net.params[name][at] = old + eps
                up = loss()
                net.params[name][at] = old - eps
                down = loss()
                net.params[name][at] = old
                assert abs((up - down) / (2 * eps) - g[at]) < 1e-3, (name, at)


def test_samples_are_bounded_by_rows_and_bytes():
    rows = [{"size": 5}, {"size": None}, {"size": 6}, {"size": 1}]
    assert len(language_id.bounded(rows, 11)) == 3 and len(language_id.bounded(rows, 3)) == 1 and len(language_id.bounded(rows, 100)) == 4


def test_folders_of_a_cluster(spark):
    import pytest

    from webloom.llm import _store

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _store.work_dir(Session())
