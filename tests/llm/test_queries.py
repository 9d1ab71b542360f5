"""The registered queries on whole small tables, against the libraries and brute force."""

import hashlib
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).parent))
from test_exact import ALNUM, bag, brute_components, brute_hits, brute_measures, low  # noqa: E402
from tests_support import documents  # noqa: E402

from webloom.llm import licenses, queries  # noqa: E402


def run(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


def test_op2(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, at, want = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), 0, []
    for d, text in sorted(documents(sf)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert bag([tuple(r) for r in run(spark, sf, "op2_token_store")]) == bag(want)


def test_op3(spark, sf):
    want = []
    for d, text in documents(sf):
        w, at, labels = ALNUM.findall(low(text)), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        want.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    got = run(spark, sf, "op3_license_scan")
    assert bag([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got]) == bag(want)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_op4(spark, sf):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, sf, "op4_near_duplicates")]
    assert bag(got) == bag([(d, n, c, d == c) for d, n, c in brute_components(documents(sf), 4)])


def test_op6(spark, sf):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    want = []
    for d, text in documents(sf):
        ids = sp.encode(text or "")
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
    assert bag([(r["doc_id"], r["n_pieces"], r["ids_crc32"], r["round_trip"]) for r in run(spark, sf, "op6_sentencepiece")]) == bag(want)


def test_op8(spark, sf):
    got = run(spark, sf, "op8_quality_rules")
    assert bag([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got]) == bag([(d, *brute_measures(t)) for d, t in documents(sf)])
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_op10(spark, sf):
    t = pq.read_table(f"{sf}/benchmark.parquet")
    items = list(zip(t["item_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    want = []
    for d, n, hit, ids in brute_hits(documents(sf), items, 13):
        want.append((d, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * hit >= n))
    assert bag([tuple(r) for r in run(spark, sf, "op10_decontamination")]) == bag(want)


def test_ledger_is_stored_once(spark, sf, tmp_path):
    from webloom.llm import quality_rules as q

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    led = q.write_ledger(q.ledger(q.measured(docs)), f"file://{tmp_path}/ledger")
    plan = q.with_policy(led, "lenient")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1] and "Python" not in plan
    kept = {p: {r["doc_id"] for r in q.with_policy(led, p).where("kept").collect()} for p in q.POLICIES}
    assert kept["v1"] <= kept["lenient"] <= kept["base"] and {r["policy"] for r in q.with_policy(led, "base").collect()} == {"base"}
