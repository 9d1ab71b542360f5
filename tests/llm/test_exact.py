"""Operators against brute force, on odd tables and on the small test tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from tests_support import documents  # noqa: E402

from webloom.llm import _text, components, decontaminate, licenses, line_dedup, near_dups, pieces, quality_rules, repeats, token_store

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return (t or "").translate(ASCII_LOWER)


def bag(rows):
    return Counter(map(repr, rows))


def thue_morse(k):
    """Two words of 2^k letters, each other's mirror, whose polynomial hashes modulo 2^64 agree for k of 10 and more."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


# -- near-duplicates ---------------------------------------------------------------------------------------


def shingles(t, k):
    w = WORD.findall(low(t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        out.append((d, len(sets[i]), min((x for x in keys if x is not None), default=None)))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(odd, odd_rows, k):
    got = [(r["key"], r["n"], r["component"]) for r in near_dups.near_duplicates(odd, k=k, keep=("row", "kept")).collect()]
    assert bag(got) == bag(brute_components([r[:2] for r in odd_rows], k))


def test_near_duplicates_blocks(spark):
    """A group dealt to many blocks: every copy differs, and only some are linked."""
    import random

    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            words[rng.randrange(80)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dups.near_duplicates(df, k=4, block_rows=16)
    assert bag([(r["key"], r["n"], r["component"]) for r in got.collect()]) == bag(brute_components(rows, 4))
    first = got.where("first").count()
    assert first == len({c for _, _, c in brute_components(rows, 4)})


def test_estimates_and_merging():
    sketch = near_dups.SetSketch(m=400)
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for j in (0.3, 0.8):
        common = int(2 * 1000 * j / (1 + j))
        a, b = h[:1000], h[1000 - common : 2000 - common]
        ra, rb = (sketch.registers(x, np.array([0, len(x)])) for x in (a, b))
        n = np.array([1000])
        assert sketch.at_least(j - 0.12, ra, rb, n, n)[0, 0] and not sketch.at_least(j + 0.12, ra, rb, n, n)[0, 0]
        both = np.union1d(a, b)
        assert (sketch.registers(both, np.array([0, len(both)])) == sketch.merged(ra, rb)).all()


def test_components(spark, tmp_path):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 3), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected(df, f"file://{tmp_path}/c").collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}


# -- repeated strings --------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(x[i : i + length] for _, x in texts for i in range(len(x) - length + 1))
    out = []
    for d, x in texts:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        out.append((d, len(x), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "span"), [(40, 20), (64, 50)])
def test_repeats(odd, odd_rows, length, span):
    rows = [r[:2] for r in odd_rows if r[1] is None or len(r[1]) < 20_000]
    df = odd.where("text is null or length(text) < 20000")
    got = [(r["doc_id"], r["n_bytes"], [(s["a"], s["b"]) for s in r["spans"]], r["kept_sha256"]) for r in repeats.repeated_spans(df, length=length, span=span).collect()]
    assert bag(got) == bag(brute_repeats(rows, length))


def test_repeats_shifted_copies(spark):
    import random

    rng = random.Random(2)
    part = "".join(rng.choice("abcd ") for _ in range(300))
    rows = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randrange(90))) + part[rng.randrange(60) : 300 - rng.randrange(60)] + "".join(rng.choice("xy") for _ in range(rng.randrange(9)))) for i in range(60)]
    rows += [(100, "ab" * 200), (101, "z" * 333), (102, "qrs" * 100)]
    got = [(r["doc_id"], r["n_bytes"], [(s["a"], s["b"]) for s in r["spans"]], r["kept_sha256"]) for r in repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length=100, span=50).collect()]
    assert bag(got) == bag(brute_repeats(rows, 100))


@pytest.mark.parametrize("most", [20_000, 3])
def test_repeats_of_long_and_low_texts(spark, odd, odd_rows, most):
    """Long texts, runs of one byte, words that rolling hashes modulo 2^64 take for equal; frequent phrases by windows."""
    import random

    rng = random.Random(8)
    long = [r[1] for r in odd_rows if r[0] == 10][0][:40_000]
    a, b = thue_morse(11)
    rows = [(1, long), (2, long[100:900] + "x" * 700 + long[:1000]), (3, a), (4, b), (5, "x" * 90 + "y"), (6, None), (7, a[:1024] + "#" + a[1024:])]
    common = "".join(rng.choice("abcdef ") for _ in range(70))
    rows += [(10 + i, "".join(rng.choice("abc") for _ in range(60)) + common + "".join(rng.choice("abc") for _ in range(60))) for i in range(40)]
    got = [(r["doc_id"], r["n_bytes"], [(s["a"], s["b"]) for s in r["spans"]], r["kept_sha256"]) for r in repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=72, most=most).collect()]
    assert bag(got) == bag(brute_repeats(rows, 72))


def test_repeats_where_a_pack_has_none(spark):
    rows = [(i, f"{i} own text of document {i * 7919} " * 1 + "x" * (i % 3)) for i in range(6)] + [(10, "".join(chr(97 + i * i % 26) + str(i) for i in range(200)))]
    got = repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length=40).collect()
    assert bag([(r["doc_id"], r["n_bytes"], [(s["a"], s["b"]) for s in r["spans"]], r["kept_sha256"]) for r in got]) == bag(brute_repeats(rows, 40))


def test_suffix_arrays_of_a_block():
    import random

    import pyarrow as pa

    rng = random.Random(3)
    strings = list({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))).encode() for _ in range(60)})
    ranks, begins = repeats.dictionary_ranks(pa.array(strings, pa.binary()))
    suffixes = [(s[i:], int(ranks[b + i])) for s, b in zip(strings, begins.tolist(), strict=True) for i in range(len(s))]
    ordered = sorted({s for s, _ in suffixes})
    of = dict(suffixes)
    assert len({(s, r) for s, r in suffixes}) == len(ordered) and [of[s] for s in ordered] == sorted(of.values())
    values = np.array([rng.randrange(50) for _ in range(300)])
    a = np.array([rng.randrange(299) for _ in range(200)])
    b = np.array([rng.randrange(x + 1, 301) for x in a.tolist()])
    assert repeats.LeastBetween(values)(a, b).tolist() == [min(values[x:y]) for x, y in zip(a, b, strict=True)]


def test_repeats_query(spark, sf):
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.op5_repeated_strings(spark, sf).collect()]
    want = [(d, n, sum(b - a for a, b in s), len(s), h) for d, n, s, h in brute_repeats(documents(sf), 400)]
    assert bag(got) == bag(want)


def test_repeats_query_on_more(spark):
    """All rows of a larger table, long texts included, against counts of digests of all strings."""
    sf = "/root/testdata/sf0.01"
    texts = [(d, (t or "").encode()) for d, t in documents(sf)]
    digest = lambda x: hashlib.blake2b(x, digest_size=12).digest()
    names = [[digest(x[i : i + 400]) for i in range(len(x) - 399)] for _, x in texts]
    seen = Counter(n for own in names for n in own)
    want = []
    for (d, x), own in zip(texts, names, strict=True):
        spans: list[list[int]] = []
        for i, n in enumerate(own):
            if seen[n] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 400
                else:
                    spans.append([i, i + 400])
        kept, at = hashlib.sha256(), 0
        for a, b in spans:
            kept.update(x[at:a])
            at = b
        kept.update(x[at:])
        want.append((d, len(x), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
    assert max(n for _, n, *_ in want) > 20_000 and sum(s for *_, s, _ in want) > 50
    assert bag([tuple(r) for r in repeats.op5_repeated_strings(spark, sf).collect()]) == bag(want)


# -- decontamination ---------------------------------------------------------------------------------------


def brute_hits(rows, items, window):
    found = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        for a in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[a : a + window]), set()).add(str(i))
    sizes = {len(k) for k in found}
    out = []
    for d, t in rows:
        w = ALNUM.findall(low(t))
        hit, ids = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                k = tuple(w[a : a + n])
                if k in found:
                    hit |= set(range(a, a + n))
                    ids |= found[k]
        out.append((d, len(w), len(hit), sorted(ids)))
    return out


@pytest.mark.parametrize("most", [32 << 20, 400])
def test_benchmark_matches(spark, odd, odd_rows, most):
    items = [(1, " ".join(odd_rows[8][1].split()[5:30])), (2, "line two here line"), (2, "rights RESERVED"), (3, None), (4, ""), (None, "alpha"), (5, "not there at all"), (6, " ".join(odd_rows[5][1].split()[:13]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.benchmark_matches(odd, bench, max_benchmark_bytes=most, keep=("key",)).collect()]
    assert bag(got) == bag(brute_hits([r[:2] for r in odd_rows], [i for i in items if i[0] is not None], 13))


def brute_matches(rows, items, window):
    """All verbatim matches of a window or more (of a whole shorter item) that can't be made longer."""
    out = []
    for d, t in rows:
        w, got = ALNUM.findall(low(t)), set()
        for i, text in items:
            b = ALNUM.findall(low(text))
            n = min(window, len(b))
            for x in range(len(w)):
                for y in range(len(b)):
                    if w[x] == b[y] and not (x and y and w[x - 1] == b[y - 1]):
                        k = 0
                        while x + k < len(w) and y + k < len(b) and w[x + k] == b[y + k]:
                            k += 1
                        if k >= n:
                            got.add((x, x + k, str(i), y))
        out.append((d, sorted(got)))
    return out


@pytest.mark.parametrize("window", [1, 3, 13, 17, 24])
def test_benchmark_windows_and_longest_matches(spark, window):
    import random

    rng = random.Random(window)
    items = [(i, " ".join(rng.choice("abcd") + rng.choice("xy") for _ in range(rng.choice([2, 9, 30, 45])))) for i in range(6)]
    rows = [(1, None), (2, "")]
    for d in range(3, 20):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            parts += w[a : a + rng.randrange(1, 40)] + [rng.choice(["ax", "q", "by"])]
        rows.append((d, " ".join(parts)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for most in (8 << 20, 100):
        got = decontaminate.benchmark_matches(docs, bench, window=window, max_benchmark_bytes=most).collect()
        assert bag([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got]) == bag(brute_hits(rows, items, window))
        assert bag([(r["doc_id"], sorted(map(tuple, r["matches"]))) for r in got]) == bag(brute_matches(rows, items, window))
        assert all(r["longest"] == max((m["b"] - m["a"] for m in r["matches"]), default=0) for r in got)


def test_words_that_rolling_hashes_confuse(spark):
    """Two words whose polynomial hashes modulo 2^64 agree are different words to every operator."""
    a, b = thue_morse(10)
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {r["key"]: r["component"] for r in near_dups.near_duplicates(df).collect()} == {1: 1, 2: 2}
    got = decontaminate.benchmark_matches(df, spark.createDataFrame([(1, a)], "item_id long, text string"))
    assert {r["doc_id"]: r["n_hit"] for r in got.collect()} == {1: 1, 2: 0}
    got = licenses.scan_licenses(df, phrases={a: "it"})
    assert {r["doc_id"]: r["n_base"] for r in got.collect()} == {1: 1, 2: 0}
    got = repeats.repeated_spans(df, length=512)
    assert {(r["doc_id"], r["n_bytes"], len(r["spans"])) for r in got.collect()} == {(d, n, len(s)) for d, n, s, _ in brute_repeats([(1, a), (2, b)], 512)}
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, f"{a}\n{a}"), (2, f"{b}\n{b}")], "doc_id long, text string"), passages=True)
    assert all(not r["n_removed_bytes"] for r in got.collect())


# -- quality rules -----------------------------------------------------------------------------------------


def brute_measures(t):
    t = t or ""
    w = WORD.findall(t)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(odd, odd_rows):
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.measured(odd).collect()]
    assert bag(got) == bag([(d, *brute_measures(t)) for d, t in (r[:2] for r in odd_rows)])


def test_ledger(odd):
    led = quality_rules.ledger(quality_rules.measured(odd)).cache()
    kept = quality_rules.with_policy(led).collect()
    assert all(not (r["base_failed"] and r["kept"]) for r in kept)
    counts = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality_rules.ablations(led).collect()}
    masks = [r["failed"] for r in kept]
    for rule in quality_rules.RULES:
        assert counts[rule.name] == (sum(m >> rule.bit & 1 for m in masks), sum(m == 1 << rule.bit for m in masks))


def test_rules_keep_clean_documents(spark):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    got = quality_rules.op8_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    good, lost = got.where("quality = 1 and n_words >= 50").select(F.count("*"), F.count_if(~F.col("kept"))).first()
    bad, caught = got.where("quality = 0").select(F.count("*"), F.count_if(~F.col("kept"))).first()
    assert lost <= 0.02 * good and caught >= 0.7 * bad


# -- licences ----------------------------------------------------------------------------------------------


def test_licenses(odd, odd_rows):
    rows = {}
    for d, t in (r[:2] for r in odd_rows):
        w = ALNUM.findall(low(t))
        at, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        rows.setdefault(d, []).append((len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    for r in licenses.scan_licenses(odd).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in rows[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        if r["doc_id"] == 41:
            assert r["labels"] == "cc-by,cc-by-nc-4.0,reserved" and r["score"] == 1


def test_license_spans(spark):
    notice = "x y Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files z"
    got = licenses.scan_licenses(spark.createDataFrame([(1, notice), (2, "free of charge to any person")], "doc_id long, text string")).collect()
    span = next(r for r in got if r["doc_id"] == 1)["spans"][0]
    assert span["label"] == "mit" and span["first_word"] == 2 and 0.8 < span["share"] < 1
    assert not next(r for r in got if r["doc_id"] == 2)["spans"]


def test_license_phrase_of_one_word(spark):
    df = spark.createDataFrame([(1, "zzz yyy copyleft xxx Copyleft"), (2, "zzz yyy"), (3, "copyleft")], "doc_id long, text string")
    got = licenses.scan_licenses(df, phrases={"copyleft": "copyleft", "all rights reserved": "reserved"}).collect()
    assert sorted((r["doc_id"], r["n_base"], r["first_word"], r["last_word"]) for r in got) == [(1, 2, 2, 4), (2, 0, None, None), (3, 1, 0, 0)]


def test_automaton_matching_statistics():
    import random

    rng = random.Random(0)
    auto = licenses.Automaton()
    texts = [[rng.randrange(4) for _ in range(30)] for _ in range(5)]
    for i, t in enumerate(texts):
        auto.add(i, t)
    parts = {tuple(t[a:b]) for t in texts for a in range(30) for b in range(a, 31)}
    query = [rng.randrange(4) for _ in range(300)]
    state = size = 0
    for i, c in enumerate(query):
        while state and c not in auto.next[state]:
            state = auto.link[state]
            size = auto.length[state]
        if c in auto.next[state]:
            state, size = auto.next[state][c], size + 1
        assert size == max(n for n in range(31) if n <= i + 1 and tuple(query[i + 1 - n : i + 1]) in parts)
        for t, end in auto.places[state].items():
            assert texts[t][end - size : end] == query[i + 1 - size : i + 1]


# -- pieces and ids ----------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark, odd, odd_rows):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    rows = [r[:2] for r in odd_rows] + [(60 + k, " " * k + "x" + " " * (k % 3)) for k in range(25)]
    rows += [(100, "\n a\n\n  b \n"), (101, " "), (102, "a b  c\td")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pieces.encode_pieces(df)
    want = bag([(d, sp.encode(t or "")) for d, t in rows])
    assert bag([(r["doc_id"], r["ids"]) for r in got.collect()]) == want
    assert got.where("not round_trip").count() == 0
    back = pieces.decode_pieces(got)
    assert bag([(r["doc_id"], r["text"]) for r in back.collect()]) == bag([(d, t or "") for d, t in rows])


def test_pieces_of_zero_characters(spark):
    """U+0000 is a character of the text: its part has its own ids, and other texts of the batch keep theirs."""
    import public_tokenizers
    import sentencepiece

    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = ["alpha beta", "\0", "a\0b", "x \0\0 y\0", "\0lead", "trail\0", " \0 ", "漢\0字\n\0\nbeta", "the\0 of the", "alpha beta", "😀\0"]
    want = [sp.encode(t) for t in texts]
    coder, m = pieces.Encoder(pieces._model(model)), pieces._model(model)
    # A second batch reads the parts kept from the first.
    for batch in (texts, texts[::-1]):
        expected = want if batch is texts else want[::-1]
        block = _block(batch)
        ids, counts = coder.encode(*pieces.with_prefix(block.buf, block.offs))
        ends = np.cumsum(counts)
        assert [ids[e - c : e].tolist() for c, e in zip(counts, ends, strict=True)] == expected
        assert [pieces.decoded(ids[e - c : e], m) for c, e in zip(counts, ends, strict=True)] == batch
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in pieces.encode_pieces(df).collect()}
    assert [got[i]["ids"] for i in range(len(texts))] == want and all(r["round_trip"] for r in got.values())


def test_seams_against_merges():
    """Whether two tokens stay apart, by the merges at their edges, equals running all merges."""
    import random

    import public_tokenizers

    m = pieces._model(str(public_tokenizers.path("piece_bpe_32k.model")))
    rng = random.Random(6)
    names = list(m.ids)
    short = [p for p in names if len(p) <= 3]
    for _ in range(8000):
        a, b = rng.choice(rng.choice([names, short])), rng.choice(rng.choice([names, short]))
        assert m.apart(a, b) == (m.merged(a + b) == [a, b]), (a, b)


def test_token_store(spark, odd, odd_rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    path = f"file://{tmp_path}/store"
    token_store.write_store(odd, path)
    got = token_store.document_checksums(spark, path).orderBy("start").collect()
    ids = {}
    for d, text in (r[:2] for r in odd_rows):
        ids.setdefault(d, []).append([*t.encode(text or "", add_special_tokens=False).ids, 2])
    assert [r["key"] for r in got] == sorted((r[0] for r in odd_rows), key=lambda k: (k is not None, k))
    at = 0
    for r in got:
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[r["key"]]] and r["start"] == at
        at += r["n_tokens"]
    assert bag([(r["key"], r["ids"]) for r in token_store.read_documents(spark, path).collect()]) == bag([(d, x) for d, xs in ids.items() for x in xs])
    assert token_store.verify_manifest(spark, path).count() == 0
    chunks = [r["digests"][i : i + 16] for r in token_store._chunks(spark, path).collect() for i in range(0, len(r["digests"]), 16)]
    assert len(chunks) == len({bytes(c) for c in chunks})


def test_damage_is_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(spark.createDataFrame([(1, "some text " * 50)], "doc_id long, text string"), path)
    rows = token_store._chunks(spark, path).collect()
    bad = rows[0].asDict() | {"digests": bytearray(b"x" * len(rows[0]["digests"]))}
    with pytest.raises(token_store.CorruptStore):
        list(token_store._unpacked(bad))


def test_recipes_and_manifest_are_verified(spark, tmp_path):
    """Recipes swapped within a pack, each sound by itself, and a pack that is gone."""
    path = f"file://{tmp_path}/store"
    token_store.write_store(spark.createDataFrame([(i, f"text number {i} " * (i + 1)) for i in range(8)], "doc_id long, text string").repartition(2), path)
    assert token_store.document_checksums(spark, path).count() == 8 and token_store.verify_manifest(spark, path).count() == 0
    assert len(token_store.store_root(spark, path)) == 64
    recipes = spark.read.parquet(f"{path}/recipes")
    rows = [r.asDict() for r in recipes.orderBy("part", "local").collect()]
    same = [i for i in range(1, 8) if rows[i]["part"] == rows[i - 1]["part"]][0]
    for c in ("digests", "sizes", "root"):
        rows[same][c], rows[same - 1][c] = rows[same - 1][c], rows[same][c]
    n = rows[same]["n"], rows[same - 1]["n"]
    rows[same - 1]["n"], rows[same]["n"] = n
    rows[same]["local"] = rows[same - 1]["local"] + n[0]
    whole = spark.createDataFrame(rows, recipes.schema)
    whole.write.parquet(f"{path}-b/recipes")
    gone = spark.createDataFrame([r for r in rows if r["part"] != rows[0]["part"]], recipes.schema)
    gone.write.parquet(f"{path}-c/recipes")
    for x in "bc":
        for t in ("blocks", "manifest"):
            spark.read.parquet(f"{path}/{t}").write.parquet(f"{path}-{x}/{t}", partitionBy=["kind"] if t == "blocks" else None)
        assert token_store.verify_manifest(spark, f"{path}-{x}").count()
        with pytest.raises(Exception, match="CorruptStore"):
            token_store.document_checksums(spark, f"{path}-{x}").collect()


def _block(texts):
    import pyarrow as pa

    return next(_text.blocks(pa.record_batch([pa.array(texts, pa.string())], ["text"]), "text", 1 << 30))


def test_parts_against_the_regular_expression():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    rule = re.compile("'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\\s+(?!\\S)|\\s+")
    rng = random.Random(1)
    bits = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "é", "a", "Z", "1", "!", "\t", "'s", "don't", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(3000)]
    block = _block(texts)
    begins, data = token_store.parts_of(block.buf, block.offs).tolist(), block.buf.tobytes()
    assert [data[a:b].decode() for a, b in zip(begins, [*begins[1:], len(data)], strict=True)] == [p for t in texts for p in rule.findall(t)]
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    t, coder = Tokenizer.from_file(path), token_store.Coder(path)
    texts += ["漢字 it's", "<|endoftext|> x", "a × b", "", "x\x1cy", "é" * 5000]
    for _ in range(2):
        rng.shuffle(texts)
        ids, bounds = coder.encode(_block(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    cuts = token_store.Cuts()
    marks = cuts.marks(ids, bounds)
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        assert (marks[(marks > a) & (marks <= b)] - a).tolist() == cuts.marks(ids[a:b], np.array([0, b - a])).tolist()


# -- lines -------------------------------------------------------------------------------------------------


def test_line_dedup(odd, odd_rows):
    from pyspark.sql import functions as F

    # A repeated document of several lines is cut like its first, wherever the boundaries fall.
    odd, odd_rows = odd.union(odd.where("doc_id = 43").withColumn("doc_id", F.lit(44))), [*odd_rows, (44, odd_rows[-1][1])]
    got = line_dedup.dedup_lines(odd, keep=("kept", "row")).collect()
    assert Counter(r["key"] for r in got) == Counter(r[0] for r in odd_rows)
    assert [r["text"] for r in got if r["key"] == 44] == [""]
    texts = {}
    for d, t in (r[:2] for r in odd_rows):
        texts.setdefault(d, []).append(t)
    for r in got:
        assert any((t is None) == (r["text"] is None) for t in texts[r["key"]])
        if not r["n_removed_chunks"]:
            assert r["text"] in texts[r["key"]]
    assert sum(r["n_removed_chunks"] for r in got) >= 1


def test_line_dedup_against_brute_force(spark):
    import random

    rng = random.Random(3)
    lines = [f"line number {i} of some text" for i in range(400)]
    shared = lines[:40]
    rows = [(i, "\n".join(rng.sample(lines[40:], rng.randrange(1, 9)) + (shared if i % 3 == 0 else []) + rng.sample(lines[40:], 3) + [f"own {i}"])) for i in range(30)]
    got = {r["key"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    seen, want = set(), {}
    for d, t in sorted(rows):
        data = t.encode()
        begins, ends, _, worded, _ = line_dedup.line_chunks(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        out = b""
        for a, b, w in zip(begins.tolist(), ends.tolist(), worded.tolist(), strict=True):
            body = data[a:b].rstrip(b"\n")
            if w >= 2 and body in seen:
                continue
            if w >= 2:
                seen.add(body)
            out += data[a:b]
        want[d] = out.decode().rstrip("\n") if not t.endswith("\n") else out.decode()
    assert {d: r["text"] for d, r in got.items()} == want
    assert sum(r["n_removed_chunks"] for r in got.values()) >= 9


def brute_passages(rows, long_words=50):
    """Without hashes or chunks: a line goes if an earlier place, by key, then row and line, has it with its
    neighbour with words (and the blank lines between), or alone if it is long. (text left, runs removed) by row."""
    seen, out = set(), []
    for _, t in rows:
        lines = (t or "").split("\n")
        worded = [i for i, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for i, j in [*zip(worded, worded[1:]), *((i, i) for i in worded if len(WORD.findall(lines[i])) > long_words)]:
            passage = "\n".join(lines[i : j + 1])
            if passage in seen:
                gone |= set(range(i, j + 1))
            seen.add(passage)
        left = [x for i, x in enumerate(lines) if i not in gone]
        runs = len([i for i in gone if i - 1 not in gone])
        out.append((None if t is None else "\n".join(left), runs))
    return out


def test_line_passages(spark):
    """Copies at any place and of any length, among other lines, with blank lines, at the edges of a document."""
    import random

    rng = random.Random(5)
    lines = [f"line number {i} of some text" if i % 5 else " ".join(f"w{i * j}" for j in range(40 + i % 30)) for i in range(150)]
    for i in range(0, 150, 7):
        lines[i] += "\n\n \n"
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "x\nx\nx\nx"), (5, lines[0].strip()), (6, lines[0].strip()), (7, "short"), (8, "short")]
    for d in range(10, 90):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(150)
            parts += [rng.choice(lines) for _ in range(rng.randrange(3))] + lines[a : a + rng.randrange(1, 7)] + [f"own {d} {rng.random()}"]
        rows.append((d, "\n".join(parts[rng.randrange(2) : len(parts) - rng.randrange(2)]) + rng.choice(["", "\n"])))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), passages=True).collect()
    want = [(d, *x) for (d, _), x in zip(rows, brute_passages(rows), strict=True)]
    assert bag([(r["key"], r["text"], r["n_removed_chunks"]) for r in got]) == bag(want)
    assert sum(n for _, _, n in want) > 50


def test_line_dedup_query(spark, sf):
    """No repeated passage stays, whole documents included."""
    rows = sorted(documents(sf))
    got = line_dedup.op9_line_dedup(spark, sf).collect()
    want = [(d, hashlib.sha256(t.encode()).hexdigest(), n) for (d, _), (t, n) in zip(rows, brute_passages(rows), strict=True)]
    assert bag([(r["doc_id"], r["kept_sha256"], r["n_removed_chunks"]) for r in got]) == bag(want)


# -- no rows at all ----------------------------------------------------------------------------------------


def test_empty_tables(spark, none, tmp_path):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert near_dups.near_duplicates(none).count() == 0
    assert repeats.repeated_spans(none).count() == 0
    assert decontaminate.benchmark_matches(none, bench).count() == 0
    assert quality_rules.measured(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert pieces.round_trips(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    path = f"file://{tmp_path}/store"
    token_store.write_store(none, path)
    assert token_store.document_checksums(spark, path).count() == 0
