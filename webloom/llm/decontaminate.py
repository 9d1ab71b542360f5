"""Benchmark decontamination with suffix arrays over the training text.

Each shard of documents (a block of whole documents) gets a suffix array of its words, by prefix doubling. Every suffix
of every benchmark item that has a window's words is binary-searched in it; the range found gives all places of
its first words. Places and suffixes that lie on one diagonal, one after another, are one verbatim match, as long as
it can be: its words in the document, its item and its place there come back. Windows of any length are read off
the matches, and from them the words that are hit.

Words are compared by their bytes: the benchmark's words are numbered, and a document's are looked up among them; others
match nothing. A shard lives in one task's memory and nothing is shuffled: the benchmark travels to the documents,
as its words and their numbers, never more than its text. It is sent whole only if its checked size is below
``max_benchmark_bytes``; a larger one is sent in groups of items of at most that size (by a hash of their ids), and what
is found is united per document.

Windows are ``window`` consecutive words of an item; an item with fewer words, but not none, is one window.

Defined results: null or empty texts have no words and are never hit; a very long text is a shard of its own; rows of one
item id are one item; items without id are left out; matches at one place come in order of their ends, items and places
there; repeated documents give repeated rows; empty tables give no hits; no other columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import _store, _suffixes, _text


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """(words, bounds of each document's)."""
    low = _text.LOWER[buf]
    starts, ends, bounds = _text.word_spans(low, offs, _text.ALNUM)
    return _text.word_array(low, starts, ends), bounds


@dataclass
class Benchmark:
    """Rows of items as numbers of words, 1 and up, a 0 after each row. ``item``: the index into ``ids`` of each row;
    ``suffixes``: where the suffixes begin that have a window; ``sizes``: the words of those windows."""

    vocabulary: pa.Array
    words: np.ndarray
    row: np.ndarray
    begins: np.ndarray
    item: np.ndarray
    ids: list[str]
    suffixes: np.ndarray
    sizes: np.ndarray


def benchmark_of(rows: list[tuple[object, str | None]], window: int) -> Benchmark:
    rows = sorted(((str(i), t or "") for i, t in rows if i is not None), key=lambda r: r)
    ids = sorted({i for i, _ in rows})
    number = {x: k for k, x in enumerate(ids)}
    texts = [t.encode() for _, t in rows]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words, bounds = _words(np.frombuffer(b"".join(texts), np.uint8), offs)
    found = words.dictionary_encode()
    n = np.diff(bounds)
    out = np.zeros(len(words) + len(rows), np.int32)
    begins = bounds[:-1] + np.arange(len(rows))
    out[_text.ragged(begins, n)] = found.indices.to_numpy() + 1
    size = np.minimum(n, window)
    count = np.where(n > 0, n - size + 1, 0)
    row = np.repeat(np.arange(len(rows)), count)
    return Benchmark(found.dictionary, out, row, begins, np.array([number[i] for i, _ in rows], np.int64), ids, _text.ragged(begins, count), size[row])


class Shard:
    """The suffix array of the words of a block, 0 for words that no item has and between documents."""

    def __init__(self, words: np.ndarray, window: int):
        self.words = np.concatenate([words, np.zeros(window, np.int32)])
        n = len(words)
        inside = words > 0
        #: Words up to the next 0.
        end = np.where(inside, n, np.arange(n))
        left = np.minimum.accumulate(end[::-1])[::-1] - np.arange(n) if n else end
        ranks = _suffixes.suffix_ranks(words.astype(np.int64), left, 1, window)
        places = np.flatnonzero(inside)
        self.suffixes = places[np.argsort(ranks[places], kind="stable")]
        self.present = np.zeros(int(words.max(initial=0)) + 1, bool)
        self.present[words] = True

    def search(self, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, from, to): the ranges of the suffix array that begin with a window of the benchmark."""
        there = np.zeros(int(bench.words.max(initial=0)) + 1, bool)
        there[: len(self.present)] = self.present
        there[0] = False
        seen = np.concatenate([[0], np.cumsum(there[bench.words])])
        sought = np.flatnonzero(seen[bench.suffixes + bench.sizes] - seen[bench.suffixes] == bench.sizes)
        begins, sizes = bench.suffixes[sought], bench.sizes[sought]
        low = self._bound(bench.words, begins, sizes, False)
        high = self._bound(bench.words, begins, sizes, True)
        some = high > low
        return sought[some], low[some], high[some]

    def _bound(self, words: np.ndarray, begins: np.ndarray, sizes: np.ndarray, after: bool) -> np.ndarray:
        low, high = np.zeros(len(begins), np.int64), np.full(len(begins), len(self.suffixes), np.int64)
        most = int(sizes.max(initial=0))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            here = self.suffixes[mid]
            below = np.full(len(open_), after)
            # Words are compared until they differ, for those that haven't yet.
            same = np.arange(len(open_))
            for k in range(most):
                same = same[sizes[open_[same]] > k]
                if not len(same):
                    break
                x, y = self.words[here[same] + k], words[begins[open_[same]] + k]
                differs = x != y
                below[same[differs]] = x[differs] < y[differs]
                same = same[~differs]
            low[open_[below]] = mid[below] + 1
            high[open_[~below]] = mid[~below]
        return low


def matches(block: _text.Block, bench: Benchmark, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each document; and of each match the document, first word, word after the last, row of the benchmark, word there),
    ordered by these. Matches have a window at least and can't be made longer."""
    words, bounds = _words(block.buf, block.offs)
    none = np.zeros(0, np.int64)
    if not len(words) or not len(bench.suffixes):
        return np.diff(bounds), none, none, none, none, none
    numbers = pc.index_in(words, value_set=bench.vocabulary).fill_null(-1).to_numpy() + 1
    doc = np.repeat(np.arange(block.n), np.diff(bounds))
    placed = np.zeros(len(words) + block.n, np.int32)
    placed[np.arange(len(words)) + doc] = numbers
    shard = Shard(placed, window)
    which, low, high = shard.search(bench)
    counts = high - low
    place = shard.suffixes[_text.ragged(low, counts)]
    which = np.repeat(which, counts)
    at = bench.suffixes[which]
    # Neighbours on a diagonal, in one row and one document (a 0 lies between others), are one match.
    order = np.lexsort((place, place - at))
    place, at, which = place[order], at[order], which[order]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1] + 1) | (at[1:] != at[:-1] + 1)])) if len(place) else none
    last = np.append(new[1:], len(place)) - 1
    first, row = place[new], bench.row[which[new]]
    size = last - new + bench.sizes[which[new]] if len(new) else none
    of = np.searchsorted(bounds[1:] + np.arange(1, block.n + 1), first, "right")
    begin = first - (bounds[of] + of)
    there = at[new] - bench.begins[row]
    order = np.lexsort((there, row, begin + size, begin, of))
    return np.diff(bounds), of[order], begin[order], (begin + size)[order], row[order], there[order]


def _united_runs(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs without overlaps or contact, from runs in order of document and beginning."""
    if not len(doc):
        return doc, begin, end
    width = int(end.max()) + 2
    reach = np.maximum.accumulate(doc * width + end)
    new = np.flatnonzero(np.concatenate([[True], doc[1:] * width + begin[1:] > reach[:-1]]))
    until = reach[np.append(new[1:], len(doc)) - 1] - doc[new] * width
    return doc[new], begin[new], until


def _lists(of: np.ndarray, n: int, **columns) -> pa.Array:
    return _text.ragged_lists(pa.StructArray.from_arrays(list(columns.values()), list(columns)), np.bincount(of, minlength=n), None)


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", *, item: str = "item_id", item_text: str = "text", window: int = 13, max_benchmark_bytes: int = 8 << 20, shard_bytes: int = 8 << 20, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, n_words, n_hit, longest, runs, items, matches, kept): for each document the runs of words inside a benchmark window
    [first, after the last), the ids, as strings, of the items with a window in it, the words of the longest verbatim match, and
    all matches that can't be made longer: their words [a, b), the item and the word ``at`` there, in its row."""
    spark = docs.sparkSession
    picked = benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i is not null")
    size = picked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    groups = -(-size // max_benchmark_bytes) or 1
    kind = dict(docs.dtypes)[key]
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), _text.kept(keep))
    columns = {"key": "key", "text": "text", "kept": "kept"}
    schema = f"key {kind}, kept {dict(docs.dtypes)['kept']}, n_words long, runs array<struct<a:long,b:long>>, items array<string>, matches array<struct<a:long,b:long,item:string,at:long>>"
    if groups > 1:
        docs = _store.written(docs.select(F.monotonically_increasing_id().alias("row"), "*"), _store.work_dir(spark))
        columns, schema = {"row": "row", **columns}, "row long, " + schema
    parts = []
    for g in range(groups):
        part = picked if groups == 1 else picked.where(F.pmod(F.xxhash64("i"), F.lit(groups)) == g)
        sent = spark.sparkContext.broadcast(benchmark_of([tuple(r) for r in part.collect()], window))

        def work(block: _text.Block, sent=sent) -> dict:
            bench = sent.value
            n_words, doc, begin, end, row, at = matches(block, bench, window)
            ids = pa.array(bench.ids, pa.string())
            names = ids.take(pa.array(bench.item[row]))
            run_doc, run_a, run_b = _united_runs(doc, begin, end)
            pairs = np.unique(doc * max(1, len(bench.ids)) + bench.item[row])
            pair_doc, pair_item = np.divmod(pairs, max(1, len(bench.ids)))
            return {
                **{k: v for k, v in block.columns.items() if k != "text"},
                "n_words": n_words,
                "runs": _lists(run_doc, block.n, a=pa.array(run_a), b=pa.array(run_b)),
                "items": _text.ragged_lists(ids.take(pa.array(pair_item)), np.bincount(pair_doc, minlength=block.n), None),
                "matches": _lists(doc, block.n, a=pa.array(begin), b=pa.array(end), item=names, at=pa.array(at)),
            }

        parts.append(_text.map_blocks(docs, columns, work, schema, shard_bytes))
    out = parts[0]
    if groups > 1:
        for p in parts[1:]:
            out = out.unionByName(p)
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
        out = out.groupBy("row").agg(F.first("key").alias("key"), F.first("kept").alias("kept"), F.max("n_words").alias("n_words"), flat("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), flat("matches"))
        out = out.withColumn("runs", _united("runs")).withColumn("matches", F.array_sort("matches"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["b"] - r["a"])
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["b"] - m["a"])), F.lit(0).cast("long"))
    return out.select(F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), longest.alias("longest"), "runs", F.array_sort("items").alias("items"), "matches", "kept")


def _united(runs: str):
    """Sorted runs without overlaps."""
    start = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return F.aggregate(
        F.array_sort(runs),
        start,
        lambda acc, r: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= r["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(acc, F.lit(-1))["b"], r["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(r))),
    )


def is_contaminated():
    """Over a twentieth of the words, and at least one, stand in benchmark windows."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = benchmark_matches(docs, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated")
    )


OP10_SQL = r"""
with d as (select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
bw as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') as k
    from (select item_id, w, unnest(range(0, greatest(len(w) - 12, 1))) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select rid, i, n, array_to_string(w[i + 1 : i + n], ' ') as k
    from (select rid, w, n, unnest(range(0, len(w) - n + 1)) as i from d, sizes where len(w) >= n)),
hits as (select rid, i, dw.n, item_id from dw join bw using (n, k)),
words as (select distinct rid, unnest(range(i, i + n)) as p from (select distinct rid, i, n from hits)),
nh as (select rid, count(*) as n_hit from words group by rid),
ni as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item_id::varchar as item from hits) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join nh using (rid) left join ni using (rid)
"""
