"""Near-duplicates by SetSketch registers, bands of them, joint estimates by likelihood, and exact checks.

1. Each text becomes the set of its word shingles' 64-bit hashes, sums over BLAKE2b hashes of the words. The sketch keeps, for each of ``m`` random
   orders of all shingles, the smallest value in the set on an exponential scale, truncated to 16 bits:
   registers of a union are the larger of both (``merged``), and registers agree about as often as sets do.
2. Texts with the same set are one class from here on.
3. ``rows`` registers make a band. Classes that share a band meet at that band's smallest class, their
   centre. Two classes that share any band share its centre, so the members of each centre are all that
   must be compared; a class has few centres however large the group of copies is.
4. The members of a centre are dealt to blocks of bounded number and bytes of text, and every block meets the centre, which
   stands for the group. There the similarity is estimated from both classes' registers by likelihood, with their
   set sizes known; pairs far below the threshold are left. For the others the full sets are intersected, all at
   once, as products of 0/1 matrices. Only a spanning forest of the links found is returned, never the pairs.
   Members that their block links to the centre are done with one another; only those it doesn't link meet the
   members of all other blocks, in chunks of a block's size.
5. Components of these links (``components``).

Joins are sort-merge joins at every size, so plans and what they move don't change as tables grow.

A pair at the threshold is missed if it shares no band (0.8: 3e-6 with 24 bands of 4) or if its estimate is
off by more than ``margin`` (6 standard deviations with the default). A group of n members in k blocks compares
n * block_rows / 2 estimates when its members are linked to the centre; where none is, every two of its blocks meet.

Defined results: a very long text is compared whole, in a block with few others; a text with fewer words than a shingle is one shingle; null, empty and wordless texts have
no shingles and are alone; equal texts are linked; a component's id is its smallest key, nulls last; rows
with equal keys are rows of their own; an empty table gives none; columns named in ``keep`` come back, others
aren't read, and names of either never clash because they travel inside one struct.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import _store, _text
from webloom.llm.components import connected

_U64 = np.uint64
_SHINGLE = np.random.Generator(np.random.PCG64(17)).integers(0, 1 << 63, 64, dtype=_U64) * _U64(2) + _U64(1)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int, table: np.ndarray = _text.NONSPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each document's distinct shingles of k words, ASCII letters in lower case."""
    low = _text.LOWER[buf]
    starts, ends, bounds = _text.word_spans(low, offs, table)
    words = _text.word_hashes(low, starts, ends)
    n = np.diff(bounds)
    full = np.maximum(n - k + 1, 0)
    first = _text.ragged(bounds[:-1], full)
    h = np.zeros(len(first), _U64)
    for j in range(k):
        h += words[first + j] * _SHINGLE[j]
    doc = np.repeat(np.arange(len(n)), full)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        parts = bounds[short].repeat(n[short]) + (inner := _text.ragged(np.zeros(len(short), np.int64), n[short]))
        whole = np.add.reduceat(words[parts] * _SHINGLE[k + inner], np.cumsum(n[short]) - n[short]) * _SHINGLE[n[short]]
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    h = _text.mix(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


class SetSketch:
    """``m`` registers of base ``base`` with ``levels`` steps. Register i of a set is
    floor(1 - log_base(x)), x being the smallest of its elements' exponential values in order i."""

    def __init__(self, m: int = 96, base: float = 1.001, rate: float = 20.0, levels: int = 65534):
        rng = np.random.Generator(np.random.PCG64(91))
        self.m, self.base, self.rate, self.levels = m, base, rate, levels
        self.a = rng.integers(0, 1 << 31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, m, dtype=np.uint32)

    def registers(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        least = np.zeros((len(bounds) - 1, self.m), np.uint32)
        folded = (h >> _U64(32)).astype(np.uint32)
        a, b = self.a[:, None], self.b[:, None]
        for i, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if y > x:
                low = np.full(self.m, 0xFFFFFFFF, np.uint32)
                for z in range(x, y, 4096):
                    v = folded[None, z : min(y, z + 4096)] * a + b
                    v ^= v >> np.uint32(15)
                    v *= np.uint32(0x85EBCA6B)
                    np.minimum(low, v.min(axis=1), out=low)
                least[i] = low
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / self.rate
        k = np.clip(np.floor(1 - np.log(x) / math.log(self.base)) + self.levels // 2, 0, self.levels + 1).astype(np.uint16)
        k[np.diff(bounds) == 0] = 0
        return k

    @staticmethod
    def merged(*registers: np.ndarray) -> np.ndarray:
        """The registers of the sets' union."""
        return np.maximum.reduce(registers)

    def at_least(self, j: float, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
        """Whether the likeliest Jaccard similarity of each left with each right set is ``j`` or more. The
        likelihood of the counts of larger, smaller and equal registers is concave, so its slope at j tells."""
        greater = np.zeros((len(left), len(right)), np.int32)
        less = np.zeros_like(greater)
        for i in range(self.m):
            greater += left[:, i, None] > right[None, :, i]
            less += left[:, i, None] < right[None, :, i]
        u = n_left[:, None] / (n_left[:, None] + n_right[None, :])
        v = 1 - u
        c = (self.base - 1) / self.base
        ln_b = math.log(self.base)
        p = lambda x: -np.log1p(-x * c) / ln_b
        slope = lambda x: c / (1 - x * c) / ln_b
        x, y = u - v * j, v - u * j
        possible = (x >= 0) & (y >= 0)
        x, y = np.maximum(x, 1e-12), np.maximum(y, 1e-12)
        equal = self.m - greater - less
        d = -greater * slope(x) * v / p(x) - less * slope(y) * u / p(y) + equal * (slope(x) * v + slope(y) * u) / np.maximum(1 - p(x) - p(y), 1e-12)
        return possible & (d >= 0)


def linked(hashes: list[np.ndarray], percent: int, tried: np.ndarray | None = None, columns: int = 2048) -> np.ndarray:
    """A matrix of which sets have 100 * intersection >= percent * union."""
    n = len(hashes)
    sizes = np.array([len(h) for h in hashes], np.int64)
    values, column, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    row = np.repeat(np.arange(n), sizes)
    row, column = row[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)
    block = np.zeros((n, columns), np.float32)
    for a in range(0, int(shared.sum()), columns):
        x, y = np.searchsorted(column, (a, a + columns))
        block[:] = 0
        block[row[x:y], column[x:y] - a] = 1
        common += block @ block.T
    out = np.empty((n, n), bool)
    for a in range(0, n, 256):
        part = common[a : a + 256].astype(np.int64)
        out[a : a + 256] = 100 * part >= percent * (sizes[a : a + 256, None] + sizes[None, :] - part)
    np.fill_diagonal(out, False)
    return out if tried is None else out & tried


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) for every node that isn't the first of its component."""
    seen = np.zeros(len(links), bool)
    out = []
    for root in range(len(links)):
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(links[front].any(axis=0) & ~seen)
            seen[front] = True
            out += [(int(x), root) for x in front]
    return out


class Staged:
    """Texts and sketches in a table: (row, key, kept, missing, n, d1, d2, size, z, registers, bands)."""

    def __init__(self, df: DataFrame, key: str, text: str, keep: tuple[str, ...], k: int, sketch: SetSketch, rows: int):
        spark = df.sparkSession
        self.path = _store.work_dir(spark)
        picked = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), _text.kept(keep))
        picked = picked.select(F.monotonically_increasing_id().alias("row"), "key", "kept", F.col("text").isNull().alias("missing"), "text")
        kinds = dict(picked.dtypes)
        bands = sketch.m // rows
        weights = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, (bands, rows), dtype=_U64) * _U64(2) + _U64(1)

        def work(block: _text.Block) -> dict:
            h, bounds = shingle_sets(block.buf, block.offs, k)
            registers = sketch.registers(h, bounds)
            grouped = registers[:, : bands * rows].reshape(-1, bands, rows).astype(_U64)
            keys = _text.mix((grouped * weights).sum(axis=2, dtype=_U64) + np.arange(bands, dtype=_U64) * _U64(0x9E3779B97F4A7C15)).astype(np.int64)
            n = np.diff(bounds)
            d = np.zeros((2, block.n), _U64)
            some = n > 0
            if some.any():
                d[0, some] = np.add.reduceat(h, bounds[:-1][some])
                d[1, some] = np.add.reduceat(_text.mix(h ^ _U64(0x5851F42D4C957F2D)), bounds[:-1][some])
            return {
                **{c: block.columns[c] for c in ("row", "key", "kept", "missing")},
                "n": n,
                "d1": d[0].astype(np.int64),
                "d2": d[1].astype(np.int64),
                "size": np.diff(block.offs),
                "z": _store.packed(block),
                "registers": pa.array([r.tobytes() for r in registers], pa.binary()),
                "bands": _text.ragged_lists(keys[some].ravel(), np.where(some, bands, 0), pa.int64()),
            }

        schema = f"row long, key {kinds['key']}, kept {kinds['kept']}, missing boolean, n long, d1 long, d2 long, size long, z binary, registers binary, bands array<long>"
        out = _text.map_blocks(picked, {c: c for c in picked.columns}, work, schema)
        self.table = _store.written(out, f"{self.path}/texts")


def _apart(rows: list[int], edges: list[tuple[int, int]], centre: int) -> list[int]:
    """The rows that a forest's edges (node, root) don't link to the centre."""
    root = {r: r for r in rows} | dict(edges)
    return [r for r in rows if root[r] != root[centre]]


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", *, keep: tuple[str, ...] = (), k: int = 5, percent: int = 80, m: int = 96, rows: int = 4, margin: float = 0.25, block_rows: int = 1024, block_bytes: int = 16 << 20, keep_texts: bool = False
) -> DataFrame:
    """(row, key, kept, n, component, first, and texts packed as ``z`` if ``keep_texts``): per row the size of its set, its
    component's smallest key, and whether it is the row that represents the component."""
    spark = df.sparkSession
    sketch = SetSketch(m)
    staged = Staged(df, key, text, keep, k, sketch, rows)
    table, path = staged.table, staged.path
    # A class's best row has the smallest key, nulls last, and of equal keys is the first.
    rank = F.struct(F.col("key").isNull().alias("no"), "key", "row")
    classes = table.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("row").alias("class"), F.min(rank).alias("best"))
    classes = _store.written(classes, f"{path}/classes")
    sole = table.select("row", "bands", "size").join(classes.select(F.col("class").alias("row")).hint("merge"), "row").select("row", F.explode("bands").alias("band"), "size")
    sole = _store.written(sole, f"{path}/bands")
    centres = sole.groupBy("band").agg(F.min("row").alias("centre"), F.count("*").alias("c")).where("c > 1").drop("c")
    centres = _store.written(centres, f"{path}/centres")
    members = _store.written(sole.join(centres.hint("merge"), "band").select("centre", "row", "size").distinct(), f"{path}/members")
    share = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("size") / block_bytes)).cast("int")
    sizes = _store.written(members.groupBy("centre").agg(share.alias("k")), f"{path}/sizes")
    members = _store.written(members.join(sizes.hint("merge"), "centre").withColumn("block", F.pmod(F.xxhash64("row"), F.col("k")).cast("int")).drop("size"), f"{path}/dealt")
    bodies = table.select("row", "n", "registers", "z").hint("merge")
    # First every block with the centre, which stands for the group; a block of its own if the group has one only.
    every = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block")
    centre_of = members.where("row = centre and k > 1").select("centre", "row", "k", F.col("block").alias("own"), every).where("block <> own").drop("own")
    met = members.select("centre", "row", "k", "block").unionByName(centre_of).withColumn("other", F.lit(-1)).join(bodies, "row")
    low = percent / 100 - margin

    def compare(block: pa.Table) -> pa.Table:
        row = block.column("row").to_numpy()
        order = np.argsort(row)
        row = row[order]
        n = block.column("n").to_numpy()[order]
        registers = np.frombuffer(b"".join(block.column("registers").to_pylist()), np.uint16).reshape(len(row), -1)[order]
        tried = np.concatenate([sketch.at_least(low, registers[a : a + 256], registers, n[a : a + 256], n) for a in range(0, len(row), 256)])
        np.fill_diagonal(tried, False)
        some = np.flatnonzero(tried.any(axis=0))
        edges = []
        if len(some):
            z = block.column("z")
            buf, offs = _store.unpacked([z[int(order[i])].as_py() for i in some])
            h, bounds = shingle_sets(buf, offs, k)
            sets = [h[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            edges = [(int(row[some[a]]), int(row[some[b]])) for a, b in forest(linked(sets, percent, tried[np.ix_(some, some)]))]
        centre, many = block.column("centre")[0].as_py(), block.column("k")[0].as_py() > 1
        # In the first round of a group of several blocks: rows that the block doesn't link to the centre.
        left = _apart(row.tolist(), edges, centre) if many and block.column("other")[0].as_py() < 0 else []
        own = block.column("block")[0].as_py()
        return pa.table(
            {
                "a": pa.array([e[0] for e in edges] + [None] * len(left), pa.int64()),
                "b": pa.array([e[1] for e in edges] + left, pa.int64()),
                "centre": pa.array([centre] * (len(edges) + len(left)), pa.int64()),
                "block": pa.array([own] * (len(edges) + len(left)), pa.int32()),
            }
        )

    schema = "a long, b long, centre long, block int"
    first = _store.written(met.groupBy("centre", "block", "other").applyInArrow(compare, schema), f"{path}/first")
    # Then those that stay apart with all members of the other blocks, in chunks as large as a block.
    apart = first.where("a is null").select("centre", F.col("b").alias("row"), F.col("block").alias("own"))
    chunks = _store.written(apart.groupBy("centre").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("m")), f"{path}/chunks")
    apart = _store.written(apart.join(chunks.hint("merge"), "centre").withColumn("other", F.pmod(F.xxhash64("row", F.lit(1)), F.col("m")).cast("int")), f"{path}/apart")
    blocks_of = sizes.where("k > 1")
    theirs = apart.join(blocks_of.hint("merge"), "centre").select("centre", "row", "k", "own", "other", every).where("block <> own").drop("own")
    asked = members.join(chunks.hint("merge"), "centre").select("centre", "row", "k", "block", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    met = asked.unionByName(theirs.select(asked.columns)).join(bodies, "row")
    second = met.groupBy("centre", "block", "other").applyInArrow(compare, schema)
    edges = first.where("a is not null").select("a", "b").unionByName(second.select("a", "b"))
    roots = connected(edges, f"{path}/components")
    of_class = classes.join(roots.select(F.col("node").alias("class"), "root").hint("merge"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    of_class = _store.written(of_class, f"{path}/roots")
    # Both tables are written before the joins, so that a frequent class or root is split by them, not met by an aggregate.
    best = _store.written(of_class.groupBy("root").agg(F.min("best").alias("best")), f"{path}/best")
    of_class = _store.written(of_class.drop("best").join(best.hint("merge"), "root").select("d1", "d2", "n", "best"), f"{path}/of_class")
    found = table.select("row", "key", "n", "d1", "d2").join(of_class.hint("merge"), ["d1", "d2", "n"], "left")
    found = found.select("row", F.when(F.col("best").isNull(), F.col("key")).otherwise(F.col("best.key")).alias("component"), F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("first"))
    table = table.drop("bands", "registers", "d1", "d2", "size", *([] if keep_texts else ["z", "missing"]))
    return _store.settled(found.join(table.hint("merge"), "row"), path)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)
    return found.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))


OP4_SQL = r"""
with recursive d as (select doc_id, row_number() over () as rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct rid, array_to_string(w[i + 1 : i + 4], ' ') as h from (select rid, w, unnest(range(0, greatest(len(w) - 3, 1))) as i from d where len(w) > 0)),
n as (select rid, count(*) as n from s group by rid),
p as (select a.rid as x, b.rid as y, count(*) as c from s a join s b on a.h = b.h and a.rid <> b.rid group by all),
l as (select x, y from p join n nx on nx.rid = x join n ny on ny.rid = y where 100 * c >= 80 * (nx.n + ny.n - c)),
r as (select rid as x, rid as y from d union select r.x, l.y from r join l on l.x = r.y),
c as (select r.x as rid, min(d.doc_id) as component_id from r join d on d.rid = r.y group by r.x)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from d join c using (rid) left join n using (rid)
"""
