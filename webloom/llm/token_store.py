"""A content-addressed store of token ids.

Texts are encoded, a rolling hash over the ids cuts each document into chunks at places that depend on the
ids alone, and every distinct chunk is stored once under its digest. A document is a recipe: the digests of
its chunks in order. The files:

``blocks/``    Parquet; below ``kind=chunk`` a row per pack of chunks: ``digests`` (16 bytes each), ``sizes`` (ids of each chunk) and
               ``body``, the chunks' ids as little-endian integers of ``width`` bytes, Zstandard-compressed.
``recipes/``   Parquet in ascending order of the key (nulls first), a file per range of keys (a part): ``part``, ``pack`` (a run of
               ``PACK`` documents), ``local`` (ids before the document in its part), ``n``, ``digests``, ``sizes``, ``root``.
``manifest/``  Parquet, a row per pack: its part, documents, ids, ``local`` and ``root``.

A document's root is the digest of its chunks' digests, a pack's that of its documents' roots: a Merkle tree,
whose top is ``store_root``.

Scale: each task keeps a chunk it meets again only once and sends packs of chunks to buckets by digest, so a
chunk of a third of all documents costs a row a task. Ids are shuffled once and stored once. The checking
reader sends no ids at all: it checks every chunk against its digest once and reduces it to its CRC, and a
document's CRC is combined from its chunks'. Every pack asks once for each of its distinct chunks, so a
frequent chunk meets a row a pack, not a row a document. ``read_documents`` gives the ids themselves.

Defined results: null and empty texts are documents of no ids but the end; very long texts are documents like
others, encoded whole in one task; rows with equal keys are documents of their own, in an arbitrary but fixed
order; null keys come first; an empty table makes an empty store; no other column is read.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import _store, _text
from webloom.llm._parts import Parts

DIGEST = 16
#: Bytes of text encoded at once; a longer text is encoded alone.
_ENCODED = 4 << 20
#: Documents of a pack.
PACK = 4096
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@dataclass(frozen=True)
class Cuts:
    """Chunks have ``least`` to ``most`` ids and end where the rolling hash of the last four ids has its
    ``bits`` lowest bits 0."""

    bits: int = 8
    least: int = 64
    most: int = 1024

    def marks(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The places after which a chunk may end, in documents from ``bounds[i]`` to ``bounds[i + 1]``."""
        n = len(ids)
        h = np.zeros(n, np.uint64)
        wide = ids.astype(np.uint64) + np.uint64(1)
        begins = bounds[:-1][np.diff(bounds) > 0]
        for k, m in enumerate(_MULTIPLIERS):
            term = wide[: n - k] * m
            # What lies before a document's first id isn't part of its hashes.
            for j in range(k):
                at = begins - k + j
                term[at[(at >= 0) & (at < n - k)]] = 0
            h[k:] += term
        h ^= h >> np.uint64(29)
        h *= _MULTIPLIERS[0]
        return np.flatnonzero(h >> np.uint64(64 - self.bits) == 0) + 1

    def ends(self, marks: list[int], n: int) -> list[int]:
        """The ends of the chunks of a document of ``n`` ids."""
        out, at = [], 0
        for m in marks:
            while m - at > self.most:
                at += self.most
                out.append(at)
            if m - at >= self.least:
                at = m
                out.append(at)
        while n - at > self.most:
            at += self.most
            out.append(at)
        if at < n:
            out.append(n)
        return out


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


#: Kinds of bytes: letters of ASCII (and, by the bytes 0xC3 and what follows, of Latin-1), digits, white space, others.
_LETTER, _NUMBER, _SPACE, _SIGN = 0, 1, 2, 3
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = _LETTER
_KIND[48:58] = _NUMBER
_KIND[9:14] = _KIND[32] = _SPACE
#: Bytes of separators and of characters beyond ASCII.
_ODD = np.zeros(256, bool)
_ODD[0x1C:0x20] = _ODD[0x80:] = True
#: Parts encoded at once.
_JOINED = 256
_QUOTED = {b"s": 1, b"t": 1, b"re": 2, b"ve": 2, b"m": 1, b"ll": 2, b"d": 1}


def parts_of(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the byte-level rule's parts begin, in texts of ASCII and Latin-1 letters: runs of letters, of digits and
    of other characters, each with one space before it; white space up to the last character before another
    part; and an apostrophe with s, t, re, ve, m, ll or d."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    kind = _KIND[buf]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    edge = first.copy()
    edge[1:n] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(edge[:-1])
    ends = np.append(starts[1:], n)
    space = kind[starts] == _SPACE
    # White space that another part follows gives its last character away: to it if a space, else as a part alone.
    given = np.flatnonzero(space & ~first[ends])
    last = ends[given] - 1
    begins = np.zeros(n + 1, bool)
    begins[starts] = True
    begins[last] = True
    begins[ends[given][buf[last] == 32]] = False
    # An apostrophe alone that begins a part takes the letters of its list along.
    sign = np.flatnonzero((ends - starts == 1) & (buf[starts] == 39))
    for at in starts[sign][begins[starts[sign]] & ~first[ends[sign]]].tolist():
        text = buf[at + 1 : at + 3].tobytes()
        size = _QUOTED.get(text[:1]) or (_QUOTED.get(text) if not first[at + 2] else None)
        if size and kind[at + 1] == _LETTER:
            begins[at + 1] = False
            after = at + 1 + size
            # What follows the list's letters, if letters, begins a part of its own.
            if after < n and not first[after] and kind[after] == _LETTER:
                begins[after] = True
    return np.flatnonzero(begins[:n])


class Coder:
    """Ids of texts. Where the tokenizer's own rule cuts a text whatever surrounds the cut, a block's distinct
    parts are encoded once and their ids kept, ``MEMO`` parts at most, and texts are put together from them."""

    MEMO = 500_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        rule = made.get("pre_tokenizer") or {}
        added = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in made.get("added_tokens", ()))
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each token, which the byte-level alphabet writes as a character each.
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.parted = added and made.get("normalizer") is None and rule.get("type") == "ByteLevel" and rule.get("use_regex") and not rule.get("add_prefix_space")
        self.parts = Parts(self.MEMO)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _others(block: _text.Block) -> np.ndarray:
        """Whether each text has characters outside ASCII and Latin-1 letters, separators, or the beginning of an added token."""
        b, n = block.buf, len(block.buf)
        place = np.flatnonzero(_ODD[b])
        after = b[np.minimum(place + 1, n - 1)] if n else b
        letter = (b[place] == 0xC3) & (place + 1 < n) & (after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7)
        fine = letter.copy()
        fine[1:] |= letter[:-1]
        angle = np.flatnonzero(b == 60)
        angle = angle[angle + 1 < n]
        odd = np.sort(np.concatenate([place[~fine], angle[b[angle + 1] == 124]]))
        return np.diff(np.searchsorted(odd, block.offs)) > 0

    def _parts_ids(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of distinct parts. Those that begin with a space before another character stay parts when
        joined, so they are encoded in joined runs and told apart by their tokens' bytes."""
        joined = np.array([len(p) > 1 and p[0] == 32 and _KIND[p[1]] != _SPACE for p in parts], bool)
        counts = np.zeros(len(parts), np.int64)
        flat = []
        for which in (np.flatnonzero(joined), np.flatnonzero(~joined)):
            if not len(which):
                continue
            own = [parts[i] for i in which.tolist()]
            run = _JOINED if joined[which[0]] else 1
            ids = [x for c in self._whole([b"".join(own[i : i + run]).decode() for i in range(0, len(own), run)]) for x in c]
            ids = np.array(ids, np.uint32)
            ends = np.cumsum(self.sizes[ids])
            until = np.cumsum([len(p) for p in own])
            at = np.searchsorted(ends, until) + 1
            if (ends[at - 1] != until).any():
                raise ValueError("the tokenizer's tokens cross the parts of its own rule")
            counts[which] = np.diff(at, prepend=0)
            flat.append((which, ids))
        begins = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for which, ids in flat:
            out[_text.ragged(begins[which], counts[which])] = ids
        return out, counts

    def encode(self, block: _text.Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): document i's ids are those from ``bounds[i]`` to ``bounds[i + 1]``."""
        whole = self._others(block) if self.parted else np.ones(block.n, bool)
        text = lambda i: block.buf[block.offs[i] : block.offs[i + 1]].tobytes()
        sizes = np.diff(block.offs)
        if whole.any():
            coded = dict(zip(np.flatnonzero(whole).tolist(), self._whole([text(i).decode() for i in np.flatnonzero(whole)]), strict=True))
            buf = block.buf[np.repeat(~whole, sizes)]
            offs = np.concatenate([[0], np.cumsum(np.where(whole, 0, sizes))])
        else:
            coded, buf, offs = {}, block.buf, block.offs
        ids, n_ids = self.parts.encode(buf, parts_of(buf, offs), offs, self._parts_ids)
        if coded:
            pieces, at = [], np.concatenate([[0], np.cumsum(n_ids)]).tolist()
            for i in range(block.n):
                pieces.append(np.array(coded[i], np.uint32) if i in coded else ids[at[i] : at[i + 1]])
            n_ids = np.array([len(p) for p in pieces], np.int64)
            ids = np.concatenate(pieces)
        return ids, np.concatenate([[0], np.cumsum(n_ids)]).astype(np.int64)


_coders: dict[str, Coder] = {}


def _coder(path: str) -> Coder:
    """The worker's coder, which outlives a task."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids with ``end_id`` after them."""
    n = len(bounds) - 1
    out = np.empty(len(ids) + n, ids.dtype)
    own = np.ones(len(out), bool)
    bounds = bounds + np.arange(n + 1)
    own[bounds[1:] - 1] = False
    out[own] = ids
    out[~own] = end_id
    return out, bounds


_ROW = "kind string, bucket int, row long, key {kind}, n long, digests binary, sizes binary, body binary"


def write_store(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", *, tokenizer: str | None = None, end_id: int = 2, cuts: Cuts = Cuts(), n_buckets: int | None = None, flush_bytes: int = 16 << 20
) -> None:
    """Encode, cut and write. ``n_buckets``: packs of chunks are gathered in so many tasks, each of which
    must hold the distinct chunks of its share; by default twice the session's shuffle partitions."""
    spark = df.sparkSession
    tokenizer = tokenizer or _default()
    n_buckets = n_buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(df.dtypes)[key]
    fields = spark.createDataFrame([], _ROW.format(kind=kind)).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def encode(batches):
        coder = _coder(tokenizer)
        width = coder.width
        seen: set[bytes] = set()
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        size = 0
        pack = zstandard.ZstdCompressor(level=3)

        def packs():
            rows = []
            for b, chunks in held.items():
                rows.append(("chunk", b, None, None, None, b"".join(d for d, _ in chunks), np.array([len(c) // width for _, c in chunks], "<u4").tobytes(), pack.compress(b"".join(c for _, c in chunks))))
            held.clear()
            return rows

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            for block in _text.blocks(batch, "text", _ENCODED):
                ids, bounds = with_end(*coder.encode(block), end_id)
                marks = cuts.marks(ids, bounds)
                per = np.searchsorted(marks, bounds, "right").tolist()
                # A mark at a document's end belongs to it, one at its beginning to the one before.
                marks = marks.tolist()
                data = ids.astype(f"<u{width}").tobytes()
                rows = []
                for i, (row, k, x, y) in enumerate(zip(block.columns["row"].to_pylist(), block.columns["key"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    ends = cuts.ends([m - x for m in marks[per[i] : per[i + 1]]], y - x)
                    names, at = [], x
                    for end in ends:
                        chunk = data[at * width : (x + end) * width]
                        at = x + end
                        names.append(d := _digest(chunk))
                        if d not in seen:
                            seen.add(d)
                            held.setdefault(int.from_bytes(d[:4], "little") % n_buckets, []).append((d, chunk))
                            size += len(chunk)
                    rows.append(("recipe", row % n_buckets, row, k, y - x, b"".join(names), np.diff([0, *ends]).astype("<u4").tobytes(), None))
                yield table(rows)
                if size > flush_bytes:
                    yield table(packs())
                    size = 0
        if held:
            yield table(packs())

    def once(batches):
        """Each chunk of a bucket once; recipes as they are."""
        seen: set[bytes] = set()
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for batch in batches:
            rows = batch.to_pylist()
            out = [r for r in rows if r["kind"] == "recipe"]
            for r in rows:
                if r["kind"] == "recipe":
                    continue
                digests = r["digests"]
                names = [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]
                new = [i for i, d in enumerate(names) if d not in seen]
                seen.update(names)
                if len(new) == len(names):
                    out.append(r)
                elif new:
                    sizes = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
                    body = unpack.decompress(r["body"])
                    width = len(body) // int(sizes.sum())
                    ends = (np.cumsum(sizes) * width).tolist()
                    kept = b"".join([body[ends[i] - width * int(sizes[i]) : ends[i]] for i in new])
                    out.append(r | {"digests": b"".join([names[i] for i in new]), "sizes": sizes[new].astype("<u4").tobytes(), "body": pack.compress(kept)})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    picked = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    sent = picked.mapInArrow(encode, fields).repartition(n_buckets, "bucket").mapInArrow(once, fields)
    staged = f"{path}/blocks"
    sent.write.mode("overwrite").partitionBy("kind").parquet(staged)
    stored = spark.read.schema(fields).parquet(staged)
    ordered = stored.where("kind = 'recipe'").select("key", "row", "n", "digests", "sizes")
    n_parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 20))
    ordered = ordered.repartitionByRange(n_parts, F.col("key").asc_nulls_first(), F.col("row")).sortWithinPartitions(F.col("key").asc_nulls_first(), "row")
    out = spark.createDataFrame([], f"part int, pack long, row long, key {kind}, local long, n long, digests binary, sizes binary, root binary").schema
    out_arrow = to_arrow_schema(out)

    def laid(batches):
        part, place, before = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = np.array(b.column(2).to_pylist(), np.int64)
            roots = [_digest(d) for d in b.column(3).to_pylist()]
            local = before + np.cumsum(n) - n
            m = len(n)
            packs = (place + np.arange(m)) // PACK
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, part, np.int32)), pa.array(packs), b.column(1), b.column(0), pa.array(local), b.column(2), b.column(3), b.column(4), pa.array(roots, pa.binary())], schema=out_arrow
            )
            place, before = place + m, before + int(n.sum())

    ordered.mapInArrow(laid, out).write.mode("overwrite").parquet(f"{path}/recipes")
    recipes = spark.read.schema(out).parquet(f"{path}/recipes")
    _manifest(recipes).write.mode("overwrite").parquet(f"{path}/manifest")


def _manifest(recipes: DataFrame) -> DataFrame:
    """A row per pack; a pack's documents are in the order of the ids before them and, as each has an end, no two have the same."""
    roots = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("local", F.hex("root").alias("root")))), lambda x: x["root"]), "")
    return recipes.groupBy("part", "pack").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_ids"), F.min("local").alias("local"), F.sha2(roots, 256).alias("root"))


class Combine:
    """The CRC-32 of joined byte strings from theirs: appending n bytes is a linear map of the 32 bits. The maps,
    one for each size of a chunk, are kept for the worker's next packs."""

    tables: dict[int, list[list[int]]] = {}

    def _table(self, n: int) -> list[list[int]]:
        if n not in self.tables:
            # zlib continues from any state; over zero bytes the state's change is linear.
            columns = [zlib.crc32(bytes(n), 1 << bit) ^ zlib.crc32(bytes(n)) for bit in range(32)]
            table = []
            for byte in range(4):
                row = [0] * 256
                for v in range(1, 256):
                    low = v & -v
                    row[v] = row[v ^ low] ^ columns[8 * byte + low.bit_length() - 1]
                table.append(row)
            self.tables[n] = table
        return self.tables[n]

    def __call__(self, left: int, right: int, n: int) -> int:
        """``right`` is the CRC of the ``n`` bytes appended."""
        a, b, c, d = self._table(n)
        return a[left & 255] ^ b[left >> 8 & 255] ^ c[left >> 16 & 255] ^ d[left >> 24] ^ right


class CorruptStore(ValueError):
    pass


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digests binary, sizes binary, body binary, kind string").parquet(f"{path}/blocks").where("kind = 'chunk'")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes with ``start``; what is gathered for it is a row for each part."""
    recipes = spark.read.parquet(f"{path}/recipes")
    starts, at = [], 0
    for r in spark.read.parquet(f"{path}/manifest").groupBy("part").agg(F.sum("n_ids").alias("n_ids")).orderBy("part").collect():
        starts.append((r["part"], at))
        at += r["n_ids"]
    before = spark.createDataFrame(starts, "part int, before long")
    return recipes.join(F.broadcast(before), "part", "left").withColumn("start", F.col("before") + F.col("local")).drop("before")


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Packs whose recipes don't agree with the manifest or stand on one side only; none in a sound store."""
    now, then = _manifest(spark.read.parquet(f"{path}/recipes")), spark.read.parquet(f"{path}/manifest")
    columns = ["part", "pack", "n_docs", "n_ids", "local", "root"]
    return now.join(then, columns, "left_anti").select(columns).unionByName(then.join(now, columns, "left_anti").select(columns))


def store_root(spark: SparkSession, path: str) -> str:
    """The root of the tree: of the parts' roots, which are those of their packs'."""
    joined = lambda order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "root"))), lambda x: x["root"]), ""), 256).alias("root")
    parts = spark.read.parquet(f"{path}/manifest").groupBy("part").agg(joined("pack"))
    return parts.agg(joined("part")).first()[0]


def _unpacked(r: dict):
    """(digest, how many ids, their bytes as little-endian 32-bit integers) of each chunk of a row, checked."""
    sizes = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
    body = zstandard.ZstdDecompressor().decompress(r["body"])
    width = len(body) // int(sizes.sum())
    wide = memoryview(np.frombuffer(body, f"<u{width}").astype("<u4").tobytes())
    at, digests = 0, r["digests"]
    for i, s in enumerate(sizes.tolist()):
        name = digests[i * DIGEST : (i + 1) * DIGEST]
        if _digest(body[at * width : (at + s) * width]) != name:
            raise CorruptStore(f"chunk {name.hex()} doesn't have its digest")
        yield name, s, wide[4 * at : 4 * (at + s)]
        at += s


def _agrees(n: np.ndarray, local: np.ndarray, roots: list[bytes], told: dict | None) -> bool:
    """Whether a pack's documents, in order, are those of its row in the manifest."""
    if told is None or (told["n_docs"], told["n_ids"], told["local"]) != (len(n), int(n.sum()), int(local[0]) if len(n) else None):
        return False
    follows = (local[1:] == local[:-1] + n[:-1]).all()
    return bool(follows) and hashlib.sha256("".join(r.hex().upper() for r in roots).encode()).hexdigest() == told["root"]


def document_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files; fails if a chunk, a recipe, a root or
    the manifest isn't what it should be. The CRC is over all ids as little-endian 32-bit integers."""

    def sums(batches):
        for b in batches:
            rows = [(d, s, zlib.crc32(ids)) for r in b.to_pylist() for d, s, ids in _unpacked(r)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["digest", "size", "crc"])

    crcs = _chunks(spark, path).select("digests", "sizes", "body").mapInArrow(sums, "digest binary, size int, crc long")
    recipes = _recipes(spark, path)
    kind = dict(recipes.dtypes)["key"]

    def asked(batches):
        """Each chunk once for every pack in a batch."""
        for b in batches:
            got: dict[tuple[int, int], set[bytes]] = {}
            for part, pack, digests in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                got.setdefault((part, pack), set()).update(digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST))
            rows = [(*k, d) for k, ds in got.items() for d in ds]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["part", "pack", "digest"])

    told = recipes.select("part", "pack", "digests").mapInArrow(asked, "part int, pack long, digest binary").join(crcs, "digest")
    told = told.groupBy("part", "pack").agg(F.collect_set(F.struct("digest", "size", "crc")).alias("chunks"))
    manifest = spark.read.parquet(f"{path}/manifest").select("part", "pack", F.struct("n_docs", "n_ids", "local", "root").alias("told"))
    #: A pack is in either table or in both; the one without the other is damage.
    told = manifest.join(told, ["part", "pack"], "full")
    docs = recipes.select("part", "pack", "key", "start", "local", "n", "root", "digests")

    def combined(docs: pa.Table, told: pa.Table) -> pa.Table:
        rows = sorted(docs.to_pylist(), key=lambda r: r["local"])
        claims = told.to_pylist()
        claim = claims[0] if len(claims) == 1 else {"told": None, "chunks": None}
        crc_of = {c["digest"]: (c["size"], c["crc"]) for c in claim["chunks"] or ()}
        join, crcs, roots = Combine(), [], []
        for r in rows:
            digests = r["digests"]
            parts = [crc_of.get(digests[i : i + DIGEST]) for i in range(0, len(digests), DIGEST)]
            if None in parts or sum(s for s, _ in parts) != r["n"] or _digest(digests) != r["root"]:
                raise CorruptStore("a recipe's chunks are missing or aren't those of its root")
            crc = 0
            for s, c in parts:
                crc = join(crc, c, 4 * s)
            crcs.append(crc)
            roots.append(r["root"])
        if not _agrees(np.array([r["n"] for r in rows], np.int64), np.array([r["local"] for r in rows], np.int64), roots, claim["told"]):
            raise CorruptStore("a pack's recipes aren't those of the manifest")
        keys = pa.array([r["key"] for r in rows], docs.schema.field("key").type)
        return pa.table({"key": keys, "start": pa.array([r["start"] for r in rows], pa.int64()), "n_tokens": pa.array([r["n"] for r in rows], pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    out = docs.groupBy("part", "pack").cogroup(told.groupBy("part", "pack"))
    return out.applyInArrow(combined, f"key {kind}, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, ids array<int>): the documents themselves, each chunk checked against its digest."""

    def bodies(batches):
        for b in batches:
            rows = [(d, np.frombuffer(ids, "<i4")) for r in b.to_pylist() for d, _, ids in _unpacked(r)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["digest", "ids"])

    chunks = _chunks(spark, path).select("digests", "sizes", "body").mapInArrow(bodies, "digest binary, ids array<int>")
    recipes = _recipes(spark, path)
    count = (F.length("digests") / DIGEST).cast("int")
    used = recipes.select("row", F.explode(F.sequence(F.lit(0), count - 1)).alias("at"), "digests").select("row", "at", F.substring("digests", F.col("at") * DIGEST + 1, F.lit(DIGEST)).alias("digest"))
    used = used.join(chunks, "digest").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("c"))
    return recipes.join(used, "row").select("key", "start", F.flatten(F.col("c.ids")).alias("ids"))


def _default() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _store.work_dir(spark)
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return _store.settled(document_checksums(spark, path), path).withColumnRenamed("key", "doc_id")
