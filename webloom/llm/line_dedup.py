"""Line deduplication by repeated passages or by content-defined chunks of lines.

Lines are hashed one by one (BLAKE2b, 64 bits), and rolling hashes run over the lines' hashes.

Passages (``passages=True``, as the queries have it), a boundary after every line: every window of ``min_lines`` lines with words, with the
blank lines between them, and every single line of more than ``long_words`` words. Of those that occur more than
once anywhere, the first place (by key, nulls last, then row and place) stays; the lines of the others are removed
once their bytes have been compared with the first's. Windows overlap, so a repeated run of lines goes from its
first line to its last, wherever it begins; each line that goes still stands at an earlier place. A shorter
line repeated alone stays, and so do blank lines at the edges of a passage.

Chunks (the default): a line's hash chooses whether a chunk ends with it, so boundaries shift with the text and a
passage repeated elsewhere is cut alike from some line on. The same holds for every chunk of ``min_lines`` or more lines
with words; what of a passage lies in other chunks stays.

Joins are sort-merge joins at every size, so plans and what they move don't change as tables grow.
Work moves hashes, not texts: chunks and windows are counted by hash with partial sums, only rows with a repeated
one are looked up again, and only repeated ones' bytes are sent to be compared.

Defined results: a very long text is cut into lines whole, in one task; of equal passages the first stays by key, row and
place, so there are no ties; null stays null with no lines; a text in which nothing repeats comes back as it was; a
text may become empty; repeated rows keep the lines of the first of them; ``n_removed_chunks`` counts the chunks
removed or, with passages, the runs of lines removed; an empty table gives none; other
columns come back only if named in ``keep``, inside one struct, so their names never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import _store, _text

_U64 = np.uint64


def _lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, docs, feed): lines as byte ranges, their documents, and whether a line feed ends them."""
    n = len(buf)
    last = np.zeros(n, bool)
    last[buf == 10] = True
    # A line ends after its line feed or with its document; a document without a byte has no line.
    last[offs[1:][np.diff(offs) > 0] - 1] = True
    ends = np.flatnonzero(last) + 1
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    docs = np.searchsorted(offs, begins, "right") - 1
    return begins, ends, docs, buf[ends - 1] == 10 if len(ends) else np.zeros(0, bool)


def line_chunks(buf: np.ndarray, offs: np.ndarray, every: int = 3, min_lines: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, docs, worded, hashes): chunks as byte ranges, with the line end after their
    last line, their documents, and their lines with words. A line ends a chunk if its own hash says so, about every
    ``every``-th does, and the chunk has ``min_lines`` lines with words by then."""
    begins, ends, docs, feed = _lines(buf, offs)
    n = len(docs)
    h = _text.word_hashes(buf, begins, ends - feed)
    words = np.concatenate([[0], np.cumsum(_text.NONSPACE[buf])])
    worded = np.concatenate([[0], np.cumsum(words[ends] > words[begins])])
    final = np.ones(n, bool)
    final[:-1] = docs[1:] != docs[:-1]
    stop, since, so_far = [], 0, worded.tolist()
    for line in np.flatnonzero((_text.mix(h) % _U64(every) == 0) | final).tolist():
        if final[line] or so_far[line + 1] - so_far[since] >= min_lines:
            stop.append(line)
            since = line + 1
    stop = np.array(stop, np.int64)
    start = np.concatenate([[0], stop[:-1] + 1]).astype(np.int64) if len(stop) else stop
    hashes = _text.Rolling(h)(start, stop + 1) if len(stop) else h
    return begins[start], ends[stop], docs[start], worded[stop + 1] - worded[start], hashes


def line_windows(buf: np.ndarray, offs: np.ndarray, min_lines: int = 2, long_words: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, docs, at, hashes) of the windows of ``min_lines`` lines with words and of the lines of more
    than ``long_words`` words, in order. ``at`` is twice the first line's number in its document, plus one for
    a single line."""
    begins, ends, docs, feed = _lines(buf, offs)
    inside = _text.NONSPACE[buf]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    # A document may begin right after another's last word.
    first = offs[:-1][offs[:-1] < len(buf)]
    starts[first] = inside[first]
    words = np.concatenate([[0], np.cumsum(starts)])
    words = words[ends] - words[begins]
    worded = np.flatnonzero(words)
    head, tail = worded[: max(0, len(worded) - min_lines + 1)], worded[min_lines - 1 :]
    one = docs[head] == docs[tail]
    long = np.flatnonzero(words > long_words)
    head, tail = np.concatenate([head[one], long]), np.concatenate([tail[one], long])
    kind = np.repeat([0, 1], [int(one.sum()), len(long)])
    order = np.argsort(2 * head + kind)
    head, tail, kind = head[order], tail[order], kind[order]
    at = 2 * (head - np.searchsorted(docs, docs[head])) + kind
    # Over the lines' hashes without their feeds: at a document's end there is none.
    hashes = _text.Rolling(_text.word_hashes(buf, begins, ends - feed))(head, tail + 1)
    return begins[head], ends[tail], docs[head], at, hashes


def _body(data: bytes, begin: int, end: int) -> bytes:
    return data[begin : end - 1] if data[end - 1 : end] == b"\n" else data[begin:end]


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", *, keep: tuple[str, ...] = (), every: int = 3, min_lines: int = 2, passages: bool = False, long_words: int = 50) -> DataFrame:
    """(row, key, kept, text, n_lines, n_removed_chunks, n_removed_bytes): every row with what is left of its text."""

    def units(block: _text.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begins, ends, bounds, at, hashes) of what is looked for; document i's are those from ``bounds[i]`` to ``bounds[i + 1]``."""
        if passages:
            begins, ends, docs, at, hashes = line_windows(block.buf, block.offs, min_lines, long_words)
        else:
            begins, ends, docs, worded, hashes = line_chunks(block.buf, block.offs, every, min_lines)
            at = np.arange(len(docs)) - np.searchsorted(docs, docs)
            begins, ends, docs, at, hashes = (x[worded >= min_lines] for x in (begins, ends, docs, at, hashes))
        return begins, ends, np.searchsorted(docs, np.arange(block.n + 1)), at, hashes

    path = _store.work_dir(df.sparkSession)
    picked = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), _text.kept(keep), F.col(f"`{text}`").alias("text")
    )
    kinds = dict(picked.dtypes)

    def pack(block: _text.Block) -> dict:
        _, _, bounds, at, hashes = units(block)
        chunks = pa.StructArray.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(at.astype(np.int32))], ["h", "at"])
        return {"row": block.columns["row"], "key": block.columns["key"], "kept": block.columns["kept"], "missing": ~block.valid, "z": _store.packed(block), "chunks": _text.ragged_lists(chunks, np.diff(bounds), None)}

    schema = f"row long, key {kinds['key']}, kept {kinds['kept']}, missing boolean, z binary, chunks array<struct<h:long,at:int>>"
    table = _store.written(_text.map_blocks(picked, {c: c for c in picked.columns}, pack, schema), f"{path}/texts")
    places = table.select("row", F.struct(F.col("key").isNull().alias("no"), "key", "row").alias("rank"), F.explode("chunks").alias("c")).select("row", "rank", "c.h", "c.at")
    firsts = places.groupBy("h").agg(F.min(F.struct("rank", "at")).alias("f"), F.count("*").alias("c")).where("c > 1").select("h", F.col("f.rank.row").alias("f_row"), F.col("f.at").alias("f_at"))
    # Written before the join, so that a frequent passage is split by it, not met by the aggregate's tasks.
    firsts = _store.written(firsts, f"{path}/firsts")
    repeats = places.select("h", "row", "at").join(firsts.hint("merge"), "h").select("h", "row", "at", ((F.col("row") == F.col("f_row")) & (F.col("at") == F.col("f_at"))).alias("is_first"))
    repeats = _store.written(repeats, f"{path}/repeats")
    wanted = repeats.groupBy("row").agg(F.collect_list(F.struct("at", "h", "is_first")).alias("wanted"))

    def cut(batches):
        for b in batches:
            for block in _text.blocks(_unpack(b), "text"):
                begins, ends, bounds, at, _ = units(block)
                data = block.buf.tobytes()
                out = []
                for d, (row, chunks) in enumerate(zip(block.columns["row"].to_pylist(), block.columns["wanted"].to_pylist(), strict=True)):
                    for c in chunks:
                        k = bounds[d] + np.searchsorted(at[bounds[d] : bounds[d + 1]], c["at"])
                        out.append((c["h"], row, c["at"], c["is_first"], _body(data, int(begins[k]), int(ends[k]))))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], ["h", "row", "at", "is_first", "body"])

    bodies = table.select("row", "z").join(wanted.hint("merge"), "row").select("row", "wanted", "z").mapInArrow(cut, "h long, row long, at int, is_first boolean, body binary")
    bodies = _store.written(bodies, f"{path}/bodies")
    left = bodies.where("not is_first").select("h", "row", "at", "body")
    right = bodies.where("is_first").select("h", F.col("body").alias("first_body"))
    same = left.join(right.hint("merge"), "h").where(F.col("body") == F.col("first_body")).groupBy("row").agg(F.collect_list("at").alias("gone"))

    def rewrite(batches):
        for b in batches:
            for block in _text.blocks(_unpack(b), "text"):
                begins, ends, bounds, at, _ = units(block)
                data = block.buf.tobytes()
                lines, removed, size, packed = [], [], [], []
                pack = zstandard.ZstdCompressor(level=3)
                for d, gone in enumerate(block.columns["gone"].to_pylist()):
                    a, z = int(block.offs[d]), int(block.offs[d + 1])
                    whole = data[a:z]
                    lines.append(whole.count(b"\n") + 1 if whole else 0)
                    n = len(gone or ())
                    if gone:
                        k = bounds[d] + np.searchsorted(at[bounds[d] : bounds[d + 1]], np.sort(gone))
                        left, n_runs, done = [], 0, a
                        for begin, end in zip(begins[k].tolist(), ends[k].tolist(), strict=True):
                            if begin > done or not n_runs:
                                left.append(data[done:begin])
                                n_runs += 1
                            done = max(done, end)
                        # What is left, in order; a line feed before a removed end goes with it.
                        whole = b"".join([*left, data[done:z]])
                        n = n_runs if passages else n
                        if whole.endswith(b"\n") and not data[a:z].endswith(b"\n"):
                            whole = whole[:-1]
                    packed.append(pack.compress(whole))
                    removed.append(n)
                    size.append(z - a - len(whole))
                missing = block.columns["missing"]
                yield pa.RecordBatch.from_arrays(
                    [block.columns["row"], block.columns["key"], block.columns["kept"], missing, pa.array(packed, pa.binary()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(size, pa.int64())],
                    ["row", "key", "kept", "missing", "z", "n_lines", "n_removed_chunks", "n_removed_bytes"],
                )

    whole = table.drop("chunks").join(same.hint("merge"), "row", "left").select("row", "key", "kept", "missing", "gone", "z")
    done = whole.mapInArrow(rewrite, f"row long, key {kinds['key']}, kept {kinds['kept']}, missing boolean, z binary, n_lines long, n_removed_chunks long, n_removed_bytes long")
    done = _store.settled(done, path)
    return _store.with_texts(done).select("row", "key", "kept", "text", "n_lines", "n_removed_chunks", "n_removed_bytes")


def _unpack(batch: pa.RecordBatch) -> pa.RecordBatch:
    buf, offs = _store.unpacked(batch.column(batch.schema.get_field_index("z")).to_pylist())
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(buf.tobytes())])
    names = [n for n in batch.schema.names if n != "z"]
    return pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], text], [*names, "text"])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), passages=True)
    return found.select(F.col("key").alias("doc_id"), "n_lines", "n_removed_chunks", "n_removed_bytes", F.sha2("text", 256).alias("kept_sha256"))
