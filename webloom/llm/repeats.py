"""Exact removal of long repeated strings by prefix-free parsing.

Every byte covered by a string of ``length`` bytes (a window) that also starts anywhere else, in the same document
or another, is removed.

1. *Parse.* A rolling hash of eight bytes marks triggers: a window's trigger is the first place with the smallest
   hash among its first ``span``. Phrases run from trigger to trigger and overlap by a trigger. As 2 * span + 8 <= length,
   a window's bytes settle its trigger and the phrase that begins there, and equal windows settle equal phrases at
   equal places (a later phrase counts only if the window has all bytes that settle where it ends).
2. *Dictionary.* Distinct phrases are gathered by digest over the corpus. A window that settles a phrase which stands
   nowhere else is done. What is left are the windows of triggers among repeated phrases; a trigger's *context* is
   the bytes of all its windows.
3. *Parse order.* Contexts are dealt out by the phrase that begins at their trigger. A context that stands
   elsewhere too repeats with all its windows; one that stands alone and has no other under its phrase has none.
4. *Corpus order.* Only distinct contexts that share a phrase with others are left: that is where repeats begin and end.
   Their bytes go to blocks, a phrase to one block. There the suffix array of the dictionary (what stands before a
   trigger, with the trigger; by prefix doubling) and that of the parse (what begins at a trigger) are built and
   combined: windows in order of dictionary suffix, then of parse suffix, are in the order of the corpus, and a
   window repeats if it has its length in common with its neighbour in this order. As triggers are least hashes, one
   phrase may begin with another, so the parse's suffixes are compared by their bytes, not by ranks of phrases; common
   prefixes are lengths of equal bytes, counted on the bytes themselves.

Digests are 128 bits of BLAKE2b, so that phrases and contexts that agree in them are the same; hashes choose triggers
only. Under a phrase with more than ``most`` places contexts aren't gathered: each of its windows is looked up by its
own digest instead, exactly, so no block holds an unbounded group.

Texts lie in packs of whole documents, and every question goes from packs to blocks and back as arrays, so it costs
few rows. A pack sends each phrase, context or window once with the number of its places: one that a third of all
documents have costs a block an entry a pack. Numbers of blocks follow the bytes measured.

Defined results: texts shorter than ``length`` and nulls lose nothing; a very long text is a pack of its own, held
by one task; ties can't arise, since every place of a repeated window goes; equal rows lose all their windows; an
empty table gives none; a null key stays null; no other column is read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import _store, _suffixes, _text

_U64 = np.uint64
_GRAM = 8
#: Places of a trigger's hash in the packed values: fixed, so that texts of any size choose alike.
_PLACE_BITS = _U64(32)
#: Bytes of strings gathered at once.
_AT_ONCE = 16 << 20


def triggers(buf: np.ndarray, offs: np.ndarray, length: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, first windows): the triggers of texts in order, and the first window that has each."""
    sizes = np.diff(offs)
    starts = _text.ragged(offs[:-1], np.where(sizes >= length, sizes - _GRAM - span + 2, 0))
    if not len(starts):
        return starts, starts
    grams = len(buf) - _GRAM + 1
    rolled = np.lib.stride_tricks.as_strided(np.ascontiguousarray(buf).view(np.uint8), (grams, _GRAM), (1, 1)).copy().view("<u8").ravel()
    padded = np.full(-(-(grams + span) // span) * span, ~_U64(0))
    padded[:grams] = (_text.mix(rolled) >> _PLACE_BITS << _PLACE_BITS) | np.arange(grams, dtype=_U64)
    table = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[starts], ahead[starts + span - 1]) & ((_U64(1) << _PLACE_BITS) - _U64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return at[first], starts[first]


class Parse:
    """The triggers of texts, in order: ``at``, the windows from ``low`` to ``high`` that have it (none if ``high`` is
    less), where its phrase ends and how far the bytes reach that settle it (-1 for a document's last trigger, which
    has none)."""

    def __init__(self, at: np.ndarray, low: np.ndarray, offs: np.ndarray, length: int, span: int):
        self.at, self.low, self.length, self.offs = at, low, length, offs
        self.doc = np.searchsorted(offs, low, "right") - 1
        follows = self.doc[1:] == self.doc[:-1]
        self.high = offs[self.doc + 1] - length
        self.end = np.full(len(at), -1, np.int64)
        self.reach = np.full(len(at), -1, np.int64)
        self.high[:-1][follows] = np.minimum(self.high[:-1], low[1:] - 1)[follows]
        self.end[:-1][follows] = at[1:][follows] + _GRAM
        self.reach[:-1][follows] = low[1:][follows] + span + _GRAM - 1

    def candidates(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(triggers, last window of each): those with windows that settle repeated phrases only."""
        n = len(self.at)
        #: The first phrase from each trigger on that isn't repeated; a document's last trigger counts as one.
        bad = np.where(repeated, n, np.arange(n))
        bad = np.minimum.accumulate(bad[::-1])[::-1]
        reach = self.reach[np.minimum(bad, n - 1)]
        last = np.where(reach < 0, self.high, np.minimum(self.high, reach - self.length - 1))
        which = np.flatnonzero(repeated & (last >= self.low))
        return which, last[which]


class Strings:
    """Substrings of a text, numbered by equality. ``number`` of each, and of each number a place ``first``."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.buf, self.starts, self.ends = buf, starts, ends
        sizes = ends - starts
        part = (np.cumsum(sizes) - sizes) // _AT_ONCE
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(starts)] if len(starts) else [0]
        known: dict[bytes, int] = {}
        self.number = np.zeros(len(starts), np.int64)
        for a, b in zip(cuts, cuts[1:], strict=False):
            found = _gathered(buf, starts[a:b], sizes[a:b]).dictionary_encode()
            number = found.indices.to_numpy().astype(np.int64)
            if len(cuts) > 2:
                names = [_digest(x) for x in found.dictionary.to_pylist()]
                number = np.array([known.setdefault(d, len(known)) for d in names], np.int64)[number]
            self.number[a:b] = number
        _, self.first, self.counts = np.unique(self.number, return_index=True, return_counts=True)

    def digests(self, which: np.ndarray) -> np.ndarray:
        """A row of two integers for each of these numbers."""
        data, first = self.buf, self.first[which]
        return np.frombuffer(b"".join([_digest(data[a:b]) for a, b in zip(self.starts[first].tolist(), self.ends[first].tolist(), strict=True)]), "<u8").reshape(-1, 2)


def _digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _gathered(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    data = buf[_text.ragged(starts, sizes)]
    offs = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(sizes, out=offs[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(data)])


# -- suffix arrays of a block ------------------------------------------------------------------------------


def _left(sizes: np.ndarray) -> np.ndarray:
    """Symbols up to the end, for strings of these sizes laid one after another with an end each."""
    return np.repeat(np.cumsum(sizes + 1), sizes + 1) - 1 - np.arange(int(sizes.sum()) + len(sizes))


def dictionary_ranks(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ranks of all suffixes of the strings, where each string begins among them)."""
    buf, offs, _ = _text.bytes_of(strings)
    sizes = np.diff(offs)
    begins = offs[:-1] + np.arange(len(sizes))
    left = _left(sizes)
    symbols = np.zeros(len(left) + 7, np.int64)
    symbols[_text.ragged(begins, sizes)] = buf.astype(np.int64) + 1
    key = np.zeros(len(left), np.int64)
    for j in range(7):
        key <<= 9
        key |= np.where(left > j, symbols[j : j + len(left)], 0)
    return _suffixes.suffix_ranks(np.unique(key, return_inverse=True)[1], left, 7), begins


def common_prefixes(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes that each string has in common with the next."""
    out = np.zeros(max(0, len(starts) - 1), np.int64)
    width = int(sizes.max(initial=0))
    padded = np.concatenate([buf, np.zeros(width, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, width) if width else None
    for a in range(0, len(out), 4096):
        b = min(a + 4096, len(out))
        differs = view[starts[a:b]] != view[starts[a + 1 : b + 1]]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        out[a:b] = np.minimum(first, np.minimum(sizes[a:b], sizes[a + 1 : b + 1]))
    return out


class LeastBetween:
    """The least of ``values[a:b]``, for many ranges at once."""

    def __init__(self, values: np.ndarray):
        self.levels = [values.astype(np.int32)]
        while len(self.levels[-1]) > (step := 1 << (len(self.levels) - 1)):
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int32)
        level = np.log2(b - a).astype(np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][a[at]], self.levels[k][b[at] - (1 << k)])
        return out


def repeated_windows(buf: np.ndarray, offs: np.ndarray, length: int, span: int) -> np.ndarray:
    """Whether each window of each of these distinct contexts, one after another, stands in another of them."""
    p = Parse(*triggers(buf, offs, length, span), offs, length, span)
    n = len(offs) - 1
    first = np.searchsorted(p.doc, np.arange(n))
    trigger = p.at[first]
    windows = np.diff(offs) - length + 1
    # The dictionary: what stands before each context's trigger, with it.
    before = _gathered(buf, offs[:-1], trigger + _GRAM - offs[:-1]).dictionary_encode()
    ranks, begins = dictionary_ranks(before.dictionary)
    # The parse: its suffixes from the contexts' triggers on.
    order = pc.sort_indices(_gathered(buf, trigger, offs[1:] - trigger)).to_numpy().astype(np.int64)
    common = common_prefixes(buf, trigger[order], (offs[1:] - trigger)[order])
    of_parse = np.empty(n, np.int64)
    of_parse[order] = np.arange(n)
    # Corpus order: by dictionary suffix, then by parse suffix.
    context = np.repeat(np.arange(n), windows)
    start = _text.ragged(np.zeros(n, np.int64), windows)
    suffix = ranks[begins[before.indices.to_numpy()][context] + start]
    key = suffix.astype(np.int64) * n + of_parse[context]
    order = np.argsort(key)
    x, y = order[:-1], order[1:]
    same = np.flatnonzero(suffix[x] == suffix[y])
    x, y = x[same], y[same]
    out = np.zeros(len(context), bool)
    if len(x):
        needed = length - (trigger - offs[:-1])[context[x]] + start[x]
        least = LeastBetween(common)(of_parse[context[x]], of_parse[context[y]])
        out[x[least >= needed]] = out[y[least >= needed]] = True
    return out


# -- questions and answers ---------------------------------------------------------------------------------

PHRASES, CONTEXTS, WINDOWS, BYTES = 1, 2, 3, 4
#: Answers. Phrases: repeated, or repeated more than ``most`` times. Contexts: all windows repeat; the same, and its bytes
#: stand for all its places; alone, with bytes to be compared. Windows: repeated.
AGAIN, HOT, FULL, SHOWN, SINGLE = 1, 2, 3, 4, 5
_SENT = "question int, block int, pack long, number binary, key binary, value binary, body binary"
_TOLD = "question int, pack long, number binary, answer binary, n_bytes long"


def _block_of(values: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((values >> _U64(32)) * _U64(n_blocks) >> _U64(32)).astype(np.int64)


def _dealt(key: np.ndarray, n_blocks: int):
    """(block, members) of each block that a key falls into."""
    block = _block_of(key, n_blocks)
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        yield int(block[order[a]]), order[a:b]


def _answer(most: int):
    def answer(block: pa.Table) -> pa.Table:
        rows = sorted(block.to_pylist(), key=lambda r: (r["question"], r["pack"]))
        out = []
        for question in sorted({r["question"] for r in rows}):
            own = [r for r in rows if r["question"] == question]
            sizes = [len(r["number"]) // 4 for r in own]
            value = np.frombuffer(b"".join(r["value"] for r in own), "<u8").reshape(-1, 2)
            key = np.frombuffer(b"".join(r["key"] for r in own), "<u8") if question == CONTEXTS else np.zeros(len(value), _U64)
            counts = np.frombuffer(b"".join(r["body"] for r in own), "<u4").astype(np.int64)
            order = np.lexsort((value[:, 1], value[:, 0], key))
            k, v = key[order], value[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1]).any(axis=1)])
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            total = np.add.reduceat(counts[order], first)
            if question == CONTEXTS:
                family = np.cumsum(np.concatenate([[True], k[first][1:] != k[first][:-1]])) - 1
                others = (np.bincount(family) > 1)[family]
                told = np.where(total > 1, FULL, np.where(others, SINGLE, 0))[group]
                told[first[(total > 1) & others]] = SHOWN
            else:
                told = np.where(total > 1, np.where((total > most) & (question == PHRASES), HOT, AGAIN), 0)[group]
            answers = np.empty(len(value), np.uint8)
            answers[order] = told
            at = 0
            for r, size in zip(own, sizes, strict=True):
                got = answers[at : at + size]
                some = got > 0
                number = np.frombuffer(r["number"], "<u4")[some]
                at += size
                if len(number):
                    out.append((question, r["pack"], number.tobytes(), got[some].tobytes(), int((got >= SHOWN).sum())))
        return _told(out)

    return answer


def _told(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(("question", "pack", "number", "answer", "n_bytes"), kinds, strict=True))})


def _compare(length: int, span: int):
    def compare(block: pa.Table) -> pa.Table:
        rows = sorted(block.to_pylist(), key=lambda r: r["pack"])
        unpack = zstandard.ZstdDecompressor()
        buf = np.frombuffer(b"".join(unpack.decompress(r["body"]) for r in rows), np.uint8)
        offs = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(r["value"] for r in rows), "<u4"), dtype=np.int64)])
        again = repeated_windows(buf, offs, length, span)
        out, at, w = [], 0, 0
        for r in rows:
            n = len(r["number"]) // 4
            size = int((np.diff(offs[at : at + n + 1]) - length + 1).sum())
            out.append((BYTES, r["pack"], r["number"], np.packbits(again[w : w + size]).tobytes(), 0))
            at, w = at + n, w + size
        return _told(out)

    return compare


class _Pack:
    """A pack's parse with what has been answered so far."""

    def __init__(self, row: dict, length: int, span: int):
        self.text = zstandard.ZstdDecompressor().decompress(row["z"]) if row["z"] else b""
        self.buf = np.frombuffer(self.text, np.uint8)
        self.offs = np.frombuffer(row["offs"], np.int64)
        self.length, self.got = length, row.get("got") or []
        self.parse = p = Parse(*(np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("at", "low")), self.offs, length, span)
        if not len(p.at):
            return
        self.whole = np.flatnonzero(p.end >= 0)
        self.phrases = Strings(self.buf, p.at[self.whole], p.end[self.whole])
        if any(g["question"] == PHRASES for g in self.got):
            self._candidates()

    def answers(self, question: int, n: int) -> np.ndarray:
        out = np.zeros(n, np.uint8)
        for g in self.got:
            if g["question"] == question:
                out[np.frombuffer(g["number"], "<u4")] = np.frombuffer(g["answer"], np.uint8)
        return out

    def _candidates(self) -> None:
        p = self.parse
        state = np.zeros(len(p.at), np.uint8)
        state[self.whole] = self.answers(PHRASES, len(self.phrases.first))[self.phrases.number]
        which, last = p.candidates(state > 0)
        hot = state[which] == HOT
        self.low, self.last = p.low[which[~hot]], last[~hot]
        self.contexts = Strings(self.buf, self.low, self.last + self.length)
        #: The phrase that begins at each distinct context's trigger.
        number = np.zeros(len(p.at), np.int64)
        number[self.whole] = self.phrases.number
        self.phrase = number[which[~hot]][self.contexts.first]
        self.starts = _text.ragged(p.low[which[hot]], last[hot] - p.low[which[hot]] + 1)
        self.windows = Strings(self.buf, self.starts, self.starts + self.length)

    def ask(self, question: int, pack: int, n_blocks: int):
        strings = {PHRASES: self.phrases, CONTEXTS: getattr(self, "contexts", None), WINDOWS: getattr(self, "windows", None)}[question]
        # A pack without a repeated phrase was told nothing: it has no contexts.
        if strings is None or not len(strings.first):
            return
        value = strings.digests(np.arange(len(strings.first)))
        key = value[:, 0]
        if question == CONTEXTS:
            used, back = np.unique(self.phrase, return_inverse=True)
            key = self.phrases.digests(used)[back, 0]
        for block, own in _dealt(key, n_blocks):
            yield question, block, pack, own.astype("<u4").tobytes(), key[own].tobytes() if question == CONTEXTS else b"", value[own].tobytes(), strings.counts[own].astype("<u4").tobytes()

    def show(self, pack: int, n_blocks: int):
        """The bytes of contexts to be compared."""
        if not hasattr(self, "contexts"):
            return
        own = np.flatnonzero(self.answers(CONTEXTS, len(self.contexts.first)) >= SHOWN)
        if not len(own):
            return
        used, back = np.unique(self.phrase[own], return_inverse=True)
        key = self.phrases.digests(used)[back, 0]
        press = zstandard.ZstdCompressor(level=3)
        first = self.contexts.first[own]
        begins, ends = self.contexts.starts[first], self.contexts.ends[first]
        for block, which in _dealt(key, n_blocks):
            body = b"".join([self.text[a:b] for a, b in zip(begins[which].tolist(), ends[which].tolist(), strict=True)])
            yield BYTES, block, pack, own[which].astype("<u4").tobytes(), b"", (ends - begins)[which].astype("<u4").tobytes(), press.compress(body)

    def removed(self) -> np.ndarray:
        """Whether each byte is covered."""
        change = np.zeros(len(self.text) + 1, np.int64)
        if hasattr(self, "contexts"):
            told = self.answers(CONTEXTS, len(self.contexts.first))[self.contexts.number]
            full = (told == FULL) | (told == SHOWN)
            n = len(change)
            change += np.bincount(self.low[full], minlength=n) - np.bincount(self.last[full] + self.length, minlength=n)
            hits = [self.starts[self.answers(WINDOWS, len(self.windows.first))[self.windows.number] > 0]]
            # A context that stands alone has one place; the bits say which of its windows repeat.
            sizes = (self.last - self.low + 1)[self.contexts.first]
            for g in self.got:
                if g["question"] == BYTES:
                    number = np.frombuffer(g["number"], "<u4")
                    again = np.unpackbits(np.frombuffer(g["answer"], np.uint8), count=int(sizes[number].sum())).astype(bool)
                    hits.append(_text.ragged(self.low[self.contexts.first[number]], sizes[number])[again])
            hits = np.concatenate(hits)
            change += np.bincount(hits, minlength=n) - np.bincount(hits + self.length, minlength=n)
        return np.cumsum(change[:-1]) > 0


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", *, length: int = 400, span: int = 200, n_blocks: int | None = None, block_bytes: int = 16 << 20, most: int = 20_000) -> DataFrame:
    """(key, n_bytes, spans, kept_sha256): for each document the maximal runs of removed bytes [a, b) and the
    SHA-256 of the bytes left. ``span`` is at most what the parse allows, (length - 8) / 2. ``n_blocks``: digests are dealt to so
    many tasks; by default twice the session's shuffle partitions, or more if a block would pass ``block_bytes``."""
    span = min(span, (length - _GRAM) // 2)
    if span < 1:
        raise ValueError(f"length must be {_GRAM + 2} or more")
    spark = df.sparkSession
    path = _store.work_dir(spark)
    kind = dict(df.dtypes)[key]
    counters: list[int] = []

    def pack(block: _text.Block) -> dict:
        counters.append(1)
        if len(block.buf) >= 1 << int(_PLACE_BITS):
            raise ValueError("a text has 2^32 bytes or more")
        z = zstandard.ZstdCompressor(level=3).compress(block.buf.tobytes())
        at, low = (x.astype("<u4").tobytes() for x in triggers(block.buf, block.offs, length, span))
        number = (TaskContext.get().partitionId() << 33) + len(counters)
        return {"pack": [number], "z": [z], "offs": [block.offs.tobytes()], "at": [at], "low": [low], "size": [len(block.buf)], "keys": _text.ragged_lists(block.columns["key"], np.array([block.n]), None)}

    packs = _store.written(_text.map_blocks(df, {"key": key, "text": text}, pack, f"pack long, z binary, offs binary, at binary, low binary, size long, keys array<{kind}>"), f"{path}/packs")
    total = packs.agg(F.sum("size")).first()[0] or 0
    packs = packs.drop("size")
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A phrase is half a span long on average, and its entry has some thirty bytes.
    digest_blocks = n_blocks or max(least, total * 64 // span // block_bytes)
    told = None
    for questions in ((PHRASES,), (CONTEXTS, WINDOWS), (BYTES,)):
        if questions == (BYTES,):
            shown = told.agg(F.sum("n_bytes")).first()[0] or 0
            blocks = n_blocks or max(least, shown * (length + span) // block_bytes)
        else:
            blocks = digest_blocks

        def ask(batches, questions=questions, blocks=blocks):
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            for b in batches:
                for row in b.to_pylist():
                    p = _Pack(row, length, span)
                    if not len(p.parse.at):
                        continue
                    out = [r for q in questions for r in (p.show(row["pack"], blocks) if q == BYTES else p.ask(q, row["pack"], blocks))]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["question", "block", "pack", "number", "key", "value", "body"])
            _text.release()

        source = packs if told is None else packs.join(_by_pack(told), "pack", "left")
        answer = _compare(length, span) if questions == (BYTES,) else _answer(most)
        answers = source.mapInArrow(ask, _SENT).groupBy("block").applyInArrow(answer, _TOLD)
        answers = _store.written(answers, f"{path}/answers{questions[0]}")
        told = answers if told is None else told.unionByName(answers)

    def finish(batches):
        for b in batches:
            for i, row in enumerate(b.to_pylist()):
                p = _Pack(row, length, span)
                gone = p.removed()
                any_gone = np.concatenate([[0], np.cumsum(gone)])
                spans, shas = [], []
                for a, z in zip(p.offs[:-1].tolist(), p.offs[1:].tolist(), strict=True):
                    runs = []
                    if any_gone[z] > any_gone[a]:
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:z], [False]]).astype(np.int8)))
                        runs = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
                    spans.append(runs)
                    sha, at = hashlib.sha256(), a
                    for x, y in runs:
                        sha.update(p.text[at : a + x])
                        at = a + y
                    sha.update(p.text[at:z])
                    shas.append(sha.hexdigest())
                keys = b.column(b.schema.get_field_index("keys"))[i].values
                flat = pa.StructArray.from_arrays([pa.array([r[k] for s in spans for r in s], pa.int64()) for k in (0, 1)], ["a", "b"])
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(p.offs)), _text.ragged_lists(flat, np.array([len(s) for s in spans]), None), pa.array(shas, pa.string())], ["key", "n_bytes", "spans", "kept_sha256"])
        _text.release()

    done = packs.join(_by_pack(told), "pack", "left").mapInArrow(finish, f"key {kind}, n_bytes long, spans array<struct<a:long,b:long>>, kept_sha256 string")
    return _store.settled(done, path).withColumnRenamed("key", key)


def _by_pack(told: DataFrame) -> DataFrame:
    return told.groupBy("pack").agg(F.collect_list(F.struct("question", "number", "answer")).alias("got"))


def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["b"] - s["a"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
