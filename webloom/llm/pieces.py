"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut where no piece of the model can lie across (before white space, around line ends),
the distinct parts are concatenated, and a suffix array of that text is built. Every piece is binary-searched
in it; the ranges give all places where pieces stand. These edges, sorted by position, are relaxed from left
to right: an edge extends the encoding of the text before it if the two tokens at the seam stay apart when
the model's merges run over both. The merges fix exactly one such edge for each prefix, so one pass suffices.
Characters that no piece has are written as bytes. Results equal the ``sentencepiece`` library's for BPE
models with identity normalisation, a dummy prefix and byte fallback, which ``Model`` requires.

Defined results: null and empty texts have no ids; a very long text is a batch of its own, encoded whole; of edges that
end at one place the merges leave one, so there are no ties; U+2581 in a text is the model's white space and is
decoded as a space, so such a text doesn't come back as it was; repeated rows give repeated results; an
empty table gives none; a null key stays null; no other column is read.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import _text
from webloom.llm._parts import Parts

_SPACE = "▁"
#: Between parts: no character and no piece has this code point, so U+0000 in a text is a character like any other.
_SEPARATOR = 0x110000
#: Parts that a Python worker keeps between batches and tasks.
MEMO = 400_000
_START = -2


class Model:
    def __init__(self, path: str):
        self.path = path

    def __reduce__(self):
        return _model, (self.path,)

    @cached_property
    def _library(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    @cached_property
    def ids(self) -> dict[str, int]:
        sp = self._library
        n = sp.vocab_size()
        if sp.encode("a  b", out_type=str)[0] != _SPACE + "a" or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("only BPE models with identity normalisation and a dummy prefix are supported")
        return {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}

    @cached_property
    def scores(self) -> dict[str, float]:
        return {p: self._library.get_score(i) for p, i in self.ids.items()}

    @cached_property
    def byte_ids(self) -> list[int]:
        return [self._library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]

    @cached_property
    def outputs(self) -> list[bytes]:
        """The bytes that each id stands for."""
        sp, back = self._library, {i: b for b, i in enumerate(self.byte_ids)}
        n = sp.vocab_size()
        return [bytes([back[i]]) if i in back else b"" if sp.is_control(i) else sp.id_to_piece(i).replace(_SPACE, " ").encode() for i in range(n)]

    @cached_property
    def parts(self) -> re.Pattern:
        """Cuts a text where no piece lies across: where white space begins, and around line ends if no piece has one."""
        if any(_SPACE in p.lstrip(_SPACE) for p in self.ids):
            raise ValueError("pieces with white space after other characters are not supported")
        return re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+" if not self.cuts_lines else f"{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+|\n")

    @cached_property
    def cuts_lines(self) -> bool:
        return not any("\n" in p for p in self.ids)

    @cached_property
    def written(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, begins, sizes): the bytes of all ids' outputs, one after another."""
        sizes = np.array([len(o) for o in self.outputs], np.int64)
        return np.frombuffer(b"".join(self.outputs), np.uint8), np.cumsum(sizes) - sizes, sizes

    @cached_property
    def matrix(self) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Code points of the pieces, padded with 0, their lengths and the pieces."""
        pieces = list(self.ids)
        sizes = np.array([len(p) for p in pieces])
        out = np.zeros((len(pieces), sizes.max()), np.uint32)
        for r, p in enumerate(pieces):
            out[r, : len(p)] = [ord(c) for c in p]
        return out, sizes, pieces

    @cached_property
    def numbers(self) -> np.ndarray:
        return np.array([self.ids[p] for p in self.matrix[2]], "<u4")

    @property
    def first_character(self) -> int:
        """Tokens from here on are characters that are no piece."""
        return len(self.matrix[2])

    def merged(self, text: str) -> list[str]:
        """The model's merges run over a text: the pair with the best score first, the leftmost among equals."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (s := self.scores.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, b, parts[a] + parts[b]))

        for i in range(len(parts) - 1):
            push(i, i + 1)
        while heap:
            _, a, b, whole = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != whole:
                continue
            parts[a], parts[b] = whole, None
            after[a] = after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            push(before[a], a)
            push(a, after[a])
        return [p for p in parts if p is not None]


    @cached_property
    def _edges(self) -> dict[tuple[str, bool], tuple[bool, list[tuple[str, float, float]]] | None]:
        return {}

    def _edge(self, piece: str, last: bool) -> tuple[bool, list[tuple[str, float, float]]] | None:
        """The tokens at a piece's last (or first) place while its merges run, each with the scores of the merges that make
        and end it, and whether the merges' scores only fall; None if the merges don't end in the piece."""
        if (piece, last) not in self._edges:
            parts, out, falls = list(piece), [], True
            since = now = math.inf
            while len(parts) > 1:
                pairs = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores]
                if not pairs:
                    break
                s, i = min(pairs)
                falls &= -s <= now
                now = -s
                if i == (len(parts) - 2 if last else 0):
                    out.append((parts[-1 if last else 0], since, now))
                    since = now
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._edges[piece, last] = (falls, [*out, (piece, since, -math.inf)]) if len(parts) == 1 else None
        return self._edges[piece, last]

    def apart(self, left: str, right: str) -> bool:
        """Whether the merges over both tokens' characters end in these two. They don't if two tokens that stand at the seam at
        one time have a merge that comes before the next one on either side (of equal ones the leftmost is first)."""
        a, b = self._edge(left, True), self._edge(right, False)
        if a is None or b is None:
            return False
        if not (a[0] and b[0]):
            return self.merged(left + right) == [left, right]
        scores = self.scores
        for x, x_since, x_until in a[1]:
            for y, y_since, y_until in b[1]:
                s = scores.get(x + y)
                if s is not None and x_until < y_since and y_until <= x_since and s > x_until and s >= y_until:
                    return False
        return True


_models: dict[str, Model] = {}


def _model(path: str) -> Model:
    return _models.setdefault(path, Model(path))


class Encoder:
    """Encodes blocks of texts; keeps the ids of parts seen before."""

    def __init__(self, model: Model):
        self.model = model
        self.kept = Parts(MEMO)
        #: Pairs of tokens whose seam has been tried, in order, and whether they stay apart.
        self.pairs, self.values = np.zeros(0, np.int64), np.zeros(0, bool)
        self.runs: dict[int, bytes] = {}

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) of texts that begin with the dummy prefix, a space."""
        space, feed = buf == 32, buf == 10
        begins = np.zeros(len(buf) + 1, bool)
        begins[:-1] = space
        begins[1:-1] &= ~space[:-1]
        if self.model.cuts_lines:
            begins[:-1] |= feed
            begins[1:] |= feed
        begins[offs] = True
        return self.kept.encode(buf, np.flatnonzero(begins[: len(buf)]), offs, self._ids_of)

    def _ids_of(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self._learn([p.decode().replace(" ", _SPACE) for p in parts])
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(f) // 4 for f in found], np.int64)

    def _learn(self, new: list[str]) -> list[bytes]:
        """Space runs before a part merge after everything else, and only with each other. A space written as U+2581 cuts a
        part in two."""
        bodies = [p.lstrip(_SPACE) for p in new]
        odd = [i for i, b in enumerate(bodies) if _SPACE in b]
        if odd:
            cut, whole = [self.model.parts.findall(new[i]) for i in odd], set(odd)
            found = dict(zip(extra := sorted({x for p in cut for x in p}), self._learn(extra), strict=True))
            rest = iter(self._learn([p for i, p in enumerate(new) if i not in whole]))
            joined = {i: b"".join([found[x] for x in p]) for i, p in zip(odd, cut, strict=True)}
            return [joined[i] if i in whole else next(rest) for i in range(len(new))]
        cores = [_SPACE + b if len(b) < len(p) else b for p, b in zip(new, bodies, strict=True)]
        distinct = sorted({c for c, b in zip(cores, bodies, strict=True) if b})
        found = dict(zip(distinct, self._matched(distinct), strict=True))
        space = np.array([self.model.ids[_SPACE]], "<u4").tobytes()
        out = []
        for p, b, c in zip(new, bodies, cores, strict=True):
            k = len(p) - len(b)
            ids = found[c] if b else self._run(k)
            if b and k > 1:
                ids = self._run(k) + ids[4:] if ids[:4] == space else self._run(k - 1) + ids
            out.append(ids)
        return out

    def _run(self, k: int) -> bytes:
        if k not in self.runs:
            self.runs[k] = np.array([self.model.ids[p] for p in self.model.merged(_SPACE * k)], "<u4").tobytes()
        return self.runs[k]

    def _matched(self, parts: list[str]) -> list[bytes]:
        """The encodings of distinct parts, relaxed side by side: step k takes the edges that end k
        characters into their part. A character that is no piece is a token of its own."""
        if not parts:
            return []
        sizes = np.array([len(p) for p in parts])
        text = np.frombuffer("\0".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
        text[begins[1:] - 1] = _SEPARATOR
        start, end, piece = self._edges(text)
        whole = np.zeros(len(text), bool)
        whole[start[end - start == 1]] = True
        other = np.flatnonzero(~whole & (text != _SEPARATOR))
        start, end = np.concatenate([start, other]), np.concatenate([end, other + 1])
        piece = np.concatenate([piece, text[other] + self.model.first_character])
        depth = end - np.repeat(begins, sizes + 1)[start]
        # Edges come in order of their piece and stay so at each depth: pairs, which begin with it, are looked up near each other.
        order = np.argsort(depth.astype(np.uint16) if int(sizes.max()) < 1 << 16 else depth, kind="stable")
        start, end, piece, depth = start[order], end[order], piece[order], depth[order]
        steps = np.searchsorted(depth, np.arange(1, int(sizes.max()) + 2))
        last = np.full(len(text) + 2, -1, np.int64)
        last[begins] = _START
        came = np.zeros(len(text) + 2, np.int64)
        for x, y in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            before = last[start[x:y]]
            on = np.flatnonzero(before != -1) + x
            before = last[start[on]]
            on = on[(before == _START) | self._apart(before, piece[on])]
            last[end[on]], came[end[on]] = piece[on], start[on]
        at, row, tokens = begins + sizes, np.arange(len(parts)), []
        while len(at):
            tokens.append((came[at], last[at]))
            at = came[at]
            open_ = at > begins[row]
            at, row = at[open_], row[open_]
        place, token = (np.concatenate(x) for x in zip(*tokens, strict=True))
        order = np.argsort(place)
        place, token = place[order], token[order]
        ids, counts = self._ids(token)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.append(np.searchsorted(place, begins[1:]), len(token))].tolist()
        blob = ids.tobytes()
        return [blob[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _ids(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' ids, and how many each has: a character that is no piece has one for each byte."""
        first = self.model.first_character
        counts = np.ones(len(tokens), np.int64)
        other = {int(i): [self.model.byte_ids[b] for b in chr(int(tokens[i]) - first).encode()] for i in np.flatnonzero(tokens >= first)}
        for i, bytes_ in other.items():
            counts[i] = len(bytes_)
        ids = np.repeat(self.model.numbers[np.minimum(tokens, first - 1)], counts)
        at = np.cumsum(counts) - counts
        for i, bytes_ in other.items():
            ids[at[i] : at[i] + len(bytes_)] = bytes_
        return ids, counts

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges over both tokens' characters end in these two tokens."""
        keys = (right << 32) | np.maximum(left, 0)
        at = np.minimum(np.searchsorted(self.pairs, keys), max(0, len(self.pairs) - 1))
        unknown = (self.pairs[at] != keys) if len(self.pairs) else np.ones(len(keys), bool)
        unknown &= left != _START
        if unknown.any():
            names, first, apart = self.model.matrix[2], self.model.first_character, self.model.apart
            name = lambda t: names[t] if t < first else chr(t - first)
            new = np.unique(keys[unknown])
            values = np.array([apart(name(k & 0xFFFFFFFF), name(k >> 32)) for k in new.tolist()])
            keep = len(self.pairs) < 2 * MEMO
            pairs, values = (np.concatenate([self.pairs, new]), np.concatenate([self.values, values])) if keep else (new, values)
            order = np.argsort(pairs)
            self.pairs, self.values = pairs[order], values[order]
            return self._apart(left, right)
        return self.values[at] if len(self.pairs) else np.zeros(len(keys), bool)

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all places where pieces stand in the text."""
        matrix, sizes, _ = self.model.matrix
        matrix = matrix.astype(text.dtype)
        reach = matrix.shape[1]
        n = len(text)
        alphabet, order = np.unique(text, return_inverse=True)
        ranks = np.zeros(n + max(reach, 64), np.int64)
        ranks[:n] = order + 1
        # As many characters as fit into one number to begin with, then twice as many in each step.
        step = min(reach, 62 // (len(alphabet) + 1).bit_length())
        order = np.zeros(n, np.int64)
        for j in range(step):
            order = order * (len(alphabet) + 1) + ranks[j : j + n]
        order = np.unique(order, return_inverse=True)[1]
        while step < reach:
            later = np.zeros(n, np.int64)
            later[: max(0, n - step)] = order[step:] + 1
            order = np.unique(order * (n + 2) + later, return_inverse=True)[1]
            step *= 2
        suffixes = np.argsort(order)
        at = np.minimum(np.searchsorted(alphabet, matrix), len(alphabet) - 1)
        used = np.arange(reach) < sizes[:, None]
        there = np.flatnonzero(((alphabet[at] == matrix) | ~used).all(axis=1))
        sought, used = np.where(used[there], at[there] + 1, 0), used[there]
        bounds = []
        for after in (False, True):
            low, high = np.zeros(len(there), np.int64), np.full(len(there), n, np.int64)
            while (low < high).any():
                mid = (low + high) >> 1
                here = ranks[suffixes[np.minimum(mid, n - 1)][:, None] + np.arange(reach)]
                differs = (here != sought) & used
                first = differs.argmax(axis=1)
                row = np.arange(len(there))
                below = np.where(differs[row, first], here[row, first] < sought[row, first], after)
                open_ = low < high
                low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)
            bounds.append(low)
        counts = bounds[1] - bounds[0]
        start = suffixes[_text.ragged(bounds[0], counts)]
        piece = np.repeat(there, counts)
        return start, start + sizes[piece], piece


_encoders: dict[str, Encoder] = {}


def _encoder(model: Model) -> Encoder:
    """The worker's encoder, which outlives a task."""
    if model.path not in _encoders:
        _encoders[model.path] = Encoder(model)
    return _encoders[model.path]


def decoded_bytes(ids: np.ndarray, counts: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of these ids, with the dummy prefix."""
    data, begins, sizes = model.written
    out = data[_text.ragged(begins[ids], sizes[ids])]
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])
    return out, ends[np.concatenate([[0], np.cumsum(counts)])]


def decoded(ids: np.ndarray, model: Model) -> str:
    """The text of a document's ids; a dummy prefix is taken off."""
    text = decoded_bytes(ids, np.array([len(ids)]), model)[0].tobytes()
    return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def with_prefix(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that isn't empty."""
    sizes = np.diff(offs)
    some = sizes > 0
    ends = np.concatenate([[0], np.cumsum(sizes + some)])
    out = np.empty(int(ends[-1]), np.uint8)
    own = np.ones(len(out), bool)
    own[ends[:-1][some]] = False
    out[~own] = 32
    out[own] = buf
    return out, ends


def _equal(a: np.ndarray, a_offs: np.ndarray, b: np.ndarray, b_offs: np.ndarray) -> np.ndarray:
    """Whether each text of one side is that of the other."""
    same = np.diff(a_offs) == np.diff(b_offs)
    sizes = np.where(same, np.diff(a_offs), 0)
    differs = np.concatenate([[0], np.cumsum(a[_text.ragged(a_offs[:-1], sizes)] != b[_text.ragged(b_offs[:-1], sizes)])])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return same & (differs[ends[1:]] == differs[ends[:-1]])


def encode_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", *, model: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, ids array<int>, n_pieces, ids_crc32, round_trip, kept). ``model``: the path of a model file that every executor has."""
    return _with_pieces(df, key, text, model, keep)


def decode_pieces(df: DataFrame, key: str = "doc_id", ids: str = "ids", *, model: str | None = None) -> DataFrame:
    """(key, text): null ids give null."""
    m = _model(model or _default())
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField("key", df.schema[key].dataType), StructField("text", StringType())])

    def run(batches):
        for b in batches:
            rows = [None if x is None else decoded(np.array(x, np.int64), m) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.string())], ["key", "text"])

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids")).mapInArrow(run, schema).withColumnRenamed("key", key)


def _default() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _with_pieces(df: DataFrame, key: str, text: str, model: str | None, keep: tuple[str, ...] | None) -> DataFrame:
    m = _model(model or _default())
    kind = dict(df.dtypes)[key]

    def work(block: _text.Block) -> dict:
        buf, offs = with_prefix(block.buf, block.offs)
        ids, counts = _encoder(m).encode(buf, offs)
        data, ends = ids.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
        out = {
            "key": block.columns["key"],
            "n_pieces": counts,
            "ids_crc32": [zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)],
            "round_trip": _equal(*decoded_bytes(ids, counts, m), buf, offs),
        }
        if keep is None:
            return out
        return out | {"ids": _text.ragged_lists(ids.astype(np.int32), counts, pa.int32()), "kept": block.columns["kept"]}

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), *([] if keep is None else [_text.kept(keep)]))
    schema = f"key {kind}, n_pieces long, ids_crc32 long, round_trip boolean" + ("" if keep is None else f", ids array<int>, kept {dict(rows.dtypes)['kept']}")
    return _text.map_blocks(rows, {c: c for c in rows.columns}, work, schema, 2 << 20).withColumnRenamed("key", key)


def round_trips(df: DataFrame, key: str = "doc_id", text: str = "text", *, model: str | None = None) -> DataFrame:
    """(key, n_pieces, ids_crc32, round_trip): ids encoded, as little-endian 32-bit integers for the CRC,
    and whether they decode to the text."""
    return _with_pieces(df, key, text, model, None)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"))
