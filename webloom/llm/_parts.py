"""Ids of distinct parts of texts, kept in flat arrays between the batches and tasks of a Python worker."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa

from webloom.llm import _text


class Parts:
    """Parts seen before, by their bytes, and their ids; at most about ``most`` parts, then all are forgotten."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begins = np.zeros(1 << 16, np.int64)
        self.counts = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _add(self, new: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        at = len(self.memo)
        while at + len(new) > len(self.begins):
            self.begins, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.counts))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.begins[at : at + len(new)] = self.used + np.cumsum(counts) - counts
        self.counts[at : at + len(new)] = counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.memo.update(zip(new, range(at, at + len(new)), strict=True))

    def encode(self, buf: np.ndarray, begins: np.ndarray, offs: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each document) of texts that ``begins`` cuts into parts. ``learn`` gives (ids, counts) of new
        parts."""
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        buf = np.ascontiguousarray(buf)
        cuts = np.append(begins, len(buf)).astype(np.int32)
        found = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(cuts), pa.py_buffer(buf)]).dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False)
        if len(self.memo) > self.most:
            self.forget()
        number = np.fromiter(map(self.memo.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = len(self.memo) + np.arange(len(new))
            parts = distinct[new].tolist()
            self._add(parts, *learn(parts))
        number = number[found.indices.to_numpy()]
        counts = self.counts[number]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[_text.ragged(self.begins[number], counts)], np.diff(ends[np.searchsorted(begins, offs)])
