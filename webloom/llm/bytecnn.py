"""A small byte-level convolutional network in numpy.

Bytes are embedded, filters of several widths run over windows of a fixed length, each filter's largest
response in a window is kept (max pooling, then a rectifier), and a softmax gives the classes. With
``over_document`` the pooled windows of a document are first combined into their maximum and their mean.
Windows overlap by the widest filter less one byte, so every run of bytes that a filter can see lies whole
in some window and the windows cover the whole text.

Training touches only the places that won the pooling, and is repeatable: fixed seeds, sorted samples.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from webloom.llm import _text


@dataclass
class ByteCNN:
    classes: list
    length: int = 256
    widths: tuple[int, ...] = (2, 3, 5)
    filters: int = 16
    dim: int = 8
    over_document: bool = False
    fold_case: bool = False
    seed: int = 7
    params: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        w, f = max(self.widths), self.filters * len(self.widths)
        mask = np.zeros((w, self.dim, f), np.float32)
        for k, width in enumerate(self.widths):
            mask[:width, :, k * self.filters : (k + 1) * self.filters] = 1
        self.mask = mask.reshape(w * self.dim, f)
        if not self.params:
            n = f * (2 if self.over_document else 1)
            self.params = {
                "embed": rng.normal(0, 0.5, (256, self.dim)).astype(np.float32),
                "conv": (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32),
                "bias": np.zeros(f, np.float32),
                "out": rng.normal(0, 0.1, (n, len(self.classes))).astype(np.float32),
                "out_bias": np.zeros(len(self.classes), np.float32),
            }
            self.params["embed"][0] = 0

    @property
    def overlap(self) -> int:
        return max(self.widths) - 1

    def windows(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows, bounds, sizes): document i's windows are those from bounds[i] to bounds[i + 1], zeros
        after a text's end; sizes are bytes of text. An empty text has one empty window."""
        step = self.length - self.overlap
        sizes = np.diff(offs)
        counts = np.maximum(1, -(-(sizes - self.overlap) // step))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        begins = offs[:-1].repeat(counts) + _text.ragged(np.zeros(len(counts), np.int64), counts) * step
        left = np.minimum(self.length, offs[1:].repeat(counts) - begins)
        padded = np.concatenate([_text.LOWER[buf] if self.fold_case else buf, np.zeros(self.length, np.uint8)])
        out = np.lib.stride_tricks.sliding_window_view(padded, self.length)[begins].copy()
        short = np.flatnonzero(left < self.length)
        out[short] *= np.arange(self.length) < left[short, None]
        return out, bounds, left

    def _responses(self, windows: np.ndarray) -> np.ndarray:
        """Every filter's response at every place where the widest filter fits."""
        p, w = self.params, max(self.widths)
        places = self.length - w + 1
        x = p["embed"][windows]
        view = np.lib.stride_tricks.sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2)
        columns = np.ascontiguousarray(view).reshape(-1, w * self.dim)
        return (columns @ p["conv"]).reshape(len(windows), places, -1)

    def pooled(self, windows: np.ndarray, at_once: int = 256) -> np.ndarray:
        out = np.empty((len(windows), self.mask.shape[1]), np.float32)
        for a in range(0, len(windows), at_once):
            out[a : a + at_once] = self._responses(windows[a : a + at_once]).max(axis=1)
        return np.maximum(out + self.params["bias"], 0)

    def _combined(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not self.over_document:
            return h
        counts = np.diff(bounds)[:, None]
        return np.concatenate([np.maximum.reduceat(h, bounds[:-1]), np.add.reduceat(h, bounds[:-1]) / counts], axis=1)

    def probabilities(self, windows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """A row for each document if the network is over documents, else for each window."""
        z = self._combined(self.pooled(windows), bounds) @ self.params["out"] + self.params["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, examples: list[np.ndarray], labels: np.ndarray, steps: int = 500, batch: int = 32, rate: float = 4e-3, decay: float = 1e-4) -> ByteCNN:
        """``examples``: the windows of each; ``labels``: indexes of classes."""
        rng = np.random.default_rng(self.seed)
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.params.items()}
        step = 0
        while step < steps:
            order = rng.permutation(len(examples))
            for a in range(0, len(order), batch)[: steps - step]:
                picked = order[a : a + batch]
                grads = self._gradients([examples[i] for i in picked], labels[picked])
                step += 1
                now = rate * (1 - step / (steps + 1))
                for k, g in grads.items():
                    m, v = state[k]
                    g = g + decay * self.params[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.params[k] -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
                self.params["conv"] *= self.mask
                self.params["embed"][0] = 0
        return self

    def _gradients(self, examples: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        p, w = self.params, max(self.widths)
        windows = np.concatenate(examples)
        bounds = np.concatenate([[0], np.cumsum([len(e) for e in examples])])
        where, raw = (np.empty((len(windows), self.mask.shape[1]), t) for t in (np.int64, np.float32))
        for a in range(0, len(windows), 256):
            responses = self._responses(windows[a : a + 256])
            where[a : a + 256] = most = responses.argmax(axis=1)
            raw[a : a + 256] = np.take_along_axis(responses, most[:, None], axis=1)[:, 0] + p["bias"]
        h = np.maximum(raw, 0)
        doc = self._combined(h, bounds)
        z = doc @ p["out"] + p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(z)), labels] -= 1
        z /= len(z)
        grads = {"out": doc.T @ z, "out_bias": z.sum(axis=0)}
        g = z @ p["out"].T
        if self.over_document:
            f, counts = h.shape[1], np.diff(bounds)
            most = np.repeat(doc[:, :f], counts, axis=0)
            won = h == most
            shared = np.repeat(np.add.reduceat(won.astype(np.float32), bounds[:-1]), counts, axis=0)
            g = np.repeat(g[:, :f], counts, axis=0) * won / shared + np.repeat(g[:, f:] / counts[:, None], counts, axis=0)
        g = g * (raw > 0)
        grads["bias"] = g.sum(axis=0)
        # Only the winning places take part: their bytes' embeddings, for each window and filter.
        span = where[:, :, None] + np.arange(w)
        rows = np.arange(len(windows))[:, None, None]
        which = windows[rows, span]
        seen = p["embed"][which].reshape(len(windows), where.shape[1], -1)
        grads["conv"] = np.einsum("nf,nfk->kf", g, seen, optimize=True) * self.mask
        back = (g[:, :, None] * p["conv"].T[None]).reshape(-1, self.dim)
        grads["embed"] = np.stack([np.bincount(which.reshape(-1), back[:, d], 256) for d in range(self.dim)], axis=1).astype(np.float32)
        return grads
