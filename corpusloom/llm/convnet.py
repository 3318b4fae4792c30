"""Small one-dimensional convolutional network in numpy: embeddings, several filter widths, max pooling, softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class ConvNet:
    """Classifier of fixed-length windows of token ids; id 0 is padding and has a zero embedding.

    Windows are (n, length), or (n, length, k) where a token is the sum of k embeddings.
    """

    def __init__(self, vocab: int, classes: int, dim: int = 16, widths: tuple[int, ...] = (2, 3, 4, 5), filters: int = 32, seed: int = 0, spread: float = 0.3) -> None:
        rng = np.random.default_rng(seed)
        self.widths = widths
        self.p = {"E": rng.normal(0, spread, (vocab, dim)).astype(np.float32)}
        self.p["E"][0] = 0
        for w in widths:
            self.p[f"W{w}"] = rng.normal(0, np.sqrt(2 / (w * dim)), (w * dim, filters)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(filters, np.float32)
        self.p["U"] = rng.normal(0, 0.1, (len(widths) * filters, classes)).astype(np.float32)
        self.p["c"] = np.zeros(classes, np.float32)
        self.m = self.v = None
        self.t = 0

    def embedded(self, x: np.ndarray) -> np.ndarray:
        return self.p["E"][x] if x.ndim == 2 else self.p["E"][x].sum(2)

    def forward(self, emb: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled features of embedded windows, and for each width where each filter has its largest value."""
        out, places = [], []
        dim = emb.shape[2]
        for w in self.widths:
            n = emb.shape[1] - w + 1
            h = emb[:, :n] @ self.p[f"W{w}"][:dim]
            for j in range(1, w):
                h += emb[:, j : j + n] @ self.p[f"W{w}"][j * dim : (j + 1) * dim]
            at = h.argmax(1)
            places.append(at)
            out.append(np.maximum(np.take_along_axis(h, at[:, None, :], 1)[:, 0] + self.p[f"b{w}"], 0))
        return np.concatenate(out, 1), places

    def logits(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        """Scores of each class. Windows of like length go together and their common padding is left out; at
        least one filter width of it stays with every window, so a score does not depend on its batch.

        Every tap of a filter is applied once to each distinct token, and a window adds up what its tokens give.
        """
        out = np.zeros((len(x), len(self.p["c"])), np.float32)
        if not len(x):
            return out
        if x.ndim == 3:
            code = x[:, :, 0]
            for j in range(1, x.shape[2]):
                code = code * len(self.p["E"]) + x[:, :, j]
            _, first, at = np.unique(code, return_index=True, return_inverse=True)
            tokens, at = x.reshape(-1, x.shape[2])[first], at.reshape(code.shape)
            units = self.p["E"][tokens].sum(1)
        else:
            at, units = x, self.p["E"]
        taps = self.taps(units)
        size = ((x if x.ndim == 2 else x[:, :, 0]) != 0).sum(1)
        order = np.argsort(size, kind="stable")
        at = at.astype(np.int32)
        for s in range(0, len(x), batch):
            i = order[s : s + batch]
            out[i] = self.pooled(taps, at[i, : int(size[i[-1]]) + max(self.widths)]) @ self.p["U"] + self.p["c"]
        return out

    def taps(self, units: np.ndarray) -> list[list[np.ndarray]]:
        """For each filter width, what each of its taps gives for each of the embeddings ``units``."""
        dim = units.shape[1]
        return [[np.ascontiguousarray(units @ self.p[f"W{w}"][j * dim : (j + 1) * dim]) for j in range(w)] for w in self.widths]

    def pooled(self, taps: list[list[np.ndarray]], at: np.ndarray) -> np.ndarray:
        """Pooled features of windows of tokens, numbers into ``taps``."""
        at = np.ascontiguousarray(at.T)
        out = []
        for w, own in zip(self.widths, taps):
            n = len(at) - w + 1
            h = own[0].take(at[:n], 0)
            for j in range(1, w):
                h += own[j].take(at[j : j + n], 0)
            out.append(np.maximum(h.max(0) + self.p[f"b{w}"], 0))
        return np.concatenate(out, 1)

    def gradients(self, x: np.ndarray, emb: np.ndarray, feat: np.ndarray, places: list[np.ndarray], d_logit: np.ndarray) -> dict:
        """Gradients of a loss whose derivative by the logits is ``d_logit``."""
        g = {"U": feat.T @ d_logit, "c": d_logit.sum(0)}
        d_feat = (d_logit @ self.p["U"].T) * (feat > 0)
        dim, k = emb.shape[2], d_feat.shape[1] // len(self.widths)
        row, col = np.arange(len(x))[:, None], np.arange(k)
        d_emb = np.zeros_like(emb)
        for i, (w, at) in enumerate(zip(self.widths, places)):
            d = d_feat[:, i * k : (i + 1) * k]
            n = emb.shape[1] - w + 1
            back = np.zeros((len(x), n, k), emb.dtype)
            back[row, at, col] = d
            flat = back.reshape(-1, k)
            taps = []
            for j in range(w):
                taps.append(emb[:, j : j + n].reshape(-1, dim).T @ flat)
                d_emb[:, j : j + n] += back @ self.p[f"W{w}"][j * dim : (j + 1) * dim].T
            g[f"W{w}"] = np.concatenate(taps)
            g[f"b{w}"] = d.sum(0)
        # only the embeddings that occur have a gradient: their rows, and the sums for each
        many = 1 if x.ndim == 2 else x.shape[2]
        ids, grad = x.ravel(), np.repeat(d_emb.reshape(-1, dim), many, axis=0)
        order = np.argsort(ids, kind="stable")
        rows, first = np.unique(ids[order], return_index=True)
        sums = np.add.reduceat(grad[order], first, axis=0)
        g["E"] = (rows[rows > 0], sums[rows > 0])
        return g

    def update(self, g: dict, rate: float) -> None:
        """One Adam step; of the embeddings only the rows that occur move."""
        if self.m is None:
            self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
            self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t += 1
        for k, d in g.items():
            at, d = d if k == "E" else (slice(None), d)
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * d
            v = self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * d * d
            self.p[k][at] -= (rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-7)).astype(np.float32)

    def batches(self, x: np.ndarray, batch: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, int]]:
        """Rows in random batches, and how much of them is more than common padding."""
        size = ((x if x.ndim == 2 else x[:, :, 0]) != 0).sum(1)
        order = rng.permutation(len(x))
        for s in range(0, len(x), batch):
            i = order[s : s + batch]
            yield i, int(size[i].max()) + max(self.widths)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 2e-3, batch: int = 64, seed: int = 0) -> None:
        """Softmax cross-entropy on labelled windows."""
        rng = np.random.default_rng(seed)
        for e in range(epochs):
            for i, long in self.batches(x, batch, rng):
                part = x[i, :long]
                emb = self.embedded(part)
                feat, places = self.forward(emb)
                d = softmax(feat @ self.p["U"] + self.p["c"])
                d[np.arange(len(i)), y[i]] -= 1
                self.update(self.gradients(part, emb, feat, places, d / len(i)), rate * (1 - e / (epochs + 1)))

    def slim(self) -> ConvNet:
        """Without the state of training."""
        self.m = self.v = None
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)
