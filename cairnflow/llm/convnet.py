"""A byte-level convolutional network in numpy.

Bytes are embedded; learned filters of WIDTH bytes slide over the whole document in steps of STRIDE; each overlapping
chunk keeps the maximum of every filter; the document keeps, of every filter, the maximum and the mean over its chunks,
and a hidden layer makes one probability of them. A document of any length goes through in slices of bounded size.
"""

from __future__ import annotations

import numpy as np

WIDTH, STRIDE = 12, 4
BLOCK = 32
"""Frames (filter positions) of a block; a chunk is CHUNK blocks and shares one with the next chunk."""
CHUNK, HOP = 4, 3
SLICE = 1 << 16
"""Bytes that are put through the filters at once: a whole number of blocks."""
ECHO = 64


def echoes(data: np.ndarray) -> np.ndarray:
    """1 where the four bytes that end here have occurred among the ECHO byte positions before (repetition)."""
    n = len(data)
    out = np.zeros(n, np.float32)
    if n < 8:
        return out
    d = data.astype(np.uint32)
    grams = d[3:] | d[2:-1] << 8 | d[1:-2] << 16 | d[:-3] << 24
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    near = (g[1:] == g[:-1]) & (order[1:] - order[:-1] <= ECHO)
    out[order[1:][near] + 3] = 1
    return out


class ConvNet:
    def __init__(self, filters: int = 32, dims: int = 7, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.dims, self.filters = dims, filters
        self.w = {
            "embed": (rng.standard_normal((256, dims)) * 0.5).astype(np.float32),
            "conv": scale(WIDTH * (dims + 1), filters),
            "conv_b": np.zeros(filters, np.float32),
            "dense": scale(2 * filters, hidden),
            "dense_b": np.zeros(hidden, np.float32),
            "out": scale(hidden, 1),
            "out_b": np.zeros(1, np.float32),
        }

    # The filters

    def _frames(self, data: np.ndarray, echo: np.ndarray) -> np.ndarray:
        """Inputs of all filter positions: (frames, WIDTH * (dims + 1))."""
        n = max(1, -(-len(data) // STRIDE))
        size = (n - 1) * STRIDE + WIDTH
        x = np.zeros((size, self.dims + 1), np.float32)
        m = min(len(data), size)
        x[:m, :-1] = self.w["embed"][data[:m]]
        x[:m, -1] = echo[:m]
        row, item = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, WIDTH * (self.dims + 1)), (row * STRIDE, item)), x

    def _blocks(self, data: np.ndarray, echo: np.ndarray) -> np.ndarray:
        """The maximum of each filter in each block of BLOCK frames, slice by slice."""
        out, step = [], SLICE
        for at in range(0, max(1, len(data)), step):
            frames, _ = self._frames(data[at : at + step + WIDTH - STRIDE], echo[at : at + step + WIDTH - STRIDE])
            n = max(1, -(-min(step, len(data) - at) // STRIDE))
            h = np.maximum(frames[:n] @ self.w["conv"] + self.w["conv_b"], 0)
            out.append(np.maximum.reduceat(h, np.arange(0, n, BLOCK), axis=0))
        return np.concatenate(out)

    @staticmethod
    def chunk_starts(blocks: int) -> np.ndarray:
        return np.arange(0, max(1, blocks - CHUNK + HOP), HOP)

    def _pooled(self, blocks: np.ndarray) -> np.ndarray:
        starts = self.chunk_starts(len(blocks))
        chunks = np.stack([blocks[s : s + CHUNK].max(0) for s in starts]) if len(starts) < 64 else self._chunks(blocks, starts)
        return np.concatenate([chunks.max(0), chunks.mean(0)])

    @staticmethod
    def _chunks(blocks: np.ndarray, starts: np.ndarray) -> np.ndarray:
        rows = np.minimum(starts[:, None] + np.arange(CHUNK), len(blocks) - 1)
        return blocks[rows].max(1)

    def _head(self, pooled: np.ndarray) -> np.ndarray:
        h = np.maximum(pooled @ self.w["dense"] + self.w["dense_b"], 0)
        return (h @ self.w["out"] + self.w["out_b"])[:, 0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """A probability for each document, of its whole bytes."""
        if not texts:
            return np.zeros(0)
        pooled = []
        for t in texts:
            data = np.frombuffer(t, np.uint8)
            pooled.append(self._pooled(self._blocks(data, echoes(data))))
        return 1 / (1 + np.exp(-self._head(np.stack(pooled)).astype(np.float64)))

    # Fitting

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = 180, size: int = 32, rate: float = 4e-3, seed: int = 7) -> ConvNet:
        """Adam on the log loss, over the whole bytes of every document of the sample."""
        rng = np.random.default_rng(seed)
        data = [np.frombuffer(t, np.uint8) for t in texts]
        echo = [echoes(d) for d in data]
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        var = {k: np.zeros_like(v) for k, v in self.w.items()}
        done = 0
        while done < steps:
            order = rng.permutation(len(data))
            for at in range(0, len(order), size):
                some = order[at : at + size]
                grads = self._gradients([data[i] for i in some], [echo[i] for i in some], y[some].astype(np.float32))
                done += 1
                lr = rate * max(0.0, 1 - done / (steps + 1))
                for k, g in grads.items():
                    mean[k] += 0.1 * (g - mean[k])
                    var[k] += 0.001 * (g * g - var[k])
                    self.w[k] -= lr * (mean[k] / (1 - 0.9**done)) / (np.sqrt(var[k] / (1 - 0.999**done)) + 1e-8)
        return self

    def _gradients(self, data, echo, y) -> dict[str, np.ndarray]:
        w, f = self.w, self.filters
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        kept, pooled = [], []
        for d, e in zip(data, echo, strict=True):
            frames, x = self._frames(d, e)
            h = np.maximum(frames @ w["conv"] + w["conv_b"], 0)
            n = len(h)
            begin = np.arange(0, n, BLOCK)
            blocks = np.maximum.reduceat(h, begin, axis=0)
            starts = self.chunk_starts(len(blocks))
            rows = np.minimum(starts[:, None] + np.arange(CHUNK), len(blocks) - 1)
            best = blocks[rows].argmax(1)  # chunk, filter
            best = np.take_along_axis(rows, best, 1)  # the block that gives the chunk's maximum
            chunks = np.take_along_axis(blocks, best, 0)
            top = chunks.argmax(0)
            kept.append((d, h, begin, blocks, best, chunks, top))
            pooled.append(np.concatenate([chunks.max(0), chunks.mean(0)]))
        p = np.stack(pooled)
        hid = np.maximum(p @ w["dense"] + w["dense_b"], 0)
        raw = (hid @ w["out"] + w["out_b"])[:, 0]
        err = ((1 / (1 + np.exp(-raw)) - y) / len(y))[:, None].astype(np.float32)
        grads["out"], grads["out_b"] = hid.T @ err, err.sum(0)
        dhid = (err @ w["out"].T) * (hid > 0)
        grads["dense"], grads["dense_b"] = p.T @ dhid, dhid.sum(0)
        dp = dhid @ w["dense"].T
        columns = np.arange(f)
        for (d, h, begin, blocks, best, chunks, top), g, e in zip(kept, dp, echo, strict=True):
            dchunk = np.tile(g[f:] / len(chunks), (len(chunks), 1))
            dchunk[top, columns] += g[:f]
            dblock = np.zeros_like(blocks)
            np.add.at(dblock, (best, np.broadcast_to(columns, best.shape)), dchunk)
            b, c = np.nonzero(dblock * (blocks > 0))
            if not len(b):
                continue
            # The frame of each block maximum: few (block, filter) pairs carry a gradient.
            place = np.minimum(begin[b][:, None] + np.arange(BLOCK), len(h) - 1)
            frame = begin[b] + h[place, c[:, None]].argmax(1)
            frame = np.minimum(frame, len(h) - 1)
            dv = dblock[b, c]
            frames, x = self._frames(d, e)
            part = frames[frame]
            dpre = np.zeros((len(b), f), np.float32)
            dpre[np.arange(len(b)), c] = dv
            grads["conv"] += part.T @ dpre
            grads["conv_b"] += dpre.sum(0)
            dx = (dpre @ w["conv"].T).reshape(len(b), WIDTH, self.dims + 1)[:, :, :-1]
            at = frame[:, None] * STRIDE + np.arange(WIDTH)
            inside = at < len(d)
            np.add.at(grads["embed"], d[np.minimum(at, len(d) - 1)][inside], dx[inside])
        return grads
