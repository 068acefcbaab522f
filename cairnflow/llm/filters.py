"""Filters of keys: sets that answer a little too often, and fit where the keys don't."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairnflow.llm.common import map_batches

# Odd multipliers for mixing bits.
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
MOST_BYTES = 32 << 20
"""The largest filter that is sent to all tasks."""


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MULTIPLIERS[2]
    h = (h ^ (h >> np.uint64(29))) * MULTIPLIERS[1]
    return h ^ (h >> np.uint64(32))


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches over which all keys stay the same."""
    cut = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        cut |= k[1:] != k[:-1]
    cut = np.flatnonzero(cut) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(keys[0])]])


_BYTE = (np.arange(1, 257, dtype=np.uint64) * MULTIPLIERS[0]) ^ ((np.arange(1, 257, dtype=np.uint64) * MULTIPLIERS[1]) >> np.uint64(23))


class Prints:
    """Hashes of all parts of a text of any one length, from hashes of parts of 1, 2, 4, ... bytes (or words)."""

    def __init__(self, text: bytes):
        self.powers = [_BYTE[np.frombuffer(text, np.uint8)]]

    @classmethod
    def over(cls, hashes: np.ndarray) -> Prints:
        """Of a sequence of anything that has hashes."""
        out = cls(b"")
        out.powers = [hashes]
        return out

    def of(self, length: int) -> np.ndarray:
        top = length.bit_length() - 1
        while len(self.powers) <= top:
            h, n = self.powers[-1], 1 << (len(self.powers) - 1)
            h = h[:-n] * MULTIPLIERS[1] + h[n:]
            self.powers.append(h ^ (h >> np.uint64(29)))
        h, m = self.powers[top], len(self.powers[0]) - length + 1
        rest = length - (1 << top)
        return mixed(h[:m] * MULTIPLIERS[0] + h[rest : rest + m])


class Filter:
    """Which keys may be in a set: each sets four bits of one word, at 16 bits for a key. It never denies a key that is in it, and few others pass."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def size(keys: int) -> int:
        return 1 << max(6, (keys * 16 // 64).bit_length())

    @staticmethod
    def places(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(keys ^ MULTIPLIERS[1])
        bits = np.zeros(len(h), np.uint64)
        for shift in (0, 6, 12, 18):
            bits |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
        return ((h >> np.uint64(24)) & np.uint64(words - 1)).astype(np.int64), bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        word, bits = self.places(keys, len(self.words))
        return (self.words[word] & bits) == bits


SEGMENT = 1 << 13


def key_filter(keys: DataFrame, count: int, most: int | None = None) -> Filter:
    """The filter of a table of keys; its segments are filled in tasks. Its size has to be checked before, or is most words (a
    power of two), in which many keys leave it to pass more others."""
    words = Filter.size(count) if most is None else min(Filter.size(count), most)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            word, bits = Filter.places(batch.column("key").to_numpy().view(np.uint64), words)
            order = np.argsort(word, kind="stable")
            word, bits = word[order], bits[order]
            a, b = runs(word // SEGMENT) if len(word) else ([], [])
            for i, j in zip(a, b, strict=True):
                part = parts.setdefault(int(word[i]) // SEGMENT, np.zeros(min(SEGMENT, words), np.uint64))
                np.bitwise_or.at(part, word[i:j] % SEGMENT, bits[i:j])
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([p.tobytes() for p in parts.values()], pa.binary())], ["segment", "words"])

    out = np.zeros(words, np.uint64)
    tasks = max(1, min(words // SEGMENT, 64))
    for row in map_batches(keys.select("key").repartition(tasks), fill, "segment bigint, words binary", rows=65_536).toLocalIterator():
        a = row.segment * SEGMENT
        part = np.frombuffer(row.words, np.uint64)
        out[a : a + len(part)] |= part
    return Filter(out)
