"""Directly addressable codes: integers cut in byte-wide chunks, one level for each chunk.

Level 0 holds the lowest byte of every integer, level 1 the next byte of those that need one, and so on. A bitmap for
each level marks the integers that continue on the next one, and a rank directory (ones in front of each 512 bits) turns
a place on one level into the place on the next. So token i is read with a few fixed-size reads and no decoding of its
neighbours; a range of tokens is a contiguous slice of every level.

File: b"DAC1", the levels' bytes, bitmaps and directories, the document directory (ids, null marks, first tokens), a
JSON footer with all offsets, its length in 8 bytes, b"DAC1".
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

MAGIC = b"DAC1"
BLOCK = 512


def levels_of(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each level: chunk bytes, bitmap bytes (padded to whole blocks), rank directory."""
    out, rest = [], values.astype(np.uint32)
    while True:
        more = rest > 255
        bitmap = np.zeros((len(rest) // BLOCK + 1) * (BLOCK // 8), np.uint8)
        packed = np.packbits(more, bitorder="little")
        bitmap[: len(packed)] = packed
        ones = np.bitwise_count(bitmap.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
        directory = np.zeros(len(ones), np.uint32)
        directory[1:] = np.cumsum(ones)[:-1]
        out.append(((rest & 255).astype(np.uint8), bitmap, directory))
        rest = rest[more] >> 8
        if not len(rest):
            return out


def dump(values: np.ndarray, ids: list[int | None], starts: np.ndarray) -> bytes:
    """A file's bytes; starts: the first token of each document, and the number of tokens at the end."""
    parts, at, levels = [MAGIC], len(MAGIC), []

    def put(array: np.ndarray) -> int:
        nonlocal at
        data = array.tobytes()
        parts.append(data)
        at += len(data)
        return at - len(data)

    for chunks, bitmap, directory in levels_of(values):
        levels.append({"n": len(chunks), "chunks": put(chunks), "bitmap": put(bitmap), "directory": put(directory)})
    footer = {
        "levels": levels,
        "docs": len(ids),
        "ids": put(np.array([i or 0 for i in ids], "<i8")),
        "nulls": put(np.array([i is None for i in ids], np.uint8)),
        "starts": put(np.asarray(starts, "<i8")),
    }
    tail = json.dumps(footer).encode()
    return b"".join([*parts, tail, len(tail).to_bytes(8, "little"), MAGIC])


class Reader:
    """read(offset, size) gives bytes of the file, of which `size` is the length; nothing else is read."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail = read(size - 12, 12)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of directly addressable codes, or one cut short")
        n = int.from_bytes(tail[:8], "little")
        self.footer = json.loads(read(size - 12 - n, n))
        self.levels = self.footer["levels"]
        self.n = self.levels[0]["n"]

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        n, f = self.footer["docs"], self.footer
        ids = np.frombuffer(self.read(f["ids"], 8 * n), "<i8").tolist()
        nulls = self.read(f["nulls"], n)
        return [None if z else i for i, z in zip(ids, nulls, strict=True)], np.frombuffer(self.read(f["starts"], 8 * n + 8), "<i8")

    def _rank(self, level: dict, i: int) -> int:
        """Integers in front of place i that continue on the next level."""
        block = i // BLOCK
        before = int.from_bytes(self.read(level["directory"] + 4 * block, 4), "little")
        bits = int.from_bytes(self.read(level["bitmap"] + block * (BLOCK // 8), BLOCK // 8), "little")
        return before + (bits & ((1 << (i % BLOCK)) - 1)).bit_count()

    def token(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, level in enumerate(self.levels):
            value |= self.read(level["chunks"] + i, 1)[0] << (8 * k)
            if not self.read(level["bitmap"] + i // 8, 1)[0] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Tokens start..end-1: a slice of each level."""
        out, places = np.zeros(max(0, end - start), np.uint32), np.arange(max(0, end - start))
        for k, level in enumerate(self.levels):
            if start >= end:
                break
            out[places] |= np.frombuffer(self.read(level["chunks"] + start, end - start), np.uint8).astype(np.uint32) << np.uint32(8 * k)
            first = start // 8
            bits = np.unpackbits(np.frombuffer(self.read(level["bitmap"] + first, end // 8 + 1 - first), np.uint8), bitorder="little")
            places = places[bits[start - 8 * first : end - 8 * first].astype(bool)]
            start, end = self._rank(level, start), self._rank(level, end)
        return out
