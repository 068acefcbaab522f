"""Suffix arrays of fragments by two-stage sorting, and what repeats in them.

Only suffixes that are smaller than their successor (type B) are sorted by comparison. The others follow from them: going
through the suffixes in order, the one that starts a letter earlier, if it is of type A, is the next in its letter's bucket,
where type A comes before type B. Whole buckets are moved at a time. As only the first `length` letters of a suffix matter,
comparisons end there."""

from __future__ import annotations

import numpy as np

END = 0xFF
"""Follows every fragment. It is the largest letter, so that the last letters of a fragment are of type B (or are END's
own kind, whose order does not matter). Windows never hold it as such: they end where their fragment ends."""
ROWS_AT_ONCE = 1 << 17


def joined(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """All fragments, each followed by END, and where each one starts; some more END at the end for comparisons."""
    end = bytes([END])
    starts = np.cumsum([0] + [len(b) + 1 for b in bodies[:-1]])
    return np.frombuffer(end.join(bodies) + end * (length + 1), np.uint8), starts


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Type B: the suffix is smaller than the one after it. In a run of one letter the letter after the run decides."""
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = np.append(text[change + 1] > text[change], True)
    return np.repeat(rises, np.diff(np.concatenate([[-1], change, [len(text) - 1]])))


def suffix_order(text: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """The wanted positions (a mask over text without its last `length`), in the order of the first `length` letters."""
    smaller = smaller_than_next(text)
    needed = wanted.copy()
    # a suffix of type A needs the ones after it, up to one of type B
    next_b = np.flatnonzero(smaller)
    last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    last = last[~smaller[last]]
    reach = next_b[np.searchsorted(next_b, last)]
    steps = np.zeros(len(text) + 1, np.int32)
    np.add.at(steps, last, 1)
    np.add.at(steps, reach + 1, -1)
    needed = needed | (np.cumsum(steps[:-1])[: len(needed)] > 0)
    needed = np.append(needed, np.zeros(len(text) - len(needed), bool))

    direct = np.flatnonzero(needed & smaller)
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    compared = np.ascontiguousarray(windows[direct]).view(f"S{length}").ravel()
    direct = direct[np.argsort(compared, kind="stable")]
    letters = text[direct]
    bounds = np.searchsorted(letters, np.arange(257))

    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger = needed & ~smaller
    out = []

    def before(positions: np.ndarray) -> np.ndarray:
        p = positions[positions > 0] - 1
        return p[larger[p]]

    for letter in range(256):
        front = np.concatenate(induced[letter]) if induced[letter] else np.empty(0, np.int64)
        bucket = [front]
        while len(front):
            front = before(front)
            front = front[text[front] == letter]
            bucket.append(front)
        bucket.append(direct[bounds[letter] : bounds[letter + 1]])
        whole = np.concatenate(bucket)
        if not len(whole):
            continue
        out.append(whole)
        moved = before(whole)
        to = text[moved]
        moved, to = moved[to > letter], to[to > letter]
        order = np.argsort(to, kind="stable")
        moved, to = moved[order], to[order]
        ends = np.flatnonzero(np.append(to[1:] != to[:-1], True)) + 1 if len(to) else []
        for a, b in zip([0, *ends[:-1]], ends, strict=True) if len(to) else ():
            induced[to[a]].append(moved[a:b])
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    mask = np.append(wanted, np.zeros(len(text) - len(wanted), bool))
    return order[mask[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """How many letters each suffix shares with the one before it, up to length; 0 for the first."""
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), ROWS_AT_ONCE):
        b = min(len(order), a + ROWS_AT_ONCE)
        rows = windows[order[a - 1 : b]]
        differ = rows[1:] != rows[:-1]
        first = differ.argmax(1)
        out[a:b] = np.where(differ[np.arange(b - a), first], first, length)
    return out


def repeated(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of `length` letters occurred before, in the fragments' order: fragment and offset of each."""
    text, starts = joined(bodies, length)
    counts = np.array([len(b) - length + 1 for b in bodies])
    wanted = np.zeros(len(text) - length, bool)
    steps = np.zeros(len(text) + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + counts, -1)
    wanted[:] = np.cumsum(steps)[: len(wanted)] > 0
    order = suffix_order(text, wanted, length)
    if not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    groups = np.flatnonzero(common_prefixes(text, order, length) < length)
    first = np.minimum.reduceat(order, groups)
    again = order[order != np.repeat(first, np.diff(np.append(groups, len(order))))]
    again.sort()
    fragment = np.searchsorted(starts, again, side="right") - 1
    return fragment, again - starts[fragment]
