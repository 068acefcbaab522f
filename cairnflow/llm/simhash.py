"""SimHash near-duplicates: fingerprints, and a hierarchical index in Gray order.

Candidates. The 64 bits are cut in five blocks. Fingerprints that differ in at most three bits agree on at least two
blocks, so they meet under at least one of the ten pairs of blocks; no link is lost.

Index. Rows of one pair of blocks' values, sorted by Gray rank, lie so that neighbours differ in few bits. Sixteen
neighbours form a node, sixteen nodes a node above, and so on. A node keeps the bits on which all below it agree, and
only those that the nodes above it haven't compared already. A search goes down from the root, adding up the
differences, and leaves a whole group as soon as they exceed three.

Links of a block of rows are united at once and come out as one link per row to its root, so the output is at most the
input, however many rows are alike.

Defined results: null and empty texts, and those of white space only, have fingerprint 0 and link like any other; equal
fingerprints are one node, whatever their number; null keys are ignored where the smallest key is taken; an empty table
gives an empty table; further columns are not read.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import map_batches, scratch, text_input, written
from cairnflow.llm.components import Forest, components

SEED = 42
BITS_APART = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
FAN_OUT = 16
ROWS_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 21

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = np.array([[b >> k & 1 for k in range(8)] for b in range(256)])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is 1 if over half of the shingles' hashes have it; 0 without words."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        parts, n = [b" ".join(words)], 1
    else:
        parts, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)), len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.dtype("<u8"), n).view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """key, fingerprint as a (signed) bigint with the same bits."""

    def run(batches):
        for b in batches:
            f = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(f)], ["key", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(text_input(docs, key, text), run, f"key {kind}, fingerprint bigint").withColumnRenamed("key", key)


def gray_rank(bits: Column) -> Column:
    """The place of a bit pattern in the reflected Gray order: each bit is the parity of those above it and itself."""
    for step in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, step))
    return bits


def block_keys(bits: Column) -> Column:
    """The ten keys of a fingerprint: the number of the pair of blocks, and the bits in them."""

    def part(k: int) -> Column:
        start, size = BLOCKS[k]
        return F.shiftrightunsigned(bits, start).bitwiseAND((1 << size) - 1)

    return F.array(
        *(
            F.lit(n << 26).bitwiseOR(F.shiftleft(part(i), 13)).bitwiseOR(part(j))
            for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
        )
    )


def _count(bits: np.ndarray) -> np.ndarray:
    """Ones of each row, of one word or several."""
    n = np.bitwise_count(bits)
    return n.astype(np.int64) if n.ndim == 1 else n.sum(1, dtype=np.int64)


class GrayIndex:
    """Over rows sorted by key and then Gray rank; a tree for each key, all trees side by side in each level.

    bits: a word of 64 bits for each row, or several (rows, words)."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray):
        self.bits = bits
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))  # tree of each row
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.levels = [(bits, np.full(bits.shape, full), np.arange(len(bits) + 1), np.arange(len(bits)) + 1)]
        trees = owner
        while len(trees) > len(first):
            pattern, mask, _, end = self.levels[-1]
            begin = np.flatnonzero(np.r_[True, trees[1:] != trees[:-1]])
            place = np.arange(len(trees)) - np.repeat(begin, np.diff(np.r_[begin, len(trees)]))
            heads = np.flatnonzero(place % FAN_OUT == 0)
            same = np.bitwise_and.reduceat(mask, heads)
            ones, any_ = np.bitwise_and.reduceat(pattern, heads), np.bitwise_or.reduceat(pattern, heads)
            same &= ~(ones ^ any_)
            edges = np.r_[heads, len(trees)]
            self.levels.append((ones & same, same, edges, end[edges[1:] - 1]))
            trees = trees[heads]
        self.root = owner

    def pairs(self, queries: np.ndarray, apart: int = BITS_APART, both: bool = False):
        """(row, later row of the same tree) at most so many bits apart; both: later or earlier, and the bits apart."""
        row, node = queries, self.root[queries]
        acc = np.zeros(len(queries), np.int64)
        known = np.zeros((len(queries), *self.bits.shape[1:]), np.uint64)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, mask, children, end = self.levels[depth]
            acc = acc + _count((self.bits[row] ^ pattern[node]) & mask[node] & ~known)
            live = (acc <= apart) & (both | (end[node] > row + 1))
            row, node, acc = row[live], node[live], acc[live]
            if depth == 0:
                other = node != row if both else node > row
                return (row[other], node[other], acc[other]) if both else (row[other], node[other])
            known = mask[node]
            n = children[node + 1] - children[node]
            at = np.repeat(np.arange(len(node)), n)
            node = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(children[node], n)
            row, acc, known = row[at], acc[at], known[at]


def _links(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hang on another one, and that one's bits."""
    index, forest = GrayIndex(keys, bits), Forest(len(bits))
    size = np.bincount(index.root)[index.root]
    rows = np.flatnonzero(size > 1)
    cuts = np.searchsorted(np.cumsum(size[rows]), np.arange(PAIRS_AT_ONCE, int(size[rows].sum()) + 1, PAIRS_AT_ONCE))
    for part in np.split(rows, np.unique(cuts)):
        if len(part):
            forest.unite(*index.pairs(part))
    root = forest.roots()
    hung = np.flatnonzero(root != np.arange(len(root)))
    return bits[hung], bits[root[hung]]


def link_fingerprints(distinct: DataFrame, column: str = "fingerprint") -> DataFrame:
    """a, b: links that connect all fingerprints at most BITS_APART bits apart."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.select(F.explode(block_keys(F.col(column))).alias("key"), F.col(column).alias("bits"))
    ordered = rows.repartition(parts, "key").sortWithinPartitions("key", gray_rank(F.col("bits")))

    def run(batches):
        keys, bits = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def found(k, b):
            x, y = _links(k, b)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        waiting, held = [], 0
        for b in batches:
            waiting.append((b.column("key").to_numpy().astype(np.int64), b.column("bits").to_numpy().view(np.uint64)))
            held += b.num_rows
            if held >= max(ROWS_AT_ONCE, 2 * len(keys)):
                keys = np.concatenate([keys, *(k for k, _ in waiting)])
                bits = np.concatenate([bits, *(v for _, v in waiting)])
                waiting, held = [], 0
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if cut:
                    yield found(keys[:cut], bits[:cut])
                    keys, bits = keys[cut:], bits[cut:]
        keys = np.concatenate([keys, *(k for k, _ in waiting)])
        bits = np.concatenate([bits, *(v for _, v in waiting)])
        if len(keys):
            yield found(keys, bits)

    return ordered.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """key, fingerprint (bigint), component_id: the smallest key among all documents that links connect."""
    folder = scratch(docs.sparkSession, "simhash")
    marked = written(fingerprints(docs, key, text, shingle), f"{folder}/fingerprints")
    distinct = marked.groupBy("fingerprint").agg(F.min(key).alias("first_key"))
    distinct = written(distinct, f"{folder}/distinct")
    roots = components(link_fingerprints(distinct)).withColumnRenamed("node", "fingerprint")
    joined = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    joined = written(joined, f"{folder}/roots")
    first = joined.groupBy("root").agg(F.min("first_key").alias("component_id"))
    classes = joined.join(first, "root").select("fingerprint", "component_id")
    return marked.join(classes, "fingerprint").select(key, "fingerprint", "component_id")


def hex_digits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
