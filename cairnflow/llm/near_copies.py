"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints. PARTS words of bits over the set of shingles, by majority as in simhash.py. Two texts of similarity s
agree on a bit with a chance of at least 1 - arccos(2s / (1 + s)) / pi, so the number of bits in which a pair at the
least similarity differs is known, and the radius is the one that all but a tenth of MISSED of such pairs keep. The index compares
the first words; the others are carried in the last round only.

Candidates. A radius as wide as this shares no whole blocks, so fingerprints meet in tables: each table masks some bits,
as many as bring its groups of equal masked bits to about CELL texts, and there are as many tables as lose at most
MISSED of the pairs at the least similarity. Inside a group the rows are in Gray order under a GrayIndex, whose nodes
share masked bit patterns and drop whole groups by accumulated differences.

Check. Candidates are compared by their exact sets, an ordinary join. The first rounds compare each row with the nearest
one of each table only, or, in groups of equal masked bits that are large, with the one in the middle of its surroundings:
copies that were edited apart are nearer to what they were copied from than to each other, so a large group is united by
a few comparisons a row. The last round by tables compares, in each table, all rows within the radius
that are still in different components: those outside a group's largest component against all of it, so that a large
component isn't compared with itself; a pair that meets in several tables comes out of the first of them only. Left out
are pairs whose component is known already or that can't be similar enough: by their numbers
of shingles, or by what is known of both and a third text that both were compared with (how many shingles each has beside
it and lacks of it, and marks of the former). So copies that were edited apart are not compared with each other.

The rest, exactly. Tables and radius lose a few pairs, so a round by prefixes follows that loses none: in any one order of
all shingles, two sets of the least similarity share one among the first n - ceil(least * n) + 1 of each. The order has
shingles that are frequent in a sample last, and first those that texts of one component only have, which is counted exactly
of the LOW part of all hashes (any order gives the same links; this one makes few pairs). No pair comes of these, so they are
left out of the prefixes: a text with enough of its own has no rows, however many passages it shares. Rows that share a
shingle there and are in different components are a pair if their sizes, the places of that shingle and the parities of how
many members each of 1,024 bins has allow it: sets that differ in d members differ in d parities at most. All this goes with
each row, so that texts that share a passage, or are somewhat similar, are told apart where they meet.

Defined results: words are as in simhash.fingerprint; a text of fewer than five words is one shingle; null and empty
texts, and those of white space only, are alike; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import map_batches, scratch, written
from cairnflow.llm.components import components
from cairnflow.llm.filters import MOST_BYTES, Filter, key_filter
from cairnflow.llm.simhash import _LOWER, SEED, GrayIndex, gray_rank

WORDS = 5
SIMILARITY = 0.8
PARTS, LOOKED_AT = 16, 3
"""Words of 64 bits of a fingerprint, and how many of them the tables mask and the index compares."""
MISSED = 0.003
CELL = 256
ROWS_AT_ONCE = 1 << 14
PAIRS_AT_ONCE = 1 << 16
"""Rows and pairs that a task has in arrays: a pair takes up to 500 bytes there, a row as many."""
ROUNDS = 2
DENSE = 512
"""Rows of a key among which every row may be compared with every other to find the nearest."""
SAMPLE, SAMPLED_SHARE, OFTEN, MOST_FREQUENT = 20_000, 1 / 64, 4, 1 << 18
"""Texts, or the share of all if that is more, whose shingles are counted to order prefixes; the least count of a frequent
shingle, and how many of them are sent to all tasks."""
LOW = 0.3
"""Part of the shingles, by their hashes, of which is counted whether more than one component has them."""
BINS = 1024
HASHES_AT_ONCE = 1 << 12

_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 1 << 63, PARTS, np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Plan:
    radius: int
    """Of the words that the index compares."""
    whole: int
    """Of all words."""
    bits: int
    tables: int
    least: float

    @classmethod
    def of(cls, texts: int, least: float = SIMILARITY) -> Plan:
        differ = math.acos(min(1.0, 2 * least / (1 + least))) / math.pi
        within = lambda n: math.ceil(n * differ + NormalDist().inv_cdf(1 - MISSED / 10) * math.sqrt(n * differ * (1 - differ)))
        bits = max(0, math.ceil(math.log2(max(1, texts) / CELL)))
        same = (1 - differ) ** bits
        tables = 1 if same >= 1 else max(1, math.ceil(math.log(MISSED) / math.log(1 - same)))
        return cls(within(64 * LOOKED_AT), within(64 * PARTS), bits, tables, least)

    def masks(self) -> np.ndarray:
        """The places of the masked bits of each table; all places are used before one is used again."""
        rng, need = np.random.default_rng(SEED + 1), self.bits * self.tables
        of = 64 * LOOKED_AT
        places = np.concatenate([rng.permutation(of) for _ in range(-(-need // of))] or [np.zeros(0, np.int64)])
        return places[:need].reshape(self.tables, self.bits)

    def met_before(self, table: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """Whether pairs of rows, found in a table and differing in these bits, have met in an earlier table."""
        met = np.zeros(len(table), bool)
        for t, places in enumerate(self.masks()):
            mask = np.zeros(64 * LOOKED_AT, np.uint8)
            mask[places] = 1
            mask = np.packbits(mask, bitorder="little").view(np.uint64)
            met |= (t < table) & ~(differ & mask).any(1)
        return met


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """The distinct hashes of the shingles, sorted."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    parts = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(words) - size + 1))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """PARTS words of 64 bits: a bit is 1 if over half of the shingles have it; all zero without shingles."""
    counts = np.zeros(64 * PARTS, np.int64)
    for at in range(0, len(found), HASHES_AT_ONCE):
        h = found[at : at + HASHES_AT_ONCE, None] * _TIMES
        h ^= h >> np.uint64(32)
        h *= _TIMES
        counts += np.unpackbits((h ^ (h >> np.uint64(29))).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(found), bitorder="little").view(np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def text_digest(text: str = "text") -> Column:
    """Equal texts, and no others, are one node: SHA-256, as 64-bit hashes of different texts can be made to agree."""
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


_WORDS = [f"w{k}" for k in range(PARTS)]


def _fingerprints(texts: DataFrame) -> DataFrame:
    """digest, the number of its shingles and the words of its fingerprint, once for each text."""

    def run(batches):
        for b in batches:
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            f = np.array([fingerprint(x) for x in sets], np.uint64).reshape(-1, PARTS).view(np.int64)
            columns = [pa.array([len(x) for x in sets], pa.int64()), *(pa.array(f[:, k]) for k in range(PARTS))]
            yield pa.RecordBatch.from_arrays([b.column("digest"), *columns], ["digest", "size", *_WORDS])

    made = map_batches(texts, run, "digest binary, size bigint, " + ", ".join(f"{w} bigint" for w in _WORDS))
    return made.groupBy("digest").agg(*(F.min(c).alias(c) for c in ("size", *_WORDS)))  # equal texts have equal words


def _placed(marked: DataFrame, plan: Plan) -> DataFrame:
    """A row for each fingerprint and table, by the table's masked bits and then in Gray order."""
    masks, kept = plan.masks(), marked.columns

    def run(batches):
        for b in batches:
            words = np.stack([b.column(w).to_numpy() for w in _WORDS[:LOOKED_AT]], 1).view(np.uint8)
            bits = np.unpackbits(words, axis=1, bitorder="little")
            for t, mask in enumerate(masks):
                key = bits[:, mask] @ (1 << np.arange(plan.bits, dtype=np.int64)) | np.int64(t << 40)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(b.column(c) for c in kept)], ["key", *kept])

    rows = map_batches(marked, run, "key bigint, " + ", ".join(f"{c} bigint" for c in kept), 4096)
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", gray_rank(F.col("w0")))


def _groups(batches):
    """Arrays of whole keys, of about ROWS_AT_ONCE rows: key, other columns by name."""
    held: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    rows, least = 0, ROWS_AT_ONCE
    for b in batches:
        if not b.num_rows:
            continue
        held.append({c: b.column(c).to_numpy() for c in b.schema.names})
        rows += b.num_rows
        if rows >= least:
            all_ = joined()
            cut = int(np.searchsorted(all_["key"], all_["key"][-1]))  # the last key may go on
            if cut:
                yield {c: v[:cut] for c, v in all_.items()}
            held = [{c: v[cut:] for c, v in all_.items()}]
            rows -= cut
            least = max(ROWS_AT_ONCE, 2 * rows)
    if rows:
        yield joined()


def _words(g: dict[str, np.ndarray], names: list[str]) -> np.ndarray:
    return np.stack([g[w] for w in names], 1).view(np.uint64)


def _leaders(words: np.ndarray, rows: np.ndarray, radius: int) -> tuple[list[tuple[np.ndarray, int]], list[np.ndarray]]:
    """Of many rows of one key, by few comparisons each: (rows within the radius of a row in their middle, that row), and
    what is left in parts of at most DENSE rows. The middle is the row next to the majority of each bit. Rows that are
    further away are parted by the bit on which they agree least."""
    near, parts, waiting = [], [], [rows]
    while waiting:
        some = waiting.pop()
        if len(some) <= DENSE:
            parts.append(some)
            continue
        bits = np.unpackbits(words[some].view(np.uint8), axis=1, bitorder="little")
        share = bits.mean(0)
        middle = np.packbits(share > 0.5, bitorder="little").view(np.uint64)
        leader = int(some[np.bitwise_count(words[some] ^ middle).sum(1, dtype=np.int64).argmin()])
        close = np.bitwise_count(words[some] ^ words[leader]).sum(1, dtype=np.int64) <= radius
        near.append((some[close & (some != leader)], leader))
        far, bits = some[~close], bits[~close]
        if len(far):
            split = bits[:, np.abs(bits.mean(0) - 0.5).argmin()] == 1
            waiting += [p for p in (far[split], far[~split]) if len(p)]
    return near, parts


def _nearest(key: np.ndarray, words: np.ndarray, asks: np.ndarray, radius: int, fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each row that asks one near row of its key: of small keys the nearest one that fits, of larger ones
    the one in the middle of its surroundings, so that comparisons grow with the rows of a key and not with their square."""
    sizes = np.bincount(np.cumsum(np.r_[False, key[1:] != key[:-1]]))
    ends = np.cumsum(sizes)
    large = np.repeat(sizes > DENSE, sizes)
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    part = np.full(len(key), -1)
    part[~large] = np.repeat(np.arange(len(sizes)), sizes)[~large]
    asking = np.zeros(len(key), bool)
    asking[asks] = True
    number = len(sizes)
    for end, size in zip(ends[sizes > DENSE].tolist(), sizes[sizes > DENSE].tolist(), strict=True):
        rows = np.arange(end - size, end)
        others = rows[asking[rows]]
        if not len(others):
            continue
        at_rest = rows[~asking[rows]]
        near, parts = _leaders(words, others, radius)
        if len(at_rest):  # the largest component, by the row in its middle
            middle = np.packbits(np.unpackbits(words[at_rest].view(np.uint8), axis=1, bitorder="little").mean(0) > 0.5, bitorder="little").view(np.uint64)
            leader = int(at_rest[np.bitwise_count(words[at_rest] ^ middle).sum(1, dtype=np.int64).argmin()])
            near.append((others[np.bitwise_count(words[others] ^ words[leader]).sum(1, dtype=np.int64) <= radius], leader))
        for rows_near, leader in near:
            x.append(rows_near)
            y.append(np.full(len(rows_near), leader))
        for some in parts:
            part[some] = number
            number += 1
    taken = np.flatnonzero(part >= 0)
    taken = taken[np.argsort(part[taken], kind="stable")]  # in Gray order within a part
    index = GrayIndex(part[taken], words[taken])
    places = np.flatnonzero(asking[taken])
    total = np.cumsum(np.bincount(index.root)[index.root[places]]) if len(places) else np.zeros(0, np.int64)
    cuts = np.searchsorted(total, np.arange(PAIRS_AT_ONCE, int(total[-1]) + 1, PAIRS_AT_ONCE)) if len(places) else []
    for some in np.split(places, np.unique(cuts).astype(np.int64)):
        if not len(some):
            continue
        a, b, bits = index.pairs(some, radius, both=True)
        a, b = taken[a], taken[b]
        fit = fits(a, b)
        a, b, bits = a[fit], b[fit], bits[fit]
        by = np.lexsort((b, bits, a))
        by = by[np.r_[True, a[by][1:] != a[by][:-1]]] if len(by) else by
        x.append(a[by])
        y.append(b[by])
    return np.concatenate(x), np.concatenate(y)


def _apart(placed: DataFrame, plan: Plan, nearest: bool) -> DataFrame:
    """a, b: rows of a key within the radius that are in different components and of sizes that allow the least
    similarity, each pair once; nearest: of each row only the nearest one."""

    def run(batches):
        for g in _groups(batches):
            key, i = g["key"], g["id"]
            root = g.get("root", i)
            size = g["size"].astype(np.float64) if "size" in g else np.ones(len(i))
            # Of each key the largest component asks nothing: every pair has a row outside of it.
            order = np.lexsort((root, key))
            first = np.r_[True, (key[order][1:] != key[order][:-1]) | (root[order][1:] != root[order][:-1])]
            part = np.empty(len(key), np.int64)
            part[order] = np.cumsum(first) - 1
            of = key[order][first]
            top = np.lexsort((np.bincount(part), of))
            largest = np.zeros(len(of), bool)
            largest[top[np.r_[of[top][1:] != of[top][:-1], True]]] = True
            asks = np.flatnonzero(~largest[part])
            if not len(asks):
                continue
            words = _words(g, _WORDS[:LOOKED_AT])
            fits = lambda x, y: (root[x] != root[y]) & (np.minimum(size[x], size[y]) >= plan.least * np.maximum(size[x], size[y]) - 1e-9) & ~_too_far(g, x, y, plan.least)
            if nearest:
                x, y = _nearest(key, words, asks, plan.radius, fits)
                fit = fits(x, y)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i[x], i[y])[fit]), pa.array(np.maximum(i[x], i[y])[fit])], ["a", "b"])
                continue
            index = GrayIndex(key, words)
            rest = _words(g, _WORDS[LOOKED_AT:])
            total = np.cumsum(np.bincount(index.root)[index.root[asks]])
            cuts = np.searchsorted(total, np.arange(PAIRS_AT_ONCE, int(total[-1]) + 1, PAIRS_AT_ONCE))
            for some in np.split(asks, np.unique(cuts)):
                if not len(some):
                    continue
                x, y, bits = index.pairs(some, plan.radius, both=True)
                fit = fits(x, y)
                x, y, bits = x[fit], y[fit], bits[fit]
                near = bits + np.bitwise_count(rest[x] ^ rest[y]).sum(1, dtype=np.int64) <= plan.whole
                near &= (x < y) | largest[part[y]]  # if both ask, it comes twice
                x, y = x[near], y[near]
                new = ~plan.met_before(key[x] >> 40, words[x] ^ words[y])
                x, y = x[new], y[new]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i[x], i[y])), pa.array(np.maximum(i[x], i[y]))], ["a", "b"])

    pairs = map_batches(placed, run, "a bigint, b bigint", 4096)
    return pairs.distinct() if nearest else pairs


def _sets(texts: DataFrame, asked: object) -> DataFrame:
    """digest and found, its sorted shingles, of the texts that a broadcast filter of digests lets pass (None: of all)."""

    def run(batches):
        for b in batches:
            digests = b.column("digest").to_pylist()
            keys = np.array([int.from_bytes(d[:8], "big") for d in digests], np.uint64)
            wanted = np.flatnonzero(asked.value.has(keys)) if asked is not None else np.arange(len(keys))
            sets = [shingles(t).tobytes() for t in b.column("text").take(pa.array(wanted)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in wanted], pa.binary()), pa.array(sets, pa.binary())], ["digest", "found"])

    return map_batches(texts, run, "digest binary, found binary")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct()


def _within(pairs: DataFrame, marked: DataFrame, plan: Plan) -> DataFrame:
    """The pairs whose whole fingerprints are within the radius: most others need no sets."""
    sides = [marked.select(F.col("id").alias(c), *(F.col(w).alias(f"{c}_{w}") for w in _WORDS)) for c in "ab"]
    rows = pairs.join(sides[0], "a").join(sides[1], "b")
    apart = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in _WORDS[1:]), F.bit_count(F.col(f"a_{_WORDS[0]}").bitwiseXOR(F.col(f"b_{_WORDS[0]}"))))
    return rows.where(apart <= plan.whole).select("a", "b")


def _similar(pairs: DataFrame, texts: DataFrame, marked: DataFrame, least: float) -> DataFrame:
    """Pairs a, b with whether they are at least so similar. Texts in no pair are not made to sets, nor moved."""
    spark = texts.sparkSession
    folder = scratch(spark, "near_copy_sets")
    asked = _ids(pairs).join(marked.select("id", "digest"), "id")
    asked = written(asked, f"{folder}/asked")
    count = asked.count()
    passing = None
    if Filter.size(count) * 8 <= MOST_BYTES:
        first = F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long")
        passing = spark.sparkContext.broadcast(key_filter(asked.select(first.alias("key")), count))
    sets = _sets(texts, passing).dropDuplicates(["digest"]).join(asked, "digest").select("id", "found")
    sets = written(sets, f"{folder}/sets")
    x, y = (sets.select(F.col("id").alias(c), F.col("found").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    rows = pairs.join(x, "a").join(y, "b")

    def run(batches):
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            out = [_compared(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), least) for p, q in zip(x, y, strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], _TRIED)

    kinds = "a bigint, b bigint, same boolean, only_a bigint, only_b bigint, marks_a binary, marks_b binary"
    return map_batches(rows.select("a", "b", "x", "y"), run, kinds)


_TRIED = ["a", "b", "same", "only_a", "only_b", "marks_a", "marks_b"]
MARKS = 8
"""Words of the marks of a set: a bit for each member, by its hash."""


def _marks(found: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * MARKS, np.uint8)
    bits[((found * _TIMES[0]) >> np.uint64(32)) % np.uint64(64 * MARKS)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _compared(x: np.ndarray, y: np.ndarray, least: float) -> tuple[bool, int, int, bytes, bytes]:
    """Whether two sets are so similar, how many each has that the other hasn't, and the marks of these."""
    only_x, only_y = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
    both = len(x) - len(only_x)
    near = both / (both + len(only_x) + len(only_y)) if len(x) or len(y) else 1.0
    return near >= least, len(only_x), len(only_y), _marks(only_x).tobytes(), _marks(only_y).tobytes()


_ANCHOR = ["anchor", "more", "less", *(f"m{k}" for k in range(MARKS))]
"""The text that a row was compared with, how many shingles it has beside it and lacks of it, and the marks of the former."""


def _anchors(tried: DataFrame) -> DataFrame:
    """id and one text that it was compared with: the one that most rows were compared with, so that many have the same."""
    sides = [tried.select(F.col(a).alias("id"), F.col(b).alias("anchor"), F.col(f"only_{a}").alias("more"), F.col(f"only_{b}").alias("less"), F.col(f"marks_{a}").alias("marks")) for a, b in ("ab", "ba")]
    both = sides[0].unionByName(sides[1])
    often = both.groupBy("anchor").agg(F.count("*").alias("often"))
    best = F.max_by(F.struct("anchor", "more", "less", "marks"), F.struct("often", -F.col("more") - F.col("less"), "anchor"))
    chosen = both.join(often, "anchor").groupBy("id").agg(best.alias("c")).select("id", "c.*")
    digits = F.hex("marks")
    # little-endian words
    word = lambda k: F.conv(F.concat(*(F.substring(digits, 16 * k + 15 - 2 * j, 2) for j in range(8))), 16, -10).cast("long")
    return chosen.select("id", "anchor", "more", "less", *(word(k).alias(f"m{k}") for k in range(MARKS)))


def _too_far(g: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Pairs that can't be so similar, by what is known of both and one anchor: what they share is in the anchor too, so in
    neither of the parts that one lacks of it, or in both of the parts beside it, whose marks bound that."""
    if "anchor" not in g:
        return np.zeros(len(x), bool)
    marks = np.stack([g[f"m{k}"] for k in range(MARKS)], 1).view(np.uint64)
    ones = np.bitwise_count(marks).sum(1, dtype=np.int64)
    size, more, less = g["size"], g["more"], g["less"]
    hidden = more - ones  # members that share a mark
    beside = np.bitwise_count(marks[x] & marks[y]).sum(1, dtype=np.int64) + np.minimum(hidden[x], hidden[y])
    beside = np.minimum(beside, np.minimum(more[x], more[y]))
    inside = size[x] - more[x] + less[x] - np.maximum(less[x], less[y])
    shared = np.minimum(np.minimum(size[x] - more[x], size[y] - more[y]), inside) + beside
    return (g["anchor"][x] == g["anchor"][y]) & (shared < least * (size[x] + size[y] - shared) - 1e-9)


def _frequent(texts: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of the texts, sorted, and the logarithms of how often. They order prefixes and
    decide nothing else."""
    top = int(max(SAMPLE / max(count, 1), SAMPLED_SHARE) * 2**32)

    def run(batches):
        for b in batches:
            taken = [i for i, d in enumerate(b.column("digest").to_pylist()) if int.from_bytes(d[8:12], "big") < top]
            found = [shingles(t) for t in b.column("text").take(pa.array(taken, pa.int64())).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["shingle"])

    counts = map_batches(texts, run, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    got = counts.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toArrow()
    found, often = got.column("shingle").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(found)
    return found[order], np.log2(often[order]).astype(np.int64)


_LOWEST = np.uint64(int(LOW * 2**64))


def _shared(texts: DataFrame, links: DataFrame | None, folder: str) -> Filter:
    """A filter of the shingles below LOW that texts of several components (digest, root; others are alone) have."""

    def run(batches):
        for b in batches:
            low = [x[: np.searchsorted(x, _LOWEST)].view(np.int64) for x in map(shingles, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(low, pa.list_(pa.int64()))], ["digest", "low"])

    rows = map_batches(texts, run, "digest binary, low array<bigint>")
    own = F.xxhash64(F.lit(uuid.uuid4().hex), "digest")  # of no text that was made to have another one's
    if links is None:
        rows = rows.withColumn("of", own)
    else:
        rows = rows.join(links, "digest", "left").withColumn("of", F.coalesce("root", own))
    kept = rows.select(F.explode("low").alias("key"), "of").groupBy("key").agg(F.min("of").alias("first"), F.max("of").alias("last")).where("first <> last")
    kept = written(kept.select("key"), f"{folder}/shared")
    return key_filter(kept, kept.count(), MOST_BYTES // 8)


def _first(size: np.ndarray | int, least: float) -> np.ndarray | int:
    """How many first members of a set are its prefix."""
    return size - np.ceil(least * size - 1e-9).astype(np.int64) + 1


def _prefix(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], least: float, shared: Filter | None = None) -> np.ndarray:
    """The first members of a set, of which any set of the least similarity has one among its own first. An empty set has 0,
    as it is similar to empty ones only. Left out is what comes first of all, what no other component has (see _shared)."""
    if not len(found):
        return np.zeros(1, np.uint64)
    n = int(_first(len(found), least))
    if shared is not None:
        low = int(np.searchsorted(found, _LOWEST))
        met = shared.has(found[:low])
        n -= low - int(met.sum())
        if n <= 0:
            return np.zeros(0, np.uint64)
        found = np.concatenate([found[:low][met], found[low:]])
    keys, often = frequent
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1) if len(keys) else None
    if at is not None and (known := keys[at] == found).any():
        found = found[np.argsort(np.where(known, often[at], -1), kind="stable")]
    return found[:n]


def _parities(found: np.ndarray) -> bytes:
    """Of each bin whether it has an odd number of members."""
    bins = ((found * _TIMES[1]) >> np.uint64(32)) % np.uint64(BINS)
    return np.packbits(np.bincount(bins.astype(np.int64), minlength=BINS) & 1).tobytes()


def _prefixes(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], shared: Filter, least: float) -> DataFrame:
    """digest, size, prefix and parities, once for each text of which anything is left in its prefix."""
    sent = texts.sparkSession.sparkContext.broadcast((frequent, shared))

    def run(batches):
        for b in batches:
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            prefixes = [_prefix(x, sent.value[0], least, sent.value[1]) for x in sets]
            some = [i for i, p in enumerate(prefixes) if len(p)]
            sets, prefixes = [sets[i] for i in some], [prefixes[i] for i in some]
            columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array([p.tobytes() for p in prefixes], pa.binary()), pa.array(map(_parities, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("digest").take(pa.array(some, pa.int64())), *columns], ["digest", "size", "prefix", "parities"])

    return map_batches(texts, run, "digest binary, size bigint, prefix binary, parities binary").dropDuplicates(["digest"])


def _ranges(start: np.ndarray, end: np.ndarray):
    """Index of the range and the place, for all places of all ranges, in parts of about PAIRS_AT_ONCE."""
    size = np.maximum(end - start, 0)
    total = np.cumsum(size)
    cuts = np.searchsorted(total, np.arange(PAIRS_AT_ONCE, int(total[-1]) + 1, PAIRS_AT_ONCE)) if len(total) else []
    for some in np.split(np.arange(len(size)), np.unique(cuts).astype(np.int64)):
        n = size[some]
        if n.sum():
            of = np.repeat(some, n)
            yield of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[of]


def _sharing(size: np.ndarray, place: np.ndarray, root: np.ndarray, least: float):
    """Pairs of rows of one shingle, in parts, that are in different components and may be similar enough if it is the first one
    they share: what the larger one has from its place on bounds the size of the smaller one."""
    n, part = np.unique(root, return_inverse=True)
    if len(n) < 2:
        return
    largest = part == np.bincount(part).argmax()
    rest = size - place
    low = np.ceil(least * size - 1e-9)
    high = np.minimum(size, np.floor(rest * (1 + least) / least - size + 1e-9))
    sides = [np.flatnonzero(~largest), np.flatnonzero(largest)]
    sides = [x[np.argsort(size[x], kind="stable")] for x in sides]
    for i, j in ((0, 0), (0, 1), (1, 0)):  # the largest component isn't compared with itself
        x, y = sides[i], sides[j]
        for a, b in _ranges(np.searchsorted(size[y], low[x], "left"), np.searchsorted(size[y], high[x], "right")):
            a, b = x[a], y[b]
            fit = (root[a] != root[b]) & (np.minimum(rest[a], rest[b]) >= least / (1 + least) * (size[a] + size[b]) - 1e-9)
            yield a[fit], b[fit]


def _meeting(rows: DataFrame, least: float) -> DataFrame:
    """a, b: rows (id, root, size, prefix) that share a shingle of their prefixes, see _sharing, and whose parities, if they
    have them, allow the least similarity."""
    odd = [f"odd{k}" for k in range(BINS // 64)] if "parities" in rows.columns else []

    names = ["key", "place", "id", "root", "size", *odd]

    def dealt(batches):
        for b in batches:
            found = [np.frombuffer(p, np.int64) for p in b.column("prefix").to_pylist()]
            n = [len(f) for f in found]
            left_out = _first(b.column("size").to_numpy(), least) - n
            place = np.concatenate([np.zeros(0, np.int64), *map(np.arange, left_out, left_out + n)])
            columns = [np.repeat(b.column(c).to_numpy(), n) for c in ("id", "root", "size")]
            if odd:
                parities = np.frombuffer(b"".join(b.column("parities").to_pylist()), np.int64).reshape(-1, len(odd))
                columns += [np.repeat(p, n) for p in parities.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(place), *map(pa.array, columns)], names)

    def run(batches):
        for g in _groups(batches):
            starts = np.flatnonzero(np.r_[True, g["key"][1:] != g["key"][:-1]])
            ends = np.r_[starts[1:], len(g["key"])]
            held, waiting = [], 0
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                i, size = g["id"][s:e], g["size"][s:e]
                parities = _words({c: g[c][s:e] for c in odd}, odd) if odd else None
                for x, y in _sharing(size.astype(np.float64), g["place"][s:e], g["root"][s:e], least):
                    if odd:
                        near = np.bitwise_count(parities[x] ^ parities[y]).sum(1, dtype=np.int64) <= (1 - least) / (1 + least) * (size[x] + size[y]) + 1e-9
                        x, y = x[near], y[near]
                    held.append(np.stack([np.minimum(i[x], i[y]), np.maximum(i[x], i[y])], 1))
                    waiting += len(x)
                    if waiting >= PAIRS_AT_ONCE:
                        yield _pairs(held)
                        held, waiting = [], 0
            yield _pairs(held)

    dealt_rows = map_batches(rows, dealt, ", ".join(f"{c} bigint" for c in names))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(dealt_rows.repartition(parts, "key").sortWithinPartitions("key"), run, "a bigint, b bigint", 4096).distinct()


def _pairs(held: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *held]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _by_prefixes(texts: DataFrame, marked: DataFrame, tried: DataFrame | None, count: int, least: float, folder: str) -> DataFrame:
    """a, b: all pairs that are similar enough, are in different components and haven't been compared, and few others."""
    links, known = None, None
    if tried is not None:
        links = written(components(tried.where("same")), f"{folder}/known-last").withColumnRenamed("node", "id")
        members = links.union(links.select(F.col("root").alias("id"), "root").distinct())
        known = written(marked.select("id", "digest").join(members, "id").select("digest", "root"), f"{folder}/known-texts")
    made = _prefixes(texts, _frequent(texts, count), _shared(texts, known, folder), least).join(marked.select("digest", "id"), "digest")
    if links is None:
        made = made.withColumn("root", F.col("id"))
    else:
        made = made.join(links, "id", "left").withColumn("root", F.coalesce("root", "id"))
    made = written(made.drop("digest"), f"{folder}/prefixes")
    pairs = _meeting(made, least)
    return pairs if tried is None else pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")


def roots(docs: DataFrame, text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """digest (see text_digest) and group: for every text that is similar to another one, directly or by way of others, the
    same number for all texts of its component. Texts on their own have no row."""
    folder = scratch(docs.sparkSession, "near_copies")
    texts = docs.select(text_digest(text).alias("digest"), F.col(text).cast("string").alias("text"))
    marked = written(_fingerprints(texts).withColumn("id", F.monotonically_increasing_id()), f"{folder}/fingerprints")
    count = marked.count()
    plan = Plan.of(count, least)
    tried = None
    for n in range(ROUNDS + 1):
        if tried is not None:
            # What has no neighbour within the radius in any table had none to be compared with, and has none now.
            met = _ids(tried)
            links = written(components(tried.where("same")), f"{folder}/known-{n}").withColumnRenamed("node", "id")
            known = met.join(links, "id", "left").withColumn("root", F.coalesce("root", "id")).join(_anchors(tried), "id")
            rows = marked.select("id", "size", *_WORDS[: LOOKED_AT if n < ROUNDS else PARTS]).join(known, "id")
        else:
            rows = marked.select("id", *_WORDS[:LOOKED_AT])  # every row is written to every table: no more than it takes
        pairs = _apart(_placed(rows, plan), plan, nearest=n < ROUNDS)
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = written(pairs, f"{folder}/pairs-{n}")
        if n < ROUNDS:
            pairs = written(_within(pairs, marked, plan), f"{folder}/within-{n}")
        new = written(_similar(pairs, texts, marked, least), f"{folder}/tried-{n}")
        if new.isEmpty():
            break
        tried = new if tried is None else tried.union(new)
    pairs = written(_by_prefixes(texts, marked, tried, count, least, folder), f"{folder}/pairs-last")
    new = written(_similar(pairs, texts, marked, least), f"{folder}/tried-last")
    links = (new if tried is None else tried.union(new)).where("same").select("a", "b")
    hung = components(links)
    members = hung.select(F.col("node").alias("id"), "root").union(hung.select(F.col("root").alias("id"), "root").distinct())
    return marked.select("id", "digest").join(members, "id").select("digest", F.col("root").alias("group"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """key, component_id: the smallest key among all documents that links connect."""
    linked = roots(docs, text, least)
    marked = docs.select(F.col(key), text_digest(text).alias("digest")).join(linked, "digest", "left")
    marked = marked.select(key, F.coalesce(F.col("group").cast("string").cast("binary"), "digest").alias("group"))
    return marked.join(marked.groupBy("group").agg(F.min(key).alias("component_id")), "group").select(key, "component_id")


def decided(docs: DataFrame, said: DataFrame, key: str = "doc_id", text: str = "text", filter_bytes: int = MOST_BYTES) -> DataFrame:
    """docs without the rows that have to go, and with one of those that are alike.

    said: _id, _digest (see text_digest), stays and n, the number of rows, of what goes or comes in several rows; others need
    not be named. A filter of these digests, sent to all tasks where its size allows, leaves all other rows where they are."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*docs.columns).alias("doc"), text_digest(text).alias("digest"))
    count = said.count()
    apart = None
    if Filter.size(count) * 8 <= filter_bytes:
        first = F.conv(F.substring(F.hex("_digest"), 1, 16), 16, -10).cast("long")
        known = spark.sparkContext.broadcast(key_filter(said.select(first.alias("key")), count))

        def chosen(passing):
            def choose(batches):
                for b in batches:
                    keys = np.array([int.from_bytes(d[:8], "big") for d in b.column("digest").to_pylist()], np.uint64)
                    yield b.filter(pa.array(known.value.has(keys) == passing))

            return map_batches(rows, choose, rows.schema, 64)

        apart, rows = chosen(False), chosen(True)
    same = F.col(f"doc.{key}").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    rows = rows.join(said, same, "left").where("stays IS NULL OR stays")
    repeated = rows.where("n > 1").groupBy("_id", "_digest").agg(F.first("doc").alias("doc"))
    out = rows.where("n IS NULL OR n = 1").select("doc.*").unionByName(repeated.select("doc.*"))
    return out if apart is None else apart.select("doc.*").unionByName(out)
