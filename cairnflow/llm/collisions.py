"""Embedding near-duplicates by collision-counting projections.

Every vector is laid on PROJECTIONS random lines. Each line's values are sorted, and around every query a window of fixed
half-width is cut out; a pair collides on a line if one lies in the other's window. Two unit vectors of cosine c are
sqrt(2 - 2c) apart, and their difference on a Gaussian line is normal with that deviation, so the chance p of a
collision at the least cosine is known, the number of collisions of such a pair is binomial, and the count that a pair
must reach is the largest that MISSED of the pairs at the least cosine miss at most. Pairs that reach it are verified in
double precision.

Windows on one line hold a fixed share of all vectors, so lines are sorted within cells: a cell is a label and the signs
of `bits` further projections, as many as bring a label's vectors to about CELL a cell. `tables` independent sets of
cells, as many as lose at most MISSED of the pairs at the least cosine, are searched, and a pair counts in the first
table where its vectors share a cell. Cells that are larger all the same are cut in parts, and every two parts meet in a
block of bounded size.

Copies of a vector are one vector here and are counted by their number.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those without a label,
have no links and are their own component; vectors of different lengths never link; rows that repeat a key are separate
vectors; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import map_batches, scratch, written
from cairnflow.llm.components import Forest, components

LEAST_COSINE = 0.98
PROJECTIONS = 24
COLLISION_CHANCE = 0.9
MISSED = 1e-4
CELL = 2_048
QUERIES = 256
SEED = 11


@dataclass(frozen=True)
class Plan:
    cosine: float
    half_width: float
    count: int
    bits: int
    tables: int
    projections: int = PROJECTIONS

    @classmethod
    def of(cls, largest: int, cosine: float = LEAST_COSINE, projections: int = PROJECTIONS) -> Plan:
        """largest: the number of vectors of the largest label."""
        apart = math.sqrt(max(0.0, 2 - 2 * cosine))
        half_width = apart * _quantile((1 + COLLISION_CHANCE) / 2)
        count, tail = projections, 0.0
        while count > 1:  # the largest count that enough pairs reach
            tail = sum(
                math.comb(projections, k) * COLLISION_CHANCE**k * (1 - COLLISION_CHANCE) ** (projections - k) for k in range(count)
            )
            if tail <= MISSED:
                break
            count -= 1
        same = 1 - math.acos(min(1.0, cosine)) / math.pi
        bits = max(0, math.ceil(math.log2(max(1, largest) / CELL)))
        tables = 1 if not bits or same >= 1 else max(1, math.ceil(math.log(MISSED) / math.log(1 - same**bits)))
        return cls(cosine, half_width, count, bits, tables, projections)


def _quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def lines(dims: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, n))


def cell_codes(x: np.ndarray, plan: Plan) -> np.ndarray:
    """The cell of each unit vector in each table: (vectors, tables)."""
    signs = x @ lines(x.shape[1], max(1, plan.bits) * plan.tables, SEED) > 0
    signs = signs.reshape(len(x), plan.tables, -1)[:, :, : plan.bits]
    return signs @ (1 << np.arange(plan.bits, dtype=np.int64))


class Cell:
    """The vectors of one cell, in sorted order on every line."""

    def __init__(self, x: np.ndarray, plan: Plan):
        self.x, self.plan = x, plan
        self.values = x @ lines(x.shape[1], plan.projections, SEED + 1)
        order = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, order, 0)
        self.place = np.empty((plan.projections, len(x)), np.uint16 if len(x) < 1 << 16 else np.uint32)
        for k in range(plan.projections):
            self.place[k, order[:, k]] = np.arange(len(x))

    def collisions(self, queries: np.ndarray) -> np.ndarray:
        """Lines on which each vector lies in each query's window: (queries, vectors).

        A window is a range of places in the sorted order; a place lies in it if its distance from the range's start, as
        an unsigned number, is below the range's size."""
        out = np.zeros((len(queries), len(self.x)), np.uint8)
        for k in range(self.plan.projections):
            v, place = self.values[queries, k], self.place[k]
            low = np.searchsorted(self.sorted[:, k], v - self.plan.half_width, "left").astype(place.dtype)
            high = np.searchsorted(self.sorted[:, k], v + self.plan.half_width, "right").astype(place.dtype)
            out += (place[None] - low[:, None]) < (high - low)[:, None]
        return out

    def links(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) of cosine at least the plan's, other than the query itself."""
        q, v = np.nonzero(self.collisions(queries) >= self.plan.count)
        q = queries[q]
        other = q != v
        q, v = q[other], v[other]
        near = np.einsum("ij,ij->i", self.x[q], self.x[v]) >= self.plan.cosine
        return q[near], v[near]


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, initial=0.0)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = LEAST_COSINE
) -> DataFrame:
    """key, n_links (other vectors linked directly), component_id (smallest key reachable), kept (it is its own)."""
    spark = vectors.sparkSession
    folder = scratch(spark, "collisions")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(
        F.col(key).alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label")
    )
    endless = F.lit(math.inf)
    sound = F.col("label").isNotNull() & F.coalesce(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < endless)) & F.exists("v", lambda c: c != 0), F.lit(False)
    )
    rows = rows.withColumn("sound", sound)
    # Copies become one vector, whose node is their smallest key.
    distinct = rows.where("sound").groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    distinct = written(distinct, f"{folder}/distinct")
    largest = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    plan = Plan.of(largest, cosine)

    def place(batches):
        for b in batches:
            v = b.column("v").to_pylist()
            sizes = np.array([len(x) for x in v])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                raw = np.array([v[i] for i in at], np.float64)
                codes = cell_codes(_units(raw), plan)
                packed = [y.tobytes() for y in raw.astype(carried)]
                some = b.take(pa.array(at))
                for t in range(plan.tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.column("first"), some.column("copies"),
                            pa.array([f"{d}|{t}|{c}|{g}" for c, g in zip(codes[:, t].tolist(), some.column("label").to_pylist(), strict=True)]),
                            pa.array(packed, pa.binary()),
                        ],
                        ["first", "copies", "cell", "x"],
                    )

    carried = np.float32 if vectors.schema[embedding].dataType.simpleString() == "array<float>" else np.float64  # without loss
    kind = vectors.schema[key].dataType.simpleString()
    # Not written: cells are counted from one reading and dealt from another, which costs less than their disk.
    placed = map_batches(distinct, place, f"first {kind}, copies bigint, cell string, x binary")
    # Large cells are dealt out in parts of about CELL vectors; every two parts meet in one block, and so does each part
    # with itself, so a block holds two parts at most.
    large = placed.groupBy("cell").count().where(F.col("count") > CELL).select("cell", F.ceil(F.col("count") / CELL).alias("parts"))
    large = written(large, f"{folder}/large")
    placed = placed.withColumn("mix", F.xxhash64("first", "x"))
    dealt = placed.join(large, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("bigint"))
    dealt = dealt.withColumn("part", F.pmod("mix", "parts"))
    meets = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1),
        lambda k: F.struct(F.least(k, "part").alias("low"), F.greatest(k, "part").alias("high")),
    )
    dealt = dealt.withColumn("block", F.explode(meets)).select("first", "copies", "cell", "x", "mix", "part", "block.low", "block.high")
    cells = dealt.repartition(parts, "cell", "low", "high").sortWithinPartitions("cell", "low", "high", "mix").drop("mix")

    def search(batches):
        held: list[dict] = []

        def found():
            x = _units(np.stack([np.frombuffer(r["x"], carried) for r in held]))
            codes = cell_codes(x, plan)
            table = int(held[0]["cell"].split("|")[1])
            copies = np.array([r["copies"] for r in held])
            part, low, high = np.array([r["part"] for r in held]), held[0]["low"], held[0]["high"]
            cell, forest, links = Cell(x, plan), Forest(len(held)), np.zeros(len(held), np.int64)
            asks = np.flatnonzero(part == low)
            for at in range(0, len(asks), QUERIES):
                q, v = cell.links(asks[at : at + QUERIES])
                kept = part[v] == high
                if table:
                    kept &= (codes[q, :table] != codes[v, :table]).all(1)
                q, v = q[kept], v[kept]
                np.add.at(links, q, copies[v])
                if low < high:
                    np.add.at(links, v, copies[q])
                forest.unite(q, v)
            root = forest.roots()
            out = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([held[i]["first"] for i in out], first_kind),
                    pa.array(links[out]),
                    pa.array([held[root[i]]["first"] for i in out], first_kind),
                ],
                ["first", "links", "root"],
            )

        first_kind = None
        for b in batches:
            first_kind = b.schema.field("first").type
            for r in b.to_pylist():
                if held and any(r[k] != held[0][k] for k in ("cell", "low", "high")):
                    if len(held) > 1:
                        yield found()
                    held = []
                held.append(r)
        if len(held) > 1:
            yield found()

    links = written(map_batches(cells, search, f"first {kind}, links bigint, root {kind}"), f"{folder}/links")
    counted = links.groupBy("first").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("first").alias("a"), F.col("root").alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
    roots = roots.withColumnRenamed("node", "first")
    classes = distinct.join(counted, "first", "left").join(roots, "first", "left").select(
        "label", "v",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "first").alias("component_id"),
    )
    linked = rows.where("sound").join(classes, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
