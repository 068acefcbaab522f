"""Whitening of embeddings by their principal components, from exact whole-number moments.

Components of vectors become whole numbers x = floor(64 c) + 1000000. Counts, sums and products of the distinct vectors are
exact, whatever the order in which tasks add them up; only these, as many as a vector has pairs of components, reach the
driver. The components are those of charpoly.py.

Left out are vectors that are null, hold null or non-finite components or ones whose x is no long, and vectors of another
length than most have (of equally frequent lengths the smallest counts). With one distinct vector, or none, there is no
variance and no component, so no row comes out; in general as many components come out as the variance has dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm import charpoly
from cairnflow.llm.common import map_batches, scratch, written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
LIMB = 22
"""Bits of the parts that products are taken of: 512 products of two parts add up exactly in a double."""
BLOCK = 512
_LARGEST = float(1 << 62)


@dataclass
class Whitening:
    n: int
    sums: list[int]
    """Of x, by dimension."""
    vectors: np.ndarray
    """A row for each component."""
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def size(self) -> int:
        return len(self.sums)


def integers(df: DataFrame, vector: str = "embedding", *more: str) -> DataFrame:
    """v, the vector as x - 1000000, and more columns, of the rows that can be used, whatever their length."""
    doubles = F.transform(F.col(vector), lambda c: c.cast("double") * SCALE)
    sound = F.forall(doubles, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _LARGEST))
    rows = df.where(F.col(vector).isNotNull()).select(*more, doubles.alias("v")).where(sound.eqNullSafe(F.lit(True)) & (F.size("v") > 0))
    return rows.withColumn("v", F.transform("v", lambda c: F.floor(c).cast("long")))


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Of each distinct vector once; None if there is no variance."""
    spark = df.sparkSession
    rows = integers(df, vector)
    usual = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return None
    size = usual["size"]
    distinct = written(rows.where(F.size("v") == size).distinct(), scratch(spark, "distinct_vectors"))
    moments = _moments(distinct, size)
    n, sums = int(moments[size, size]), [int(s) for s in moments[size, :size]]
    scatter = n * moments[:size, :size] - np.array(sums, object)[:, None] * np.array(sums, object)
    trace = int(np.trace(scatter))
    if not trace:
        return None
    common = math.gcd(*(int(v) for v in scatter.ravel()))
    scatter, trace = scatter // common, trace // common
    roots = charpoly.Roots(polynomial(spark, scatter, trace), trace, components)
    vectors, wanted = [], []
    for root, many, found in _null_spaces(spark, scatter, roots):
        vectors += list(found)
        wanted += [root] * many
    vectors, wanted = vectors[:components], wanted[:components]
    unit = trace << roots.shift
    explained = np.array([r / unit for r in wanted])
    variances = np.array([r * common / ((n * n) << roots.shift) for r in wanted])
    model = Whitening(n, [s + n * OFFSET for s in sums], np.array(vectors), variances, explained)
    model.identity_error = _identity_error(distinct, model)
    return model


def transform(df: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: key, component (from 1), n, deviation, whitened and explained.

    deviation, the sum of (n x - S)^2, is null where it is no long."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    rows = integers(df, vector, key).select(F.col(key).alias("key"), "v").where(F.size("v") == model.size)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        for batch in batches:
            m = batch.num_rows
            away, deviation, white = _projected(_matrix(batch.column("v"), model.size), model)
            index = np.repeat(np.arange(m), k)
            deviations = pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64())
            columns = [
                batch.column("key").take(pa.array(index)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                deviations.take(pa.array(index)), pa.array(white.ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_batches(rows, whiten, schema, rows=2048).withColumnRenamed("key", key)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _projected(v: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int], np.ndarray]:
    """n x - S exactly, its squared length, and the whitened components."""
    sums = [s - model.n * OFFSET for s in model.sums]
    most = max((abs(int(v.max())), abs(int(v.min()))), default=0) if v.size else 0
    if model.n * most + max(map(abs, sums)) < 1 << 28 and model.size < 1 << 7:
        away = model.n * v - np.array(sums)
        deviation = (away * away).sum(1).tolist()
    else:
        away = model.n * v.astype(object) - np.array(sums, object)
        deviation = [int(d) for d in (away * away).sum(1)]
    # each whole number over n, correctly rounded where it is large
    share = away / model.n
    return away, deviation, share.astype(float) @ model.vectors.T / np.sqrt(model.variances)


def _limbs(v: np.ndarray) -> list[np.ndarray]:
    """Parts of LIMB bits as doubles, the lowest first; the last one has the sign."""
    out, rest = [], v
    while not ((rest >= -(1 << (LIMB - 1))) & (rest < 1 << (LIMB - 1))).all():
        out.append((rest & ((1 << LIMB) - 1)).astype(float))
        rest = rest >> LIMB
    return [*out, rest.astype(float)]


def _moments(distinct: DataFrame, size: int) -> np.ndarray:
    """Exact sums of products of all pairs of components, a constant 1 being the last: with it come the sums and the count."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1), object)
        part: dict[int, np.ndarray] = {}
        for number, batch in enumerate(batches, 1):
            v = _matrix(batch.column("v"), size)
            limbs = _limbs(np.hstack([v, np.ones((len(v), 1), np.int64)]))
            for a, left in enumerate(limbs):
                for b, right in enumerate(limbs):
                    part[a + b] = part.get(a + b, 0) + (left.T @ right).astype(np.int64)
            if number % 128 == 0:
                total, part = total + _shifted(part), {}
        total = total + _shifted(part)
        i, j = np.triu_indices(size + 1)
        values = [int(x) for x in total[i, j]]
        low = (1 << 48) - 1
        limbs = [[x >> 96 for x in values], [x >> 48 & low for x in values], [x & low for x in values]]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *(pa.array(x, pa.int64()) for x in limbs)], ["i", "j", "high", "middle", "low"])

    sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "middle", "low")]
    schema = "i bigint, j bigint, high bigint, middle bigint, low bigint"
    rows = map_batches(distinct, add_up, schema, rows=BLOCK).groupBy("i", "j").agg(*sums).collect()
    out = np.zeros((size + 1, size + 1), object)
    for r in rows:
        out[r.i, r.j] = out[r.j, r.i] = (int(r.high) << 96) + (int(r.middle) << 48) + int(r.low)
    return out


def _shifted(part: dict[int, np.ndarray]) -> np.ndarray | int:
    return sum((x.astype(object) << (LIMB * k) for k, x in part.items()), 0)


def polynomial(spark: SparkSession, matrix: np.ndarray, trace: int) -> list[int]:
    """The characteristic polynomial, lowest coefficient first; primes are shared out to tasks."""
    moduli = charpoly.enough_primes(trace, len(matrix))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_pylist()
            found = [charpoly.polynomial_mod(matrix, moduli[i]) for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["id", "residues"])

    tasks = min(len(moduli), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(moduli), 1, tasks).mapInArrow(reduce, "id bigint, residues array<bigint>").collect()
    residues = {r.id: r.residues for r in rows}
    return charpoly.combined([residues[i] for i in range(len(moduli))], moduli)


def _null_spaces(spark: SparkSession, matrix: np.ndarray, roots: charpoly.Roots) -> list[tuple[int, int, np.ndarray]]:
    """Root, multiplicity and vectors of every root found; a task for each."""
    found = roots.found

    def iterate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_pylist()
            vectors = [charpoly.null_vectors(matrix, found[i][0], roots.shift, found[i][1]).tolist() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(vectors, pa.list_(pa.list_(pa.float64())))], ["id", "vectors"])

    rows = spark.range(0, len(found), 1, len(found)).mapInArrow(iterate, "id bigint, vectors array<array<double>>").collect()
    vectors = {r.id: np.array(r.vectors) for r in rows}
    return [(root, many, vectors[i]) for i, (root, many) in enumerate(found)]


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity; their means are taken off as sums."""
    k = len(model.variances)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            white = _projected(_matrix(batch.column("v"), model.size), model)[2]
            white = np.hstack([white, np.ones((len(white), 1))])
            total += white.T @ white
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "total"])

    rows = map_batches(distinct, add_up, "i bigint, j bigint, total double", rows=BLOCK).groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((k + 1, k + 1))
    for r in rows:
        total[r.i, r.j] = r.total
    mean = total[k, :k] / model.n
    return float(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())
