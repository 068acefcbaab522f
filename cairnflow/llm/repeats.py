"""Passages of whole texts, as bytes, that occurred before: suffix arrays over the parts of texts that can repeat.

Every window of `length` bytes is filed under the least hash of its parts (of about a third of it), so equal windows meet
under one key, and neighbouring windows with one key are a fragment of the text, sent once. Keys are counted first: a
fragment under a key of its own holds nothing that occurs elsewhere and stays where it is. Keys of very many bytes, as of a
passage in a third of all documents, are filed anew by longer parts, and in the end by whole windows; equal fragments of
them are merged within salted groups before. Then each key's fragments go to one block, where a suffix array built in two
stages gives the windows that occurred before.

A document is a row's id and text: ids order documents (null last), texts of one id are ordered by their SHA-256, and rows
equal in both are one document, with one result. A null text is empty. Texts shorter than a window repeat nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.llm import suffix_array
from cairnflow.llm.common import map_batches, scratch, written
from cairnflow.llm.filters import MOST_BYTES, Filter, Prints, key_filter, mixed, runs

LENGTH = 100
HOT_BYTES = 4 << 20
"""Fragments of one key that one block takes; keys with more are filed anew."""
BLOCK_BYTES = 2 << 20
SALTS = 64
TEXT_BYTES = 1 << 19
"""Longer texts are taken in pieces, so that the work on one has bounded memory."""
_POSITION = np.uint64((1 << 20) - 1)

Place = "doc bigint, tie binary, start bigint, n bigint"
"""A run of n windows of a document, from byte start on. With a body it is a fragment; without, the windows have all
occurred before."""


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    m, n = h, 1
    while 2 * n <= width:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    k = len(h) - width + 1
    return np.minimum(m[:k], m[width - n : width - n + k])


def anchors(prints: Prints, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window the place and hash of its least part, the first of equal ones."""
    part = max(1, length * 36 // 100)
    h = prints.of(part)
    place = np.arange(len(h), dtype=np.uint64)
    least = sliding_min((h & ~_POSITION) | place, length - part + 1)
    at = (least & _POSITION).astype(np.int64)
    return at, h[at]


def finer(prints: Prints, at: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
    """New keys of windows: by the bytes that all windows share whose least part is about as far from their start."""
    step = max(1, length // 12)
    group = (at - np.arange(len(at))) // step
    core = prints.of(length - step + 1)
    return mixed(keys ^ mixed(core[at - step * group] + group.astype(np.uint64)))


# Fragments of texts


def _pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Parts of a text whose windows are all its windows, each once."""
    for a in range(0, len(text) - length + 1, TEXT_BYTES):
        yield a, text[a : a + TEXT_BYTES + length - 1]


def _count_keys(length: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, times = [], [], []
            for text in batch.column("body").to_pylist():
                for _, piece in _pieces(text, length):
                    at, keys = anchors(Prints(piece), length)
                    a, b = runs(keys)
                    moves = np.concatenate([[0], np.cumsum(at[1:] != at[:-1])])
                    found.append(keys[a])
                    sizes.append(b - a + length - 1)
                    times.append(1 + (moves[b - 1] > moves[a]))
            if found:
                columns = [np.concatenate(found).view(np.int64), np.concatenate(sizes), np.concatenate(times)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "bytes", "times"])

    return count


class _Pieces:
    """Rows of runs and fragments, in batches of bounded size."""

    SCHEMA = f"key bigint, {Place}, hot boolean, body binary"
    FIELDS = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("tie", pa.binary()), ("start", pa.int64()), ("n", pa.int64()), ("hot", pa.bool_()), ("body", pa.binary())])

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, *row: object) -> None:
        self.rows.append(row)
        self.size += 64 + (len(row[6]) if row[6] is not None else 0)

    def full(self) -> bool:
        return self.size >= 8 << 20

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[] for _ in self.FIELDS]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, self.FIELDS, strict=True)], schema=self.FIELDS)


def _emit(out: _Pieces, body: bytes, doc: object, tie: bytes, start: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> None:
    """Finer fragments of one text, of which repeated ones are runs at once."""
    first: set[tuple[int, bytes]] = set()
    for key, i, j in zip(keys[a].view(np.int64).tolist(), a.tolist(), b.tolist(), strict=True):
        part = body[i : j + length - 1]
        again = (key, part) in first
        first.add((key, part))
        out.add(key, doc, tie, start + i, j - i, True, None if again else part)


def _cut_texts(length: int, repeated: object, hot: object):
    """Fragments under repeated keys; repeated and hot are broadcast filters, or None: each row then says which it needs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Pieces()
        for batch in batches:
            wanted = batch.column("wanted").to_pylist() if repeated is None else [None] * batch.num_rows
            for doc, tie, text, some in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "body")), wanted, strict=True):
                if some is not None:
                    some = {w["key"]: w["hot"] for w in some}
                for start, piece in _pieces(text, length):
                    prints = Prints(piece)
                    at, keys = anchors(prints, length)
                    a, b = runs(keys)
                    mine = keys[a]
                    if some is None:
                        take = repeated.value.has(mine)
                        burn = take & hot.value.has(mine)
                    else:
                        found = [some.get(k) for k in mine.view(np.int64).tolist()]
                        take, burn = np.array([f is not None for f in found], bool), np.array([bool(f) for f in found], bool)
                    cool = take & ~burn
                    for key, i, j in zip(mine[cool].view(np.int64).tolist(), a[cool].tolist(), b[cool].tolist(), strict=True):
                        out.add(key, doc, tie, start + i, j - i, False, piece[i : j + length - 1])
                    if burn.any():
                        new = finer(prints, at, keys, length)
                        burning = np.repeat(burn, b - a)
                        x, y = runs(new, burning)
                        x, y = x[burning[x]], y[burning[x]]
                        _emit(out, piece, doc, tie, start, new, x, y, length)
                    if out.full():
                        yield out.batch()
        yield out.batch()

    return cut


def _cut_windows(length: int):
    """Fragments filed by whole windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Pieces()
        for batch in batches:
            for doc, tie, start, body in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "start", "body")), strict=True):
                keys = Prints(body).of(length)
                _emit(out, body, doc, tie, start, keys, *runs(keys), length)
                if out.full():
                    yield out.batch()
        yield out.batch()

    return cut


# Groups of fragments


def _order(doc: object, tie: bytes, start: int) -> tuple:
    return (doc is None, doc or 0, tie, start)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "tie", "start", "n", "body")), strict=True)


class _Group:
    """Fragments of one key: the first of equal ones is kept, the others have occurred before."""

    def __init__(self) -> None:
        self.first: dict[bytes, tuple] = {}

    def add(self, body: bytes, place: tuple) -> tuple | None:
        """The place that has occurred before, of this one and the first one so far."""
        old = self.first.setdefault(body, place)
        if old[:3] == place[:3]:
            return None
        if _order(*place[:3]) < _order(*old[:3]):
            self.first[body], place = place, old
        return place


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal fragments of one key and salt, sorted by key: the first stays, the others become runs."""
    out, group, key = _Pieces(), _Group(), None

    def close() -> None:
        for body, place in group.first.items():
            out.add(key, *place, True, body)

    for k, doc, tie, start, n, body in _rows(batches):
        if k != key:
            close()
            key, group = k, _Group()
        again = group.add(body, (doc, tie, start, n))
        if again is not None:
            out.add(k, *again, True, None)
        if out.full():
            yield out.batch()
    close()
    yield out.batch()


def _sort_blocks(length: int):
    """Fragments sorted by key to the runs of windows that have occurred before, by suffix arrays of whole keys."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, group, key, size = _Pieces(), _Group(), None, 0
        block: list[tuple[bytes, tuple]] = []

        def close() -> None:
            block.sort(key=lambda x: _order(*x[1][:3]))
            fragment, offset = suffix_array.repeated([body for body, _ in block], length)
            if not len(fragment):
                return
            a = np.flatnonzero(np.concatenate([[True], (fragment[1:] != fragment[:-1]) | (offset[1:] != offset[:-1] + 1)]))
            for i, o, n in zip(fragment[a].tolist(), offset[a].tolist(), np.diff(np.append(a, len(fragment))).tolist(), strict=True):
                doc, tie, start, _ = block[i][1]
                out.add(None, doc, tie, start + o, n, False, None)

        for k, doc, tie, start, n, body in _rows(batches):
            if k != key:
                block += group.first.items()
                key, group = k, _Group()
                if size >= BLOCK_BYTES:
                    close()
                    block, size = [], 0
                if out.full():
                    yield out.batch()
            if body not in group.first:
                size += len(body)
            again = group.add(body, (doc, tie, start, n))
            if again is not None:
                out.add(None, *again, False, None)
        block += group.first.items()
        if block:
            close()
        yield out.batch()

    return sort


def _grouped(fragments: DataFrame, fn, *by: Column | str) -> DataFrame:
    rows = fragments.select("key", "doc", "tie", "start", "n", "body").repartition(*by).sortWithinPartitions("key")
    return map_batches(rows, fn, _Pieces.SCHEMA, rows=4096)


# The operator


def documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, tie and body of every row; the tie is part of the text's SHA-256."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc"), F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("tie"), body.cast("binary").alias("body"))


def repeated_runs(texts: DataFrame, length: int = LENGTH, hot_bytes: int = HOT_BYTES, filter_bytes: int = MOST_BYTES) -> DataFrame:
    """doc, tie, start and n: runs of windows that occurred before. texts: as documents() gives them."""
    spark = texts.sparkSession
    folder = scratch(spark, "repeats")
    counted = map_batches(texts.select("body"), _count_keys(length), "key bigint, bytes bigint, times bigint", rows=64)
    keys = counted.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.sum("times").alias("times")).where("times > 1")
    keys = written(keys.select("key", (F.col("bytes") > hot_bytes).alias("hot")), f"{folder}/keys")
    total, hot = keys.agg(F.count("*"), F.count(F.when(F.col("hot"), 1))).first()
    if Filter.size(total) * 8 <= filter_bytes:
        both = [spark.sparkContext.broadcast(key_filter(k, n)) for k, n in ((keys, total), (keys.where("hot"), hot))]
        fragments = map_batches(texts, _cut_texts(length, *both), _Pieces.SCHEMA, rows=64)
    else:
        fragments = map_batches(_with_keys(texts, keys, length), _cut_texts(length, None, None), _Pieces.SCHEMA, rows=64)
    if not hot:
        return _grouped(fragments, _sort_blocks(length), "key").select("doc", "tie", "start", "n")
    fragments = written(fragments, f"{folder}/fragments")
    known, cool, burning = fragments.where("body IS NULL"), fragments.where("NOT hot"), fragments.where("hot AND body IS NOT NULL")
    for level in ("cores", "windows"):
        salt = F.pmod(F.xxhash64("doc", "tie", "start"), F.lit(SALTS))
        merged = written(_grouped(burning, _merge, "key", salt), f"{folder}/merged-{level}")
        known = known.unionByName(merged.where("body IS NULL"))
        burning = merged.where("body IS NOT NULL")
        if level == "windows":
            break
        weights = burning.groupBy("key").agg(F.sum(F.octet_length("body")).alias("bytes"))
        hot_keys = written(weights.where(F.col("bytes") > hot_bytes).select("key"), f"{folder}/hot-{level}")
        cool = cool.unionByName(burning.join(hot_keys, "key", "left_anti").select(*burning.columns))
        burning = map_batches(burning.join(hot_keys, "key", "left_semi").select(*burning.columns), _cut_windows(length), _Pieces.SCHEMA, rows=256)
        burning = written(burning, f"{folder}/windows")
        known, burning = known.unionByName(burning.where("body IS NULL")), burning.where("body IS NOT NULL")
    sorted_out = _grouped(cool.unionByName(burning), _sort_blocks(length), "key")
    return known.unionByName(sorted_out).select("doc", "tie", "start", "n")


def _with_keys(texts: DataFrame, keys: DataFrame, length: int) -> DataFrame:
    """Texts, each with those of its keys that repeat: for sets of keys that no filter may hold."""

    def list_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[np.ndarray] = []
            index: list[int] = []
            for i, text in enumerate(batch.column("body").to_pylist()):
                for _, piece in _pieces(text, length):
                    own = np.unique(anchors(Prints(piece), length)[1])
                    rows.append(own)
                    index += [i] * len(own)
            taken = [batch.column(c).take(pa.array(index, pa.int64())) for c in ("doc", "tie")]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(np.concatenate(rows).view(np.int64) if rows else [], pa.int64())], ["doc", "tie", "key"])

    listed = map_batches(texts, list_keys, "doc bigint, tie binary, key bigint", rows=64).distinct().join(keys, "key")
    lists = listed.groupBy("doc", "tie").agg(F.collect_list(F.struct("key", "hot")).alias("wanted")).select(F.col("doc").alias("d"), F.col("tie").alias("t"), "wanted")
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))
    return texts.join(lists, same).select("doc", "tie", "body", "wanted")


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot_bytes: int = HOT_BYTES, filter_bytes: int = MOST_BYTES
) -> DataFrame:
    """Of every row: key, n_bytes, spans (start and end of the bytes to remove: every byte of a window of `length` bytes that
    occurred earlier, in a smaller document or before in the same one) and kept, the bytes that are left."""
    texts = documents(docs, key, text)
    found = repeated_runs(texts, length, hot_bytes, filter_bytes)
    lists = found.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    lists = lists.select(F.col("doc").alias("d"), F.col("tie").alias("t"), "runs")
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))
    rows = texts.join(lists, same, "left").select("doc", "body", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, sizes = [], [], []
            for body, own in zip(batch.column("body").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                gone = united(own, length) if own else []
                edges = [0, *(e for s in gone for e in s), len(body)]
                spans.append([{"start": s, "end": e} for s, e in gone])
                kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(body))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n_bytes", "spans", "kept"])

    schema = "doc bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    return map_batches(rows, cut, schema, rows=64).withColumnRenamed("doc", key)


def united(own: list[dict], length: int) -> list[tuple[int, int]]:
    """Spans of bytes that runs of windows cover; those that touch are one."""
    out: list[tuple[int, int]] = []
    for r in sorted(own, key=lambda r: r["start"]):
        a, b = r["start"], r["start"] + r["n"] + length - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
