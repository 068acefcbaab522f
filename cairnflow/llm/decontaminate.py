"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded run of consecutive documents of one task. Its text is indexed over the alphabet of the benchmark's
words: every other word is a separator, and stretches between separators that are shorter than the shortest phrase can
hold no phrase and are left out. All phrases (windows of `window` words of an item; a shorter item is one phrase) are
searched backward at once, occurrences are located by sampled suffix positions, and the words that they cover are
merged to spans.

The phrases are broadcast in blocks of bounded size, one after the other: items are taken once, long ones in pieces, and
dealt out by size. Where there is more than one block, documents without any window whose hash is a phrase's stay where
they are, and only the others, few, go from block to block; so a benchmark of any size is searched in full.

Defined results: null and empty texts and items have no words and no hits; repeated documents each get their own
result; items with the same id count once; the words that an item without an id hits count, but it is in no list of items; an empty table on either side gives no hits; further columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import extended, map_batches, scratch, text_input, written
from cairnflow.llm.filters import MOST_BYTES, Filter, Prints, key_filter, mixed
from cairnflow.llm.fmindex import FMIndex

WINDOW = 10
SHARD_SYMBOLS = 1 << 20
SHARD_BYTES = 32 << 20
SHARD_DOCS = 20_000
BLOCK_CHARS = 4 << 20
"""Characters of benchmark items in a broadcast block. As arrays a block takes about 20 bytes of memory a character."""

PIECE_WORDS = 20_000
"""Windows of a piece of a long item."""

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
"""A word before A-Z are lower-cased."""
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words. Bytes from 128 on belong to non-ASCII characters, all of which are word parts."""
    return (text or "").encode("utf-8", "replace").translate(_TO_WORDS).split()


@dataclass
class Phrases:
    """The distinct phrases of a block of items."""

    vocabulary: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    names: list[str | None]
    """The items' ids."""
    starts: np.ndarray
    of: np.ndarray
    """The items of phrase k are names[of[starts[k] : starts[k + 1]]]."""

    def items(self, phrases: set[int]) -> list[str]:
        """The ids of the items of some phrases, in order; items without an id are left out."""
        found = {self.names[i] for k in phrases for i in self.of[self.starts[k] : self.starts[k + 1]].tolist()}
        return sorted(found - {None})

    @classmethod
    def of_items(cls, rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        windows, sizes, owners = [], [], []
        for k, (_, text) in enumerate(rows):
            ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)), np.int32)
            if not len(ids):
                continue
            size = min(window, len(ids))
            found = np.lib.stride_tricks.sliding_window_view(ids, size)
            windows.append(found if size == window else np.pad(found, ((0, 0), (0, window - size))))
            sizes.append(np.full(len(found), size, np.int32))
            owners.append(np.full(len(found), k, np.int32))
        names = [name for name, _ in rows]
        if not windows:
            return cls(vocabulary, np.zeros((0, 0), np.int64), np.zeros(0, np.int64), names, np.zeros(1, np.int64), np.zeros(0, np.int32))
        # No word has the number 0, so padded windows differ from whole ones.
        patterns, which = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
        which, owner = which.ravel(), np.concatenate(owners)
        lengths = np.zeros(len(patterns), np.int64)
        lengths[which] = np.concatenate(sizes)
        order = np.argsort(which, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(which, minlength=len(patterns)))]
        return cls(vocabulary, patterns[:, : int(lengths.max())], lengths, names, starts, owner[order])


class Shard:
    """Collects stretches of benchmark words of documents, then finds the phrases in them."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.shortest = int(phrases.lengths.min()) if len(phrases.lengths) else 0
        self.parts: list[np.ndarray] = []
        self.runs: list[tuple[int, int]] = []  # document, first word
        self.symbols = 1

    def add(self, doc: int, words: list[bytes]) -> bool:
        """Whether the document has any stretch that could hold a phrase."""
        if not self.shortest or len(words) < self.shortest:
            return False
        get = self.phrases.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.r_[0, (ids != 0).astype(np.int8), 0]))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.shortest
        for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            self.parts.append(ids[s:e])
            self.runs.append((doc, s))
            self.symbols += e - s + 1
        return bool(long.any())

    def find(self) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
        """Of each document with hits: merged word spans, and its phrases."""
        if not self.parts:
            return {}, {}
        text = np.zeros(self.symbols, np.int64)
        sizes = np.array([len(p) for p in self.parts])
        begins = 1 + np.r_[0, np.cumsum(sizes + 1)[:-1]]
        for b, p in zip(begins.tolist(), self.parts, strict=True):
            text[b : b + len(p)] = p
        p = self.phrases
        index = FMIndex(text, len(p.vocabulary) + 1)
        low, high = index.search(p.patterns, p.lengths)
        n = high - low
        found = np.flatnonzero(n)
        if not len(found):
            return {}, {}
        which = np.repeat(found, n[found])
        rows = np.arange(len(which)) - np.repeat(np.cumsum(n[found]) - n[found], n[found]) + np.repeat(low[found], n[found])
        at = index.locate(rows)
        cover = np.zeros(self.symbols + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + p.lengths[which], -1)
        hit = np.cumsum(cover) > 0
        edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
        docs = np.array([d for d, _ in self.runs])
        spans: dict[int, list[tuple[int, int]]] = {}
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            run = int(np.searchsorted(begins, s, "right")) - 1
            doc, first = self.runs[run]
            off = s - int(begins[run]) + first
            spans.setdefault(doc, []).append((off, off + e - s))
        pairs = np.unique(np.stack([docs[np.searchsorted(begins, at, "right") - 1], which]), axis=1)
        by_doc: dict[int, set[int]] = {}
        for d, w in pairs.T.tolist():
            by_doc.setdefault(d, set()).add(w)
        return spans, by_doc


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as code points: from the start of the first word to the end of the last."""
    if not spans:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "n_words bigint, word_spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _shards(phrases: Phrases, batches):
    """(batch, results of its rows); documents are held until their shard is full, and only while they may have hits."""
    held: list[tuple[pa.RecordBatch, int, int]] = []
    shard, docs, size, counts = Shard(phrases), 0, 0, {}

    def flush():
        spans, found = shard.find()
        for b, first, _ in held:
            ids = range(first, first + b.num_rows)
            yield (
                b,
                [counts[i] for i in ids],
                [spans.get(i, []) for i in ids],
                [phrases.items(found[i]) if i in found else [] for i in ids],
            )

    for b in batches:
        first = docs
        for t in b.column("text").to_pylist():
            w = words_of(t)
            counts[docs] = len(w)
            shard.add(docs, w)
            docs += 1
        held.append((b, first, b.nbytes))
        size += b.nbytes
        if shard.symbols >= SHARD_SYMBOLS or size >= SHARD_BYTES or docs >= SHARD_DOCS:
            yield from flush()
            held, shard, docs, size, counts = [], Shard(phrases), 0, 0, {}
    yield from flush()


def _pieces(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """item, text, chars: each item once, as words; long ones in pieces that hold each of its windows once."""

    def cut(batches):
        for b in batches:
            names, texts = [], []
            for name, t in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(t)
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    names.append(name)
                    texts.append(b" ".join(words[at : at + PIECE_WORDS + window - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["item", "text"])

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    return map_batches(rows, cut, "item string, text string").where("text <> ''").distinct().withColumn("chars", F.length("text"))


def _dealt(pieces: DataFrame, most: int) -> list[Column | None]:
    """Conditions that part the pieces into blocks of about `most` characters; where a hash deals out more than twice as
    many, the block is dealt out again."""
    chars = pieces.agg(F.sum("chars")).first()[0] or 0
    n = max(1, math.ceil(chars / most))
    if n == 1:
        return [None]
    first = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    out: list[Column | None] = []
    for r in pieces.groupBy(first.alias("k")).agg(F.sum("chars").alias("chars")).orderBy("k").collect():  # a row for each block
        again = math.ceil(r.chars / most) if r.chars > 2 * most else 1
        out += [(first == r.k) & (F.pmod(F.xxhash64("text", "item", F.lit(1)), F.lit(again)) == j) for j in range(again)]
    return out


def _blocks(pieces: DataFrame, parts: list[Column | None], window: int):
    """Whether it is the last, and the phrases of the pieces, in broadcast blocks; each is made when it is asked for."""
    spark = pieces.sparkSession
    for k, part in enumerate(parts):
        rows = (pieces if part is None else pieces.where(part)).select("item", "text").collect()
        yield k == len(parts) - 1, spark.sparkContext.broadcast(Phrases.of_items([(r["item"], r["text"]) for r in rows], window))


def _window_keys(words: list[bytes], length: int) -> np.ndarray:
    """A hash of each window of a number of words."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return mixed(Prints.over(one).of(length) ^ np.uint64(length))


def _phrase_filter(pieces: DataFrame, window: int, most: int):
    """The lengths of phrases and a broadcast filter of their hashes; None if that would be too large."""

    def hash_all(batches):
        for b in batches:
            keys, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
            for t in b.column("text").to_pylist():
                words = words_of(t)
                keys.append(_window_keys(words, size := min(window, len(words))))
                sizes.append(np.full(len(keys[-1]), size, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sizes))], ["key", "size"])

    spark = pieces.sparkSession
    keys = written(map_batches(pieces.select("text"), hash_all, "key bigint, size int").distinct(), scratch(spark, "phrases"))
    count = keys.count()
    if Filter.size(count) * 8 > most:
        return None
    return [r.size for r in keys.select("size").distinct().collect()], spark.sparkContext.broadcast(key_filter(keys, count))  # window lengths


def _sieve(lengths: list[int], known, passing: bool):
    """Rows that may hold a phrase, or the others with their number of words."""

    def sieve(batches):
        for b in batches:
            held, counts = [], []
            for t in b.column("text").to_pylist():
                words = words_of(t)
                counts.append(len(words))
                held.append(any(known.value.has(_window_keys(words, n)).any() for n in lengths))
            taken = pa.array([h == passing for h in held], pa.bool_())
            yield b.append_column("n_words", pa.array(counts, pa.int64())).filter(taken)

    return sieve


_STATE = ["n_words", "word_spans", "items"]


def _search(
    rows: DataFrame, benchmark: DataFrame, item: str, item_text: str, window: int, finish=None, schema: str = "",
    block_chars: int = BLOCK_CHARS, filter_bytes: int = MOST_BYTES,
) -> DataFrame:
    """rows: key, text. Adds the state columns, block by block; finish(batch, word spans) makes the last block's output
    of them instead, so that one block needs one pass through Python. With several blocks, only rows in which a filter of
    all phrases finds one go from block to block."""
    spark, kind = rows.sparkSession, rows.schema["key"].dataType.simpleString()
    pieces = written(_pieces(benchmark, item, item_text, window), scratch(spark, "benchmark"))
    parts = _dealt(pieces, block_chars)
    state = f"key {kind}, text string, n_words bigint"
    empty = [F.array().cast("array<struct<start:bigint,end:bigint>>").alias("word_spans"), F.array().cast("array<string>").alias("items")]
    sieve = _phrase_filter(pieces, window, filter_bytes) if len(parts) > 1 else None
    clean = None
    if sieve is not None:
        clean = map_batches(rows, _sieve(*sieve, False), state)
        clean = clean.select("key", "text") if finish else clean.select("key", "text", "n_words", *empty)
        rows = map_batches(rows, _sieve(*sieve, True), state)
    found = rows.select("key", "text", F.lit(0).cast("long").alias("n_words"), *empty)
    for is_last, shared in _blocks(pieces, parts, window):
        last = finish if is_last else None

        def run(batches, shared=shared, last=last):
            for b, counts, spans, items in _shards(shared.value, batches):
                spans = [
                    merged([(s["start"], s["end"]) for s in old] + new)
                    for old, new in zip(b.column("word_spans").to_pylist(), spans, strict=True)
                ]
                if last:
                    yield last(b, spans)
                    continue
                items = [sorted({*old, *new}) for old, new in zip(b.column("items").to_pylist(), items, strict=True)]
                state = [
                    pa.array(counts, pa.int64()),
                    pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPANS),
                    pa.array(items, pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("text"), *state], ["key", "text", *_STATE])

        found = map_batches(found, run, schema if last else f"key {kind}, text string, {_FOUND}")
        if not is_last:
            # Each block's pass is written, so that the driver and the workers hold one block at a time.
            found = written(found, scratch(spark, "leaks"))
            shared.destroy()
    return found if clean is None else found.unionByName(clean)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
    filter_bytes: int = MOST_BYTES,
) -> DataFrame:
    """key, text, n_words, word_spans (merged spans of hit words), items. with_char_spans adds the spans as code points."""
    found = _search(text_input(docs, key, text), benchmark, item, item_text, window, block_chars=block_chars, filter_bytes=filter_bytes)
    return found.withColumnRenamed("key", key)


def with_char_spans(found: DataFrame) -> DataFrame:
    """find_leaks' result with spans: the word spans as code points of the text."""

    def run(batches):
        for b in batches:
            spans = [
                [{"start": s, "end": e} for s, e in char_spans(t or "", [(x["start"], x["end"]) for x in w])]
                for t, w in zip(b.column("text").to_pylist(), b.column("word_spans").to_pylist(), strict=True)
            ]
            yield b.append_column("spans", pa.array(spans, _SPANS))

    return map_batches(found, run, extended(found, ("spans", "array<struct<start:bigint,end:bigint>>")))


def cut(text: str, word_spans: list[tuple[int, int]]) -> str:
    """The text without the spans."""
    parts, at = [], 0
    for s, e in char_spans(text, word_spans):
        parts.append(text[at:s])
        at = e
    return "".join([*parts, text[at:]])


def remove_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW,
    block_chars: int = BLOCK_CHARS, filter_bytes: int = MOST_BYTES,
) -> DataFrame:
    """docs with the merged spans cut out of the text; other columns are unchanged. No shuffle: rows stay where they are."""
    rest = F.struct(*(F.col(c) for c in docs.columns if c != text)) if len(docs.columns) > 1 else F.struct(F.lit(1).alias("none"))
    packed = docs.select(rest.alias("key"), F.col(text).alias("text"))

    def finish(b, spans):
        texts = [cut(t, w) if w else t for t, w in zip(b.column("text").to_pylist(), spans, strict=True)]
        return pa.RecordBatch.from_arrays([b.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    kind = packed.schema["key"].dataType.simpleString()
    left = _search(packed, benchmark, item, item_text, window, finish, f"key {kind}, text string", block_chars, filter_bytes)
    return left.select(*(F.col("text").alias(c) if c == text else F.col("key")[c].alias(c) for c in docs.columns))
