"""Token ids of whole documents in directly addressable files, in document order (see dac.py).

Writing: documents are range-partitioned and sorted by their key, encoded, closed with an end id and written to files
of bounded size in a folder that all executors share; the tasks that succeed report their files in a manifest, so files
of failed or repeated attempts are never read. Reading: each file's place in the whole is the sum of the tokens of the
files before it.

Defined results: a null text counts as empty and has the end id only; null keys come first; rows with equal keys stay
neighbours, in any order among themselves; an empty table gives an empty manifest; further columns are not read.
"""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.llm.bpe import _SETTLED, byte_alphabet
from cairnflow.llm.common import map_batches, scratch, text_input, written
from cairnflow.llm.dac import Reader, dump

END_ID = 2
FILE_TOKENS = 4 << 20
"""A file is closed once it holds so many tokens; memory is this plus one document."""
_LONG_RUN = regex.compile(r"\S{4000}|\s{4000}")
"""The fast encoder takes quadratic time in a run, so texts with runs like this go to the library."""

# Fixed value: how byte-level BPE cuts text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteEncoder:
    """A byte-level tokenizer file of the tokenizers library. tiktoken gives the same ids several times faster where
    the merge list is in id order and characters' classes don't depend on the Unicode version; the library itself
    encodes all other texts."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = spec["model"]["vocab"]
        self.special = [x["content"] for x in spec["added_tokens"]]
        made = [vocab["".join(p) if isinstance(p, list) else p.replace(" ", "")] for p in spec["model"]["merges"]]
        self.fast = None
        if all(a < b for a, b in zip(made, made[1:], strict=False)):
            ranks = {bytes(of[c] for c in t): i for t, i in vocab.items()}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        plain = text.isascii() or _SETTLED.fullmatch(text)
        if self.fast and plain and not _LONG_RUN.search(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def _put(folder: str, values: list[np.ndarray], ids: list) -> dict:
    starts = np.r_[0, np.cumsum([len(v) for v in values])]
    data = dump(np.concatenate(values), ids, starts)
    store, base = fs.FileSystem.from_uri(folder)
    name = f"{base}/{uuid.uuid4().hex}.dac"
    with store.open_output_stream(name) as out:
        out.write(data)
    return {"file": f"{folder}/{name.rsplit('/', 1)[1]}", "bytes": len(data), "docs": len(ids), "tokens": int(starts[-1])}


_MANIFEST = pa.schema(
    [("file", pa.string()), ("bytes", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("first", pa.int64()), ("part", pa.int64())]
)


def write_tokens(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, file_tokens: int = FILE_TOKENS
) -> DataFrame:
    """The manifest of the files: file, bytes, docs, tokens, first (key of its first document), part (its number among
    the files of one partition). The key must be an integer."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    rows = text_input(docs, key, text).select(F.col("key").cast("long"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "key").sortWithinPartitions("key")

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        enc, part = byte_encoder(path), 0
        values, ids, size = [], [], 0

        def flush():
            row = _put(folder, values, ids) | {"first": ids[0], "part": part}
            return pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

        for b in batches:
            for i, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                v = np.append(enc.encode(t or ""), np.uint32(end_id)).astype(np.uint32)
                values.append(v)
                ids.append(i)
                size += len(v)
                if size >= file_tokens:
                    yield flush()
                    part += 1
                    values, ids, size = [], [], 0
        if ids:
            yield flush()

    manifest = map_batches(ordered, run, "file string, bytes bigint, docs bigint, tokens bigint, first bigint, part bigint")
    return written(manifest, f"{folder}/manifest")


def open_tokens(file: str, size: int) -> Reader:
    """Random access by range reads."""
    store, name = fs.FileSystem.from_uri(file)
    handle = store.open_input_file(name)

    def read(offset: int, n: int) -> bytes:
        return handle.read_at(n, offset)

    return Reader(read, size)


def read_tokens(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start (tokens of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers).

    The running sum is over files, of which there is one for each FILE_TOKENS tokens or partition, not over documents.
    """
    before = Window.orderBy(F.col("first").asc_nulls_first(), "part", "file").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                store, name = fs.FileSystem.from_uri(row["file"])
                with store.open_input_file(name) as f:
                    data = f.read()  # all of it is wanted: bounded by FILE_TOKENS
                reader = Reader(lambda offset, n, data=data: data[offset : offset + n], row["bytes"])
                ids, starts = reader.documents()
                for k in range(0, len(ids), 256):
                    some = range(k, min(k + 256, len(ids)))
                    tokens = [reader.tokens(int(starts[i]), int(starts[i + 1])).astype("<u4").tobytes() for i in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[i] for i in some], pa.int64()),
                            pa.array([row["before"] + int(starts[i]) for i in some], pa.int64()),
                            pa.array([len(t) // 4 for t in tokens], pa.int64()),
                            pa.array(tokens, pa.binary()),
                        ],
                        ["key", "start", "n_tokens", "ids"],
                    )

    spread = placed.repartition(parts, "file")
    out = map_batches(spread, run, "key bigint, start bigint, n_tokens bigint, ids binary")
    return out.withColumnRenamed("key", key)
