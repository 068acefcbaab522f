"""BPE encoding and decoding of whole text columns (see bpe.py for the transducers).

Defined results: a null text counts as empty and has no tokens; repeated rows give repeated results; a text of any
length needs memory for itself, its tokens and one lookahead; an empty table gives an empty table; further columns are
not read. Surrogates that can't be written in UTF-8 don't occur in Spark strings.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from cairnflow.llm.bpe import decoder, encoder
from cairnflow.llm.common import extended, map_batches, text_input


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """key, n_tokens, ids. as_text: ids as decimals joined by one blank instead of array<int>."""

    def run(batches):
        enc = encoder(path)
        names = {i: str(i) for i in enc.merges.tokens}
        for b in batches:
            ids = [enc.encode(t) if t else [] for t in b.column("text").to_pylist()]
            n = pa.array([len(x) for x in ids], pa.int64())
            column = pa.array([" ".join(map(names.__getitem__, x)) for x in ids], pa.string()) if as_text else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("key"), n, column], ["key", "n_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids {'string' if as_text else 'array<int>'}"
    return map_batches(text_input(docs, key, text), run, schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, surface: bool = True) -> DataFrame:
    """encode's result with a column `decoded`, from its ids in either form."""
    i = encoded.columns.index("ids")
    as_text = encoded.dtypes[i][1] == "string"

    def run(batches):
        dec = decoder(path, surface)
        for b in batches:
            ids = b.column(i).to_pylist()
            text = [dec.decode((x.split() if as_text else x) or ()) for x in ids]
            yield b.append_column("decoded", pa.array(text, pa.string()))

    return map_batches(encoded, run, extended(encoded, ("decoded", "string")))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", surface: bool = True) -> DataFrame:
    """key, n_tokens, ids (decimals joined by one blank) and decoded, in one pass through Python."""

    def run(batches):
        enc, dec = encoder(path), decoder(path, surface)
        names = {i: str(i) for i in enc.merges.tokens}

        def one(t: str | None) -> tuple[int, str, str]:
            n, parts = 0, []

            def passing():
                nonlocal n
                for ids in enc.stream((t or "",)):
                    if ids:
                        n += len(ids)
                        parts.append(" ".join(map(names.__getitem__, ids)))
                        yield from ids

            back = dec.decode(passing())
            return n, " ".join(parts), back

        for b in batches:
            n, ids, back = zip(*map(one, b.column("text").to_pylist()), strict=True) if b.num_rows else ((), (), ())
            columns = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("key"), *columns], ["key", "n_tokens", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(text_input(docs, key, text), run, f"key {kind}, n_tokens bigint, ids string, decoded string").withColumnRenamed("key", key)
