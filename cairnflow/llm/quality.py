"""Quality: one probability for a whole text from a byte-level convolutional network (see convnet.py).

The network is fitted on at most FIT_ROWS labelled rows of the fit folds, chosen by a hash of the key; scoring covers
every byte of every document.

Defined results: null and empty texts are scored as documents without bytes; repeated rows get equal scores; of several
labels of a key the largest counts, null labels do not; with labels of one class, or none, the score is the smoothed
rate of the class; an empty table gives an empty table; only key and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import crc_fold, map_batches, text_input
from cairnflow.llm.convnet import ConvNet
from cairnflow.llm.toxicity import labelled

FOLDS, HELD_OUT = 3, 1
FIT_ROWS = 1_200
"""Bound on the labelled rows that the network is fitted on."""
FIT_BYTES = 16 << 20
"""Bound on their bytes, half of it for each label: a row that doesn't fit any more, in hash order, is passed over."""
FIT_ROW_BYTES = 1 << 17
"""Longer texts are not used for fitting (they are scored like any other), so that a step's memory is bounded."""
THRESHOLD = 0.5


def fold(key: str = "doc_id"):
    return crc_fold(key, FOLDS)


@dataclass
class Model:
    net: ConvNet | None
    rate: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.rate)
        return self.net.scores([(t or "").encode("utf-8", "replace") for t in texts])


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS
) -> Model:
    rows = labelled(docs, labels, label, key, text, lambda k: crc_fold(k, FOLDS) != HELD_OUT, fit_rows)
    rows = rows.select("key", "label", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= FIT_ROW_BYTES)
    sample, left = [], {0: FIT_BYTES // 2, 1: FIT_BYTES // 2}
    for r in rows.orderBy(F.xxhash64("key"), "key").toLocalIterator():
        data = r["text"].encode("utf-8", "replace")
        if len(data) <= left[r["label"]]:
            left[r["label"]] -= len(data)
            sample.append((r["label"], data))
    y = np.array([v for v, _ in sample], float)
    rate = float((y.sum() + 0.5) / (len(y) + 1))
    if len(y) == 0 or y.min() == y.max():
        return Model(None, rate)
    return Model(ConvNet().fit([t for _, t in sample], y), rate)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = shared.value.scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(s, pa.float64())], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(text_input(docs, key, text), run, f"key {kind}, score double").withColumnRenamed("key", key)
