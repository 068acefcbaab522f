"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

The lexicon is learned: words, and beginnings of words, that are much likelier in toxic documents than in others, by
document counts that Spark aggregates over the labelled fit rows. Features are densities of lexicon hits, their
nearness to words of the second person, capitals, punctuation and obfuscation.

Labels are learned from rows of the fit folds only, at most FIT_ROWS of them, chosen by a hash of the key; the trees
and the lexicon see two folds, the calibration the third. The trees see each row by a lexicon that was learned without
it. Every other step covers all documents.

Defined results: null and empty texts have no words and get the score of an empty feature row; repeated rows get equal
scores; of several labels of a key the largest counts, null labels do not; without labels, or with labels of one class,
the score is the smoothed rate of the class; an empty table gives an empty table; only key and text are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.boosting import Boosting, Isotonic
from cairnflow.llm.common import crc_fold, map_batches, scratch, text_input, written

FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3
FIT_ROWS = 20_000
"""Bound on the labelled rows that a model is fitted on."""
LEXICON_FOLDS = 4
LEXICON = 1_000
"""Most entries of the lexicon, by significance."""
THRESHOLD = 0.3
STEMS = (4, 5, 6, 7)
NEAR = 5
STRETCH = 50

# Words of the second person in four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer eure tu toi te ton ta "
    "tes vous votre vos tú ti usted ustedes vosotros vuestro vuestra contigo".split()
)
# Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!|", "oieastasil")
MARKS = "!?*#$%&@"

FEATURES = (
    "log_words", "word_hits", "stem_hits", "disguised_hits", "hit_density", "word_density", "stem_density", "weight_density",
    "most_in_stretch", "log_hits", "you_density", "hits_near_you", "nearest_you", "caps_words", "capital_letters",
    "marks", "exclamations", "disguised_words", "stretched_words", "question_marks",
)


@dataclass
class Lexicon:
    words: dict[str, int]
    stems: dict[str, int]
    """Weights from 1 to 15."""


_CORE = re.compile(r"\w(?:.*\w)?", re.DOTALL)
_LETTERS = re.compile(r"[^\W\d_]")
_STRETCHED = re.compile(r"(.)\1\1", re.DOTALL)
_SPLIT_LETTERS = re.compile(r"(?:[^\W\d_][.\-*_]){2,}[^\W\d_]")

_WORD_HIT, _STEM_HIT, _DISGUISED_HIT, _YOU, _CAPS, _DISGUISED, _LONG = (1 << k for k in range(7))


class Featurizer:
    CACHE = 100_000
    CACHED_LENGTH = 48
    """Characters of the longest token that is kept, so that the cache's memory is bounded."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.known: dict[str, int] = {}

    def _weight(self, word: str) -> tuple[int, int]:
        w = self.lexicon.words.get(word)
        if w:
            return _WORD_HIT, w
        best = max((self.lexicon.stems.get(word[:n], 0) for n in STEMS if len(word) >= n), default=0)
        return (_STEM_HIT, best) if best else (0, 0)

    def code(self, token: str) -> int:
        """Marks of a token, with the lexicon's weight above them."""
        out = self.known.get(token)
        if out is not None:
            return out
        found = _CORE.search(token)
        core = found[0] if found else ""
        low = core.lower()
        mark, weight = self._weight(low)
        out = mark
        if low in SECOND_PERSON:
            out |= _YOU
        if len(core) > 1 and core.isupper():
            out |= _CAPS
        if _STRETCHED.search(low):
            out |= _LONG
        odd = any(not c.isalpha() and c not in "'’-" for c in core)
        if _LETTERS.search(core) and (odd or _SPLIT_LETTERS.fullmatch(core)):
            out |= _DISGUISED
            plain = "".join(c for c in token.lower().translate(DISGUISE) if c.isalpha())
            mark, w = self._weight(plain)
            if mark and not out & (_WORD_HIT | _STEM_HIT):
                out |= _DISGUISED_HIT
                weight = w
        out |= weight << 8
        if len(token) <= self.CACHED_LENGTH:
            if len(self.known) >= self.CACHE:
                self.known = {}
            self.known[token] = out
        return out

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        tokens = text.split()
        n = len(tokens)
        codes = np.fromiter(map(self.code, tokens), np.int64, n)
        hit = (codes & (_WORD_HIT | _STEM_HIT | _DISGUISED_HIT)) != 0
        you = np.flatnonzero(codes & _YOU)
        at = np.flatnonzero(hit)
        near, nearest = 0.0, 100.0
        if len(at) and len(you):
            k = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
            near, nearest = float((gap <= NEAR).mean()), float(min(100, gap.min()))
        total = np.r_[0, np.cumsum(hit)]
        most = int((total[np.minimum(np.arange(n) + STRETCH, n)] - total[:n]).max()) if n else 0
        count = lambda bit: int(np.count_nonzero(codes & bit))
        size, chars = max(n, 1), max(len(text), 1)
        words, stems, hidden, hits = count(_WORD_HIT), count(_STEM_HIT), count(_DISGUISED_HIT), len(at)
        return [
            math.log1p(n), words, stems, hidden, hits / size, words / size, stems / size, float((codes >> 8).sum()) / size,
            most, math.log1p(hits), len(you) / size, near, nearest, count(_CAPS) / size,
            sum(map(str.isupper, text)) / chars if not text.islower() else 0.0,
            sum(map(text.count, MARKS)) / chars, text.count("!") / chars, count(_DISGUISED) / size, count(_LONG) / size,
            text.count("?") / chars,
        ]


def fold(key: str = "doc_id"):
    return crc_fold(key, FOLDS)


def lexicon_fold(folds: int = LEXICON_FOLDS):
    """Not crc32, by whose remainders the rows have been chosen."""
    return F.pmod(F.xxhash64("key"), F.lit(folds))


_SHARES = 1 << 40


def labelled(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, allowed, rows: int) -> DataFrame:
    """key, text, label (0 or 1) of at most about `rows` documents of the allowed folds, by a hash of the key. Labels that are
    neither 0 nor 1 are no labels.

    The chosen labels are bounded by `rows`, so they are broadcast and only their texts are shuffled: of rows that
    repeat a key one is used, chosen by a hash of its text, so that the rows are bounded too."""
    known = (
        labels.where(F.coalesce(F.col(label).try_cast("double").isin(0.0, 1.0), F.lit(False)) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .where(allowed("key"))
    )
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("key"), F.lit(_SHARES)) < math.ceil(share * _SHARES))
    found = text_input(docs, key, text).join(F.broadcast(chosen), "key")
    one = found.groupBy("key").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("one"))
    return one.select("key", "one.text", "one.label")


def learn_lexicons(rows: DataFrame, folds: int = LEXICON_FOLDS, entries: int = LEXICON) -> list[Lexicon]:
    """rows: key, text, label. The lexicon of all rows, then that of all rows but each fold's. Weights are log odds of
    document counts; entries must stand out by three standard errors."""
    spark, fold_of = rows.sparkSession, lexicon_fold(folds)
    parts = rows.groupBy(fold_of.alias("fold")).agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).collect()
    sizes = {r["fold"]: (r["t"], r["c"]) for r in parts}
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda w: F.length(w) >= 3)
    forms = lambda w: F.array(w, *(F.when(F.length(w) >= n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS))
    entry = F.explode(F.array_distinct(F.array_compact(F.flatten(F.transform(words, forms))))).alias("entry")
    found = rows.select("label", fold_of.alias("fold"), entry)
    toxic = [F.sum(F.when(F.col("fold") == k, F.col("label")).otherwise(0)).alias(f"t{k}") for k in range(folds)]
    clean = [F.sum(F.when(F.col("fold") == k, 1 - F.col("label")).otherwise(0)).alias(f"c{k}") for k in range(folds)]
    counts = found.groupBy("entry").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"), *toxic, *clean).where("t >= 3")
    counts = written(counts, scratch(spark, "lexicon"))

    def learn(left_out: int | None) -> Lexicon:
        t, c = F.col("t"), F.col("c")
        out = [v for k, v in sizes.items() if k != left_out]
        if left_out is not None:
            t, c = t - F.col(f"t{left_out}"), c - F.col(f"c{left_out}")
        n_toxic, n_clean = sum(x for x, _ in out), sum(x for _, x in out)
        w = F.log((t + 0.5) / F.lit(n_toxic + 1.0)) - F.log((c + 0.5) / F.lit(n_clean + 1.0))
        z = F.col("w") / F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        best = counts.where(t >= 3).withColumn("w", w).withColumn("z", z).where("z >= 3 AND w >= 1.5")
        top = best.orderBy(F.desc("z"), "entry").limit(entries).select("entry", "w").collect()
        weight = lambda w: int(min(15, max(1, round(2 * w))))
        return Lexicon(
            {r["entry"]: weight(r["w"]) for r in top if not r["entry"].endswith("*")},
            {r["entry"][:-1]: weight(r["w"]) for r in top if r["entry"].endswith("*")},
        )

    return [learn(None), *map(learn, range(folds))]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosting
    calibration: Isotonic

    def scores(self, texts: list[str | None], featurizer: Featurizer) -> np.ndarray:
        x = np.array([featurizer.features(t) for t in texts]).reshape(len(texts), len(FEATURES))
        return np.clip(self.calibration(self.trees.raw(x)), 0.0, 1.0)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS
) -> Model:
    rows = labelled(docs, labels, label, key, text, lambda k: crc_fold(k, FOLDS) != HELD_OUT, fit_rows)
    rows = written(rows, scratch(docs.sparkSession, "labelled"))
    later = crc_fold("key", FOLDS) == CALIBRATION
    whole, *others = learn_lexicons(rows.where(~later))
    # A row that the lexicon was learned on would look more toxic by it than it is: it gets the lexicon of other rows.
    marked = rows.select("key", "label", "text", F.when(~later, lexicon_fold()).cast("int").alias("fold"))

    def run(batches):
        plain, apart = Featurizer(whole), [Featurizer(x) for x in others]
        for b in batches:
            x = [
                (plain if k is None else apart[k]).features(t)
                for t, k in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("label"), pa.array(x, pa.list_(pa.float64()))], ["key", "label", "x"]
            )

    kind = rows.schema["key"].dataType.simpleString()
    found = map_batches(marked, run, f"key {kind}, label int, x array<double>")
    sample = found.select(later.alias("later"), "label", "x").orderBy("key").collect()
    x = np.array([r["x"] for r in sample]).reshape(len(sample), len(FEATURES))
    y = np.array([float(r["label"]) for r in sample])
    later = np.array([r["later"] for r in sample], bool)
    trees = Boosting().fit(x[~later], y[~later])
    return Model(whole, trees, Isotonic().fit(trees.raw(x[later]), y[later]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        featurizer = Featurizer(shared.value.lexicon)
        for b in batches:
            s = shared.value.scores(b.column("text").to_pylist(), featurizer)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(s, pa.float64())], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(text_input(docs, key, text), run, f"key {kind}, score double").withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at or over the threshold; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        featurizer = Featurizer(shared.value.lexicon)
        for b in batches:
            s = shared.value.scores(b.column(text).to_pylist(), featurizer)
            yield b.filter(pa.array(s < threshold))

    return map_batches(docs, run, docs.schema)
