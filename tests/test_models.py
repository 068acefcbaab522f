"""The forest: fitting, saving, scoring and its report; ingestion's pieces that need no broker."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cairnflow.functions.columns import json_of, json_scalar
from cairnflow.operators import ml, rolling
from cairnflow.sources import ingest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def rows(spark):
    hashed = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    return spark.range(600).select(F.col("id").alias("transaction_id"), hashed.alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)).cast("double").alias("b"), (hashed > 0.6).alias("label"))


def test_forest_is_saved_and_scores_alike(spark, rows, tmp_path):
    model = ml.fit_forest(rows, ["a", "b"], trees=10)
    model.save(str(tmp_path / "m"))
    loaded = type(model).load(str(tmp_path / "m"))
    scores = lambda m: {r.transaction_id: r.probability for r in ml.score(m, rows).collect()}
    assert scores(model) == scores(loaded)
    (first, most), (_, least) = ml.importances(loaded, ["a", "b"])
    assert first == "a" and most > least and most + least == pytest.approx(1)
    scored = ml.score(loaded, rows).join(rows.select("transaction_id", "label"), "transaction_id")
    assert ml.roc_auc(scored) > 0.95
    report = {r.figure: r.value for r in ml.report(scored, loaded, ["a", "b"]).collect()}
    assert report["roc_auc"] > 0.95 and set(report) == {"roc_auc", "a", "b"}
    stored = ml.write_scores(scored, str(tmp_path / "scores"))
    assert stored.count() == 600 and set(stored.columns) == {"transaction_id", "probability", "decision"}
    assert stored.where("(decision = 'DECLINE') <> (probability > 0.8)").count() == 0


def test_roc_auc_equals_pairs(spark):
    rows = [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (0, 0.2), (1, 0.4)]
    pairs = [(p > q) + (p == q) / 2 for a, p in rows for b, q in rows if a and not b]
    assert ml.roc_auc(spark.createDataFrame(rows, "label int, probability double")) == pytest.approx(sum(pairs) / len(pairs))
    assert ml.roc_auc(spark.createDataFrame([(1, 0.5)], "label int, probability double")) != ml.roc_auc(spark.createDataFrame([(1, 0.5)], "label int, probability double"))


def test_split_of_one_instant(spark):
    rows = spark.range(50).select((F.col("id") * 37 % 50 - 25).alias("transaction_id"), F.lit(5).cast("long").alias("us"))
    assert sorted(r.transaction_id for r in ml.temporal_split(rows).where("train").collect()) == list(range(-25, 15))


def test_json_of_any_text(spark):
    texts = ["plain", 'say "a"', "back\\slash", "two\nlines", "é\u0001", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_of(F.col("t"), "string").alias("j"))
    import json

    for r in df.select("t", "j", json_scalar("j").alias("back")).collect():
        assert (json.loads(r.j) if r.j is not None else None) == r.t == r.back
    odd = spark.createDataFrame([(r'"a\nbé"',), ("null",), ("3",)], "j string").select(json_scalar("j").alias("s"))
    assert [r.s for r in odd.collect()] == ["a\nbé", None, "3"]


def test_busy_entity_is_linear(spark):
    rows = spark.range(100_000).select(
        F.col("id").alias("transaction_id"), F.lit("u").alias("entity_id"), (F.col("id") * 20_000_000).alias("us"), (F.col("id") % 97).cast("double").alias("amount")
    )
    got = rolling.rolling_features(rows).agg(F.sum("transaction_count_30d"), F.max("max_amount_30d"), F.max("total_amount_24h")).first()
    assert got[0] == sum(range(100_000)) and got[1] == 96.0


def test_broker_options():
    """The reader's options and the parse of its binary values, without a broker."""

    class Reader:
        def __init__(self):
            self.options = {}

        def format(self, kind):
            self.kind = kind
            return self

        def option(self, k, v):
            self.options[k] = v
            return self

        def load(self):
            return self

        def select(self, *columns):
            return self

    class Session:
        readStream = Reader()

    made = ingest.kafka_events(Session(), "broker:9092", "events", 500)
    assert made.kind == "kafka" and made.options == {"kafka.bootstrap.servers": "broker:9092", "subscribe": "events", "startingOffsets": "earliest", "maxOffsetsPerTrigger": 500}


def test_binary_lines_are_parsed(spark):
    line = b'{"event_id":"e1","event_type":"user_login","entity_id":"u","entity_type":"user","occurred_at":"2024-01-01T00:00:00","payload":{"device":"d"},"source":"s"}'
    raw = spark.createDataFrame([(bytearray(line),), (bytearray(b"no"),)], "value binary").select(F.col("value").cast("string").alias("value"))
    assert sorted((r.event_id, r.reason is None) for r in ingest.parse(raw).where("event_id IS NOT NULL").collect()) == [("e1", True)]


def test_engine_without_the_corpus_folders(tmp_path):
    """With both corpus folders gone all other queries are there."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print('rolling_features' in q, 'st_ingest' in s, any(n.startswith('op1') for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=False)
    assert out.stdout.split() == ["True", "True", "False", "False"], out.stderr


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_bursts_are_learned_from_what_came_before(spark):
    """One fit serves the three queries of the model; it tells bursts of later transactions."""
    import __spark_entry__

    run = lambda name: __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01").collect()
    report = {r.figure: r.value for r in run("rf_report")}
    assert report["roc_auc"] > 0.95
    row = run("rf_train")[0]
    assert row.recall > 0.8 and row.tp > 20 and len(run("rf_score")) == row.tp + row.fp + row.fn + row.tn


def test_transactions_of_one_instant_are_scored_once(spark, tmp_path):
    """Two transactions of an entity at the same instant are two rows of the model's table, not four."""
    from cairnflow.plans import stores

    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.floor(F.col("id") / 2) * 1_000_000_000)
    events = spark.range(400).select(
        F.col("id").alias("event_id"), at.cast("timestamp_ntz").alias("ts"), (F.floor(F.col("id") / 2) % 4).alias("user_id"), F.lit("purchase").alias("event_type"),
        (F.col("id") % 90 + 1).cast("double").alias("value"), F.concat(F.lit('{"k": '), F.col("id") % 5, F.lit("}")).alias("props"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    scored = [r.transaction_id for r in stores.rf_score(spark, str(tmp_path)).collect()]
    assert sorted(scored) == list(range(320, 400))
