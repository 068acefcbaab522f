"""Small cases of the other operators."""

import hashlib
import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairnflow.functions.columns import decision, md5_bucket, micros
from cairnflow.operators import asof, backfill, batch, catalog, experiments, history, ml, ondemand, online, validate
from cairnflow.sources import ingest

T = datetime(2024, 3, 1)
HOUR = timedelta(hours=1)
LOG = "entity_id string, feature_group string, feature_version string, feature_name string, feature_value string, event_time timestamp, computed_at timestamp, event_id long"


def log(spark, *rows):
    """(entity, feature, value, event time, computed time)"""
    return spark.createDataFrame([(e, "g", "v1", f, v, t, c, i) for i, (e, f, v, t, c) in enumerate(rows)], LOG)


def obs(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "obs_id long, entity_id string, timestamp timestamp")
    return df.withColumn("us", micros("timestamp"))


def txns(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "transaction_id long, entity_id string, timestamp timestamp, amount double, merchant_id string")
    return df.withColumn("us", micros("timestamp")).withColumn("merchant_category", F.lit("c"))


def test_as_of_join(spark):
    known = log(spark, ("u", "f", "1", T, T), ("u", "f", "2", T + HOUR, T), ("u", "f", "null", T + 2 * HOUR, T), ("u", "g", "7", T + 9 * HOUR, T))
    asked = obs(spark, ("u", T + HOUR), ("u", T + HOUR), ("u", T + 2 * HOUR), ("u", T - HOUR), ("w", T))
    got = {r.obs_id: (r.f, r.g) for r in asof.as_of_join(asked, known, ["f", "g"]).collect()}
    assert got == {0: ("2", None), 1: ("2", None), 2: ("null", None), 3: (None, None), 4: (None, None)}
    filled = {r.obs_id: r.f for r in asof.as_of_join(asked, known, ["f"], fill="0").collect()}
    assert filled == {0: "2", 1: "2", 2: "null", 3: "0", 4: "0"}
    young = {r.obs_id: r.f for r in asof.as_of_join(obs(spark, ("u", T + timedelta(days=3))), known, ["f"], max_age=asof.age_limit(1)).collect()}
    assert young == {0: None}


def test_as_of_ties_go_to_the_later_computation(spark):
    known = log(spark, ("u", "f", "new", T, T + 2 * HOUR), ("u", "f", "old", T, T + HOUR))
    assert asof.as_of_join(obs(spark, ("u", T)), known, ["f"]).first().f == "new"


def test_late_arrivals_and_newly_present(spark):
    known = log(spark, ("u", "f", "1", T - HOUR, T + HOUR), ("u", "g", "1", T - HOUR, T - HOUR), ("u", "h", "1", T + HOUR, T + HOUR), ("u", "f", "1", T - HOUR, T + timedelta(days=30)))
    assert [tuple(r) for r in asof.late_arrivals(known, T).collect()] == [("u", ["f"])]
    assert [tuple(r) for r in asof.newly_present(known, T).collect()] == [("u", "h")]


def test_batch_window_edges(spark):
    week = timedelta(days=7)
    rows = txns(spark, ("u", T - week, 10.0, "a"), ("u", T, 20.0, ""), ("v", T - timedelta(days=20), 5.0, "b"), ("w", T - timedelta(days=40), 5.0, "b"))
    got = {r.entity_id: tuple(r)[1:] for r in batch.user_aggregates(rows, T, T).collect()}
    assert got["u"] == (15.0, pytest.approx(math.sqrt(50)), 1, 30.0)
    assert got["v"] == (0.0, 0.0, 1, 5.0)
    assert "w" not in got
    assert {r.entity_id for r in batch.user_aggregates(rows, T, T, None).collect()} == {"u", "v", "w"}


def test_backfill_equals_day_by_day(spark):
    rows = txns(spark, *(("u%d" % (i % 2), T + timedelta(hours=(i * 31) % 900), float(i), "m%d" % (i % 4)) for i in range(80)), ("u0", T + timedelta(days=3), 9.0, "x"), ("u0", T + timedelta(days=3, microseconds=1), 9.0, "y"))
    days = [T.date() + timedelta(days=d) for d in range(12)]
    got = {(r.entity_id, r.as_of): r for r in backfill.backfill(rows, days[0], days[-1]).collect()}
    n = 0
    for d in days:
        at = datetime(d.year, d.month, d.day)
        for r in batch.user_aggregates(rows, at - timedelta(days=1), at).collect():
            n += 1
            g = got[r.entity_id, d]
            assert (g.unique_merchants_30d, g.avg_transaction_amount_7d, g.user_lifetime_value) == (r.unique_merchants_30d, pytest.approx(r.avg_transaction_amount_7d), pytest.approx(r.user_lifetime_value))
    assert n == len(got)


def test_backfill_skips_done_days(spark):
    rows = txns(spark, ("u", T, 1.0, "a"))
    done = spark.createDataFrame([(date(2024, 3, 2),)], "as_of date")
    assert sorted(r.as_of.day for r in backfill.backfill(rows, date(2024, 3, 1), date(2024, 3, 3), done).collect()) == [1, 3]


def test_ondemand(spark):
    row = spark.range(1).select(
        ondemand.zscore(F.lit(5.0), F.lit(None).cast("double"), F.lit(1.0)).alias("a"), ondemand.zscore(F.lit(5.0), F.lit(3.0), F.lit(0.0)).alias("b"),
        ondemand.new_merchant(F.lit(None).cast("array<string>"), F.lit("m")).alias("c"), ondemand.high_risk_time(F.array().cast("array<int>"), F.lit(T)).alias("d"),
        ondemand.high_risk_time(F.array(F.lit(5)), F.lit(T)).alias("e"), ondemand.merchant_deviation(F.lit(5.0), F.lit(None).cast("double")).alias("f"),
    ).first()
    assert (row.b, row.c, row.d, row.e, row.f) == (0.0, True, False, True, 0.0)


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def event(payload, kind="transaction_created"):
    return '{"event_id":"1","event_type":"%s","entity_id":"u","entity_type":"user","occurred_at":"2024-03-01T00:00:00Z","more":1,"payload":%s}' % (kind, payload)


def test_parse_and_transform(spark):
    parsed = ingest.parse(lines(spark, event("{}"), event('{"amount":"99.99"}'), event('{"amount":"x"}'), event('{"amount":null}'), "{broken", event("{}").replace('"u"', "null"), event("{}").replace("2024-03-01", "soon")))
    assert [r.reason for r in parsed.collect()][:4] == [None] * 4
    assert ingest.dead_letters(parsed).count() == 3
    rows = ingest.transform_transactions(parsed.where("reason IS NULL")).collect()
    first = rows[0]
    assert (first.transaction_amount, first.transaction_currency, first.merchant_id, first.merchant_category, first.is_online) == (0.0, "USD", "", "unknown", False)
    assert rows[1].transaction_amount == 99.99
    assert rows[2].reason and rows[3].reason
    profile = ingest.transform_profiles(ingest.parse(lines(spark, event('{"kyc_verified":"false"}', "user_profile_updated")))).first()
    assert (profile.kyc_verified, profile.account_age_days) == (False, 0)


def test_validation_rules(spark):
    defs = validate.definitions(spark)
    cases = [
        ("transaction", "transaction_currency", '"USD"', []), ("transaction", "transaction_currency", '"usd"', ["transaction_currency: pattern mismatch"]),
        ("transaction", "nope", "1", ["nope: unknown feature"]), ("transaction", "transaction_amount", "3", []), ("transaction", "transaction_amount", None, ["transaction_amount: null value"]),
        ("transaction", "transaction_amount", "-1", ["transaction_amount: below minimum"]), ("transaction", "transaction_amount", "1000000", []),
        ("transaction", "transaction_amount", '"x"', ["transaction_amount: wrong type"]), ("user", "account_age_days", "1.5", ["account_age_days: wrong type"]),
        ("transaction", "merchant_id", None, []), ("user", "login_device", "null", []),
    ]
    rows = spark.createDataFrame([(i, g, "v1", n, v) for i, (g, n, v, _) in enumerate(cases)], "i int, feature_group string, feature_version string, feature_name string, feature_value string")
    got = {r.i: r.errors for r in validate.errors(rows, defs).collect()}
    assert got == {i: e for i, (*_, e) in enumerate(cases)}


def test_reconcile_is_close(spark):
    make = lambda *v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "k int, f double")
    got = {r.k: r.agrees for r in validate.reconcile(make(101.0, 101.02, None, None), make(100.0, 100.0, 1.0, None), ["k"], ["f"]).collect()}
    assert got == {0: True, 1: math.isclose(101.02, 100.0, rel_tol=0.01, abs_tol=0.01), 2: False, 3: True}


def test_history_round_trip(spark):
    rows = spark.createDataFrame([("u", T, 1.5, 'say "hi" \\ there', True), ("v", T, None, None, None)], "entity_id string, event_time timestamp, a double, b string, c boolean")
    long = history.unpivot(rows, ["a", "b", "c"], ["entity_id", "event_time"])
    assert [tuple(r)[2:] for r in history.pivot(long, ["a", "b", "c"]).collect()] == [("1.5", 'say "hi" \\ there', "true")]


def test_insert_and_upsert(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "k string, v int")
    assert [tuple(r) for r in history.insert_if_absent(old, new, ["k"], [F.col("v")]).collect()] == [("b", 3)]
    assert sorted(map(tuple, history.upsert(old, new, ["k"], [F.desc("v")]).collect())) == [("a", 2), ("b", 4)]


def test_online_expiry_and_fallback(spark):
    known = log(spark, ("u", "f", "1", T, T), ("v", "f", "2", T - timedelta(days=9), T), ("u", "h", "3", T - timedelta(days=9), T))
    table = online.latest(known, 7 * 86400)
    asked = spark.createDataFrame([("u",), ("v",), ("w",)], "entity_id string")
    got = {r.entity_id: (r.f, r.h, r.cache_hit) for r in online.read_with_fallback(table, known, asked, "g", ["f", "h"], T + HOUR).collect()}
    assert got == {"u": ("1", "3", True), "v": ("2", None, False), "w": (None, None, False)}
    assert [r.entity_id for r in online.multi_get(online.alive(table, T + HOUR), asked, "g", ["f"]).collect()] == ["u"]
    assert {r.ttl_left for r in online.freshness(online.latest(known, 0), T).collect()} == {-1}


def test_bucket_equals_python(spark):
    row = spark.range(1).select(md5_bucket(F.lit("split_test:user_1"), 10_000).alias("b")).first()
    assert row.b == int(hashlib.md5(b"split_test:user_1").hexdigest()[:8], 16) % 10_000 == 6506


def test_variants(spark):
    users = spark.range(10_000).select(F.concat(F.lit("user_"), "id").alias("u"))
    share = users.select(experiments.variant(F.col("u"), "t", [("control", 0.5), ("x", 0.5)]).alias("v")).where("v = 'x'").count() / 10_000
    assert abs(share - 0.5) < 0.05
    assert users.select(experiments.variant(F.col("u"), "t", [("x", 1.0)], running=False).alias("v")).distinct().first().v == "control"


def test_z_test_p_value(spark):
    rows = spark.createDataFrame([("e", "m", v, float(x)) for v, n in (("control", 0), ("x", 1)) for x in range(n, n + 20)], "experiment string, metric string, variant string, value double")
    r = experiments.z_test(rows).first()
    assert r.p_value == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)))


def test_decision_edges(spark):
    rows = spark.createDataFrame([(0.81,), (0.80,), (0.50,)], "p double").select(decision(F.col("p")).alias("d"))
    assert [r.d for r in rows.collect()] == ["DECLINE", "REVIEW", "APPROVE"]


def test_lineage_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "feature string, depends_on string")
    got = {tuple(r) for r in catalog.lineage(edges).collect()}
    assert got == {(x, y) for x in "abcd" for y in "abc"}


def test_temporal_split_with_ties(spark):
    rows = txns(spark, *(("u", T + (i // 4) * HOUR, 1.0, "m") for i in range(10)))
    assert [r.transaction_id for r in ml.temporal_split(rows).where("train").orderBy("transaction_id").collect()] == list(range(8))
    assert ml.temporal_split(rows.limit(0)).count() == 0
