"""Edges of the rolling windows, and two ways to the same result."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairnflow.functions.columns import DAY, micros
from cairnflow.operators import rolling

T = datetime(2024, 3, 1, 12)
US = timedelta(microseconds=1)


def txns(spark, *rows):
    """(entity, time, amount, merchant)"""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "transaction_id long, entity_id string, timestamp timestamp, amount double, merchant_id string")
    return df.withColumn("us", micros("timestamp")).withColumn("merchant_category", F.col("merchant_id"))


def result(df, column):
    return [r[column] for r in df.orderBy("transaction_id").collect()]


@pytest.mark.parametrize(("gap", "expected"), [(timedelta(days=1), 0), (timedelta(days=1) - US, 1), (timedelta(0), 0)])
def test_window_ends_are_outside(spark, gap, expected):
    rows = rolling.rolling_features(txns(spark, ("u", T - gap, 1.0, "a"), ("u", T, 2.0, "a")))
    assert result(rows, "transaction_count_24h")[1] == expected


def test_empty_window_has_zeros(spark):
    row = rolling.rolling_features(txns(spark, ("u", T, 2.0, "a"))).first()
    assert (row.total_amount_24h, row.avg_amount_7d, row.max_amount_30d, row.transactions_last_hour) == (0.0, 0.0, 0.0, 0)


def test_same_instant_sees_nothing_of_the_other(spark):
    rows = txns(spark, ("u", T, 1.0, "a"), ("u", T, 2.0, "b"), ("u", T + US, 3.0, "a"))
    assert result(rolling.rolling_features(rows), "transaction_count_7d") == [0, 0, 2]
    assert result(rolling.rolling_distinct(rows), "unique_merchants_7d") == [0, 0, 2]


@pytest.mark.parametrize(("amounts", "expected"), [((10.0,), 0.0), ((5.0, 5.0, 9.0), 0.0), ((10.0, 20.0, 30.0), 3.0)])
def test_zscore(spark, amounts, expected):
    rows = txns(spark, *(("u", T + i * timedelta(hours=1), a, "m") for i, a in enumerate(amounts)))
    assert result(rolling.rolling_zscore(rows), "amount_zscore")[-1] == pytest.approx(expected)


def test_sweep_equals_sets(spark):
    rows = txns(spark, *(("u%d" % (i % 3), T + timedelta(hours=(i * 37) % 400), 1.0, "m%d" % (i * i % 5) if i % 9 else None) for i in range(150)))
    sets = rolling.distinct_by_sets(rows, "merchant_id", 2 * DAY, "n")
    sweep = rolling.distinct_by_sweep(rows, "merchant_id", 2 * DAY, "n")
    assert result(sets, "n") == result(sweep, "n")


def test_buckets_equal_whole_entities(spark):
    rows = txns(spark, *(("u", T + timedelta(hours=(i * 53) % 2000), float(i), "m") for i in range(200)))
    a, b = (sorted(map(tuple, rolling.rolling_features(rows, bucket=k).collect())) for k in (None, 5 * DAY))
    assert [(r[:5], r[8:]) for r in a] == [(r[:5], r[8:]) for r in b]


def test_new_merchant(spark):
    rows = txns(spark, ("u", T, 1.0, "a"), ("u", T + US, 1.0, "a"), ("v", T + US, 1.0, "a"))
    assert result(rolling.is_new_merchant(rows), "is_new_merchant") == [True, False, True]
