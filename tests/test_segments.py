"""Stretches of time, two clocks, panes, holes and odd amounts, against plain forms."""

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairnflow.functions.columns import DAY, json_of
from cairnflow.operators import asof, backfill, rolling
from cairnflow.operators.batch import window_aggregates
from cairnflow.operators.segments import Running, running

START = datetime(2024, 1, 1)


def transactions(spark, seed, n=300, entities=3, amounts=None):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + timedelta(seconds=r.choice([r.randrange(40 * 86_400), 86_400 * r.randrange(40), 3600 * r.randrange(900)]))
        amount = r.choice(amounts) if amounts else r.choice([None, round(r.uniform(0, 500), 2)])
        rows.append((i, f"e{r.randrange(entities)}", at, int((at - datetime(1970, 1, 1)).total_seconds()) * 1_000_000, amount, r.choice(["", None, *(f"m{k}" for k in range(6))])))
    df = spark.createDataFrame(rows, "transaction_id long, entity_id string, timestamp timestamp, us long, amount double, merchant_id string")
    return df.withColumn("merchant_category", F.col("merchant_id")).withColumn("is_online", F.lit(False))


@pytest.mark.parametrize("stretch", [None, DAY, 9 * DAY])
def test_running_values_equal_plain_python(spark, stretch):
    df = transactions(spark, 1).drop("timestamp")
    of = {"s": Running("sum", F.col("amount")), "low": Running("min", F.col("amount")), "high": Running("max", F.col("amount")), "last": Running("last", F.col("merchant_id"))}
    rows = sorted(df.collect(), key=lambda r: (r.us, r.transaction_id))
    for current in (True, False):
        if not current:
            of.pop("last")
        got = {r.transaction_id: r for r in running(df, ["entity_id"], ["us", "transaction_id"], of, stretch, current=current).collect()}
        assert len(got) == len(rows)
        for i, row in enumerate(rows):
            so_far = [r for r in (rows[: i + 1] if current else rows) if r.entity_id == row.entity_id and (current or r.us < row.us)]
            seen = [r.amount for r in so_far if r.amount is not None]
            g = got[row.transaction_id]
            assert (g.low, g.high) == ((min(seen), max(seen)) if seen else (None, None))
            assert g.s == (pytest.approx(math.fsum(seen)) if seen else None)
            if current:
                named = [r.merchant_id for r in so_far if r.merchant_id is not None]
                assert g["last"] == (named[-1] if named else None)


def test_stretched_forms_equal_whole_ones(spark):
    df = transactions(spark, 2, amounts=[None, 0.1, 5.0, 70.0, 1e6])
    key = ["transaction_id"]
    for whole, cut, column in (
        (rolling.rolling_zscore(df), rolling.rolling_zscore(df, stretch=DAY), "amount_zscore"),
        (rolling.rolling_distinct(df), rolling.rolling_distinct(df, stretch=DAY), "unique_merchants_7d"),
    ):
        pairs = whole.select(*key, F.col(column).alias("a")).join(cut.select(*key, F.col(column).alias("b")), key).collect()
        assert len(pairs) == 300 and all(p.a == pytest.approx(p.b, rel=1e-6, abs=1e-9) for p in pairs)


@pytest.mark.parametrize("stretch", [None, 2 * DAY])
def test_values_computed_later_are_not_known(spark, stretch):
    r = random.Random(4)
    at = lambda h: START + timedelta(hours=h)
    log = [(f"e{r.randrange(2)}", "g", "v1", r.choice("xy"), str(i), at(h := r.randrange(200)), at(h + r.choice([0, 0, 5, 90, -3])), i) for i in range(150)]
    obs = [(i, f"e{r.randrange(3)}", r.randrange(220)) for i in range(80)]
    logged = spark.createDataFrame(log, "entity_id string, feature_group string, feature_version string, feature_name string, feature_value string, event_time timestamp, computed_at timestamp, event_id long")
    asked = spark.createDataFrame([(i, e, at(h)) for i, e, h in obs], "obs_id long, entity_id string, timestamp timestamp").withColumn("us", F.unix_micros("timestamp"))
    got = {g.obs_id: (g.x, g.y) for g in asof.as_of_join(asked, logged, ["x", "y"], known=True, stretch=stretch).collect()}
    one_clock = {g.obs_id: (g.x, g.y) for g in asof.as_of_join(asked, logged, ["x", "y"], stretch=stretch).collect()}
    leaks = {(g.obs_id, g.feature_name) for g in asof.leaking_values(asked, logged, ["x", "y"]).where("leaks").collect()}
    for i, e, h in obs:
        for f, value, plain in zip("xy", got[i], one_clock[i]):
            past = [v for v in log if v[0] == e and v[3] == f and v[5] <= at(h)]
            newest = lambda vs: max(vs, key=lambda v: (v[5], v[6], v[7]), default=None)
            best, known = newest(past), newest([v for v in past if v[6] <= at(h)])
            assert value == (known and known[4]) and plain == (best and best[4])
            assert ((i, f) in leaks) == (best is not None and best[6] > at(h))
    assert leaks and got != one_clock


def test_panes_equal_copies_of_transactions(spark):
    """Against the form that copies each transaction to every midnight that it feeds."""
    df, first, last = transactions(spark, 5, n=500), date(2024, 1, 3), date(2024, 2, 12)
    low, high = (F.lit((d - date(1970, 1, 1)).days) for d in (first, last))
    fed = df.withColumn("day", F.explode(F.sequence(F.greatest(F.ceil(F.col("us") / DAY), low.cast("long")).cast("long"), F.ceil(F.col("us") / DAY).cast("long") + 40)))
    fed = fed.where((F.col("day") <= high) & (F.col("us") >= F.col("day") * DAY - 31 * DAY))
    want = {(r.entity_id, r.day): tuple(r)[2:] for r in fed.groupBy("entity_id", "day").agg(*window_aggregates(F.col("day") * DAY)).collect()}
    got = {(r.entity_id, (r.as_of - date(1970, 1, 1)).days): tuple(r)[1:5] for r in backfill.backfill(df, first, last).collect()}
    assert set(got) == set(want) and len(got) > 100
    for k, row in want.items():
        assert got[k] == pytest.approx(row, rel=1e-9, abs=1e-6)


def test_holes_of_all_lengths(spark):
    r = random.Random(6)
    first, last = date(2024, 1, 1), date(2024, 1, 20)
    present = {(e, f): sorted(r.sample(range(-3, 25), r.choice([0, 1, 5, 15, 28]))) for e in "abcde" for f in "xy"}
    log = spark.createDataFrame([(e, f, START + timedelta(days=d, hours=5)) for (e, f), days in present.items() for d in days], "entity_id string, feature_name string, event_time timestamp")
    expected = spark.createDataFrame([(e, f) for e in "abcdz" for f in "xy"], "entity_id string, feature_name string")
    got = sorted((h.entity_id, h.feature_name, h.first, h.last) for h in backfill.holes(log, expected, first, last).select("entity_id", "feature_name", F.col("first"), F.col("last")).collect())
    want = []
    for e in "abcdz":
        for f in "xy":
            missing = [d for d in range(20) if d not in present.get((e, f), [])]
            for d in missing:
                if d - 1 in missing:
                    want[-1] = (*want[-1][:3], first + timedelta(days=d))
                else:
                    want.append((e, f, first + timedelta(days=d), first + timedelta(days=d)))
    assert got == sorted(want)


@pytest.mark.parametrize("amounts", [[1.0, 2.5, float("nan")], [1.0, float("inf"), float("-inf")], [1.0, 1e19, 3.0], [1e-12, 2e-12, 0.0], [1.0, None, 0.001], [1e300, 5.0]])
def test_odd_amounts_show_in_their_own_windows_only(spark, amounts):
    df = transactions(spark, 7, n=120, amounts=amounts)
    rows = df.collect()
    for g in rolling.rolling_features(df).collect():
        inside = lambda days: [r for r in rows if r.entity_id == g.entity_id and g.us - days * DAY < r.us < g.us]  # noqa: E731, B023
        for days, value, mean in ((1, g.total_amount_24h, False), (7, g.avg_amount_7d, True)):
            seen = [r.amount for r in inside(days) if r.amount is not None]
            total = math.nan if any(map(math.isnan, seen)) or {math.inf, -math.inf} <= set(seen) else sum(seen)
            want = (total / len(seen) if mean else total) if seen else 0.0
            assert value == pytest.approx(want, rel=1e-9, abs=1e-15, nan_ok=True)
        assert (g.transaction_count_24h, g.transaction_count_30d) == (len(inside(1)), len(inside(30)))


def test_numbers_that_are_not_finite_are_strings_in_json(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r.j for r in df.select(json_of(F.col("v"), "double").alias("j")).collect()] == ["1.5", '"NaN"', '"Infinity"', None]


@pytest.mark.parametrize("bucket", [None, 15 * DAY])
def test_tasks_of_rolling_features_grow_with_the_rows(spark, monkeypatch, bucket):
    from cairnflow.operators import segments

    monkeypatch.setattr(segments, "ROWS_OF_A_TASK", 20)
    t = F.timestamp_micros(F.col("id") * 3_600_000_000)
    rows = spark.range(600).select(
        F.col("id").alias("transaction_id"), (F.col("id") % 50).cast("string").alias("entity_id"), (F.col("id") * 3_600_000_000).alias("us"),
        t.alias("timestamp"), F.lit(1.5).alias("amount"),
    )
    features = rolling.rolling_features(rows, bucket)
    assert features.rdd.getNumPartitions() >= 30 and features.count() == 600


@pytest.mark.parametrize("amounts", [[0.5, 5.0, 70.0], [None, 0.5, 5.0, math.nan]])
def test_all_features_equal_their_parts(spark, amounts):
    """Ties, null merchants and odd amounts included; without odd amounts from one shuffle."""
    df, key = transactions(spark, 3, amounts=amounts), list(rolling.KEYS)
    made = rolling.all_features(df)
    parts = rolling.rolling_features(df).join(rolling.rolling_distinct(df), key).join(rolling.rolling_zscore(df), key)
    assert made.columns == parts.columns
    rows = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) and v == v else str(v) for v in r) for r in d.collect())
    assert rows(made) == rows(parts) and made.count() == 300
    if not any(a is None for a in amounts):
        plan = rolling.all_features(df)._jdf.queryExecution().executedPlan().toString()  # not run yet: the first plan only
        assert plan.count("Exchange") == 1 and "Join" not in plan
