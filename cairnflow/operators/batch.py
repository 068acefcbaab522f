"""Aggregates of entities as of a time."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.functions.columns import DAY
from cairnflow.operators.history import unpivot


class BatchJob(Protocol):
    """A job computes features as of a time; its result is written as history (see history.append)."""

    def compute(self, transactions: DataFrame, as_of: datetime) -> DataFrame: ...


class UserAggregates:
    """The four user aggregates as a job."""

    def compute(self, transactions: DataFrame, as_of: datetime) -> DataFrame:
        return user_aggregates(transactions, as_of, as_of)


class DailyCount:
    def compute(self, transactions: DataFrame, as_of: datetime) -> DataFrame:
        return daily_count(transactions, as_of)


JOBS: dict[str, BatchJob] = {"user_aggregates": UserAggregates(), "daily_count": DailyCount()}
"""Jobs by name. Further jobs are added by further entries."""


def run_jobs(transactions: DataFrame, as_of: datetime, jobs: dict[str, BatchJob] = JOBS) -> DataFrame:
    """The features of all jobs as history: entity_id, job, feature_name, feature_value (JSON), event_time."""
    out: DataFrame | None = None
    for name, job in jobs.items():
        made = job.compute(transactions, as_of)
        long = unpivot(made.withColumn("job", F.lit(name)), [c for c in made.columns if c != "entity_id"], ["entity_id", "job"])
        out = long if out is None else out.unionByName(long)
    assert out is not None, "no job"
    return out.withColumn("event_time", F.lit(as_of).cast("timestamp"))


def _at(t: datetime) -> Column:
    return F.unix_micros(F.lit(t).cast("timestamp"))


def window_aggregates(at: Column) -> list[Column]:
    """The four user aggregates as of a time column; both ends of the windows belong to them."""
    week, month = F.col("us") >= at - 7 * DAY, F.col("us") >= at - 30 * DAY
    amount = F.col("amount")
    return [
        F.coalesce(F.avg(F.when(week, amount)), F.lit(0.0)).alias("avg_transaction_amount_7d"),
        F.coalesce(F.stddev_samp(F.when(week, amount)), F.lit(0.0)).alias("std_transaction_amount_7d"),
        F.count_distinct(F.when(month & (F.col("merchant_id") != ""), F.col("merchant_id"))).alias("unique_merchants_30d"),
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("user_lifetime_value"),
    ]


def user_aggregates(transactions: DataFrame, start: datetime, as_of: datetime, history_days: int | None = 30) -> DataFrame:
    """One row per entity seen in [start - history_days, as_of]; None: in all history up to as_of."""
    rows = transactions.where(F.col("us") <= _at(as_of))
    if history_days is not None:
        rows = rows.where(F.col("us") >= _at(start - timedelta(days=history_days)))
    return rows.groupBy("entity_id").agg(*window_aggregates(_at(as_of)))


def daily_count(transactions: DataFrame, as_of: datetime) -> DataFrame:
    recent = (F.col("us") > _at(as_of) - DAY) & (F.col("us") <= _at(as_of))
    return transactions.groupBy("entity_id").agg(F.count(F.when(recent, 1)).alias("transaction_count_24h"))


def _month(transactions: DataFrame, as_of: datetime) -> DataFrame:
    return transactions.where((F.col("us") >= _at(as_of) - 30 * DAY) & (F.col("us") <= _at(as_of)))


def typical_hours(transactions: DataFrame, as_of: datetime) -> DataFrame:
    """Hours with at least a 24th of an entity's transactions of 30 days."""
    hours = _month(transactions, as_of).groupBy("entity_id", F.hour("timestamp").alias("hour")).count()
    total = F.sum("count").over(Window.partitionBy("entity_id"))
    frequent = hours.withColumn("total", total).where(F.col("count") * 24 >= F.col("total"))
    return frequent.groupBy("entity_id").agg(F.sort_array(F.collect_list("hour")).alias("typical_active_hours"))


def category_frequency(transactions: DataFrame, as_of: datetime) -> DataFrame:
    counts = _month(transactions, as_of).groupBy("entity_id", "merchant_category").count()
    share = F.col("count") / F.sum("count").over(Window.partitionBy("entity_id"))
    return counts.select("entity_id", "merchant_category", share.alias("merchant_category_frequency"))


def known_merchants(transactions: DataFrame, as_of: datetime) -> DataFrame:
    seen = transactions.where(F.col("us") < _at(as_of)).groupBy("entity_id")
    return seen.agg(F.sort_array(F.collect_set("merchant_id")).alias("known_merchant_ids"))


def merchant_averages(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("entity_id", "merchant_id").agg(F.avg("amount").alias("merchant_avg_amount"))


def last_values(transactions: DataFrame) -> DataFrame:
    newest = F.struct("us", "transaction_id")
    return transactions.groupBy("entity_id").agg(
        F.max_by("amount", newest).alias("last_transaction_amount"), F.max_by("merchant_id", newest).alias("last_transaction_merchant")
    )


def session_counts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    sessions = events.groupBy("entity_id", F.session_window("timestamp", gap).alias("session")).agg(F.count("*").alias("events"))
    return sessions.groupBy("entity_id").agg(F.count("*").alias("session_count"), F.max("events").alias("longest_session"))


def rolling_as_of(rows: DataFrame, as_of: datetime, hours: int, value: str = "amount") -> DataFrame:
    """Count, sum, mean and sample deviation of the values from as_of - hours on (no upper end)."""
    inside = F.col("us") >= _at(as_of) - hours * 3_600_000_000
    v = F.when(inside, F.col(value))
    return rows.groupBy("entity_id").agg(
        F.count(v).alias("rolling_count"), F.coalesce(F.sum(v), F.lit(0.0)).alias("rolling_sum"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("rolling_avg"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("rolling_std"),
    )


def coverage(log: DataFrame, expected: DataFrame, group: str, start: datetime, end: datetime) -> DataFrame:
    """Rows of each expected entity in a period; a missing one has none."""
    inside = log.where((F.col("feature_group") == group) & F.col("event_time").between(F.lit(start), F.lit(end)))
    counts = inside.groupBy("entity_id").agg(F.count("*").alias("rows"))
    return expected.select("entity_id").distinct().join(counts, "entity_id", "left").select("entity_id", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def coverage_share(covered: DataFrame) -> DataFrame:
    present = F.count(F.when(F.col("rows") > 0, 1))
    return covered.agg(
        F.count("*").alias("expected"), present.alias("present"), (F.count("*") - present).alias("missing"),
        (100.0 * present / F.greatest(F.count("*"), F.lit(1))).alias("coverage_pct"),
    )
