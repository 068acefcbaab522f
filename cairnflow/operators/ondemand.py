"""Features from stored statistics and the transaction at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zscore(amount: Column, mean: Column, deviation: Column) -> Column:
    return F.when(deviation > 0, (amount - mean) / deviation).otherwise(F.lit(0.0))


def new_merchant(known: Column, merchant: Column) -> Column:
    return F.coalesce(~F.array_contains(known, merchant), F.lit(True))


def high_risk_time(hours: Column, ts: Column) -> Column:
    return F.coalesce((F.size(hours) > 0) & ~F.array_contains(hours, F.hour(ts)), F.lit(False))


def merchant_deviation(amount: Column, average: Column) -> Column:
    return F.coalesce(amount - average, F.lit(0.0))


def with_stored(transactions: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Every transaction, with the stored values of its keys where there are any."""
    return transactions.join(stored, keys, "left")
