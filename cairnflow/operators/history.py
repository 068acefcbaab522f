"""The append-only history of feature values, and its bridges to wide tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.functions.columns import json_of, json_scalar
from cairnflow.operators.rolling import newest_per_key

KEY = ["entity_id", "feature_group", "feature_version", "feature_name", "event_time"]


def unpivot(records: DataFrame, features: list[str], ids: list[str]) -> DataFrame:
    """A row for each feature that has a value, as JSON."""
    kinds = dict(records.dtypes)
    pairs = F.array(*(F.struct(F.lit(f).alias("feature_name"), json_of(F.col(f), kinds[f]).alias("feature_value")) for f in features))
    return records.select(*ids, F.inline(pairs)).where("feature_value IS NOT NULL")


def pivot(log: DataFrame, features: list[str], keys: tuple[str, ...] = ("entity_id", "event_time")) -> DataFrame:
    """A column for each feature, with the first value that isn't null; keys without any value vanish."""
    value = json_scalar("feature_value")
    wide = log.where(F.col("feature_name").isin(features)).groupBy(*keys).pivot("feature_name", features).agg(F.first(value, ignorenulls=True))
    return wide.where(F.coalesce(*features).isNotNull())


def coerced(df: DataFrame, features: list[str]) -> DataFrame:
    """Numbers, with 0 for what isn't one and for columns that are missing."""
    return df.withColumns({f: F.coalesce(F.col(f).try_cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0) for f in features})


def with_times(records: DataFrame) -> DataFrame:
    """The event time defaults to the time of computation."""
    return records.withColumn("event_time", F.coalesce("event_time", "computed_at"))


def append(log: DataFrame, path: str) -> None:
    """Append to the history, in folders by event date."""
    log.withColumn("event_date", F.to_date("event_time")).write.mode("append").partitionBy("event_date").parquet(path)


def group_table(log: DataFrame, group: str, path: str) -> DataFrame:
    """The history of one feature group as a table of its own, in folders by event date; gives what is stored."""
    append(log.where(F.col("feature_group") == group), f"{path}/features_{group}")
    return log.sparkSession.read.parquet(f"{path}/features_{group}")


def scan(
    log: DataFrame, start: datetime, end: datetime, features: list[str] | None = None, group: str | None = None, entities: DataFrame | None = None
) -> DataFrame:
    """History from start to end, both included; no features, or no entities, means all of them."""
    rows = log.where(F.col("event_time").between(F.lit(start), F.lit(end)))
    if "event_date" in log.columns:
        rows = rows.where(F.col("event_date").between(F.lit(start.date()), F.lit(end.date())))
    if features:
        rows = rows.where(F.col("feature_name").isin(features))
    if group:
        rows = rows.where(F.col("feature_group") == group)
    return rows if entities is None else rows.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The rows to append: of each new key the first, unless the key is there already."""
    return newest_per_key(new, key, order).join(old.select(*key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The table after the new rows: of each key the last written, new before old."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return newest_per_key(both, key, [F.desc("_new"), *order]).drop("_new")


def retained(log: DataFrame, as_of: datetime, keep_days: int = 90) -> DataFrame:
    """History no older than some days before as_of."""
    return log.where(F.to_date("event_time") >= F.date_sub(F.lit(as_of.date()), keep_days))
