"""The latest value of every feature, with expiry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.functions.columns import json_scalar
from cairnflow.operators.asof import as_of_join
from cairnflow.operators.validate import errors

HASH = ["entity_id", "feature_group"]
DEFAULT_TTL = 3600


def latest(log: DataFrame, ttl_seconds: int | None = DEFAULT_TTL) -> DataFrame:
    """Of each feature the value with the newest event time, then the newest computation. A group of an entity expires
    as a whole, ttl after its last write; no ttl, or 0: never."""
    newest = F.max_by(F.struct("feature_value", "event_time"), F.struct("event_time", "computed_at", "event_id"))
    values = log.groupBy(*HASH, "feature_name").agg(newest.alias("n"), F.max("event_time").alias("written_at"))
    hashes = values.groupBy(*HASH).agg(F.max("written_at").alias("last_written"))
    never = F.lit(None).cast("timestamp")
    expires = F.col("last_written") + F.make_interval(secs=F.lit(ttl_seconds)) if ttl_seconds and ttl_seconds > 0 else never
    return values.join(hashes, HASH).select(*HASH, "feature_name", "n.feature_value", "written_at", "last_written", expires.alias("expires_at"))


def accepted(log: DataFrame, definitions: DataFrame) -> DataFrame:
    """The rows of a log that break no rule: what may be written online."""
    return errors(log, definitions).where(F.size("errors") == 0).drop("errors")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two tables of latest values as one: newer values win, and the later write sets the expiry."""
    both = old.unionByName(new)
    values = both.groupBy(*HASH, "feature_name").agg(F.max_by(F.struct("feature_value", "written_at"), "written_at").alias("n"))
    hashes = both.groupBy(*HASH).agg(F.max("last_written").alias("last_written"), F.max_by("expires_at", "last_written").alias("expires_at"))
    return values.join(hashes, HASH).select(*HASH, "feature_name", "n.feature_value", "n.written_at", "last_written", "expires_at")


def alive(online: DataFrame, as_of: datetime) -> DataFrame:
    return online.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp")))


def multi_get(online: DataFrame, requested: DataFrame, group: str, features: list[str]) -> DataFrame:
    """A row for each requested entity that has any of the features; the others it lacks are null."""
    rows = online.where((F.col("feature_group") == group) & F.col("feature_name").isin(features))
    rows = rows.join(requested.select("entity_id").distinct(), "entity_id", "left_semi")
    wide = rows.groupBy("entity_id").pivot("feature_name", features).agg(F.first(json_scalar("feature_value")))
    return wide.where(F.coalesce(*features).isNotNull())


def delete(online: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the (entity, group) pairs in gone."""
    return online.join(gone.select(*HASH).distinct(), HASH, "left_anti")


def freshness(online: DataFrame, as_of: datetime) -> DataFrame:
    """Seconds left (-1: no expiry) and seconds since the last write of each entity's group."""
    now = F.unix_seconds(F.lit(as_of).cast("timestamp"))
    hashes = online.groupBy(*HASH).agg(F.max("last_written").alias("last_written"), F.max("expires_at").alias("expires_at"))
    left = F.when(F.col("expires_at").isNull(), F.lit(-1)).otherwise(F.greatest(F.lit(0), F.unix_seconds("expires_at") - now))
    return hashes.select(
        *HASH, left.cast("long").alias("ttl_left"), (now - F.unix_seconds("last_written")).alias("staleness"),
        (F.col("expires_at").isNull() | (F.unix_seconds("expires_at") > now)).alias("is_fresh"),
    )


def read_with_fallback(online: DataFrame, log: DataFrame, requested: DataFrame, group: str, features: list[str], as_of: datetime) -> DataFrame:
    """Entities with live online values from there (cache_hit), the others from history as of now."""
    hits = multi_get(alive(online, as_of), requested, group, features).withColumn("cache_hit", F.lit(True))
    asked = requested.select("entity_id").distinct()
    misses = asked.join(hits, "entity_id", "left_anti").withColumn("us", F.unix_micros(F.lit(as_of).cast("timestamp")))
    past = as_of_join(misses, log, features, group, keys=("entity_id", "us")).drop("us")
    past = past.select("entity_id", *(json_scalar(f).alias(f) for f in features), F.lit(False).alias("cache_hit"))
    return hits.unionByName(past)


def read_feature_fallback(online: DataFrame, log: DataFrame, requested: DataFrame, group: str, features: list[str], as_of: datetime) -> DataFrame:
    """Every requested entity; each feature from the online table, or from history where it is missing there."""
    asked = requested.select("entity_id").distinct()
    now = multi_get(alive(online, as_of), asked, group, features).select("entity_id", *(F.col(f).alias(f"{f}_now") for f in features))
    timed = asked.withColumn("us", F.unix_micros(F.lit(as_of).cast("timestamp")))
    past = as_of_join(timed, log, features, group, keys=("entity_id", "us")).drop("us")
    return past.join(now, "entity_id", "left").select("entity_id", *(F.coalesce(f"{f}_now", json_scalar(f)).alias(f) for f in features))
