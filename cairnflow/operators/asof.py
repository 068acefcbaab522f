"""Point-in-time joins: what was known of an entity at a time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.functions.columns import DAY, micros
from cairnflow.operators.segments import Running, running

STEP = "struct<event_us:bigint,computed_us:bigint,seq:bigint,value:string>"


def as_of_join(
    observations: DataFrame,
    log: DataFrame,
    features: list[str],
    group: str | None = None,
    max_age: int | None = None,
    fill: str | None = None,
    keys: tuple[str, ...] = ("obs_id", "entity_id", "us"),
    known: bool = False,
    stretch: int | None = None,
) -> DataFrame:
    """Of each observation and feature the newest value with event time at or before it; every observation stays.

    Both sides go through one running window by entity and time, log rows in front of observations of the same instant and
    by computed_at among themselves: one shuffle, no pairs. Values travel in a struct, so a stored JSON null is a value.
    max_age: microseconds after which a value counts as missing. fill: JSON in place of missing values. known: only values
    that were there at the time of the observation, computed_at at or before it, count: of those the one with the newest
    event. stretch: microseconds of a stretch of time, for entities too busy for one task (see segments)."""
    known_rows = log.where(F.col("feature_name").isin(features))
    if group is not None:
        known_rows = known_rows.where(F.col("feature_group") == group)
    none = F.lit(None)
    left = observations.select(
        *keys, F.lit(1).alias("_kind"), none.cast("long").alias("_at"), none.cast("long").alias("_seq"), *(none.cast(STEP).alias(f) for f in features)
    )
    event, computed = micros("event_time"), micros("computed_at")
    value = F.struct(event.alias("event_us"), computed.alias("computed_us"), F.col("event_id").cast("long").alias("seq"), F.col("feature_value").alias("value"))
    seen = F.greatest(event, computed) if known else event
    right = known_rows.select(
        *(seen.alias("us") if k == "us" else F.col("entity_id") if k == "entity_id" else none.cast(observations.schema[k].dataType).alias(k) for k in keys),
        F.lit(0).alias("_kind"), computed.alias("_at"), F.col("event_id").cast("long").alias("_seq"),
        *(F.when(F.col("feature_name") == f, value).alias(f) for f in features),
    )
    # What was known is not in the order of events: the newest event so far is a maximum.
    kind = "max" if known else "last"
    found = running(left.unionByName(right), ["entity_id"], ["us", "_kind", "_at", "_seq"], {f"_{f}": Running(kind, F.col(f)) for f in features}, stretch)
    out = found.where("_kind = 1")
    for f in features:
        fresh = F.col(f"_{f}").isNotNull()
        if max_age is not None:
            fresh &= F.col(f"_{f}")["event_us"] >= F.col("us") - max_age
        out = out.withColumn(f, F.when(fresh, F.col(f"_{f}")["value"]).otherwise(F.lit(fill)))
    return out.select(*keys, *features)


def leaking_values(observations: DataFrame, log: DataFrame, features: list[str], keys: tuple[str, ...] = ("obs_id", "entity_id", "us")) -> DataFrame:
    """A row for each observation and feature: whether the value that a join by event time alone gives it was computed
    after the observation, so that nobody knew it then."""
    stamped = log.withColumn("feature_value", micros("computed_at").cast("string"))
    joined = as_of_join(observations, stamped, features, keys=keys)
    pairs = F.array(*(F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("long").alias("computed_us")) for f in features))
    rows = joined.select(*keys, F.inline(pairs))
    return rows.select(*keys, "feature_name", F.coalesce(F.col("computed_us") > F.col("us"), F.lit(False)).alias("leaks"))


def time_travel(entities: DataFrame, log: DataFrame, features: list[str], times: list[datetime]) -> DataFrame:
    """The state of every entity at each of a few times."""
    at = F.explode(F.array(*(F.lit(t).cast("timestamp") for t in times)))
    asked = entities.select("entity_id").distinct().select("entity_id", at.alias("timestamp"))
    asked = asked.withColumn("us", micros("timestamp"))
    return as_of_join(asked, log, features, keys=("entity_id", "us"))


def late_arrivals(log: DataFrame, as_of: datetime, window_days: int = 7) -> DataFrame:
    """Features whose event was before as_of and that were written after it, within some days."""
    at = F.lit(as_of).cast("timestamp")
    late = (F.col("event_time") <= at) & (F.col("computed_at") > at) & (F.col("computed_at") <= at + F.make_interval(days=F.lit(window_days)))
    return log.where(late).groupBy("entity_id").agg(F.sort_array(F.collect_set("feature_name")).alias("features"))


def newly_present(log: DataFrame, as_of: datetime) -> DataFrame:
    """(entity, feature) pairs without a value at as_of that have one now."""
    pair = ["entity_id", "feature_name"]
    then = log.where(F.col("event_time") <= F.lit(as_of).cast("timestamp")).select(*pair)
    return log.select(*pair).distinct().join(then.distinct(), pair, "left_anti")


def leaks(feature_us: str, label_us: str) -> Column:
    """Whether a joined row's feature is from after its label."""
    return F.col(feature_us) > F.col(label_us)


def age_limit(days: int) -> int:
    return days * DAY
