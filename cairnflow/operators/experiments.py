"""Experiments: assignment, summaries, tests, allocation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.functions.columns import md5_bucket

BUCKETS = 10_000


def variant(entity: Column, experiment: str, variants: list[tuple[str, float]], running: bool = True) -> Column:
    """The first variant whose cumulated share lies above the entity's bucket; the last one takes the rest."""
    if not running or not variants:
        return F.lit("control")
    bucket = md5_bucket(F.concat(F.lit(f"{experiment}:"), entity), BUCKETS)
    out, total, cases = F.lit(variants[-1][0]), 0.0, []
    for name, share in variants:
        total += share
        cases.append((name, int(total * BUCKETS)))
    for name, end in reversed(cases):
        out = F.when(bucket < end, name).otherwise(out)
    return out


def overridden(value: Column, assigned: Column, overrides: dict[str, float]) -> Column:
    """A feature's value, replaced in the variants that override it."""
    out = value
    for name, v in overrides.items():
        out = F.when(assigned == name, F.lit(v)).otherwise(out)
    return out


def rollout(entity: Column, feature: str, overrides: list[tuple[str, float]], latest: str) -> Column:
    """The version that serves an entity: the first override whose percentage covers its bucket, else the latest."""
    out = F.lit(latest)
    for version, percent in reversed(overrides):
        bucket = md5_bucket(F.concat(F.lit(f"{feature}:{version}:"), entity), 100)
        out = F.when(bucket < percent, version).otherwise(out)
    return out


def summary(observations: DataFrame) -> DataFrame:
    """observations: experiment, metric, variant, value."""
    v = F.col("value")
    return observations.groupBy("experiment", "metric", "variant").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def z_test(observations: DataFrame, control: str = "control", alpha: float = 0.05, min_n: int = 1) -> DataFrame:
    """Every other variant against the control: z with unpooled variances, lift in percent, two-sided p."""

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return z.map(lambda x: 2 * (1 - 0.5 * (1 + math.erf(abs(x) / math.sqrt(2)))))

    s = summary(observations).withColumn("se2", F.col("std") * F.col("std") / F.col("n"))
    base = s.where(F.col("variant") == control).select(
        "experiment", "metric", F.col("mean").alias("mean_c"), F.col("se2").alias("se2_c"), F.col("n").alias("n_c")
    )
    both = s.where(F.col("variant") != control).join(base, ["experiment", "metric"])
    se = F.sqrt(F.col("se2") + F.col("se2_c"))
    z = F.when(se > 0, (F.col("mean") - F.col("mean_c")) / se).otherwise(F.lit(0.0))
    lift = 100 * (F.col("mean") - F.col("mean_c")) / F.greatest(F.abs("mean_c"), F.lit(1e-9))
    out = both.withColumn("z", z).withColumn("lift_pct", lift).withColumn("p_value", two_sided("z"))
    enough = (F.col("n") >= min_n) & (F.col("n_c") >= min_n)
    return out.withColumn("significant", enough & (F.col("p_value") < alpha))


def epsilon_greedy(observations: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """The best mean gets 1 - epsilon + epsilon / n of the traffic, the others epsilon / n; ties go to the first name."""
    s = summary(observations)
    w = Window.partitionBy("experiment", "metric")
    best = F.row_number().over(w.orderBy(F.desc("mean"), "variant")) == 1
    n = F.count("*").over(w)
    return s.select("experiment", "metric", "variant", "mean", (F.when(best, 1 - epsilon).otherwise(0.0) + epsilon / n).alias("traffic"))
