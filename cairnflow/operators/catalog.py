"""Tables about features: differences of versions, lineage, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.sources.folders import shared_folder, written


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new: feature_name, dtype, has_rules, min_value, max_value. A row for each feature of either: what changed,
    and whether that breaks readers. Bounds count only if both versions have rules."""
    o = old.select("feature_name", *(F.col(c).alias(f"o_{c}") for c in ("dtype", "has_rules", "min_value", "max_value")))
    n = new.select("feature_name", *(F.col(c).alias(f"n_{c}") for c in ("dtype", "has_rules", "min_value", "max_value")))
    both = o.join(n, "feature_name", "full_outer")
    ruled = F.coalesce(F.col("o_has_rules") & F.col("n_has_rules"), F.lit(False))
    raised = ruled & F.coalesce(F.col("n_min_value") > F.col("o_min_value"), F.lit(False))
    lowered = ruled & F.coalesce(F.col("n_max_value") < F.col("o_max_value"), F.lit(False))
    issues = F.array_compact(
        F.array(
            F.when(F.col("n_dtype").isNull(), "removed"), F.when(F.col("o_dtype").isNull(), "added"),
            F.when(F.col("o_dtype") != F.col("n_dtype"), "type changed"), F.when(raised, "minimum raised"), F.when(lowered, "maximum lowered"),
        )
    )
    return both.select("feature_name", issues.alias("issues"), F.exists(issues, lambda x: x != "added").alias("breaking"))


def lineage(edges: DataFrame) -> DataFrame:
    """edges: feature, depends_on. All (feature, ancestor) pairs; cycles end. A round joins the pairs found last with
    the edges and keeps the new ones, so rounds are as many as the longest path; each is written once."""
    folder = shared_folder(edges.sparkSession, "lineage")
    pairs = edges.select("feature", F.col("depends_on").alias("ancestor")).distinct()
    known = fresh = written(pairs, f"{folder}/0")
    steps, n = known.select(F.col("feature").alias("ancestor"), F.col("ancestor").alias("next")), 0
    while not fresh.isEmpty():
        n += 1
        further = fresh.join(steps, "ancestor").select("feature", F.col("next").alias("ancestor")).distinct()
        fresh = written(further.join(known, ["feature", "ancestor"], "left_anti"), f"{folder}/{n}")
        known = known.unionByName(fresh)
    return known


def active_features(defs: DataFrame) -> DataFrame:
    return defs.groupBy("feature_group").agg(F.count("*").alias("active_features"))
