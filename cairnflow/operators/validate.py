"""Rule-based validation of feature values, as expressions without user functions but for custom rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.functions.columns import json_scalar, number

DEFINITION = "feature_group string, feature_version string, feature_name string, dtype string, has_rules boolean, not_null boolean, min_value double, max_value double, pattern string, allowed array<string>"


@dataclass(frozen=True)
class Definition:
    """A declared feature. Rules apply if there are any; has_rules alone means not null."""

    feature_group: str
    feature_version: str
    feature_name: str
    dtype: str
    has_rules: bool = True
    not_null: bool = True
    min_value: float | None = None
    max_value: float | None = None
    pattern: str | None = None
    allowed: tuple[str, ...] | None = None


# The declared features of the default schemas, with their bounds.
DEFAULTS = (
    Definition("transaction", "v1", "transaction_amount", "FLOAT", min_value=0.0, max_value=1_000_000.0),
    Definition("transaction", "v1", "transaction_currency", "STRING", pattern="[A-Z]{3}"),
    Definition("transaction", "v1", "merchant_id", "STRING", not_null=False),
    Definition("transaction", "v1", "merchant_category", "STRING", not_null=False),
    Definition("transaction", "v1", "is_online", "BOOLEAN", not_null=False),
    Definition("user", "v1", "account_age_days", "INTEGER", min_value=0.0),
    Definition("user", "v1", "kyc_verified", "BOOLEAN"),
    Definition("user", "v1", "last_login_timestamp", "STRING"),
    Definition("user", "v1", "login_device", "STRING", has_rules=False),
    Definition("user", "v1", "login_ip_country", "STRING", has_rules=False),
    Definition("user", "v1", "preferred_currency", "STRING", has_rules=False),
    Definition("user", "v1", "transaction_count_24h", "INTEGER", min_value=0.0, max_value=100_000.0),
    Definition("user", "v1", "avg_transaction_amount_7d", "FLOAT", min_value=0.0),
    Definition("user", "v1", "std_transaction_amount_7d", "FLOAT", min_value=0.0),
    Definition("user", "v1", "unique_merchants_30d", "INTEGER", min_value=0.0),
    Definition("user", "v1", "user_lifetime_value", "FLOAT", min_value=0.0),
)


def definitions(spark, rows=DEFAULTS) -> DataFrame:
    return spark.createDataFrame(
        [(d.feature_group, d.feature_version, d.feature_name, d.dtype, d.has_rules, d.not_null, d.min_value, d.max_value, d.pattern, list(d.allowed) if d.allowed else None) for d in rows],
        DEFINITION,
    )


def json_kind(value: Column) -> Column:
    """INTEGER, FLOAT, STRING, BOOLEAN, LIST or MAP of a JSON text; null for null and for what isn't JSON."""
    return (
        F.when(value.rlike(r"\A-?\d+\z"), "INTEGER").when(value.rlike(r"\A-?\d+(\.\d+)?([eE][+-]?\d+)?\z"), "FLOAT")
        .when(value.rlike(r'(?s)\A".*"\z'), "STRING").when(value.isin("true", "false"), "BOOLEAN")
        .when(value.rlike(r"(?s)\A\[.*\]\z"), "LIST").when(value.rlike(r"(?s)\A\{.*\}\z"), "MAP")
    )


def errors(values: DataFrame, defs: DataFrame) -> DataFrame:
    """values: feature_group, feature_version, feature_name, feature_value (JSON). Adds `errors`, empty if valid.

    The definitions are as many as features are declared; Spark broadcasts them by its own size check."""
    value, name = F.col("feature_value"), F.col("feature_name")
    missing = value.isNull() | (value == "null")
    kind, scalar, num = json_kind(value), json_scalar(value), number(value)
    known = F.col("dtype").isNotNull()
    numeric = kind.isin("INTEGER", "FLOAT")
    text = kind == "STRING"
    typed = (F.col("dtype") == kind) | ((F.col("dtype") == "FLOAT") & (kind == "INTEGER")) | (
        (F.col("dtype") == "TIMESTAMP") & scalar.try_cast("timestamp").isNotNull()
    )
    rules = known & F.col("has_rules") & ~missing
    checks = {
        "unknown feature": ~known,
        "null value": known & F.col("has_rules") & F.col("not_null") & missing,
        "wrong type": known & ~missing & ~F.coalesce(typed, F.lit(False)),
        "below minimum": rules & numeric & (num < F.col("min_value")),
        "above maximum": rules & numeric & (num > F.col("max_value")),
        "pattern mismatch": rules & text & ~F.rlike(scalar, F.concat(F.lit(r"\A(?:"), F.col("pattern"), F.lit(r")\z"))),
        "value not allowed": rules & ~F.array_contains(F.col("allowed"), scalar),
    }
    found = F.array_compact(F.array(*(F.when(bad, F.concat(name, F.lit(f": {what}"))) for what, bad in checks.items())))
    keys = ["feature_group", "feature_version", "feature_name"]
    return values.join(defs, keys, "left").select(*(F.col(c) for c in values.columns), found.alias("errors"))


def collect_errors(checked: DataFrame, record: list[str]) -> DataFrame:
    """All errors of each record, in order."""
    return checked.groupBy(*record).agg(F.array_sort(F.flatten(F.collect_list("errors"))).alias("errors"))


def split(records: DataFrame, checked: DataFrame, record: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a record is rejected whole if any of its features fails."""
    bad = collect_errors(checked.where(F.size("errors") > 0), record)
    return records.join(bad, record, "left_anti"), records.join(bad, record)


def custom_rule(fn: Callable[[str], object]) -> Callable[[Column], Column]:
    """A rule from a plain function: True or None is fine, other results are the error's text, and a function that
    raises is ignored."""

    def rule(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                r = fn(v)
            except Exception:
                return None
            return None if r is None or r is True else (str(r) or "custom rule failed") if r is not False else "custom rule failed"

        return values.map(one, na_action="ignore").astype(object).where(lambda s: s.notna(), None)

    return F.pandas_udf(rule, "string")


def reconcile(computed: DataFrame, expected: DataFrame, key: list[str], features: list[str], rel: float = 0.01, abs_: float = 0.01) -> DataFrame:
    """A row for each feature of the keys on both sides: the two values and whether they agree."""

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("double").alias(name)) for f in features))
        return df.select(*key, F.inline(pairs))

    both = long(computed, "computed").join(long(expected, "expected"), [*key, "feature_name"])
    a, b = F.col("computed"), F.col("expected")
    near = F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))
    return both.withColumn("agrees", F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near))
