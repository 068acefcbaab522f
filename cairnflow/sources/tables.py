"""The feature engine's inputs as views of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions.columns import json_of, micros

LOG_COLUMNS = ("entity_id", "feature_group", "feature_version", "feature_name", "feature_value", "event_time", "computed_at", "event_id")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the zone-free time as UTC, its microseconds, and the number k of their properties."""
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("user_id").cast("string").alias("entity_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        micros("ts").alias("us"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events(spark, sf_dir)
        .where("event_type = 'purchase'")
        .select(
            F.col("event_id").alias("transaction_id"), "entity_id", "timestamp", "us", F.col("value").alias("amount"),
            F.concat(F.lit("m"), "k").alias("merchant_id"), F.concat(F.lit("c"), F.col("k") % 8).alias("merchant_category"),
            (F.col("k") % 2 == 0).alias("is_online"),
        )
    )


def tied_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: their times are whole days, so many are equal."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").cast("string").alias("entity_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), micros("o_orderdate").alias("us"),
        F.col("o_totalprice").cast("double").alias("amount"), F.col("o_orderpriority").alias("merchant_id"),
        F.col("o_orderstatus").alias("merchant_category"), F.lit(False).alias("is_online"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows."""
    e = events(spark, sf_dir).where("event_type = 'error'")
    return e.select(F.col("event_id").alias("obs_id"), "entity_id", "timestamp", "us", (F.col("value") > 150).alias("label"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of JSON. Clicks have a type that no transformer knows; errors lack a required field; every
    seventh purchase has an amount that is no number."""
    e = events(spark, sf_dir)
    kind = (
        F.when(F.col("event_type") == "purchase", "transaction_created").when(F.col("event_type") == "view", "user_login")
        .when(F.col("event_type") == "signup", "user_profile_updated").otherwise(F.col("event_type"))
    )
    amount = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("decimal(18,4)").cast("string"))
    payload = F.struct(
        F.when(F.col("event_type") == "purchase", amount).alias("amount"),
        F.when((F.col("event_type") == "purchase") & (F.col("k") % 3 == 0), "EUR").alias("currency"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("m"), "k")).alias("merchant_id"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("d"), F.col("k") % 4)).alias("device"),
        F.when((F.col("event_type") == "view") & (F.col("k") % 5 != 0), F.lit("DE")).alias("ip_country"),
        F.when(F.col("event_type") == "signup", F.col("k").cast("string")).alias("account_age_days"),
        F.when(F.col("event_type") == "signup", (F.col("k") % 2 == 0)).alias("kyc_verified"),
    )
    line = F.struct(
        F.col("event_id").cast("string").alias("event_id"), kind.alias("event_type"),
        F.when(F.col("event_type") != "error", F.col("entity_id")).alias("entity_id"), F.lit("user").alias("entity_type"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("occurred_at"), payload.alias("payload"),
        F.lit("web").alias("source"),
    )
    return e.select(F.to_json(line).alias("value"))


def feature_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long history: a row for each feature of a purchase or a signup; some are computed days after their event."""
    e = events(spark, sf_dir)
    late = F.timestamp_micros(F.col("us") + (F.col("event_id") % 10) * 86_400_000_000)
    amount = json_of(F.col("value").cast("decimal(18,4)"), "number")
    bought = F.create_map(
        F.lit("transaction_amount"), amount, F.lit("merchant_id"), json_of(F.concat(F.lit("m"), "k"), "string"),
        F.lit("merchant_category"), json_of(F.concat(F.lit("c"), F.col("k") % 8), "string"),
        F.lit("is_online"), json_of(F.col("k") % 2 == 0, "boolean"),
    )
    signed = F.create_map(
        F.lit("account_age_days"), json_of(F.col("k"), "number"), F.lit("kyc_verified"), json_of(F.col("k") % 2 == 0, "boolean")
    )
    buys = F.col("event_type") == "purchase"
    return e.where("event_type IN ('purchase', 'signup')").select(
        "entity_id", F.when(buys, "transaction").otherwise("profile").alias("feature_group"), F.lit("v1").alias("feature_version"),
        F.explode(F.when(buys, bought).otherwise(signed)).alias("feature_name", "feature_value"),
        F.col("timestamp").alias("event_time"), late.alias("computed_at"), "event_id",
    )
