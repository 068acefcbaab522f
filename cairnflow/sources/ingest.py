"""From lines of JSON to feature records, with what can't be read on the side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnflow.functions.columns import number

RAW_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("entity_id", T.StringType()),
        T.StructField("entity_type", T.StringType()), T.StructField("occurred_at", T.StringType()),
        T.StructField("payload", T.MapType(T.StringType(), T.StringType())), T.StructField("source", T.StringType()),
    ]
)
REQUIRED = ("event_id", "event_type", "entity_id", "entity_type", "occurred_at")


def kafka_events(spark: SparkSession, servers: str, topics: str, per_trigger: int = 100_000) -> DataFrame:
    """The event stream from a broker; needs Spark's Kafka package on the class path."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
        .option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).load().select(F.col("value").cast("string").alias("value"))
    )


def file_events(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """The same from files of lines that keep arriving in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fields of raw events, the line itself as `raw`, and `reason`: null, or why the line is malformed."""
    e = F.from_json(F.col(column), RAW_EVENT, {"mode": "PERMISSIVE"})
    parsed = lines.select(F.col(column).alias("raw"), e.alias("e")).select("raw", "e.*")
    parsed = parsed.withColumn("occurred_at", F.col("occurred_at").try_cast("timestamp"))
    reason: Column = F.lit(None).cast("string")
    for field in reversed(REQUIRED):
        reason = F.when(F.col(field).isNull(), F.lit(f"missing or invalid {field}")).otherwise(reason)
    return parsed.withColumn("reason", reason)


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Records for the dead-letter sink."""
    return parsed.where("reason IS NOT NULL").select(F.col("raw").alias("original"), F.col("reason").alias("failure_reason"))


def _payload(field: str, default: str | None) -> Column:
    """A payload field; the default stands in for an absent one only, a null stays null."""
    value = F.col("payload")[field]
    if default is None:
        return value
    return F.when(F.coalesce(F.map_contains_key("payload", field), F.lit(False)), value).otherwise(F.lit(default))


def _amount() -> Column:
    return number(_payload("amount", "0.0"))


def _age() -> Column:
    return _payload("account_age_days", "0").try_cast("bigint")


_ALWAYS = ("event_id", "entity_id", "occurred_at", "raw")


def transform_transactions(parsed: DataFrame) -> DataFrame:
    """Features of a transaction; an amount that is present and no number gives a reason."""
    amount = _amount()
    return parsed.select(
        *_ALWAYS, amount.alias("transaction_amount"), _payload("currency", "USD").alias("transaction_currency"),
        _payload("merchant_id", "").alias("merchant_id"), _payload("merchant_category", "unknown").alias("merchant_category"),
        F.coalesce(_payload("is_online", "false").try_cast("boolean"), F.lit(False)).alias("is_online"),
        F.when(amount.isNull(), F.lit("amount is not a number")).alias("reason"),
    )


def transform_logins(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        *_ALWAYS, F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("last_login_timestamp"),
        _payload("device", "unknown").alias("login_device"), _payload("ip_country", "unknown").alias("login_ip_country"),
        F.lit(None).cast("string").alias("reason"),
    )


def transform_profiles(parsed: DataFrame) -> DataFrame:
    age = _age()
    return parsed.select(
        *_ALWAYS, age.alias("account_age_days"), F.coalesce(_payload("kyc_verified", "false").try_cast("boolean"), F.lit(False)).alias("kyc_verified"),
        _payload("preferred_currency", "USD").alias("preferred_currency"),
        F.when(age.isNull(), F.lit("account_age_days is not a number")).alias("reason"),
    )


Transformer = Callable[[DataFrame], DataFrame]
TRANSFORMERS: dict[str, tuple[str, Transformer]] = {
    "transaction_created": ("transaction", transform_transactions),
    "user_login": ("user", transform_logins),
    "user_profile_updated": ("user", transform_profiles),
}
"""Event type: feature group and transformer. Further event types are added by further entries."""


def route(parsed: DataFrame, transformers: dict[str, tuple[str, Transformer]] = TRANSFORMERS) -> DataFrame:
    """The records of all transformers side by side; events of other types are skipped."""
    out: DataFrame | None = None
    for event_type, (group, fn) in transformers.items():
        part = fn(parsed.where((F.col("event_type") == event_type) & F.col("reason").isNull())).withColumn("feature_group", F.lit(group))
        part = part.withColumn("event_type", F.lit(event_type))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    assert out is not None, "no transformer"
    return out


def routing_counts(parsed: DataFrame, known: tuple[str, ...] = tuple(TRANSFORMERS)) -> DataFrame:
    status = F.when(F.col("reason").isNotNull(), "dead_letter").when(F.col("event_type").isin(*known), "transformed").otherwise("skipped")
    return parsed.groupBy(F.coalesce("event_type", F.lit("?")).alias("event_type"), status.alias("status")).agg(F.count("*").alias("events"))


NUMBERS: dict[str, tuple[str, Callable[[], Column]]] = {"transaction_created": ("transaction_amount", _amount), "user_profile_updated": ("account_age_days", _age)}
"""Event type: the feature that has to be a number, and how it is read; null if it isn't one."""


def counted(parsed: DataFrame) -> DataFrame:
    """counter, label and n, from one reading: events by type, dead letters by reason, and values that are no numbers though
    their type's feature has to be one."""
    fault = F.lit(None).cast("string")
    for event_type, (feature, value) in NUMBERS.items():
        fault = F.when((F.col("event_type") == event_type) & value().isNull(), F.lit(feature)).otherwise(fault)
    readable = F.col("reason").isNull()
    said = F.array(
        F.struct(F.lit("events").alias("counter"), F.col("event_type").alias("label")),
        F.when(~readable, F.struct(F.lit("dead_letters").alias("counter"), F.col("reason").alias("label"))),
        F.when(readable & fault.isNotNull(), F.struct(F.lit("validation_errors").alias("counter"), fault.alias("label"))),
    )
    return parsed.select(F.inline(F.array_compact(said))).groupBy("counter", "label").agg(F.count("*").alias("n"))


TRANSACTION_FILE = "transaction_id bigint, user_id string, merchant_id string, amount double, timestamp timestamp"


def read_csv(spark: SparkSession, path: str, schema: str = TRANSACTION_FILE) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_json_lines(spark: SparkSession, path: str, schema: str = TRANSACTION_FILE) -> DataFrame:
    return spark.read.schema(schema).json(path)
