"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch; a timestamp without zone counts as UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def number(text: Column | str) -> Column:
    """A double, or null for what isn't a number."""
    return (F.col(text) if isinstance(text, str) else text).try_cast("double")


def json_of(value: Column, kind: str) -> Column:
    """A scalar as JSON text. JSON has no numbers that aren't finite: they are strings, which no number's type allows."""
    if kind == "string":
        made = F.to_json(F.struct(value.alias("v")))  # {"v":...}
        return F.when(value.isNotNull(), made.substr(F.lit(6), F.length(made) - 6))
    if kind in ("double", "float"):
        plain = value.cast("string")
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(plain)
    return value.cast("string")


def json_scalar(text: Column | str) -> Column:
    """The text of a JSON scalar: strings lose their quotes; null stays null, and so does JSON null."""
    text = F.col(text) if isinstance(text, str) else text
    quoted = text.startswith('"') & text.endswith('"') & (F.length(text) >= 2)
    body = text.substr(F.lit(2), F.length(text) - 2)
    escaped = F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    return F.when(quoted, F.when(text.contains("\\"), escaped).otherwise(body)).when(text != "null", text)


def temporal_features(ts: Column) -> dict[str, Column]:
    """Seven calendar features; Monday is day 0, and the hour of 17 still counts as business."""
    hour, day = F.hour(ts), F.weekday(ts)
    return {
        "hour_of_day": hour,
        "day_of_week": day,
        "is_weekend": day >= 5,
        "is_business_hours": (hour >= 9) & (hour <= 17),
        "week_of_year": F.weekofyear(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
    }


def decision(probability: Column, decline: float = 0.80, review: float = 0.50) -> Column:
    return F.when(probability > decline, "DECLINE").when(probability > review, "REVIEW").otherwise("APPROVE")


def md5_bucket(text: Column, buckets: int) -> Column:
    """The first eight hex digits of the MD5, as a number, modulo buckets."""
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets))
