"""Recomputing history for a range of days in one job."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.functions.columns import DAY

REACH = 31 * DAY
"""A transaction feeds the midnights from its own time to 31 days later: a day's chunk, and 30 days of history."""


def days(df: DataFrame, start: date, end: date) -> DataFrame:
    """Every day from start to end, both included."""
    return df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("as_of"))


def backfill(transactions: DataFrame, start: date, end: date, done: DataFrame | None = None, holes: DataFrame | None = None) -> DataFrame:
    """User aggregates as of every midnight from start to end: entity_id, as_of and four features.

    Transactions become panes first, the state of an entity's day (number, mean and squared distances from it, and of each
    merchant that it was seen): these are combined on the way to the shuffle. The state of a midnight is that of the panes
    before it, and of what happened at that instant itself. So what is copied to the 32 midnights it feeds is panes, not
    transactions, and distinct merchants are steps up and down that add up. done: days (as_of) that are there already and
    are skipped. holes: entity_id, first and last day of ranges; only these are made."""
    first, last = (F.datediff(F.lit(d), F.lit(date(1970, 1, 1))) for d in (start, end))
    rows = transactions.where(F.col("us").between(first.cast("long") * DAY - REACH, last.cast("long") * DAY))
    day = F.floor(F.col("us") / DAY).cast("int")
    rows = rows.select("entity_id", "merchant_id", "amount", day.alias("day"), (F.col("us") == day.cast("long") * DAY).alias("instant"))
    panes = rows.groupBy("entity_id", "day", "instant").agg(
        F.count("amount").alias("n"), F.sum("amount").alias("s"), F.avg("amount").alias("mean"), (F.var_pop("amount") * F.count("amount")).alias("m2")
    )
    centre = F.sum("s").over(Window.partitionBy("entity_id")) / F.sum("n").over(Window.partitionBy("entity_id"))
    panes = panes.withColumn("centre", centre)
    # A pane feeds the midnights after it; an instant also its own.
    begins = F.when(F.col("instant"), F.col("day")).otherwise(F.col("day") + 1)
    low = F.greatest(begins, first)
    fed = panes.withColumn("low", low).withColumn("high", F.least(F.col("day") + 31, last)).where("low <= high")
    fed = fed.withColumn("at", F.explode(F.sequence("low", "high")))
    if done is not None:
        fed = fed.join(done.select(F.unix_date("as_of").alias("at")).distinct(), "at", "left_anti")
    if holes is not None:
        wanted = holes.select("entity_id", F.explode(F.sequence(F.unix_date("first"), F.unix_date("last"))).alias("at")).distinct()
        fed = fed.join(wanted, ["entity_id", "at"], "left_semi")
    week = F.col("day") >= F.col("at") - 7
    of = lambda c: F.sum(F.when(week, c))
    off = F.col("mean") - F.col("centre")
    sums = fed.groupBy("entity_id", "at").agg(
        of(F.col("n")).alias("n"), of(F.col("s")).alias("s"), of(F.col("n") * off).alias("d"), of(F.col("m2") + F.col("n") * off * off).alias("q"), F.sum("s").alias("total")
    )
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("d") * F.col("d") / F.col("n")) / (F.col("n") - 1)))
    out = sums.join(_merchants(rows, sums.select("entity_id", "at")), ["entity_id", "at"])
    return out.select(
        "entity_id", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(0.0)).alias("avg_transaction_amount_7d"),
        F.when(F.col("n") > 1, spread).otherwise(F.lit(0.0)).alias("std_transaction_amount_7d"), "unique_merchants_30d",
        F.coalesce("total", F.lit(0.0)).alias("user_lifetime_value"), F.date_from_unix_date("at").alias("as_of"),
    )


def _merchants(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """How many merchants an entity has met in the 30 days up to each midnight that is asked for.

    A merchant met on a day counts from the next midnight (at midnight: from that one) for 30 days, or until it counts anew."""
    met = rows.where(F.col("merchant_id") != "").groupBy("entity_id", "merchant_id", "day").agg(F.max("instant").alias("instant"))
    begins = F.when(F.col("instant"), F.col("day")).otherwise(F.col("day") + 1)
    w = Window.partitionBy("entity_id", "merchant_id").orderBy("day")
    spans = met.withColumn("a", begins).withColumn("b", F.least(F.col("day") + 31, F.coalesce(F.lead("a").over(w), F.col("day") + 31)))
    steps = spans.where("a < b").select("entity_id", F.inline(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("step")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("step")))))
    steps = steps.groupBy("entity_id", "at").agg(F.sum("step").alias("step")).withColumn("asks", F.lit(False))
    both = steps.unionByName(asked.select("entity_id", "at", F.lit(0).cast("long").alias("step"), F.lit(True).alias("asks")))
    total = F.sum("step").over(Window.partitionBy("entity_id").orderBy("at"))
    return both.withColumn("unique_merchants_30d", total).where("asks").select("entity_id", "at", "unique_merchants_30d")


def holes(log: DataFrame, expected: DataFrame, start: date, end: date) -> DataFrame:
    """Ranges of days, both ends included, without any value: entity_id, feature_name, first, last.

    expected: the entities and features that should have a value on every day from start to end. A day that is missing is
    where the next day that is there is more than one later; days just outside stand for the ends."""
    pair = ["entity_id", "feature_name"]
    there = log.select(*pair, F.to_date("event_time").alias("day")).where(F.col("day").between(F.lit(start), F.lit(end))).distinct()
    wanted = expected.select(*pair).distinct()
    edges = wanted.select(*pair, F.explode(F.array(F.date_sub(F.lit(start), 1), F.date_add(F.lit(end), 1))).alias("day"))
    days_ = there.join(wanted, pair, "left_semi").unionByName(edges)
    before = F.lag("day").over(Window.partitionBy(*pair).orderBy("day"))
    gaps = days_.withColumn("before", before).where(F.datediff("day", "before") > 1)
    return gaps.select(*pair, F.date_add("before", 1).alias("first"), F.date_sub("day", 1).alias("last"))


def write(features: DataFrame, path: str) -> None:
    """Replace the days that are written and leave the others alone: running twice changes nothing."""
    features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)


def restricted(transactions: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Only the transactions of the entities asked for (None: all)."""
    return transactions if entities is None else transactions.join(entities.select("entity_id"), "entity_id", "left_semi")
