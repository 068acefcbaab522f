"""Running totals of a busy entity in many tasks.

Rows are dealt by entity and stretch of time. Each stretch is gone through on its own; what it hands on to the next ones, a
row for each stretch, is an aggregate that is combined on the way to the shuffle, and a window over the stretches of an entity
turns it into what each one is handed. Both parts meet where the stretch is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ROWS_OF_A_TASK = 50_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys in as many tasks as leave each about ROWS_OF_A_TASK, for work that takes up many times its input. Said as
    a number, since tasks would otherwise be as many for any input, or be put together by the size of what they read."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // ROWS_OF_A_TASK)), *keys)


@dataclass(frozen=True)
class Running:
    """kind: sum, min, max or last (the newest that is not null, in the rows' order), of a column over what came so far."""

    kind: str
    value: Column

    def within(self, w) -> Column:
        return F.last(self.value, ignorenulls=True).over(w) if self.kind == "last" else getattr(F, self.kind)(self.value).over(w)

    def total(self, order: Column) -> Column:
        return F.max_by(self.value, F.when(self.value.isNotNull(), order)) if self.kind == "last" else getattr(F, self.kind)(self.value)

    def joined(self, before: Column, here: Column) -> Column:
        if self.kind == "sum":
            return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
        return {"min": F.least, "max": F.greatest, "last": lambda b, h: F.coalesce(h, b)}[self.kind](before, here)


def running(
    rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Running], stretch: int | None, time: str = "us", current: bool = True
) -> DataFrame:
    """rows with running values by keys, in the order of columns of which time is the first.

    current: up to each row and itself; otherwise over earlier times only. stretch: length of a stretch in units of time;
    None: an entity is one stretch."""
    span = Window.partitionBy(*keys) if stretch is None else Window.partitionBy(*keys, "_stretch")
    w = span.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) if current else span.orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    if stretch is None:
        return rows.withColumns({name: v.within(w) for name, v in values.items()})
    dealt = rows.withColumn("_stretch", F.floor(F.col(time) / stretch).cast("long"))
    totals = dealt.groupBy(*keys, "_stretch").agg(*(v.total(F.struct(*order)).alias(f"_in_{n}") for n, v in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    handed = totals.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)), F.col("_stretch").alias("_stretch_of"), *(Running(v.kind, F.col(f"_in_{n}")).within(earlier).alias(f"_in_{n}") for n, v in values.items()))
    dealt = dealt.withColumns({name: v.within(w) for name, v in values.items()})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)] + [F.col("_stretch") == F.col("_stretch_of")]
    both = dealt.join(handed, same)
    both = both.withColumns({name: v.joined(F.col(f"_in_{name}"), F.col(name)) for name, v in values.items()})
    return both.select(*rows.columns, *values)
