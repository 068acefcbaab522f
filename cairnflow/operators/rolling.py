"""Rolling features of each transaction over what came before it.

A window of length d at time t is the open interval (t - d, t): the row itself and all rows of the same instant are
outside. Times are whole microseconds, so the frame is an exact range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cairnflow.functions.columns import DAY, HOUR
from cairnflow.operators.segments import Running, dealt, running

KEYS = ("transaction_id", "entity_id", "us")


def before(length: int | None, *keys: str, time: str = "us") -> WindowSpec:
    """Rows of the same keys earlier than the current instant, by less than length (None: all)."""
    start = Window.unboundedPreceding if length is None else -(length - 1)
    return Window.partitionBy(*keys).orderBy(time).rangeBetween(start, -1)


def spread(rows: DataFrame, length: int, bucket: int) -> DataFrame:
    """Rows for windows by (entity, bucket) instead of entity, so that one busy entity is shared by many tasks.

    Each row goes to the bucket of its time, as `home`, and to the later buckets whose windows of `length` reach it."""
    first = F.floor(F.col("us") / bucket).cast("long")
    last = F.floor((F.col("us") + length) / bucket).cast("long")
    return rows.withColumn("bucket", F.explode(F.sequence(first, last))).withColumn("home", F.col("bucket") == first)


_ENDS = {"h": HOUR, "d": DAY, "w": 7 * DAY, "m": 30 * DAY}


_UNIT = 10**10
"""Sums are of whole numbers and of ten-billionths, as long."""


def _odd(amount: Column) -> Column:
    """Amounts that this doesn't suit: NaN, infinities, from a million millions on, and those too small to be seen."""
    size = F.abs(amount)
    return F.coalesce(F.isnan(amount) | (size >= 1e12) | ((size > 0) & (size < 1e-6)), F.lit(False))


def rolling_features(transactions: DataFrame, bucket: int | None = None) -> DataFrame:
    """Counts over 1 hour, 24 hours, 7 and 30 days, sum over 24 hours, mean over 7 days, largest over 30 days.

    Linear in the rows of an entity: each row enters once and leaves once for each length, and a window's count or sum
    is what has entered less what has left, by running totals of whole numbers, so that nothing drifts. The largest value
    is taken over blocks of 30 days: the block's own rows so far, and those of the block before that are still inside.
    Entities with odd amounts (NaN, infinite, 1e12 and more, under 1e-6) have sums of doubles over each window instead: NaN
    or an infinity in a window shows in its sum and mean, in no other one. A null amount counts as a transaction only.
    bucket: microseconds of a time bucket (see spread), for entities too busy for one task."""
    odd = transactions.where(_odd(F.col("amount"))).select("entity_id").distinct()
    plain = _by_sweep(transactions.join(odd, "entity_id", "left_anti"), bucket)
    return plain.unionByName(_by_frames(transactions.join(odd, "entity_id", "left_semi")))


def _by_frames(transactions: DataFrame) -> DataFrame:
    h, d, w, m = (before(length, "entity_id") for length in _ENDS.values())
    one, amount = F.lit(1), F.col("amount")
    sum_, mean = F.sum(amount).over(d), F.sum(amount).over(w) / F.count(amount).over(w)
    return transactions.select(
        *KEYS, F.count(one).over(d).alias("transaction_count_24h"), F.count(one).over(w).alias("transaction_count_7d"), F.count(one).over(m).alias("transaction_count_30d"),
        F.coalesce(sum_, F.lit(0.0)).alias("total_amount_24h"), F.when(F.count(amount).over(w) > 0, mean).otherwise(F.lit(0.0)).alias("avg_amount_7d"),
        F.coalesce(F.max(amount).over(m), F.lit(0.0)).alias("max_amount_30d"), F.count(one).over(h).alias("transactions_last_hour"),
    )


_DISTINCT = {"unique_merchants_7d": ("merchant_id", "w"), "unique_categories_30d": ("merchant_category", "m")}


def all_features(transactions: DataFrame) -> DataFrame:
    """rolling_features, rolling_distinct and rolling_zscore side by side, from one shuffle and no join, where no amount is odd."""
    if transactions.where(_odd(F.col("amount"))).isEmpty():
        rows = _by_sweep(transactions, None, _DISTINCT, zscore=True)
        return rows.select(*(c for c in rows.columns if c != "amount_zscore"), "amount_zscore")
    key = list(KEYS)
    return rolling_features(transactions).join(rolling_distinct(transactions), key).join(rolling_zscore(transactions), key)


def _by_sweep(transactions: DataFrame, bucket: int | None, distinct: dict[str, tuple[str, str]] | None = None, zscore: bool = False) -> DataFrame:
    """distinct: names of counts of distinct values, each with its column and length; they need whole entities, as zscore does.
    A value counts from the first of its rows that follow each other by less than the length until the last of them leaves."""
    distinct = distinct or {}
    rows = transactions.select(*KEYS, "amount", *(c for c, _ in distinct.values()))
    keys = ("entity_id",)
    if bucket:
        rows, keys = spread(rows, 30 * DAY, bucket), ("entity_id", "bucket")
    rows = dealt(rows, *keys)  # one shuffle, before each row becomes five
    for name, (column, move) in distinct.items():
        mine = Window.partitionBy(*keys, column).orderBy("us", "transaction_id")
        gap = lambda a, b, length=_ENDS[move]: F.col(column).isNotNull() & F.coalesce(a - b >= length, F.lit(True))
        first, last = gap(F.col("us"), F.lag("us").over(mine)), gap(F.lead("us").over(mine), F.col("us"))
        rows = rows.withColumns({f"_first_{name}": F.when(first, 1), f"_last_{name}": F.when(last, 1)}).drop(column)
    if zscore:
        rows = rows.withColumn("amount_zscore", _level())
    month = _ENDS["m"]
    moves = F.array(
        F.struct(F.col("us").alias("at"), F.lit("in").alias("move")),
        *(F.struct((F.col("us") + length).alias("at"), F.lit(name).alias("move")) for name, length in _ENDS.items()),
    )
    whole = F.floor("amount").cast("long")
    rows = rows.withColumn("whole", whole).withColumn("rest", F.round((F.col("amount") - F.col("whole")) * _UNIT).cast("long"))
    rows = rows.select("*", F.inline(moves)).withColumn("block", F.floor(F.col("at") / month))
    entered = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    left = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*keys, "block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "block").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    of = lambda move, value: F.when(F.col("move") == move, value)
    one = F.lit(1)

    def count(move: str, value: Column = one, leaving: Column | None = None) -> Column:
        return F.count(of("in", value)).over(entered) - F.count(of(move, value if leaving is None else leaving)).over(left)

    def sums(move: str, column: str) -> Column:
        zero = F.lit(0).cast("long")
        return F.coalesce(F.sum(of("in", F.col(column))).over(entered), zero) - F.coalesce(F.sum(of(move, F.col(column))).over(left), zero)

    def total(move: str) -> Column:
        return sums(move, "whole").cast("double") + sums(move, "rest") / F.lit(float(_UNIT))

    some = count("w", F.col("amount"))
    out = rows.withColumns(
        {
            "transaction_count_24h": count("d"),
            "transaction_count_7d": count("w"),
            "transaction_count_30d": count("m"),
            "total_amount_24h": total("d"),
            "avg_amount_7d": F.when(some > 0, total("w") / some).otherwise(F.lit(0.0)),
            "max_amount_30d": F.coalesce(F.greatest(F.max(of("in", F.col("amount"))).over(own), F.max(of("m", F.col("amount"))).over(inside)), F.lit(0.0)),
            "transactions_last_hour": count("h"),
            **{name: count(move, F.col(f"_first_{name}"), F.col(f"_last_{name}")) for name, (_, move) in distinct.items()},
        }
    ).where("move = 'in'")
    flags = [f"_{end}_{name}" for name in distinct for end in ("first", "last")]
    return (out.where("home").drop("home", "bucket") if bucket else out).drop("amount", "whole", "rest", "at", "move", "block", *flags)


def velocity(count_last_hour: Column) -> Column:
    """Transactions per hour over the last hour."""
    return count_last_hour.cast("double")


def _level() -> Column:
    w, a = before(None, "entity_id"), F.col("amount")
    level = F.when((F.count("*").over(w) >= 2) & (F.min(a).over(w) < F.max(a).over(w)), (a - F.avg(a).over(w)) / F.stddev_pop(a).over(w))
    return F.coalesce(level, F.lit(0.0))


def rolling_zscore(transactions: DataFrame, stretch: int | None = None) -> DataFrame:
    """Deviations of an amount from the mean of all earlier ones, by their population deviation.

    0 with fewer than two earlier rows, or if all earlier amounts are equal. stretch: microseconds of a stretch of time, for
    entities too busy for one task (see segments); sums are then of distances from the entity's mean, so that they stay
    small."""
    a = F.col("amount")
    if stretch is None:
        return transactions.select(*KEYS, _level().alias("amount_zscore"))
    centre = transactions.groupBy("entity_id").agg(F.avg("amount").alias("_centre")).withColumnRenamed("entity_id", "_entity")
    rows = transactions.select(*KEYS, "amount").join(centre, F.col("entity_id").eqNullSafe(F.col("_entity"))).drop("_entity")
    off = a - F.col("_centre")
    of = {"n": ("sum", F.lit(1)), "some": ("sum", a.isNotNull().cast("long")), "s": ("sum", off), "q": ("sum", off * off), "low": ("min", a), "high": ("max", a)}
    rows = running(rows, ["entity_id"], ["us"], {f"_{name}": Running(*v) for name, v in of.items()}, stretch, current=False)
    mean = F.col("_s") / F.col("_some")
    level = (off - mean) / F.sqrt(F.col("_q") / F.col("_some") - mean * mean)
    level = F.when((F.col("_n") >= 2) & (F.col("_low") < F.col("_high")), level)
    return rows.select(*KEYS, F.coalesce(level, F.lit(0.0)).alias("amount_zscore"))


def distinct_by_sets(transactions: DataFrame, column: str, length: int, name: str) -> DataFrame:
    """Distinct values in the window, by a set for each row: for short windows."""
    return transactions.select(*KEYS, F.size(F.collect_set(column).over(before(length, "entity_id"))).cast("long").alias(name))


def distinct_by_sweep(transactions: DataFrame, column: str, length: int, name: str, stretch: int | None = None) -> DataFrame:
    """The same in time linear in the rows. A value seen at s and next at n is in the window of the times after s up to
    min(n, s + length - 1): one step up after s, one down after the end, and a running sum (in stretches: see segments)."""
    seen = transactions.where(F.col(column).isNotNull()).select("entity_id", column, "us").distinct()
    following = F.lead("us").over(Window.partitionBy("entity_id", column).orderBy("us"))
    ends = F.least(F.coalesce(following, F.col("us") + length), F.col("us") + length - 1)
    steps = seen.select("entity_id", F.col("us") + 1, F.lit(1), (ends + 1).alias("end")).toDF("entity_id", "us", "step", "end")
    steps = steps.select(
        "entity_id", F.inline(F.array(F.struct("us", "step"), F.struct(F.col("end").alias("us"), F.lit(-1).alias("step"))))
    ).groupBy("entity_id", "us").agg(F.sum("step").alias("step"))
    asked = transactions.select(*KEYS, F.lit(0).cast("long").alias("step"))
    both = asked.unionByName(steps.select(F.lit(None).cast("long").alias("transaction_id"), "entity_id", "us", "step"))
    if stretch is None:
        total = F.sum("step").over(Window.partitionBy("entity_id").orderBy("us"))
        return both.withColumn(name, total).where("transaction_id IS NOT NULL").drop("step")
    asks = both.withColumn("_asks", F.col("transaction_id").isNotNull())  # steps of an instant come before what asks then
    return running(asks, ["entity_id"], ["us", "_asks"], {name: Running("sum", F.col("step"))}, stretch).where("_asks").drop("step", "_asks")


def rolling_distinct(transactions: DataFrame, stretch: int | None = None) -> DataFrame:
    """Distinct merchants over 7 days and categories over 30."""
    merchants = distinct_by_sweep(transactions, "merchant_id", 7 * DAY, "unique_merchants_7d", stretch)
    categories = distinct_by_sweep(transactions, "merchant_category", 30 * DAY, "unique_categories_30d", stretch)
    return merchants.join(categories.select("transaction_id", "unique_categories_30d"), "transaction_id")


def is_new_merchant(transactions: DataFrame) -> DataFrame:
    """Whether an entity has not met a merchant before the instant: the first instant of a pair is an aggregate, combined on
    the way to the shuffle, so that a busy entity, or pair, is no one task's."""
    first = transactions.groupBy(F.col("entity_id").alias("_entity"), F.col("merchant_id").alias("_merchant")).agg(F.min("us").alias("_first"))
    rows = transactions.join(first, F.col("entity_id").eqNullSafe(F.col("_entity")) & F.col("merchant_id").eqNullSafe(F.col("_merchant")))
    return rows.select(*KEYS, "merchant_id", (F.col("us") <= F.col("_first")).alias("is_new_merchant"))


def newest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
