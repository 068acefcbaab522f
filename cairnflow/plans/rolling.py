"""Queries: rolling windows, point-in-time joins, batch aggregates, backfill, on-demand features."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions.columns import DAY, micros
from cairnflow.functions.columns import temporal_features as calendar
from cairnflow.operators import asof, backfill as bf, batch, ondemand, rolling
from cairnflow.plans.registry import EVENTS, LOG, OBS, TXN, query
from cairnflow.sources import tables
from cairnflow.sources.folders import shared_folder

AS_OF = datetime(2024, 1, 31)
MID = datetime(2024, 1, 20)
EARLY = datetime(2024, 1, 2)
TIMES = [datetime(2024, 1, 10), datetime(2024, 1, 20), datetime(2024, 1, 30)]


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded, whole numbers as long."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append((F.round(c, other.get(name, digits)) if kind == "double" else c.cast("long") if kind in ("int", "smallint") else c).alias(name))
    return df.select(*out)


_W = "RANGE BETWEEN INTERVAL {} MICROSECONDS PRECEDING AND INTERVAL 1 MICROSECONDS PRECEDING"
_FRAMES = ", ".join(
    f"{n} AS (PARTITION BY entity_id ORDER BY ts {_W.format(us - 1)})" for n, us in (("h", 3_600_000_000), ("d", DAY), ("w", 7 * DAY), ("m", 30 * DAY))
)
_FEATURES = f"""SELECT transaction_id, entity_id, us, count(*) OVER d AS transaction_count_24h, count(*) OVER w AS transaction_count_7d,
    count(*) OVER m AS transaction_count_30d, round(coalesce(sum(amount) OVER d, 0), 6) AS total_amount_24h,
    round(coalesce(avg(amount) OVER w, 0), 6) AS avg_amount_7d, round(coalesce(max(amount) OVER m, 0), 6) AS max_amount_30d,
    count(*) OVER h AS transactions_last_hour FROM {{}} WINDOW {_FRAMES}"""
_TIES = """, ties AS (SELECT o_orderkey AS transaction_id, CAST(o_custkey AS VARCHAR) AS entity_id, CAST(o_orderdate AS TIMESTAMP) AS ts,
    epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS us, CAST(o_totalprice AS DOUBLE) AS amount, o_orderpriority AS merchant_id, o_orderstatus AS merchant_category FROM orders)"""


@query(f"WITH {TXN} " + _FEATURES.format("txn"))
def rolling_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rolling.rolling_features(tables.transactions(spark, sf)))


@query(f"WITH {TXN}{_TIES} " + _FEATURES.format("ties"))
def rolling_features_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Many orders of a customer share a day: none sees another one of its own instant."""
    return rounded(rolling.rolling_features(tables.tied_transactions(spark, sf)))


@query(f"WITH {TXN} " + _FEATURES.format("txn"))
def rolling_features_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """The form for entities too busy for one task."""
    return rounded(rolling.rolling_features(tables.transactions(spark, sf), bucket=15 * DAY))


_DISTINCT = f"""WITH {TXN} SELECT transaction_id, entity_id, us, count(DISTINCT merchant_id) OVER (PARTITION BY entity_id ORDER BY ts {_W.format(7 * DAY - 1)}) AS unique_merchants_7d,
    count(DISTINCT merchant_category) OVER (PARTITION BY entity_id ORDER BY ts {_W.format(30 * DAY - 1)}) AS unique_categories_30d FROM txn"""


@query(_DISTINCT)
def rolling_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.rolling_distinct(tables.transactions(spark, sf)).select("transaction_id", "entity_id", "us", "unique_merchants_7d", "unique_categories_30d")


_ZSCORE = f"""WITH {TXN}, z AS (SELECT *, count(*) OVER p AS n, avg(amount) OVER p AS mu, stddev_pop(amount) OVER p AS sd, min(amount) OVER p AS lo, max(amount) OVER p AS hi
    FROM txn WINDOW p AS (PARTITION BY entity_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECONDS PRECEDING))
    SELECT transaction_id, entity_id, us, round(CASE WHEN n >= 2 AND lo < hi THEN (amount - mu) / sd ELSE 0 END, 4) AS amount_zscore FROM z"""


@query(_ZSCORE)
def rolling_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rolling.rolling_zscore(tables.transactions(spark, sf)), 4)


@query(_DISTINCT)
def rolling_distinct_stretched(spark: SparkSession, sf: str) -> DataFrame:
    """The form for entities too busy for one task, as the next one."""
    rows = rolling.rolling_distinct(tables.transactions(spark, sf), stretch=3 * DAY)
    return rows.select("transaction_id", "entity_id", "us", "unique_merchants_7d", "unique_categories_30d")


@query(_ZSCORE)
def rolling_zscore_stretched(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rolling.rolling_zscore(tables.transactions(spark, sf), stretch=3 * DAY), 4)


@query(
    f"""WITH {LOG} SELECT entity_id, feature_name, feature_value, us FROM flog
    QUALIFY row_number() OVER (PARTITION BY entity_id, feature_name ORDER BY event_time DESC, computed_at DESC, event_id DESC) = 1"""
)
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.feature_log(spark, sf)
    newest = rolling.newest_per_key(log, ["entity_id", "feature_name"], [F.desc("event_time"), F.desc("computed_at"), F.desc("event_id")])
    return newest.select("entity_id", "feature_name", "feature_value", micros("event_time").alias("us"))


@query(
    f"""WITH {TXN} SELECT transaction_id, entity_id, us, merchant_id,
    NOT EXISTS (SELECT 1 FROM txn b WHERE b.entity_id = a.entity_id AND b.merchant_id = a.merchant_id AND b.us < a.us) AS is_new_merchant FROM txn a"""
)
def is_new_merchant(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.is_new_merchant(tables.transactions(spark, sf))


@query(
    f"""WITH {EVENTS} SELECT event_id, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week, isodow(ts) >= 6 AS is_weekend, hour(ts) BETWEEN 9 AND 17 AS is_business_hours,
    weekofyear(ts) AS week_of_year, month(ts) AS month, quarter(ts) AS quarter FROM ev"""
)
def temporal_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tables.events(spark, sf).select("event_id", *(c.alias(n) for n, c in calendar(F.col("timestamp")).items())))


_PIT = """, pairs AS (SELECT o.obs_id, o.entity_id, o.us, f.feature_name, f.feature_value, f.us AS event_us,
    row_number() OVER (PARTITION BY o.obs_id, f.feature_name ORDER BY f.us DESC, f.computed_at DESC, f.event_id DESC) AS n
    FROM obs o JOIN flog f ON f.entity_id = o.entity_id AND f.us <= o.us WHERE f.feature_name IN ('transaction_amount', 'merchant_id', 'account_age_days')),
    newest AS (SELECT * FROM pairs WHERE n = 1)"""
_PIT_COLUMNS = ", ".join(
    f"max(CASE WHEN p.feature_name = '{f}' {{0}} THEN p.feature_value END) AS {f}" for f in ("transaction_amount", "merchant_id", "account_age_days")
)
_PIT_SELECT = "SELECT o.obs_id, o.entity_id, o.us, {} FROM obs o LEFT JOIN newest p ON p.obs_id = o.obs_id GROUP BY ALL"
PIT_FEATURES = ["transaction_amount", "merchant_id", "account_age_days"]


@query(f"WITH {LOG}{_PIT} " + _PIT_SELECT.format(_PIT_COLUMNS.format("")))
def pit_join(spark: SparkSession, sf: str) -> DataFrame:
    return asof.as_of_join(tables.observations(spark, sf), tables.feature_log(spark, sf), PIT_FEATURES)


@query(f"WITH {LOG}{_PIT} " + _PIT_SELECT.format(_PIT_COLUMNS.format(f"AND p.event_us >= p.us - {3 * DAY}")))
def pit_max_age(spark: SparkSession, sf: str) -> DataFrame:
    return asof.as_of_join(tables.observations(spark, sf), tables.feature_log(spark, sf), PIT_FEATURES, max_age=asof.age_limit(3))


@query(f"WITH {LOG}{_PIT} " + _PIT_SELECT.format(", ".join(f"coalesce({c.rpartition(' AS ')[0]}, '0') AS {c.rpartition(' AS ')[2]}" for c in _PIT_COLUMNS.format("").split(", max(")[0:1] + ["max(" + x for x in _PIT_COLUMNS.format("").split(", max(")[1:]])))
def pit_fill(spark: SparkSession, sf: str) -> DataFrame:
    return asof.as_of_join(tables.observations(spark, sf), tables.feature_log(spark, sf), PIT_FEATURES, fill="0")


_KNOWN = _PIT.replace("f.us <= o.us WHERE", "f.us <= o.us AND epoch_us(f.computed_at) <= o.us WHERE")


@query(f"WITH {LOG}{_KNOWN} " + _PIT_SELECT.format(_PIT_COLUMNS.format("")))
def pit_two_clocks(spark: SparkSession, sf: str) -> DataFrame:
    """Only values that had been computed by then: those computed days after their event are no news to older labels."""
    return asof.as_of_join(tables.observations(spark, sf), tables.feature_log(spark, sf), PIT_FEATURES, known=True)


@query(f"WITH {LOG}{_KNOWN} " + _PIT_SELECT.format(_PIT_COLUMNS.format("")))
def pit_two_clocks_stretched(spark: SparkSession, sf: str) -> DataFrame:
    """The form for entities too busy for one task."""
    return asof.as_of_join(tables.observations(spark, sf), tables.feature_log(spark, sf), PIT_FEATURES, known=True, stretch=4 * DAY)


@query(f"WITH {LOG}{_PIT} " + _PIT_SELECT.format(_PIT_COLUMNS.format("")))
def pit_stretched(spark: SparkSession, sf: str) -> DataFrame:
    return asof.as_of_join(tables.observations(spark, sf), tables.feature_log(spark, sf), PIT_FEATURES, stretch=4 * DAY)


@query(
    f"""WITH {LOG}, pairs AS (SELECT o.obs_id, f.feature_name, epoch_us(f.computed_at) > o.us AS late, row_number() OVER (PARTITION BY o.obs_id, f.feature_name ORDER BY f.us DESC, f.computed_at DESC, f.event_id DESC) AS n
    FROM obs o JOIN flog f ON f.entity_id = o.entity_id AND f.us <= o.us WHERE f.feature_name IN ('transaction_amount', 'merchant_id', 'account_age_days'))
    SELECT feature_name, (SELECT count(*) FROM obs) AS joined, count(*) FILTER (WHERE late) AS leaking FROM pairs WHERE n = 1 GROUP BY feature_name"""
)
def leakage_two_clocks(spark: SparkSession, sf: str) -> DataFrame:
    """How many values of a join by event time nobody knew at the time of the label."""
    rows = asof.leaking_values(tables.observations(spark, sf), tables.feature_log(spark, sf), PIT_FEATURES)
    return rows.groupBy("feature_name").agg(F.count("*").alias("joined"), F.count(F.when(F.col("leaks"), 1)).alias("leaking"))


@query(
    f"""WITH {LOG} SELECT entity_id, string_agg(DISTINCT feature_name, ',' ORDER BY feature_name) AS features FROM flog
    WHERE event_time <= TIMESTAMP '2024-01-20' AND computed_at > TIMESTAMP '2024-01-20' AND computed_at <= TIMESTAMP '2024-01-27' GROUP BY entity_id"""
)
def late_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    late = asof.late_arrivals(tables.feature_log(spark, sf), MID, 7)
    return late.select("entity_id", F.array_join("features", ",").alias("features"))


@query(
    f"""WITH {LOG} SELECT DISTINCT entity_id, feature_name FROM flog
    EXCEPT SELECT entity_id, feature_name FROM flog WHERE event_time <= TIMESTAMP '2024-01-02'"""
)
def newly_present(spark: SparkSession, sf: str) -> DataFrame:
    return asof.newly_present(tables.feature_log(spark, sf), EARLY)


@query(
    f"""WITH {LOG}, asked AS (SELECT DISTINCT entity_id, epoch_us(t) AS us FROM ev, (SELECT unnest([TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-30']) AS t)),
    p AS (SELECT a.entity_id, a.us, f.feature_value, row_number() OVER (PARTITION BY a.entity_id, a.us ORDER BY f.us DESC, f.computed_at DESC, f.event_id DESC) AS n
    FROM asked a JOIN flog f ON f.entity_id = a.entity_id AND f.us <= a.us AND f.feature_name = 'merchant_id')
    SELECT a.entity_id, a.us, p.feature_value AS merchant_id FROM asked a LEFT JOIN p ON p.entity_id = a.entity_id AND p.us = a.us AND p.n = 1"""
)
def time_travel(spark: SparkSession, sf: str) -> DataFrame:
    return asof.time_travel(tables.events(spark, sf), tables.feature_log(spark, sf), ["merchant_id"], TIMES)


@query(
    f"""WITH {TXN}, j AS (SELECT o.transaction_id, o.us AS label_us, f.us AS feature_us FROM txn o ASOF LEFT JOIN txn f ON f.entity_id = o.entity_id AND f.us <= o.us)
    SELECT count(*) AS joined, count(*) FILTER (WHERE feature_us > label_us) AS leaking FROM j"""
)
def leakage_audit(spark: SparkSession, sf: str) -> DataFrame:
    """After a point-in-time join no feature may be from after its label."""
    txn = tables.transactions(spark, sf)
    log = txn.select(
        "entity_id", F.lit("transaction").alias("feature_group"), F.lit("seen_us").alias("feature_name"), F.col("us").cast("string").alias("feature_value"),
        F.col("timestamp").alias("event_time"), F.col("timestamp").alias("computed_at"), F.col("transaction_id").alias("event_id"),
    )
    joined = asof.as_of_join(txn, log, ["seen_us"], keys=("transaction_id", "entity_id", "us"))
    joined = joined.withColumn("seen_us", F.col("seen_us").cast("long"))
    return joined.agg(F.count("*").alias("joined"), F.count(F.when(asof.leaks("seen_us", "us"), 1)).alias("leaking"))


_AGGS = """round(coalesce(avg(amount) FILTER (WHERE us >= {at} - 7 * 86400000000), 0), 6) AS avg_transaction_amount_7d,
    round(coalesce(stddev_samp(amount) FILTER (WHERE us >= {at} - 7 * 86400000000), 0), 4) AS std_transaction_amount_7d,
    count(DISTINCT merchant_id) FILTER (WHERE us >= {at} - 30 * 86400000000 AND merchant_id <> '') AS unique_merchants_30d,
    round(coalesce(sum(amount), 0), 6) AS user_lifetime_value"""
_NOW = "epoch_us(TIMESTAMP '2024-01-31')"


@query(f"WITH {TXN} SELECT entity_id, {_AGGS.format(at=_NOW)} FROM txn WHERE us <= {_NOW} AND us >= epoch_us(TIMESTAMP '2024-01-01') GROUP BY entity_id")
def batch_user_aggs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(batch.user_aggregates(tables.transactions(spark, sf), AS_OF, AS_OF), std_transaction_amount_7d=4)


@query(f"WITH {TXN} SELECT entity_id, count(*) FILTER (WHERE us > {_NOW} - 86400000000 AND us <= {_NOW}) AS transaction_count_24h FROM txn GROUP BY entity_id")
def batch_extra_aggs(spark: SparkSession, sf: str) -> DataFrame:
    return batch.daily_count(tables.transactions(spark, sf), AS_OF)


_MONTH = f"us >= {_NOW} - 30 * 86400000000 AND us <= {_NOW}"
_HOURS = f""", hours AS (SELECT entity_id, hour(ts) AS h, count(*) AS n FROM txn WHERE {_MONTH} GROUP BY ALL),
    typical AS (SELECT entity_id, h FROM (SELECT *, sum(n) OVER (PARTITION BY entity_id) AS t FROM hours) WHERE n * 24 >= t)"""


@query(f"WITH {TXN}{_HOURS} SELECT entity_id, string_agg(h::VARCHAR, ',' ORDER BY h) AS typical_active_hours FROM typical GROUP BY entity_id")
def typical_hours(spark: SparkSession, sf: str) -> DataFrame:
    hours = batch.typical_hours(tables.transactions(spark, sf), AS_OF)
    return hours.select("entity_id", F.array_join(F.col("typical_active_hours").cast("array<string>"), ",").alias("typical_active_hours"))


@query(
    f"""WITH {TXN}, c AS (SELECT entity_id, merchant_category, count(*) AS n FROM txn WHERE {_MONTH} GROUP BY ALL)
    SELECT entity_id, merchant_category, round(n / sum(n) OVER (PARTITION BY entity_id), 6) AS merchant_category_frequency FROM c"""
)
def category_freq(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(batch.category_frequency(tables.transactions(spark, sf), AS_OF))


@query(f"WITH {TXN} SELECT entity_id, string_agg(DISTINCT merchant_id, ',' ORDER BY merchant_id) AS known_merchant_ids FROM txn WHERE us < epoch_us(TIMESTAMP '2024-01-20') GROUP BY entity_id")
def known_merchants(spark: SparkSession, sf: str) -> DataFrame:
    known = batch.known_merchants(tables.transactions(spark, sf), MID)
    return known.select("entity_id", F.array_join("known_merchant_ids", ",").alias("known_merchant_ids"))


@query(f"WITH {TXN} SELECT entity_id, merchant_id, round(avg(amount), 6) AS merchant_avg_amount FROM txn GROUP BY ALL")
def merchant_avg(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(batch.merchant_averages(tables.transactions(spark, sf)))


@query(
    f"""WITH {TXN} SELECT entity_id, round(amount, 6) AS last_transaction_amount, merchant_id AS last_transaction_merchant FROM txn
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY us DESC, transaction_id DESC) = 1"""
)
def last_values(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(batch.last_values(tables.transactions(spark, sf)))


@query(
    f"""WITH {EVENTS}, g AS (SELECT entity_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY entity_id ORDER BY us) < 1800000000 THEN 0 ELSE 1 END AS starts FROM ev),
    s AS (SELECT entity_id, sum(starts) OVER (PARTITION BY entity_id ORDER BY us) AS s FROM g), c AS (SELECT entity_id, s, count(*) AS n FROM s GROUP BY ALL)
    SELECT entity_id, count(*) AS session_count, max(n) AS longest_session FROM c GROUP BY entity_id"""
)
def session_count(spark: SparkSession, sf: str) -> DataFrame:
    return batch.session_counts(tables.events(spark, sf))


@query(
    f"""WITH {TXN}, i AS (SELECT entity_id, CASE WHEN us >= {_NOW} - 72 * 3600000000 THEN amount END AS v FROM txn)
    SELECT entity_id, count(v) AS rolling_count, round(coalesce(sum(v), 0), 6) AS rolling_sum, round(coalesce(avg(v), 0), 6) AS rolling_avg, round(coalesce(stddev_samp(v), 0), 4) AS rolling_std FROM i GROUP BY entity_id"""
)
def rolling_helpers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(batch.rolling_as_of(tables.transactions(spark, sf), AS_OF, 72), rolling_std=4)


@query(
    f"""WITH {LOG}, c AS (SELECT entity_id, count(*) AS n FROM flog WHERE feature_group = 'transaction' AND event_time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' GROUP BY 1),
    e AS (SELECT DISTINCT entity_id FROM ev) SELECT count(*) AS expected, count(n) AS present, count(*) - count(n) AS missing, round(100.0 * count(n) / greatest(count(*), 1), 6) AS coverage_pct
    FROM e LEFT JOIN c USING (entity_id)"""
)
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    covered = batch.coverage(tables.feature_log(spark, sf), tables.events(spark, sf), "transaction", datetime(2024, 1, 10), datetime(2024, 1, 12))
    return rounded(batch.coverage_share(covered).withColumn("coverage_pct", F.col("coverage_pct").cast("double")))


@query(f"WITH {OBS} SELECT count(*) AS transactions, count(DISTINCT entity_id) AS users, min(us) AS first_us, max(us) AS last_us, round(sum(amount), 2) AS total, round(avg(amount), 6) AS mean, (SELECT round(avg(label::INT), 6) FROM obs) AS label_rate FROM txn")
def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.events(spark, sf)
    bought, observed = F.col("event_type") == "purchase", F.col("event_type") == "error"
    of = lambda c: F.when(bought, F.col(c))
    return e.agg(
        F.count(F.when(bought, 1)).alias("transactions"), F.count_distinct(of("entity_id")).alias("users"), F.min(of("us")).alias("first_us"),
        F.max(of("us")).alias("last_us"), F.round(F.sum(of("value")), 2).alias("total"), r(F.avg(of("value"))).alias("mean"),
        r(F.avg(F.when(observed, (F.col("value") > 150).cast("int")))).alias("label_rate"),
    )


@query(
    f"""WITH {TXN}, s AS (SELECT entity_id, {_AGGS.format(at=_NOW)} FROM txn WHERE us <= {_NOW} AND us >= epoch_us(TIMESTAMP '2024-01-01') GROUP BY entity_id)
    SELECT 'user_aggregates' AS job, f AS feature_name, count(*) AS n FROM s, (SELECT unnest(['avg_transaction_amount_7d', 'std_transaction_amount_7d', 'unique_merchants_30d', 'user_lifetime_value']) AS f) GROUP BY ALL
    UNION ALL SELECT 'daily_count', 'transaction_count_24h', count(DISTINCT entity_id) FROM txn"""
)
def batch_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """All registered jobs, their features as history."""
    return batch.run_jobs(tables.transactions(spark, sf), AS_OF).groupBy("job", "feature_name").agg(F.count("*").alias("n"))


START, END = date(2024, 1, 1), date(2024, 1, 30)
_BACKFILL = f""", days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS as_of),
    filled AS (SELECT entity_id, as_of, {_AGGS.format(at="epoch_us(as_of::TIMESTAMP)")} FROM days JOIN txn ON us <= epoch_us(as_of::TIMESTAMP) AND us >= epoch_us(as_of::TIMESTAMP) - 31 * 86400000000 GROUP BY ALL)"""
_DAY = "strftime(as_of, '%Y-%m-%d') AS as_of"


def _dated(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("as_of", F.col("as_of").cast("string")), std_transaction_amount_7d=4)


@query(f"WITH {TXN}{_BACKFILL} SELECT * REPLACE ({_DAY}) FROM filled")
def backfill(spark: SparkSession, sf: str) -> DataFrame:
    return _dated(bf.backfill(tables.transactions(spark, sf), START, END))


@query(f"WITH {TXN}{_BACKFILL} SELECT * REPLACE ({_DAY}) FROM filled WHERE as_of NOT IN (SELECT DISTINCT CAST(ts AS DATE) FROM ev WHERE day(ts) % 3 = 0)")
def backfill_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Days that are done already, every third one here, are skipped."""
    e = tables.events(spark, sf)
    done = e.where(F.dayofmonth("timestamp") % 3 == 0).select(F.to_date("timestamp").alias("as_of"))
    return _dated(bf.backfill(tables.transactions(spark, sf), START, END, done))


@query(f"WITH {TXN}{_BACKFILL} SELECT * REPLACE ({_DAY}) FROM filled")
def backfill_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    """Written twice, the second time over some days only: the table is as if written once."""
    path = shared_folder(spark, "backfill")
    rows = bf.backfill(tables.transactions(spark, sf), START, END)
    bf.write(rows, path)
    bf.write(rows.where(F.dayofmonth("as_of") > 20), path)
    columns = ["entity_id", "as_of", "avg_transaction_amount_7d", "std_transaction_amount_7d", "unique_merchants_30d", "user_lifetime_value"]
    return _dated(spark.read.parquet(path).select(*columns))


_HOLES = """, present AS (SELECT DISTINCT entity_id, feature_name, CAST(event_time AS DATE) AS day FROM flog WHERE CAST(event_time AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'),
    expected AS (SELECT e.entity_id, f.feature_name FROM (SELECT DISTINCT entity_id FROM ev) e, (SELECT unnest(['transaction_amount', 'account_age_days']) AS feature_name) f),
    missing AS (SELECT x.entity_id, x.feature_name, d.as_of AS day FROM expected x, days d WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.entity_id = x.entity_id AND p.feature_name = x.feature_name AND p.day = d.as_of)),
    islands AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY entity_id, feature_name ORDER BY day) AS INTEGER) AS island FROM missing),
    holes AS (SELECT entity_id, feature_name, min(day) AS a, max(day) AS z FROM islands GROUP BY entity_id, feature_name, island)"""


def _holes(spark: SparkSession, sf: str) -> DataFrame:
    names = F.explode(F.array(F.lit("transaction_amount"), F.lit("account_age_days"))).alias("feature_name")
    expected = tables.events(spark, sf).select("entity_id").distinct().select("entity_id", names)
    return bf.holes(tables.feature_log(spark, sf), expected, START, END)


@query(f"WITH {LOG}{_BACKFILL}{_HOLES} SELECT entity_id, feature_name, strftime(a, '%Y-%m-%d') AS first, strftime(z, '%Y-%m-%d') AS last FROM holes")
def coverage_holes(spark: SparkSession, sf: str) -> DataFrame:
    """The ranges of days on which an entity has no value of a feature."""
    return _holes(spark, sf).withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


@query(f"WITH {LOG}{_BACKFILL}{_HOLES} SELECT * REPLACE ({_DAY}) FROM filled f WHERE EXISTS (SELECT 1 FROM holes h WHERE h.entity_id = f.entity_id AND h.feature_name = 'transaction_amount' AND f.as_of BETWEEN h.a AND h.z)")
def backfill_holes(spark: SparkSession, sf: str) -> DataFrame:
    """Only what is missing is made: the days of each entity without a transaction."""
    missing = _holes(spark, sf).where("feature_name = 'transaction_amount'")
    return _dated(bf.backfill(tables.transactions(spark, sf), START, END, holes=missing))


@query(f"WITH {TXN}{_BACKFILL} SELECT {_DAY}, entity_id, avg_transaction_amount_7d FROM filled WHERE entity_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)")
def batch_filtered(spark: SparkSession, sf: str) -> DataFrame:
    wanted = tables.read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("entity_id"))
    rows = bf.restricted(tables.transactions(spark, sf), wanted)
    return _dated(bf.backfill(rows, START, END).select("entity_id", "as_of", "avg_transaction_amount_7d"))


@query(
    f"""WITH {TXN}, s AS (SELECT entity_id, {_AGGS.format(at=_NOW)} FROM txn WHERE us <= {_NOW} AND us >= epoch_us(TIMESTAMP '2024-01-01') GROUP BY entity_id),
    x AS (SELECT entity_id, avg(amount) AS mu, stddev_samp(amount) AS sd FROM txn WHERE us >= {_NOW} - 7 * 86400000000 AND us <= {_NOW} GROUP BY entity_id)
    SELECT transaction_id, round(CASE WHEN sd > 0 THEN (amount - mu) / sd ELSE 0 END, 4) AS amount_zscore FROM txn LEFT JOIN x USING (entity_id)"""
)
def ondemand_zscore(spark: SparkSession, sf: str) -> DataFrame:
    txn = tables.transactions(spark, sf)
    stored = batch.user_aggregates(txn, AS_OF, AS_OF)
    z = ondemand.zscore(F.col("amount"), F.col("avg_transaction_amount_7d"), F.col("std_transaction_amount_7d"))
    return ondemand.with_stored(txn, stored, ["entity_id"]).select("transaction_id", r(z, 4).alias("amount_zscore"))


@query(f"WITH {TXN} SELECT transaction_id, NOT EXISTS (SELECT 1 FROM txn b WHERE b.entity_id = a.entity_id AND b.merchant_id = a.merchant_id AND b.us < epoch_us(TIMESTAMP '2024-01-20')) AS is_new_merchant FROM txn a")
def ondemand_new_merchant(spark: SparkSession, sf: str) -> DataFrame:
    txn = tables.transactions(spark, sf)
    rows = ondemand.with_stored(txn, batch.known_merchants(txn, MID), ["entity_id"])
    return rows.select("transaction_id", ondemand.new_merchant(F.col("known_merchant_ids"), F.col("merchant_id")).alias("is_new_merchant"))


@query(
    f"""WITH {TXN}{_HOURS} SELECT transaction_id, entity_id IN (SELECT entity_id FROM typical) AND NOT EXISTS (SELECT 1 FROM typical t WHERE t.entity_id = a.entity_id AND t.h = hour(a.ts)) AS is_high_risk_time FROM txn a"""
)
def high_risk_time(spark: SparkSession, sf: str) -> DataFrame:
    txn = tables.transactions(spark, sf)
    rows = ondemand.with_stored(txn, batch.typical_hours(txn, AS_OF), ["entity_id"])
    return rows.select("transaction_id", ondemand.high_risk_time(F.col("typical_active_hours"), F.col("timestamp")).alias("is_high_risk_time"))


@query(
    f"""WITH {TXN}, m AS (SELECT entity_id, merchant_id, avg(amount) AS a FROM txn WHERE us < epoch_us(TIMESTAMP '2024-01-20') GROUP BY ALL)
    SELECT transaction_id, round(coalesce(amount - a, 0), 6) AS amount_deviation FROM txn LEFT JOIN m USING (entity_id, merchant_id)"""
)
def merchant_deviation(spark: SparkSession, sf: str) -> DataFrame:
    txn = tables.transactions(spark, sf)
    stored = batch.merchant_averages(txn.where(F.col("us") < F.unix_micros(F.lit(MID).cast("timestamp"))))
    rows = ondemand.with_stored(txn, stored, ["entity_id", "merchant_id"])
    return rows.select("transaction_id", r(ondemand.merchant_deviation(F.col("amount"), F.col("merchant_avg_amount"))).alias("amount_deviation"))


@query(
    f"""WITH {TXN}, e AS (SELECT DISTINCT entity_id FROM ev), l AS (SELECT entity_id, amount, merchant_id FROM txn QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY us DESC, transaction_id DESC) = 1),
    c AS (SELECT entity_id, count(*) FILTER (WHERE us > {_NOW} - 86400000000 AND us <= {_NOW}) AS d, count(*) FILTER (WHERE us > {_NOW} - 3600000000 AND us <= {_NOW}) AS h FROM txn GROUP BY 1)
    SELECT entity_id, coalesce(d, 0) AS transaction_count_24h, coalesce(h, 0)::DOUBLE AS transaction_velocity_1h, round(amount, 6) AS last_transaction_amount, merchant_id AS last_transaction_merchant
    FROM e LEFT JOIN c USING (entity_id) LEFT JOIN l USING (entity_id)"""
)
def user_realtime_bundle(spark: SparkSession, sf: str) -> DataFrame:
    txn, now = tables.transactions(spark, sf), F.unix_micros(F.lit(AS_OF).cast("timestamp"))
    since = lambda length: F.count(F.when((F.col("us") > now - length) & (F.col("us") <= now), 1))
    counts = txn.groupBy("entity_id").agg(since(DAY).alias("d"), since(DAY // 24).alias("h"))
    rows = tables.events(spark, sf).select("entity_id").distinct().join(counts, "entity_id", "left").join(batch.last_values(txn), "entity_id", "left")
    return rows.select(
        "entity_id", F.coalesce("d", F.lit(0)).alias("transaction_count_24h"), rolling.velocity(F.coalesce("h", F.lit(0))).alias("transaction_velocity_1h"),
        r("last_transaction_amount").alias("last_transaction_amount"), "last_transaction_merchant",
    )


