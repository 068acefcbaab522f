"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# Views of the inputs for the SQL side; the same as in sources/tables.py.
EVENTS = r"""ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS entity_id, ts, epoch_us(ts) AS us, event_type, value,
    CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k FROM events)"""
TXN = (
    EVENTS
    + """, txn AS (SELECT event_id AS transaction_id, entity_id, ts, us, value AS amount, 'm' || k AS merchant_id,
    'c' || (k % 8) AS merchant_category, k % 2 = 0 AS is_online, k FROM ev WHERE event_type = 'purchase')"""
)
OBS = TXN + ", obs AS (SELECT event_id AS obs_id, entity_id, ts, us, value > 150 AS label FROM ev WHERE event_type = 'error')"
LOG = (
    OBS
    + """, feats AS (
    SELECT *, 'transaction' AS feature_group, 'transaction_amount' AS feature_name, CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR) AS feature_value FROM ev WHERE event_type = 'purchase'
    UNION ALL SELECT *, 'transaction', 'merchant_id', '"m' || k || '"' FROM ev WHERE event_type = 'purchase'
    UNION ALL SELECT *, 'transaction', 'merchant_category', '"c' || (k % 8) || '"' FROM ev WHERE event_type = 'purchase'
    UNION ALL SELECT *, 'transaction', 'is_online', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END FROM ev WHERE event_type = 'purchase'
    UNION ALL SELECT *, 'profile', 'account_age_days', CAST(k AS VARCHAR) FROM ev WHERE event_type = 'signup'
    UNION ALL SELECT *, 'profile', 'kyc_verified', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END FROM ev WHERE event_type = 'signup'),
    flog AS (SELECT entity_id, feature_group, 'v1' AS feature_version, feature_name, feature_value, ts AS event_time,
    ts + to_days(CAST(event_id % 10 AS INTEGER)) AS computed_at, event_id, us FROM feats)"""
)
