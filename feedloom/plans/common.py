"""Registration of queries with the SQL that defines them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from feedloom.operators.stage import Stage

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

#: The domain views in the oracle's SQL, as common table expressions.
EV = """ev AS (SELECT event_id, CAST(user_id AS BIGINT) AS user_id, CAST(json_extract_string(props, '$.k') AS INT) AS video_id,
 CAST(json_extract_string(props, '$.k') AS INT) % 20 AS author_id, epoch_us(ts) // 1000 AS time_ms,
 CAST(strftime(ts + INTERVAL 8 HOUR, '%Y%m%d') AS INT) AS date, CAST(hour(ts + INTERVAL 8 HOUR) * 100 + minute(ts + INTERVAL 8 HOUR) AS INT) AS hourmin,
 CAST(event_type = 'click' AS INT) AS is_click, CAST(event_type = 'view' AS INT) AS long_view, CAST(event_type = 'purchase' AS INT) AS is_like,
 CAST(event_type = 'signup' AS INT) AS is_comment, CAST(event_type = 'error' AS INT) AS is_follow, CAST(event_id % 5 AS INT) AS tab, value FROM events),
lg AS (SELECT *, CASE WHEN date <= 20240107 THEN 'warmup' WHEN date <= 20240122 THEN 'train' WHEN date <= 20240126 THEN 'valid' WHEN date <= 20240130 THEN 'test' ELSE 'unused' END AS split,
 CAST(strptime(CAST(date AS VARCHAR), '%Y%m%d') AS DATE) AS day FROM ev)"""
OR = """lo AS (SELECT o_custkey AS user_id, l_partkey AS video_id, l_suppkey AS author_id, o_orderdate AS ts, CAST(l_returnflag = 'R' AS INT) AS positive, year(o_orderdate) AS year
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the defining SQL if SQL can say it."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


def once(df: DataFrame) -> DataFrame:
    """``df`` written and read back, for plans that read it several times: its joins run once."""
    return Stage(df.sparkSession).write(df, "once")
