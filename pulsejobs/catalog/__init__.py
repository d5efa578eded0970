"""Queries by name, each with the DuckDB SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

#: Common table expressions of the oracles: samples of events, their windows of 16, embeddings as samples, feature rows.
SAMPLES = """s AS (
  SELECT user_id AS patient, row_number() OVER w - 1 AS idx, value AS ppg, coalesce(lag(value, 3) OVER w, 0) AS abp
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
len AS (SELECT patient, count(*) AS len FROM s GROUP BY patient)"""
WINDOWS = SAMPLES + """,
w AS (SELECT patient, idx // 16 AS j, idx % 16 AS i, ppg, abp FROM s JOIN len USING (patient) WHERE idx // 16 < len // 16)"""
WIDE = "e AS (SELECT label::BIGINT AS patient, vec_id AS trial, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
FEATURES = """f AS (
  SELECT o_custkey AS patient, o_orderkey AS trial, 80 + o_totalprice / 4000 AS SP, 40 + (o_totalprice % 7000) / 100 AS DP, f1, f2, f3, f4
  FROM orders JOIN (SELECT l_orderkey, avg(l_quantity) AS f1, max(l_extendedprice) AS f2, avg(l_discount) AS f3, count(*)::DOUBLE AS f4 FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""


def maxima_sql(src: str, out: str, key: str, x: str = "x", sign: str = "", i: str = "i") -> str:
    """CTEs that end in ``out`` (key, p): strict local maxima of a long table, a plateau at its middle."""
    return f"""{out}_0 AS (SELECT {key}, {i} AS i, {sign}{x} AS x, CASE WHEN {x} = lag({x}) OVER q THEN 0 ELSE 1 END AS new FROM {src} WINDOW q AS (PARTITION BY {key} ORDER BY {i})),
{out}_1 AS (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY i) AS grp FROM {out}_0),
{out}_2 AS (SELECT {key}, grp, any_value(x) AS x, min(i) AS lo, max(i) AS hi FROM {out}_1 GROUP BY ALL),
{out} AS (SELECT {key}, (lo + hi) // 2 AS p FROM (SELECT *, lag(x) OVER q AS l, lead(x) OVER q AS r FROM {out}_2 WINDOW q AS (PARTITION BY {key} ORDER BY grp)) WHERE x > l AND x > r)"""


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) and its SQL."""

    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def r6(c: str | Column) -> Column:
    """Rounded to 6 decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def r6s(c: str) -> str:
    return f"(round({c}, 6) + 0.0)"


def long_form(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """(keys, i, one column for each array, rounded)."""
    zipped = F.posexplode(F.arrays_zip(*arrays)).alias("i", "z")
    return df.select(*keys, zipped).select(*keys, F.col("i").cast("long").alias("i"), *[r6(F.col(f"z.{a}").cast("double")).alias(a) for a in arrays])


from . import records, windows, beats, wave_features, tables, model_jobs  # noqa: E402,F401
