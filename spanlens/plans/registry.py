"""Registry of named queries: each is ``fn(spark, sf_dir) -> DataFrame`` with an optional DuckDB oracle SQL.

Queries read the driver's tables (or Spark-derived span views of them) whole; no row caps, id subsets or
sampling. Doubles that come out of sums are reported rounded to 6 places with the same IEEE formula on both
sides (``floor(x * 1e6 + 0.5) / 1e6``) so engine-specific summation order cannot change the result text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.functions.scalar import js_round
from spanlens.sources import fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return deco


def r6(c: Column | str) -> Column:
    return js_round(c, 6)


def sql_r6(expr: str) -> str:
    return f"floor(({expr}) * 1000000.0 + 0.5) / 1000000.0"


def sql_r(expr: str, digits: int) -> str:
    scale = f"{10 ** digits}.0"
    return f"floor(({expr}) * {scale} + 0.5) / {scale}"


# The span views stay lazy: filters and column choices of a query reach the scans below them.


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.span_events(spark, sf_dir)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.span_orders(spark, sf_dir)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.span_turns(spark, sf_dir)


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes)


EV = fixtures.SPAN_EVENTS_CTE
ORD = fixtures.SPAN_ORDERS_CTE
TURNS = fixtures.SPAN_TURNS_CTE

# W1 in SQL window form (a different formulation from the library's first-occurrence join)
EV_FLAGGED = """
flagged as (
  select *,
    (row_number() over (partition by agent_id, function_name, output_type order by received_at, ingest_seq) = 1
     and row_number() over (partition by agent_id, function_name order by received_at, ingest_seq) > 1) as anomaly
  from span_events)
"""

