"""Named queries over the driver's tables, each with a DuckDB oracle where SQL can express it."""

from __future__ import annotations

from spanlens.plans import (  # noqa: F401  (registers queries)
    contract_queries,
    graph_queries,
    io_queries,
    payload_queries,
    report_queries,
    session_queries,
    span_queries,
    stream_queries,
    tree_queries,
)
from spanlens.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
