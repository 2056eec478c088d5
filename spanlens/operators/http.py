"""HTTP call extraction (P17), JVM-side on VARIANT.

The first ``input`` element that is an object with a string ``method`` and a string request target, where the
target is the first non-null of ``url``, ``path``, ``pathname``. Method upper-cased, header values as text
(``String(v)`` rules: objects print ``[object Object]``), body or NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.schema import conform


def _present(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.is_variant_null(c), c)


def _target(x: Column) -> Column:
    return F.coalesce(*[_present(F.variant_get(x, f"$.{k}", "variant")) for k in ("url", "path", "pathname")])


def _is_request(x: Column) -> Column:
    return (
        F.schema_of_variant(x).startswith("OBJECT")
        & (F.schema_of_variant(F.variant_get(x, "$.method", "variant")) == "STRING")
        & (F.schema_of_variant(_target(x)) == "STRING")
    )


def _item_text(v: Column, levels: int) -> Column:
    """An array element as JavaScript joins it: null is empty, nested arrays are joined; below ``levels`` arrays stay JSON."""
    t = F.schema_of_variant(v)
    nested = F.to_json(v) if not levels else F.array_join(
        F.transform(F.variant_get(v, "$", "array<variant>"), lambda x: _item_text(x, levels - 1)), ",")
    return (
        F.when(v.isNull() | (t == "VOID"), F.lit(""))
        .when(t == "STRING", F.variant_get(v, "$", "string"))
        .when(t.startswith("OBJECT"), F.lit("[object Object]"))
        .when(t.startswith("ARRAY"), nested)
        .otherwise(F.to_json(v))
    )


def _as_text(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return (
        F.when(t == "STRING", F.variant_get(v, "$", "string"))
        .when(t.startswith("OBJECT"), F.lit("[object Object]"))
        .when(t.startswith("ARRAY"), F.array_join(F.transform(F.variant_get(v, "$", "array<variant>"), lambda x: _item_text(x, 3)), ","))
        .otherwise(F.to_json(v))
    )


def http_calls(spans: DataFrame) -> DataFrame:
    """Spans whose arguments contain an HTTP request: method, url, headers (map), body (JSON text)."""
    s = conform(spans)
    args = F.try_variant_get(F.try_parse_json("input_json"), "$", "array<variant>")
    req = F.filter(args, _is_request)[0]
    r = s.select("span_id", "trace_id", "agent_id", "function_name", req.alias("_req")).where(F.col("_req").isNotNull())
    headers = F.try_variant_get(F.col("_req"), "$.headers", "map<string,variant>")
    body = _present(F.variant_get(F.col("_req"), "$.body", "variant"))
    return r.select(
        "span_id", "trace_id", "agent_id", "function_name",
        F.upper(F.variant_get("_req", "$.method", "string")).alias("method"),
        F.variant_get(_target(F.col("_req")), "$", "string").alias("url"),
        F.coalesce(F.transform_values(headers, lambda k, v: _as_text(v)),
                   F.create_map().cast("map<string,string>")).alias("headers"),
        F.to_json(body).alias("body"),
    )
