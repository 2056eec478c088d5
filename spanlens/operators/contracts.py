"""Contracts: JSON-schema inference, confidence, drift, validation, typed read.

Inference is a recursive rule over the values seen at each position of a payload. It only ever looks at the
multiset of values at one path, split by JS type, so it is computed as:

1. ``payload_values``: every argument / return value is flattened into rows ``(group, slot, path, js_type,
   json, str_value)``, one nesting level per step (VARIANT ``map`` / ``array`` explode), children of objects under
   ``.key`` and elements of arrays under ``[]``;
2. ``value_profile`` (C1): one partial+final aggregation per (group, slot, path, type): count, first arrival,
   format hits, distinct count, and the first 11 distinct values (``row_number() <= 11`` plans as a map-side
   ``WindowGroupLimit``, so a hot path never ships more than 11 values per task);
3. ``infer_contracts`` (C2-C8): the schema text is assembled bottom-up from the deepest path to the root on the
   profile table, whose size is the size of the schemas, not of the data.

Canonical order (a documented deviation): object properties are sorted by key (VARIANT sorts keys), union
branches and enum values follow first arrival.

Drift (C10) and confidence (C12) work on ``schema_nodes``: one row per schema node reachable through
``properties`` / ``items`` (not into ``oneOf`` branches, like the reference). Validation (C9) turns each contract into a
list of schema nodes, joins it to the function's spans and takes the values down the nodes level by level inside the row.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlens.functions.scalar import FORMAT_ORDER, FORMAT_PATTERNS, js_round
from spanlens.schema import arrival_key, conform
from spanlens.session import cut_lineage, written

# Fixed values of the inference rules.
ENUM_MAX_DISTINCT = 10
FORMAT_MATCH_THRESHOLD = 0.8
REQUIRED_THRESHOLD = 0.9
MIN_SAMPLES = 5

PRIMITIVES = ["boolean", "number", "string"]


def _vtype(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit("undefined"))
        .when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY"), "array")
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(t == "VOID", "null")
        .otherwise("number")
    )


# ---------------------------------------------------------------- C1: flatten + profile


#: Nesting levels that one pass flattens inside a row before it explodes.
_LEVELS = 3


def _map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


_NODE = "struct<seg: array<string>, p: array<int>, v: variant>"


def _members(x: Column) -> Column:
    """The values inside a value: object members under ``.key``, array elements under ``[]`` with their positions."""
    node = lambda seg, p, v: F.struct(F.concat(x["seg"], F.array(seg)).alias("seg"), p.alias("p"), v.alias("v"))
    of_object = F.transform(F.map_entries(_map(x["v"])), lambda e: node(F.concat(F.lit("."), e["key"]), x["p"], e["value"]))
    of_array = F.transform(_list(x["v"]), lambda e, i: node(F.lit("[]"), F.concat(x["p"], F.array(i)), e))
    kind = _vtype(x["v"])
    return F.when(kind == "object", of_object).when(kind == "array", of_array).otherwise(F.array().cast(f"array<{_NODE}>"))


def payload_values(spans: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Flatten arguments (slot ``args[i]``) and non-error returns (slot ``return``) into path rows, written once as a table.

    A row of spans is read once. Three levels are flattened inside it, then its values become rows; values nested deeper than that are
    rows of the next pass, which reads only them.
    """
    g = group_cols or ["function_name"]
    s = conform(spans)
    root = lambda slot, p, v: F.struct(slot.alias("slot"), F.struct(F.array().cast("array<string>").alias("seg"), p.alias("p"), v.alias("v")).alias("x"))
    args = F.coalesce(F.transform(_list(F.try_parse_json("input_json")), lambda v, i: root(F.concat(F.lit("args["), i.cast("string"), F.lit("]")), F.array(i), v)),
                      F.array().cast(f"array<struct<slot: string, x: {_NODE}>>"))
    ret = F.array(root(F.lit("return"), F.array().cast("array<int>"), F.try_parse_json("output_json")))
    rows = s.select(*g, arrival_key().alias("_a"), F.explode(F.concat(args, F.when(~F.col("has_error"), ret).otherwise(
        F.array().cast(f"array<struct<slot: string, x: {_NODE}>>")))).alias("r")).select(*g, "_a", "r.slot", F.array("r.x").alias("level"))
    out = None
    while True:
        levels = ["level"]
        for i in range(1, _LEVELS):
            rows = rows.withColumn(f"level{i}", F.flatten(F.transform(levels[-1], _members)))
            levels.append(f"level{i}")
        x = rows.select(*g, "_a", "slot", F.explode(F.concat(*levels)).alias("x")).select(*g, "_a", "slot", "x.*").withColumn("js_type", _vtype(F.col("v")))
        deeper = F.size("seg") % _LEVELS == _LEVELS - 1
        done = written(x.select(
            *g, "slot", F.col("seg").alias("path"), "js_type",
            # a value's place in arrival order: its span's, then the positions of the array elements that lead to it
            F.struct(F.col("_a").alias("a"), F.col("p").alias("p")).alias("_arr"),
            F.when(F.col("js_type").isin(*PRIMITIVES), F.to_json("v")).alias("json"),
            F.when(F.col("js_type") == "string", F.try_variant_get("v", "$", "string")).alias("str_value"),
            F.when(deeper & F.col("js_type").isin("object", "array"), F.to_json("v")).alias("_more")))
        part = done.drop("_more")
        out = part if out is None else out.unionByName(part)
        rest = done.where(F.col("_more").isNotNull())
        if rest.isEmpty():
            return out
        inner = F.struct(F.col("path").alias("seg"), F.col("_arr.p").alias("p"), F.try_parse_json("_more").alias("v"))
        rows = rest.select(*g, F.col("_arr.a").alias("_a"), "slot", _members_of(inner).alias("level"))


def _members_of(x: Column) -> Column:
    return F.flatten(F.transform(F.array(x), _members))


def value_profile(spans: DataFrame, group_cols: list[str] | None = None, values: DataFrame | None = None
                  ) -> DataFrame:
    """Per (group, slot, path, js_type): n, first arrival, format hits, distinct count, first distinct values."""
    g = group_cols or ["function_name"]
    vals = values if values is not None else payload_values(spans, g)
    key = [*g, "slot", "path", "js_type"]
    # one pass over the values: counts per distinct value (containers have no value text and count as one group)
    per_value = written(vals.groupBy(*key, "json").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_arr").alias("_vf"), F.first("str_value").alias("_sv")))
    fmt_aggs = [F.sum(F.when(F.col("_sv").rlike(FORMAT_PATTERNS[f]), F.col("_c")).otherwise(F.lit(0)))
                .alias(f"fmt_{f.replace('-', '_')}") for f in FORMAT_ORDER]
    prof = per_value.groupBy(*key).agg(
        F.sum("_c").alias("n"), F.min("_vf").alias("first_arr"), *fmt_aggs,
        F.count("json").alias("n_distinct"))
    dv = per_value.where(F.col("json").isNotNull())
    w = Window.partitionBy(*key).orderBy("_vf", "json")
    top = dv.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= ENUM_MAX_DISTINCT + 1)
    top = top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_vf", "json"))).alias("_vals"))
    return prof.join(top, key, "left").select(
        *key, "n", "first_arr", *[f"fmt_{f.replace('-', '_')}" for f in FORMAT_ORDER],
        F.when(F.col("n_distinct") > 0, F.col("n_distinct")).alias("n_distinct"),
        F.transform("_vals", lambda x: x["json"]).alias("first_values"),
    )


# ---------------------------------------------------------------- C2-C8: assembly


def _quoted(c: Column) -> Column:
    return F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)


def _primitive_branch() -> Column:
    """Schema text of a boolean / number / string / null / undefined branch from its profile row."""
    enum = F.concat(F.lit('{"enum":['), F.array_join("first_values", ","), F.lit("]}"))
    small = F.col("n_distinct") <= ENUM_MAX_DISTINCT
    fmt = F.lit(None).cast("string")
    for f in reversed(FORMAT_ORDER):
        hits = F.col(f"fmt_{f.replace('-', '_')}")
        fmt = F.when(hits / F.col("n") >= FORMAT_MATCH_THRESHOLD, F.lit(f)).otherwise(fmt)
    string_schema = (
        F.when(fmt.isNotNull(), F.concat(F.lit('{"type":"string","format":'), _quoted(fmt), F.lit("}")))
        .when(small, enum)
        .otherwise(F.lit('{"type":"string"}'))
    )
    t = F.col("js_type")
    return (
        F.when(t == "null", F.lit('{"type":"null"}'))
        .when(t == "undefined", F.lit('{"type":"string"}'))
        .when(t == "string", string_schema)
        .when(small, enum)
        .otherwise(F.concat(F.lit('{"type":"'), t, F.lit('"}')))
    )


def assemble_schemas(profile: DataFrame, group_cols: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Schema text per (group, slot) root from a value profile, deepest paths first."""
    g = group_cols or ["function_name"]
    p = profile.withColumn("_d", F.size("path"))
    max_d = p.agg(F.max("_d")).first()[0]
    if max_d is None:
        return p.select(*g, "slot", F.lit(None).cast("string").alias("schema")).limit(0)
    child = None  # schemas at depth d + 1: group, slot, path, schema, n_all
    for d in range(max_d, -1, -1):
        rows = p.where(F.col("_d") == d)
        branch = _primitive_branch()
        if child is not None:
            c = child.select(
                *[F.col(k).alias("_c_" + k) for k in g], F.col("slot").alias("_c_slot"),
                F.slice("path", 1, d).alias("_parent"), F.element_at("path", -1).alias("_seg"),
                "schema", "n_all",
            )
            objs = rows.where(F.col("js_type") == "object")
            cond = [F.col(k) == F.col("_c_" + k) for k in g] + [
                F.col("slot") == F.col("_c_slot"), F.col("path") == F.col("_parent"),
                F.col("_seg").startswith("."),
            ]
            # presence needs the parent's object count: join first, then aggregate
            pj = objs.select(*g, "slot", "path", F.col("n").alias("_nobj")).join(c, cond, "inner")
            props = pj.groupBy(*g, "slot", "path").agg(
                F.array_sort(F.collect_list(F.struct(
                    F.expr("substring(_seg, 2)").alias("k"), "schema",
                    (F.col("n_all") / F.col("_nobj") >= REQUIRED_THRESHOLD).alias("req"),
                ))).alias("_props")
            )
            items_cond = [F.col(k) == F.col("_c_" + k) for k in g] + [
                F.col("slot") == F.col("_c_slot"), F.col("path") == F.col("_parent"), F.col("_seg") == "[]",
            ]
            items = rows.where(F.col("js_type") == "array").select(*g, "slot", "path").join(
                c, items_cond, "inner").select(*g, "slot", "path", F.col("schema").alias("_items"))
            rows = rows.join(props, [*g, "slot", "path"], "left").join(items, [*g, "slot", "path"], "left")
        else:
            rows = rows.withColumn("_props", F.lit(None).cast(
                "array<struct<k:string,schema:string,req:boolean>>")).withColumn("_items", F.lit(None).cast("string"))
        prop_text = F.array_join(F.transform("_props", lambda x: F.concat(_quoted(x["k"]), F.lit(":"), x["schema"])), ",")
        req = F.filter("_props", lambda x: x["req"])
        req_text = F.when(F.size(req) > 0, F.concat(
            F.lit(',"required":['), F.array_join(F.transform(req, lambda x: _quoted(x["k"])), ","), F.lit("]")
        )).otherwise(F.lit(""))
        obj_schema = F.concat(F.lit('{"type":"object","properties":{'), F.coalesce(prop_text, F.lit("")), F.lit("}"),
                              F.when(F.col("_props").isNull(), F.lit("")).otherwise(req_text), F.lit("}"))
        arr_schema = F.concat(F.lit('{"type":"array"'),
                              F.when(F.col("_items").isNotNull(), F.concat(F.lit(',"items":'), F.col("_items")))
                              .otherwise(F.lit("")), F.lit("}"))
        rows = rows.withColumn(
            "_branch",
            F.when(F.col("js_type") == "object", obj_schema).when(F.col("js_type") == "array", arr_schema)
            .otherwise(branch),
        )
        key = [*g, "slot", "path"]
        if strict:
            w = Window.partitionBy(*key).orderBy(F.col("n").desc(), "first_arr")
            picked = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            tot = rows.groupBy(*key).agg(F.sum("n").alias("n_all"))
            level = picked.join(tot, key).select(*key, F.col("_branch").alias("schema"), "n_all")
        else:
            level = rows.groupBy(*key).agg(
                F.array_sort(F.collect_list(F.struct("first_arr", "js_type", "_branch"))).alias("_b"),
                F.sum("n").alias("n_all"),
            ).select(
                *key,
                F.when(F.size("_b") == 1, F.col("_b")[0]["_branch"]).otherwise(
                    F.concat(F.lit('{"oneOf":['), F.array_join(F.transform("_b", lambda x: x["_branch"]), ","), F.lit("]}"))
                ).alias("schema"),
                "n_all",
            )
        child = cut_lineage(level)
    return child.select(*g, "slot", "schema")


def error_schemas(spans: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """One object schema per distinct error type, in first-seen order; NULL when a group has no errors."""
    g = group_cols or ["function_name"]
    s = conform(spans).where(F.col("has_error"))
    firsts = s.groupBy(*g, "error_type").agg(F.min(arrival_key()).alias("_f"))
    text = F.concat(
        F.lit('{"type":"object","properties":{"type":{"enum":['), F.coalesce(_quoted(F.col("error_type")), F.lit("null")),
        F.lit(']},"message":{"type":"string"}},"required":["type","message"]}'),
    )
    return firsts.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("_f", text.alias("t")))).alias("_e")).select(
        *g, F.transform("_e", lambda x: x["t"]).alias("errors")
    )


def infer_contracts(spans: DataFrame, min_samples: int = MIN_SAMPLES, strict: bool = False,
                    group_cols: list[str] | None = None) -> DataFrame:
    """One contract per function with at least ``min_samples`` spans (errors included).

    Columns: group columns, version, generated_at, sample_count, args (array of schema JSON text by position),
    returns (schema JSON text, ``{}`` without successful calls), errors (array of JSON text or NULL).
    """
    g = group_cols or ["function_name"]
    s = conform(spans)
    counts = s.groupBy(*g).agg(F.count(F.lit(1)).alias("sample_count")).where(F.col("sample_count") >= min_samples)
    counts = written(counts)
    kept = value_profile(s, g).join(counts.select(*g), g, "left_semi")  # profiles of functions, not their spans
    roots = assemble_schemas(written(kept), g, strict)
    args = roots.where(F.col("slot").startswith("args[")).withColumn(
        "_i", F.regexp_extract("slot", "\\[(\\d+)\\]", 1).cast("int")
    ).groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("_i", "schema"))).alias("_a"))
    rets = roots.where(F.col("slot") == "return").select(*g, F.col("schema").alias("returns"))
    errs = error_schemas(s, g)
    return counts.join(args, g, "left").join(rets, g, "left").join(errs, g, "left").select(
        *g,
        F.lit("1.0").alias("version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generated_at"),
        "sample_count",
        F.coalesce(F.transform("_a", lambda x: x["schema"]), F.array().cast("array<string>")).alias("args"),
        F.coalesce("returns", F.lit("{}")).alias("returns"),
        "errors",
    )


# ---------------------------------------------------------------- schema nodes, confidence, drift


def schema_nodes(contracts: DataFrame, key: str = "function_name", roots: DataFrame | None = None) -> DataFrame:
    """Schema nodes reachable through properties / items from each root (``args[i]``, ``returns``).

    Columns: key, steps (array of path parts; tells nodes apart), path (the same as text), parent_path, prop_key, via_items, type_json, format, enum_json, has_oneof,
    has_properties, prop_keys, required, has_items.
    """
    if roots is None:
        a = contracts.select(key, F.posexplode("args").alias("_i", "_s")).select(
            key, F.concat(F.lit("args["), F.col("_i").cast("string"), F.lit("]")).alias("path"), "_s")
        r = contracts.select(key, F.lit("returns").alias("path"), F.col("returns").alias("_s"))
        roots = a.unionByName(r)
    level = roots.select(key, F.array("path").alias("steps"), "path", F.try_parse_json("_s").alias("v"),
                         F.lit(None).cast("string").alias("parent_path"), F.lit(None).cast("string").alias("prop_key"),
                         F.lit(False).alias("via_items"))
    out = []
    while True:
        lv = cut_lineage(level.select(
            "*",
            F.coalesce(F.to_json(F.variant_get("v", "$.type", "variant")), F.lit("null")).alias("type_json"),
            F.try_variant_get("v", "$.format", "string").alias("format"),
            F.coalesce(F.to_json(F.variant_get("v", "$.enum", "variant")), F.lit("null")).alias("enum_json"),
            F.variant_get("v", "$.oneOf", "variant").isNotNull().alias("has_oneof"),
            F.try_variant_get("v", "$.properties", "map<string,variant>").alias("_props"),
            F.try_variant_get("v", "$.required", "array<string>").alias("required"),
            F.variant_get("v", "$.items", "variant").alias("_items"),
        ))
        out.append(lv.select(key, "steps", "path", "parent_path", "prop_key", "via_items", "type_json", "format", "enum_json",
                             "has_oneof", F.col("_props").isNotNull().alias("has_properties"),
                             F.coalesce(F.map_keys("_props"), F.array().cast("array<string>")).alias("prop_keys"),
                             F.transform_values("_props", lambda k, x: F.to_json(x)).alias("prop_schemas"),
                             F.coalesce("required", F.array().cast("array<string>")).alias("required"),
                             F.col("_items").isNotNull().alias("has_items")))
        props = lv.select(key, "steps", F.col("path").alias("parent_path"), "via_items",
                          F.explode("_props").alias("prop_key", "v")).select(
            key, F.concat("steps", F.array(F.concat(F.lit("."), "prop_key"))).alias("steps"), F.concat("parent_path", F.lit("."), "prop_key").alias("path"), "v", "parent_path", "prop_key",
            "via_items")
        items = lv.where(F.col("_items").isNotNull()).select(
            key, F.concat("steps", F.array(F.lit("[]"))).alias("steps"), F.concat("path", F.lit("[items]")).alias("path"), F.col("_items").alias("v"),
            F.col("path").alias("parent_path"), F.lit(None).cast("string").alias("prop_key"),
            F.lit(True).alias("via_items"))
        nxt = props.unionByName(items)
        if nxt.isEmpty():
            break
        level = nxt
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def contract_confidence(contracts: DataFrame, key: str = "function_name", gate: int = 10) -> DataFrame:
    """C12 + O10: confidence 0-100, band (high >= 80, medium >= 50, low), coverage gate sample_count < gate."""
    nodes = schema_nodes(contracts, key)
    agg = nodes.groupBy(key).agg(
        F.count_if("has_oneof").alias("oneof_count"),
        F.coalesce(F.bool_or(F.col("format").isNotNull() & ~F.col("via_items")), F.lit(False)).alias("has_format"),
    )
    c = contracts.select(key, "sample_count").join(agg, key, "left")
    sample = F.least(F.col("sample_count") / 50.0, F.lit(1.0)) * 50
    typ = F.greatest(F.lit(0.0), 30 - F.coalesce("oneof_count", F.lit(0)) * 5.0)
    fmt = F.when(F.coalesce("has_format", F.lit(False)), F.lit(20.0)).otherwise(F.lit(0.0))
    score = js_round(F.least(F.lit(100.0), sample + typ + fmt)).cast("int")
    return c.select(
        key, "sample_count", F.coalesce("oneof_count", F.lit(0)).alias("oneof_count"),
        F.coalesce("has_format", F.lit(False)).alias("has_format"), score.alias("confidence"),
    ).withColumn(
        "band", F.when(F.col("confidence") >= 80, "high").when(F.col("confidence") >= 50, "medium").otherwise("low")
    ).withColumn("below_gate", F.col("sample_count") < gate)


BREAKING_KINDS = ["type_changed", "required_added", "field_removed", "enum_changed"]


def contract_drift(saved: DataFrame, current: DataFrame, key: str = "function_name") -> DataFrame:
    """Schema changes per function between a saved and a current contract (functions in both).

    Rows: key, path, kind, before, after (JSON text; of an added or removed field, its schema). A missing argument counts as ``{}``.
    """
    pair = saved.select(key, F.col("args").alias("_sa"), F.col("returns").alias("_sr")).join(
        current.select(key, F.col("args").alias("_ca"), F.col("returns").alias("_cr")), key)
    idx = pair.select(key, "_sa", "_ca", "_sr", "_cr",
                      F.explode(F.sequence(F.lit(0), F.greatest(F.size("_sa"), F.size("_ca")))).alias("_i"))
    arg_roots = idx.where(F.col("_i") < F.greatest(F.size("_sa"), F.size("_ca"))).select(
        key, F.concat(F.lit("args["), F.col("_i").cast("string"), F.lit("]")).alias("path"),
        F.coalesce(F.get("_sa", F.col("_i")), F.lit("{}")).alias("_s"),
        F.coalesce(F.get("_ca", F.col("_i")), F.lit("{}")).alias("_c"))
    ret_roots = pair.select(key, F.lit("returns").alias("path"), F.col("_sr").alias("_s"), F.col("_cr").alias("_c"))
    roots = arg_roots.unionByName(ret_roots)
    sn = schema_nodes(None, key, roots.select(key, "path", "_s"))
    cn = schema_nodes(None, key, roots.select(key, "path", F.col("_c").alias("_s")))
    cols = ["type_json", "format", "enum_json", "has_properties", "prop_keys", "prop_schemas", "required", "has_items"]
    b = sn.select(key, "steps", "path", *[F.col(c).alias("b_" + c) for c in cols])
    a = cn.select(key, "steps", *[F.col(c).alias("a_" + c) for c in cols])
    both = cut_lineage(b.join(a, [key, "steps"]))
    nul = F.lit(None).cast("string")
    type_ch = both.where(F.col("b_type_json") != F.col("a_type_json")).select(
        key, "path", F.lit("type_changed").alias("kind"), F.col("b_type_json").alias("before"),
        F.col("a_type_json").alias("after"))
    fmt_ch = both.where(~F.col("b_format").eqNullSafe(F.col("a_format"))).select(
        key, F.concat("path", F.lit(".format")).alias("path"), F.lit("format_changed").alias("kind"),
        F.col("b_format").alias("before"), F.col("a_format").alias("after"))
    enum_ch = both.where(F.col("b_enum_json") != F.col("a_enum_json")).select(
        key, "path", F.lit("enum_changed").alias("kind"), F.col("b_enum_json").alias("before"),
        F.col("a_enum_json").alias("after"))
    keys = both.where(F.col("b_has_properties") | F.col("a_has_properties")).select(
        key, "path", "b_prop_keys", "a_prop_keys", "b_prop_schemas", "a_prop_schemas", "b_required", "a_required",
        F.explode(F.array_union("b_prop_keys", "a_prop_keys")).alias("_k"))
    child = F.concat("path", F.lit("."), "_k")
    in_b = F.array_contains("b_prop_keys", F.col("_k"))
    in_a = F.array_contains("a_prop_keys", F.col("_k"))
    added = keys.where(~in_b).select(key, child.alias("path"), F.lit("field_added").alias("kind"),
                                     nul.alias("before"), F.element_at("a_prop_schemas", F.col("_k")).alias("after"))
    removed = keys.where(in_b & ~in_a).select(key, child.alias("path"), F.lit("field_removed").alias("kind"),
                                              F.element_at("b_prop_schemas", F.col("_k")).alias("before"), nul.alias("after"))
    rb = F.array_contains("b_required", F.col("_k"))
    ra = F.array_contains("a_required", F.col("_k"))
    req_rm = keys.where(rb & ~ra).select(key, child.alias("path"), F.lit("required_removed").alias("kind"),
                                         F.lit("true").alias("before"), F.lit("false").alias("after"))
    req_add = keys.where(~rb & ra).select(key, child.alias("path"), F.lit("required_added").alias("kind"),
                                          F.lit("false").alias("before"), F.lit("true").alias("after"))
    return type_ch.unionByName(fmt_ch).unionByName(enum_ch).unionByName(added).unionByName(removed) \
        .unionByName(req_rm).unionByName(req_add)


def drift_breaking(changes: DataFrame, key: str = "function_name") -> DataFrame:
    """C11: per function, breaking = any type_changed, required_added, field_removed or enum_changed."""
    return changes.groupBy(key).agg(
        F.count(F.lit(1)).alias("change_count"),
        F.bool_or(F.col("kind").isin(*BREAKING_KINDS)).alias("is_breaking"),
    )


# ---------------------------------------------------------------- C9: validation

VIOLATION = T.ArrayType(T.StructType([
    T.StructField("path", T.StringType()), T.StructField("expected", T.StringType()),
    T.StructField("received", T.StringType()), T.StructField("rule", T.StringType()),
]))


class _Sql:
    """Writes the check of a value against a list of schema nodes as one Spark SQL expression (lambdas over arrays; every name once).

    ``nodes`` is the contract's node list, a pair ``p`` is a value with its place: (v, at, node, place).
    """

    FAULT = "struct<place: array<int>, path: string, expected: string, received: string, rule: string>"
    PAIR = "struct<v: variant, at: string, node: int, place: array<int>>"
    NO_FAULTS, NO_PAIRS = f"cast(array() as array<{FAULT}>)", f"cast(array() as array<{PAIR}>)"

    def __init__(self) -> None:
        self._names = 0

    def name(self) -> str:
        self._names += 1
        return f"x{self._names}"

    def let(self, value: str, body) -> str:
        """``body(name)`` with ``value`` computed once."""
        x = self.name()
        return f"transform(array({value}), {x} -> {body(x)})[0]"

    def kind(self, v: str) -> str:
        return self.let(f"schema_of_variant({v})", lambda t: (
            f"case when {t} is null then 'undefined' when startswith({t}, 'OBJECT') then 'object' when startswith({t}, 'ARRAY') then 'array' "
            f"when {t} = 'STRING' then 'string' when {t} = 'BOOLEAN' then 'boolean' when {t} = 'VOID' then 'null' else 'number' end"))

    def text(self, v: str, kind: str) -> str:
        """JSON text as JavaScript prints it: numbers without a fraction as integers."""
        number = self.let(f"try_variant_get({v}, '$', 'double')", lambda d: (
            f"case when {d} = floor({d}) and abs({d}) < 1e15 then cast(cast({d} as bigint) as string) else to_json({v}) end"))
        return f"case when {kind} = 'number' then {number} else to_json({v}) end"

    def identity(self, v: str, kind: str) -> str:
        """Equal for two values exactly if their JSON texts are."""
        return f"concat({kind}, ' ', coalesce({self.text(v, kind)}, ''))"

    @staticmethod
    def fault(p: str, place: str, path: str, expected: str, received: str, rule: str) -> str:
        return (f"named_struct('place', concat({p}.place, array({place})), 'path', {path}, 'expected', {expected}, 'received', {received}, 'rule', '{rule}')")

    def own_faults(self, p: str, n: str, kind: str) -> str:
        """Faults of a value against a node's own rules; of a choice, none."""
        at, text = f"{p}.at", f"try_variant_get({p}.v, '$', 'string')"
        known = " ".join(f"when '{name}' then not rlike({text}, r'{pattern}')" for name, pattern in FORMAT_PATTERNS.items())
        lacking = self.let(f"try_variant_get({p}.v, '$', 'map<string,variant>')", lambda m: (
            f"transform(filter({n}.required, key -> not map_contains_key({m}, key)), (key, nth) -> "
            + self.fault(p, "0, nth", f"concat({at}, '.', key)", "'present'", "'missing'", "required") + ")"))
        wrong_format = self.fault(p, "0, 0", at, f"concat('string(format: ', {n}.format, ')')", text, "format")
        wrong_pattern = self.fault(p, "0, 1", at, f"concat('string matching /', {n}.pattern, '/')", text, "pattern")
        return f"""case
            when {n}.enum is not null then case when coalesce(array_contains({n}.enum, {self.identity(p + '.v', kind)}), false) then {self.NO_FAULTS}
                else array({self.fault(p, '0, 0', at, f"concat('one of ', {n}.enum_text)", f"case when {kind} != 'undefined' then {self.text(p + '.v', kind)} end", 'enum')}) end
            when {n}.choices >= 0 or {n}.types is null then {self.NO_FAULTS}
            when not array_contains({n}.types, {kind}) then array({self.fault(p, '0, 0', at, f"array_join({n}.types, ' | ')", kind, 'type')})
            when {kind} = 'string' then concat(
                case when {n}.format is not null and case {n}.format {known} else false end then array({wrong_format}) else {self.NO_FAULTS} end,
                case when {n}.pattern is not null and not rlike({text}, {n}.pattern) then array({wrong_pattern}) else {self.NO_FAULTS} end)
            when {kind} = 'object' and size({n}.required) > 0 then {lacking}
            else {self.NO_FAULTS} end"""

    def below(self, p: str, n: str) -> str:
        """The pairs of the values inside ``p`` (or of ``p`` itself, for branches) and the nodes that check them; missing members have none."""
        def pair(v: str, at: str, place: str) -> str:
            return f"named_struct('v', {v}, 'at', {at}, 'node', {n}.first + nth, 'place', concat({p}.place, array(1, {place})))"

        def of(m: str, e: str) -> str:
            return f"""flatten(transform(slice(nodes, {n}.first + 1, {n}.count), (child, nth) -> coalesce(case child.link
                when 'prop' then case when map_contains_key({m}, child.key) then array({pair(f"element_at({m}, child.key)", f"concat({p}.at, '.', child.key)", 'nth')}) end
                when 'items' then transform({e}, (item, place) -> {pair('item', f"concat({p}.at, '[', place, ']')", 'place')})
                else array({pair(f'{p}.v', f'{p}.at', 'nth')}) end, {self.NO_PAIRS})))"""

        return self.let(f"try_variant_get({p}.v, '$', 'map<string,variant>')", lambda m: self.let(f"try_variant_get({p}.v, '$', 'array<variant>')", lambda e: of(m, e)))

    @staticmethod
    def goes_in(n: str, kind: str) -> str:
        """A node of this type is content with the value's kind, so that what the value holds is checked."""
        return f"({n}.enum is null and {n}.choices < 0 and {n}.count > 0 and coalesce(array_contains({n}.types, {kind}), false))"

    def node_and_kind(self, p: str, body) -> str:
        return self.let(f"nodes[{p}.node]", lambda n: self.let(self.kind(f"{p}.v"), lambda kind: body(n, kind)))

    def fails(self, p: str, levels: int) -> str:
        """Whether a value has any fault against a node, ``levels`` levels down: a choice fails if all its branches do."""
        def of(n: str, kind: str) -> str:
            own = f"size({self.own_faults(p, n, kind)}) > 0"
            if levels <= 1:
                return own
            child = self.name()
            inside = f"transform({self.below(p, n)}, {child} -> {self.fails(child, levels - 1)})"
            chooses = f"({n}.enum is null and {n}.choices >= 0)"
            return (f"case when {chooses} or {self.goes_in(n, kind)} then "
                    + self.let(inside, lambda r: f"case when {chooses} then forall({r}, f -> f) else exists({r}, f -> f) end or (not {chooses} and {own})")
                    + f" else {own} end")

        return self.node_and_kind(p, of)

    def checked(self, p: str, deeper: bool, choice_levels: int) -> str:
        """(faults, pairs of the next level) of one pair."""
        def of(n: str, kind: str) -> str:
            faults = self.own_faults(p, n, kind)
            if choice_levels:
                no_branch = self.fault(p, "0, 0", f"{p}.at", f"concat('one of ', {n}.choices, ' schemas')", kind, "type")
                faults = (f"case when {n}.enum is null and {n}.choices >= 0 then case when {self.fails(p, choice_levels)} then array({no_branch}) "
                          f"else {self.NO_FAULTS} end else {faults} end")
            inside = f"case when {self.goes_in(n, kind)} then {self.below(p, n)} else {self.NO_PAIRS} end" if deeper else self.NO_PAIRS
            return f"named_struct('faults', {faults}, 'below', {inside})"

        return self.node_and_kind(p, of)


_NODE_LIST = ("function_name string, names array<string>, nodes array<struct<link: string, key: string, enum: array<string>, choices: int, types: array<string>, "
              "format: string, pattern: string, required: array<string>, first: int, count: int>>, levels int, choice_levels int")


def _node_list(roots: list[str | None]) -> tuple[list[dict], int, int]:
    """The schema nodes of a contract's texts, level by level, so that a node's children lie side by side; the number of levels; and of
    those at and below a choice. Only what a check can reach becomes a node: an enum has no children, nor has a schema without a type."""
    level = [({} if not t else json.loads(t), "root", None) for t in roots]
    out, levels = [], []
    while level:
        below, offset = [], len(out) + len(level)
        for schema, link, key in level:
            kids, types = [], schema.get("type")
            if "enum" not in schema and "oneOf" in schema:
                kids = [(b, "branch", None) for b in schema["oneOf"]]
            elif "enum" not in schema and types is not None:
                kids = [(x, "prop", k) for k, x in (schema.get("properties") or {}).items()]
                kids += [(schema["items"], "items", None)] if "items" in schema else []
            out.append({"link": link, "key": key, "enum": [json.dumps(x) for x in schema["enum"]] if "enum" in schema else None,
                        "choices": len(schema["oneOf"]) if "oneOf" in schema else -1, "types": types if isinstance(types, list) or types is None else [types],
                        "format": schema.get("format"), "pattern": schema.get("pattern"), "required": schema.get("required") or [],
                        "first": offset + len(below), "count": len(kids)})
            below += kids
        levels.append(len(level))
        level = below
    height = [1] * len(out)
    for i in range(len(out) - 1, -1, -1):
        n = out[i]
        height[i] += max((height[j] for j in range(n["first"], n["first"] + n["count"])), default=0)
    return out, len(levels), max((height[i] for i, n in enumerate(out) if n["choices"] >= 0 and n["enum"] is None), default=0)


def compiled_contracts(contracts: DataFrame) -> tuple[DataFrame, int, int]:
    """Per contract its schema nodes as one list and the roots' names; the number of levels of all; the levels of their choices. A table of
    the size of the contracts, written once."""
    def compiled(batches):
        for pdf in batches:
            rows = []
            for f, args, returns in zip(pdf["function_name"], pdf["args"], pdf["returns"]):
                args = list(args) if args is not None else []
                nodes, levels, choices = _node_list([*args, returns])
                rows.append((f, [*(f"args[{i}]" for i in range(len(args))), "return"], nodes, levels, choices))
            yield pd.DataFrame(rows, columns=["function_name", "names", "nodes", "levels", "choice_levels"])

    q = _Sql()
    of = lambda e, what: q.let(f"parse_json({e})", lambda v: q.let(q.kind(v), lambda kind: what(v, kind)))
    table = contracts.select("function_name", "args", "returns").mapInPandas(compiled, _NODE_LIST)
    table = written(table.withColumn("nodes", F.expr(f"""transform(nodes, n -> named_struct('link', n.link, 'key', n.key,
        'enum', transform(n.enum, e -> {of('e', q.identity)}), 'enum_text', concat('[', array_join(transform(n.enum, e -> {of('e', q.text)}), ','), ']'),
        'choices', n.choices, 'types', n.types, 'format', n.format, 'pattern', n.pattern, 'required', n.required, 'first', n.first, 'count', n.count))""")))
    most = table.agg(F.max("levels"), F.max("choice_levels")).first()
    return table, most[0] or 0, most[1] or 0


def validate_calls(spans: DataFrame, contracts: DataFrame, sample_rate: float = 1.0, seed: int = 7) -> DataFrame:
    """One row per violating span with its violation list; only spans of functions with a contract.

    Contracts become node lists, one row a function, which meet the spans in one join (adaptive execution picks it by measured size).
    A span's values go down the nodes level by level inside its row, so nothing is shuffled by value. A payload that is no JSON has no
    values: its arguments count as missing. Violations come in the order of the schema, a value's own rules before what it holds.
    """
    s = conform(spans)
    if sample_rate < 1.0:
        s = s.where(F.rand(seed) <= F.lit(sample_rate))
    nodes, levels, choice_levels = compiled_contracts(contracts)
    q = _Sql()
    x = s.select("function_name", "span_id", "trace_id", F.col("started_at").alias("timestamp"), "has_error",
                 _list(F.try_parse_json("input_json")).alias("_args"), F.try_parse_json("output_json").alias("_out")).join(nodes.drop("levels", "choice_levels"), "function_name")
    x = x.withColumn("_pairs", F.expr("""filter(transform(names, (at, i) -> named_struct('v', case when at = 'return' then _out else get(_args, i) end,
        'at', at, 'node', i, 'place', array(i))), p -> not (has_error and p.at = 'return'))""")).withColumn("_faults", F.expr(q.NO_FAULTS))
    for left in range(levels, 0, -1):
        p = q.name()
        x = x.withColumn("_step", F.expr(f"transform(_pairs, {p} -> {q.checked(p, left > 1, min(left, choice_levels))})"))
        x = x.withColumn("_faults", F.concat("_faults", F.flatten("_step.faults"))).withColumn("_pairs", F.flatten("_step.below"))
    # exploded, so that the filter stays above: pushed below, it would run each level once for every mention of it, twice as often a level
    kept = ["function_name", "span_id", "trace_id", "timestamp"]
    x = x.select(*kept, F.array("_faults").alias("_faults")).select(*kept, F.explode_outer("_faults").alias("_faults")).where(F.size("_faults") > 0)
    found = F.transform(F.array_sort("_faults"), lambda f: F.struct(*(f[c.name].alias(c.name) for c in VIOLATION.elementType.fields)))
    return x.select(*kept, found.alias("violations"))


def check_schema(value, schema: dict, path: str) -> list[dict]:
    """Faults of one value against one schema (a job over one row; ``validate_calls`` is the way for spans)."""
    spark = SparkSession.getActiveSession()
    span = spark.createDataFrame([("f", "s", "t", json.dumps([value]))], "function_name string, span_id string, trace_id string, input_json string")
    span = span.withColumn("started_at", F.lit(0.0)).withColumn("output_json", F.lit(None).cast("string")).withColumn("has_error", F.lit(True))
    contract = spark.createDataFrame([("f", [json.dumps(schema)], "{}")], "function_name string, args array<string>, returns string")
    rows = violation_details(validate_calls(span, contract)).collect()
    return [{"path": path + r.path.removeprefix("args[0]"), "expected": r.expected, "received": r.received, "rule": r.rule} for r in rows]


def violation_details(violations: DataFrame) -> DataFrame:
    """One row per violation detail."""
    return violations.select("function_name", "span_id", F.inline("violations"))


# ---------------------------------------------------------------- C13: contract → Spark DDL


def schema_to_ddl(schema: dict | str) -> str:
    """Spark DDL type for a JSON schema (payload projection with ``from_json``)."""
    s = json.loads(schema or "{}") if isinstance(schema, str) else schema
    if "enum" in s:
        kinds = {"boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "other" for x in s["enum"]}
        return {"number": "double", "boolean": "boolean"}.get(kinds.pop(), "string") if len(kinds) == 1 else "string"
    if "oneOf" in s:
        return "string"
    t = s.get("type")
    if t == "object":
        props = s.get("properties") or {}
        if not props:
            return "map<string,string>"
        return "struct<" + ",".join("`" + k.replace("`", "``") + "`:" + schema_to_ddl(v) for k, v in props.items()) + ">"
    if t == "array":
        return "array<" + (schema_to_ddl(s["items"]) if "items" in s else "string") + ">"
    return {"number": "double", "integer": "bigint", "boolean": "boolean"}.get(t, "string")


@F.pandas_udf(T.StringType())
def _ddl_udf(schemas: pd.Series) -> pd.Series:
    return schemas.map(lambda x: schema_to_ddl(x) if x is not None else None)


def contract_to_ddl(contracts: DataFrame) -> DataFrame:
    """Per function the DDL of every argument and of the return value; a function without arguments has one row, with a
    null argument."""
    return contracts.select(
        "function_name",
        F.transform("args", lambda x: x).alias("args"),
        "returns",
    ).select("function_name", F.posexplode_outer("args").alias("arg_index", "_s"), "returns").select(
        "function_name", "arg_index", _ddl_udf("_s").alias("arg_ddl"), _ddl_udf("returns").alias("returns_ddl"))


def contract_index(contracts: DataFrame, gate: int = 10) -> DataFrame:
    """Contracts sorted by function name with the coverage gate (fewer than ``gate`` samples)."""
    return contracts.select("function_name", "sample_count", (F.col("sample_count") < gate).alias("below_gate")) \
        .orderBy("function_name")
