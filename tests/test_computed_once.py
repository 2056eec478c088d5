"""Costly column expressions are computed once a row: no filter pushed below them repeats them."""

from __future__ import annotations

import contextlib
import io
import json
import re

from pyspark.sql import functions as F

from spanlens.operators import contracts as C


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def filters(df) -> list[str]:
    return re.findall(r"(?m)^Condition : (.*)$", plan(df))


def test_validation_levels_are_not_repeated_in_a_filter(spark):
    span = spark.createDataFrame([("f", "s", "t", '[{"a":{"b":"x"}}]', "1", 1.0, False)],
                                 "function_name string, span_id string, trace_id string, input_json string, output_json string, started_at double, has_error boolean")
    schema = {"type": "object", "properties": {"a": {"type": "object", "properties": {"b": {"type": "number"}}}}}
    contract = spark.createDataFrame([("f", [json.dumps(schema)], "{}")], "function_name string, args array<string>, returns string")
    v = C.validate_calls(span, contract)
    assert not [c for c in filters(v) if "transform" in c or "parseJson" in c]
    assert [(r.path, r.rule) for r in C.violation_details(v).collect()] == [("args[0].a.b", "type")]


def test_a_message_is_parsed_once_though_only_valid_spans_are_kept(spark):
    from spanlens.operators.ingest import explode_messages, parse_spans

    raw = spark.createDataFrame([('{"schema_version":"1.0","tags":{"a":1}}',), ("[]",), ("[1]",)], "value string")
    msgs = explode_messages(raw)
    assert not [c for c in filters(msgs) if "from_json" in c or "JsonToStructs" in c]
    parsed = parse_spans(msgs, "message", require_uuid=False)
    good = parsed.where(F.size("reasons") == 0).drop("reasons")
    assert not [c for c in filters(good) if "variant_get" in c]
    reasons = {r.reasons[0]: r.reasons for r in parsed.collect()}
    assert "tags" in reasons["trace_id"] and "schema_version" not in reasons["trace_id"]
    assert reasons["not_an_object"][-1] == "tags" and good.count() == 0


def test_tree_rounds_carry_inner_spans_only(spark, tmp_path, monkeypatch):
    from spanlens.operators import tree as TR

    rows = [("t", "r", None), ("t", "a", "r"), ("t", "b", "a"), ("t", "c", "a"), ("t", "x", "y"), ("t", "y", "x"), ("t", "z", "y"), ("t", "o", "gone"),
            ("t", "a", "gone"), ("u", "a", None), (None, "n", "r"), ("t", None, "r")]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string").selectExpr("*", "'f' as function_name", "'g' as agent_id",
                                                                                                               "1.0D as duration_ms", "1.0D as started_at", "1L as received_at")
    counts, real = [], TR.written
    monkeypatch.setattr(TR, "written", lambda df: counts.append(out.count()) or out if (out := real(df)) is not None else None)
    got = sorted((r.trace_id or "", "/".join(p or "?" for p in r.path), r.depth) for r in TR.span_tree(spans).collect())
    # a comes twice in trace t: once below r, once as a root, so that what hangs on it comes twice
    assert got == sorted([("t", "r", 0), ("t", "r/a", 1), ("t", "a", 0), ("t", "r/a/b", 2), ("t", "a/b", 1), ("t", "r/a/c", 2), ("t", "a/c", 1), ("t", "o", 0),
                          ("u", "a", 0), ("", "n", 0), ("t", "r/?", 1)])
    assert counts[0] == len(rows) and max(counts[1:]) == 5  # r, a, a, x, y


def test_message_files_of_one_delivery_go_by_name(spark, tmp_path):
    import os

    from spanlens.plans.stream_queries import _delivered

    folder = str(tmp_path / "in")
    for lo in (0, 50):
        _delivered(spark.range(lo, lo + 50, numPartitions=4).selectExpr("cast(id as string) as value").repartition(4).sort(F.col("value").cast("int")), folder)
    files = sorted((os.stat(f"{folder}/{n}").st_mtime_ns // 1_000_000, n) for n in os.listdir(folder) if n.startswith("part-"))
    assert len({t for t, _ in files}) == 2
    assert [int(x) for _, n in files for x in open(f"{folder}/{n}").read().split()] == list(range(100))
