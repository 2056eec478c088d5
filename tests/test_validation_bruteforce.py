"""Contract validation against a plain recursive check, and payloads that are hard to read."""

from __future__ import annotations

import json
import random
import re

from spanlens.functions.scalar import FORMAT_PATTERNS
from spanlens.operators import contracts as C

from helpers import make_spans


def kind(v):
    if v is None:
        return "null"
    return {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object", type(Ellipsis): "undefined"}[type(v)]


def text(v):
    if isinstance(v, float) and v.is_integer():
        v = int(v)
    if isinstance(v, list):
        return "[" + ",".join(map(text, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + text(v[k]) for k in sorted(v)) + "}"
    return None if v is ... else json.dumps(v, ensure_ascii=False)


def check(v, s, at):
    if "enum" in s:
        return [] if v is not ... and text(v) in map(text, s["enum"]) else [(at, "one of " + text(s["enum"]), text(v), "enum")]
    if "oneOf" in s:
        return [] if any(not check(v, b, at) for b in s["oneOf"]) else [(at, f"one of {len(s['oneOf'])} schemas", kind(v), "type")]
    if "type" not in s:
        return []
    types = s["type"] if isinstance(s["type"], list) else [s["type"]]
    if kind(v) not in types:
        return [(at, " | ".join(types), kind(v), "type")]
    out = []
    if isinstance(v, str):
        if s.get("format") in FORMAT_PATTERNS and not re.search(FORMAT_PATTERNS[s["format"]].replace("\\z", "\\Z"), v):
            out.append((at, f"string(format: {s['format']})", v, "format"))
        if "pattern" in s and not re.search(s["pattern"], v):
            out.append((at, f"string matching /{s['pattern']}/", v, "pattern"))
    if isinstance(v, dict):
        out += [(f"{at}.{k}", "present", "missing", "required") for k in s.get("required", []) if k not in v]
        for k in s.get("properties", {}):
            if k in v:
                out += check(v[k], s["properties"][k], f"{at}.{k}")
    if isinstance(v, list) and "items" in s:
        for i, x in enumerate(v):
            out += check(x, s["items"], f"{at}[{i}]")
    return out


def schema(draw, depth=0):
    k = draw.random()
    if k < 0.12:
        return {"enum": draw.sample([1, 2.0, "a", "é", True, None, 1.5], draw.randint(1, 4))}
    if k < 0.27 and depth < 4:
        return {"oneOf": [schema(draw, depth + 1) for _ in range(draw.randint(1, 3))]}
    if k < 0.55 and depth < 4:
        keys = draw.sample(["a", "b", "c.d", "e[]"], draw.randint(0, 3))
        out = {"type": draw.choice(["object", ["object", "null"]]), "properties": {x: schema(draw, depth + 1) for x in keys}}
        return out | ({"required": draw.sample(["a", "b", "z"], draw.randint(0, 2))} if draw.random() < 0.6 else {})
    if k < 0.72 and depth < 4:
        return {"type": "array"} | ({"items": schema(draw, depth + 1)} if draw.random() < 0.8 else {})
    return draw.choice([{"type": "string"}, {"type": "number"}, {"type": ["string", "number"]}, {}, {"type": "string", "format": "email"}, {"type": "boolean"},
                        {"type": "string", "format": "date-time", "pattern": "^20"}, {"type": "string", "pattern": "[0-9]+x"}, {"type": "null"}])


def fit(draw, s, depth=0):
    """A value that mostly keeps to the schema."""
    if draw.random() < 0.12:
        return draw.choice([None, 1, 2, 1.5, "a", "é", "u@x.io", "2024-01-01", "9x", True, [], {}, [1], {"a": 1}])
    if "enum" in s:
        return draw.choice(s["enum"])
    if "oneOf" in s:
        return fit(draw, draw.choice(s["oneOf"]), depth + 1)
    t = s.get("type", "string")
    t = t[0] if isinstance(t, list) else t
    if t == "object":
        return {k: fit(draw, x, depth + 1) for k, x in s.get("properties", {}).items() if draw.random() < 0.85} | ({"z": 1} if draw.random() < 0.3 else {})
    if t == "array":
        return [fit(draw, s.get("items", {}), depth + 1) for _ in range(draw.randint(0, 3))]
    return {"number": 7, "boolean": False, "null": None}.get(t, draw.choice(["u@x.io", "2024-01-01", "9x", "text"]))


def test_equals_recursive_check(spark):
    draw = random.Random(8)
    contracts, spans, want = [], [], {}
    for f in range(25):
        args, returns = [schema(draw) for _ in range(draw.randint(0, 2))], schema(draw)
        contracts.append((f"f{f}", [json.dumps(a) for a in args], json.dumps(returns)))
        for i in range(16):
            given, out, error = [fit(draw, a) for a in args][:draw.choice([2, 2, 2, 0])], fit(draw, returns), draw.random() < 0.2
            spans.append({"span_id": f"{f}-{i}", "function_name": f"f{f}", "input": given, "output": out, "error_type": "E" if error else None})
            faults = [x for j, a in enumerate(args) for x in check(given[j] if j < len(given) else ..., a, f"args[{j}]")]
            faults += [] if error else check(out, returns, "return")
            if faults:
                want[f"{f}-{i}"] = faults
    got = C.validate_calls(make_spans(spark, spans), spark.createDataFrame(contracts, "function_name string, args array<string>, returns string")).collect()
    assert {r.span_id: [tuple(v) for v in r.violations] for r in got} == want
    rules = {v[3] for vs in want.values() for v in vs}
    assert rules == {"enum", "type", "format", "pattern", "required"}


def test_unreadable_payloads_are_reported_not_fatal(spark):
    rows = [{"span_id": "text", "input_json": "no json", "output_json": "{"}, {"span_id": "half", "input_json": r'["\ud800"]', "output_json": "1"},
            {"span_id": "deep", "input_json": "[" * 500 + "]" * 500, "output_json": "1"}, {"span_id": "inf", "input_json": "[1e400]", "output_json": "1"},
            {"span_id": "null", "input_json": None, "output_json": None}, {"span_id": "good", "input_json": "[3]", "output_json": "1"}]
    contracts = spark.createDataFrame([("createOrder", ['{"type":"number"}'], '{"type":"number"}')], "function_name string, args array<string>, returns string")
    got = {r.span_id: [(v.path, v.received) for v in r.violations] for r in C.validate_calls(make_spans(spark, rows), contracts).collect()}
    assert got["text"] == got["null"] == [("args[0]", "undefined"), ("return", "undefined")]
    assert got["half"] == [("args[0]", "string")] and got["deep"] == [("args[0]", "array")] and "good" not in got


def test_no_python_worker(spark):
    contracts = spark.createDataFrame([("createOrder", [], '{"oneOf":[{"type":"number"},{"type":"array","items":{"type":"string"}}]}')],
                                      "function_name string, args array<string>, returns string")
    plan = C.validate_calls(make_spans(spark, [{"output": 1}]), contracts)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan
