"""Span factory with test defaults (shape of the reference's fixtures)."""

from __future__ import annotations

import json

from spanlens.schema import SPAN_SCHEMA

DEFAULT = {
    "schema_version": "1.0",
    "parent_span_id": None,
    "agent_id": "test-agent",
    "language": "js",
    "file": "src/orders.ts",
    "line": 10,
    "function_name": "createOrder",
    "description": None,
    "started_at": 1_700_000_000_000.0,
    "duration_ms": 50.0,
    "input_json": json.dumps([{"userId": "u_1", "amount": 99.99}]),
    "output_json": json.dumps({"orderId": "ord_1", "status": "pending"}),
    "has_error": False,
    "error_type": None,
    "error_message": None,
    "error_stack": None,
    "tags": {},
    "anomaly": False,
    "distributed": False,
}


def make_spans(spark, rows: list[dict]):
    out = []
    for i, r in enumerate(rows):
        d = dict(DEFAULT)
        d.update({"trace_id": f"t{i}", "span_id": f"s{i}", "received_at": 1_700_000_000_000 + i, "ingest_seq": i})
        if "output" in r:
            r = dict(r)
            o = r.pop("output")
            d["output_json"] = None if o is _ABSENT else json.dumps(o)
        if "input" in r:
            r = dict(r)
            d["input_json"] = json.dumps(r.pop("input"))
        d.update(r)
        for f in ("duration_ms", "started_at"):
            d[f] = float(d[f])
        if d.get("error_type") is not None:
            d["has_error"] = True
        out.append(tuple(d[f.name] for f in SPAN_SCHEMA.fields))
    return spark.createDataFrame(out, SPAN_SCHEMA)


class _Absent:
    pass


_ABSENT = _Absent()
ABSENT = _ABSENT
