"""Contracts, redaction, HTTP extraction, sources and sinks, streaming replay."""

from __future__ import annotations

import json
import os
import tempfile

from helpers import make_spans
from pyspark.sql import functions as F

from spanlens.operators import contracts as C
from spanlens.operators import sessions as SS
from spanlens.operators.http import http_calls
from spanlens.operators.redact import redact, redaction_audit
from spanlens.sources import spans_io as IO


def _contract(spark, outputs, inputs=None):
    rows = [{"output": o, **({"input": inputs[i]} if inputs else {})} for i, o in enumerate(outputs)]
    return C.infer_contracts(make_spans(spark, rows), min_samples=1).first()


def test_enum_for_few_values_and_type_for_many(spark):
    c = _contract(spark, [i % 3 for i in range(12)])
    assert json.loads(c.returns) == {"enum": [0, 1, 2]}
    c = _contract(spark, list(range(12)))
    assert json.loads(c.returns) == {"type": "number"}


def test_formats_and_optional_field(spark):
    outs = [{"id": f"0b7a2a4c-1111-4a2b-9c3d-00000000000{i}", "mail": f"u{i}@x.io"} for i in range(10)]
    for i in range(5):
        outs[i]["note"] = f"n{i}"
    r = json.loads(_contract(spark, outs).returns)
    assert r["properties"]["id"] == {"type": "string", "format": "uuid"}
    assert r["properties"]["mail"] == {"type": "string", "format": "email"}
    assert r["required"] == ["id", "mail"]


def test_mixed_types_oneof(spark):
    r = json.loads(_contract(spark, [f"s{i}" for i in range(6)] + list(range(6))).returns)
    assert len(r["oneOf"]) == 2


def test_arrays_items_and_min_samples(spark):
    r = json.loads(_contract(spark, [[1, 2], [], [3]]).returns)
    assert r == {"type": "array", "items": {"enum": [1, 2, 3]}}
    few = make_spans(spark, [{}, {}])
    assert C.infer_contracts(few).count() == 0


def test_validation_rules(spark):
    assert C.check_schema({"a": 1}, {"type": "object", "required": ["b"], "properties": {"a": {"type": "string"}}},
                          "v") == [
        {"path": "v.b", "expected": "present", "received": "missing", "rule": "required"},
        {"path": "v.a", "expected": "string", "received": "number", "rule": "type"},
    ]
    assert C.check_schema([1, "x"], {"type": "array", "items": {"type": "number"}}, "v")[0]["path"] == "v[1]"
    assert C.check_schema(True, {"oneOf": [{"type": "string"}, {"type": "number"}]}, "v")[0]["rule"] == "type"
    assert C.check_schema(2, {"enum": [1.0, 2.0]}, "v") == []


def test_validate_calls_error_skips_return(spark):
    s = make_spans(spark, [{"output": 1}, {"output": "x", "error_type": "E"}, {"output": "y"}])
    contracts = spark.createDataFrame([("createOrder", [], '{"type":"number"}')],
                                      "function_name string, args array<string>, returns string")
    v = C.validate_calls(s, contracts).collect()
    assert len(v) == 1 and v[0].violations[0]["rule"] == "type"
    assert C.validate_calls(s, contracts, sample_rate=0.0).count() == 0


def test_drift_new_required_field(spark):
    saved = spark.createDataFrame([("f", [], '{"type":"object","properties":{"a":{"type":"string"}},"required":["a"]}')],
                                  "function_name string, args array<string>, returns string")
    cur = spark.createDataFrame([("f", ['{"type":"string"}'],
                                  '{"type":"object","properties":{"a":{"type":"number"},"b":{"type":"string"}},'
                                  '"required":["a","b"]}')],
                                "function_name string, args array<string>, returns string")
    kinds = sorted((r.path, r.kind) for r in C.contract_drift(saved, cur).collect())
    assert kinds == [("args[0]", "type_changed"), ("returns.a", "type_changed"), ("returns.b", "field_added"),
                     ("returns.b", "required_added")]
    assert C.drift_breaking(C.contract_drift(saved, cur)).first().is_breaking
    added, = C.contract_drift(saved, cur).where("kind = 'field_added'").collect()
    removed, = C.contract_drift(cur, saved).where("kind = 'field_removed'").collect()
    assert (added.before, added.after, removed.before, removed.after) == (None, '{"type":"string"}', '{"type":"string"}', None)


def test_confidence(spark):
    c = spark.createDataFrame([("f", 25, ['{"type":"string","format":"uuid"}'], '{"oneOf":[{"type":"null"}]}')],
                              "function_name string, sample_count int, args array<string>, returns string")
    r = C.contract_confidence(c).first()
    assert r.confidence == round(25 / 50 * 50 + 25 + 20) and r.band == "medium"


def test_ddl():
    assert C.schema_to_ddl({"type": "object", "properties": {"a": {"type": "number"},
                                                             "b": {"type": "array", "items": {"enum": ["x"]}}}}) \
        == "struct<`a`:double,`b`:array<string>>"


def test_redaction_keys_values_custom(spark):
    payload = [{"user": {"Password": "p", "nested": [{"token": "t"}]}, "jwt": "aa.bb.cc", "ok": "hello"}, "11.22.33"]
    df = spark.createDataFrame([(json.dumps(payload),)], "input_json string")
    r = redact(df, keys="hub").first()
    out = json.loads(r.input_json)
    assert out[0]["user"]["Password"] == "[REDACTED]" and out[0]["user"]["nested"][0]["token"] == "[REDACTED]"
    assert out[0]["jwt"] == "aa.bb.cc"  # hub: keys only
    r = redact(df, keys="agent").first()
    out = json.loads(r.input_json)
    assert out[0]["jwt"] == "[REDACTED]" and out[1] == "11.22.33"  # JS rule: bare strings are kept
    r = redact(df, keys="agent", bare_strings=True).first()
    assert json.loads(r.input_json)[1] == "[REDACTED]"
    r = redact(df, rule=lambda k, v: "[REDACTED]" if k == "ok" else v).first()
    assert json.loads(r.input_json)[0]["ok"] == "[REDACTED]"
    audit = {(x.key, x.rule): x.redactions for x in redaction_audit(redact(df, keys="agent")).collect()}
    assert audit == {("Password", "key"): 1, ("token", "key"): 1, ("jwt", "key"): 1}


def test_http_extraction(spark):
    inp = ["ctx", {"method": "post", "url": None, "path": "/a", "headers": {"n": 1, "s": "x"}, "body": {"k": 1}}]
    s = make_spans(spark, [{"input": inp}, {"input": [{"method": 1, "url": "/x"}]}])
    r = http_calls(s).collect()
    assert len(r) == 1 and r[0].method == "POST" and r[0].url == "/a" and r[0].headers == {"n": "1", "s": "x"}
    assert json.loads(r[0].body) == {"k": 1}


def test_ndjson_and_snapshot_round_trip(spark):
    d = tempfile.mkdtemp(prefix="spanlens-io-")
    rows = [{"span_id": f"0b7a2a4c-1111-4a2b-9c3d-00000000000{i}", "trace_id": "0b7a2a4c-1111-4a2b-9c3d-0000000000aa",
             "output": {"i": i}} for i in range(3)]
    s = make_spans(spark, rows)
    IO.write_spans(s, os.path.join(d, "dump"))
    back = IO.read_spans(spark, os.path.join(d, "dump"))
    assert back.count() == 3 and {r.output_json for r in back.collect()} == {'{"i":0}', '{"i":1}', '{"i":2}'}
    IO.write_snapshot(s, os.path.join(d, "snaps"), "100")
    IO.write_snapshot(s.limit(1), os.path.join(d, "snaps"), "200")
    ids = [r.snapshot_id for r in IO.list_snapshots(spark, os.path.join(d, "snaps")).collect()]
    assert ids == ["200", "100"]
    assert IO.load_snapshot(spark, os.path.join(d, "snaps"), "100").count() == 3


def test_share_code_round_trip(spark):
    doc = json.dumps({"id": "x", "createdAt": 1, "spans": [{"a": "é" * 80}]})
    df = spark.createDataFrame([(doc,), ('{"id":1}',)], "j string")
    out = df.select(IO.decode_snapshot(IO.encode_snapshot(F.col("j"))).alias("d")).collect()
    assert out[0].d == doc and out[1].d is None


def test_contracts_and_sessions_io(spark):
    d = tempfile.mkdtemp(prefix="spanlens-io-")
    c = C.infer_contracts(make_spans(spark, [{} for _ in range(5)]))
    IO.write_contracts(c, os.path.join(d, "c"))
    back = IO.read_contracts(spark, os.path.join(d, "c")).first()
    assert back.function_name == "createOrder" and back.returns == c.first().returns
    with open(os.path.join(d, "s.json"), "w") as fh:
        json.dump({"session": "s1", "calls": [{"function": "f", "args": [1], "return": 2, "durationMs": 3,
                                               "error": None, "sequence": 1}]}, fh)
    calls, meta = IO.read_session_documents(spark, os.path.join(d, "s.json"))
    assert calls.first().function == "f" and meta.first().session == "s1"
    assert IO.load_extra_keys(os.path.join(d, "missing.json")) == []


def test_array_positions_decide_first_seen(spark):
    s = make_spans(spark, [{"function_name": "f", "input": [["b", "a", 1]], "output": None} for _ in range(3)])
    schema = json.loads(C.infer_contracts(s, min_samples=1).first().args[0])
    assert [x.get("enum", x) for x in schema["items"]["oneOf"]] == [["b", "a"], [1]]


def test_drift_tells_dotted_keys_apart(spark):
    one = json.dumps({"type": "object", "properties": {"a.b": {"type": "string"}, "a": {"type": "object", "properties": {"b": {"type": "number"}}}}})
    c = spark.createDataFrame([("f", [one], "{}")], "function_name string, args array<string>, returns string")
    assert C.contract_drift(c, c).count() == 0


def test_ddl_keeps_functions_without_arguments(spark):
    c = spark.createDataFrame([("f0", [], '{"type":"number"}'), ("f1", ['{"type":"object","properties":{"x`y":{"type":"string"}}}'], "{}")],
                              "function_name string, args array<string>, returns string")
    got = {r.function_name: (r.arg_ddl, r.returns_ddl) for r in C.contract_to_ddl(c).collect()}
    assert got == {"f0": (None, "double"), "f1": ("struct<`x``y`:string>", "string")}


def test_formats_end_where_the_text_ends(spark):
    from spanlens.functions import scalar as S

    df = spark.createDataFrame([("2024-01-01",), ("2024-01-01\n",), ("\u0662\u0660\u0662\u0664-01-01",)], "t string")
    assert [r.f for r in df.select(S.first_format("t").alias("f")).collect()] == ["date-time", None, None]
    assert [len(C.check_schema(t, {"type": "string", "format": "date-time"}, "x")) for t in ("2024-01-01", "2024-01-01\n")] == [0, 1]


def test_escaped_secrets_are_redacted(spark):
    rows = ['[{"pass\\u0077ord":"hunter2"}]', '[{"k":"abc.def.ghi\\n"}]', '[{"k":"1234\\t5678\\t1234\\t5678"}]']
    df = spark.createDataFrame([(r,) for r in rows], "input_json string")
    got = [json.loads(r.input_json)[0] for r in redact(df, keys="hub", values=True).collect()]
    assert [list(g.values()) for g in got] == [["[REDACTED]"]] * 3


def test_indented_contract_files_are_read(spark):
    d = tempfile.mkdtemp(prefix="spanlens-io-")
    with open(os.path.join(d, "one.json"), "w") as fh:
        json.dump({"version": "1.0", "functionName": "f", "args": [{"type": "string"}], "returns": {}}, fh, indent=2)
    with open(os.path.join(d, "two.json"), "w") as fh:
        fh.write('{"version":"1.0","functionName":"g","args":[]}\n{"version":"1.0","functionName":"h","args":[]}\n')
    assert sorted(r.function_name for r in IO.read_contracts(spark, d).collect()) == ["f", "g", "h"]


def test_dumps_keep_arrival_order_of_equal_times(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="spanlens-io-"), "dump")
    s = make_spans(spark, [{"span_id": f"s{i}", "received_at": 1_700_000_000_000} for i in range(5)])
    IO.write_spans(s, d)
    back = IO.read_spans(spark, d, require_uuid=False).orderBy("ingest_seq").collect()
    assert [r.span_id for r in back] == [f"s{i}" for i in range(5)]


def test_session_documents_are_read_by_line_in_many_tasks(spark):
    """One document, a call a line, is no single task's work, and no row holds it."""
    d = tempfile.mkdtemp(prefix="spanlens-io-")
    spans = make_spans(spark, [{"function_name": f"f{i % 3}", "input": {"k": i, "t": "x" * 200}, "started_at": i, "error_type": "E" if i % 7 == 0 else None}
                               for i in range(400)]).withColumn("input_json", F.regexp_replace("input_json", ",", ",\n"))
    calls, meta = SS.record_session(spans, "big")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        IO.write_session_documents(calls, meta, d)
        got, back = IO.read_session_documents(spark, d)
        assert got.select(F.spark_partition_id()).distinct().count() > 3
        cols = ["sequence", "function", "span_id", "duration_ms", "error_type"]
        assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(map(tuple, calls.select(*cols).collect()), key=str)
        assert {json.loads(r.args_json)["k"] for r in got.collect()} == set(range(400))
        assert [tuple(r) for r in back.collect()] == [tuple(r) for r in meta.select(*back.columns).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])


def test_session_documents_of_any_layout(spark):
    """A file is read by line only where that gives what the whole document gives."""
    d = tempfile.mkdtemp(prefix="spanlens-io-")
    one, two = '{"sequence":5,"function":"f","args":[1]}', '{"sequence":6,"function":"g"}'
    head = '{"session":"%s","startTime":"a","calls":['
    texts = {
        "lines": (head + f"\n{one}\n,{two}\n]}}\n", [5, 6]),
        "blank": ("\r\n  " + head + f" \r\n\r\n {one}\r\n , {two} \r\n\t]}}\r\n\r\n", [5, 6]),
        "none": (head + "\n]}\n", []),
        "flat": (head + one + "," + two + "]}", [5, 6]),
        "after": (head + f"\n{one},\n{two}\n]}}", [5, 6]),
        "pair": (head + f"\n{one},{two}\n,{two}\n]}}", [5, 6, 6]),
        "pretty": (head + '\n{\n"sequence":\n5}\n,\n{"sequence":6\n}\n]\n}\n', [5, 6]),
        "places": (head + '\n{"function":"f"}\n,3\n,{"sequence":9}\n]}', [1, 2, 9]),
        "more": (head + f"\n{one}\n]\n,\"x\":[\n]}}", [5]),
        "other": (f'{{"session":"%s","calls":[{one}],"x":[\n{two}\n]}}', [5]),
        "behind": (head + f"\n{one}\n]}}\n{two}\n", [5]),
        "no comma": (head + f"\n{one}\n{two}\n]}}", None),
        "two commas": (head + f"\n{one}\n,,{two}\n]}}", None),
        "comma first": (head + f"\n,{one}\n,{two}\n]}}", None),
        "ends twice": (head + f"\n{one}\n]}}\n]}}\n", [5]),
        "heads twice": (head + '\n{"session":"x","calls":[\n' + f"{one}\n]}}", None),
        "cut": (head + f"\n{one}\n,{two}\n", None),
        "bad call": (head + f"\n{one}\n,{{\"sequence\":}}\n]}}", None),
        "extra bracket": (head + f"\n{one}\n,{two}]\n]}}", None),
        "turned": (f"]}}\n{one}\n" + head, None),
        "number": (f'{{"session":7,"n":"%s","calls":[\n{one}\n]}}', None),
        "empty": ("%s"[:0], None),
    }
    for name, (text, _) in texts.items():
        with open(os.path.join(d, f"s{{}} {name}*%.json"), "w", newline="") as fh:
            fh.write(text % name if text else text)
    calls, meta = IO.read_session_documents(spark, d)
    want = {name: found for name, (_, found) in texts.items() if found is not None}
    assert sorted(r.session for r in meta.collect()) == sorted(want)
    got = {name: [] for name in want}
    for r in calls.orderBy("sequence").collect():
        got[r.session].append(r.sequence)
    assert got == want
    assert {r.args_json for r in calls.where("function = 'f' and sequence = 5").collect()} == {"[1]"}
