"""Ingest flags and validation, trees, sessions, reports."""

from __future__ import annotations

import json

from helpers import ABSENT, make_spans
from pyspark.sql import functions as F

from spanlens.functions import scalar as S
from spanlens.operators import sessions as SS
from spanlens.operators import tree as TR
from spanlens.operators.ingest import (
    check_spans,
    explode_messages,
    flag_anomalies,
    flag_distributed,
    parse_spans,
    split_valid,
)
from spanlens.streaming.live import rate_cap


def test_anomaly_types_string_number_string(spark):
    rows = [{"output": "a"}, {"output": 1}, {"output": "b"}]
    got = [r.anomaly for r in flag_anomalies(make_spans(spark, rows)).orderBy("ingest_seq").collect()]
    assert got == [False, True, False]


def test_anomaly_independent_per_node_and_missing_vs_null(spark):
    rows = [{"output": ABSENT}, {"output": None}, {"function_name": "other", "output": None},
            {"output": ABSENT}]
    got = [r.anomaly for r in flag_anomalies(make_spans(spark, rows)).orderBy("ingest_seq").collect()]
    assert got == [False, True, False, False]


def test_distributed_second_agent_flagged(spark):
    rows = [{"trace_id": "t", "agent_id": "a"}, {"trace_id": "t", "agent_id": "b"}, {"trace_id": "t", "agent_id": "a"}]
    s = make_spans(spark, rows).withColumn("trace_id", F.lit("t"))
    got = [r.distributed for r in flag_distributed(s).orderBy("ingest_seq").collect()]
    assert got == [False, True, True]


def _event(**over):
    e = {
        "schema_version": "1.0", "trace_id": "0b7a2a4c-1111-4a2b-9c3d-000000000001",
        "span_id": "0b7a2a4c-1111-4a2b-9c3d-000000000002", "parent_span_id": None,
        "source": {"agent_id": "a", "language": "js", "file": "x.ts", "line": 1, "function_name": "f"},
        "timing": {"started_at": 1.0, "duration_ms": 2.0}, "input": [], "output": "ok", "error": None, "tags": {},
    }
    for k, v in over.items():
        if "." in k:
            a, b = k.split(".")
            e[a] = dict(e[a], **{b: v})
        else:
            e[k] = v
    return json.dumps(e)


def test_validation_rejects_bad_spans(spark):
    msgs = [_event(), _event(**{"timing.started_at": 0}), _event(**{"timing.duration_ms": -1}),
            _event(**{"source.language": "cobol"}), "not json", json.dumps([json.loads(_event())] * 2)]
    df = spark.createDataFrame([(m,) for m in msgs], "value string")
    parsed = parse_spans(explode_messages(df, "value"), "message")
    good, bad = split_valid(parsed)
    assert good.count() == 3  # the first event and the two inside the batch
    reasons = sorted(r for row in bad.collect() for r in row.reasons)
    assert reasons == ["source.language", "timing.duration_ms", "timing.started_at"]


def test_parent_key_must_exist_and_error_shape(spark):
    e = json.loads(_event())
    del e["parent_span_id"]
    e2 = json.loads(_event(error={"type": "E", "message": "m"}))  # no stack
    df = spark.createDataFrame([(json.dumps(e),), (json.dumps(e2),)], "message string")
    bad = [r.reasons for r in parse_spans(df).collect()]
    assert bad == [["parent_span_id"], ["error"]]


def test_check_spans_typed(spark):
    s = make_spans(spark, [{"duration_ms": -1.0}, {}])
    assert [len(r.reasons) for r in check_spans(s).orderBy("ingest_seq").collect()] == [1, 0]


def test_tree_depth_roots_and_cycle(spark):
    rows = [
        {"span_id": "r", "trace_id": "t"}, {"span_id": "a", "parent_span_id": "r"},
        {"span_id": "b", "parent_span_id": "a"}, {"span_id": "o", "parent_span_id": "nowhere"},
        {"span_id": "x", "parent_span_id": "y"}, {"span_id": "y", "parent_span_id": "x"},
    ]
    s = make_spans(spark, rows).withColumn("trace_id", F.lit("t"))
    t = {r.span_id: (r.root_id, r.depth) for r in TR.span_tree(s).collect()}
    assert t == {"r": ("r", 0), "a": ("r", 1), "b": ("r", 2), "o": ("o", 0)}  # cycle x<->y is unreachable
    d = {r.root_id: r.chain_depth for r in TR.tree_depths(TR.span_tree(s)).collect()}
    assert d["r"] == 3 and d["o"] == 1


def test_flame_layout(spark):
    rows = [{"span_id": "r", "started_at": 100.0, "duration_ms": 10.0},
            {"span_id": "c", "parent_span_id": "r", "started_at": 105.0, "duration_ms": 5.0}]
    s = make_spans(spark, rows).withColumn("trace_id", F.lit("t"))
    f = {r.span_id: r for r in TR.flame(s).collect()}
    assert f["c"].depth == 1 and f["c"].x_frac == 0.5 and f["c"].width_frac == 0.5 and f["r"].max_depth == 1


def test_nested_tree_json(spark):
    rows = [{"span_id": "r", "function_name": "root"}, {"span_id": "c", "parent_span_id": "r", "function_name": "kid"}]
    s = make_spans(spark, rows).withColumn("trace_id", F.lit("t"))
    doc = json.loads(TR.span_tree_json(s).first().tree_json)
    kid = doc["children"][0]
    assert doc["source"]["function_name"] == "root" and kid["source"]["function_name"] == "kid" and kid["timing"]["duration_ms"] == 50.0


def _calls(spark, fn, durations, errors=None):
    errors = errors or [None] * len(durations)
    rows = [{"function_name": fn, "duration_ms": d, "started_at": float(i), "error_type": e}
            for i, (d, e) in enumerate(zip(durations, errors))]
    return make_spans(spark, rows)


def test_session_diff_error_rate_and_latency(spark):
    b, _ = SS.record_session(_calls(spark, "f", [50.0, 60.0]), "before")
    a, _ = SS.record_session(_calls(spark, "f", [200.0, 210.0], ["E", "E"]), "after")
    d = {r.kind: r for r in SS.diff_sessions(b, a).collect()}
    assert d["error_rate"].before_value == 0.0 and d["error_rate"].after_value == 1.0
    assert d["latency"].change_pct == 250.0  # p95 60 -> 210
    assert SS.is_breaking(SS.diff_sessions(b, a)).first().breaking


def test_faster_is_not_regression(spark):
    b, _ = SS.record_session(_calls(spark, "f", [200.0, 210.0]), "b")
    a, _ = SS.record_session(_calls(spark, "f", [50.0, 60.0]), "a")
    assert SS.diff_sessions(b, a).where("kind = 'latency'").count() == 0


def test_record_cap_and_predicate_leave_gaps(spark):
    c, meta = SS.record_session(_calls(spark, "f", [1.0, 20.0, 3.0, 40.0]), "s", max_calls=3,
                                predicate=F.col("duration_ms") > 2)
    assert [(r.sequence, r.duration_ms) for r in c.orderBy("sequence").collect()] == [(2, 20.0), (3, 3.0)]
    assert meta.first().start_time == "1970-01-01T00:00:00.000Z"


def test_merge_sessions_stable_order(spark):
    a, ma = SS.record_session(_calls(spark, "f", [1.0, 2.0]), "a")
    b, mb = SS.record_session(_calls(spark, "g", [3.0]), "b")
    m, _ = SS.merge_sessions(a.unionByName(b), ma.unionByName(mb), ["b", "a"], "m")
    got = [(r.sequence, r.function) for r in m.orderBy("sequence").collect()]
    assert got == [(1, "g"), (2, "f"), (3, "f")]


def test_rate_cap_501_in_one_second(spark):
    rows = [("a", 1000 + i // 10, i) for i in range(501)] + [("a", 2100, 501)]
    df = spark.createDataFrame(rows, "agent_id string, received_at long, ingest_seq long")
    acc = [r.accepted for r in rate_cap(df, 500).orderBy("ingest_seq").collect()]
    assert sum(acc[:501]) == 500 and acc[500] is False and acc[501] is True


def test_scalar_functions(spark):
    df = spark.createDataFrame([(0.5, "UserService.getUser", "create_order"), (1500.0, "handleCheckout", "x-y"),
                                (12.34, "fetchUser", "a")], "ms double, fn string, n string")
    r = df.select(S.duration_label("ms").alias("l"), S.service_of("fn").alias("s"), S.base_name("fn").alias("b"),
                  S.camel_case("n").alias("c"), S.snake_case("fn").alias("k"), S.js_round(F.lit(-2.5)).alias("r"),
                  S.iso_time(F.lit(0)).alias("t")).collect()
    assert [x.l for x in r] == ["500µs", "1.50s", "12.3ms"]
    assert [x.s for x in r] == ["UserService", "Handlers", "Other"]
    assert [x.b for x in r] == ["getUser", "handleCheckout", "fetchUser"]
    assert [x.c for x in r] == ["createOrder", "xY", "a"]
    assert r[1].k == "handle_checkout" and r[0].r == -2.0 and r[0].t == "1970-01-01T00:00:00.000Z"


def test_deep_chain_and_cycles(spark):
    """A chain far deeper than any round count, next to a cycle that no root reaches."""
    rows = [{"trace_id": "deep", "span_id": f"d{i}", "parent_span_id": f"d{i - 1}" if i else None} for i in range(1500)]
    rows += [{"trace_id": "deep", "span_id": f"c{i}", "parent_span_id": f"c{(i + 1) % 7}"} for i in range(7)]
    rows += [{"trace_id": "deep", "span_id": "x", "parent_span_id": "c0"}]
    t = {r.span_id: (r.root_id, r.depth, len(r.path)) for r in TR.span_tree(make_spans(spark, rows)).collect()}
    assert t == {f"d{i}": ("d0", i, i + 1) for i in range(1500)}


def test_tree_with_hot_parent(spark):
    rows = [{"span_id": "r"}] + [{"span_id": f"c{i}", "parent_span_id": "r"} for i in range(40)] + \
           [{"span_id": f"g{i}", "parent_span_id": f"c{i % 3}"} for i in range(9)]
    t = TR.span_tree(make_spans(spark, rows).withColumn("trace_id", F.lit("t"))).collect()
    assert len(t) == 50 and {r.root_id for r in t} == {"r"} and sorted(r.depth for r in t) == [0] + [1] * 40 + [2] * 9
