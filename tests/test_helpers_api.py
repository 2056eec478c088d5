"""Small public helpers: lookups, set operations on sessions, violation rows, typed redaction, arrival stamps."""

from __future__ import annotations

from helpers import make_spans
from pyspark.sql import functions as F

from spanlens.operators import contracts as C
from spanlens.operators import filters as FL
from spanlens.operators import reports as RP
from spanlens.operators import sessions as SS
from spanlens.operators.ingest import stamp_arrival
from spanlens.operators.redact import redact_strings


def test_get_span_last_arrival_wins(spark):
    s = make_spans(spark, [{"span_id": "x", "function_name": "old"}, {"span_id": "x", "function_name": "new"}])
    assert FL.get_span(s, "x").first().function_name == "new"


def test_session_function_sets(spark):
    b, _ = SS.record_session(make_spans(spark, [{"function_name": "f"}, {"function_name": "g"}]), "b")
    a, _ = SS.record_session(make_spans(spark, [{"function_name": "g"}, {"function_name": "h"}]), "a")
    assert [r.function for r in SS.functions_added(b, a).collect()] == ["h"]
    assert [r.function for r in SS.functions_removed(b, a).collect()] == ["f"]
    assert [r.function for r in SS.functions_common(b, a).collect()] == ["g"]


def test_violation_detail_rows(spark):
    s = make_spans(spark, [{"output": "x"}])
    c = spark.createDataFrame([("createOrder", [], '{"type":"number"}')],
                              "function_name string, args array<string>, returns string")
    d = C.violation_details(C.validate_calls(s, c)).collect()
    assert [(r.path, r.rule, r.received) for r in d] == [("return", "type", "string")]


def test_error_examples_join(spark):
    s = make_spans(spark, [{"error_type": "E1", "error_stack": "a\nb"}, {"error_type": "E2"}])
    nodes = spark.createDataFrame([("test-agent", "createOrder")], "agent_id string, function_name string")
    r = RP.nodes_with_error_examples(nodes, s).first()
    assert r.error_type == "E1" and r.error_stack == "a\nb"


def test_redact_strings_and_stamps(spark):
    df = spark.createDataFrame([(" 4111 1111 1111 1111 ",), ("hello",), ("aa.bb.cc",)], "v string")
    assert [r.v for r in df.select(redact_strings("v").alias("v")).collect()] == ["[REDACTED]", "hello", "[REDACTED]"]
    st = stamp_arrival(df, F.lit(5)).collect()
    assert {r.received_at for r in st} == {5} and len({r.ingest_seq for r in st}) == 3
