"""Registered queries on the smallest tables: SQL where it exists, and the pipeline's stages on each other's results."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from spanlens.llm import queries as llm
from spanlens.llm import simhash

SF = "/root/testdata/sf0.001"


def test_entry_registers_all():
    assert sorted(n.split("_")[0] for n in llm.QUERIES) == sorted(f"op{i}" for i in range(1, 14))
    assert {*llm.QUERIES, "pipeline"} <= set(entry.queries()) and set(llm.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = llm.QUERIES[name](spark, SF)
    want = con.execute(f"select {', '.join(df.columns)} from ({llm.ORACLES[name]}) q").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(docs.count())
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        if name != "packing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    assert seen[0] >= seen[1] == seen[2] >= seen[3] > 0
    packed = docs.groupBy("sequence_id").agg({"length": "sum"}).toPandas()
    assert packed["sum(length)"].max() <= 2048


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "empty-stage")
        assert docs.count() == 0


def test_near_dedup_keeps_visits_off_the_driver(spark, monkeypatch):
    plans = []

    def spied(edges, *how):
        edges.count()
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return components(edges, *how)

    components = simhash.components
    monkeypatch.setattr(simhash, "components", spied)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < corpus_pipeline.near_dedup(spark, docs, SF).count() <= docs.count()
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
