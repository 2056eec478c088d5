"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes each stage's result as
Parquet in the shared folder and reads it again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm.common import written
from spanlens.llm.lines import drop_repeated_lines
from spanlens.llm.mixing import take_copies
from spanlens.llm.packing import pack_documents
from spanlens.llm.queries import table
from spanlens.llm.simhash import keep_one_of_group
from spanlens.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from labels outside the held-out fold, scores below 0.3."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines of later copies of runs of three or more or of over 50 words; n_chars follows the text."""
    kept = drop_repeated_lines(docs, run=3, words=50).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash fingerprints over 3-word shingles at 2 or fewer differing bits."""
    return keep_one_of_group(docs, shingle=3, bits=2, seed=42)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a document taken twice is there twice."""
    return take_copies(docs, share=1.5, weights=(3, 1, 2), repeats=2, seed=42)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, length=2048, end=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: SQL has no training, seeded hash or tokenizer of these stages: they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return docs
