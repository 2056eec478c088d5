"""The registered queries of the training-data operators: each reads whole tables and keeps to its operator."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, lines, repair, search
from .hmm import score_texts
from .mixing import mix_documents
from .nndescent import near_duplicates
from .packing import pack_documents
from .pii import pii_report
from .simhash import simhash_report
from .substrings import substring_report
from .topk import top_k
from .toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Python workers on this machine find the package; a cluster has it installed or by --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to 150 % of all words, sources weighing 3, 1, 2 in turn, no document more than twice."""
    return mix_documents(table(spark, sf_dir, "documents"), share=1.5, weights=(3, 1, 2), repeats=2, seed=42)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over 3-word shingles and its group of fingerprints at 2 or fewer differing bits."""
    return simhash_report(table(spark, sf_dir, "documents"), shingle=3, bits=2, seed=42)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learnt from labels outside the held-out fold; 0.3 and more is predicted toxic."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at cosine 0.93 and more inside its label, its component and whether it stays."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93, seed=42)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    hard = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.formatted_digests(table(spark, sf_dir, "conversations").select(more.columns).union(more))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of recurring windows of 35 words."""
    return substring_report(table(spark, sf_dir, "documents"), window=35)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of runs of three or more lines."""
    kept = lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), run=3)
    return kept.select("doc_id", "lines.n_lines", "lines.n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 2048."""
    return pack_documents(table(spark, sf_dir, "documents"), length=2048, end=1)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text, base patterns and what deobfuscation adds."""
    return pii_report(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates, by integer inner product, of every 20th vector."""
    return top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


def op11_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's log10 probability by a hidden Markov model and by add-one counts, learnt outside the held-out fold."""
    return score_texts(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged and repaired by the least-cost edits."""
    return repair.repair_report(table(spark, sf_dir, "conversations"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_embeddings": op4_embeddings,
    "op5_chat": op5_chat,
    "op6_substrings": op6_substrings,
    "op7_lines": op7_lines,
    "op8_packing": op8_packing,
    "op9_pii": op9_pii,
    "op10_topk": op10_topk,
    "op11_lm": op11_lm,
    "op12_repair": op12_repair,
    "op13_search": op13_search,
}

ORACLES: dict[str, str] = {"op5_chat": chat.SQL, "op7_lines": lines.SQL, "op12_repair": repair.SQL, "op13_search": search.SQL}
