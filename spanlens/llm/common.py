"""Helpers of the training-data operators: written intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); set here only where it is unset, on a local master."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; intermediate tables need a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spanlens-llm-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: it cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_written_at", None)
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def column_or(df: DataFrame, name: str, kind: str) -> Column:
    """The column as ``kind``, or nulls where the table has none."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added while ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: inside a lambda a column expression would run for every element."""
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the links (a, b), longs: columns ``node``, ``root`` (the smallest node reachable).

    Large-star and small-star steps alternate until the links stay the same; each step is a grouped minimum (combined
    before the shuffle) and a join that adaptive execution can split, so a node with very many links needs no single
    task. Rows with a null end and links of a node to itself carry nothing and are left out; only the nodes that occur
    in a remaining link come back. Each round is written to the shared folder.
    """
    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    now = written(links.filter("_a is not null and _b is not null and u != v").select("u", "v").distinct(), "links")
    seen = state(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        after = written(small, "links")
        was, seen = seen, state(after)
        drop_written(now)
        now = after
        if was == seen:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
