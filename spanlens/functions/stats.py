"""Exact order statistics that survive hot groups.

``percentile_disc`` keeps every distinct value of a group in one task's hash map; one function holding a third
of all spans would put a third of the distinct durations into one task. ``exact_rank_value`` instead picks the
k-th smallest value per group in two bounded passes:

1. a histogram per group over an order-preserving log-linear bucket of the value (HDR-histogram style: exponent
   plus the top ``SUB_BITS`` mantissa bits). It is built with a partial (map-side) aggregation, so the shuffle
   carries at most one row per (group, bucket, task), and a group has at most ``2^SUB_BITS`` buckets per octave.
   A running count over that small table finds the bucket holding rank k;
2. only the rows of that one bucket, pre-aggregated by distinct value, are ranked exactly.

Both windows run over bounded partitions (buckets of one group, distinct values of one narrow bucket), never
over the raw rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUB_BITS = 10
_EXP_OFFSET = 1100  # keeps bucket ids of positive values > 0 (double exponents are >= -1074)


def order_bucket(x: Column) -> Column:
    """Order-preserving integer bucket of a double: equal values share a bucket, larger values never sort lower."""
    ax = F.abs(x)
    e0 = F.floor(F.log2(ax))
    # log2 may be off by one right at powers of two; correct it with exact power-of-two comparisons
    e = e0 - F.when(ax < F.pow(F.lit(2.0), e0), 1).otherwise(0) + F.when(ax >= F.pow(F.lit(2.0), e0 + 1), 1).otherwise(0)
    sub = F.floor((ax / F.pow(F.lit(2.0), e) - F.lit(1.0)) * F.lit(float(1 << SUB_BITS)))
    pos = (e + F.lit(_EXP_OFFSET)) * F.lit(1 << SUB_BITS) + sub
    return F.when(x > 0, pos).when(x < 0, -pos).otherwise(F.lit(0)).cast("long")


def rank_floor95(n: Column) -> Column:
    """1-based rank of rule A: sorted[min(floor(0.95 n), n - 1)]."""
    return F.least(F.floor(F.lit(0.95) * n), n - 1) + 1


def rank_ceil95(n: Column) -> Column:
    """1-based rank of rule B (= percentile_disc(0.95)): sorted[max(0, ceil(0.95 n) - 1)]."""
    return F.greatest(F.ceil(F.lit(0.95) * n) - 1, F.lit(0)) + 1


def exact_rank_value(df: DataFrame, keys: list[str], value: str, rank_of_n, out: str = "value_at_rank",
                     weight: str | None = None) -> DataFrame:
    """Per group of ``keys``: the value at 1-based rank ``rank_of_n(n)`` in ascending order, with ``n``.

    NULL values are ignored (as in the reference, durations are never null). Groups with no values are absent;
    callers left-join and default to 0. A row counts ``weight`` times if that column is given, else once.
    """
    times = F.lit(1).cast("long") if weight is None else F.col(weight)
    v = df.select(*keys, F.col(value).alias("_v"), times.alias("_w")).where(F.col("_v").isNotNull())
    v = v.withColumn("_b", order_bucket(F.col("_v")))
    hist = v.groupBy(*keys, "_b").agg(F.sum("_w").alias("_c"))
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = (
        hist.withColumn("_cum", F.sum("_c").over(upto))
        .withColumn("_n", F.sum("_c").over(by_key))
        .withColumn("_k", rank_of_n(F.col("_n")))
    )
    target = hist.where((F.col("_cum") - F.col("_c") < F.col("_k")) & (F.col("_k") <= F.col("_cum"))).select(
        *keys, "_b", "_n", "_k", (F.col("_cum") - F.col("_c")).alias("_before")
    )
    # rows of the one target bucket per group, collapsed to distinct values before ranking
    cand = (
        v.join(target, [*keys, "_b"])
        .groupBy(*keys, "_v")
        .agg(F.sum("_w").alias("_vc"), F.first("_before").alias("_before"), F.first("_k").alias("_k"),
             F.first("_n").alias("_n"))
    )
    upto_v = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cand = cand.withColumn("_cum", F.col("_before") + F.sum("_vc").over(upto_v))
    return cand.where((F.col("_cum") - F.col("_vc") < F.col("_k")) & (F.col("_k") <= F.col("_cum"))).select(
        *keys, F.col("_n").alias("n"), F.col("_v").alias(out)
    )


def p95_floor(df: DataFrame, keys: list[str], value: str, out: str = "p95") -> DataFrame:
    """Rule A percentile per group (live graph)."""
    return exact_rank_value(df, keys, value, rank_floor95, out)


def p95_rank(df: DataFrame, keys: list[str], value: str, out: str = "p95") -> DataFrame:
    """Rule B percentile per group (export graph, session diff); equals ``percentile_disc(0.95)``."""
    return exact_rank_value(df, keys, value, rank_ceil95, out)


def sequence_number(df: DataFrame, group_cols: list[str], order_cols: list, out: str = "seq",
                    partitions: int | None = None) -> DataFrame:
    """Consecutive 1-based numbers per group in ``order_cols`` order, without a window over a whole group.

    The rows are range-partitioned on (group, order) and checkpointed (so partition ids are stable under
    recomputation); each partition numbers its own rows; a small (group, partition) count table gives every
    partition its offset. ``order_cols`` must end in a unique tiebreaker for the numbering to be deterministic.
    """
    from spanlens.session import cut_lineage

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rp = cut_lineage(df.repartitionByRange(n, *group_cols, *order_cols).withColumn("_pid", F.spark_partition_id()))
    local = rp.withColumn(
        "_l", F.row_number().over(Window.partitionBy("_pid", *group_cols).orderBy(*order_cols))
    )
    counts = rp.groupBy(*group_cols, "_pid").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return local.join(offs, [*group_cols, "_pid"]).withColumn(out, F.col("_off") + F.col("_l")).drop(
        "_pid", "_l", "_off"
    )


EXACT_SCALE = 9  # durations are summed exactly at 1e-9 ms resolution


def exact_sum(c: Column | str) -> Column:
    """Order-independent sum (decimal) — same result on every recomputation and engine."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col.cast(f"decimal(38,{EXACT_SCALE})"))


def with_rounded_mean(df: DataFrame, sum_col: str, n_col: str, digits: int, out: str) -> DataFrame:
    """``out`` = exact mean sum/n rounded half-up to ``digits`` places, by integer arithmetic only
    (so no floating summation order or division rounding can move a value across a rounding boundary)."""
    k = 10 ** (EXACT_SCALE - digits)
    return (
        df.withColumn("_rm_s", (F.col(sum_col) * F.lit(10 ** EXACT_SCALE)).cast("decimal(38,0)"))
        .withColumn(out, F.expr(f"cast((_rm_s * 2 + `{n_col}` * {k}) div (`{n_col}` * {2 * k}) as double)"
                                f" / cast({10 ** digits} as double)"))
        .drop("_rm_s")
    )


def sql_rounded_mean(expr: str, digits: int) -> str:
    """DuckDB twin of ``with_rounded_mean`` over a column expression (aggregate)."""
    k = 10 ** (EXACT_SCALE - digits)
    s = f"cast(sum(cast({expr} as decimal(38,{EXACT_SCALE}))) * {10 ** EXACT_SCALE} as hugeint)"
    n = f"count({expr})"
    return f"((({s}) * 2 + {n} * {k}) // ({n} * {2 * k})) / {float(10 ** digits)}"
