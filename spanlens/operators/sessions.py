"""Recorded sessions (W3-W5, W7, A14, A15, D1, D2, U1-U5, O9, P13, S8 list).

A session is a named, ordered list of calls. Here sessions are two tables:

* ``calls``: session, sequence, function, span_id, trace_id, args_json, return_json, duration_ms, error_type,
  error_message (one row per call; partition the stored table by ``session``);
* ``sessions``: session, start_time, end_time (ISO text).

Sequence numbers are a total order inside a session, so they are computed with ``sequence_number`` (range
partitioning + per-partition numbering + offsets), never with a window over a whole session. Per-function caps
and examples use ``row_number() <= k``, which Catalyst turns into a map-side ``WindowGroupLimit`` so a hot function
ships at most k rows per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlens.functions.scalar import iso_time, js_round
from spanlens.functions.stats import exact_sum, p95_rank, sequence_number, with_rounded_mean
from spanlens.schema import conform

CALL_COLUMNS = ["session", "sequence", "function", "span_id", "trace_id", "args_json", "return_json",
                "duration_ms", "error_type", "error_message", "started_at"]


def record_session(
    spans: DataFrame,
    name: str,
    functions: list[str] | None = None,
    max_calls: int | None = None,
    predicate: Callable[[DataFrame], Column] | Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Spans → (calls, sessions) for one named recording.

    Order: by started_at (stable: arrival order on ties). Function filter first, then the per-function cap
    (first k by start), then sequence numbers, then the row predicate, so removed calls leave gaps and still use
    up the cap. Start and end cover all given spans, before any filter.
    """
    s = conform(spans)
    meta = s.agg(
        F.min("started_at").alias("_st"), F.max(F.col("started_at") + F.col("duration_ms")).alias("_en")
    ).select(F.lit(name).alias("session"), iso_time("_st").alias("start_time"), iso_time("_en").alias("end_time"))
    c = s
    if functions is not None:
        c = c.where(F.col("function_name").isin(functions))
    order = [F.col("started_at").asc(), F.col("received_at").asc(), F.col("ingest_seq").asc()]
    if max_calls is not None:
        w = Window.partitionBy("function_name").orderBy(*order)
        c = c.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max_calls).drop("_k")
    calls = c.select(
        F.lit(name).alias("session"),
        F.col("function_name").alias("function"),
        "span_id", "trace_id",
        F.col("input_json").alias("args_json"),
        F.col("output_json").alias("return_json"),
        "duration_ms",
        F.when(F.col("has_error"), F.col("error_type")).alias("error_type"),
        F.when(F.col("has_error"), F.col("error_message")).alias("error_message"),
        "started_at", "received_at", "ingest_seq",
    )
    calls = sequence_number(calls, ["session"], order, out="sequence")
    if predicate is not None:
        cond = predicate(calls) if callable(predicate) else predicate
        calls = calls.where(cond)
    return calls.select(*CALL_COLUMNS), meta


def list_sessions(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """S8 list: per session the call count, start and end."""
    counts = calls.groupBy("session").agg(F.count(F.lit(1)).alias("call_count"))
    return sessions.join(counts, "session", "left").select(
        "session", F.coalesce("call_count", F.lit(0)).alias("call_count"), "start_time", "end_time"
    )


def session_summary(calls: DataFrame) -> DataFrame:
    """Per session and function: calls, errors, error rate, rounded mean ms."""
    agg = calls.groupBy("session", "function").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("error_type").isNotNull()).alias("errors"),
        F.avg(F.col("error_type").isNotNull().cast("double")).alias("error_rate"),
        exact_sum("duration_ms").alias("_sum"),
    )
    return with_rounded_mean(agg, "_sum", "calls", 0, "avg_ms").drop("_sum")


def merge_sessions(calls: DataFrame, sessions: DataFrame, names: list[str], new_name: str
                   ) -> tuple[DataFrame, DataFrame]:
    """Concatenate sessions in list order, stable-sort by old sequence, renumber from 1."""
    if len(names) < 2:
        raise ValueError("merge needs at least two sessions")
    pos = F.lit(None).cast("int")
    for i, n in enumerate(names):
        pos = F.when(F.col("session") == n, F.lit(i)).otherwise(pos)
    picked = calls.where(F.col("session").isin(names)).withColumn("_input_pos", pos)
    picked = picked.withColumn("_old_seq", F.col("sequence")).withColumn("session", F.lit(new_name))
    merged = sequence_number(picked.drop("sequence"), ["session"], ["_old_seq", "_input_pos"], out="sequence")
    meta = sessions.where(F.col("session").isin(names)).agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")
    ).select(F.lit(new_name).alias("session"), "start_time", "end_time")
    return merged.select(*[c for c in CALL_COLUMNS if c in merged.columns]), meta


def clone_session(calls: DataFrame, src: str, dst: str) -> DataFrame:
    """The calls table with a copy of ``src`` named ``dst``."""
    return calls.unionByName(calls.where(F.col("session") == src).withColumn("session", F.lit(dst)))


def rename_session(calls: DataFrame, src: str, dst: str) -> DataFrame:
    """Rename a session in the calls table."""
    return calls.withColumn("session", F.when(F.col("session") == src, F.lit(dst)).otherwise(F.col("session")))


def delete_session(calls: DataFrame, name: str) -> DataFrame:
    """Drop one session."""
    return calls.where(F.col("session") != name)


def session_timeline(calls: DataFrame) -> DataFrame:
    """Bar layout per call: left = (seq-1)/calls*100, width = max(dur/max(maxDur,1)*30, 0.5)."""
    per = calls.groupBy("session").agg(F.count(F.lit(1)).alias("_n"), F.max("duration_ms").alias("_mx"))
    j = calls.join(per, "session")
    return j.select(
        "session", "sequence", "function",
        ((F.col("sequence") - 1) / F.col("_n") * 100).alias("left_pct"),
        F.greatest(F.col("duration_ms") / F.greatest(F.col("_mx"), F.lit(1.0)) * 30, F.lit(0.5)).alias("width_pct"),
    )


def session_examples(calls: DataFrame, successes: int = 3, errors: int = 2, args: int = 3) -> DataFrame:
    """Per session and function: first successes' returns, first errors, first args, rounded mean, count."""
    key = ["session", "function"]
    by_seq = lambda: Window.partitionBy(*key, "_ok").orderBy("sequence")
    ok = calls.withColumn("_ok", F.col("error_type").isNull())
    ranked = ok.withColumn("_r", F.row_number().over(by_seq())).where(F.col("_r") <= max(successes, errors))
    firsts = ranked.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("_ok") & (F.col("_r") <= successes),
                                           F.struct("sequence", "return_json")))).alias("_s"),
        F.array_sort(F.collect_list(F.when(~F.col("_ok") & (F.col("_r") <= errors),
                                           F.struct("sequence", "error_type", "error_message")))).alias("_e"),
    )
    arg_rank = calls.withColumn("_a", F.row_number().over(Window.partitionBy(*key).orderBy("sequence")))
    first_args = arg_rank.where(F.col("_a") <= args).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("sequence", "args_json"))).alias("_g")
    )
    stats = calls.groupBy(*key).agg(F.count(F.lit(1)).alias("call_count"), exact_sum("duration_ms").alias("_sum"))
    stats = with_rounded_mean(stats, "_sum", "call_count", 0, "avg_ms").drop("_sum")
    return stats.join(firsts, key, "left").join(first_args, key, "left").select(
        *key, "call_count", "avg_ms",
        F.transform("_s", lambda x: x["return_json"]).alias("success_returns"),
        F.transform("_e", lambda x: x["error_type"]).alias("error_types"),
        F.transform("_g", lambda x: x["args_json"]).alias("first_args"),
    )


def _p95_by_function(calls: DataFrame) -> DataFrame:
    return p95_rank(calls, ["function"], "duration_ms", out="p95").drop("n")


def diff_sessions(before: DataFrame, after: DataFrame, threshold: float = 0.0,
                  shapes: DataFrame | None = None) -> DataFrame:
    """One long table (kind, function, before_value, after_value, change_pct).

    kinds: added, removed, error_rate (|change| > 0.001), latency (p95 rule B over all calls incl. errors,
    change % > threshold, only when before p95 > 0, reported rounded to 1 place), return_shape (when a shape table
    from ``return_shapes`` is passed).
    """
    def stats(c: DataFrame) -> DataFrame:
        agg = c.groupBy("function").agg(F.avg(F.col("error_type").isNotNull().cast("double")).alias("err"))
        return agg.join(_p95_by_function(c), "function", "left")

    b = stats(before).select("function", F.col("err").alias("b_err"), F.col("p95").alias("b_p95"),
                             F.lit(True).alias("_b"))
    a = stats(after).select("function", F.col("err").alias("a_err"), F.col("p95").alias("a_p95"),
                            F.lit(True).alias("_a"))
    j = b.join(a, "function", "full_outer")
    nul = F.lit(None).cast("double")
    added = j.where(F.col("_b").isNull()).select(F.lit("added").alias("kind"), "function", nul.alias("before_value"),
                                                 nul.alias("after_value"), nul.alias("change_pct"))
    removed = j.where(F.col("_a").isNull()).select(F.lit("removed").alias("kind"), "function", nul.alias("before_value"),
                                                   nul.alias("after_value"), nul.alias("change_pct"))
    common = j.where(F.col("_a") & F.col("_b"))
    err = common.where(F.abs(F.col("b_err") - F.col("a_err")) > 0.001).select(
        F.lit("error_rate").alias("kind"), "function", F.col("b_err").alias("before_value"),
        F.col("a_err").alias("after_value"), nul.alias("change_pct"))
    pct = (F.col("a_p95") - F.col("b_p95")) / F.col("b_p95") * 100
    lat = common.where((F.col("b_p95") > 0) & (pct > threshold)).select(
        F.lit("latency").alias("kind"), "function", F.col("b_p95").alias("before_value"),
        F.col("a_p95").alias("after_value"), js_round(pct, 1).alias("change_pct"))
    out = added.unionByName(removed).unionByName(err).unionByName(lat)
    if shapes is not None:
        out = out.unionByName(shapes.select(F.lit("return_shape").alias("kind"), "function", nul.alias("before_value"),
                                            nul.alias("after_value"), nul.alias("change_pct")))
    return out


def is_breaking(diff: DataFrame, pct: float = 20.0) -> DataFrame:
    """One row: any removed function, any shape change, or any latency change >= pct."""
    flag = (
        (F.col("kind") == "removed") | (F.col("kind") == "return_shape")
        | ((F.col("kind") == "latency") & (F.col("change_pct") >= pct))
    )
    return diff.agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("breaking"))


def functions_added(before: DataFrame, after: DataFrame) -> DataFrame:
    """Functions in after but not before."""
    return after.select("function").distinct().join(before.select("function").distinct(), "function", "left_anti")


def functions_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Functions in before but not after."""
    return functions_added(after, before)


def functions_common(before: DataFrame, after: DataFrame) -> DataFrame:
    """Functions in both."""
    return before.select("function").distinct().intersect(after.select("function").distinct())


def return_shapes(calls: DataFrame) -> DataFrame:
    """D1 helper: per (session, function) the JSON schema inferred from the non-error return values; only
    functions with at least one successful call appear."""
    from spanlens.operators.contracts import assemble_schemas, value_profile

    like = calls.select(
        "session", F.col("function").alias("function_name"), F.lit("[]").alias("input_json"),
        F.col("return_json").alias("output_json"), F.col("error_type").isNotNull().alias("has_error"),
        F.col("sequence").cast("long").alias("received_at"), F.lit(0).cast("long").alias("ingest_seq"),
    )
    g = ["session", "function_name"]
    roots = assemble_schemas(value_profile(like, g), g)
    return roots.where(F.col("slot") == "return").select("session", F.col("function_name").alias("function"),
                                                        F.col("schema").alias("shape"))


def shape_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Functions whose inferred return shape differs (both sessions need successful calls); pass the result
    as ``shapes`` to ``diff_sessions``."""
    b = return_shapes(before).select("function", F.col("shape").alias("before_shape"))
    a = return_shapes(after).select("function", F.col("shape").alias("after_shape"))
    return b.join(a, "function").where(F.col("before_shape") != F.col("after_shape"))
