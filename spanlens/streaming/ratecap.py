"""The rate cap per connection, as a batch job and as a stage of live ingest.

A message is accepted when fewer than ``per_second`` messages were accepted in the second before it, both edges included. The rule is
sequential, because a refused message does not count, but only where a connection really is over its limit:

* messages of one millisecond share a window, so the rule works on ticks (connection, millisecond, messages offered), which are counted
  on the map side;
* if a tick and the second before it hold at most ``per_second`` *offered* messages, all of the tick is accepted, whatever came before.
  Such ticks need no scan at all;
* the others, and the known ticks in the second before each, make segments wherever a second passes without one: a segment's first
  window holds known ticks only. So a connection's segments run in parallel, and a segment costs its milliseconds, not the messages of
  a flood.

The sums above are windows over one minute of one connection (with a few seconds of its neighbours), never over a whole connection.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlens.functions.stats import exact_rank_value
from spanlens.session import written
from spanlens.streaming.state import KeyedState, delete

RATE_LIMIT = 500
#: The window of the rule, both edges included.
SECOND = 1_000
#: Milliseconds of one connection that one window task holds, and what it sees of the minutes before and after.
BLOCK, BEFORE, AFTER = 60_000, 2 * SECOND, SECOND


def _with_neighbours(ticks: DataFrame) -> DataFrame:
    """Each tick in its own block (``own``), and again in a neighbour block that looks at it."""
    home = F.floor(F.col("t") / BLOCK)
    late, early = F.col("t") >= (home + 1) * BLOCK - BEFORE, F.col("t") < home * BLOCK + AFTER
    blocks = F.filter(F.array(home, F.when(late, home + 1), F.when(early, home - 1)), lambda b: b.isNotNull())
    return ticks.withColumn("home", home).withColumn("block", F.explode(blocks)).withColumn("own", F.col("home") == F.col("block"))


def _segments(ticks: DataFrame, per_second: int, save: Callable) -> DataFrame:
    """Ticks with ``over`` (their outcome needs the scan), ``lead`` (a tick of known outcome in the second before such a tick) and the
    segment's number: ticks that are over less than a second apart are one segment."""
    # a tick counts from its own millisecond until a second after it: running sums, whatever the number of ticks in a second
    comes_goes = F.explode(F.array(F.struct(F.col("t").alias("at"), F.col("offered").alias("d"), F.lit(True).alias("tick")),
                                   F.struct((F.col("t") + SECOND + 1).alias("at"), (-F.col("offered")).alias("d"), F.lit(False).alias("tick"))))
    part = Window.partitionBy("key", "block")
    upto = lambda w, end: w.rowsBetween(Window.unboundedPreceding, end)
    x = _with_neighbours(ticks).select("*", comes_goes.alias("e")).withColumn(
        "offered_last", F.sum("e.d").over(upto(part.orderBy("e.at", "e.tick", F.desc("known")), 0))).where("e.tick")
    x = x.withColumn("over", ~F.col("known") & (F.col("offered_last") > per_second))
    over_at = F.when(F.col("over"), F.col("t"))
    forth = part.orderBy("t", F.desc("known"))  # a millisecond may hold a known tick and an own one
    x = x.withColumn("last", F.max(over_at).over(upto(forth, -1))).withColumn("next", F.min(over_at).over(upto(part.orderBy(F.desc("t"), "known"), 0)))
    x = x.withColumn("last", F.when(F.col("t") - F.col("last") <= SECOND, F.col("last"))).withColumn(
        "next", F.when(F.col("next") - F.col("t") <= SECOND, F.col("next")))
    x = x.withColumn("lead", ~F.col("over") & F.col("next").isNotNull()).where("own")
    x = x.withColumn("starts", (F.col("over") & F.col("last").isNull()).cast("int"))
    x = save(x.withColumn("nth", F.sum("starts").over(upto(forth, 0))).drop("e", "home", "own", "offered_last"), "marked")
    per_block = x.groupBy("key", "block").agg(F.sum("starts").alias("n"))
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a minute
    per_block = per_block.select("key", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    begins = F.col("lead") & (F.col("last").isNull() | (F.col("next") - F.col("last") > SECOND))  # leads the next segment in
    return x.join(per_block, ["key", "block"]).withColumn("segment", F.col("offset") + F.col("nth") + begins.cast("int")).select(
        "key", "t", "offered", "known", "over", "lead", "segment")


def _scan(rows: DataFrame, per_second: int) -> DataFrame:
    """``accepted`` of the ticks that are over: one pass over each segment in time order. A task reads its segments one after the other and
    holds a second of one of them."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, log, room = None, deque(), per_second
        for pdf in batches:
            out = []
            for key, seg, t, offered, fixed in zip(pdf["key"], pdf["segment"], pdf["t"], pdf["offered"], pdf["fixed"]):
                if (key, seg) != segment:
                    segment, log, room = (key, seg), deque(), per_second
                while log and log[0][0] < t - SECOND:
                    room += log.popleft()[1]
                taken = offered if fixed else min(offered, max(room, 0))
                log.append((t, taken))
                room -= taken
                out.append(taken)
            yield pdf[["key", "t"]].assign(accepted=out)[~pdf["fixed"].to_numpy()]

    kind = rows.schema["key"].dataType.simpleString()
    ordered = rows.repartition("key", "segment").sortWithinPartitions("key", "segment", "t", F.desc("fixed"))
    return ordered.mapInPandas(scan, f"key {kind}, t long, accepted long")


def accepted_ticks(ticks: DataFrame, per_second: int, save: Callable) -> DataFrame:
    """(key, t, offered, accepted) of ticks (key, t, offered, known). A ``known`` tick offers what was accepted before: it counts in the
    windows of others and is not returned. ``save(table, name)`` writes what is read more than once."""
    x = _segments(ticks, per_second, save)
    scanned = _scan(x.where("over or lead").select("key", "segment", "t", "offered", (~F.col("over")).alias("fixed")), per_second)
    return x.where("not known").select("key", "t", "offered", "over").join(scanned, ["key", "t"], "left").select(
        "key", "t", "offered", F.when(F.col("over"), F.col("accepted")).otherwise(F.col("offered")).alias("accepted"))


def _label(messages: DataFrame, ticks: DataFrame, key: str, save: Callable) -> DataFrame:
    """``accepted`` per message: within a tick the first ones are taken. Only ticks that lose messages are joined, with the number of the
    last message taken, which a bounded rank finds."""
    cut = save(ticks.where("accepted < offered").select(F.col("key").alias(key), F.col("t").alias("received_at"), F.col("accepted").alias("_take")), "cut")
    part = messages.select(key, "received_at", "ingest_seq").join(cut.where("_take > 0"), [key, "received_at"])
    last = exact_rank_value(part, [key, "received_at", "_take"], "ingest_seq", lambda n: F.col("_take"), "_last").select(key, "received_at", "_last")
    cut = cut.join(last, [key, "received_at"], "left").select(key, "received_at", "_last", F.lit(True).alias("_loses"))
    out = messages.join(cut, [key, "received_at"], "left")
    return out.withColumn("accepted", F.col("_loses").isNull() | F.coalesce(F.col("ingest_seq") <= F.col("_last"), F.lit(False))).drop("_loses", "_last")


def rate_cap(spans: DataFrame, per_second: int = RATE_LIMIT, key: str = "agent_id") -> DataFrame:
    """X2 as a batch job: ``accepted`` per message, in the order of ``received_at`` and ``ingest_seq`` (unique within a millisecond of a
    connection); ``per_second <= 0`` turns the cap off. Messages without a connection or a time are accepted."""
    if per_second <= 0:
        return spans.withColumn("accepted", F.lit(True))
    ticks = spans.where(F.col(key).isNotNull() & F.col("received_at").isNotNull()).groupBy(F.col(key).alias("key"), F.col("received_at").alias("t")).agg(
        F.count(F.lit(1)).alias("offered")).withColumn("known", F.lit(False))
    save = lambda table, name: written(table)
    return _label(spans, accepted_ticks(ticks, per_second, save), key, save)


class RateCap:
    """X2 as a stage of a micro-batch job: the state is each connection's accepted ticks of its last second."""

    def __init__(self, spark: SparkSession, root: str, per_second: int = RATE_LIMIT, key: str = "connection", every: int = 8):
        self.per_second, self.key = per_second, key
        self.state = KeyedState(spark, root, "ticks", "key string, t long, accepted long",
                                lambda rows: rows.groupBy("key", "t").agg(F.sum("accepted").alias("accepted")), every)

    @staticmethod
    def _last_second(ticks: DataFrame) -> DataFrame:
        newest = ticks.groupBy("key").agg(F.max("t").alias("newest"))
        return ticks.join(newest, "key").where(F.col("t") >= F.col("newest") - SECOND).select("key", "t", "accepted")

    def apply(self, messages: DataFrame, batch_id: int) -> DataFrame:
        """``accepted`` for a batch's messages (read more than once: give a written table). Writes the batch's ticks."""
        if self.per_second <= 0:
            return messages.withColumn("accepted", F.lit(True))
        own = messages.where(F.col(self.key).isNotNull() & F.col("received_at").isNotNull()).groupBy(
            F.col(self.key).cast("string").alias("key"), F.col("received_at").alias("t")).agg(F.count(F.lit(1)).alias("offered"))
        known = self.state.before(batch_id).select("key", "t", F.col("accepted").alias("offered"), F.lit(True).alias("known"))
        # a millisecond that an earlier batch began: its accepted messages count first
        both = own.withColumn("known", F.lit(False)).unionByName(known)
        spark, at = self.state.spark, f"{self.state.path}-of"

        def save(table: DataFrame, name: str) -> DataFrame:
            table.write.mode("overwrite").parquet(f"{at}/batch={batch_id}/{name}")
            return spark.read.schema(table.schema).parquet(f"{at}/batch={batch_id}/{name}")

        ticks = save(accepted_ticks(both, self.per_second, save), "ticks")
        delete(spark, f"{at}/batch={batch_id - 1}")
        self.state.add(batch_id, self._last_second(ticks.where("accepted > 0").select("key", "t", "accepted")))
        if self.state.due(batch_id):
            self.state.compact(batch_id, self._last_second)
        return _label(messages.withColumn(self.key, F.col(self.key).cast("string")), ticks, self.key, save)
