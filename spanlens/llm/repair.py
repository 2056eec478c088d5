"""Conversation repair: the cheapest edits that make turns alternate, by a Viterbi search that works on chunks at once.

A repaired conversation's role initials read ``(s?(ua)+)?``. Its states: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may
end. A vector holds what the rest of a conversation costs from each state; a row turns the vector behind it into the one before it.
Vectors that differ by a constant lead to the same edits, so a vector is kept as its shape (least entry 0) and its constant. All
chunks of a conversation start at once from a guessed shape; fix-up passes rerun chunks whose right neighbour shows another shape,
until the shapes agree. Then the true shapes and states are followed from chunk to chunk by doubling, and each chunk traces its edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Rows of a chunk: what one task holds of a conversation.
CHUNK = 128
#: Costs of the edits, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The state that an inserted or reroled turn leads to, and its role.
_AFTER = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
#: Where keeping a row leads, by state: initials s, u, a, any other.
_KEEP = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
#: Faults by number.
BLANK, DUPLICATE, CUT = 1, 2, 3

Shape = tuple[int, int, int, int]
#: What the end costs from each state: nothing to insert, user and assistant, an assistant, nothing.
END: Shape = (0, 2 * INSERT, INSERT, 0)


@cache
def step(behind: Shape, code: int) -> tuple[Shape, int, tuple[tuple[str, int], ...]]:
    """A row before the vector ``behind``: the new shape, its constant, and for each state the least letters and the state after the row.

    ``code`` is the initial (0 s, 1 u, 2 a, 3 other) plus 4 times the fault. Letters are tried in ASCII order: D, I, K, R. The number of
    different shapes is small, because any two states are a few inserts apart, so nearly every call is a look-up.
    """
    initial, fault = code % 4, code // 4
    more = TRUNCATED if fault == CUT else 0
    edits: list[list[tuple[int, str, int]]] = []
    for q in range(4):
        edits.append([(DELETE + behind[q], "D", q)])
        if fault not in (BLANK, DUPLICATE):
            if q in _KEEP[initial]:
                edits[q].append((more + behind[_KEEP[initial][q]], "K", _KEEP[initial][q]))
            edits[q].append((REROLE + more + behind[_AFTER[q]], "R", _AFTER[q]))
    cost = [min(e)[0] for e in edits]
    two, three = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    full = (min(cost[0], INSERT + two), min(cost[1], INSERT + two), two, three)
    choice = []
    for q in range(4):
        letters, at = "", q
        while True:
            ways = [(letter, to) for c, letter, to in edits[at] if c == full[at]]
            if INSERT + full[_AFTER[at]] == full[at]:
                ways.append(("I", _AFTER[at]))
            letter, to = min(ways)
            letters, at = letters + letter, to
            if letter != "I":
                break
        choice.append((letters, at))
    least = min(full)
    return tuple(c - least for c in full), least, tuple(choice)


def ending(q: int) -> str:
    """The inserts that end a conversation in state ``q``."""
    return "I" * (END[q] // INSERT)


def shape_of(text: str) -> Shape:
    return tuple(map(int, text.split(",")))


def name_of(shape: Shape) -> str:
    return ",".join(map(str, shape))


def costs(codes: list[int], right: str) -> tuple[str, int]:
    """The shape before the rows, and its constant, if ``right`` is the shape behind them."""
    v, total = shape_of(right), 0
    for c in reversed(codes):
        v, add, _ = step(v, c)
        total += add
    return name_of(v), total


def rerun(codes: list[int], right: str, guess: str, out: str, total: int) -> tuple[str, int]:
    """As ``costs``, given that ``guess`` behind the rows led to ``out`` and ``total``: once the two vectors differ by a constant only,
    the rest of the rows adds to both alike."""
    v, w, mine, theirs = shape_of(right), shape_of(guess), 0, 0
    for c in reversed(codes):
        if v == w:
            return out, total + mine - theirs
        (v, a, _), (w, b, _) = step(v, c), step(w, c)
        mine, theirs = mine + a, theirs + b
    return name_of(v), mine


def traced(codes: list[int], right: str, q: int) -> tuple[list[str], int]:
    """Each row's letters, inserts before it first, from state ``q`` on, and the state after the rows."""
    v, choices = shape_of(right), []
    for c in reversed(codes):
        v, _, choice = step(v, c)
        choices.append(choice)
    letters = []
    for choice in reversed(choices):
        edit, q = choice[q]
        letters.append(edit)
    return letters, q


_costs = T.StructType([T.StructField("s_out", T.StringType()), T.StructField("add", T.LongType())])


@F.pandas_udf(_costs)
def _first(codes: pd.Series, right: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([costs(c.tolist(), r) for c, r in zip(codes, right)], columns=["s_out", "add"])


@F.pandas_udf(_costs)
def _again(codes: pd.Series, right: pd.Series, guess: pd.Series, out: pd.Series, add: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rerun(c.tolist(), *r) for c, *r in zip(codes, right, guess, out, add)], columns=["s_out", "add"])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _ends(codes: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([[traced(c.tolist(), r, q)[1] for q in range(4)] for c, r in zip(codes, right)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _edits(codes: pd.Series, right: pd.Series, q: pd.Series, last: pd.Series) -> pd.Series:
    out = []
    for c, r, at, end in zip(codes, right, q, last):
        letters, at = traced(c.tolist(), r, at)
        out.append([*letters, ending(at)] if end else letters)
    return pd.Series(out)


def ordered(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with ``conv`` (the id as text, null: one space) and ``at``, a number in the order of conversation,
    turn (null first), role and text. A range of that order is a task, so a large conversation lies in many; equal rows lie apart too."""
    rows = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), "conv_id", "turn", "role", "text",
                       F.monotonically_increasing_id().alias("source"))
    keys = ["conv", "turn", "role", "text", "source"]
    return written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("source").withColumn("at", F.monotonically_increasing_id()), "turns")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def placed(turns: DataFrame, chunk: int) -> DataFrame:
    """``conv, at, chunk, place`` and each row's ``code``: its initial plus 4 times its first fault."""
    first = F.left("role", F.lit(1))
    rows = turns.select("conv", "at", (F.shiftright("at", 33)).alias("part"), F.sha2(F.concat_ws("\n", "role", "text"), 256).alias("digest"), F.length("role").alias("size"),
                        F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("initial"),
                        is_blank(F.col("text")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    firsts = rows.groupBy("conv", "size", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    runs = rows.groupBy("conv", "part").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as tasks hold the conversation
    runs = runs.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    fault = F.when(F.col("blank"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    seq = F.col("offset") + F.col("at") - F.col("start")
    return rows.join(firsts, "at", "left").join(runs, ["conv", "part"]).select(
        "conv", "at", F.floor(seq / chunk).alias("chunk"), (seq % chunk).cast("int").alias("place"), (F.col("initial") + 4 * fault).alias("code"))


def followed(maps: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """(conv, pos, mark) of every position reached from ``starts`` (position 0), where ``maps`` (conv, pos, mark, next) leads from a
    position's mark to the next position's. Jumps double, so the joins grow with the logarithm of ``steps``."""
    reached, jump = starts, 1
    while jump < steps:
        more = reached.join(maps, ["conv", "pos", "mark"]).select("conv", (F.col("pos") + jump).alias("pos"), F.col("next").alias("mark"))
        reached = written(reached.union(more), "reached")
        if jump * 2 < steps:
            on = maps.select("conv", F.col("pos").alias("_p"), F.col("mark").alias("_m"), F.col("next").alias("_n"))
            maps = written(maps.select("conv", "pos", "mark", "next", (F.col("pos") + jump).alias("_p"), F.col("next").alias("_m"))
                           .join(on, ["conv", "_p", "_m"]).select("conv", "pos", "mark", F.col("_n").alias("next")), "jumps")
        jump *= 2
    return reached


def settled(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, mark, s_out, add): the true shape behind every chunk (``mark``) and what it leads to.

    Every chunk first runs as if the conversation ended behind it, which is true for the last one. The first fix-up pass reruns a chunk
    from the shape that its right neighbour shows. If that gives the neighbours new shapes again, later passes rerun the conversation's
    chunks from every shape it has shown, so their number is bounded by the number of shapes, not of chunks.
    """
    end = name_of(END)
    runs = written(chunks.withColumn("s_in", F.lit(end)).withColumn("r", _first("codes", "s_in")).select("conv", "chunk", "n_chunks", "s_in", "r.*"), "runs")
    guess = runs.where("n_chunks > 1").select("conv", "chunk", F.col("s_in").alias("guess"), F.col("s_out").alias("guess_out"), F.col("add").alias("guess_add"))
    many = chunks.where("chunk < n_chunks - 1")
    new, passes = runs.where("n_chunks > 1"), 0
    while True:
        shown = new.where("chunk > 0").select("conv", (F.col("chunk") - 1).alias("chunk"), F.col("s_out").alias("s_in")).distinct()
        wanted = shown.join(runs, ["conv", "chunk", "s_in"], "left_anti")
        if passes:
            shapes = runs.where("n_chunks > 1 and chunk > 0").select("conv", F.col("s_out").alias("s_in")).distinct()
            every = many.select("conv", "chunk").join(shapes, "conv").join(wanted.select("conv").distinct(), "conv", "left_semi")
            wanted = every.join(runs, ["conv", "chunk", "s_in"], "left_anti")
        new = written(many.join(wanted, ["conv", "chunk"]).join(guess, ["conv", "chunk"])
                      .withColumn("r", _again("codes", "s_in", "guess", "guess_out", "guess_add"))
                      .select("conv", "chunk", "n_chunks", "s_in", "r.*"), "fixed")
        if new.isEmpty():
            break
        runs, passes = runs.union(new), passes + 1
    steps = chunks.agg(F.max("n_chunks")).first()[0] or 0
    pos = (F.col("n_chunks") - 1 - F.col("chunk")).alias("pos")
    maps = runs.where("n_chunks > 1").select("conv", pos, F.col("s_in").alias("mark"), F.col("s_out").alias("next"))
    starts = chunks.where("chunk = 0").select("conv", F.lit(0).cast("long").alias("pos"), F.lit(end).alias("mark"))
    true = followed(maps, starts, steps)
    return runs.withColumn("pos", pos).withColumnRenamed("s_in", "mark").join(true, ["conv", "pos", "mark"]).drop("pos")


def repair(turns: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``turns`` as ``ordered`` gives them: the edits and one row a conversation.

    Edits: conv, chunk, place, step (their order), edit (D, I, K or R), role (an inserted or reroled turn's, else null), at (the row it
    edits; null for an insert). Conversations: conv, blank, duplicate, truncated, illegal, cost. Any edit path that gets to the least
    cost is a candidate; the one whose letters come first in ASCII order is taken. No task holds more of a conversation than a chunk.
    """
    rows = written(placed(turns, chunk), "places")
    n_chunks = rows.groupBy("conv").agg((F.max("chunk") + 1).alias("n_chunks"))
    chunks = rows.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("c"))
    chunks = written(chunks.join(n_chunks, "conv").select("conv", "chunk", "n_chunks", F.col("c.code").alias("codes")), "chunks")
    true = written(settled(chunks).select("conv", "chunk", "mark", "s_out", "add"), "shapes")
    steps = chunks.agg(F.max("n_chunks")).first()[0] or 0

    known = written(chunks.join(true, ["conv", "chunk"]).withColumn("ends", _ends("codes", "mark")), "ends")
    maps = known.where("n_chunks > 1").select("conv", F.col("chunk").alias("pos"), F.posexplode("ends").alias("mark", "next"))
    starts = known.where("chunk = 0").select("conv", F.col("chunk").alias("pos"), F.lit(0).alias("mark"))
    states = followed(maps, starts, steps).select("conv", F.col("pos").alias("chunk"), F.col("mark").alias("state"))
    edits = (known.join(states, ["conv", "chunk"])
             .withColumn("e", _edits("codes", "mark", "state", F.col("chunk") == F.col("n_chunks") - 1))
             .select("conv", "chunk", "state", F.posexplode("e").alias("place", "letters")))
    # the roles of inserted and reroled turns alternate with the state, which the letters and the rows' initials give
    edits = edits.join(rows.select("conv", "chunk", "place", "at", (F.col("code") % 4).alias("initial")), ["conv", "chunk", "place"], "left")
    lines = edits.groupBy("conv", "chunk", "state").agg(F.sort_array(F.collect_list(F.struct("place", "letters", "at", "initial"))).alias("e"))
    lines = lines.select("conv", "chunk", F.explode(_roles("e", "state")).alias("l")).select("conv", "chunk", "l.*")

    pair = lambda a, b: ~F.concat(a, b).isin("01", "12", "21")  # su, ua, au
    initials = F.transform("codes", lambda c: (c % 4).cast("string"))
    inside = F.size(F.filter(F.arrays_zip(F.slice(initials, 1, F.size("codes") - 1).alias("a"), F.slice(initials, 2, F.size("codes")).alias("b")),
                             lambda p: pair(p["a"], p["b"])))
    fault = lambda k: F.size(F.filter("codes", lambda c: F.floor(c / 4) == k))
    per = chunks.select("conv", "chunk", inside.alias("inside"), initials[0].alias("first"), F.element_at(initials, -1).alias("last"),
                        *(fault(k).alias(n) for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))))
    per = per.join(per.select("conv", (F.col("chunk") + 1).alias("chunk"), F.col("last").alias("previous")), ["conv", "chunk"], "left")
    per = per.join(true, ["conv", "chunk"])
    total = per.groupBy("conv").agg(
        *(F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")),
        F.sum(F.col("inside") + F.coalesce(pair(F.col("previous"), F.col("first")), F.lit(False)).cast("int")).cast("long").alias("illegal"),
        (F.sum("add") + F.max(F.when(F.col("chunk") == 0, F.split("s_out", ",")[0].cast("long")))).alias("cost"))
    return lines, total


_LINE = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("step", T.IntegerType()), T.StructField("edit", T.StringType()),
                      T.StructField("role", T.StringType()), T.StructField("at", T.LongType())])


@F.pandas_udf(T.ArrayType(_LINE))
def _roles(edits: pd.Series, state: pd.Series) -> pd.Series:
    out = []
    for rows, q in zip(edits, state):
        lines = []
        for r in rows:
            for i, letter in enumerate(r["letters"]):
                role = None
                if letter in "IR":
                    q = _AFTER[q]
                    role = _ROLE[q]
                elif letter == "K":
                    q = _KEEP[int(r["initial"])][q]
                lines.append({"place": r["place"], "step": i, "edit": letter, "role": role, "at": None if letter == "I" else int(r["at"])})
        out.append(lines)
    return pd.Series(out)


def repaired_turns(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations: conv, chunk, place, step (their order), role, text, edit. Inserted turns have an empty text."""
    kept = edits.where("edit != 'D'").withColumnRenamed("role", "new").join(turns.select("at", F.col("role").alias("old"), "text"), "at", "left")
    return kept.select("conv", "chunk", "place", "step", F.coalesce("new", "old").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def turn_digests(lines: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): lowercase hex over a conversation's ``role:text`` lines, joined by newlines.

    A SHA-256 reads its input in order, so one task reads a conversation's lines; it holds one line at a time, whatever their number.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, ids, out = None, None, [], []
        for batch in batches:
            for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line")):
                if conv != now:
                    if now is not None:
                        ids.append(now)
                        out.append(h.hexdigest())
                    now, h = conv, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(line.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], ["conv", "repaired_sha256"])
            ids, out = [], []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([h.hexdigest()])], ["conv", "repaired_sha256"])

    order = ["conv", "chunk", "place", "step"]
    one = lines.select(*order, F.concat_ws(":", "role", "text").cast("binary").alias("line")).repartition("conv").sortWithinPartitions(*order)
    return one.select("conv", "line").mapInArrow(digest, "conv string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Seeded faults by crc32(``conv_id:turn``) mod 20: 0 drops a row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it a user's.

    A null role, text, id or turn reads as one space; the id and the turn themselves stay null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def repair_report(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Damages all rows, then one row for every original conv_id: what was found, the least cost, its edits and the repaired turns' hash.

    Rows of one turn are taken by role and text; equal rows follow each other, the later one is a duplicate. Rows of a null id are one
    conversation. A role that does not begin with s, u or a can be reroled or deleted only. A conversation that lost all its rows has
    zeros, an empty audit and the hash of the empty text. Columns other than conv_id, turn, role and text are not read; an empty
    table gives an empty result. Conversations and texts of any length count whole.
    """
    conversations = conversations.select("conv_id", "turn", "role", "text")
    turns = ordered(damage(conversations))
    edits, totals = repair(turns, chunk)
    edits = written(edits, "edits")
    letters = edits.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "step", "edit"))).alias("e"))
    audit = (letters.select("conv", "chunk", F.array_join("e.edit", "").alias("e")).groupBy("conv")
             .agg(F.sort_array(F.collect_list(F.struct("chunk", "e"))).alias("e")).select("conv", F.array_join("e.e", "").alias("audit")))
    gaps = turns.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    every = conversations.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    out = every.join(gaps, "conv", "left").join(totals, "conv", "left").join(audit, "conv", "left").join(turn_digests(repaired_turns(turns, edits)), "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _state_sql(q: int) -> str:
    """The cheapest way from state ``q`` before a row, without inserts before it."""
    ways = [f"{{c: {DELETE} + n.s{q}.c, a: 'D' || n.s{q}.a, t: n.s{q}.t}}"]
    line = "d.text || chr(10) || n.s{0}.t"
    for initial, letter in enumerate("sua"):
        if q in _KEEP[initial]:
            to = _KEEP[initial][q]
            ways.append(f"{{c: case when d.fault in (0, 3) and left(d.role, 1) = '{letter}' then d.fault + n.s{to}.c else 1000000000 end,"
                        f" a: 'K' || n.s{to}.a, t: d.role || ':' || {line.format(to)}}}")
    to = _AFTER[q]
    ways.append(f"{{c: case when d.fault in (0, 3) then {REROLE} + d.fault + n.s{to}.c else 1000000000 end, a: 'R' || n.s{to}.a, t: '{_ROLE[to]}:' || {line.format(to)}}}")
    return f"list_sort([{', '.join(ways)}])[1]"


def _insert_sql(q: str, after: str, role: str) -> str:
    return f"list_sort([{q}, {{c: {INSERT} + {after}.c, a: 'I' || {after}.a, t: '{role}:' || chr(10) || {after}.t}}])[1]"


#: The same results by one recursion over the rows of each conversation, last row first.
SQL = rf"""
with recursive crc_table as (
    select list_transform(range(256), lambda n: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as crc),
keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') as conv,
           coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
kinds as (
    select keyed.*, xor(list_reduce(list_transform(string_split(key, ''), lambda x: ascii(x)::bigint),
                                    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 20 as kind
    from keyed, crc_table),
damaged as (
    select conv, turn, case when kind = 4 then 'user' else role end as role,
           case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text
    from kinds, range(2) copies(i) where kind != 0 and (i = 0 or kind = 3)),
numbered as (select *, row_number() over (partition by conv order by turn nulls first, role, text) as r from damaged),
d as (
    select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1
                   when row_number() over (partition by conv, role, text order by r) > 1 then 2
                   when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 3 else 0 end as fault,
           left(lag(role) over (partition by conv order by r), 1) || left(role, 1) as pair
    from numbered),
steps as (
    select conv, max(r) + 1 as r, {{c: 0, a: '', t: ''}} as s0, {{c: 6, a: 'II', t: 'user:' || chr(10) || 'assistant:' || chr(10)}} as s1,
           {{c: 3, a: 'I', t: 'assistant:' || chr(10)}} as s2, {{c: 0, a: '', t: ''}} as s3 from d group by conv
    union all
    select conv, r, {_insert_sql('b0', 'f2', 'user')}, {_insert_sql('b1', 'f2', 'user')}, f2, f3 from (
        select conv, r, b0, b1, {_insert_sql('b2', 'b3', 'assistant')} as f2, {_insert_sql('b3', 'b2', 'user')} as f3 from (
            select n.conv, d.r, {_state_sql(0)} as b0, {_state_sql(1)} as b1, {_state_sql(2)} as b2, {_state_sql(3)} as b3
            from steps n join d on d.conv = n.conv and d.r = n.r - 1))),
found as (
    select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank,
           count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
           count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from d group by conv)
select k.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(s0.c, 0)::bigint as cost,
       coalesce(s0.a, '') as audit, sha256(coalesce(left(s0.t, length(s0.t) - 1), '')) as repaired_sha256
from (select distinct conv_id, conv from keyed) k left join found using (conv) left join (select conv, s0 from steps where r = 1) using (conv)
"""
