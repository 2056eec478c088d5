"""Chat formatting by schema fingerprints: heterogeneous layouts become canonical turns, then one marked text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let

_TURNS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("role", "content", "text", "from", "value")]))

#: The fields that layouts are told by, and their types.
FIELDS: dict[str, T.DataType] = {
    "messages": _TURNS, "conversations": _TURNS, "turns": _TURNS, "system": T.StringType(), "prompt": T.StringType(),
    "response": T.StringType(), "completion": T.StringType(), "instruction": T.StringType(), "input": T.StringType(),
    "output": T.StringType(), "question": T.StringType(), "answer": T.StringType(),
}

#: Declarative mappings: nested field paths of a layout -> how its turns are read. A list layout names the list and its
#: role and text fields; a flat layout names (role, field) pairs, where several fields of one role are joined by a blank line.
LAYOUTS: dict[tuple[str, ...], tuple] = {
    ("messages[].content", "messages[].role"): ("list", "messages", "role", "content"),
    ("conversations[].from", "conversations[].value"): ("list", "conversations", "from", "value"),
    ("turns[].role", "turns[].text"): ("list", "turns", "role", "text"),
    ("messages[].content", "messages[].role", "system"): ("list", "messages", "role", "content", "system"),
    ("conversations[].from", "conversations[].value", "system"): ("list", "conversations", "from", "value", "system"),
    ("prompt", "response"): ("flat", ("user", "prompt"), ("assistant", "response")),
    ("completion", "prompt"): ("flat", ("user", "prompt"), ("assistant", "completion")),
    ("answer", "question"): ("flat", ("user", "question"), ("assistant", "answer")),
    ("instruction", "output"): ("flat", ("user", "instruction"), ("assistant", "output")),
    ("input", "instruction", "output"): ("flat", ("user", "instruction", "input"), ("assistant", "output")),
    ("prompt", "response", "system"): ("flat", ("system", "system"), ("user", "prompt"), ("assistant", "response")),
    ("input", "instruction", "output", "system"): ("flat", ("system", "system"), ("user", "instruction", "input"), ("assistant", "output")),
}

#: Role names of common layouts -> canonical roles; others stay as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

_ITEMS = ("role", "content", "text", "from", "value")
OPEN, CLOSE = "<turn>", "</turn>\n"


def from_json_text(record: Column) -> Column:
    """A JSON record as a struct of the fields that layouts are told by; other fields are passed over."""
    return F.from_json(record, T.StructType([T.StructField(n, t) for n, t in FIELDS.items()]))


def _holds(item: str):
    return lambda m: m[item].isNotNull()


def paths(record: Column, fields: list[str]) -> Column:
    """Sorted nested field paths that hold something in ``record`` (an empty or null-only list holds nothing)."""
    found = []
    for f in fields:
        if isinstance(FIELDS[f], T.ArrayType):
            found += [F.when(F.exists(record[f], _holds(i)), F.lit(f"{f}[].{i}")) for i in _ITEMS]
        else:
            found.append(F.when(record[f].isNotNull(), F.lit(f)))
    return F.array_sort(F.array_compact(F.array(*found)))


def fingerprint(path_array: Column) -> Column:
    return F.xxhash64(F.array_join(path_array, "|"))


def _turns(record: Column, layout: tuple) -> Column:
    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if layout[0] == "list":
        _, f, who, what, *system = layout
        names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
        turns = F.transform(record[f], lambda m: turn(F.coalesce(names[m[who]], m[who], F.lit("")), m[what]))
        return F.concat(F.array(turn(F.lit("system"), record[system[0]])), turns) if system else turns
    return F.array(*(turn(F.lit(role), F.array_join(F.filter(F.array(*(record[f] for f in fields)), lambda x: x != ""), "\n\n"))
                     for role, *fields in layout[1:]))


def canonical_turns(df: DataFrame, record: str, out: str = "turns") -> DataFrame:
    """Adds ``fingerprint`` and ``out``: array of (role, text), chosen by the hash of the record's nested field paths.

    ``record``: a struct column with some of ``FIELDS`` (see ``from_json_text``). A layout that no mapping names, and a
    null record, give null turns and keep their fingerprint, so nothing is guessed and nothing is lost. Null texts are
    empty, null roles the empty role.
    """
    kind = df.schema[record].dataType
    r = F.col(record)
    fields = [f for f in FIELDS if f in kind.fieldNames()]
    print_ = fingerprint(paths(r, fields))
    turns = F.lit(None).cast("array<struct<role: string, text: string>>")
    for names, layout in LAYOUTS.items():
        if {n.partition("[")[0] for n in names} <= set(fields):
            turns = F.when(F.col("fingerprint") == F.xxhash64(F.lit("|".join(sorted(names)))), _turns(r, layout)).otherwise(turns)
    return df.withColumn("fingerprint", print_).withColumn(out, turns)


def _escape(text: Column, role: bool = False) -> Column:
    """Without ``<`` and, in a role, without line ends: backslash becomes ``\\\\b``, ``<`` ``\\\\l``, line end ``\\\\n``."""
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(text, F.lit("\n"), F.lit("\\n")) if role else text


def _unescape(text: Column, role: bool = False) -> Column:
    if role:
        text = F.replace(text, F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_turns(turns: Column) -> Column:
    """One struct: ``formatted`` text and ``loss``: array of (start, length) over its code points, the assistants' texts.

    A turn is ``<turn>role``, a line end, the text, ``</turn>`` and a line end. Escapes leave no ``<`` inside roles and
    texts, so marks cannot be forged and ``read_turns`` gives back exactly what was formatted.
    """
    parts = F.transform(turns, lambda t: F.struct(
        (t["role"] == "assistant").alias("learn"), F.concat(F.lit(OPEN), _escape(t["role"], True), F.lit("\n")).alias("head"), _escape(t["text"]).alias("body")))

    def made(p: Column) -> Column:
        whole = F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("loss"))
        step = F.aggregate(p, start, lambda s, x: F.struct(
            (s["at"] + F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)).alias("at"),
            F.when(x["learn"], F.concat(s["loss"], F.array(F.struct(
                (s["at"] + F.length(x["head"])).cast("long").alias("start"), F.length(x["body"]).cast("long").alias("length")))))
            .otherwise(s["loss"]).alias("loss")))
        return F.struct(whole.alias("formatted"), step["loss"].alias("loss"))

    return let(parts, made)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(
        _unescape(F.substring_index(F.substring(x, len(OPEN) + 1, 2**31 - 1), "\n", 1), True).alias("role"),
        _unescape(F.substring(x, F.instr(x, "\n") + 1, F.length(x))).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: _unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def by_turn(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one record a conversation, in the ``turns`` layout.

    Turns are ordered by (turn with null first, role, text), so ties and repeated rows have a fixed place; rows with
    null conv_id are one conversation. Null text is empty, null role the empty role.
    """
    item = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("t")).select("conv_id", F.struct(
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.lit(None).cast("string").alias("content"), x["text"].alias("text"),
                                            F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("value"))).alias("turns")).alias("record"))


def formatted_digests(rows: DataFrame) -> DataFrame:
    """Formats by-turn conversations and reports digests of what is read back from the formatted text."""
    out = canonical_turns(by_turn(rows), "record").withColumn("f", format_turns(F.col("turns"))).select(
        "conv_id", F.explode(F.array(F.struct("f.formatted", "f.loss", read_turns(F.col("f.formatted")).alias("back")))).alias("x"))
    said = F.array_join(F.transform("x.back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.col("masked")
    return out.withColumn("masked", read_loss(F.col("x.formatted"), F.col("x.loss"))).select(
        "conv_id", F.size("x.back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"),
        F.length("x.formatted").cast("long").alias("formatted_chars"))


#: DuckDB: the digests straight from the rows, without any template; formatted length by the template's rule.
SQL = """
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + 15 + length(regexp_replace(text, '[^<\\\\]', '', 'g'))
      + length(regexp_replace(role, '[^<\\\\\\n]', '', 'g')))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
