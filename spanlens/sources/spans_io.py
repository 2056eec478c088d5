"""Sources and sinks (S1-S6, S8-S11): NDJSON span dumps, snapshot documents, sessions, contracts, share codes.

Readers return DataFrames in the flat span layout (``spanlens.schema``); writers take DataFrames. Whole-document
formats (a snapshot, a session file, a contract file) are one JSON document per file, which Spark reads with
``wholetext`` (one file per task) and explodes; a session file with a call a line is read by line. Only the names of
session files of other layouts are gathered on the driver. The Spark-native layout for
large stores is Parquet partitioned by ``snapshot_id`` / ``session``.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.operators.ingest import parse_spans
from spanlens.schema import conform
from spanlens.session import written


def _vnull_or(c: Column, v: Column) -> Column:
    """A VARIANT that is JSON null when ``c`` is NULL (so ``to_json`` keeps the key)."""
    return F.when(c.isNull(), F.parse_json(F.lit("null"))).otherwise(v)


def span_json(spans: DataFrame) -> Column:
    """One span as TraceEvent / StoredSpan JSON text (``parent_span_id`` and ``error`` always present, optional
    ``description`` and absent ``output`` left out)."""
    cols = set(spans.columns)
    err = F.to_variant_object(F.struct(F.col("error_type").alias("type"), F.coalesce("error_message", F.lit("")).alias("message"),
                                       F.coalesce("error_stack", F.lit("")).alias("stack")))
    fields = [
        F.col("schema_version"), F.col("trace_id"), F.col("span_id"),
        _vnull_or(F.col("parent_span_id"), F.col("parent_span_id").cast("variant")).alias("parent_span_id"),
    ]
    source = F.struct("agent_id", "language", "file", F.coalesce("line", F.lit(0)).alias("line"), "function_name",
                      "description").alias("source")
    timing = F.struct(F.col("started_at").cast("double").alias("started_at"),
                      F.col("duration_ms").cast("double").alias("duration_ms")).alias("timing")
    body = [
        *fields, source, timing,
        F.coalesce(F.try_parse_json("input_json"), F.parse_json(F.lit("[]"))).alias("input"),
        F.try_parse_json("output_json").alias("output"),
        F.when(F.col("has_error"), err).otherwise(F.parse_json(F.lit("null"))).alias("error"),
        F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"),
    ]
    for extra in ("received_at", "ingest_seq", "anomaly", "distributed"):
        if extra in cols:
            body.append(F.col(extra))
    return F.to_json(F.struct(*body))


# ---------------------------------------------------------------- S1 / S2: NDJSON dumps


def read_spans(spark: SparkSession, path: str, require_uuid: bool = True, valid_only: bool = True) -> DataFrame:
    """NDJSON span dump(s) → flat spans (stored fields received_at / ingest_seq / anomaly / distributed kept if
    present; without ``ingest_seq``, lines count as newest first, as dumps are written)."""
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    v = F.try_parse_json("value")
    raw = raw.select(
        "value",
        F.try_variant_get(v, "$.received_at", "long").alias("received_at"),
        F.try_variant_get(v, "$.anomaly", "boolean").alias("anomaly"),
        F.try_variant_get(v, "$.distributed", "boolean").alias("distributed"),
        F.coalesce(F.try_variant_get(v, "$.ingest_seq", "long"), -F.monotonically_increasing_id()).alias("ingest_seq"),
    )
    parsed = parse_spans(raw, "value", require_uuid=require_uuid)
    return parsed.where(F.size("reasons") == 0).drop("reasons") if valid_only else parsed


def _newest(spans: DataFrame, last_n: int | None) -> DataFrame:
    newest = spans.orderBy(F.col("received_at").desc_nulls_last(), F.col("ingest_seq").desc_nulls_last())
    return newest if last_n is None else newest.limit(last_n)


def write_spans(spans: DataFrame, path: str, last_n: int | None = None) -> None:
    """Spans (the last ``last_n`` by arrival where asked), newest first, as NDJSON files in order of their names."""
    s = conform(spans)
    _newest(s, last_n).select(span_json(s).alias("value")).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- S3-S6: snapshots


def write_snapshot(spans: DataFrame, root: str, snapshot_id: str, tags: dict | None = None,
                   last_n: int | None = None) -> str:
    """A snapshot of the spans (the last ``last_n`` where asked) under ``root/snapshot_id=<id>/``: ``spans/`` holds them as
    NDJSON files, ``header/`` one document ``{id, createdAt, agents, spanCount, tags}``."""
    out = os.path.join(root, f"snapshot_id={snapshot_id}")
    write_spans(spans, os.path.join(out, "spans"), last_n)
    back = spans.sparkSession.read.text(os.path.join(out, "spans")).select(F.get_json_object("value", "$.source.agent_id").alias("agent_id"))
    facts = back.groupBy("agent_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.array_sort(F.collect_list("agent_id")).alias("agents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    header = facts.select(F.concat(
        F.lit('{"id":' + json.dumps(snapshot_id)),
        F.lit(',"createdAt":'), F.unix_millis(F.current_timestamp()).cast("string"),
        F.lit(',"agents":'), F.to_json("agents"), F.lit(',"spanCount":'), F.col("n").cast("string"),
        F.lit(',"tags":'), F.lit(json.dumps(tags or {}, separators=(",", ":"))), F.lit("}"),
    ).alias("value"))
    header.write.mode("overwrite").text(os.path.join(out, "header"))
    return out


def read_snapshot(spark: SparkSession, path: str, require_uuid: bool = True) -> DataFrame:
    """S3: foreign snapshot document(s) ``{id, createdAt, spans[]}`` → flat spans with ``snapshot_id`` and ``created_at`` (one file per task)."""
    docs = spark.read.text(path, wholetext=True)
    v = F.col("_doc")
    # parse each document once and drop its text before exploding, so no span row carries the whole document
    d = docs.select(F.try_parse_json("value").alias("_doc")).select(
        F.try_variant_get(v, "$.id", "string").alias("snapshot_id"),
        F.try_variant_get(v, "$.createdAt", "long").alias("created_at"),
        F.try_variant_get(v, "$.spans", "array<variant>").alias("_spans"),
    ).select("snapshot_id", "created_at", F.posexplode("_spans").alias("_pos", "_s"))
    d = d.select(
        "snapshot_id", "created_at", F.to_json("_s").alias("message"), F.col("_pos").alias("ingest_seq"),
        F.try_variant_get("_s", "$.received_at", "long").alias("received_at"),
        F.try_variant_get("_s", "$.anomaly", "boolean").alias("anomaly"),
        F.try_variant_get("_s", "$.distributed", "boolean").alias("distributed"),
    )
    parsed = parse_spans(d, "message", require_uuid=require_uuid)
    return parsed.where(F.size("reasons") == 0).drop("reasons")


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Snapshots under ``root``, from their headers alone: id, createdAt, span count, agents; newest id first."""
    docs = spark.read.text(os.path.join(root, "*", "header"))
    v = F.try_parse_json("value")
    return docs.select(
        F.try_variant_get(v, "$.id", "string").alias("snapshot_id"),
        F.try_variant_get(v, "$.createdAt", "long").alias("created_at"),
        F.try_variant_get(v, "$.spanCount", "long").alias("span_count"),
        F.try_variant_get(v, "$.agents", "array<string>").alias("agents"),
    ).where(F.col("snapshot_id").isNotNull()).orderBy(F.col("snapshot_id").desc())


def load_snapshot(spark: SparkSession, root: str, snapshot_id: str, require_uuid: bool = True) -> DataFrame:
    """The spans of one snapshot (replaces the current table content when written over it)."""
    at = os.path.join(root, f"snapshot_id={snapshot_id}")
    return read_spans(spark, os.path.join(at, "spans"), require_uuid).withColumn("snapshot_id", F.lit(snapshot_id))


# ---------------------------------------------------------------- S11: share codes


def encode_snapshot(json_text: Column) -> Column:
    """JSON text → base64url without padding (Spark's base64 wraps lines; they are removed)."""
    b64 = F.regexp_replace(F.base64(F.encode(json_text, "UTF-8")), "[=\\r\\n]", "")
    return F.translate(b64, "+/", "-_")


def decode_snapshot(code: Column) -> Column:
    """base64url → JSON text; NULL unless it is an object with ``id``, ``spans`` and ``createdAt``."""
    std = F.translate(code, "-_", "+/")
    padded = F.rpad(std, (F.ceil(F.length(std) / 4) * 4).cast("int"), "=")
    text = F.decode(F.unbase64(padded), "UTF-8")
    v = F.try_parse_json(text)
    ok = (
        F.schema_of_variant(v).startswith("OBJECT")
        & F.variant_get(v, "$.id", "variant").isNotNull()
        & F.variant_get(v, "$.spans", "variant").isNotNull()
        & F.variant_get(v, "$.createdAt", "variant").isNotNull()
    )
    return F.when(ok, text)


# ---------------------------------------------------------------- S8: sessions


def write_sessions(calls: DataFrame, sessions: DataFrame, root: str) -> None:
    """Calls as Parquet partitioned by session (the Spark layout), session metadata beside them."""
    calls.write.mode("overwrite").partitionBy("session").parquet(os.path.join(root, "calls"))
    sessions.write.mode("overwrite").parquet(os.path.join(root, "sessions"))


def read_sessions(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(os.path.join(root, "calls")), spark.read.parquet(os.path.join(root, "sessions"))


def write_session_documents(calls: DataFrame, sessions: DataFrame, path: str) -> None:
    """One JSON document ``{session, startTime, endTime, calls[]}`` per session, under ``path/session=<name>/``.

    A document is written line by line, a call a line, from rows sorted by sequence: no row and no memory holds a session. A document
    is one file, so one task writes it; sessions are spread over tasks. Absent arguments and returns leave their key out.
    """
    def value(c: str) -> Column:
        """The column as JSON text, null included."""
        return F.concat(F.lit(""), F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'(?s)\A\{"v":(.*)\}\z', 1))

    # a line break in JSON text is space between its parts: the call stays on its line
    raw = lambda key, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{key}":'), F.translate(c, "\r\n", "  "), F.lit(",")))
    error = F.when(F.col("error_type").isNull(), F.lit("null")).otherwise(
        F.concat(F.lit('{"type":'), value("error_type"), F.lit(',"message":'), value("error_message"), F.lit("}")))
    call = F.concat_ws("", F.lit('{"sequence":'), F.col("sequence").cast("string"), F.lit(',"function":'), value("function"), F.lit(',"spanId":'), value("span_id"),
                       F.lit(',"traceId":'), value("trace_id"), F.lit(","), raw("args", "args_json"), raw("return", "return_json"), F.lit('"durationMs":'),
                       value("duration_ms"), F.lit(',"error":'), error, F.lit("}"))
    head = F.concat(F.lit('{"session":'), value("session"), F.lit(',"startTime":'), value("start_time"), F.lit(',"endTime":'), value("end_time"), F.lit(',"calls":['))
    first = calls.groupBy("session").agg(F.min("sequence").alias("_first"))
    body = calls.join(first, "session").select("session", F.col("sequence").cast("long").alias("_at"),
                                               F.concat(F.when(F.col("sequence") == F.col("_first"), "").otherwise(","), call).alias("value"))
    ends = sessions.select("session", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("_at"), head.alias("value")),
                                                        F.struct(F.lit((1 << 63) - 1).alias("_at"), F.lit("]}").alias("value")))).alias("e")).select("session", "e.*")
    lines = body.unionByName(ends).repartition("session").sortWithinPartitions("session", "_at")
    lines.select("session", "value").write.mode("overwrite").partitionBy("session").text(path)


def _document_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files, without space around them and but for empty ones: file, block (start of the split), line."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                       F.trim("value", F.lit(" \t\r\n")).alias("line"))
    return raw.where(F.col("line") != "")


def _documents_by_line(spark: SparkSession, path: str) -> DataFrame:
    """(file, by_line, session, start_time, end_time), a row a file. ``by_line``: the file is one document that has a head up to ``"calls":[``,
    a call with a sequence on each line (all but the first after a comma) and ``]}``, so that its lines can be read one by one.

    A line's hash is put behind it before it is parsed: where it comes back as the next element, the line is whole JSON and no more.
    The session is null if it is no string.
    """
    line, mark = F.col("line"), F.col("_mark")
    text = mark.cast("string")
    opens, ends, later = line.endswith("["), line == "]}", line.startswith(",")
    call = F.concat(F.lit("["), F.when(later, line.substr(F.lit(2), F.length(line))).otherwise(line), F.lit(","), text, F.lit("]"))
    lines = _document_lines(spark, path).withColumn("_id", F.monotonically_increasing_id()).withColumn("_mark", F.xxhash64("line"))
    lines = lines.select("file", "block", "_id", "_mark", later.alias("_later"), ends.alias("_ends"),
                         F.when(opens, F.try_parse_json(F.concat("line", text, F.lit("]}")))).alias("_head"),
                         F.when(~opens & ~ends, F.try_parse_json(call)).alias("_call"))
    head = F.when(F.try_variant_get("_head", "$.calls[0]", "long") == mark, F.struct(
        F.when(F.schema_of_variant(F.variant_get("_head", "$.session", "variant")) == "STRING", F.try_variant_get("_head", "$.session", "string")).alias("session"),
        F.try_variant_get("_head", "$.startTime", "string").alias("start_time"), F.try_variant_get("_head", "$.endTime", "string").alias("end_time")))
    is_call = (F.try_variant_get("_call", "$[1]", "long") == mark) & F.try_variant_get("_call", "$[0].sequence", "long").isNotNull()
    lines = lines.select("file", "block", "_id", "_later", "_ends", head.alias("_head"), is_call.alias("_call"))
    kind = F.when(F.col("_head").isNotNull(), 0).when(F.col("_call") & ~F.col("_later"), 1).when(F.col("_call"), 2).when(F.col("_ends"), 3).otherwise(-1)
    # counts by split first: the order of a file's lines is that of (block, id)
    splits = lines.select("file", "block", "_id", "_head", kind.alias("kind")).groupBy("file", "block", "kind", "_head").agg(
        F.count(F.lit(1)).alias("n"), F.min("_id").alias("lo"), F.max("_id").alias("hi"))
    kinds = splits.groupBy("file", "kind").agg(F.sum("n").alias("n"), F.min(F.struct("block", F.col("lo").alias("id"))).alias("lo"),
                                               F.max(F.struct("block", F.col("hi").alias("id"))).alias("hi"), F.max("_head").alias("_head"))
    files = kinds.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("kind", "n", "lo", "hi"))).alias("k"), F.max("_head").alias("_head"))
    found = F.array_join(F.transform("k", lambda x: x["kind"].cast("string")), "")
    one = F.forall("k", lambda x: (x["kind"] == 2) | (x["n"] == 1))
    in_turn = F.forall(F.sequence(F.lit(1), F.size("k") - 1), lambda i: F.col("k")[i - 1]["hi"] < F.col("k")[i]["lo"])
    return files.select("file", F.when(found.isin("03", "013", "0123"), one & in_turn).otherwise(False).alias("by_line"), "_head.*")


def read_session_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Session JSON documents ``{session, startTime, endTime, calls[]}`` → (calls, sessions); a document
    without a string ``session`` or an array ``calls`` is skipped.

    A document with a call a line, as ``write_session_documents`` lays it out, is read line by line in as many tasks as it has splits;
    whether each file is so laid out is found by a pass over all lines before this returns. Any other document is read whole, in one task.
    """
    files = written(_documents_by_line(spark, path))
    others = [r.file for r in files.where("not by_line").select("file").collect()]
    docs = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_path").isin(others))
    v = F.col("_doc")
    d = docs.select(F.try_parse_json("value").alias("_doc")).select(
        F.try_variant_get(v, "$.session", "string").alias("session"),
        F.schema_of_variant(F.variant_get(v, "$.session", "variant")).alias("_st"),
        F.try_variant_get(v, "$.startTime", "string").alias("start_time"),
        F.try_variant_get(v, "$.endTime", "string").alias("end_time"),
        F.try_variant_get(v, "$.calls", "array<variant>").alias("_calls"),
    ).where((F.col("_st") == "STRING") & F.col("_calls").isNotNull())
    heads = files.where("by_line and session is not null")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    sessions = d.select("session", "start_time", "end_time").unionByName(heads.select("session", "start_time", "end_time")).select(
        "session", F.coalesce("start_time", now).alias("start_time"), F.coalesce("end_time", now).alias("end_time"))
    line = F.col("line")
    lines = _document_lines(spark, path).where(~line.endswith("[") & (line != "]}")).join(heads.select("file", "session"), "file").select(
        "session", F.lit(None).cast("int").alias("_pos"),
        F.try_parse_json(F.when(line.startswith(","), line.substr(F.lit(2), F.length(line))).otherwise(line)).alias("c"))
    c = d.select("session", F.posexplode("_calls").alias("_pos", "c")).unionByName(lines)
    err = F.variant_get("c", "$.error", "variant")
    has_err = err.isNotNull() & ~F.is_variant_null(err)
    calls = c.select(
        "session",
        F.coalesce(F.try_variant_get("c", "$.sequence", "long"), F.col("_pos") + 1).alias("sequence"),
        F.try_variant_get("c", "$.function", "string").alias("function"),
        F.try_variant_get("c", "$.spanId", "string").alias("span_id"),
        F.try_variant_get("c", "$.traceId", "string").alias("trace_id"),
        F.to_json(F.variant_get("c", "$.args", "variant")).alias("args_json"),
        F.to_json(F.variant_get("c", "$.return", "variant")).alias("return_json"),
        F.try_variant_get("c", "$.durationMs", "double").alias("duration_ms"),
        F.when(has_err, F.try_variant_get("c", "$.error.type", "string")).alias("error_type"),
        F.when(has_err, F.try_variant_get("c", "$.error.message", "string")).alias("error_message"),
    )
    return calls, sessions


# ---------------------------------------------------------------- S9: contracts


def write_contracts(contracts: DataFrame, path: str) -> None:
    """One contract JSON document per line."""
    head = F.to_json(F.struct(F.col("version"), F.col("function_name").alias("functionName"),
                              F.col("generated_at").alias("generatedAt"), F.col("sample_count").alias("sampleCount")))
    text = F.concat(
        F.expr("substring(_head, 1, length(_head) - 1)"),
        F.lit(',"args":['), F.array_join("args", ","), F.lit("]"),
        F.lit(',"returns":'), F.col("returns"),
        F.when(F.col("errors").isNotNull(), F.concat(F.lit(',"errors":['), F.array_join("errors", ","), F.lit("]")))
        .otherwise(F.lit("")),
        F.lit("}"),
    )
    contracts = contracts.withColumn("_head", head)
    contracts.select(text.alias("value")).write.mode("overwrite").text(path)


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Contract documents, one per line, or one per file in any layout; kept when version is "1.0", functionName is a
    string and args is an array; missing parts get defaults (sampleCount 0, returns ``{}``)."""
    files = spark.read.text(path, wholetext=True)
    # a file whose first line is a document holds one a line; any other file is one document
    lines = F.split(F.ltrim("value"), "\n")
    raw = files.select(F.explode(F.when(F.try_parse_json(lines[0]).isNotNull(), lines).otherwise(F.array("value"))).alias("value"))
    v = F.try_parse_json("value")
    ok = (
        (F.try_variant_get(v, "$.version", "string") == "1.0")
        & (F.schema_of_variant(F.variant_get(v, "$.functionName", "variant")) == "STRING")
        & F.schema_of_variant(F.variant_get(v, "$.args", "variant")).startswith("ARRAY")
    )
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    # schema texts keep their original key order: parse them as raw JSON strings, not as VARIANT
    raw_text = F.from_json("value", "args array<string>, returns string, errors array<string>")
    return raw.where(ok).select(
        F.try_variant_get(v, "$.functionName", "string").alias("function_name"),
        F.lit("1.0").alias("version"),
        F.coalesce(F.try_variant_get(v, "$.generatedAt", "string"), now).alias("generated_at"),
        F.coalesce(F.try_variant_get(v, "$.sampleCount", "long"), F.lit(0)).alias("sample_count"),
        raw_text["args"].alias("args"),
        F.coalesce(raw_text["returns"], F.lit("{}")).alias("returns"),
        raw_text["errors"].alias("errors"),
    )


# ---------------------------------------------------------------- S10: redaction config


def load_extra_keys(config_path: str) -> list[str]:
    """Extra redaction keys from a small JSON config file (``sanitizeKeys``); non-strings are ignored and a
    missing or bad file gives no extra keys."""
    spark = SparkSession.active()
    at = spark._jvm.org.apache.hadoop.fs.Path(config_path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    row = spark.read.text(config_path, wholetext=True).first()
    try:
        cfg = json.loads(row.value if row else "")
    except ValueError:
        return []
    keys = cfg.get("sanitizeKeys") if isinstance(cfg, dict) else None
    return [k for k in keys if isinstance(k, str)] if isinstance(keys, list) else []
