"""Registered redaction (R1-R5) and HTTP extraction (P17) queries over payloads built from table text.

``documents``: every document becomes one call argument ``{"doc_id", "settings": [{key: value}...], "words":
[...]}`` where settings are all ``key = "value"`` assignments of the whole text and words are all whitespace
separated words of the whole text. ``pages``: every page becomes a request-like argument.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlens.functions.scalar import first_format
from spanlens.operators.http import http_calls
from spanlens.operators.redact import AGENT_KEYS, CARD_SHAPE, HUB_KEYS, JWT_SHAPE, redact, redaction_audit
from spanlens.plans.registry import register

ASSIGN = '(\\w+)\\s*=\\s*"([^"]*)"'


#: The same assignments, each word looked at once.
_ASSIGN_ONCE = '(?<!\\w)(\\w++)\\s*+=\\s*+"([^"]*+)"'


def _assigned(group: int):
    """Keys (1) or values (2) of all assignments; a text without an equals sign or a quote is not searched."""
    text = F.col("text")
    none = ~F.contains(text, F.lit("=")) | ~F.contains(text, F.lit('"'))
    return F.when(none, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(_ASSIGN_ONCE), group))


def doc_payloads(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ks, vs = _assigned(1), _assigned(2)
    payload = F.struct(
        "doc_id",
        F.zip_with(ks, vs, lambda k, v: F.create_map(k, v)).alias("settings"),
        F.split("text", "\\s+").alias("words"),
    )
    return d.select("doc_id", F.to_json(F.array(payload)).alias("input_json"))


_KEYS_SQL = ", ".join(f"'{k}'" for k in HUB_KEYS)


def _shape_sql(x: str) -> str:
    t = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return f"(regexp_full_match({t}, '{JWT_SHAPE}') or regexp_full_match({t}, '{CARD_SHAPE}'))"


_DOC_SQL = f"""
with a as (
  select doc_id, unnest(regexp_extract_all(text, '{ASSIGN.replace(chr(92) * 2, chr(92))}', 1)) as k,
         unnest(regexp_extract_all(text, '{ASSIGN.replace(chr(92) * 2, chr(92))}', 2)) as v
  from documents),
w as (select doc_id, unnest(regexp_split_to_array(text, '\\s+')) as w from documents),
hits as (
  select doc_id, k as key, 'key' as rule from a where lower(k) in ({_KEYS_SQL})
  union all
  select doc_id, k, 'value' from a where lower(k) not in ({_KEYS_SQL}) and {_shape_sql('v')}
  union all
  select doc_id, null, 'value' from w where {_shape_sql('w')})
"""


@register("redaction_audit", _DOC_SQL + "select key, rule, count(*) as redactions from hits group by all")
def q_redaction_audit(spark, sf_dir):
    r = redact(doc_payloads(spark, sf_dir), cols=["input_json"], keys="hub", values=True, bare_strings=True)
    return redaction_audit(r)


@register(
    "redacted_documents",
    _DOC_SQL
    + """
select d.doc_id, coalesce(h.n, 0) as redactions from documents d
left join (select doc_id, count(*) as n from hits group by doc_id) h using (doc_id)""",
)
def q_redacted_documents(spark, sf_dir):
    r = redact(doc_payloads(spark, sf_dir), cols=["input_json"], keys="hub", values=True, bare_strings=True)
    return r.select("doc_id", F.size("redactions").cast("long").alias("redactions"))


@register("redacted_documents_agent_keys")
def q_redacted_documents_agent(spark, sf_dir):
    """R2 (rows only): the agent key list with JS value rules (strings under a key only)."""
    r = redact(doc_payloads(spark, sf_dir), cols=["input_json"], keys="agent")
    return r.select("doc_id", F.size("redactions").alias("redactions"), "input_json")


def page_spans(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    method = F.when(F.col("page_id") % 2 == 0, F.lit("get")).otherwise(F.lit("post"))
    target = F.when(F.col("page_id") % 3 == 0, F.lit("path")).otherwise(F.lit("url"))
    obj = F.to_json(F.struct(
        method.alias("method"),
        F.when(target == "url", F.col("url")).alias("url"),
        F.when(target == "path", F.col("url")).alias("path"),
        F.struct(F.col("page_id").alias("x-page"), F.lit("text/html").alias("accept")).alias("headers"),
        F.when(method == "post", F.struct(F.length("html").alias("size"))).alias("body"),
    ))
    return p.select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("span_id"),
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("trace_id"),
        F.lit("web").alias("agent_id"), F.lit("handleRequest").alias("function_name"),
        F.concat(F.lit('["ctx",'), obj, F.lit("]")).alias("input_json"),
    )


@register(
    "http_calls",
    """
select 'p' || page_id as span_id, upper(case when page_id % 2 = 0 then 'get' else 'post' end) as method,
       url, cast(page_id as varchar) as x_page, 'text/html' as accept,
       case when page_id % 2 = 0 then null else '{"size":' || length(html) || '}' end as body
from pages""",
)
def q_http_calls(spark, sf_dir):
    h = http_calls(page_spans(spark, sf_dir))
    return h.select("span_id", "method", "url", F.col("headers")["x-page"].alias("x_page"),
                    F.col("headers")["accept"].alias("accept"), "body")


_AGENT_KEYS_SQL = ", ".join(f"'{k}'" for k in AGENT_KEYS)


@register(
    "redaction_agent_counts",
    f"""
with a as (
  select doc_id, unnest(regexp_extract_all(text, '{ASSIGN.replace(chr(92) * 2, chr(92))}', 1)) as k,
         unnest(regexp_extract_all(text, '{ASSIGN.replace(chr(92) * 2, chr(92))}', 2)) as v
  from documents),
hits as (
  select doc_id from a where lower(k) in ({_AGENT_KEYS_SQL})
  union all
  select doc_id from a where lower(k) not in ({_AGENT_KEYS_SQL}) and {_shape_sql('v')})
select d.doc_id, coalesce(h.n, 0) as redactions from documents d
left join (select doc_id, count(*) as n from hits group by doc_id) h using (doc_id)""",
)
def q_redaction_agent_counts(spark, sf_dir):
    """R2 + R3 with the JS rule: the agent key list, value shapes only for strings under an object key (the
    words of the text are list items, so they are kept)."""
    r = redact(doc_payloads(spark, sf_dir), cols=["input_json"], keys="agent")
    return r.select("doc_id", F.size("redactions").cast("long").alias("redactions"))


# the format rules for DuckDB, on the words of every conversation and every page address
_FORMATS_SQL = """
with w as (
  select unnest(string_split(text, ' ')) as w from conversations where text is not null
  union all select url from pages
  union all select url || chr(10) from pages
  union all select strftime(ts, '%Y-%m-%dT%H:%M:%SZ') from events
)
select f as format, count(*) as texts from (
  select case
    when regexp_full_match(w, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') then 'uuid'
    when regexp_full_match(w, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') then 'email'
    when regexp_full_match(w, '[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?)?') then 'date-time'
    when regexp_matches(w, '(?i)^https?://') then 'uri' end as f from w)
group by f
"""


@register("text_formats", _FORMATS_SQL)
def q_text_formats(spark, sf_dir):
    """F8: named formats of all words of conversations, page addresses (also with a line end) and event times."""
    words = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.explode(F.split("text", " ", -1)).alias("w"))
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("w"))
    times = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("w"))
    every = words.union(urls).union(urls.select(F.concat("w", F.lit("\n")))).union(times)
    return every.groupBy(first_format("w").alias("format")).agg(F.count(F.lit(1)).alias("texts"))


# ---------------------------------------------------------------- redacted text

#: Settings and words of a document as JSON that both engines write alike; every third document has a container under a secret key.
_TEXT_SQL = f"""
with t as (
  select doc_id, regexp_extract_all(text, '{ASSIGN.replace(chr(92) * 2, chr(92))}', 1) as ks,
         list_transform(regexp_extract_all(text, '{ASSIGN.replace(chr(92) * 2, chr(92))}', 2), lambda v: regexp_replace(v, '[^ !#-\\[\\]-~]', ' ', 'g')) as vs,
         list_transform(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda v: regexp_replace(v, '[^ !#-\\[\\]-~]', ' ', 'g')) as ws
  from documents where text is not null)
select doc_id,
       '[{{"doc_id": ' || doc_id || ', "settings":[' || array_to_string(list_transform(list_zip(ks, vs), lambda s:
            '{{"' || s[1] || '" : "' || case when lower(s[1]) in ({_KEYS_SQL}) or {_shape_sql('s[2]')} then '[REDACTED]' else s[2] end || '"}}'), ',') || ']'
       || case when doc_id % 3 = 0 then ',"Secret": "[REDACTED]","n":1.50' else ',"n":-0' end
       || ',"words":[' || array_to_string(list_transform(ws, lambda w: '"' || case when {_shape_sql('w')} then '[REDACTED]' else w end || '"'), ', ') || ']}}]' as redacted
from t"""


@register("redacted_text", _TEXT_SQL)
def q_redacted_text(spark, sf_dir):
    """R1 + R3: the whole redacted text of every document, byte for byte."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text is not null")
    plain = lambda v: F.regexp_replace(v, r"[^ !#-\[\]-~]", " ")
    settings = F.array_join(F.zip_with(_assigned(1), _assigned(2), lambda k, v: F.concat(F.lit('{"'), k, F.lit('" : "'), plain(v), F.lit('"}'))), ",")
    # the plain words, parted by line ends: split and cleaned in the whole text at once (a class that lists what goes is ten times as fast)
    d = d.withColumn("words", F.regexp_replace(F.regexp_replace("text", "[ \\t\\n\\r]+", "\n"), r'[\x00-\x09\x0B-\x1F"\\\x7F-\x{10FFFF}]', " "))
    secret = F.concat(F.lit(',"Secret": {"list":[1,"]}",{"token":[]}],"word":"'), F.substring_index("words", "\n", 1), F.lit('"},"n":1.50'))
    text = F.concat(F.lit('[{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "settings":['), settings, F.lit("]"),
                    F.when(F.col("doc_id") % 3 == 0, secret).otherwise(F.lit(',"n":-0')), F.lit(',"words":["'),
                    F.replace("words", F.lit("\n"), F.lit('", "')), F.lit('"]}]'))
    r = redact(d.select("doc_id", text.alias("input_json")), cols=["input_json"], keys="hub", values=True, bare_strings=True)
    return r.select("doc_id", F.col("input_json").alias("redacted"))
