"""Redaction of JSON payload columns (R1-R5): the text is rewritten where a secret is, every other byte stays.

The text is never parsed into values. A few regular expressions put it into a form in which strings and structure cannot be confused:
escaped quotes and backslashes become one control character each, opening and closing quotes become two different ones. JSON allows
no raw control character, so the way back is exact; a text that holds one is no JSON and stays as it is. In that form a key to redact is
a string before a colon; its value is the next string or scalar, or, if a bracket opens, everything up to the bracket that closes it, which
one fold over the row's brackets finds at any depth. Numbers out of range, lone surrogates and repeated keys pass through untouched.

All of that is column expressions; rows whose text cannot hold a secret are left out by a pre-check. Every redaction is reported in
``redactions`` as (key, rule), so that the audit (R5) is a plain aggregation.

Modes: ``keys="hub"`` (the hub's 15 keys, keys only), ``keys="agent"`` (the agents' 36 keys plus value shapes), or an explicit list;
``values=True`` adds the value shapes (JWT, card number) for strings under an object key; ``bare_strings=True`` also tests strings that
are list items or top-level values (the Python agent's rule). ``rule=fn(key, value)`` replaces the key/value tests with a custom Python
function (redact when it returns ``[REDACTED]``); only then are values built, in an Arrow-batched helper.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The hub's default key list.
HUB_KEYS = [
    "password", "passwd", "token", "secret", "authorization", "auth", "api_key", "apikey", "credential",
    "private_key", "access_token", "refresh_token", "ssn", "credit_card", "card_number",
]
# The agents' default key list.
AGENT_KEYS = [
    "password", "passwd", "token", "secret", "authorization", "api_key", "apikey", "apitoken", "api_token", "auth",
    "auth_token", "access_token", "refresh_token", "id_token", "bearer", "jwt", "credential", "credentials",
    "private_key", "privatekey", "client_secret", "client_id", "session", "session_id", "sessionid", "cookie",
    "set_cookie", "x_api_key", "ssn", "social_security", "credit_card", "card_number", "cvv", "pin", "bank_account",
    "routing_number",
]
# Secret value shapes (tested on the trimmed string).
JWT_SHAPE = r"[A-Za-z0-9_-]{2,}(?:\.[A-Za-z0-9_-]{2,}){2}"
CARD_SHAPE = r"[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{1,7}"
REDACTED = "[REDACTED]"

#: White space that trimming removes, and that may part the groups of a card number: Unicode's, as the agents' languages have it.
SPACES = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: The shapes as Java reads them, without steps back: no white space or quote, which is all that may follow, is in a token's class.
_CARD = CARD_SHAPE.replace(r"\s", SPACES)
_SHAPE = r"(?:[\w-]{2,}+(?:\.[\w-]{2,}+){2}|" + _CARD + ")"
#: White space around a value; the first test spares most texts the long class.
_TRIM = f"(?:(?![!-~])[{SPACES}]++)?+"

REDACTION = T.StructType([
    T.StructField("json", T.StringType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("key", T.StringType()),
                                                     T.StructField("rule", T.StringType())]))),
])

# Control characters of the rewritten form: escaped quote, escaped backslash, opening and closing quote, "redact this key's value", and the
# four brackets inside strings.
_QUOTE, _BACKSLASH, _OPEN, _CLOSE, _MARK = "\x01", "\x02", "\x03", "\x04", "\x05"
_IN_STRING = "\x0e\x0f\x10\x11"
_RESERVED = "[\x01-\x05\x0e-\x11]"
_STRING = f"{_OPEN}[^{_CLOSE}]*+{_CLOSE}"
_COLON = r"\s*+:\s*+"


def _lexed(text: Column) -> Column:
    """The rewritten form: all quotes are string ends, and the two ends differ."""
    one = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    return F.regexp_replace(one, '"([^"]*+)"', f"{_OPEN}$1{_CLOSE}")


def _restored(form: Column) -> Column:
    for char, text in [*zip(_IN_STRING, "[]{}"), (_OPEN, '"'), (_CLOSE, '"'), (_MARK, ""), (_QUOTE, '\\"'), (_BACKSLASH, "\\\\")]:
        form = F.replace(form, F.lit(char), F.lit(text))
    return form


def _has_escapes(form: Column) -> Column:
    return F.contains(form, F.lit("\\")) | F.contains(form, F.lit(_QUOTE)) | F.contains(form, F.lit(_BACKSLASH))


def _beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.length(text)


def _decoded(content: Column) -> Column:
    """The string that JSON string content in the rewritten form stands for."""
    escaped = content.rlike(r"[\\" + _QUOTE + _BACKSLASH + _IN_STRING + "]")
    return F.when(escaped, F.from_json(F.concat(F.lit('["'), _restored(content), F.lit('"]')), "array<string>")[0]).otherwise(content)


def _literal(content: Column) -> Column:
    """A regular expression for exactly this text."""
    return F.regexp_replace(content, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", r"\\$1")


def _with_escaped(static: str, found: Column) -> Column:
    """A pattern for the static alternatives or any of the texts found in this row (few: those with escapes or beyond ASCII)."""
    return _let(found, lambda odd: F.when(F.size(odd) > 0, F.concat(F.lit("(?:" + static + "|"), F.array_join(F.transform(odd, _literal), "|"), F.lit(")"))).otherwise(
        F.lit(static)))


def _is_secret(text: Column) -> Column:
    return text.rlike(f"\\A{_TRIM}{_SHAPE}{_TRIM}\\z")


def _key_pattern(form: Column, keys: list[str]) -> Column:
    """The keys to redact, compared in lower case: ASCII keys by the pattern, keys written with escapes or beyond ASCII by their text."""
    lowered = sorted({k.lower() for k in keys})
    plain = [k for k in lowered if k.isascii()]
    static = "(?i:" + "|".join(re.escape(k) for k in plain) + ")" if plain else "(?!)"
    plain_text = r"\x20-\x5B\x5D-\x7E"  # printable ASCII but for the backslash
    odd = F.array_distinct(F.regexp_extract_all(form, F.lit(f"{_OPEN}([{plain_text}]*+[^{plain_text}{_CLOSE}][^{_CLOSE}]*+){_CLOSE}(?=\\s*+:)"), 1))
    odd = F.filter(odd, lambda k: F.lower(_decoded(k)).isin(*lowered) if lowered else F.lit(False))
    return F.when(_has_escapes(form) | _beyond_ascii(form), _with_escaped(static, odd)).otherwise(F.lit(static))


def _value_pattern(form: Column) -> Column:
    """A string, ends included, whose trimmed value has a secret shape."""
    escape = r"\\" + _QUOTE + _BACKSLASH
    odd = F.array_distinct(F.regexp_extract_all(form, F.lit(f"{_OPEN}([^{escape}{_CLOSE}]*+[{escape}][^{_CLOSE}]*+){_CLOSE}(?!\\s*+:)"), 1))
    odd = F.filter(odd, lambda v: F.coalesce(_is_secret(_decoded(v)), F.lit(False)))
    static = f"{_TRIM}{_SHAPE}{_TRIM}"
    return F.concat(F.lit(_OPEN), F.when(_has_escapes(form), _with_escaped(static, odd)).otherwise(F.lit(static)), F.lit(_CLOSE))


def _without_containers(form: Column) -> Column:
    """Objects and arrays under a marked key become the scalar 0, the outermost first: whatever is inside is gone with them."""
    held = F.lit(f"{_OPEN}[^{_CLOSE}\\[\\]{{}}]*+[\\[\\]{{}}][^{_CLOSE}]*+{_CLOSE}")  # a string with brackets
    safe = F.array_join(F.zip_with(F.split(form, held), F.regexp_extract_all(form, held, 0), lambda x, y: F.concat(
        x, F.coalesce(F.translate(y, "[]{}", _IN_STRING), F.lit("")))), "")
    tokens = F.regexp_extract_all(safe, F.lit(f"{_MARK}{_COLON}[\\[{{]|[\\[{{]|[\\]}}]|[^\\[\\]{{}}{_MARK}]++|{_MARK}"), 0)
    none = F.array().cast("array<struct<a: int, b: int>>")
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(-1).alias("start"), F.lit(0).alias("at"), none.alias("hits"))

    def step(s: Column, t: Column) -> Column:
        opens, closes = F.substring(t, -1, 1).isin("[", "{"), t.isin("]", "}")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        begins = (s["start"] < 0) & opens & t.startswith(_MARK)
        ends = (s["start"] >= 0) & closes & (depth == s["at"])
        return F.struct((s["i"] + 1).alias("i"), depth.alias("depth"),
                        F.when(begins, s["i"]).when(ends, F.lit(-1)).otherwise(s["start"]).alias("start"),
                        F.when(begins, s["depth"]).otherwise(s["at"]).alias("at"),
                        F.when(ends, F.concat(s["hits"], F.array(F.struct(s["start"].alias("a"), s["i"].alias("b"))))).otherwise(s["hits"]).alias("hits"))

    def cut(s: Column, tokens: Column) -> Column:
        # a container that never closes is redacted to the end
        hits = F.when(s["start"] >= 0, F.concat(s["hits"], F.array(F.struct(s["start"].alias("a"), (s["i"] - 1).alias("b"))))).otherwise(s["hits"])

        def join(hits: Column) -> Column:
            before = lambda j: F.when(j > 0, F.get(hits, j - 1)["b"] + 1).otherwise(F.lit(0))
            head = F.transform(hits, lambda h, j: F.concat(
                F.array_join(F.slice(tokens, before(j) + 1, h["a"] - before(j)), ""),
                F.regexp_replace(F.get(tokens, h["a"]), r"[\[{]\z", "0")))
            return F.concat(F.array_join(head, ""), F.array_join(F.slice(tokens, before(F.size(hits)) + 1, F.size(tokens)), ""))

        return _let(hits, join)

    return _let(tokens, lambda ts: _let(F.aggregate(ts, zero, step), lambda s: cut(s, ts)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _resolve_keys(keys: str | list[str], extra_keys: list | None) -> list[str]:
    base = HUB_KEYS if keys == "hub" else AGENT_KEYS if keys == "agent" else list(keys)
    extra = [k for k in (extra_keys or []) if isinstance(k, str)]  # non-strings are ignored
    return base + extra


def _precheck(text: Column, keys: list[str], shapes: bool) -> Column:
    """Superset test: can this text hold something to redact? Escapes and characters beyond ASCII are looked at closely."""
    plain = "|".join(re.escape(k.lower()) for k in keys if k.isascii())
    cond = F.contains(text, F.lit("\\")) | (_beyond_ascii(text) & text.rlike(r'"[\x00-\x21\x23-\x7F]*+[^"\x00-\x7F][^"]*+"\s*+:'))
    if plain:  # from the few ends of keys backwards
        cond = cond | text.rlike(f'"(?=\\s*+:)(?<="(?i:{plain})")')
    if shapes:  # first what the end of a secret looks like, from its points or digits on
        cond = cond | (text.rlike(f'(?:\\.[\\w-]{{2,}}+\\.[\\w-]{{2,}}+|{_CARD}){_TRIM}"') & text.rlike(f'"{_TRIM}{_SHAPE}{_TRIM}"'))
    return cond & ~text.rlike(_RESERVED)


def _rewritten(text: Column, keys: list[str], values: bool, bare: bool) -> Column:
    """(json, hits) of a text. Every step is computed once and bound by a lambda: the optimizer cannot copy it into filters."""
    none = F.array().cast(REDACTION["hits"].dataType)

    def marked(form: Column) -> Column:
        end = F.concat(F.lit(f"{_CLOSE}(?=\\s*+:)(?<={_OPEN}"), _key_pattern(form, keys), F.lit(f"{_CLOSE})"))
        return F.regexp_replace(form, end, F.lit(_CLOSE + _MARK))

    def flat(form: Column) -> Column:
        return F.when(F.contains(form, F.lit(_MARK)) & form.rlike(f"{_MARK}{_COLON}[\\[{{]"), _without_containers(form)).otherwise(form)

    def replaced(f: Column, v: Column) -> Column:
        by = lambda found, rule: F.transform(found, lambda k: F.struct(_decoded(k).alias("key"), F.lit(rule).alias("rule")))
        some = F.contains(f, F.lit(_MARK))
        hits = F.when(some, by(F.regexp_extract_all(f, F.lit(f"{_OPEN}([^{_CLOSE}]*+){_CLOSE}{_MARK}"), 1), "key")).otherwise(none)
        out = F.when(some, F.regexp_replace(f, f"({_MARK}{_COLON})(?:{_STRING}|[^\\s,\\[\\]{{}}{_OPEN}]++)", f'$1"{REDACTED}"')).otherwise(f)
        if not (values or bare):
            return F.struct(_restored(out).alias("json"), hits.alias("hits"))

        def shapes(o: Column) -> Column:
            found = []
            if values:
                member = F.concat(F.lit(f"{_OPEN}([^{_CLOSE}]*+){_CLOSE}{_COLON}"), v)
                found.append(by(F.regexp_extract_all(f, member, 1), "value"))
                o = F.regexp_replace(o, F.concat(F.lit(f"({_CLOSE}{_COLON})"), v), F.lit(f'$1"{REDACTED}"'))
            if bare:
                item = F.concat(F.lit(r"((?:\A|[\[,])\s*+)"), v, F.lit(r"(?!\s*+:)"))
                found.append(F.transform(F.regexp_extract_all(f, item, 1), lambda _: F.struct(F.lit(None).cast("string").alias("key"), F.lit("value").alias("rule"))))
                o = F.regexp_replace(o, item, F.lit(f'$1"{REDACTED}"'))
            return F.struct(_restored(o).alias("json"), F.flatten(F.array(hits, *found)).alias("hits"))

        return _let(out, lambda o: F.when(F.rlike(f, v), shapes(o)).otherwise(F.struct(_restored(o).alias("json"), hits.alias("hits"))))

    def of(t: Column) -> Column:
        pattern = _value_pattern if values or bare else lambda f: F.lit("")
        inner = _let(_lexed(t), lambda form: _let(marked(form), lambda m: _let(flat(m), lambda f: _let(pattern(f), lambda v: replaced(f, v)))))
        return F.when(_precheck(t, keys, values or bare), inner).otherwise(F.struct(t.alias("json"), none.alias("hits")))

    return _let(text, of)


def _redact_text(df: DataFrame, col: str, keys: list[str], values: bool, bare: bool) -> DataFrame:
    """``col`` rewritten, and ``_h_<col>`` with its hits."""
    x = df.withColumn(f"_r_{col}", _rewritten(F.col(col), keys, values, bare))
    return x.withColumn(col, F.col(f"_r_{col}.json")).withColumn(f"_h_{col}", F.col(f"_r_{col}.hits")).drop(f"_r_{col}")


# ---------------------------------------------------------------- R4: a custom Python rule


class _Number(float):
    """A number that keeps its text."""

    def __new__(cls, text: str):
        out = float.__new__(cls, text)
        out.text = text
        return out


def _dump(v) -> str:
    if isinstance(v, _Number):
        return v.text
    if isinstance(v, dict):
        return "{" + ",".join(_dump(k) + ":" + _dump(x) for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_dump, v)) + "]"
    text = json.dumps(v, ensure_ascii=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)  # lone surrogates have no UTF-8


def custom_redaction(rule: Callable) -> Callable[[str], tuple[str, list]]:
    """Text → (redacted text, hits) by ``rule(key, value)`` on every object member. A value nested too deep for Python is redacted whole."""
    def walk(v, hits: list):
        if isinstance(v, list):
            return [walk(x, hits) for x in v]
        if not isinstance(v, dict):
            return v
        out = {}
        for k, x in v.items():
            hit = rule(k, x) == REDACTED
            out[k] = REDACTED if hit else walk(x, hits)
            if hit:
                hits.append({"key": re.sub("[\ud800-\udfff]", "�", k), "rule": "custom"})
        return out

    def apply(text: str) -> tuple[str, list]:
        hits: list = []
        try:
            out = walk(json.loads(text, parse_float=_Number, parse_int=lambda s: int(s) if len(s) < 4000 else _Number(s)), hits)
            return (_dump(out) if hits else text), hits
        except ValueError:
            return text, []
        except RecursionError:
            return f'"{REDACTED}"', [{"key": None, "rule": "custom"}]

    return apply


def _redact_custom(df: DataFrame, col: str, rule: Callable) -> DataFrame:
    @F.pandas_udf(REDACTION)
    def udf(texts: pd.Series) -> pd.DataFrame:
        one = custom_redaction(rule)
        return pd.DataFrame([(t, []) if t is None else one(t) for t in texts], columns=["json", "hits"])

    x = df.withColumn(f"_r_{col}", udf(F.col(col)))
    return x.withColumn(col, F.col(f"_r_{col}.json")).withColumn(f"_h_{col}", F.col(f"_r_{col}.hits")).drop(f"_r_{col}")


# ---------------------------------------------------------------- R1-R5


def redact(df: DataFrame, cols: list[str] | None = None, keys: str | list[str] = "hub",
           extra_keys: list | None = None, values: bool | None = None, bare_strings: bool = False,
           rule: Callable | None = None) -> DataFrame:
    """Redact JSON text columns (default ``input_json``, ``output_json``) in place and add ``redactions``.

    A top-level string (or a string element of the ``input`` array) is only tested with ``bare_strings``, as in
    the reference; strings under an object key are tested with ``values``. Texts that are no JSON keep what cannot be read as a key
    with a value or as a string; null stays null.
    """
    cols = cols or [c for c in ("input_json", "output_json") if c in df.columns]
    key_list = _resolve_keys(keys, extra_keys)
    use_values = (keys == "agent") if values is None else values
    out = df
    for c in cols:
        out = _redact_custom(out, c, rule) if rule is not None else _redact_text(out, c, key_list, use_values, bare_strings)
    none = F.array().cast(REDACTION["hits"].dataType)
    hits = [F.coalesce(F.col(f"_h_{c}"), none) for c in cols]
    return out.withColumn("redactions", F.flatten(F.array(*hits)) if hits else none).drop(*(f"_h_{c}" for c in cols))


def redaction_audit(redacted: DataFrame) -> DataFrame:
    """Number of redactions by key and rule."""
    # the outer form, so that no filter on the whole rewrite is inferred and evaluated beside it
    return redacted.select(F.explode_outer("redactions").alias("r")).where("r is not null").groupBy(
        F.col("r.key").alias("key"), F.col("r.rule").alias("rule")
    ).agg(F.count(F.lit(1)).alias("redactions"))


def redact_strings(col, keys_col=None):
    """R3 for typed columns: a string column whose trimmed value has a secret shape → ``[REDACTED]``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(_is_secret(c), F.lit(REDACTED)).otherwise(c)
