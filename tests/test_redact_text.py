"""Redaction rewrites text in place: against a plain walk over parsed values, and byte for byte outside the secrets."""

from __future__ import annotations

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spanlens.operators.redact import AGENT_KEYS, HUB_KEYS, custom_redaction, redact

SPACE = " \t\n\x0b\x0c\r\u00a0\u2003\ufeff"
JWT = re.compile(r"[A-Za-z0-9_-]{2,}(?:\.[A-Za-z0-9_-]{2,}){2}")
CARD = re.compile(rf"[0-9]{{4}}[{SPACE}-]?[0-9]{{4}}[{SPACE}-]?[0-9]{{4}}[{SPACE}-]?[0-9]{{1,7}}")


def plain(v, keys, values, bare, hits, member=None):
    """The rule on a parsed value."""
    if isinstance(v, dict):
        out = {}
        for k, x in v.items():
            if k.lower() in keys:
                hits.append((k, "key"))
                out[k] = "[REDACTED]"
            else:
                out[k] = plain(x, keys, values, bare, hits, k)
        return out
    if isinstance(v, list):
        return [plain(x, keys, values, bare, hits) for x in v]
    if isinstance(v, str) and (values if member is not None else bare) and any(p.fullmatch(v.strip(SPACE)) for p in (JWT, CARD)):
        hits.append((member, "value"))
        return "[REDACTED]"
    return v


def payload(draw, depth=0):
    kind = draw.random()
    if depth < 4 and kind < 0.35:
        keys = draw.sample(["id", "note", "Password", "TOKEN", "ssn", "päss", "to ken", 'qu"ote', "back\\", "a[b", "c}d", "pass:word", "session", "tokenK"], draw.randint(0, 5))
        return {k: payload(draw, depth + 1) for k in keys}
    if depth < 4 and kind < 0.55:
        return [payload(draw, depth + 1) for _ in range(draw.randint(0, 4))]
    return draw.choice([None, True, 12, -0.5, 1e300, "", "plain", "abc.def.ghi", " abc.def.ghi\n", " abc.def.ghi", "4532 0151 1283 0366", "4532 01511283036",
                        'say "token": "x"', "password", "\\", "a\\\"b", "{[", "]}", ",", ":", "é.ü.ß", "ab.cd.ef.gh", "\U0001f600", "x" * 300])


def texts():
    draw = random.Random(3)
    out = []
    for _ in range(400):
        v = payload(draw)
        out.append(json.dumps(v, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, None, 1]), separators=draw.choice([None, (",", ":"), (" , ", " : ")])))
    # keys and values written with escapes
    out += [r'{"password":"x","a":"abc.def.ghi","t\/oken":1,"token":{"b":[1,"}"]},"z":"abc"}', r'["abc.def.ghi","\tabc.def.ghi "]', '"abc.def.ghi"',
            '{"auth":{"a":{"token":"x"},"b":[[[{"c":1}]]]},"token":[],"secret":{} ,"ssn":""}', '[[],{},[{}],{"ssn" : 5 }]']
    return out


@pytest.mark.parametrize("keys, values, bare", [("hub", False, False), ("agent", True, False), ("agent", True, True), ("hub", False, True)])
def test_equals_a_walk_over_values(spark, keys, values, bare):
    keyset = {k.lower() for k in (HUB_KEYS if keys == "hub" else AGENT_KEYS)} | {"päss", "a[b"}
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "id int, input_json string")
    got = {r.id: r for r in redact(df, keys=keys, extra_keys=["PÄss", "A[b", 7], values=values, bare_strings=bare).collect()}
    some = 0
    for i, t in rows:
        hits: list = []
        want = plain(json.loads(t), keyset, values, bare, hits)
        assert json.loads(got[i].input_json) == want, t
        assert sorted((h.key or "", h.rule) for h in got[i].redactions) == sorted((k or "", r) for k, r in hits), t
        if not hits:
            assert got[i].input_json == t
        some += bool(hits)
    assert some > 60


def test_untouched_text_stays_byte_for_byte(spark):
    deep = "[" * 3000 + '{"token":"x"}' + "]" * 3000
    cases = [
        (r'{"a":"\ud800","token":"x" , "n":1e400,"a":[ 1.50,-0 ]}', r'{"a":"\ud800","token":"[REDACTED]" , "n":1e400,"a":[ 1.50,-0 ]}'),
        (deep, deep.replace('"x"', '"[REDACTED]"')),
        ('{"v":" abc.def.ghi"}', '{"v":"[REDACTED]"}'),
        ('{"token":1e400}', '{"token":"[REDACTED]"}'),
        ('{"token":' + "[" * 500 + "]" * 500 + ',"b":1}', '{"token":"[REDACTED]","b":1}'),
        ('{"token":{"open":', '{"token":"[REDACTED]"'),
        ("not json", "not json"), ("", ""), (None, None), ('{"to\x01ken":"abc.def.ghi"}', '{"to\x01ken":"abc.def.ghi"}'),
        ('{"k":"' + "\\\\" * 20000 + '\\"","password":"p"}', '{"k":"' + "\\\\" * 20000 + '\\"","password":"[REDACTED]"}'),
        ('{"a":"' + "x" * 500000 + '","ssn":null}', '{"a":"' + "x" * 500000 + '","ssn":"[REDACTED]"}'),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "id int, input_json string")
    got = {r.id: r.input_json for r in redact(df, keys="agent").collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, i


def test_no_python_unless_a_rule_is_given(spark):
    df = spark.createDataFrame([("[]", "{}")], "input_json string, output_json string")
    plan = lambda d: d._jdf.queryExecution().toString()
    assert "Python" not in plan(redact(df, keys="agent", bare_strings=True)) and "Python" in plan(redact(df, rule=lambda k, v: v))


def test_custom_rule_survives_odd_texts(spark):
    one = custom_redaction(lambda k, v: "[REDACTED]" if k == "x" else v)
    assert one(r'{"a":"\ud800","x":1,"n":1e400,"m":1.50}') == (r'{"a":"\ud800","x":"[REDACTED]","n":1e400,"m":1.50}', [{"key": "x", "rule": "custom"}])
    assert one("no json") == ("no json", []) and one('{"y":"\\ud800"}') == ('{"y":"\\ud800"}', [])
    assert one("[" * 200000 + "]" * 200000)[0] == '"[REDACTED]"'
    df = spark.createDataFrame([(r'[{"\ud800x":"\ud800","x":"\udfff"}]',), (None,)], "input_json string")
    got = redact(df, rule=lambda k, v: "[REDACTED]" if "x" in k else v).select("input_json", F.size("redactions").alias("n")).collect()
    assert [tuple(r) for r in got] == [(r'[{"\ud800x":"[REDACTED]","x":"[REDACTED]"}]', 2), (None, 0)]


def test_payload_text_is_the_plain_one(spark, tmp_path):
    """Words and settings of odd texts, as splitting and cleaning word by word gives them."""
    from spanlens.plans import payload_queries as P

    texts = ["", " a  b\t\r\nc ", "\n", 'k="v"x = "y" é=  "no" ké="z"', 'a_1\x0b=\n"q\tr\u00e9\U0001f600" b="', '"x"="y"="z"', "ti\x01\x0b\x7f\\[]{}é\u2003\U0001f600!",
             "a=b \"c\"", 'token="t" note="abc.def.ghi" card="4532 0151 1283 0366" abc.def.ghi', "password = \"\"", 'a="1"b="2"c="3"', "=\"x\"", 'x==="y"']
    rows = [(3 * i + j, t) for i, t in enumerate(texts) for j in (0, 1)] + [(1000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    clean = lambda v: re.sub(r"[^ !#-\[\]-~]", " ", v)
    assign = re.compile(r'(\w+)\s*=\s*"([^"]*)"', re.ASCII)
    hidden = lambda v: "[REDACTED]" if any(p.fullmatch(v.strip(SPACE)) for p in (JWT, CARD)) else v
    got = {r.doc_id: r.redacted for r in P.q_redacted_text(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) - 1
    for i, t in rows[:-1]:
        settings = ",".join('{"' + k + '" : "' + ("[REDACTED]" if k.lower() in HUB_KEYS else hidden(clean(v))) + '"}' for k, v in assign.findall(t))
        words = ", ".join('"' + hidden(clean(w)) + '"' for w in re.split(r"[ \t\n\r]+", t))
        middle = ',"Secret": "[REDACTED]","n":1.50' if i % 3 == 0 else ',"n":-0'
        assert got[i] == '[{"doc_id": ' + str(i) + ', "settings":[' + settings + "]" + middle + ',"words":[' + words + "]}]", t
    made = {r.doc_id: json.loads(r.input_json)[0] for r in P.doc_payloads(spark, str(tmp_path)).collect()}
    assert made[1000] == {"doc_id": 1000}
    assert all(made[i]["settings"] == [{k: v} for k, v in assign.findall(t)] for i, t in rows[:-1])


def test_long_strings_take_time_by_their_length(spark, tmp_path):
    """One long word, one long string beyond ASCII and one of brackets: every character is looked at a bounded number of times."""
    from spanlens.plans import payload_queries as P

    n = 300000
    spark.createDataFrame([(3, "a" * n), (4, "a" * n + '="v"')], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.createDataFrame([(0, '["' + "é" * n + '"]'), (1, '{"token":{"a":"' + "[" * n + '"},"b":["]"],"c":["' + "}" * n + '"]}')], "id int, input_json string")
    start = time.time()
    assert {r.doc_id: r.n for r in P.doc_payloads(spark, str(tmp_path)).selectExpr("doc_id", "length(input_json) n").collect()} == {3: n + 41, 4: n + n + 55}
    got = {r.id: r.input_json for r in redact(df, keys="hub").collect()}
    assert got == {0: '["' + "é" * n + '"]', 1: '{"token":"[REDACTED]","b":["]"],"c":["' + "}" * n + '"]}'}
    assert time.time() - start < 60


def test_no_keys_and_empty_keys(spark):
    df = spark.createDataFrame([('{"":{"a":1},"b":["abc.def.ghi"],"c":"abc.def.ghi"}',)], "input_json string")
    assert redact(df, keys=[], values=True).first().input_json == '{"":{"a":1},"b":["abc.def.ghi"],"c":"[REDACTED]"}'
    assert redact(df, keys=["", "B"]).first().input_json == '{"":"[REDACTED]","b":"[REDACTED]","c":"abc.def.ghi"}'
