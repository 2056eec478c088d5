"""The text operators against plain Python on small fixtures with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from spanlens.llm import chat, lines, mixing, packing, pii, simhash, substrings, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """Random prose, copies, near copies, shared passages, null and empty values, rows that repeat, one long text."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 5))) for _ in range(300)]
    rows = []
    passage = [draw.choice(words) for _ in range(50)]
    for i in range(120):
        w = [draw.choice(words) for _ in range(draw.randint(1, 120))]
        if i % 7 == 0:
            w[len(w) // 2:len(w) // 2] = passage
        rows.append([i, " ".join(w), "en", f"s{i % 4}" if i % 3 else "s0", len(w)])
    rows += [[200 + i, rows[i][1], "en", "s1", 0] for i in range(0, 40, 2)]
    rows += [[300 + i, rows[i][1] + " Tail", "en", None, 0] for i in range(0, 20)]
    rows += [[400, None, None, None, None], [401, "", "en", "s2", 0], [402, " \n\t ", "en", "", 0], [None, "null id", "en", "s3", 0], [None, None, None, "s3", 0],
             [403, "x " * 3000, "de", "s0", 0], [404, "one two", "en", "s9", 0], [404, "one two", "en", "s9", 0], [404, "another text", "en", "s9", 0]]
    return spark.createDataFrame([tuple(r) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def widened(df):
    """Extra columns whose names the operators use themselves."""
    for c in ("size", "mix", "k", "digest", "lines", "hash", "a", "b", "turns", "_id", "_digest", "fp", "score"):
        df = df.withColumn(c, F.lit("extra"))
    return df


def test_mix_meets_targets(docs, none):
    got = mixing.mix_documents(docs).collect()
    text = {(r.doc_id, r.text, r.source) for r in docs.collect()}
    assert len(got) == docs.count() and {r.source for r in got} == {s for _, _, s in text}
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    target = mixing.reshared_targets(dict(sizes), 1.5 * sum(sizes.values()), (3, 1, 2), 2)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        assert r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    key = lambda rows: sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in rows)
    assert key(got) == key(mixing.mix_documents(docs.repartition(3)).collect())
    assert mixing.mix_documents(none).count() == 0
    copies = mixing.take_copies(widened(docs))
    assert copies.columns == widened(docs).columns and copies.count() == sum(r.copies for r in got)


def test_resharing_and_convex_flow():
    assert mixing.reshared_targets({"a": 10, "b": 100, None: 100}, 210, (3, 1, 2), 2) == {"a": 20.0, "b": pytest.approx(190 / 3), None: pytest.approx(380 / 3)}
    # the shared pattern serves b, so that a's own words need no second copy and b's are not repeated before a's
    flow = mixing.route({"a": 10, "ab": 10, "b": 10}, {"a": ["a"], "ab": ["a", "b"], "b": ["b"]}, {"a": 10, "b": 20}, 2)
    assert {p: sum(f.values()) for p, f in flow.items()} == {"a": 10, "ab": 10, "b": 10}
    flow = mixing.route({"a": 10, "ab": 10}, {"a": ["a"], "ab": ["a", "b"]}, {"a": 15, "b": 15}, 2)
    assert sum(flow["a"].values()) in range(10, 21) and sum(sum(f.values()) for f in flow.values()) == 30


def test_overlapping_sources(spark):
    rows = [(i, ["a", "b"] if i % 2 else ["a"], 10) for i in range(400)] + [(400, [], 10), (401, None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, m array<string>, n long")
    mixed, plan = mixing.mix(df, F.col("m"), F.col("n"), [F.col("doc_id")], share=1.0, weights=(1, 1))
    got = mixed.collect()
    assert plan.sources["a"][0] == 4000 and plan.sources["b"][0] == 2000
    assert sum(r.mix.taken for r in got) == pytest.approx(4000, abs=20)
    quota = collections.Counter()
    for r in got:
        quota[r.mix.quota] += r.mix.taken
    assert quota["b"] == pytest.approx(2000, rel=0.15) and all(r.mix.taken == 0 for r in got if r.doc_id >= 400)


def slow_fingerprint(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_groups(docs, none):
    rows, got = docs.collect(), simhash.simhash_report(docs).collect()
    assert sorted((str(r.doc_id), f"{slow_fingerprint(r.text):016x}") for r in rows) == sorted((str(r.doc_id), r.fingerprint) for r in got)
    fps = sorted({int(r.fingerprint, 16) for r in got})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for r in got:
        f = find(int(r.fingerprint, 16))
        least[f] = min([x for x in (least.get(f), r.doc_id) if x is not None], default=None)
    assert all(r.component_id == least[find(int(r.fingerprint, 16))] for r in got)
    kept = simhash.keep_one_of_group(widened(docs))
    assert kept.columns == widened(docs).columns
    assert kept.count() == len({find(int(r.fingerprint, 16)) for r in got})
    assert simhash.simhash_report(none).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_anchors_cover_all_links(bits):
    to, draw = simhash.anchors(bits), random.Random(bits)
    for _ in range(60):
        x = draw.getrandbits(64)
        home, y = to.home(x), x
        assert sum(((home >> s & simhash._MASK) ^ (x >> o & simhash._MASK)).bit_count() <= 3 for s, o in ((23, 0), (0, 23))) == 2
        for b in draw.sample(range(64), bits):
            y ^= 1 << b
        visits = to.visits(y).tolist()
        assert home in visits and len(set(visits)) == len(visits)


def test_simhash_links_all_pairs_once(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(30)]
    near = {b ^ sum(1 << i for i in draw.sample(range(64), draw.randint(0, 4))) for b in base for _ in range(12)}
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_simhash_visits_never_pass_the_driver(spark):
    """Spark takes visits for as many rows as fingerprints, so few fingerprints would have them broadcast."""
    links = simhash.links(spark.range(40).select(F.col("id").alias("fp")), 2)
    assert links.count() and links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_toxicity_held_out(spark, none):
    draw = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        w = [draw.choice(["the", "a", "house", "tree", "runs", "sees", "blue"]) for _ in range(draw.randint(3, 40))]
        bad = i % 5 == 0
        if bad:
            w[draw.randrange(len(w))] = draw.choice(["scum", "moron"])
        rows.append((i, " ".join(w), None, None, None))
        labels.append((i, None, int(bad)))
    rows += [(None, "scum moron", None, None, None), (2000, None, None, None, None), (2001, "", None, None, None), (1, rows[1][1], None, None, None)]
    labels += [(None, 1, 1), (7, None, None), (9999, 1, 1), (5, 0, 0)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    out = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in out]) > 0.97
    assert next(r for r in got if r.doc_id is None).predicted == 1
    kept = toxicity.drop_toxic(widened(docs), labels)
    assert kept.columns == widened(docs).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r.doc_id, r.score) for r in toxicity.toxicity(docs, flipped).collect()} == {(r.doc_id, r.score) for r in got}
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    hard = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", hard), (-7, 1, "assistant", hard), (1, 1, "assistant", "\\l\\b<turn>\n"), (1, 0, "us\ner", None), (1, None, "system", "日本"),
            (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "assistant", ""), (3, 0, "assistant", "a" * 200_000), (3, 1, "assistant", "</turn>\n")]
    got = {r.conv_id: r for r in chat.formatted_digests(spark.createDataFrame(rows, CONVERSATIONS)).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = sorted(turns, key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars > len(said)
    assert chat.formatted_digests(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_chat_layouts(spark):
    records = [
        ('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', [("user", "q"), ("assistant", "a")]),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}],"system":"s","id":7}', [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ('{"instruction":"i","input":"x","output":"o"}', [("user", "i\n\nx"), ("assistant", "o")]),
        ('{"instruction":"i","output":"o"}', [("user", "i"), ("assistant", "o")]),
        ('{"prompt":"p","completion":"c"}', [("user", "p"), ("assistant", "c")]),
        ('{"prompt":"p","response":null}', None), ('{"text":"free"}', None), ("not json", None), (None, None),
        ('{"turns":[{"role":null,"text":"t"},{"role":"user","text":null}]}', [("", "t"), ("user", "")]),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(records)], "id int, record string")
    rows = chat.canonical_turns(df.withColumn("record", chat.from_json_text(F.col("record"))), "record").orderBy("id").collect()
    assert [r.turns and [tuple(t) for t in r.turns] for r in rows] == [t for _, t in records]
    assert rows[2].fingerprint != rows[3].fingerprint and rows[6].fingerprint == rows[7].fingerprint


def slow_recurring(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


def test_recurring_windows(spark, docs, none):
    draw = random.Random(9)
    few = [(1000 + i, " ".join(draw.choice("abc") for _ in range(draw.randint(0, 300))), None, None, None) for i in range(15)]
    more = docs.union(spark.createDataFrame(few + [(1100, "y " * 35, None, None, None), (1101, "z " * 36, None, None, None)], DOCS))
    rows = more.collect()
    got = substrings.substring_report(widened(more)).collect()
    want = collections.Counter((r.doc_id, *x) for r, x in zip(rows, slow_recurring([r.text for r in rows], 35)))
    assert collections.Counter(tuple(r) for r in got) == want and sum(r.n_removed for r in got) > 1000
    assert substrings.substring_report(none).count() == 0


def test_runs_of_one_phrase_that_agree_in_half_their_hash(spark):
    """Two different runs around one phrase whose hashes agree in their upper 32 bits; neither recurs."""
    phrase = (39, 976, 562, 195, 36, 933, 357, 275, 872, 416, 407, 527)
    ends = [((811, 783, 315, 466, 115, 810, 238, 519, 41, 267, 744, 884), (647, 381, 164, 333, 864, 834, 534, 219, 487, 396, 288)),
            ((803, 500, 870, 873, 472, 318, 495, 916, 784, 519, 336, 604), (501, 959, 892, 130, 803, 227, 782, 337, 152, 531, 89))]
    texts = [" ".join(f"w{i}" for i in (*a, *phrase, *b)) for a, b in ends]
    (g, r, _, _), (g2, r2, _, _) = (substrings.Words(t).runs(35) for t in texts)
    assert g == g2 and r != r2 and r >> np.uint64(32) == r2 >> np.uint64(32)
    rows = [(i, t, None, None, None) for i, t in enumerate([*texts, "tail " + texts[1] + " q" * 3])]
    for n, gone in ((2, [0, 0]), (3, [0, 35, 35])):
        got = {r.doc_id: r.n_removed for r in substrings.substring_report(spark.createDataFrame(rows[:n], DOCS)).collect()}
        assert [got[i] for i in range(n)] == gone


def slow_lines(rows, run=3):
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    counted = {i: [(j, x) for j, x in enumerate((rows[i][1] or "").split("\n")) if re.search(lines.INK, x)] for i in order}
    seen, out = set(), {}
    for i in order:
        gone, c = set(), counted[i]
        for s in range(len(c) - run + 1):
            key = tuple(x for _, x in c[s:s + run])
            gone |= set(range(s, s + run)) if key in seen else set()
            seen.add(key)
        drop = {c[s][0] for s in gone}
        out[rows[i][0]] = (len(c), len(gone), None if rows[i][1] is None else "\n".join(x for j, x in enumerate(rows[i][1].split("\n")) if j not in drop))
    return out


def test_line_runs(spark, none):
    draw = random.Random(2)
    block = ["License", "All rights", "Granted to", "No warranty"]
    rows = []
    for i in range(60):
        x = [draw.choice(["a", "b", "c", "", " ", "line %d" % draw.randint(0, 40)]) for _ in range(draw.randint(0, 30))]
        if i % 4 == 0:
            x[len(x) // 2:len(x) // 2] = block
        rows.append((i, "\n".join(x), "en", None, 0))
    rows += [(100, None, None, None, None), (101, "", None, None, None), (102, "\n\n\n", None, None, None), (103, "r\n" * 2000, None, None, None)]
    df = widened(spark.createDataFrame(rows, DOCS))
    out = lines.drop_repeated_lines(df)
    assert out.columns[:-1] == df.columns and out.columns[-1] == "lines_"
    got = {r.doc_id: (r.lines_.n_lines, r.lines_.n_removed, r.text) for r in out.collect()}
    assert got == slow_lines(rows) and got[103][1] == 1999
    assert lines.drop_repeated_lines(none).count() == 0
    twins = spark.createDataFrame([(1, "a\nb\nc", None, None, None)] * 2 + [(None, "a\nb\nc", None, None, None), (None, "q", None, None, None)], DOCS)
    assert collections.Counter(r.lines.n_removed for r in lines.drop_repeated_lines(twins).collect()) == {3: 2, 0: 2}


def test_long_passages_of_one_or_two_lines(spark):
    draw = random.Random(8)
    prose = lambda n: " ".join(draw.choice("abcdefgh") * draw.randint(1, 9) for _ in range(n))
    one, half, rest, few = prose(51), prose(30), prose(21), prose(50)
    rows = [(0, one), (1, f"x\n{one}\ny"), (2, f"{half}\n\n{rest}"), (3, f"p\n{half}\n{rest}\nq"), (4, few), (5, few), (6, f"{half}\nother"),
            (7, f"{one}\n{one}"), (8, "a\nb\nc"), (9, "a\nb\nc"), (10, None), (11, "")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = {r.doc_id: (r.lines.n_lines, r.lines.n_removed, r.text) for r in lines.drop_repeated_lines(df, words=50).collect()}
    assert got == {0: (1, 0, one), 1: (3, 1, "x\ny"), 2: (2, 0, rows[2][1]), 3: (4, 2, "p\nq"), 4: (1, 0, few), 5: (1, 0, few), 6: (2, 0, rows[6][1]),
                   7: (2, 2, ""), 8: (3, 0, rows[8][1]), 9: (3, 3, ""), 10: (0, 0, None), 11: (0, 0, "")}
    stage = corpus_pipeline.line_dedup(spark, df, "")
    assert {r.doc_id: (r.text, r.n_chars) for r in stage.collect()} == {i: (t, None if t is None else len(t)) for i, (_, _, t) in got.items()}


def test_packing_round_trip(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(widened(docs), length=256).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 1]
        for s, n in packing.cut(len(ids), 256):
            want[r.doc_id, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(by) * 256 - total < 0.03 * total
    assert packing.pack_documents(none).count() == 0


def test_tokenizer_parts():
    import public_tokenizers

    bpe, draw = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)
    odd = ["a", "Ab", " ", "\n", "'s", "12", "!", "é", "日", " ", "\x1c", "\t", "  ", "<|endoftext|>", ".", ", "]
    for _ in range(1500):
        t = "".join(draw.choice(odd) for _ in range(draw.randint(0, 15)))
        assert bpe.ids(t).tolist() == bpe.whole.encode(t, add_special_tokens=False).ids, t


def test_patterns_hold_what_is_needed():
    draw = random.Random(6)
    for need in ({}, {5: 3}, {64: 7}, {s: draw.randint(1, 50) for s in draw.sample(range(1, 65), 30)}, {33: 100, 31: 1}):
        got = collections.Counter()
        for p in packing.plan_patterns(need, 64):
            assert sum(s * n for s, n in p.items) <= 64 and p.times > 0
            for s, n in p.items:
                got[s] += n * p.times
        assert got == need


BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_spans(t):
    out = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans():
    draw = random.Random(3)
    for _ in range(5000):
        t = "".join(draw.choice(["a", "b.", "@", ".", "1", "23", "255", "+", " ", "-", "4532015112830366", "(", ")", "Z", "0", "\n", "é"]) for _ in range(draw.randint(1, 40)))
        assert slow_spans(t) == sorted(pii.base_spans(t)), t


@pytest.mark.parametrize("text, kind, found", [
    ("mail john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
    ("to jane at example dot org.", "email", "jane at example dot org"),
    ("x jоhn@exаmple.com y", "email", "jоhn@exаmple.com"),
    ("jo​hn@exam​ple.com", "email", "jo​hn@exam​ple.com"),
    ("foo[at]bar[dot]com", "email", "foo[at]bar[dot]com"),
    ("plus one four one five five five five two six seven one.", "phone", "plus one four one five five five five two six seven one"),
    ("host 192 dot 168 dot 0 dot 1 up", "ip", "192 dot 168 dot 0 dot 1"),
    ("１９２.１６８.１.１", "ip", "１９２.１６８.１.１"),
    ("4532 0151 1283 ０３６６", "card", "4532 0151 1283 ０３６６"),
])
def test_pii_disguises(text, kind, found):
    base, added = pii.all_spans(text)
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in added if (s, k, e) not in base] == [(kind, found)]


@pytest.mark.parametrize("text, kind, rest, found", [
    ("x jоhn@example.com y", "email", "hn@example.com", "jоhn@example.com"),
    ("x јohn@example.com y", "email", "ohn@example.com", "јohn@example.com"),
    ("x jo\u200bhn@example.com y", "email", "hn@example.com", "jo\u200bhn@example.com"),
    ("x john@mail.exаmple.com y", "email", "john@mail.ex", "john@mail.exаmple.com"),
    ("to john@mail.example dot com now", "email", "john@mail.example", "john@mail.example dot com"),
    ("host 10.0.0.1２ up", "ip", "10.0.0.1", "10.0.0.1２"),
    ("host １0.0.0.1 up", "ip", "0.0.0.1", "１0.0.0.1"),
])
def test_pii_disguised_on_one_side(text, kind, rest, found):
    base, added = pii.all_spans(text)
    said = [[(pii.KINDS[k], text[s:e]) for s, k, e in spans] for spans in (base, added)]
    assert said == [[(kind, rest)], [(kind, found)]]
    assert pii.mask_pii(text) == text.replace(found, f"[{kind}]")


def test_mask_covers_the_union():
    assert pii.mask_pii("a@b.co dot uk, c@d.eu") == "[email], [email]"
    text = "at 10.0.0.4 532 0151 1283 0366 now"
    assert [pii.KINDS[k] for _, k, _ in pii.base_spans(text)] == ["ip", "card"] and pii.mask_pii(text) == "at [ip] now"


def test_pii_report(spark, docs, none):
    texts = ["a@b.co and 10.0.0.1", None, "", "meet at noon, dot the i, one two three", "a@b.co " * 20_000, "1" * 300_000 + "a" * 300_000]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None)], DOCS)
    got = {r.doc_id: r for r in pii.pii_report(widened(df)).collect()}
    for i, t in [*enumerate(texts), (None, texts[0])]:
        spans = slow_spans(t or "") if i != 5 else []
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[i].spans == said and got[i].n_email == sum(k == 0 for _, k, _ in spans)
    assert pii.pii_report(none).count() == 0 and pii.pii_report(docs).count() == docs.count()
    assert pii.mask_pii("to a@b.co!") == "to [email]!" and pii.mask_pii(None) is None


def test_disguised_identifiers_in_mixed_forms():
    for text, want in (("john at example.com", [(0, 0, 19)]), ("192.168.0 dot 1", [(0, 1, 15)]), ("pay 4532 0151 1283 036 six now", [(4, 2, 26)]),
                       ("\U0001d423\U0001d428\U0001d421\U0001d427@example.com", [(0, 0, 16)]), ("look at this one", []), ("one or 2", [])):
        base, added = pii.all_spans(text)
        assert added == [s for s in want if s not in base], text


def test_spelled_digits_are_read_in_linear_time():
    import time

    for text in ("1 " * 500_000 + "x one", "one " * 250_000, "1 1 12 " * 150_000 + "two", "1.2 dot " * 120_000, "john at " * 140_000):
        start = time.process_time()
        pii.all_spans(text)
        assert time.process_time() - start < 12
