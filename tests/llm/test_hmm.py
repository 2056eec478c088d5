"""The hidden Markov language model against enumeration of all state paths and a plain re-computation on small tables."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlens.llm import hmm

DOCS = "doc_id long, text string"


def random_model(k, size, seed=3):
    draw = np.random.default_rng(seed)
    part = [draw.random((k, k)), draw.random(k), draw.random(k), draw.random((size, k))]
    return hmm.Model(part[1] / part[1].sum(), part[2] / part[2].sum(), part[0] / part[0].sum(1, keepdims=True), part[3] / part[3].sum(0))


def paths(seq, model, start):
    """(probability, states) of every state path."""
    for states in itertools.product(range(len(start)), repeat=len(seq)):
        p = start[states[0]] * model.emit[seq[0], states[0]]
        for t in range(1, len(seq)):
            p *= model.move[states[t - 1], states[t]] * model.emit[seq[t], states[t]]
        yield p, states


def test_forward_and_expected_counts_equal_enumeration():
    model, draw = random_model(3, 6), random.Random(1)
    rows = sorted(([draw.randrange(6) for _ in range(n)] for n in (1, 2, 2, 4, 5, 6)), key=lambda r: -len(r))
    begins = np.array([i % 2 == 0 for i in range(len(rows))])
    got, want = hmm.no_counts(6, 3), hmm.no_counts(6, 3)
    log = hmm.expected([np.array(r) for r in rows], begins, model, got)
    total = 0.0
    for r, b in zip(rows, begins):
        every = list(paths(r, model, model.start if b else model.resume))
        p_all = sum(p for p, _ in every)
        total += math.log(p_all)
        for p, states in every:
            (want.start if b else want.resume)[states[0]] += p / p_all
            for t, s in enumerate(states):
                want.emit[r[t], s] += p / p_all
                if t:
                    want.move[states[t - 1], s] += p / p_all
    assert log == pytest.approx(total)
    np.testing.assert_allclose(got.move * model.move, want.move, rtol=1e-9)
    for f in ("start", "resume", "emit"):
        np.testing.assert_allclose(getattr(got, f), getattr(want, f), rtol=1e-9, atol=1e-12)
    logs = hmm.forward([np.array(r) for r in rows], model)
    np.testing.assert_allclose(logs, [math.log10(sum(p for p, _ in paths(r, model, model.start))) for r in rows])


def plain(rows, how):
    """The whole rule in one process: counts, symbols, rounds over pieces one at a time, scores."""
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter()
    for words, h in zip(split, held):
        if not h:
            c.update([*(w.encode() for w in words), None])
    n, v = sum(c.values()), len(c)
    head = sorted(w for w, x in c.items() if w is not None and x * hmm.HEAD >= n)
    ids = {w: i + 1 for i, w in enumerate(head)}
    seen, kinds = np.zeros(1 + len(head) + hmm.TAILS), np.zeros(hmm.TAILS)
    for w, x in c.items():
        s = 0 if w is None else ids.get(w, 1 + len(head) + hmm.tail_class(w))
        seen[s] += x
        if s > len(head):
            kinds[s - 1 - len(head)] += 1
    symbols = [[ids.get(w.encode(), 1 + len(head) + hmm.tail_class(w.encode())) for w in words] + [0] for words in split]
    model = hmm.first_guess(seen, how)
    share = (seen + 1) / (seen + 1).sum()
    for _ in range(how.rounds):
        new = hmm.no_counts(len(seen), how.states)
        for s, h in zip(symbols, held):
            for a in range(0, 0 if h else len(s), hmm.PIECE):
                hmm.expected([np.array(s[a:a + hmm.PIECE])], np.array([a == 0]), model, new)
        emit, move = new.emit + how.prior * share[:, None], new.move * model.move + 1
        model = hmm.Model((new.start + 1) / (new.start + 1).sum(), (new.resume + 1) / (new.resume + 1).sum(),
                          move / move.sum(1, keepdims=True), emit / emit.sum(0))
    out = []
    for (i, _), words, s, h in zip(rows, split, symbols, held):
        keys = [*(w.encode() for w in words), None]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in keys)
        score = hmm.forward([np.array(s)], model)[0]
        for w, x in zip(keys, s):
            if x > len(head):
                score += math.log10((c[w] + 1) / (seen[x] + kinds[x - 1 - len(head)] + 1))
        out.append((i, h, len(keys), sum(c[w] > 0 for w in keys), n, base, score))
    return out


@pytest.fixture(scope="module")
def rows():
    """Two invented languages that do not mix, copies, null and empty values, rows that repeat, one very long text."""
    draw = random.Random(7)
    langs = [["".join(draw.choice(letters) for _ in range(draw.randint(1, 4))) for _ in range(120)] for letters in ("abcdE", "vwxyÉ")]
    out = []
    for i in range(150):
        lang = langs[i % 2]
        out.append((i, "".join(draw.choice(lang) + draw.choice([" ", " ", "\n", "\t  "]) for _ in range(draw.randint(1, 60)))))
    out += [out[3], out[3], (400, None), (401, ""), (402, " \n "), (None, "null id"), (None, None), (403, "ab CD " * 2000),
            (404, "one\x85two \xa0 three")]
    return out


def test_scores_equal_plain_rule(spark, rows, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 200)  # so that some words are rare
    how = hmm.Hmm(states=3, rounds=3, prior=5.0)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for c in ("row", "word", "held", "n", "c", "model", "raw"):
        df = df.withColumn(c, F.lit("extra"))
    got = sorted(map(tuple, hmm.score_texts(df, how).collect()), key=repr)
    want = sorted(plain(rows, how), key=repr)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], rel=1e-3, abs=0.02)


def test_held_out_texts_gain(spark, rows):
    got = [r for r in hmm.score_texts(spark.createDataFrame(rows, DOCS), hmm.Hmm(states=4, rounds=12, prior=5.0)).collect() if r.held_out]
    assert len(got) > 10 and sum(r.score for r in got) > sum(r.base_score for r in got) + 0.1 * sum(r.n_tokens for r in got)


def test_each_round_gains(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", F.col("text").cast("binary").alias("raw"), F.lit(False).alias("held"))
    seen = np.array([len(rows), *([1.0] * hmm.TAILS)])
    _, means = hmm.trained(hmm.coded(docs, [], seen[:1]), seen, hmm.Hmm(states=3, rounds=5, prior=0.0))
    assert all(b > a - 1e-6 for a, b in zip(means, means[1:])) and means[-1] > means[0]


def test_empty_and_untrained_tables(spark):
    assert hmm.score_texts(spark.createDataFrame([], DOCS)).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r, = hmm.score_texts(spark.createDataFrame([(only, "some words")], DOCS), hmm.Hmm(rounds=1)).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and r.score < 0
