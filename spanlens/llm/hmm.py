"""Language-model scores: a hidden Markov model trained by Baum-Welch counts that Spark adds up over partitions.

The model's alphabet is bounded: words that make up at least one part in ``HEAD`` of the training tokens (at most ``HEAD`` of
them, whatever the corpus), the end of a text, and ``TAILS`` classes of all other words by their last bytes. A state emits a
symbol of that alphabet; a class then emits one of its words by the words' counts, the same in every state. Word counts cover all
training tokens and stay in Spark: what a text's rarer words add is joined by word, so no vocabulary is ever sent whole.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A word is a symbol of its own from one part in this many of all training tokens on: at most this many words.
HEAD = 1 << 17
#: Classes of all other words.
TAILS = 1024
#: Training sequences end here; a longer text is trained as several, of which the later ones have their own first state.
PIECE = 256
#: Sequences that are worked on at once.
TOGETHER = 1024
#: Expected counts are added up as integers of this unit, so that their order does not matter.
UNIT = 1 << 16


@dataclass(frozen=True)
class Hmm:
    """Settings: hidden states, rounds of Baum-Welch, weight of the prior in words a state, seed of the first guess."""

    states: int = 8
    rounds: int = 7
    prior: float = 50.0
    seed: int = 42


def tokens(raw: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased: ``bytes`` methods know ASCII only, as the contract wants it."""
    return (raw or b"").lower().split()


def tail_class(word: bytes) -> int:
    """The class of a rare word: by its last three bytes, which carry inflection and punctuation."""
    return zlib.crc32(word[-3:]) % TAILS


def held_out(doc_id: Column) -> Column:
    """Rows that training leaves out; a null id counts as an empty text (remainder 0: training)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, tail int, c long) of all training tokens; the end of a text is the row with a null word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            for a in range(0, len(words), 50_000):
                part = words[a:a + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(part, pa.binary()), pa.array([-1 if w is None else tail_class(w) for w in part], pa.int32()),
                    pa.array([seen[w] for w in part], pa.int64())], ["word", "tail", "c"])
            seen.clear()

        for batch in batches:
            for raw in batch.column("raw"):
                seen.update(tokens(raw.as_py()))
                seen[None] += 1
                if len(seen) > 400_000:
                    yield from flush()
        yield from flush()

    rows = docs.where(~F.col("held")).select("raw").mapInArrow(count, "word binary, tail int, c long")
    return rows.groupBy("word", "tail").agg(F.sum("c").alias("c"))


def coded(docs: DataFrame, head: list[bytes], counts: np.ndarray) -> DataFrame:
    """Each text as symbols of the alphabet: little-endian int32 ``symbols``, its number of tokens and its rare words.

    Symbol 0 is the end, 1 to H the words of ``head``, then the classes. ``rare`` holds each rare word once, with its number of
    occurrences; ``logs`` is the sum of log10(c + 1) over the ``n_head`` tokens that are ends or frequent words of training.
    """
    env = docs.sparkSession.sparkContext.broadcast((head, np.log10(counts + 1.0), int(counts[0] > 0)))
    first_tail = len(head) + 1

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, logs, ends_known = env.value
        ids = {w: i + 1 for i, w in enumerate(words_of)}
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                symbols, sizes, known, sums, starts, words, times = [], [], [], [], [0], [], []
                for raw in batch.column("raw"):
                    found = tokens(raw.as_py())
                    s = np.zeros(len(found) + 1, "<i4")
                    s[:-1] = np.fromiter(map(ids.get, found, itertools.repeat(-1)), np.int32, len(found))
                    at = np.flatnonzero(s < 0)
                    rare = [found[i] for i in at]
                    counted = Counter(rare)
                    tail = {w: first_tail + tail_class(w) for w in counted}
                    s[at] = [tail[w] for w in rare]
                    in_head = s[s < first_tail]
                    symbols.append(s.tobytes())
                    sizes.append(len(s))
                    known.append(len(in_head) - 1 + ends_known)
                    sums.append(float(logs[in_head].sum()))
                    words += counted
                    times += counted.values()
                    starts.append(len(words))
                rare_words = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "n"]))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("held"), pa.array(symbols, pa.binary()), pa.array(sizes, pa.int64()),
                    pa.array(known, pa.int64()), pa.array(sums, pa.float64()), rare_words],
                    ["doc_id", "held", "symbols", "n_tokens", "n_head", "logs", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(code, f"doc_id {kind}, held boolean, symbols binary, n_tokens long, n_head long, logs double, "
                                 "rare array<struct<word: binary, n: long>>")


@dataclass
class Model:
    """First states of texts and of later pieces, transitions and emissions (one row a symbol)."""

    start: np.ndarray
    resume: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_guess(seen: np.ndarray, how: Hmm) -> Model:
    """A seeded start: every state emits by the counts ``seen``, tilted by symbol, and prefers to stay."""
    draw, k = np.random.default_rng(how.seed), how.states
    emit = (seen + 1.0)[:, None] * np.exp(draw.normal(0, 1.0, (len(seen), k)))
    move = np.full((k, k), 0.5 / k) + 0.5 * np.eye(k)
    return Model(np.full(k, 1 / k), np.full(k, 1 / k), move, emit / emit.sum(0))


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences, longest first, as columns of one array, and how many of them are longer than t, for each t."""
    sizes = np.array([len(r) for r in rows])
    table = np.zeros((len(rows), sizes[0]), np.int64)
    for i, r in enumerate(rows):
        table[i, :len(r)] = r
    return np.ascontiguousarray(table.T), np.searchsorted(-sizes, -np.arange(sizes[0]), "left")


def expected(rows: list[np.ndarray], begins: np.ndarray, model: Model, out: Model) -> float:
    """Adds the sequences' expected counts to ``out`` by scaled forward and backward steps; their natural log likelihood.

    ``rows`` are sorted by length, longest first. All of them take a step at once; at step t those longer than t take part.
    """
    symbols, live = padded(rows)
    steps, n = symbols.shape
    k = len(model.start)
    ones = np.ones((k, 1))
    gain = model.emit[symbols]
    ahead = np.empty((steps, n, k))
    scale = np.ones((steps, n, 1))
    a = np.where(begins[:, None], model.start, model.resume) * gain[0]
    for t in range(steps):
        m = live[t]
        if t:
            a = (ahead[t - 1, :m] @ model.move) * gain[t, :m]
        scale[t, :m] = a @ ones
        ahead[t, :m] = a / scale[t, :m]
    back = np.ones((n, k))
    for t in range(steps - 1, -1, -1):
        m = live[t]
        if t + 1 < steps and live[t + 1]:
            j = live[t + 1]
            w = gain[t + 1, :j] * back[:j] / scale[t + 1, :j]
            out.move += ahead[t, :j].T @ w
            back[:j] = w @ model.move.T
        ahead[t, :m] *= back[:m]
    use = np.arange(n)[None, :] < live[:, None]
    flat, post = symbols[use], ahead[use]
    for s in range(k):
        out.emit[:, s] += np.bincount(flat, post[:, s], len(out.emit))
    out.start += ahead[0][begins].sum(0)
    out.resume += ahead[0][~begins].sum(0)
    return float(np.log(scale).sum())


def no_counts(size: int, k: int) -> Model:
    return Model(np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((size, k)))


def partition_counts(codes: DataFrame, model: Model) -> DataFrame:
    """One partition's expected counts a task, added up by Spark: rows (kind, at, e0 to the last state) in parts of ``UNIT``.

    Kinds: 0 emissions by symbol, 1 transitions by state (without their own probability), 2 first states, 3 later pieces' first
    states, 4 the log likelihood and the number of tokens. A task sends each symbol it saw once, however often it saw it.
    """
    env = codes.sparkSession.sparkContext.broadcast(model)
    k = len(model.start)
    names = ["kind", "at", *(f"e{i}" for i in range(k))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = env.value
        out, gained, seen = no_counts(len(m.emit), k), 0.0, 0
        rows: list[tuple[np.ndarray, bool]] = []

        def work() -> float:
            rows.sort(key=lambda r: -len(r[0]))
            total = 0.0
            for a in range(0, len(rows), TOGETHER):
                part = rows[a:a + TOGETHER]
                total += expected([r for r, _ in part], np.array([b for _, b in part]), m, out)
            rows.clear()
            return total

        for batch in batches:
            for raw in batch.column("symbols"):
                s = np.frombuffer(raw.as_py(), "<i4")
                seen += len(s)
                for a in range(0, len(s), PIECE):
                    rows.append((s[a:a + PIECE], a == 0))
                    if len(rows) == 4 * TOGETHER:
                        gained += work()
        gained += work()
        last = np.zeros((1, k))
        last[0, :2] = gained, seen
        for kind, table in enumerate((out.emit, out.move, out.start[None], out.resume[None], last)):
            at = np.flatnonzero(table.any(1))
            part = np.rint(table[at] * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)),
                                              *(pa.array(part[:, i]) for i in range(k))], names)

    rows = codes.select("symbols").mapInArrow(count, "kind int, at int, " + ", ".join(f"e{i} long" for i in range(k)))
    return rows.groupBy("kind", "at").agg(*(F.sum(f"e{i}").alias(f"e{i}") for i in range(k)))


def trained(codes: DataFrame, seen: np.ndarray, how: Hmm) -> tuple[Model, list[float]]:
    """The model after ``how.rounds`` rounds over all training texts, and each round's mean log likelihood a token.

    Each round brings one row a symbol to the driver: at most HEAD + TAILS + 1 of them.
    """
    k, shares = how.states, (seen + 1) / (seen + 1).sum()
    model, means = first_guess(seen, how), []
    for _ in range(how.rounds):
        got = partition_counts(codes, model).toPandas().to_numpy(np.int64)
        at = [got[got[:, 0] == kind] for kind in range(5)]
        new = no_counts(len(seen), k)
        for table, rows in zip((new.emit, new.move, new.start[None], new.resume[None]), at):
            table[rows[:, 1]] = rows[:, 2:] / UNIT
        if not len(at[4]):
            break
        means.append(at[4][0, 2] / max(1, at[4][0, 3]))
        emit = new.emit + how.prior * shares[:, None]
        move = new.move * model.move + 1.0
        model = Model((new.start + 1) / (new.start + 1).sum(), (new.resume + 1) / (new.resume + 1).sum(),
                      move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model, means


def forward(rows: list[np.ndarray], model: Model) -> np.ndarray:
    """Each whole sequence's exact log10 likelihood by the scaled forward recursion; ``rows`` longest first."""
    symbols, live = padded(rows)
    total = np.zeros(len(rows))
    ones = np.ones(len(model.start))
    a = model.start * model.emit[symbols[0]]
    for t in range(len(symbols)):
        m = live[t]
        if t:
            a = (a[:m] @ model.move) * model.emit[symbols[t, :m]]
        scale = a @ ones
        total[:m] += np.log10(scale)
        a = a / scale[:, None]
    return total


def forward_scores(codes: DataFrame, model: Model, class_logs: np.ndarray) -> DataFrame:
    """(row, model): the log10 probability of a text's symbols, plus ``class_logs`` for each symbol that is a class."""
    env = codes.sparkSession.sparkContext.broadcast((model, class_logs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, logs = env.value
        first_tail = len(m.emit) - len(logs)
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                rows = [np.frombuffer(raw.as_py(), "<i4") for raw in batch.column("symbols")]
                order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
                out, i = np.zeros(len(rows)), 0
                while i < len(order):
                    part = order[i:i + max(1, min(TOGETHER, (1 << 22) // len(rows[order[i]])))]
                    out[part] = forward([rows[j] for j in part], m)
                    i += len(part)
                for j, s in enumerate(rows):
                    out[j] += logs[s[s >= first_tail] - first_tail].sum()
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], ["row", "model"])

    return codes.select("row", "symbols").mapInArrow(score, "row long, model double")


def score_texts(docs: DataFrame, how: Hmm = Hmm()) -> DataFrame:
    """Every text's log10 probability by the model and by add-one word counts, both learnt outside the held-out fold.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens that training has), train_tokens, base_score, score.
    A null text is empty: one token, the end. A null id is in training. Repeated rows are rows of their own, each scored and
    counted. Without training texts every token's base is log10(1) and the model stays at its first guess. An empty table gives
    an empty result; columns other than doc_id and text are not read. Texts of any length are scored whole, step by step.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("raw"), held_out(F.col("doc_id")).alias("held"))
    counts = written(word_counts(docs), "words")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.expr("if(word is null, c, 0)")).alias("ends")).first()
    n, v, ends = total.n or 0, total.v, total.ends or 0
    frequent = counts.where(F.col("c") * HEAD >= n)
    head = sorted((bytes(r.word), r.c) for r in frequent.where("word is not null").collect())
    tails = {r.tail: r for r in counts.where((F.col("c") * HEAD < n) & F.col("word").isNotNull()).groupBy("tail")
             .agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()}
    seen = np.array([ends, *(c for _, c in head), *(tails[t].c if t in tails else 0 for t in range(TAILS))], float)
    kinds = np.array([tails[t].v if t in tails else 0 for t in range(TAILS)], float)
    codes = written(coded(docs, [w for w, _ in head], seen[:len(head) + 1]).withColumn("row", F.monotonically_increasing_id()), "codes")
    model, _ = trained(codes.where(~F.col("held")), seen, how)
    scored = forward_scores(codes, model, -np.log10(seen[len(head) + 1:] + kinds + 1))
    rare = (codes.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counts.select("word", "c"), "word")
            .groupBy("row").agg(F.sum("n").alias("n_rare"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_logs")))
    out = (codes.select("row", "doc_id", "held", "n_tokens", "n_head", "logs").join(scored, "row").join(rare, "row", "left")
           .withColumn("all_logs", F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))))
    return out.select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("all_logs") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("model") + F.coalesce("rare_logs", F.lit(0.0))).alias("score"))
