"""Packing documents into sequences: cutting-stock column generation over a histogram of piece lengths."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: What is left of a document after whole sequences is cut at its last multiple of this: a long piece of few possible
#: lengths and a short one that fills gaps.
UNIT = 128
#: Short pieces are counted in classes of this many tokens, rounded up: at most UNIT / GRAIN of them.
GRAIN = 2
#: Documents of one length are ranked in this many hash buckets, so that a length that very many share needs no one task.
BUCKETS = 256
#: Words whose ids a worker keeps (some 70 MB); then it starts anew.
_KEPT = 300_000
_GAP = re.compile(r"(?<=\S) (?=\S)")
_WIDE = re.compile(r"\s\s")
_ENDS = ".,;:!?"


class ByteBpe(dict):
    """Ids of texts by the ``tokenizers`` file's vocabulary, as little-endian 32-bit strings.

    The pre-tokenizer never joins characters over a single space between two that are not white space (the space goes to
    what follows). So the parts between such spaces are encoded each for itself, by the same ranks, and kept while a
    worker lives. A text with a special token's string is left to ``tokenizers`` itself.
    """

    def __init__(self, tokenizer: str):
        import tiktoken
        from tokenizers import Tokenizer

        import public_tokenizers

        self.whole = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(os.path.splitext(tokenizer)[0] + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ordinary, self.piece = ranks.encode_ordinary, ranks._core_bpe.encode_single_piece
        self.ends = {c: self.bytes(self.ordinary(c)) for c in _ENDS}

    @staticmethod
    def bytes(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        """Ids of a part and the space before it. Letters alone are one piece; a mark that ends a word is another."""
        if part.isalpha():
            ids = self.bytes(self.piece((" " + part).encode()))
        elif part[-1:] in self.ends and part[:-1].isalpha():
            return self[part[:-1]] + self.ends[part[-1]]
        else:
            ids = self.bytes(self.ordinary(" " + part))
        if len(self) > _KEPT:
            self.clear()
        self[part] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        plain = not (_WIDE.search(text) or text[:1].isspace() or text[-1:].isspace())
        first, *parts = text.split(" ") if plain else _GAP.split(text)
        return np.frombuffer(self.bytes(self.ordinary(first)) + b"".join(map(self.__getitem__, parts)), "<u4")


@lru_cache(1)
def byte_bpe(tokenizer: str) -> ByteBpe:
    return ByteBpe(tokenizer)


def cut(total: int, length: int, unit: int = UNIT) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, then a multiple of ``unit``, then the rest."""
    whole, long_ = total - total % length, total - total % unit
    ends = [*range(length, whole + 1, length), *([long_] if long_ > whole else []), *([total] if total > long_ else [])]
    return [(a, b - a) for a, b in zip([0, *ends], ends)]


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end: int = 1) -> DataFrame:
    """Rows (doc_id, digest, start, length, ids_crc32, doc_tokens): every document's ids and ``end``, cut into pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(tokenizer)
        for b in batches:
            out = []
            for doc, digest, text in zip(b["doc_id"], b["digest"], b["text"]):
                ids = np.append(bpe.ids(text or ""), np.uint32(end)).astype("<u4")
                out += [(doc, digest, s, n, zlib.crc32(ids[s:s + n].tobytes()), len(ids)) for s, n in cut(len(ids), length)]
            yield pd.DataFrame(out, columns=["doc_id", "digest", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("digest"), "text")
    kind = "doc_id string, digest long, start long, length long, ids_crc32 long, doc_tokens long"
    return rows.mapInPandas(run, kind).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences that each hold ``items``: (class, count) pairs."""

    items: tuple[tuple[int, int], ...]
    times: int


def _priced(values: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best value within ``room`` and how often each class is in it."""
    worth = np.zeros(room + 1)
    which = np.full(room + 1, -1)
    best_of = np.full(room + 1, -np.inf)  # the dearest class of each size
    class_of = np.full(room + 1, -1)
    for k, s in enumerate(size):
        if values[k] > best_of[s]:
            best_of[s], class_of[s] = values[k], k
    for c in range(1, room + 1):
        sums = best_of[1:c + 1] + worth[c - 1::-1] if c else []
        k = int(np.argmax(sums))
        if sums[k] > worth[c - 1]:
            worth[c], which[c] = sums[k], class_of[k + 1]
        else:
            worth[c] = worth[c - 1]
    counts, c = np.zeros(len(size), np.int64), room
    while c > 0:
        if which[c] < 0:
            c -= 1
        else:
            counts[which[c]] += 1
            c -= size[which[c]]
    return float(worth[room]), counts


def plan_patterns(need: dict[int, int], room: int, gap: float = 5e-4, rounds: int = 2000) -> list[Pattern]:
    """Patterns that hold all of ``need`` (class size -> number of pieces) in sequences of ``room``, with little padding.

    Linear program by column generation: the master's basis holds one column a class, dual prices go into the knapsack,
    its best pattern enters. It ends when no pattern improves, or when the price bound shows that the program is within
    ``gap`` of its optimum. The columns' use is rounded down and what is left, less than one sequence a column, is packed by decreasing size.
    """
    size = np.array(sorted(need, reverse=True), np.int64)
    if not len(size):
        return []
    want = np.array([need[s] for s in size], float)
    columns = np.diag(room // size).astype(float)  # each class alone, as often as it fits
    inverse = np.diag(1 / np.diag(columns))
    use = inverse @ want
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        value, pattern = _priced(price, size, room)
        if value <= 1 + 1e-9 or use.sum() * (1 - gap) <= price @ want / value:
            break
        d = inverse @ pattern
        ratio = np.where(d > 1e-9, use / np.where(d > 1e-9, d, 1), np.inf)
        leave = int(np.argmin(ratio))
        step = ratio[leave]
        inverse[leave] /= d[leave]
        rest = np.arange(len(size)) != leave
        inverse[rest] -= np.outer(d[rest], inverse[leave])
        use = np.maximum(use - step * d, 0)
        use[leave] = step
        columns[:, leave] = pattern
    out, left = [], want.astype(np.int64)
    for k in np.argsort(-use):
        count = columns[:, k].astype(np.int64)
        times = int(min([int(use[k] + 1e-9), *(left[count > 0] // count[count > 0])]))
        if times > 0:
            out.append(Pattern(tuple((int(size[c]), int(count[c])) for c in np.flatnonzero(count)), times))
            left = left - times * count
    while left.any():  # fewer than one sequence a column is left; as many sequences at once as the same items fill
        count, free = np.zeros(len(size), np.int64), room
        for c in np.flatnonzero(left):
            count[c] = min(left[c], free // size[c])
            free -= count[c] * size[c]
        times = int((left[count > 0] // count[count > 0]).min())
        out.append(Pattern(tuple((int(size[c]), int(count[c])) for c in np.flatnonzero(count)), times))
        left = left - times * count
    return out


def pack(parts: DataFrame, length: int = 2048, grain: int = GRAIN) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0) to rows (doc_id, digest, start, length, ...), a ``written`` table.

    The histogram of lengths (at most length / grain classes reach the driver) gives patterns. Pieces of a class are
    ranked: counts by (class, hash bucket) give each bucket's first rank, a window inside a bucket the rest. Each pattern
    owns a range of ranks of each of its classes, so a piece finds its sequence by arithmetic in a join with the ranges.
    """
    spark = parts.sparkSession
    size = (F.ceil(F.col("length") / grain) * grain).cast("int")
    rows = parts.withColumn("_size", size).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "digest", "start"), F.lit(BUCKETS)).cast("int"))
    by = rows.groupBy("_size", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    need = {r["_size"]: r.n for r in by.groupBy("_size").agg(F.sum("n").alias("n")).collect()}
    ranges, first_of, base = [], dict.fromkeys(need, 0), 0
    units = {s // grain: n for s, n in need.items()}
    for p in plan_patterns(units, length // grain):
        before = 0
        for unit, count in p.items:
            s = unit * grain
            ranges.append((s, first_of[s], first_of[s] + count * p.times, count, base, before))
            first_of[s] += count * p.times
            before += count
        base += p.times
    lookup = spark.createDataFrame(ranges, "_size int, _from long, _to long, _count long, _base long, _before long")
    offsets = by.withColumn("_first", F.sum("n").over(Window.partitionBy("_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = rows.join(F.broadcast(offsets.select("_size", "_bucket", F.coalesce("_first", F.lit(0)).alias("_first"))), ["_size", "_bucket"])  # classes x buckets
    ranked = ranked.withColumn("_rank", F.col("_first") + F.row_number().over(Window.partitionBy("_size", "_bucket").orderBy("doc_id", "digest", "start")) - 1)
    placed = ranked.join(F.broadcast(lookup), "_size").filter("_rank >= _from and _rank < _to")  # a few ranges a class
    at = F.col("_rank") - F.col("_from")
    placed = placed.select(*parts.columns, (F.col("_base") + F.floor(at / F.col("_count"))).cast("long").alias("sequence_id"),
                           (F.col("_before") + at % F.col("_count")).alias("_slot"))
    w = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("offset", (F.sum("length").over(w) - F.col("length")).cast("long")).drop("_slot")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = 2048, end: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece of all documents.

    Null text is empty: the document is its end id alone. Documents are told apart by doc_id and text; rows that agree in
    both are packed each for itself. No table row reaches the driver, only counts of lengths.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack(written(pieces(docs, tokenizer, length, end), "pieces"), length).drop("digest")


def padding(packed: DataFrame, length: int = 2048) -> DataFrame:
    """One row: sequences, tokens, and padding up to ``length`` (none for a sequence whose size is a power of two)."""
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.bit_count("n") == 1, 0).otherwise(length - F.col("n"))
    return per.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(pad).alias("padding"))
