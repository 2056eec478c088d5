"""SimHash near-dedup by anchor-point covering with a product of two perfect Golay codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, free_name, written

#: The binary Golay code [23, 12], with 2^12 codewords; every 23-bit word is within 3 bits of just one.
GOLAY_BITS, GOLAY_DATA, GOLAY_RADIUS, GOLAY_POLYNOMIAL = 23, 12, 3, 0b101011100011
_MASK = (1 << GOLAY_BITS) - 1

#: Shingles that are hashed and added at once, so that a very long text needs no more memory.
_CHUNK = 8192


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the shingles of a text: bit b is 1 if it is set in over half the shingles' XXH64.

    A-Z is lower-cased; words are runs of anything but ASCII white space; a text of fewer words is one shingle; null and
    empty texts have fingerprint zero. Repeated shingles count as often as they occur.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined, total = b" ".join(words), len(words) - size + 1
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:total].tolist()
    ends = ends[size - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, total, _CHUNK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i:i + _CHUNK], ends[i:i + _CHUNK])], dtype=">u8")
        # sum bytes of bits in groups of 255 at most: no byte overflows, and no wide array is made
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        for j in range(0, len(bits), 255):
            ones += np.add.reduce(bits[j:j + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, digest, fp): ``digest`` tells texts of one doc_id apart; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "digest": b["digest"], "fp": fp})

    cols = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return cols.mapInPandas(run, "doc_id string, digest long, fp long").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


@lru_cache(1)
def syndromes() -> np.ndarray:
    """Syndrome (11 bits) of each 23-bit word: its remainder by the code's generator polynomial."""
    rest = np.arange(1 << GOLAY_BITS, dtype=np.uint32)
    for bit in range(GOLAY_BITS - 1, 10, -1):
        rest ^= np.where(rest >> bit & 1, np.uint32(GOLAY_POLYNOMIAL << (bit - 11)), np.uint32(0))
    return rest.astype(np.uint16)


def _patterns(reach: int) -> list[list[np.ndarray]]:
    """For each syndrome, the 23-bit error patterns of weight at most radius + e, for e from 0 to ``reach``, by excess."""
    syndrome = syndromes()
    weight = np.bitwise_count(np.arange(1 << GOLAY_BITS, dtype=np.uint32))
    near = np.flatnonzero(weight <= GOLAY_RADIUS + reach).astype(np.uint32)
    s, excess = syndrome[near], np.maximum(weight[near].astype(np.int64) - GOLAY_RADIUS, 0)
    order = np.lexsort((near, excess, s))
    near, key = near[order], s[order].astype(np.int64) * (reach + 1) + excess[order]
    cuts = np.searchsorted(key, np.arange((1 << 11) * (reach + 1) + 1))
    return [[near[cuts[k * (reach + 1) + e]:cuts[k * (reach + 1) + e + 1]] for e in range(reach + 1)] for k in range(1 << 11)]


class Anchors:
    """Codewords of Golay x Golay over 46 of the 64 bits.

    A fingerprint's home is its nearest anchor, within ``GOLAY_RADIUS`` in either half. If two fingerprints differ in at
    most ``bits`` bits, of which e1 in the first half and e2 in the second, then the second is within radius + e1 and
    radius + e2 of the first one's home. So a fingerprint visits every anchor within covering radius plus threshold:
    those whose distances exceed the radius by no more than ``bits`` over both halves together.
    """

    def __init__(self, bits: int):
        self.bits = bits
        self.syndrome = syndromes()
        self.patterns = _patterns(bits)

    def halves(self, fp: int) -> tuple[int, int]:
        return fp & _MASK, fp >> GOLAY_BITS & _MASK

    def home(self, fp: int) -> int:
        a, b = self.halves(fp)
        (x,), (y,) = self.patterns[self.syndrome[a]][0], self.patterns[self.syndrome[b]][0]
        return int(a ^ x) << GOLAY_BITS | int(b ^ y)

    def visits(self, fp: int) -> np.ndarray:
        a, b = self.halves(fp)
        pa, pb = self.patterns[self.syndrome[a]], self.patterns[self.syndrome[b]]
        low = [np.concatenate(pb[:e + 1]) ^ np.uint32(b) for e in range(self.bits + 1)]
        return np.concatenate([((np.repeat(p.astype(np.uint64) ^ np.uint64(a), len(low[self.bits - e])) << np.uint64(GOLAY_BITS))
                                | np.tile(low[self.bits - e].astype(np.uint64), len(p))) for e, p in enumerate(pa)]).view(np.int64)


@lru_cache(2)
def anchors(bits: int) -> Anchors:
    return Anchors(bits)


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a, b), a < b as signed longs, of distinct fingerprints that differ in at most ``bits`` bits; each pair once.

    Each fingerprint is at home at one anchor and visits all anchors within covering radius plus threshold; homes meet
    visitors per anchor in a join that adaptive execution can split. The pair meets at the home of its smaller end.
    Spark takes the visits for as many rows as fingerprints (they are some 61 times as many at 2 bits) and would send
    them through the driver where the fingerprints alone are below the broadcast limit, so the join is a sort-merge join.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = anchors(bits)
        for batch in batches:
            for i in range(0, len(batch), 2000):
                fp = batch["fp"].to_numpy()[i:i + 2000]
                at = [to.visits(x & (1 << 64) - 1) for x in fp.tolist()]
                yield pd.DataFrame({"anchor": np.concatenate(at), "fp": np.repeat(fp, [len(x) for x in at])})

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = anchors(bits)
        for batch in batches:
            yield pd.DataFrame({"anchor": [to.home(x & (1 << 64) - 1) for x in batch["fp"].tolist()], "fp": batch["fp"]})

    if not 0 <= bits <= 4:
        raise ValueError("bits must be 0 to 4: visits grow steeply beyond")
    kinds = "anchor long, fp long"
    a, b = fps.mapInPandas(homes, kinds).alias("a"), fps.mapInPandas(run, kinds).hint("merge").alias("b")
    apart = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    return a.join(b, (F.col("a.anchor") == F.col("b.anchor")) & (F.col("a.fp") < F.col("b.fp")) & (apart <= bits)).select(
        F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def simhash_groups(docs: DataFrame, shingle: int = 3, bits: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, digest, fp, root, component_id): documents whose fingerprints link, over any number of steps.

    Fingerprints are equal (also zero, of texts without words) or link at ``bits`` or fewer differing bits.
    ``root`` tells groups apart, component_id is the smallest doc_id in one. Null doc_ids are the largest. Rows that agree in doc_id and text come
    back as often as they are there. Only distinct fingerprints are compared, and no document reaches the driver.
    """
    seen = written(fingerprints(docs, shingle, seed), "simhash")
    smallest = written(seen.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fp")
    roots = components(links(smallest.select("fp"), bits))
    rooted = smallest.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return seen.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def simhash_report(docs: DataFrame, shingle: int = 3, bits: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id; see ``simhash_groups``."""
    return simhash_groups(docs, shingle, bits, seed).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_group(docs: DataFrame, shingle: int = 3, bits: int = 2, seed: int = 42) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest (doc_id with null last, digest of the text).

    Rows that agree in doc_id and text are one document: one row of them stays, any other columns from one of the rows.
    """
    rows = simhash_groups(docs, shingle, bits, seed).select("root", F.struct(F.col("doc_id").isNull(), "doc_id", "digest").alias("at"))
    best = rows.groupBy("root").agg(F.min("at").alias("at"))
    id_, digest, nth = (free_name(docs, c) for c in ("_of_id", "_of_digest", "_nth"))
    best = best.select(F.col("at.doc_id").alias(id_), F.col("at.digest").alias(digest))
    kept = docs.join(best, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(digest)), "left_semi")
    w = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    return kept.withColumn(nth, F.row_number().over(w)).filter(F.col(nth) == 1).drop(nth)
