"""Line dedup by winnowing over line hashes: later copies of runs of lines go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_name, let, written

#: A line counts if it holds anything but ASCII white space.
INK = r"[^\x20\x09-\x0D]"


def _windows(text: Column, run: int, words: int | None = None) -> Column:
    """Array of (s, n, h, first, key) for each window: a run of ``run`` counted lines, or fewer that hold over ``words`` words.

    ``s``: the window's first counted line; ``n``: its lines; ``h``: hash of its smallest (hash, position), its winnowing
    fingerprint (of fewer lines the hash of all); ``first``: no earlier window has the same pick; ``key``: digest of its
    whole lines.
    """
    def joined(lines: Column, s: Column, n: int) -> Column:
        return F.array_join(F.slice(lines, s + 1, n), "\n")

    def starts(lines: Column, n: int) -> Column:
        return F.when(F.size(lines) >= n, F.sequence(F.lit(0), F.size(lines) - n))

    def of(lines: Column, hashed: Column) -> Column:
        return F.transform(starts(lines, run), lambda s: F.struct(
            s.alias("s"), F.lit(run).alias("n"),
            F.array_min(F.slice(hashed, s + 1, run))["h"].alias("h"),
            ((s == 0) | (F.array_min(F.slice(hashed, F.greatest(s, F.lit(1)), run)) != F.array_min(F.slice(hashed, s + 1, run)))).alias("first"),
            F.md5(joined(lines, s, run)).alias("key")))

    def short(lines: Column, counts: Column, n: int) -> Column:
        long = F.filter(starts(lines, n), lambda s: sum((counts[s + i] for i in range(1, n)), counts[s]) > words)
        return F.transform(long, lambda s: F.struct(
            s.alias("s"), F.lit(n).alias("n"), F.xxhash64(joined(lines, s, n)).alias("h"), F.lit(True).alias("first"), F.md5(joined(lines, s, n)).alias("key")))

    def both(lines: Column, hashed: Column) -> Column:
        if words is None:
            return of(lines, hashed)
        return let(F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))), lambda counts: F.flatten(F.filter(
            F.array(of(lines, hashed), *(short(lines, counts, n) for n in range(1, run))), lambda w: w.isNotNull())))

    return let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(INK)), lambda lines: let(
        F.transform(lines, lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("p"))), lambda hashed: both(lines, hashed)))


def repeated_windows(docs: DataFrame, run: int = 3, words: int | None = None) -> DataFrame:
    """(doc_id, digest, starts): the windows (first counted line s, lines n) whose lines also run somewhere earlier.

    Winnowing: each window's smallest line hash is its fingerprint, so equal windows have equal fingerprints in equal
    places and every run of ``run`` or more equal lines shares one. Fingerprints that occur once in all documents end
    their windows' part; the rest are joined to the earliest position of the same lines. Joining a window's whole
    digest to one earliest position extends the match left and right of the fingerprint without making pairs of all
    its occurrences. Earlier: smaller (doc_id with null first, digest of the text, line).
    """
    w = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.explode(_windows(F.col("text"), run, words)).alias("w")).select(
        "doc_id", "digest", "w.*")
    w = written(w, "line-windows")
    common = w.filter("first").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    at = F.struct("doc_id", "digest", "s")
    some = w.join(common, "h", "left_semi").select("key", "n", at.alias("at"))
    first = some.groupBy("key").agg(F.min("at").alias("was"), F.max("at").alias("last")).filter("not was <=> last").select("key", "was")
    late = some.join(first, "key").filter("not at <=> was")
    return late.groupBy("at.doc_id", "at.digest").agg(F.collect_set(F.struct("at.s", "n")).alias("starts"))


def drop_repeated_lines(docs: DataFrame, run: int = 3, out: str = "lines", words: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) without the lines that later copies of runs cover.

    A run is ``run`` or more consecutive counted lines (blank lines are passed over, stay, and part no run). A line
    goes if one of the windows of ``run`` lines that cover it also starts earlier, in this or another document; the
    earliest copy stays. With ``words``, fewer lines that hold more than that many words are a window as well. Runs may overlap themselves: of a line repeated n times in a row the first stays. Rows that
    agree in doc_id and text are one document and are treated alike. Null text stays null, with no lines; empty text
    stays empty. Adds a struct column ``out`` (n_lines: counted lines, n_removed); a column of that name is kept and the
    new one, always the last, gets underscores.
    """
    name, digest, id_ = free_name(docs, out), free_name(docs, "_digest"), free_name(docs, "_id")
    late = repeated_windows(docs.select("doc_id", "text"), run, words).select(F.col("doc_id").alias(id_), F.col("digest").alias(digest), F.col("starts").alias("_starts"))
    joined = docs.withColumn(digest, F.xxhash64("text")).alias("d").join(
        late.alias("l"), F.col(f"l.{id_}").eqNullSafe(F.col("d.doc_id")) & (F.col(f"l.{digest}") == F.col(f"d.{digest}")), "left")

    def edited(lines: Column) -> Column:
        counted = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(INK), i)), lambda i: i.isNotNull())
        gone = let(counted, lambda at: F.array_distinct(F.flatten(F.transform("l._starts", lambda w: F.slice(at, w["s"] + 1, w["n"])))))
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return let(gone, lambda gone: F.struct(
            F.array_join(F.transform(stay, lambda i: lines[i]), "\n").alias("text"),
            F.size(counted).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed")))

    n_lines = F.size(F.filter(F.split("d.text", "\n", -1), lambda x: x.rlike(INK)))
    zero = F.lit(0).cast("long")
    result = F.when(F.col("l._starts").isNull(), F.struct(
        F.col("d.text").alias("text"), F.when(F.col("d.text").isNull(), zero).otherwise(n_lines.cast("long")).alias("n_lines"), zero.alias("n_removed"),
    )).otherwise(let(F.split("d.text", "\n", -1), edited))
    new = free_name(docs, "_new")
    joined = joined.withColumn(new, result)
    return joined.select(*(F.col(new)["text"].alias(c) if c == "text" else F.col(f"d.`{c}`").alias(c) for c in docs.columns),
                         F.struct(F.col(new)["n_lines"].alias("n_lines"), F.col(new)["n_removed"].alias("n_removed")).alias(name))


#: DuckDB: the same rule by plain windows over all lines, without fingerprints.
SQL = """
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents
), e AS (
  SELECT doc_id, text, unnest(a) AS line, unnest(range(len(a))) AS i FROM l
), c AS (
  SELECT doc_id, text, line, i, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS k
  FROM e WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), w AS (
  SELECT doc_id, text, k, line AS l1, lead(line) OVER o AS l2, lead(line, 2) OVER o AS l3
  FROM c WINDOW o AS (PARTITION BY doc_id, text ORDER BY k)
), f AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, k) AS nth
  FROM w WHERE l3 IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, k + d AS k FROM f, (VALUES (0), (1), (2)) v(d) WHERE nth > 1
), kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.i) AS text
  FROM e LEFT JOIN c USING (doc_id, i) LEFT JOIN g ON g.doc_id = c.doc_id AND g.k = c.k
  WHERE g.k IS NULL GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(r.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d
LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) r USING (doc_id)
"""
