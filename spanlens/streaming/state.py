"""Keyed state of micro-batch jobs: each batch writes rows for its own keys only; a compaction now and then bounds what is read.

A state is a set of rows whose meaning is their combination by key (a minimum, a sum: associative, in any order). Batch ``id`` writes
its own rows to ``delta=id``; every ``every`` deltas they are combined with the newest ``base`` into ``base=id``, where rows that
``keep`` leaves out expire. A batch that is run again reads the same versions as the first time and writes over its own: files are
deleted only when a newer base *before the current batch* holds them. So the files of a state are bounded, whatever its age.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class KeyedState:
    """One table of state under ``root/name``. ``combine`` merges rows of equal keys and keeps the schema."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str, combine: Callable[[DataFrame], DataFrame],
                 every: int = 8):
        self.spark, self.path, self.schema, self.combine, self.every = spark, f"{root.rstrip('/')}/{name}", schema, combine, every

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, kind: str) -> list[int]:
        """Complete versions of a kind (``base`` or ``delta``), listed through the Hadoop file system."""
        jvm, path, fs = self._files()
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName().split("=")[1]) for p in names
                      if p.getName().startswith(kind + "=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def rows_before(self, batch_id: int) -> DataFrame:
        """What earlier batches wrote, not yet combined."""
        base = [v for v in self.versions("base") if v < batch_id][-1:]
        deltas = [v for v in self.versions("delta") if (base or [-1])[0] < v < batch_id]
        paths = [f"{self.path}/base={v}" for v in base] + [f"{self.path}/delta={v}" for v in deltas]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def before(self, batch_id: int) -> DataFrame:
        """The state that batch ``batch_id`` starts from."""
        return self.combine(self.rows_before(batch_id))

    def add(self, batch_id: int, rows: DataFrame) -> None:
        """The batch's own rows (combined by key already, or not)."""
        rows.write.mode("overwrite").parquet(f"{self.path}/delta={batch_id}")

    def due(self, batch_id: int) -> bool:
        """Whether ``every`` deltas have come together, this batch's included."""
        base = [v for v in self.versions("base") if v < batch_id][-1:] or [-1]
        return len([v for v in self.versions("delta") if base[0] < v <= batch_id]) >= self.every

    def compact(self, batch_id: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Combines the state up to this batch into a base of the rows that ``keep`` returns, and deletes what no batch can read any
        more, this one being run again included."""
        older = [v for v in self.versions("base") if v < batch_id]
        rows = self.before(batch_id + 1)
        (rows if keep is None else keep(rows)).write.mode("overwrite").parquet(f"{self.path}/base={batch_id}")
        if not older:
            return
        jvm, _, fs = self._files()
        gone = [f"base={v}" for v in older[:-1]] + [f"delta={v}" for v in self.versions("delta") if v <= older[-1]]
        for name in gone:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that no job reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a batch job has finished writing this folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
