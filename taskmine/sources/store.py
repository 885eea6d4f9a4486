"""Keyed result stores: immutable batches, merged when read.

A store is a folder of numbered batch folders. Adding a batch writes only the new
rows, so the cost of an update grows with the update and not with the store; a
replayed batch overwrites its own folder, which makes streaming writes exactly
once. Readers merge to one row per key, and ``compact`` folds batches into a base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from taskmine.operators.ranking import keep_one
from taskmine.sources.folders import work_folder  # noqa: F401  (callers find it here too)

def _committed(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of the finished ``<kind>=<number>`` folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(folder)):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(path(folder))]
    numbers = [int(name.split("=")[1]) for name in names if name.startswith(f"{kind}=")]
    return sorted(n for n in numbers if fs.exists(path(f"{folder}/{kind}={n}/_SUCCESS")))


class KeyedStore:
    """One row per key; ``keep`` says whether the first or the last one counts. ``schema`` is DDL.

    Batches count in the order of their numbers, or, with ``order``, rows count in the order of
    these columns whatever batch they came in.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], keep: str = "last", order: list[str] | None = None):
        if keep not in ("first", "last"):
            raise ValueError(keep)
        self.spark, self.folder, self.keys, self.keep = spark, folder, keys, keep
        self.order = order or ["batch"]
        self.schema = StructType.fromDDL(schema)

    def add(self, rows: DataFrame, batch: int, order: list[str]) -> None:
        """Write one batch. ``order`` gives the arrival order of its rows."""
        wanted = [F.col(field.name).cast(field.dataType) for field in self.schema.fields]
        merged = self._merge(rows, order)
        merged.select(*wanted).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def read(self) -> DataFrame:
        """All stored rows, one per key; a store that was never written is empty."""
        base, batches = self._parts()
        parts = []
        if base is not None:
            whole = self.spark.read.schema(self.schema).parquet(f"{self.folder}/base={base}")
            parts.append(whole.withColumn("batch", F.lit(base)))
        if batches:
            # the batch number comes back from the folder names
            reader = self.spark.read.schema(self.schema).option("basePath", self.folder)
            parts.append(reader.parquet(*[f"{self.folder}/batch={n}" for n in batches]))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        stored = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        single = (base is not None) + len(batches) == 1
        merged = stored if single else self._merge(stored, self.order)
        return merged.select(*self.schema.fieldNames())

    def compact(self) -> None:
        """Fold everything up to the newest batch into one base.

        The base is visible only once it is complete, and covers batches up to its
        number; a late replay of such a batch is therefore ignored, not applied twice.
        """
        base, batches = self._parts()
        if not batches:
            return
        self.read().write.mode("overwrite").parquet(f"{self.folder}/base={batches[-1]}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for n in batches:
            fs.delete(path(f"{self.folder}/batch={n}"), True)
        if base is not None:
            fs.delete(path(f"{self.folder}/base={base}"), True)

    def _parts(self) -> tuple[int | None, list[int]]:
        bases = _committed(self.spark, self.folder, "base")
        base = bases[-1] if bases else None
        batches = _committed(self.spark, self.folder, "batch")
        return base, [n for n in batches if base is None or n > base]

    def _merge(self, rows: DataFrame, order: list[str]) -> DataFrame:
        return keep_one(rows, self.keys, order, self.keep)
