"""Stage tables: results written out where several later steps need them."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from taskmine.sources.folders import work_folder

_WRITTEN: dict[str, list[str]] = {}
_PATHS: dict[int, str] = {}  # of a table while its DataFrame lives


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back.

    Later steps start from files: nothing is computed twice, and a lost executor
    costs a re-read instead of the whole lineage. Writing is a job that runs now.
    ``drop_stages`` deletes what is no longer needed.
    """
    spark = frame.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    table = spark.read.schema(frame.schema).parquet(path)
    _PATHS[id(table)] = path
    weakref.finalize(table, _PATHS.pop, id(table), None)
    return table


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Stage tables written inside the block are deleted at its end, but for those given to the function it yields.

    What is left over when the block fails stays for ``drop_stages``.
    """
    written = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before, kept = len(written), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(_PATHS[id(table)])
        return table

    yield keep
    done = [path for path in written[before:] if path not in kept]
    written[before:] = [path for path in written[before:] if path in kept]
    _delete(spark, done)


def drop_stages(spark: SparkSession) -> int:
    """Delete the stage tables of this application, once nothing reads them any more; how many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)
