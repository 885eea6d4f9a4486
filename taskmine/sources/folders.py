"""Where results between steps are written."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_FALLBACK: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a fresh local one only for a local session without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="taskmine-")
    return _FALLBACK[app]
