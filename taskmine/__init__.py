"""Mine, label and score software-change data with Spark DataFrames."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers parse source files.

    Not needed where it is installed on them or given to ``spark-submit --py-files``.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="taskmine-"), "taskmine")
    parent, name = os.path.split(package)
    spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", parent, name))
    _SHIPPED.add(app)
