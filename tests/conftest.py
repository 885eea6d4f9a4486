import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

from checks.compare import session


@pytest.fixture(scope="session")
def spark():
    spark = session("local[4]")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Values of one expression over a list of strings, in order."""
    def evaluate(make, values, type_name="string"):
        rows = [(i, value) for i, value in enumerate(values)]
        frame = spark.createDataFrame(rows, f"i int, v {type_name}")
        out = frame.select("i", make(frame["v"]).alias("r")).orderBy("i").collect()
        return [row["r"] for row in out]
    return evaluate
