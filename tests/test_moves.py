"""Wide rows move once: what the plans shuffle, and the rows they give on odd input."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from checks.views import Tables
from taskmine.operators import code_changes as cc, pull_requests as pr, specs as sp
from taskmine.sources import stages

FILE = "instance_id string, spec_order struct<seq:bigint,feature_pos:int,pr_pos:int>, version string, patch array<string>"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(frame):
    """Shuffles of the plan, before it adapts."""
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single)", plan(frame)))


@pytest.fixture
def lineitem(spark, tmp_path):
    """Line items of a few orders, one of them twice, with a null part."""
    rows = [(order, line, 11 * order + line, 6 * order + line % 3, 5.5 + line, "ANR"[(order + line) % 3])
            for order in range(12) for line in range(1, 1 + order % 5)]
    rows += rows[:3] + [(3, 9, None, 7, 1.0, None)]
    names = "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def rows_of(frame):
    return Counter(tuple(row) for row in frame.collect())


def test_written_groups_give_the_rows_of_the_view(spark, lineitem):
    plain, landed = Tables(spark, lineitem), Tables(spark, lineitem).files_landed()
    for name in ("pr_files", "file_contents"):
        assert rows_of(getattr(landed, name)) == rows_of(getattr(plain, name)) != Counter()
        assert exchanges(getattr(landed, name)) == 0 < exchanges(getattr(plain, name))


def test_dealt_rows_give_the_rows_of_the_view_and_gather_in_place(spark, lineitem):
    plain, dealt = Tables(spark, lineitem), Tables(spark, lineitem).files_dealt()
    assert rows_of(dealt.pr_files) == rows_of(plain.pr_files)
    gathered = lambda t: t.pr_files.groupBy(*pr.PR).agg(F.array_sort(F.collect_list(F.struct("pos", "patch"))).alias("files"))
    assert rows_of(gathered(dealt).select("repo", "pr_number", F.to_json("files"))) == rows_of(gathered(plain).select("repo", "pr_number", F.to_json("files")))
    assert exchanges(gathered(dealt)) == 1 < exchanges(gathered(plain))


def test_sources_are_dealt_before_their_texts_are_made(spark, tmp_path):
    """Else the one task that reads the given file holds the texts of all its rows for a shuffle."""
    rows = [(key, 20 + key % 9, f"Brand#{key % 3}") for key in range(13)] + [(4, 24, "Brand#1"), (12, None, None), (None, 30, "Brand#2")]
    spark.createDataFrame(rows, "p_partkey bigint, p_size int, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found, table = queries()["run_hints"](spark, str(tmp_path)), Tables(spark, str(tmp_path))
    above, read = re.split(r"Exchange (?=hash)", plan(found))[-2:]
    assert read.startswith("hashpartitioning(p_partkey") and "concat" not in read and "concat" in above
    pairs = table.test_sources.select("instance_id", "path", "before_src", "after_src")
    assert rows_of(found) == rows_of(cc.run_hints(cc.changed_tests(cc.code_changes(pairs))).select("path", "name", "command"))
    assert ("tests/test_8.py", "test_new", "pytest -v -k test_new tests/test_8.py") in rows_of(found)
    assert rows_of(table.sources_dealt().test_sources) == rows_of(table.test_sources)


def test_specs_move_once_and_are_not_written(spark):
    specs = spark.createDataFrame([
        ("a", (2, 0, 0), "v2", ["x"]), ("a", (1, 0, 0), "v1", ["y"]), ("a", (2, 0, 1), "v3", None),
        ("b", (5, 0, 0), "v5", []), ("b", (5, 0, 0), "v5", []), (None, (7, 0, 0), "v7", ["n"]),
    ], FILE)
    written = lambda: sum(map(len, stages._WRITTEN.values()))
    before = written()
    kept = sp.dedup_specs(specs)
    assert written() == before and exchanges(kept) == 1
    assert rows_of(kept.select("instance_id", "spec_order.seq", "version", F.to_json("patch"))).keys() >= {
        ("a", 1, "v3", None), ("b", 5, "v5", "[]")}
    assert kept.where("instance_id is not null").count() == 2


def test_analyses_move_once_and_equal_features_stay_apart(spark):
    features = spark.createDataFrame([("o/a", "v1", 0, "1", 0), ("o/a", "v1", 0, "2", 1), ("o/a", "v1", 1, "2", 0)],
                                     "repo string, tag_name string, feature_pos int, pr_number string, pr_pos int")
    one = ("o/a", "v1", 0, "new_feature", "f", 2, "text")
    enriched = spark.createDataFrame([one, one, ("o/a", "v1", 1, "new_feature", "g", 1, "other")],
                                     "repo string, tag_name string, feature_pos int, feature_type string, description string, n_prs bigint, feature_detailed_description string")
    analyses = spark.createDataFrame([("o/a", "1", ("1",)), ("o/a", "2", ("2",))], "repo string, pr_number string, pr_analysis struct<pr_number:string>")
    records = spark.createDataFrame([("o/a", "v1", 0, ("now",))], "repo string, tag_name string, release_pos int, original_analysis struct<analyzed_at:string>")
    nested = pr.nested_results(features, enriched, analyses, records)
    described = [(each["description"], [pull["pr_number"] for pull in each["pr_analyses"]]) for each in nested.first()["enhanced_new_features"]]
    assert described == [("f", ["1", "2"]), ("f", ["1", "2"]), ("g", ["2"])]
    assert "REPARTITION_BY_NUM" in plan(nested)
