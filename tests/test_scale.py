"""Hot keys: plans that combine before the shuffle, and results that stay whole."""

import random
import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from taskmine.operators import labels as lb, pull_requests as pr, releases as rel
from taskmine.operators.ranking import keep_first_but_all_without_id, keep_one

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def read_columns(frame):
    return {column for schema in re.findall(r"ReadSchema: struct<(.*?)>\s", plan(frame) + "\n")
            for column in re.findall(r"(\w+):", schema)}


@pytest.mark.parametrize("name,columns", [
    ("label_rows", {"user_id", "event_id", "event_type"}),
    ("version_extract", {"o_orderkey"}),
    ("repo_has_tests", {"p_partkey"}),
    ("agent_tokens", {"event_id"}),
    ("code_normalize", {"doc_id", "text"}),
    ("repos_todo", {"c_custkey", "c_acctbal", "c_mktsegment"}),
])
def test_scans_read_only_what_is_needed(spark, name, columns):
    assert read_columns(queries()[name](spark, SF)) == columns


def logs(spark, rows):
    return spark.createDataFrame(rows, "instance_id string, phase string, log string")


def test_labels_combine_before_both_shuffles(spark):
    text = plan(lb.labels_of_runs(logs(spark, [("i", "pre", ""), ("i", "post", "")])))
    assert text.count("partial_max") >= 4 and "SortAggregate" not in text and "Window" not in text


@pytest.mark.parametrize("keep", ["first", "last"])
def test_keep_one_limits_before_the_shuffle(spark, keep):
    frame = spark.createDataFrame([("k", 1)], "k string, v int")
    text = plan(keep_one(frame, ["k"], ["v"], keep))
    assert text.index("Partial") > text.index("Exchange")  # below the exchange, that is before it


def test_rows_without_id_are_not_shuffled(spark):
    frame = spark.createDataFrame([(None, 1), ("", 2), ("a", 3), ("a", 4)], "id string, v int")
    kept = keep_first_but_all_without_id(frame, ["id"], "id", ["v"])
    assert plan(kept).count("Exchange hash") == 1
    assert sorted(r["v"] for r in kept.collect()) == [1, 2, 3]


def test_a_hot_instance_keeps_all_its_labels(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for number, size in enumerate([2000] + [40] * 50):
        statuses = {f"t.py::n{i}[{p}]": (rng.choice(["PASSED", "FAILED", "SKIPPED"]), rng.choice(["PASSED", "ERROR", "SKIPPED"]))
                    for i in range(size) for p in range(rng.randint(1, 2))}
        for side, phase in enumerate(("pre", "post")):
            rows.append((f"i{number}", phase, "\n".join(f"{status[side]} {path}" for path, status in statuses.items())))
        tests = {}
        for path, status in statuses.items():
            tests.setdefault(path.split("[")[0], []).append(status)
        for test, seen in tests.items():
            worst = ["FAILED" if {"FAILED", "ERROR"} & set(side) else "PASSED" if "PASSED" in side else "SKIPPED" for side in zip(*seen)]
            if worst[1] == "PASSED" and worst[0] != "SKIPPED":
                want.add((f"i{number}", "FAIL_TO_PASS" if worst[0] == "FAILED" else "PASS_TO_PASS", test))
    assert {tuple(r) for r in lb.labels_of_runs(logs(spark, rows)).collect()} == want


def test_a_hot_repository_keeps_its_best_releases(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 == 0 else f"r{i % 50}", i, f"v{rng.randint(0, 40)}.{rng.randint(0, 40)}") for i in range(6000)]
    frame = spark.createDataFrame(rows, "repo string, api_pos int, tag_name string").repartition(8)
    got = {(r["repo"], r["rank"]): r["api_pos"] for r in rel.top_versions(frame, 30).collect()}
    groups = {}
    for repo, at, tag in rows:
        groups.setdefault(repo, []).append(([-int(n) for n in tag[1:].split(".")], at))
    assert got == {(repo, n + 1): at for repo, group in groups.items() for n, (_, at) in enumerate(sorted(group)[:30])}


def test_a_hot_pull_request_is_judged_on_all_its_files(spark):
    files = spark.range(3000).select(
        F.lit("r").alias("repo"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 40)).alias("pr_number"),
        F.col("id").cast("int").alias("pos"), F.concat(F.when(F.col("id") % 7 == 0, "tests/test_").otherwise("src/m"), "id", F.lit(".py")).alias("filename"),
        F.lit("modified").alias("status"),
    )
    prs = files.select("repo", "pr_number").distinct().withColumns({"base_sha": F.lit("b"), "head_sha": F.lit("h"), "merged": F.lit(True)})
    landed = files.select("repo", F.col("filename").alias("path"), F.explode(F.array(F.lit("b"), F.lit("h"))).alias("ref"), "pos")
    # one single file of the hot pull request gains a definition
    source = F.when((F.col("pos") == 2997 - 6) & (F.col("ref") == "h"), "def f(): pass\ndef g(): pass").otherwise("def f(): pass")
    definitions = pr.snapshot_definitions(landed.withColumn("content", source))
    flags = {r["pr_number"]: r["eligible"] for r in pr.eligibility(files, prs, definitions).collect()}
    assert flags.pop("hot") is False and len(flags) == 40 and all(flags.values())


def test_steps_that_widen_rows_are_dealt_over_all_tasks(spark):
    """Else their tasks are as few as the small rows before them need, and hold ever more as these grow."""
    from taskmine.operators import code_changes as cc

    source = "def f():\n    return 1\n"
    pairs = spark.createDataFrame([("i", f"p{k}", source, source + "\ndef g(): pass\n") for k in range(40)] * 2 + [(None, None, "", source)],
                                  "instance_id string, path string, before_src string, after_src string").coalesce(1)
    files = spark.createDataFrame([("r", str(k % 9), k, f"a{k}.py", "added", 1, 2, "+" * 20) for k in range(90)],
                                  "repo string, pr_number string, pos int, filename string, status string, additions long, deletions long, patch string").coalesce(1)
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for found, keys in ((cc.code_changes(pairs), "instance_id, path"), (pr.files_summary(files, max_files=2), "repo, pr_number")):
        plan = re.sub(r"#\d+", "", found._jdf.queryExecution().executedPlan().toString())
        assert f"hashpartitioning({keys}, {number}), REPARTITION_BY_NUM" in plan
    rows = [(r["path"], r["name"], r["change_type"]) for r in cc.code_changes(pairs).collect()]
    assert sorted(rows, key=repr) == sorted([(f"p{k}", "g", "added") for k in range(40)] + [(None, "f", "added")], key=repr)


def changes_frame(spark):
    """Forty pairs, each twice, and one without keys; each gains or loses one element."""
    from taskmine.operators import code_changes as cc

    source = "def test_f():\n    return 1\n"
    return cc, spark.createDataFrame([("i", f"p{k}", source, source + "\ndef test_g(): pass\n") for k in range(40)] * 2 + [(None, None, source, "")],
                                     "instance_id string, path string, before_src string, after_src string").coalesce(1)


def exchanges(frame):
    return re.findall(r"Exchange (.*?), \[", re.sub(r"#\d+", "", plan(frame)))


@pytest.mark.parametrize("wanted", ["changes", "hints"])
def test_elements_are_grouped_in_tasks_whose_number_is_set(spark, wanted):
    """Else Spark sizes them by compressed elements, and one task groups ever more as the input grows."""
    cc, pairs = changes_frame(spark)
    changes = cc.code_changes(pairs)
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = changes if wanted == "changes" else cc.run_hints(cc.changed_tests(changes))
    assert exchanges(found)[0] == f"hashpartitioning(instance_id, path, name, {number * cc.TASKS}), REPARTITION_BY_NUM"
    assert not [one for one in exchanges(found) if "ENSURE_REQUIREMENTS" in one]
    rows = sorted(((r["path"], r["name"], r["change_type"]) for r in found.collect()), key=repr)
    assert rows == sorted([(f"p{k}", "test_g", "added") for k in range(40)] + [(None, "test_f", "deleted")], key=repr)


def test_changed_tests_are_not_broadcast_to_the_specs(spark, tmp_path):
    """Sizes of landed files say little about how many changed tests they hold."""
    cc, pairs = changes_frame(spark)
    pairs.write.parquet(f"{tmp_path}/pairs")
    tests = cc.changed_tests(cc.code_changes(spark.read.parquet(f"{tmp_path}/pairs")))
    specs = spark.createDataFrame([("i",), ("i",), ("j",), ("j",), ("k",), (None,)], "instance_id string")
    skipped = cc.without_changed_tests(specs, tests)
    assert "Broadcast" not in plan(skipped) and "SortMergeJoin" in plan(skipped)
    assert sorted((tuple(r) for r in skipped.collect()), key=repr) == [("j", True), ("j", True), ("k", True), (None, True)]


def test_reports_are_gathered_once_in_tasks_whose_number_is_set(spark):
    cc, pairs = changes_frame(spark)
    tests = cc.changed_tests(cc.code_changes(pairs))
    found = cc.test_report(tests, ["path"], pairs)
    number = int(spark.conf.get("spark.sql.shuffle.partitions")) * cc.TASKS
    assert exchanges(found)[0] == f"hashpartitioning(path, {number}), REPARTITION_BY_NUM"
    reports = {r["path"]: r["report"] for r in found.collect()}
    assert len(reports) == 41 and all("function: test_g" in reports[f"p{k}"] for k in range(40)) and "function: test_f" in reports[None]
