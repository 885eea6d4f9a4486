"""Requests keyed by their prompts, and labels from separate, batched runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskmine import defaults as d
from taskmine.operators import labels as lb, requests as rq
from taskmine.operators.ranking import landed_once
from taskmine.plans import label


def test_answers_belong_to_their_prompt(spark):
    requests = rq.keyed(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id int, prompt string"))
    key = {r["prompt"]: r["prompt_key"] for r in requests.collect()}
    answers = spark.createDataFrame([(key["a"], "A"), (key["a"], None), (key["b"], None), ("0" * 64, "old")], "prompt_key string, response string")
    assert sorted(tuple(r) for r in rq.answered(requests, answers).collect()) == [(1, "A"), (2, None), (3, "A")]
    assert [r["prompt"] for r in rq.to_ask(requests, answers).collect()] == ["c"]
    assert [r["prompt"] for r in rq.to_ask(requests, answers.limit(0)).orderBy("prompt").collect()] == ["a", "b", "c"]  # each prompt once


def test_rows_that_landed_again(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n")], "k string, seq int, wide string")
    last = landed_once(rows, ["k"], ["seq"])
    assert "Window" not in last._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in last.collect()) == [("a", 2, "y"), ("b", 1, "z")]
    assert sorted(r["wide"] for r in landed_once(rows, ["k"], ["seq"], "first").collect()) == ["x", "z"]


def log(*lines):
    return "short test summary info\n" + "\n".join(lines)


def test_batches_are_judged_by_themselves(spark):
    """A test that fails in one batch and passes in another counts for the batch it was asked in only."""
    logs = [("i", "FAIL_TO_PASS", "pre", 0, log("FAILED t.py::a", "FAILED t.py::b")), ("i", "FAIL_TO_PASS", "post", 0, log("PASSED t.py::a", "FAILED t.py::b")),
            ("i", "FAIL_TO_PASS", "pre", 1, log("PASSED t.py::a")), ("i", "FAIL_TO_PASS", "post", 1, log("PASSED t.py::b")),
            ("i", "PASS_TO_PASS", "pre", 0, log("PASSED t.py::p", "FAILED t.py::q")), ("i", "PASS_TO_PASS", "pre", 1, log("PASSED t.py::q", "PASSED t.py::a")),
            ("i", "PASS_TO_PASS", "post", 0, log("PASSED t.py::p[1]", "FAILED t.py::p[2]")), ("i", "PASS_TO_PASS", "post", 1, log("PASSED t.py::p", "PASSED t.py::q"))]
    frame = spark.createDataFrame(logs, "instance_id string, label string, phase string, batch long, log string")
    placed = spark.createDataFrame([("i", 0, "t.py::a"), ("i", 0, "t.py::b")], "instance_id string, batch long, selector string")
    want = {("i", "FAIL_TO_PASS", "t.py::a"), ("i", "PASS_TO_PASS", "t.py::p"), ("i", "PASS_TO_PASS", "t.py::q")}
    assert {tuple(r) for r in lb.labels_of_selectors(placed, frame).collect()} == want
    # asked in every batch, b passes in the second one
    assert {tuple(r) for r in lb.labels_of_selectors(placed.drop("batch"), frame).collect()} == want | {("i", "FAIL_TO_PASS", "t.py::b")}


def test_runs_are_asked_for_and_waited_for(spark):
    selectors = spark.createDataFrame([("hot", f"t.py::test_{k}") for k in range(700)] + [("few", "t.py::test_x"), ("few", "t.py::test_x")], "instance_id string, selector string")
    folders = spark.createDataFrame([(i, "tests/") for i in ("hot", "few", "none")], "instance_id string, directory string")
    arguments = label.run_arguments(selectors, folders, max_chars=5000, batch_size=d.TESTS_PER_BATCH)
    requests = label.run_requests(arguments)
    rows = {(r["instance_id"], r["label"], r["phase"], r["batch"]): r for r in requests.collect()}
    assert sorted(r["n_arguments"] for k, r in rows.items() if k[:3] == ("hot", "FAIL_TO_PASS", "pre")) == [200, 250, 250]
    assert rows["few", "FAIL_TO_PASS", "post", 0]["command"] == d.TEST_COMMAND + " t.py::test_x"
    assert rows["few", "PASS_TO_PASS", "pre", 0]["command"] == d.TEST_COMMAND + " tests/"
    assert len(rows) == 2 * (3 + 1 + 1 + 1)
    specs = spark.createDataFrame([("hot",), ("few",), ("none",)], "instance_id string")
    logs = [("few", "FAIL_TO_PASS", "pre", 0, log("FAILED t.py::test_x")), ("few", "FAIL_TO_PASS", "post", 0, log("PASSED t.py::test_x")),
            ("few", "PASS_TO_PASS", "pre", 0, ""), ("few", "PASS_TO_PASS", "post", 0, log("PASSED t.py::y")), ("few", "PASS_TO_PASS", "pre", 9, log("PASSED t.py::y"))]
    landed = spark.createDataFrame(logs, "instance_id string, label string, phase string, batch long, log string")
    got = {r["instance_id"]: (r["processed"], r["n_missing"], r["fail_to_pass"], r["pass_to_pass"]) for r in label.label_runs(specs, arguments, landed).collect()}
    # an empty log is there and knows no test; the log of a batch nobody asked for does not count
    assert got == {"few": (True, 0, "t.py::test_x", None), "hot": (False, 8, None, None), "none": (True, 0, None, None)}
    assert label.missing_runs(requests, landed.limit(0)).count() == len(rows)
