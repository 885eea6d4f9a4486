import random
import re

import pytest
from pyspark.sql import functions as F

from taskmine.operators import labels as lb, testlogs as tl

RUN = ["run"]


def logs(spark, *texts):
    return spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "run int, log string")


def parsed(spark, text):
    return {r["test_path"]: r["status"] for r in tl.test_results(logs(spark, text), RUN).collect()}


def test_result_lines(spark):
    text = "noise\nPASSED before.py::t\n=== short test summary info ===\n" \
           " PASSED a.py::t \nFAILED a.py::t[a - b] - boom - x\nERROR b.py\nSKIPPED [1] a.py:3: why\nXFAIL c\nPASSED\nPASSEDx y"
    assert parsed(spark, text) == {"a.py::t": "PASSED", "a.py::t[a": "FAILED", "b.py": "ERROR", "[1] a.py:3: why": "SKIPPED"}


def test_without_summary_the_whole_log_counts(spark):
    assert parsed(spark, "PASSED a.py::t\n\x1b[31mFAILED\x1b[0m a.py::u - x") == {"a.py::t": "PASSED", "a.py::u": "FAILED"}


def test_last_line_wins(spark):
    assert parsed(spark, "PASSED a.py::t\nFAILED a.py::t\nPASSED a.py::t") == {"a.py::t": "PASSED"}


def test_empty_and_null_logs(spark):
    assert tl.test_results(logs(spark, "", None, "short test summary info"), RUN).collect() == []


def plain(text):
    """Results of a log by looking at one line after the other."""
    text = re.sub("\x1b\\[[0-9;]*m", "", text)
    at = text.find("short test summary info")
    seen = {}
    for line in (text[at:] if at >= 0 else text).split("\n"):
        words = line.strip().split(None, 1)
        if len(words) == 2 and words[0] in ("PASSED", "FAILED", "SKIPPED", "ERROR"):
            cut = re.search(r"(?<=.)\s-\s", words[1])
            seen[words[1][:cut.start()].strip() if cut else words[1]] = words[0]
    return seen


def test_random_logs_cell_by_cell_and_line_by_line(spark):
    rng = random.Random(7)
    pieces = ["PASSED a.py::t", "FAILED a.py::t[1] - x - y", "ERROR b.py::u", "SKIPPED a.py::t", "noise", "", "\x1b[1mPASSED\x1b[0m c.py::v[2]",
              "== short test summary info ==", "PASSED b.py::u", "  FAILED a.py::t[1]"]
    texts = ["\n".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(200)]
    frame = logs(spark, *texts)
    want = {(i, path, status) for i, text in enumerate(texts) for path, status in plain(text).items()}
    assert {tuple(r) for r in tl.test_results(frame, RUN).collect()} == want
    lines = frame.select("run", F.posexplode(F.split("log", "\n")).alias("line_no", "line"))
    assert {tuple(r) for r in tl.results_of_lines(lines, RUN).collect()} == want


@pytest.mark.parametrize("statuses,want", [
    (["PASSED", "SKIPPED"], "PASSED"), (["PASSED", "ERROR"], "FAILED"), (["SKIPPED"], "SKIPPED"), (["FAILED", "SKIPPED"], "FAILED"), (["UNKNOWN"], "FAILED"),
])
def test_roll_up(spark, statuses, want):
    rows = [(1, f"t[{i}]", status) for i, status in enumerate(statuses)]
    frame = spark.createDataFrame(rows, "run int, test_path string, status string")
    assert [(r["base"], r["status"]) for r in tl.base_status(frame, RUN).collect()] == [("t", want)]


def test_query_prefers_the_exact_path(spark):
    results = spark.createDataFrame([(1, "t[1]", "ERROR"), (1, "t[2]", "PASSED")], "run int, test_path string, status string")
    asked = spark.createDataFrame([(1, t) for t in ("t[1]", "t[2]", "t[3]", "t", "u")], "run int, test string")
    got = {r["test"]: r["status"] for r in tl.query_tests(asked, results, RUN).collect()}
    assert got == {"t[1]": "ERROR", "t[2]": "PASSED", "t[3]": "FAILED", "t": "FAILED", "u": "UNKNOWN"}


def test_find_by_pattern_is_a_regex_only_with_special_characters(spark):
    rows = [(1, path, "PASSED") for path in ("a.py::test_x", "aXpy::test_y", "b::test_x1")]
    frame = spark.createDataFrame(rows, "run int, test_path string, status string")
    found = lambda pattern: sorted(r["test_path"] for r in tl.find_by_pattern(frame, pattern).collect())
    assert found("a.py") == ["a.py::test_x", "aXpy::test_y"]
    assert found("test_x") == ["a.py::test_x", "b::test_x1"]
    assert found("test_x$") == ["a.py::test_x"]


def test_summary_fills_in_zeros(spark):
    frame = logs(spark, "PASSED a\nPASSED b\nERROR c", "nothing")
    got = {(r["run"], r["status"]): r["tests"] for r in tl.status_summary(tl.test_results(frame, RUN), frame, RUN).collect()}
    want = {(run, status): 0 for run in (0, 1) for status in ("PASSED", "FAILED", "SKIPPED", "ERROR", "UNKNOWN")}
    assert got == {**want, (0, "PASSED"): 2, (0, "ERROR"): 1}


def test_labels_from_two_logs(spark):
    pre = "FAILED t::a\nPASSED t::b\nERROR t::c[1]\nPASSED t::c[2]\nPASSED t::e"
    post = "PASSED t::a\nPASSED t::b\nPASSED t::c[1]\nSKIPPED t::c[2]\nPASSED t::d\nFAILED t::e"
    frame = spark.createDataFrame([("i", "pre", pre), ("i", "post", post)], "instance_id string, phase string, log string")
    want = {("i", "FAIL_TO_PASS", "t::a"), ("i", "FAIL_TO_PASS", "t::c"), ("i", "PASS_TO_PASS", "t::b")}
    assert {tuple(r) for r in lb.labels_of_runs(frame).collect()} == want
    instances = spark.createDataFrame([("i",), ("j",)], "instance_id string")
    texts = {r[0]: (r[1], r[2]) for r in lb.rendered(instances, lb.labels_of_runs(frame)).collect()}
    assert texts == {"i": ("t::a, t::c", "t::b"), "j": (None, None)}


def test_selector_labels_need_the_test_to_have_been_seen_before(spark):
    pre, post = "FAILED t::a\nPASSED t::b", "PASSED t::a\nPASSED t::b\nPASSED t::new"
    frame = spark.createDataFrame([("i", "pre", pre), ("i", "post", post)], "instance_id string, phase string, log string")
    selectors = spark.createDataFrame([("i", "t::a"), ("i", "t::new")], "instance_id string, selector string")
    want = {("i", "FAIL_TO_PASS", "t::a"), ("i", "PASS_TO_PASS", "t::b")}
    assert {tuple(r) for r in lb.labels_of_selectors(selectors, frame).collect()} == want


def test_label_text_and_back(column):
    assert column(lb.label_list, ["a, b", "", None, "a"]) == [["a", "b"], [], [], ["a"]]
