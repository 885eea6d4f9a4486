from pyspark.sql import functions as F

from taskmine import defaults as d
from taskmine.operators import pull_requests as pr

FILES = "repo string, pr_number string, pos int, filename string, status string, additions bigint, deletions bigint, changes bigint, patch string"


def files(spark, *entries):
    rows = [("r", number, pos, name, status, 1, 2, 3, "@@") for number, pos, name, status in entries]
    return spark.createDataFrame(rows, FILES)


def eligible(spark, changed, contents):
    frame = files(spark, *[("1", i, name, status) for i, (name, status) in enumerate(changed)])
    prs = spark.createDataFrame([("r", "1", "b", "h", True)], "repo string, pr_number string, base_sha string, head_sha string, merged boolean")
    landed = spark.createDataFrame([("r", *c) for c in contents], "repo string, path string, ref string, content string")
    return pr.eligibility(frame, prs, pr.snapshot_definitions(landed)).first()["eligible"]


TEST = ("tests/test_a.py", "modified")
SAME = [("a.py", "b", "def f(): pass"), ("a.py", "h", "def f(): return 1")]


def test_eligibility_rules(spark):
    check = lambda changed, contents: eligible(spark, changed, contents)
    assert check([TEST, ("a.py", "modified")], SAME)
    assert not check([("a.py", "modified")], SAME)  # no test file
    assert not check([TEST, ("README.md", "modified")], SAME)  # no source file
    assert not check([TEST, ("a.py", "modified")], SAME[:1])  # unreadable after
    assert not check([TEST, ("a.py", "modified")], [("a.py", "b", "x = 1"), ("a.py", "h", "def f(): pass")])
    assert check([TEST, ("a.py", "modified")], [("a.py", "b", "x = 1"), ("a.py", "h", "if 1:\n  def f(): pass")])
    assert check([TEST, ("a.py", "added")], [("a.py", "h", "x = 1")])
    assert not check([TEST, ("a.py", "added")], [("a.py", "h", "class A: pass")])
    assert check([TEST, ("a.py", "added")], [])  # unreadable added file is no violation
    assert not check([TEST, ("a.py", "removed")], [("a.py", "b", "def f(): pass")])
    assert check([TEST, ("a.py", "removed")], [("a.py", "h", "def f(): pass")])  # only the base counts
    assert check([TEST, ("a.py", "renamed")], [])
    assert check([TEST, ("a.py", "modified"), ("tests/test_b.py", "added")], [*SAME, ("tests/test_b.py", "h", "def t(): pass")])
    assert check([TEST, ("a.py", "modified")], [("a.py", "b", ""), ("a.py", "h", "x = 1")])  # empty is readable


def test_summary_text(spark):
    frame = files(spark, *[("1", i, f"m{i}.py", "modified") for i in range(4)], ("2", 0, "tests/test_a.py", "added"))
    long = frame.withColumn("patch", F.when(F.col("pos") == 1, F.repeat(F.lit("p"), 1000)).when(F.col("pos") == 2, F.repeat(F.lit("q"), 700)).otherwise("@@"))
    got = {r["pr_number"]: r["files_text"] for r in pr.files_summary(long, **{**d.SUMMARY_LIMITS, "max_files": 3}).collect()}
    assert got["2"] == "No files were modified in this PR."
    assert got["1"] == ("- m0.py (modified): +1/-2\n  @@...\n- m1.py (modified): +1/-2\n- m2.py (modified): +1/-2\n  "
                        + "q" * 600 + "...\n... and 1 more files")


FEATURES = "repo string, tag_name string, release_pos int, feature_pos int, feature_type string, description string, pr_pos int, pr_number string"


def test_feature_texts(spark):
    rows = [("r", "v1", 0, 0, "new_feature", "one", 0, "1"), ("r", "v1", 0, 1, "new_feature", "two", 0, "1"), ("r", "v1", 0, 1, "new_feature", "two", 1, "2"),
            ("r", "v1", 0, 2, "new_feature", "gone", 0, "9"), ("r", "v2", 1, 0, "new_feature", "three", 0, "1"), ("r", "v2", 1, 0, "new_feature", "three", 1, "2"),
            ("r", "v3", 2, 0, "new_feature", "four", 0, "1"), ("r", "v3", 2, 0, "new_feature", "four", 1, "2")]
    features = spark.createDataFrame(rows, FEATURES)
    eligible = spark.createDataFrame([("r", "1", True), ("r", "2", True), ("r", "9", False)], "repo string, pr_number string, eligible boolean")
    answers = spark.createDataFrame([("r", "2", "answer 2")], "repo string, pr_number string, response string")
    descriptions = pr.pr_descriptions(eligible, pr.first_mentions(features), answers)
    assert {r["pr_number"]: r["detailed_description"] for r in descriptions.collect()} == {"1": "one", "2": "answer 2"}
    synthesised = spark.createDataFrame([("r", "v1", 1, "both"), ("r", "v2", 0, None)], "repo string, tag_name string, feature_pos int, response string")
    got = {(r["tag_name"], r["feature_pos"]): r["feature_detailed_description"] for r in pr.enriched_features(features, descriptions, synthesised).collect()}
    # one PR: its text; several: the answer, the feature's words for an empty answer, nothing without an answer
    assert got == {("v1", 0): "one", ("v1", 1): "both", ("v2", 0): "three"}


def test_feature_request_lists_its_pull_requests_in_order(spark):
    rows = [("r", "v1", 0, 0, "new_feature", "two", 1, "2"), ("r", "v1", 0, 0, "new_feature", "two", 0, "1")]
    features = spark.createDataFrame(rows, FEATURES)
    prs = spark.createDataFrame([("r", "1", "T1", "closed", True), ("r", "2", "T2", "open", False)], "repo string, pr_number string, title string, state string, merged boolean")
    counts = spark.createDataFrame([("r", "1", 3), ("r", "2", 4)], "repo string, pr_number string, n_files int")
    texts = spark.createDataFrame([("r", "1", "d1"), ("r", "2", "d2")], "repo string, pr_number string, detailed_description string")
    (prompt,) = [r["prompt"] for r in pr.feature_requests(features, prs, counts, texts, "{feature_type}|{feature}|{pull_requests}").collect()]
    assert prompt == ("new_feature|two|\nPR #1: T1\n- Status: closed (merged: True)\n- Files changed: 3\n- User benefits: d1\n\n"
                      "\nPR #2: T2\n- Status: open (merged: False)\n- Files changed: 4\n- User benefits: d2\n")


def test_links_without_number_are_skipped(spark):
    rows = [("r", "v1", 0, "new_feature", 0, "d", ["https://github.com/r/pull/12", "https://github.com/r/pull/#12"]), ("r", "v1", 0, "bug_fix", 0, "d", ["https://github.com/r/pull/5"]),
            ("r", "v1", 0, "new_feature", 1, "d", [])]
    frame = spark.createDataFrame(rows, "repo string, tag_name string, release_pos int, feature_type string, feature_pos int, description string, pr_links array<string>")
    assert [r["pr_number"] for r in pr.feature_prs(frame).collect()] == ["12"]
