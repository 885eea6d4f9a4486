"""What the plans of the whole jobs must and must not hold."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from taskmine.operators import pull_requests as pr, specs as sp
from taskmine.plans import collect, enrich


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_specs_are_deduplicated_without_dragging_patches_through_a_sort_aggregate(spark):
    rows = [("a", 0, "x"), ("a", 2, "z"), ("a", 1, "y"), ("b", 3, "w"), ("b", 3, "w")]
    frame = spark.createDataFrame(rows, "instance_id string, spec_order int, patch string")
    kept = sp.dedup_specs(frame)
    assert "SortAggregate" not in plan_of(kept)
    assert sorted(tuple(r) for r in kept.collect()) == [("a", 0, "z"), ("b", 3, "w")]


def test_files_and_releases_are_narrowed_to_the_candidates_before_they_are_counted(spark):
    candidates = spark.createDataFrame([("o/a", ["x"])], "full_name string, topics array<string>")
    processed = spark.createDataFrame([], "full_name string")
    files = spark.createDataFrame([("o/a", "tests/test_a.py")], "repo string, path string")
    releases = spark.createDataFrame(
        [("o/a", "v1", "b" * 60, "2025-01-01T00:00:00Z", "dev", False, False, 0)],
        "repo string, tag_name string, body string, published_at string, author_login string, draft boolean, prerelease boolean, api_pos int")
    plan = plan_of(collect.qualify_repositories(candidates, processed, files, releases))
    assert len(re.findall(r"LeftSemi", plan)) >= 3


def test_each_text_is_parsed_once_and_only_where_it_decides(spark):
    prs = spark.createDataFrame([("o/a", "1", "b1", "h1", True), ("o/a", "2", "b2", "h2", True)], "repo string, pr_number string, base_sha string, head_sha string, merged boolean")
    files = spark.createDataFrame([("o/a", n, f, "modified", 0) for n in ("1", "2") for f in ("src/a.py", "tests/test_a.py")],
                                  "repo string, pr_number string, filename string, status string, pos int")
    body = "def f():\n    return 1\n"
    contents = spark.createDataFrame([("o/a", "src/a.py", ref, body) for ref in ("b1", "h1", "b2", "h2")] + [("o/b", "src/a.py", "b1", "def g(): pass")],
                                     "repo string, path string, ref string, content string")
    features = spark.createDataFrame([("o/a", "1")], "repo string, pr_number string")
    landed = enrich.Landed(prs, files, prs.limit(0), contents)
    eligible, _, _ = enrich.judged(features, landed)
    plan = plan_of(pr.distinct_definitions(contents, pr.needed_snapshots(files, prs)))
    below = plan[plan.index("ArrowEvalPython"):]
    assert "LeftSemi" in below and "Aggregate" in below
    assert [tuple(r) for r in eligible.select("pr_number", "eligible").collect()] == [("1", True)]
    same = pr.distinct_definitions(contents).where("repo = 'o/a'").select("definitions").distinct().collect()
    assert [r["definitions"] for r in same] == [["f"]]


def test_pull_requests_with_text_too_deep_to_parse_are_not_eligible(spark):
    deep = "x = " + "-" * 100_000 + "1\n"
    prs = spark.createDataFrame([("o/a", str(n), f"b{n}", f"h{n}", True) for n in (1, 2, 3)], "repo string, pr_number string, base_sha string, head_sha string, merged boolean")
    files = spark.createDataFrame([("o/a", str(n), f, "added" if n == 3 and f.startswith("src") else "modified", 0) for n in (1, 2, 3) for f in ("src/a.py", "tests/test_a.py")],
                                  "repo string, pr_number string, filename string, status string, pos int")
    texts = {"b1": deep + "def f(): pass\n", "h1": deep + "def f(): pass\ndef g(): pass\n", "b2": "def f(): pass\n", "h2": "def f(): return 2\n", "h3": deep + "def f(): pass\n"}
    contents = spark.createDataFrame([("o/a", "src/a.py", ref, text) for ref, text in texts.items()], "repo string, path string, ref string, content string")
    for definitions in (pr.snapshot_definitions(contents), pr.distinct_definitions(contents)):
        got = {r["pr_number"]: r["eligible"] for r in pr.eligibility(files, prs, definitions).collect()}
        assert got == {"1": False, "2": True, "3": False}


def test_cached_analyses_are_returned_whole_and_requests_come_once(spark):
    stored = spark.createDataFrame([("o/a", "v1", "old")], "repo string, tag_name string, response string")
    fresh = spark.createDataFrame([("o/a", "v1", "new"), ("o/a", "v2", "new"), ("o/a", "v2", "new")], stored.schema)
    assert sorted(tuple(r) for r in collect.with_cached(fresh, stored).collect()) == [("o/a", "v1", "old"), ("o/a", "v2", "new")]
    release = F.array(*[F.struct(F.lit(t).alias("tag_name"), F.lit("body").alias("body")) for t in ("v1", "v2")])
    repos = spark.createDataFrame([("o/a", "read me"), ("o/a", "read me")], "full_name string, readme_content string").withColumn("major_releases", release)
    requests = collect.release_requests(repos, stored).collect()
    assert [r["tag_name"] for r in requests] == ["v2"] and "read me" in requests[0]["prompt"]
