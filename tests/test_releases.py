import pytest
from pyspark.sql import functions as F

from taskmine.operators import changes as ch, releases as rel, repos as rep


def releases(spark, rows):
    names = "repo string, api_pos bigint, tag_name string, author_login string, body string, published_at string"
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("author,body,date,kept", [
    ("dev", "x" * 50, "2024-06-01T00:00:00Z", True), (None, "x" * 50, "2024-06-01T00:00:00Z", True),
    ("dependabot[bot]", "x" * 50, "2024-06-01T00:00:00Z", False), ("dev", "x" * 49 + "\n\t ", "2024-06-01T00:00:00Z", False),
    ("dev", "\n" + "x" * 50 + "\t", "2024-06-01T00:00:00Z", True), ("dev", None, "2024-06-01T00:00:00Z", False),
    ("dev", "x" * 50, "2024-05-31T23:59:59Z", False), ("dev", "x" * 50, "2024-06-01T00:00:00", False), ("dev", "x" * 50, "", False),
    ("dev", "x" * 50, None, False), ("dev", "x" * 50, "2024-06-01T01:00:00+02:00", False),
])
def test_validity(spark, author, body, date, kept):
    frame = releases(spark, [("r", 0, "v1", author, body, date)])
    assert rel.valid_releases(frame).count() == kept


def test_top_versions_keep_listing_order_among_equals(spark):
    tags = ["1.2", "1.10", "v1.2", "1", "1.2.0", "2.0rc1", "none"]
    frame = releases(spark, [("r", i, tag, "dev", "", "") for i, tag in enumerate(tags)])
    got = [r["tag_name"] for r in rel.top_versions(frame, 4).orderBy("rank").collect()]
    assert got == ["1.10", "1.2.0", "1.2", "v1.2"]
    assert [r["tag_name"] for r in rel.latest_per_major(frame).collect()] == ["1.10"]


def test_top_versions_limit_inside_the_map_tasks(spark):
    frame = releases(spark, [("r", i, f"v{i}", "dev", "", "") for i in range(10)])
    plan = rel.top_versions(frame, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_topics(spark):
    frame = spark.createDataFrame([("a", ["x", "book"]), ("b", ["x", None]), ("c", None), ("d", [])], "full_name string, topics array<string>")
    assert sorted(r["full_name"] for r in rep.without_topics(frame).collect()) == ["b", "c", "d"]


def test_tested_repos(spark):
    rows = [("root", "test_a.py"), ("dir", "MyTests/deep/x.py"), ("spec", "inspection/a.py"), ("none", "src/tests/x.py"), ("data", "tests/x.txt")]
    frame = spark.createDataFrame(rows, "repo string, path string")
    got = {r["repo"]: r["has_tests"] for r in rep.tested_repos(frame).collect()}
    assert got == {"root": True, "dir": True, "spec": True, "none": False, "data": False}


def test_test_dirs(spark):
    rows = [("a", "tests/x.py"), ("a", "lib/tests/y.py"), ("b", "lib/test/y.py"), ("b", "lib/test/unit_tests/z.py"), ("b", "build/tests/y.py"),
            ("c", "src/x.py"), ("d", ".hidden/tests/x.py"), ("e", "tests")]
    frame = spark.createDataFrame(rows, "repo string, path string")
    got = sorted((r["repo"], r["test_dir"]) for r in rep.test_dirs(frame).collect())
    assert got == [("a", "tests"), ("b", "lib/test"), ("b", "lib/test/unit_tests"), ("c", "tests"), ("d", "hidden/tests"), ("e", "tests")]


def test_rank_is_by_stars_then_listing_order(spark):
    frame = spark.createDataFrame([("a", 5, 0), ("b", 9, 1), ("c", 9, 2), ("d", 1, 3)], "full_name string, stargazers_count bigint, api_pos bigint")
    got = [(r["full_name"], r["rank"]) for r in rep.rank_candidates(frame, 2, 2, 3).orderBy("rank").collect()]
    assert got == [("c", 2), ("a", 3)]


def test_readme_is_the_first_reachable_root_file(spark):
    rows = [("a", 0, "docs/readme.md", "u", "x"), ("a", 1, "README", "", "no link"), ("a", 2, "Readme.RST", "u", "second"), ("a", 3, "readme.md", "u", "third")]
    frame = spark.createDataFrame(rows, "repo string, pos bigint, path string, download_url string, content string")
    assert [r["readme_content"] for r in rep.readmes(frame).collect()] == ["second"]


def test_answers(spark):
    rows = [("r", "v1", '{"new_features":[{"description":"d","pr_ids":[12,"#3"]},{"pr_ids":[]}]}'), ("r", "v2", "oops"), ("r", "v3", None)]
    frame = spark.createDataFrame(rows, "repo string, tag_name string, response string")
    parsed = ch.parsed_answers(frame)
    got = sorted((r["feature_pos"], r["description"], r["pr_links"]) for r in ch.release_changes(ch.analysed(parsed)).collect())
    assert got == [(0, "d", ["https://github.com/r/pull/12", "https://github.com/r/pull/#3"]), (1, "", [])]
    total = ch.change_counts(parsed).where("repo is null").first()
    assert (total["releases"], total["new_features"]) == (3, 2)


def test_fill_leaves_other_braces_alone(spark):
    text = ch.fill('{a}-{{b}}{c}{"x": {a}}', {"a": F.lit("1"), "b": F.lit(None).cast("string")})
    assert spark.range(1).select(text.alias("t")).first()["t"] == '1-{}{c}{"x": 1}'
