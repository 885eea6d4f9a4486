import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from taskmine.plans import collect, enrich
from taskmine.sources import landed
from taskmine.sources.stages import staged
from taskmine.sources.store import KeyedStore, work_folder
from taskmine.streaming import incremental as inc


def write(path, *documents):
    path.write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in documents))
    return str(path)


def test_search_pages(spark, tmp_path):
    item = lambda name: {"full_name": name, "stargazers_count": 1, "unknown": 3}
    path = write(tmp_path / "pages.json", {"page": 0, "items": [item("a"), item("b")]}, {"page": 1, "items": [item("c")]}, {"page": 2, "items": []})
    rows = landed.search_pages(spark, path).orderBy("api_pos").collect()
    assert [(r["full_name"], r["api_pos"], r["topics"]) for r in rows] == [("a", 0, None), ("b", 1, None), ("c", 100, None)]


def test_releases(spark, tmp_path):
    path = write(tmp_path / "releases.json", {"repo": "r", "api_pos": 0, "tag_name": "v1", "author": None, "body": None}, {"repo": "r", "api_pos": 30, "tag_name": "v0", "author": {"login": "x"}})
    rows = landed.releases(spark, path).orderBy("api_pos").collect()
    assert [(r["author_login"], r["body"], r["name"]) for r in rows] == [(None, "", ""), ("x", "", "")]
    assert landed.releases(spark, path, page_limit=30).count() == 1


def test_pull_request_files(spark):
    answer = json.dumps([{"filename": "a", "status": "added", "additions": 1}, {}])
    frame = spark.createDataFrame([("r", "1", answer), ("r", "2", "[]"), ("r", "3", "oops")], "repo string, pr_number string, files string")
    rows = [tuple(r) for r in landed.pull_request_files(frame).orderBy("pos").collect()]
    assert rows == [("r", "1", 0, "a", "added", 1, 0, 0, ""), ("r", "1", 1, "", "", 0, 0, 0, "")]


def test_pull_requests_commits_contents(spark, tmp_path):
    prs = write(tmp_path / "prs.json", {"repo": "r", "pr_number": "1", "base": {"sha": "b"}, "head": {"sha": "h"}})
    assert landed.pull_requests(spark, prs).first().asDict() == {
        "repo": "r", "pr_number": "1", "title": "", "body": "", "state": "", "merged": False, "base_sha": "b", "head_sha": "h"}
    commits = write(tmp_path / "commits.json", {"repo": "r", "sha": "b", "commit": {"message": "m", "author": {"date": "d"}}})
    assert tuple(landed.commits(spark, commits).first()) == ("r", "b", "m", "d", "")
    contents = write(tmp_path / "c.json", {"repo": "r", "path": "p", "ref": "b", "encoding": "base64", "content": "aGk="})
    assert landed.file_contents(spark, contents).first()["content"] == "hi"


def test_agent_patches_skip_bad_lines(spark, tmp_path):
    path = write(tmp_path / "p.jsonl", {"instance_id": "a", "model_patch": "x"}, "{oops", {"instance_id": "b", "model_patch": ""}, {"instance_id": "c"})
    assert [tuple(r) for r in landed.agent_patches(spark, path).collect()] == [("a", "x")]


def test_patch_files_are_read_whole_and_must_exist(spark, tmp_path):
    path = write(tmp_path / "patch.diff", "diff --git a/x b/x\n@@ -1 +1 @@")
    assert landed.patch_files(spark, path).first()["diff"] == "diff --git a/x b/x\n@@ -1 +1 @@"
    with pytest.raises(Exception):
        landed.patch_files(spark, str(tmp_path / "none.diff")).collect()


def test_final_document_to_specs(spark, tmp_path):
    change = lambda name: {"filename": name, "status": "modified", "additions": 1, "deletions": 0, "changes": 1, "patch": "@@"}
    pr = lambda number, text: {"pr_number": number, "base_commit": {"sha": "b", "date": "2024-01-01T00:00:00Z"}, "detailed_description": text,
                               "file_changes": [change("tests/test_a.py"), change("a.py"), change("README.md")], "test_files": ["tests/test_a.py"]}
    document = {"metadata": {}, "results": [
        {"repository": "o/r", "release": "v1", "enhanced_new_features": [{"pr_analyses": [pr("1", "first"), pr("2", "other")]}, {"pr_analyses": []}]},
        {"repository": "o/r", "release": "v2", "enhanced_new_features": [{"pr_analyses": [pr("1", "last")]}]},
        {"repository": "o/r", "release": "v3", "enhanced_new_features": []}]}
    path = write(tmp_path / "final.json", json.dumps(document, indent=2))
    specs = enrich.build_specs(landed.final_results(spark, path, lines=False))
    rows = specs.orderBy("spec_order").collect()
    assert [(r["instance_id"], r["version"], r["problem_statement"], r["number"], r["org"]) for r in rows] == [
        ("o__r-1", "v2", "last", 1, "o"), ("o__r-2", "v1", "other", 2, "o")]
    assert [c["filename"] for c in rows[0]["patch"]] == ["a.py", "README.md"]
    assert [c["filename"] for c in rows[0]["test_patch"]] == ["tests/test_a.py"]
    out = str(tmp_path / "specs")
    landed.write_json(specs.drop("spec_order"), out, "repo")
    back = landed.task_specs(spark, out)
    assert {(r["instance_id"], r["base_commit"], r["repo"]) for r in back.collect()} == {("o__r-1", "b", "o/r"), ("o__r-2", "b", "o/r")}
    array = write(tmp_path / "array.json", json.dumps([{"instance_id": "x"}, {"instance_id": "y"}], indent=1))
    assert sorted(r["instance_id"] for r in landed.task_specs(spark, array, lines=False).collect()) == ["x", "y"]


def test_written_results_read_back(spark, tmp_path):
    change = "struct<filename:string,status:string,additions:bigint,deletions:bigint,changes:bigint,patch:string>"
    rows = [(1, "o/r", "v1", "now", [(None, "d", [], "text")])]
    frame = spark.createDataFrame(rows, "seq bigint, repository string, release string, analyzed_at string, enhanced_new_features "
                                  f"array<struct<feature_type:string,description:string,pr_analyses:array<struct<file_changes:array<{change}>>>,feature_detailed_description:string>>")
    landed.write_final_results(frame, spark.range(1), str(tmp_path / "final"))
    (row,) = landed.final_results(spark, str(tmp_path / "final"), lines=True).collect()
    assert (row["seq"], row["repository"], row["enhanced_new_features"][0]["feature_detailed_description"]) == (1, "o/r", "text")


def test_log_history(spark, tmp_path):
    rows = [("r", "i", "pre", 0, "old"), ("r", "i", "pre", 1, "new"), ("r", "i", "post", 0, "x")]
    frame = spark.createDataFrame(rows, "repo string, instance_id string, phase string, run_seq bigint, log string")
    for run in (0, 1):
        landed.write_test_logs(frame.where(F.col("run_seq") == run), str(tmp_path / "logs"))
    stored = landed.read_test_logs(spark, str(tmp_path / "logs"))
    assert sorted(r["log"] for r in stored.collect()) == ["new", "old", "x"]
    assert sorted(r["log"] for r in landed.latest_test_logs(stored).collect()) == ["new", "x"]


def test_candidates_by_mode(spark):
    listing = spark.createDataFrame([(f"o/{i}", 9000 - i, i) for i in range(150)], "full_name string, stargazers_count bigint, api_pos bigint")
    assert collect.candidates("stars", listing=listing).count() == 51
    details = spark.createDataFrame([("a", 1, 2, ["t"], None, None, None, True)], "full_name string, stargazers_count bigint, size bigint, topics array<string>, "
                                    "language string, archived boolean, disabled boolean, fork boolean")
    names = spark.createDataFrame([("a",), ("gone",), ("a",)], "full_name string")
    got = [tuple(r) for r in collect.candidates("specified", names=names, details=details).collect()]
    assert got == [("a", 1, 2, ["t"], "", False, False, True)] * 2
    with pytest.raises(ValueError):
        collect.candidates("both")


def test_release_requests_skip_analysed_releases(spark):
    repos = spark.createDataFrame([("o/r", "read me", [("v1", "b1"), ("v2", "b2")])], "full_name string, readme_content string, major_releases array<struct<tag_name:string,body:string>>")
    done = spark.createDataFrame([("o/r", "v1")], "repo string, tag_name string")
    (row,) = collect.release_requests(repos, done).collect()
    assert row["tag_name"] == "v2" and "read me" in row["prompt"] and "b2" in row["prompt"] and '{"description": text' in row["prompt"]


def store(spark, tmp_path, keep="last"):
    return KeyedStore(spark, str(tmp_path / "store"), "k string, v int", ["k"], keep)


def add(store, batch, *rows):
    frame = store.spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k string, v int, at int")
    store.add(frame, batch, ["at"])


def content(store):
    return {r["k"]: r["v"] for r in store.read().collect()}


def test_store_keeps_the_last_per_key(spark, tmp_path):
    s = store(spark, tmp_path)
    assert content(s) == {}
    add(s, 0, ("a", 1), ("b", 1), ("a", 2))
    add(s, 1, ("b", 3), ("c", 4))
    assert content(s) == {"a": 2, "b": 3, "c": 4}
    add(s, 1, ("b", 3), ("c", 4))  # a replay changes nothing
    assert content(s) == {"a": 2, "b": 3, "c": 4}


def test_store_keeps_the_first_per_key(spark, tmp_path):
    s = store(spark, tmp_path, "first")
    add(s, 0, ("a", 1), ("a", 2))
    add(s, 1, ("a", 3), ("b", 3))
    assert content(s) == {"a": 1, "b": 3}


@pytest.mark.parametrize("keep,want", [("last", {"a": 9, "b": 3, "c": 4}), ("first", {"a": 1, "b": 1, "c": 4})])
def test_compaction_keeps_content_and_ignores_late_replays(spark, tmp_path, keep, want):
    s = store(spark, tmp_path, keep)
    add(s, 0, ("a", 1), ("b", 1))
    add(s, 1, ("b", 3), ("c", 4))
    s.compact()
    add(s, 1, ("b", 8), ("c", 8))  # replay of a batch the base already holds
    add(s, 2, ("a", 9))
    assert content(s) == want
    s.compact()
    assert content(s) == want


def test_unfinished_batches_are_not_read(spark, tmp_path):
    s = store(spark, tmp_path)
    add(s, 0, ("a", 1))
    add(s, 1, ("a", 2))
    (tmp_path / "store" / "batch=1" / "_SUCCESS").unlink()
    assert content(s) == {"a": 1}


def test_stage_tables_go_to_the_configured_folder(spark):
    configured = SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://shared/checkpoints"})
    assert work_folder(configured) == "hdfs://shared/checkpoints"
    with pytest.raises(ValueError):  # a cluster without a shared folder
        work_folder(SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="yarn")))
    assert work_folder(spark) == work_folder(spark)  # one local folder per session where none is set
    assert staged(spark.range(3), "numbers").count() == 3


def test_streams_equal_their_batch_form(spark, tmp_path):
    rows = [("a", 1, 0), ("b", 1, 1), ("a", 2, 2), ("c", 1, 3), ("b", 5, 4)]
    source = tmp_path / "in"
    typed = lambda part: spark.createDataFrame(part, "k string, v int, at int").withColumn("ts", F.timestamp_seconds("at").cast("timestamp_ntz"))
    schema = typed(rows).schema
    typed(rows[:3]).coalesce(1).write.parquet(str(source))
    s = store(spark, tmp_path)
    read = lambda: spark.readStream.schema(schema).parquet(str(source))
    run = lambda: inc.upsert_stream(read(), s, ["at"], str(tmp_path / "ck")).awaitTermination()
    run()
    assert content(s) == {"a": 2, "b": 1}
    typed(rows[3:]).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert content(s) == {"a": 2, "b": 5, "c": 1}
    first = inc.first_seen(read(), ["k"], "ts", "1 day")
    inc.append_stream(first, str(tmp_path / "out"), str(tmp_path / "ck2")).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_stage_tables_go_when_they_are_dropped(spark):
    from taskmine.sources import stages

    stages.drop_stages(spark)
    table = stages.staged(spark.range(3), "some")
    assert table.count() == 3 and stages.drop_stages(spark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0]).count()
    assert stages.drop_stages(spark) == 0
