"""JSON arrays over many splits, ranks without one task, and streams out of order."""

from __future__ import annotations

import gzip
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taskmine.operators.ranking import ranked
from taskmine.operators.repos import rank_candidates
from taskmine.sources import json_arrays, landed, schemas
from taskmine.sources.store import KeyedStore
from taskmine.streaming import incremental as inc

AWKWARD = ['plain', 'a } b', '{ "x": [', 'quote " inside', 'back\\slash', 'ends \\', '\\"}', '}{][', '', 'é 漢字 }', 'line\nbreak', '\\\\"', '"}],{"']


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def objects(rng, n):
    pick = lambda: rng.choice(AWKWARD) + rng.choice(AWKWARD)
    return [{"k": i, "t": pick(), "in": {"u": pick(), "v": [{"w": pick()}] * rng.randrange(3)}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_over_many_splits(spark, tmp_path, small_splits, indent):
    rows = objects(random.Random(1), 200)
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(rows[:7], ensure_ascii=True) + "\n")
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_text(json.dumps(rows[:5])[:-20])  # breaks off inside the last element
    assert spark.read.option("lineSep", "}").text(f"{tmp_path}/a.json").rdd.getNumPartitions() > 20
    got = {}
    for r in json_arrays.elements(spark, f"{tmp_path}/*.json").orderBy("file", "element_no").collect():
        got.setdefault(r["file"][-6:], []).append(json.loads(r["element"]))
    assert got == {"a.json": rows, "b.json": rows[:7], "e.json": rows[:4]}


@pytest.mark.parametrize("metadata", [{}, {"generated_at": 'now "}', "n": 3}, None])
def test_arrays_inside_documents(spark, tmp_path, small_splits, metadata):
    rows = objects(random.Random(2), 40)
    document = ({"metadata": metadata} if metadata is not None else {}) | {"results": rows, "more": "x", "end": {}}
    (tmp_path / "d.json").write_text(json.dumps(document, indent=1))
    found = json_arrays.elements(spark, f"{tmp_path}/d.json", "results").orderBy("element_no").collect()
    assert [json.loads(r["element"]) for r in found] == rows and [r["element_no"] for r in found] == list(range(40))


def test_arrays_equal_the_line_form(spark, tmp_path):
    specs = spark.range(100_000).select(
        F.concat(F.lit("o__r-"), "id").alias("instance_id"), F.lit('{"a": "}"}').alias("problem_statement"), "id",
        F.array(F.struct(F.lit("a.py").alias("filename"), F.lit("@@ {\n+}").alias("patch"))).alias("patch"))
    json_arrays.write(specs.repartition(3), str(tmp_path / "array"))
    landed.write_json(specs, str(tmp_path / "lines"))
    one = landed.task_specs(spark, str(tmp_path / "array"), lines=False)
    other = landed.task_specs(spark, str(tmp_path / "lines"))
    assert one.count() == 100_000 and one.columns == other.columns
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
    assert json.loads(next(p for p in (tmp_path / "array").glob("part-*") if p.stat().st_size > 4).read_text())[0]["patch"][0]["filename"] == "a.py"


def test_compressed_arrays_are_read_without_a_shuffle_of_their_text(spark, tmp_path, monkeypatch):
    frame = spark.range(300).select("id", F.lit('{"a": "}"}').alias("t")).repartition(3)
    json_arrays.write(frame, str(tmp_path / "packed"), "gzip")
    assert all(p.name.endswith(".gz") for p in (tmp_path / "packed").glob("part-*"))
    names = []
    keep = json_arrays.staged
    monkeypatch.setattr(json_arrays, "staged", lambda table, name: names.append((name, table.columns)) or keep(table, name))
    found = json_arrays.read(spark, str(tmp_path / "packed"), "id long, t string")
    assert found.exceptAll(frame).isEmpty() and frame.exceptAll(found).isEmpty()
    assert [name for name, columns in names if {"value", "text"} & set(columns)] == ["json-parts"]  # the text is written once


@pytest.mark.parametrize("field", [None, "results"])
def test_files_of_one_split_are_read_in_one_pass(spark, tmp_path, monkeypatch, field):
    rows = objects(random.Random(6), 40)
    for name, some, indent in (("a", rows, None), ("b", rows[:3], 2), ("c", [], None), ("d", rows[5:9], 1)):
        document = some if field is None else {"note": "{", "results": some, "more": [1]}
        with gzip.open(tmp_path / f"{name}.json.gz", "wt", encoding="utf-8") as file:
            file.write(json.dumps(document, indent=indent, ensure_ascii=name == "b"))
    (tmp_path / "e.json").write_text(json.dumps(rows[:5])[:-20] if field is None else '{"results": [')  # breaks off
    names, keep = [], json_arrays.staged
    monkeypatch.setattr(json_arrays, "staged", lambda table, name: names.append(name) or keep(table, name))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # elements go on from one batch to the next
    try:
        found = json_arrays.elements(spark, str(tmp_path), field).orderBy("file", "element_no").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    for r in found:
        assert r["element"].startswith("{") and r["element_no"] == len(got.setdefault(r["file"].rsplit("/", 1)[1][0], []))
        got[r["file"].rsplit("/", 1)[1][0]].append(json.loads(r["element"]))
    assert got == {"a": rows, "b": rows[:3], "d": rows[5:9]} | ({"e": rows[:4]} if field is None else {})
    assert names == ["json-parts"]  # no other pass over the text


def test_measures_of_pieces():
    rng = random.Random(7)
    for _ in range(300):
        pieces = [bytes(rng.choice(b'[]{"\\\\\\a\xc3 ') for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 9))]
        odd, outer, inner, first = (one.tolist() for one in json_arrays._measured(pa.array(pieces, pa.binary())))
        for k, piece in enumerate(pieces):
            steps = []
            for inside in (False, True):
                depth, at = 0, 0
                while at < len(piece):
                    one = piece[at:at + 1]
                    if one == b"\\" and piece[at + 1:at + 2] in (b"\\", b'"'):
                        at += 1
                    elif one == b'"':
                        inside = not inside
                    elif not inside:
                        depth += (one in b"[{") - (one in b"]}")
                    at += 1
                steps.append(depth - (not inside))
            assert (odd[k], outer[k], inner[k]) == (int(not inside), *steps)  # what began inside
            assert first[k] == (piece.index(b"{") if b"{" in piece else len(piece))


def test_ranks_of_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([5, 5, 5, rng.randrange(1000)]), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "stars long, pos long").repartition(5)
    found = ranked(frame, [F.desc("stars"), F.asc("pos")], "rank", ranges=7)
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    want = {row: k + 1 for k, row in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert {(r["stars"], r["pos"]): r["rank"] for r in found.collect()} == want
    assert ranked(frame.where("stars < 0"), [F.desc("stars")], "rank").count() == 0


def test_candidates_are_ranked_alike_on_both_ways(spark):
    rng = random.Random(4)
    frame = spark.createDataFrame([(f"r{i}", rng.randrange(40), i) for i in range(1500)], "full_name string, stargazers_count long, api_pos long")
    few, many = rank_candidates(frame, 1, 10, 900), rank_candidates(frame, 1, 10, 1400)
    assert few.dtypes == many.dtypes
    assert sorted(few.collect()) == sorted(many.where("rank <= 900").collect()) and many.count() == 1391


EVENT = "k string, at long, v int"


def test_first_by_order_over_batches_out_of_order(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "store"), EVENT, ["k"], "first", ["at"])
    source = str(tmp_path / "in")

    def run(rows):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
        query = inc.first_by_order(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source), store, str(tmp_path / "ck"))
        query.awaitTermination()
        # nothing is remembered between batches but the store
        assert all(not p["stateOperators"] for p in map(lambda p: json.loads(p.json), query.recentProgress))

    run([("a", 5, 1), ("b", 9, 2)])
    run([("a", 3, 3), ("c", 1, 4), ("a", 8, 5)])
    run([("b", 9_000_000, 6)])
    assert sorted(tuple(r) for r in store.read().collect()) == [("a", 3, 3), ("b", 9, 2), ("c", 1, 4)]
    store.compact()
    run([("b", 2, 7)])
    assert sorted(tuple(r) for r in store.read().collect()) == [("a", 3, 3), ("b", 2, 7), ("c", 1, 4)]
    with pytest.raises(ValueError):
        inc.first_by_order(spark.readStream.schema(EVENT).parquet(source), KeyedStore(spark, "x", EVENT, ["k"], "first"), "y")
