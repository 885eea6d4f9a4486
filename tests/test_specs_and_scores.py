import random

from pyspark.sql import functions as F

from taskmine.plans import label, score
from taskmine.operators import code_changes as cc, labels as lb, scoring as sc, specs as sp
from taskmine.operators.ranking import numbered_in_blocks


def test_dedup_keeps_the_last_content_at_the_first_place(spark):
    rows = [("a", 0, "x"), ("b", 1, "y"), ("a", 2, "z"), ("c", 3, None)]
    frame = spark.createDataFrame(rows, "instance_id string, spec_order int, version string")
    got = [tuple(r) for r in sp.dedup_specs(frame).orderBy("spec_order").select("instance_id", "version").collect()]
    assert got == [("a", "z"), ("b", "y"), ("c", None)]


def test_limits_come_before_filters(spark):
    rows = [("r", i, f"i{i}", i < 2, None if i % 2 else "t", None) for i in range(5)]
    frame = spark.createDataFrame(rows, "repo string, seq int, instance_id string, processed boolean, fail_to_pass string, pass_to_pass string")
    assert [r["seq"] for r in sp.select_for_labelling(frame, per_repo=3).collect()] == [2]
    assert sorted(r["seq"] for r in sp.select_for_labelling(frame, per_repo=3, test_only=True).collect()) == [0, 2]
    done = spark.createDataFrame([("a", "m", "i0")], "agent string, model string, instance_id string")
    todo = sp.select_for_evaluation(frame, done, [("a", "m"), ("b", "m"), ("c", "m")], ["a", "b"], per_repo=3)
    assert sorted((r["instance_id"], r["agent"]) for r in todo.collect()) == [("i0", "b"), ("i2", "a"), ("i2", "b")]
    old_way = sp.select_for_evaluation(frame, done, [("a", "m"), ("b", "m")], per_repo=3, compat=True)
    assert sorted((r["instance_id"], r["agent"]) for r in old_way.collect()) == [("i2", "a"), ("i2", "b")]
    assert sp.select_for_evaluation(frame, done, [("a", "m")], ["x"]).count() == 0


def test_missing_test_files_are_empty(spark):
    specs = spark.createDataFrame([("i", ["tests/a.py", "x.md", "tests/b.py"])], "instance_id string, test_files array<string>")
    landed = spark.createDataFrame([("i", "tests/a.py", "before", None)], "instance_id string, path string, before_src string, after_src string")
    got = sorted((r["path"], r["before_src"], r["after_src"]) for r in sp.test_snapshots(sp.test_file_rows(specs), landed).collect())
    assert got == [("tests/a.py", "before", ""), ("tests/b.py", "", "")]


def test_positions_across_blocks_are_exact(spark):
    rng = random.Random(2)
    rows = sorted({(rng.choice(["hot"] * 5 + ["a", "b"]), rng.randint(0, 5000), rng.randint(0, 3)) for _ in range(3000)})
    frame = spark.createDataFrame(rows, "k string, p int, q int").repartition(7)
    got = numbered_in_blocks(frame, ["k"], F.floor(F.col("p") / 100), ["p", "q"], "n", F.lit(1))
    want, seen = set(), {}
    for k, p, q in rows:
        want.add((k, p, q, seen.setdefault(k, 0)))
        seen[k] += 1
    found = got.collect()
    assert {(r["k"], r["p"], r["q"], r["n"]) for r in found} == want
    assert all(r["n_total"] == seen[r["k"]] for r in found)


def test_batches_only_when_the_command_is_too_long(spark):
    rows = [("long", i, "x" * 40) for i in range(30)] + [("short", i, "y") for i in range(30)]
    frame = spark.createDataFrame(rows, "run string, at int, selector string")
    got = cc.selector_batches(frame, ["run"], F.floor(F.col("at") / 7), ["at"], command="c" * 10, max_chars=41 * 30, batch_size=12)
    batches = {(r["run"], r["at"]): r["batch"] for r in got.collect()}
    assert {batches["short", i] for i in range(30)} == {0}
    assert [batches["long", i] for i in range(30)] == [i // 12 for i in range(30)]
    exact = cc.selector_batches(frame, ["run"], F.floor(F.col("at") / 7), ["at"], command="c" * 10, max_chars=41 * 30 + 10, batch_size=12)
    assert {r["batch"] for r in exact.collect()} == {0}


def test_tokens(column):
    good = "a\n\x1b[1mExecution Summary\x1b[0m\n  │ Total Tokens   │ 123 │"
    assert column(sc.total_tokens, [good, "│ Total Tokens │ 5 │", "Execution Summary", "Execution Summary\n│ Total Tokens │ x │\n│ Total Tokens │ 7 │", None]) == [123, None, None, 7, None]


def test_outcomes(spark):
    rows = [(1, "a, b", ["a", "b", "c"], None, []), (2, "a, b", ["a"], "", None), (3, None, [], "c", ["c"])]
    frame = spark.createDataFrame(rows, "i int, expected_f2p string, passed_f2p array<string>, expected_p2p string, passed_p2p array<string>")
    got = {r["i"]: (r["success_f2p"], r["success_p2p"], r["success"]) for r in sc.outcomes(frame).collect()}
    assert got == {1: (True, True, True), 2: (False, True, False), 3: (True, True, True)}


def test_outcomes_from_rows(spark):
    key = "agent string, model string, instance_id string, label string, test string"
    expected = spark.createDataFrame([("a", "m", "1", "FAIL_TO_PASS", "t"), ("a", "m", "1", "PASS_TO_PASS", "u"), ("a", "m", "2", "FAIL_TO_PASS", "t")], key)
    statuses = spark.createDataFrame([("a", "m", "1", "FAIL_TO_PASS", "t", "PASSED"), ("a", "m", "1", "PASS_TO_PASS", "u", "FAILED")], key + ", status string")
    got = {r["instance_id"]: (r["success_f2p"], r["success_p2p"], r["success"]) for r in sc.outcomes_of_tests(expected, statuses).collect()}
    assert got == {"1": (True, False, False), "2": (False, True, False)}


def test_append_keeps_the_first_and_everything_without_id(spark):
    schema = "seq int, agent string, model string, instance_id string, error string"
    old = spark.createDataFrame([(0, "a", "m", "i", None), (1, "a", "m", None, "x")], schema)
    new = spark.createDataFrame([(2, "a", "m", "i"), (3, "b", "m", "i"), (4, "a", "m", None), (5, "a", "m", "")], "seq int, agent string, model string, instance_id string")
    seqs = lambda **how: sorted(r["seq"] for r in sc.append_results(old, new, ["seq"], **how).collect())
    assert seqs() == [0, 1, 3, 4, 5] and seqs(compat=True) == [0, 1, 4, 5]


def test_a_stored_result_stays_whatever_its_number(spark):
    schema = "seq int, agent string, model string, instance_id string"
    old, new = (spark.createDataFrame([(n, "a", "m", "i")], schema) for n in (5, 0))
    assert [r["seq"] for r in sc.append_results(old, new, ["seq"]).collect()] == [5]
    assert [r["seq"] for r in sc.append_results(old, new, ["seq"], compat=True).collect()] == [5]


def test_scores_of_failing_unpatched_and_doubly_patched_pairs(spark):
    key = "agent string, model string, instance_id string"
    rows = lambda data, more: spark.createDataFrame(data, f"{key}, {more}")
    todo = rows([("a", "m", i, "t::f", "t::p, t::q") for i in ("1", "2", "3")], "fail_to_pass string, pass_to_pass string")
    patches = rows([("a", "m", "1", 1, "second"), ("a", "m", "1", 0, "first"), ("a", "m", "2", 0, "only")], "seq int, model_patch string")
    attempts = rows([("a", "m", i, 0, "x.py", i == "1") for i in "12"], "piece int, filename string, applied boolean")
    log = lambda *lines: "short test summary info\n" + "\n".join(lines)
    logs = rows([("a", "m", "1", "FAIL_TO_PASS", log("PASSED t::f")), ("a", "m", "1", "PASS_TO_PASS", log("PASSED t::p", "PASSED t::q")),
                 ("a", "m", "2", "FAIL_TO_PASS", log("PASSED t::f")), ("a", "m", "2", "PASS_TO_PASS", log("PASSED t::p", "FAILED t::q"))], "label string, log string")
    agent_logs = rows([("a", "m", "1", 0, "Execution Summary\n│ Total Tokens │ 9 │"), ("a", "m", "1", 1, "x")], "seq int, log string")
    got = {r["instance_id"]: r for r in score.score_agents(todo, patches, attempts, logs, agent_logs).collect()}
    assert len(got) == 3 and [got[i]["success"] for i in "123"] == [True, False, False]
    assert got["1"]["patch_content"] == "first" and got["1"]["total_tokens"] == 9 and got["1"]["applied_files"] == ["x.py"]
    assert (got["2"]["success_f2p"], got["2"]["success_p2p"]) == (True, False)
    assert got["2"]["passed_p2p_tests"] == ["t::p"] and got["2"]["expected_p2p_tests"] == ["t::p", "t::q"]
    assert got["3"]["error"] == sc.NO_PATCH


def test_separate_runs_count_for_their_own_label(spark):
    specs = spark.createDataFrame([("i",)], "instance_id string")
    tests = spark.createDataFrame([("i", "t.py", "f", "function", "modified")], "instance_id string, path string, name string, code_type string, change_type string")
    log = lambda *lines: "short test summary info\n" + "\n".join(lines)
    runs = [("FAIL_TO_PASS", "pre", 0, log("FAILED t.py::f")), ("FAIL_TO_PASS", "post", 0, log("PASSED t.py::f")),
            ("PASS_TO_PASS", "pre", 0, log("PASSED t.py::f", "PASSED t.py::g")), ("PASS_TO_PASS", "post", 0, log("FAILED t.py::f")),
            ("PASS_TO_PASS", "post", 1, log("PASSED t.py::g"))]
    logs = spark.createDataFrame([("i", *run) for run in runs], "instance_id string, label string, phase string, batch int, log string")
    row = label.label_specs(specs, tests, logs).first()
    assert (row["fail_to_pass"], row["pass_to_pass"]) == ("t.py::f", "t.py::g")  # f fails in the parallel run


def test_first_patch_counts(spark):
    specs = spark.createDataFrame([("a",), ("b",)], "instance_id string")
    patches = spark.createDataFrame([(1, "a", "second"), (0, "a", "first")], "seq int, instance_id string, model_patch string")
    got = {r["instance_id"]: (r["model_patch"], r["error"]) for r in sc.with_patches(specs, patches).collect()}
    assert got == {"a": ("first", None), "b": (None, sc.NO_PATCH)}
