"""FAIL_TO_PASS and PASS_TO_PASS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taskmine.operators import testlogs

F2P, P2P = "FAIL_TO_PASS", "PASS_TO_PASS"


def labels_of_runs(logs: DataFrame, key: str = "instance_id") -> DataFrame:
    """Labels straight from one log before and one after the patch: (instance, label, test).

    Both phases of a test path meet in one aggregate, and both phases of a test in a
    second; each combines inside the map tasks first, so neither a hot instance nor a
    test with very many parameters lands in one task.
    """
    parsed = testlogs.parsed_lines(testlogs.log_lines(logs.select(key, "phase", "log")))
    last = lambda phase: F.max(F.when(F.col("phase") == phase, testlogs.packed("line_no", "status")))
    paths = parsed.groupBy(key, "test_path").agg(last("pre").alias("_pre"), last("post").alias("_post"))
    worst = lambda side: F.max(testlogs.severity(testlogs.unpacked(side)))
    tests = paths.groupBy(key, testlogs.base_name(F.col("test_path")).alias("test")).agg(
        worst("_pre").alias("_pre"), worst("_post").alias("_post")
    )
    status = lambda side: testlogs.rolled_up(F.col(side))
    label = F.when(status("_pre") == "FAILED", F2P).when(status("_pre") == "PASSED", P2P)
    return tests.where(status("_post") == "PASSED").select(key, label.alias("label"), "test").where("label IS NOT NULL")


def labels_of_selectors(selectors: DataFrame, logs: DataFrame, key: str = "instance_id") -> DataFrame:
    """FAIL_TO_PASS of the changed tests only, PASS_TO_PASS of all tests.

    A changed test is asked for by its selector; one that was not seen before the
    patch is UNKNOWN and therefore no FAIL_TO_PASS. Logs with a ``label`` come from
    separate runs (the changed tests alone, all tests together) and count for their own
    label only. Logs with a ``batch`` are parts of a run: each is judged by itself and what
    matches in any of them counts; selectors with a ``batch`` are looked up in theirs only.
    """
    parts = [name for name in ("batch",) if name in logs.columns]
    run = [key, "phase", *[name for name in ("label",) if name in logs.columns], *parts]
    own = [key, "phase", *parts]
    parsed = testlogs.test_results(logs, run)
    of = lambda label: (parsed.where(F.col("label") == label) if "label" in run else parsed).select(*own, "test_path", "status")
    results, all_results = of(F2P), of(P2P)
    phases = F.explode(F.array(F.lit("pre"), F.lit("post"))).alias("phase")
    placed = [name for name in parts if name in selectors.columns]
    asked = selectors.select(key, *placed, F.col("selector").alias("test"), phases).distinct()
    if parts and not placed:
        asked = asked.join(results.select(*own).distinct(), [key, "phase"])
    queried = testlogs.query_tests(asked, results, own)
    rolled = testlogs.base_status(all_results, own).withColumnRenamed("base", "test")
    failing = lambda phase, *wanted: F.bool_or((F.col("phase") == phase) & F.col("status").isin(*wanted))
    f2p = queried.groupBy(key, "test").agg(
        failing("pre", "FAILED", "ERROR").alias("_pre"), failing("post", "PASSED").alias("_post")
    )
    p2p = rolled.groupBy(key, "test").agg(
        failing("pre", "PASSED").alias("_pre"), failing("post", "PASSED").alias("_post")
    )
    pick = lambda frame, label: frame.where("_pre AND _post").select(key, F.lit(label).alias("label"), "test")
    return pick(f2p, F2P).unionByName(pick(p2p, P2P))


def label_text(tests: Column) -> Column:
    """Sorted, comma-joined test names; null for none."""
    joined = F.array_join(F.array_sort(tests), ", ")
    return F.when(joined != "", joined)


def label_list(label: Column) -> Column:
    """The names back out of a label text; null and '' give an empty list."""
    return F.filter(F.split(F.coalesce(label, F.lit("")), ", "), lambda name: name != "")


def rendered(instances: DataFrame, labels: DataFrame, key: str = "instance_id") -> DataFrame:
    """Label texts of every instance, the form task specs are exported in."""
    names = lambda label: F.collect_list(F.when(F.col("label") == label, F.col("test")))
    rows = labels.select(key, "label", "test").unionByName(
        instances.select(key, F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("test"))
    )
    return rows.groupBy(key).agg(label_text(names(F2P)).alias("fail_to_pass"), label_text(names(P2P)).alias("pass_to_pass"))
