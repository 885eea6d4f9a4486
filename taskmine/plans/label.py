"""Which tests a task spec changes, and which of them its patch repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskmine import defaults as d
from taskmine.operators import code_changes as cc, labels, specs as sp
from taskmine.sources.stages import staged

RUN = ["instance_id", "label", "phase", "batch"]


def changed_tests(specs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Changed test functions and methods of each spec, one row each."""
    files = sp.test_file_rows(specs)
    return cc.changed_tests(cc.code_changes(sp.test_snapshots(files, snapshots)))


def label_specs(specs: DataFrame, tests: DataFrame, logs: DataFrame) -> DataFrame:
    """Specs with their label texts. A spec without changed tests is only marked processed.

    ``logs`` has a row per instance and phase, or per instance, label, phase and batch.
    Specs whose tests were all deleted have no selector and get no FAIL_TO_PASS.
    """
    selectors = cc.test_selectors(tests)
    with_tests = tests.select("instance_id").distinct()
    own_logs = logs.join(with_tests, "instance_id", "left_semi")
    found = labels.labels_of_selectors(selectors, own_logs)
    texts = labels.rendered(specs, found)
    plain = specs.drop("fail_to_pass", "pass_to_pass", "processed")
    return plain.join(texts, "instance_id").withColumn("processed", F.lit(True))


def run_arguments(selectors: DataFrame, directories: DataFrame, max_chars: int | None = None, batch_size: int | None = None,
                  command: str = d.TEST_COMMAND) -> DataFrame:
    """What the test runs of each instance are given: (instance_id, label, batch, position, argument).

    The changed tests run alone for FAIL_TO_PASS, the test directories for PASS_TO_PASS. A run whose
    command would get longer than ``max_chars`` is cut into batches. Arguments are ordered by digest,
    which deals even a huge run out to many tasks; instances without a changed test have no runs.
    """
    asked = selectors.select("instance_id", F.lit(labels.F2P).alias("label"), "selector").distinct()
    folders = directories.select("instance_id", F.lit(labels.P2P).alias("label"), F.col("directory").alias("selector")).distinct()
    both = asked.unionByName(folders.join(asked.select("instance_id"), "instance_id", "left_semi")).withColumn("_digest", F.md5("selector"))
    # written, since counts and rows of a block are read from it, and requests and labels from the result
    both = staged(both, "run-selectors")
    placed = cc.selector_batches(both, ["instance_id", "label"], F.substring("_digest", 1, 3), ["_digest"], command, max_chars, batch_size)
    return staged(placed.select("instance_id", "label", "batch", "position", F.col("selector").alias("argument")), "run-arguments")


def run_requests(arguments: DataFrame, command: str = d.TEST_COMMAND) -> DataFrame:
    """One row for each run to be made: every batch before and after the patch, with its command line."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "argument")))  # what fits one command line
    line = F.concat(F.lit(command + " "), F.array_join(F.transform(ordered, lambda one: one["argument"]), " "))
    runs = arguments.groupBy("instance_id", "label", "batch").agg(F.count("*").alias("n_arguments"), line.alias("command"))
    return runs.select("instance_id", "label", F.explode(F.array(F.lit("pre"), F.lit("post"))).alias("phase"), "batch", "n_arguments", "command")


def missing_runs(requests: DataFrame, logs: DataFrame) -> DataFrame:
    """Runs whose log has not landed. An empty log has landed: its tests are unknown, not missing."""
    return requests.join(logs.select(*RUN), RUN, "left_anti")


def label_runs(specs: DataFrame, arguments: DataFrame, logs: DataFrame) -> DataFrame:
    """Specs with their label texts from separate, batched runs, ``processed`` and ``n_missing``.

    ``logs`` has a row for each run asked for; other logs do not count. A spec with a run still
    missing stays unprocessed and unlabelled; one without runs is processed and unlabelled.
    """
    requests = run_requests(arguments).select(*RUN)
    missing = missing_runs(requests, logs).groupBy("instance_id").agg(F.count("*").alias("n_missing"))
    wanted = requests.join(missing, "instance_id", "left_anti")
    own_logs = logs.join(wanted, RUN, "left_semi")
    selectors = arguments.where(F.col("label") == labels.F2P).select("instance_id", "batch", F.col("argument").alias("selector"))
    complete = selectors.join(missing, "instance_id", "left_anti")
    texts = labels.rendered(specs, labels.labels_of_selectors(complete, own_logs))
    plain = specs.drop("fail_to_pass", "pass_to_pass", "processed", "n_missing")
    joined = plain.join(texts, "instance_id").join(missing, "instance_id", "left")
    number = F.coalesce("n_missing", F.lit(0).cast("long"))
    return joined.withColumn("n_missing", number).withColumn("processed", F.col("n_missing") == 0)
