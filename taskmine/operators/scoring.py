"""Agent results: patches, tokens, outcomes, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taskmine import defaults as d
from taskmine.functions import text
from taskmine.operators.labels import label_list
from taskmine.operators.ranking import keep_first_but_all_without_id, keep_one

RESULT_KEY = ["agent", "model", "instance_id"]
LISTS = ["passed_f2p_tests", "passed_p2p_tests", "expected_f2p_tests", "expected_p2p_tests"]

# --- fixed value -----------------------------------------------------------
NO_PATCH = "Agent failed to generate valid patches"


def first_patches(patches: DataFrame, order: str = "seq") -> DataFrame:
    """The first landed patch of each agent, model and instance."""
    first = keep_one(patches, RESULT_KEY, [order], "first") if order in patches.columns else patches.dropDuplicates(RESULT_KEY)
    return first.select(*RESULT_KEY, "model_patch")


def with_patches(specs: DataFrame, patches: DataFrame) -> DataFrame:
    """Each spec with the first patch landed for it; without one it carries an error."""
    first = keep_one(patches, ["instance_id"], ["seq"], "first").select("instance_id", "model_patch")
    joined = specs.join(first, "instance_id", "left")
    return joined.withColumn("error", F.when(F.col("model_patch").isNull(), F.lit(NO_PATCH)))


def total_tokens(log: Column) -> Column:
    """Token count of an agent log; null when the summary or the number is missing."""
    clean = text.without_colours(log)
    lines = F.transform(F.split(text.from_marker(clean, d.TOKENS_MARKER), "\n"), text.strip)
    counted = F.filter(lines, lambda line: line.startswith(d.TOKENS_LINE) & line.rlike(d.TOKENS_VALUE))
    number = F.regexp_extract(F.get(counted, F.lit(0)), d.TOKENS_VALUE, 1)
    return F.when(F.instr(clean, d.TOKENS_MARKER) > 0, number.try_cast("bigint"))


def all_passed(expected: Column, passed: Column) -> Column:
    """Every expected test is among the passed ones; true when nothing is expected."""
    return F.size(F.array_except(expected, passed)) == 0


def outcomes(results: DataFrame) -> DataFrame:
    """Success flags from the expected label texts and the passed test lists."""
    passed = lambda name: F.coalesce(name, F.array().cast("array<string>"))
    flagged = results.withColumns({
        "success_f2p": all_passed(label_list(F.col("expected_f2p")), passed("passed_f2p")),
        "success_p2p": all_passed(label_list(F.col("expected_p2p")), passed("passed_p2p")),
    })
    return flagged.withColumn("success", F.col("success_f2p") & F.col("success_p2p"))


def outcomes_of_tests(expected: DataFrame, statuses: DataFrame) -> DataFrame:
    """Success flags from rows, without gathering test lists.

    ``expected`` has (agent, model, instance_id, label, test), ``statuses`` the status
    seen for each of them.
    """
    seen = expected.join(statuses, [*RESULT_KEY, "label", "test"], "left")
    missed = lambda label: F.bool_or((F.col("label") == label) & F.coalesce(F.col("status") != "PASSED", F.lit(True)))
    flags = seen.groupBy(*RESULT_KEY).agg(
        (~missed("FAIL_TO_PASS")).alias("success_f2p"), (~missed("PASS_TO_PASS")).alias("success_p2p")
    )
    return flags.withColumn("success", F.col("success_f2p") & F.col("success_p2p"))


def test_lists(statuses: DataFrame) -> DataFrame:
    """Expected and passed tests of each pair and label, sorted (for the stored record)."""
    of = lambda label, more: F.array_sort(F.collect_list(F.when((F.col("label") == label) & more, F.col("test"))))
    passed = F.col("status") == "PASSED"
    return statuses.groupBy(*RESULT_KEY).agg(
        of("FAIL_TO_PASS", passed).alias(LISTS[0]), of("PASS_TO_PASS", passed).alias(LISTS[1]),
        of("FAIL_TO_PASS", F.lit(True)).alias(LISTS[2]), of("PASS_TO_PASS", F.lit(True)).alias(LISTS[3]))


def append_results(old: DataFrame, new: DataFrame, order: list[str], compat: bool = False) -> DataFrame:
    """Old and new results, the first per key kept; rows without an instance all stay.

    A stored row always comes before a new one; ``order`` counts within a side.
    ``compat`` keys by instance alone, which lets one agent's row hide another's.
    """
    keys = ["instance_id"] if compat else RESULT_KEY
    sided = lambda rows, side: rows.withColumn("_side", F.lit(side))
    united = sided(old, 0).unionByName(sided(new, 1), allowMissingColumns=True)
    return keep_first_but_all_without_id(united, keys, "instance_id", ["_side", *order]).drop("_side")
