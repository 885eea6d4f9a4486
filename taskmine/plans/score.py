"""From agent patches and test logs to a scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskmine.operators import diffs, labels, scoring, testlogs

KEY = scoring.RESULT_KEY


def expected_tests(todo: DataFrame) -> DataFrame:
    """Expected tests of each (agent, spec) pair, one row each."""
    both = F.array(*[
        F.struct(F.lit(label).alias("label"), labels.label_list(F.col(column)).alias("tests"))
        for label, column in ((labels.F2P, "fail_to_pass"), (labels.P2P, "pass_to_pass"))
    ])
    groups = todo.select(*KEY, F.inline(both))
    return groups.select(*KEY, "label", F.explode("tests").alias("test")).distinct()


def score_agents(todo: DataFrame, patches: DataFrame, attempts: DataFrame, logs: DataFrame,
                 agent_logs: DataFrame) -> DataFrame:
    """One result row per (agent, spec) pair still to evaluate.

    ``patches`` holds the landed patch of each agent and instance, ``attempts`` the outcome of
    applying its source files, ``logs`` the test log per label run, ``agent_logs`` the
    agent's own log. A pair without a patch becomes a short failure row. Of several
    patches or agent logs of a pair the first (by ``seq``, if there is one) counts. The
    lists of expected and passed tests and of applied files are parts of the record.
    """
    patched = todo.join(scoring.first_patches(patches), KEY, "left")
    ready = patched.where(F.length("model_patch") > 0)
    failed = patched.where(~F.coalesce(F.length("model_patch") > 0, F.lit(False)))

    expected = expected_tests(ready)
    results = testlogs.test_results(logs, [*KEY, "label"])
    statuses = testlogs.query_tests(expected, results, [*KEY, "label"])
    flags = scoring.outcomes_of_tests(expected, statuses)
    tally = diffs.application_tally(attempts, KEY)
    lists = scoring.test_lists(statuses)
    own_log = agent_logs.groupBy(*KEY).agg((F.min_by("log", "seq") if "seq" in agent_logs.columns else F.min("log")).alias("log"))
    tokens = own_log.select(*KEY, scoring.total_tokens(F.col("log")).alias("total_tokens"))

    # a pair that expects nothing passes vacuously
    passed = lambda name: F.coalesce(name, F.lit(True)).alias(name)
    scored = ready.select(*KEY, "model_patch").join(flags, KEY, "left").join(tally, KEY, "left").join(tokens, KEY, "left").join(lists, KEY, "left")
    none = F.array().cast("array<string>")
    listed = [F.coalesce(name, none).alias(name) for name in scoring.LISTS]
    done = scored.select(
        *KEY, *[passed(name) for name in ("success_f2p", "success_p2p", "success")],
        *listed, "total_tokens", "total_files_num", "applied_files_num", F.coalesce("applied_files", none).alias("applied_files"),
        F.col("model_patch").alias("patch_content"), F.lit(None).cast("string").alias("error"),
    )
    short = failed.select(*KEY, F.lit(False).alias("success"), F.lit(scoring.NO_PATCH).alias("error"))
    return done.unionByName(short, allowMissingColumns=True)


def append_scores(stored: DataFrame, todo: DataFrame, *landed: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The stored results and those of the pairs still to do; a stored row of a pair always stays."""
    return scoring.append_results(stored, score_agents(todo, *landed), order or KEY)


def source_files(patches: DataFrame) -> DataFrame:
    """The source files of agent patches; their test files are never applied."""
    parsed = diffs.parse_diffs(patches, "model_patch")
    return diffs.rebuild(diffs.filter_patches(parsed, include_test=False))
