"""Test logs: lines to results, roll-up of parametrised tests, queries, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taskmine import defaults as d
from taskmine.functions import text

# Codes fit the low bits of a long, so "last line wins" is a max of one number and the
# aggregates stay hash-based (max_by over strings would sort).
_CODES = {name: code for code, name in enumerate(d.STATUSES)}
_BITS = 3


def _code(status: Column) -> Column:
    coded = F
    for name, code in _CODES.items():
        coded = coded.when(status == name, F.lit(code))
    return coded.otherwise(F.lit(_CODES["UNKNOWN"]))


def _name(code: Column) -> Column:
    named = F
    for name, number in _CODES.items():
        named = named.when(code == number, F.lit(name))
    return named


def packed(order: str, status: str) -> Column:
    """Line number and status in one number that orders by line."""
    return F.shiftleft(F.col(order).cast("bigint"), _BITS).bitwiseOR(_code(F.col(status)))


def unpacked(column: str) -> Column:
    """The status out of a packed number; null stays null."""
    return _name(F.col(column) % (1 << _BITS))


def base_name(path: Column) -> Column:
    """Test path without its parameters."""
    return F.substring_index(path, "[", 1)


def log_lines(logs: DataFrame, column: str = "log") -> DataFrame:
    """Numbered, trimmed lines from the summary section on (from the start when there is none)."""
    keys = [name for name in logs.columns if name != column]
    section = text.from_marker(text.without_colours(F.col(column)), d.SUMMARY_MARKER)
    lines = logs.select(*keys, F.posexplode(F.split(section, "\n")).alias("line_no", "_line"))
    return lines.select(*keys, "line_no", text.strip(F.col("_line")).alias("line"))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Status and test path of every result line."""
    keys = [name for name in lines.columns if name != "line"]
    # a trimmed line that begins so has a path; the full pattern then runs on result lines only
    rows = lines.where(F.col("line").rlike(d.RESULT_START))
    status = F.regexp_extract("line", "^[A-Z]+", 0)
    path = text.strip(F.regexp_extract("line", d.RESULT_LINE, 2))
    return rows.select(*keys, status.alias("status"), path.alias("test_path"))


def last_status(parsed: DataFrame, run: list[str], order: str = "line_no") -> DataFrame:
    """One status per test path of a run: that of its last line."""
    kept = parsed.groupBy(*run, "test_path").agg(F.max(packed(order, "status")).alias("_last"))
    return kept.select(*run, "test_path", unpacked("_last").alias("status"))


def test_results(logs: DataFrame, run: list[str]) -> DataFrame:
    """Status of every test of every run."""
    return last_status(parsed_lines(log_lines(logs.select(*run, "log"))), run)


def results_of_lines(lines: DataFrame, run: list[str]) -> DataFrame:
    """The same for logs landed line by line (``line_no``, ``line``), for logs too long for a cell.

    The marker position is one number per run; a test counts if its last line is behind
    it. Lines become tests before the two meet, so a hot run meets it with its tests only.
    """
    clean = lines.select(*run, "line_no", text.without_colours(F.col("line")).alias("line"))
    marked = clean.where(F.col("line").contains(d.SUMMARY_MARKER))
    start = marked.groupBy(*run).agg(F.min("line_no").alias("_start"))
    parsed = parsed_lines(clean.select(*run, "line_no", text.strip(F.col("line")).alias("line")))
    kept = parsed.groupBy(*run, "test_path").agg(F.max(packed("line_no", "status")).alias("_last"), F.max("line_no").alias("_line"))
    after = kept.join(start, run, "left").where(F.col("_start").isNull() | (F.col("_line") > F.col("_start")))
    return after.select(*run, "test_path", unpacked("_last").alias("status"))


# Roll-up of parametrised tests: the worst kind decides, and a skip only counts when
# nothing passed.
_SEVERITY = {"SKIPPED": 0, "PASSED": 1, "FAILED": 2}


def severity(status: Column) -> Column:
    ranked = F.when(status == "SKIPPED", _SEVERITY["SKIPPED"]).when(status == "PASSED", _SEVERITY["PASSED"])
    return ranked.when(status.isNotNull(), _SEVERITY["FAILED"])


def rolled_up(level: Column) -> Column:
    named = F
    for name, number in _SEVERITY.items():
        named = named.when(level == number, F.lit(name))
    return named


def base_status(results: DataFrame, run: list[str]) -> DataFrame:
    """Status of each test over all its parameters."""
    levels = results.groupBy(*run, base_name(F.col("test_path")).alias("base")).agg(
        F.max(severity(F.col("status"))).alias("_level")
    )
    return levels.select(*run, "base", rolled_up(F.col("_level")).alias("status"))


def tests_by_status(results: DataFrame, run: list[str], statuses: list[str] | None = None) -> DataFrame:
    """Tests whose rolled-up status is one of ``statuses`` (passed ones by default)."""
    return base_status(results, run).where(F.col("status").isin(statuses or ["PASSED"]))


def query_tests(expected: DataFrame, results: DataFrame, run: list[str]) -> DataFrame:
    """Status of each expected test: exact path first, else rolled up, else UNKNOWN."""
    exact = results.select(*run, F.col("test_path").alias("test"), F.col("status").alias("_exact"))
    rolled = base_status(results, run).select(*run, F.col("base").alias("_base"), F.col("status").alias("_rolled"))
    keyed = expected.withColumn("_base", base_name(F.col("test")))
    joined = keyed.join(exact, [*run, "test"], "left").join(rolled, [*run, "_base"], "left")
    status = F.coalesce("_exact", "_rolled", F.lit("UNKNOWN"))
    return joined.select(*expected.columns, status.alias("status"))


def check_all(queried: DataFrame, run: list[str], statuses: list[str] | None = None) -> DataFrame:
    """Do all expected tests of a run have one of ``statuses``? With the statuses seen."""
    return queried.groupBy(*run).agg(
        F.bool_and(F.col("status").isin(statuses or ["PASSED"])).alias("all_expected"),
        F.map_from_entries(F.collect_set(F.struct("test", "status"))).alias("actual"),
    )


def find_by_pattern(results: DataFrame, pattern: str) -> DataFrame:
    """Tests matching a pattern: a regular expression if it has a special character, else a substring."""
    special = any(char in pattern for char in r".*+?^${}[]|()\/")
    path = F.col("test_path")
    return results.where(path.rlike(pattern) if special else path.contains(pattern))


def find_by_base_name(results: DataFrame, part: str) -> DataFrame:
    return results.where(base_name(F.col("test_path")).contains(part))


def status_summary(statuses: DataFrame, runs: DataFrame, run: list[str]) -> DataFrame:
    """Tests per status of each run, zeros included, also for runs without any result."""
    empty = runs.select(*run, F.lit(None).cast("string").alias("status"))
    rows = statuses.select(*run, "status").unionByName(empty)
    counted = rows.groupBy(*run).agg(*[
        F.count_if(F.col("status") == name).alias(name) for name in d.STATUSES
    ])
    pairs = F.array(*[F.struct(F.lit(name).alias("status"), F.col(name).alias("tests")) for name in d.STATUSES])
    return counted.select(*run, F.inline(pairs))


def matched_in_batches(expected: DataFrame, logs: DataFrame, run: list[str], statuses: list[str] | None = None) -> DataFrame:
    """Tests of a batched run that match: each batch is judged on its own log, matches are united."""
    results = test_results(logs, [*run, "batch"])
    queried = query_tests(expected, results, [*run, "batch"])
    return queried.where(F.col("status").isin(statuses or ["PASSED"])).select(*run, "test").distinct()


def joined_batch_logs(logs: DataFrame, run: list[str]) -> DataFrame:
    """The log of a batched run in one piece, batches in order (for export)."""
    ordered = F.array_sort(F.collect_list(F.struct("batch", "log")))
    return logs.groupBy(*run).agg(F.array_join(F.transform(ordered, lambda one: one["log"]), "\n").alias("log"))
