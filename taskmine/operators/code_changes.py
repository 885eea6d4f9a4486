"""Changed tests between two versions of a file, selectors and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taskmine import defaults as d
from taskmine.functions import source_code, text
from taskmine.operators.ranking import dealt, numbered_in_blocks

TYPES = ["function", "class", "method"]
TASKS = 4  # tasks that group elements, times the usual number: a group is far larger than its compressed elements

# --- fixed values: report texts -------------------------------------------
HEADINGS = {"added": "🟢 Added:", "modified": "🟡 Modified:", "deleted": "🔴 Deleted:"}
TEST_HEADINGS = {"added": "🟢 Added tests:", "modified": "🟡 Modified tests:", "deleted": "🔴 Deleted tests:"}
NO_CHANGES = "No changes detected in classes or functions."
NO_TEST_CHANGES = "No pytest-related test changes detected."
TEST_TITLE = "🧪 Pytest test changes:\n" + "=" * 40
HINT_TITLE = "\n💡 Suggested pytest run commands:\n" + "-" * 30
HINT_FUNCTIONS = "Run specific test functions:"
HINT_METHODS = "Run specific test methods:"


def code_elements(files: DataFrame, source: str) -> DataFrame:
    """Classes, functions and methods of each file with their lines; one row each."""
    keys = [name for name in files.columns if name != source]
    return source_code.with_elements(files, {"_elements": F.col(source)}).select(*keys, F.inline("_elements"))


def unreadable_pairs(pairs: DataFrame, before: str = "before_src", after: str = "after_src") -> DataFrame:
    """Keys of the pairs of which a side is Python text that the parser cannot take in."""
    keys = [name for name in pairs.columns if name not in (before, after)]
    side = lambda name, column: source_code.definitions(source_code.candidate(F.col(column))).alias(name)
    return pairs.select(*keys, side("_b", before), side("_a", after)).where("_b is null or _a is null").select(*keys)


def code_changes(pairs: DataFrame, before: str = "before_src", after: str = "after_src") -> DataFrame:
    """Added, deleted and modified elements of each pair of sources.

    Both sides become element rows that meet in one aggregate per (file, name), with a
    fingerprint in place of the body. The pairs are dealt by their keys before they are parsed,
    so no task lists the elements of a whole small file, and the elements by (file, name) before
    they are grouped, so no task groups as many as pack into a usual shuffle read.
    A pair with a side too deep to parse is left out; ``unreadable_pairs`` lists those.
    """
    keys = [name for name in pairs.columns if name not in (before, after)]
    parsed = source_code.with_elements(dealt(pairs, keys) if keys else pairs, {"_b": F.col(before), "_a": F.col(after)}).select(*keys, "_b", "_a")

    def tagged(column: str, tag: str) -> Column:
        return F.transform(column, lambda one: F.struct(
            F.lit(tag).alias("side"), one["code_type"].alias("code_type"), one["name"].alias("name"),
            text.normalised_code(one["body"]).alias("code"),
        ))

    elements = parsed.select(*keys, F.inline(F.concat(tagged("_b", "b"), tagged("_a", "a"))))
    one, two = text.fingerprint(F.col("code"))
    short = elements.select(*keys, "side", "code_type", "name", one.alias("_1"), two.alias("_2"))
    found = dealt(short, [*keys, "name"], TASKS).groupBy(*keys, "name").agg(*[
        F.max(F.when((F.col("side") == tag) & (F.col("code_type") == kind), F.col(f"_{n}"))).alias(f"_{tag}_{kind}_{n}")
        for tag in "ba" for kind in TYPES for n in (1, 2)
    ])

    appeared = lambda kind: F.col(f"_b_{kind}_1").isNull() & F.col(f"_a_{kind}_1").isNotNull()
    vanished = lambda kind: F.col(f"_b_{kind}_1").isNotNull() & F.col(f"_a_{kind}_1").isNull()

    def differs(kind: str) -> Column:
        unequal = lambda left, right: (left[0] != right[0]) | (left[1] != right[1])
        before, after = [[F.col(f"_{tag}_{kind}_{n}") for n in (1, 2)] for tag in "ba"]
        nothing = text.fingerprint(F.lit(""))  # of an element whose lines could not be cut out
        known = unequal(before, nothing) & unequal(after, nothing)
        return F.coalesce(unequal(before, after) & known, F.lit(False))

    # a name that was added or deleted as anything, or modified as an earlier type, is not reported as modified
    taken = F.lit(False)
    for kind in TYPES:
        taken = taken | appeared(kind) | vanished(kind)
    entries = []
    for kind in TYPES:
        change = F.when(appeared(kind), "added").when(vanished(kind), "deleted").when(
            differs(kind) & ~taken, "modified"
        )
        entries.append(F.struct(change.alias("change_type"), F.lit(kind).alias("code_type")))
        taken = taken | differs(kind)
    reported = F.filter(F.array(*entries), lambda entry: entry["change_type"].isNotNull())
    return found.select(*keys, "name", F.inline(reported))


def is_test_element(code_type: Column, name: Column) -> Column:
    """Test functions, and methods ``Test….test_…`` (split at the first dot)."""
    method = F.substr(name, F.instr(name, ".") + 1)
    as_method = (code_type == "method") & name.contains(".") & name.startswith("Test") & method.startswith("test_")
    return ((code_type == "function") & name.startswith("test_")) | as_method


def changed_tests(changes: DataFrame) -> DataFrame:
    """Only test functions and test methods; class rows are dropped."""
    return changes.where(is_test_element(F.col("code_type"), F.col("name")))


def test_selectors(tests: DataFrame) -> DataFrame:
    """Selector of each changed test that still exists."""
    name = F.col("name")
    method = F.concat(F.substring_index(name, ".", 1), F.lit("::"), F.substr(name, F.instr(name, ".") + 1))
    inner = F.when(F.col("code_type") == "method", method).otherwise(name)
    kept = tests.where(F.col("change_type") != "deleted")
    return kept.withColumn("selector", F.concat_ws("::", "path", inner))


def without_changed_tests(specs: DataFrame, tests: DataFrame) -> DataFrame:
    """Specs with no changed test at all; they end up processed and unlabelled.

    Merged, since the changed tests are many more than the sizes of landed files let Spark expect:
    it would broadcast all of them.
    """
    return specs.join(tests.select("instance_id").hint("merge"), "instance_id", "left_anti").select(
        "instance_id", F.lit(True).alias("processed")
    )


def selector_batches(
    selectors: DataFrame, keys: list[str], block: Column, order: list[str],
    command: str = d.TEST_COMMAND, max_chars: int | None = None, batch_size: int | None = None,
) -> DataFrame:
    """Batch number of each selector: one command unless it would get longer than ``max_chars``.

    With neither limit all selectors are one batch (``defaults.BATCH_LIMITS`` is usual).

    A run that needs batches may be huge, so positions come from ``numbered_in_blocks``
    and not from a window over the run.
    """
    numbered = numbered_in_blocks(selectors, keys, block, order, "position", F.length("selector") + 1)
    too_long = F.lit(True) if max_chars is None else F.col("position_total") + len(command) > max_chars
    batch = F.lit(0) if batch_size is None else F.when(too_long, F.floor(F.col("position") / batch_size)).otherwise(F.lit(0))
    return numbered.withColumn("batch", batch.cast("bigint")).drop("position_total")


def _listed(condition: Column, line: Column) -> Column:
    """The lines of matching rows in one text, sorted by element name; null for none."""
    entry = F.when(condition, F.struct("name", "code_type", line.alias("line")))
    lines = F.transform(F.array_sort(F.collect_list(entry)), lambda one: one["line"])
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def _sections(headings: dict[str, str]) -> list[Column]:
    line = F.concat(F.lit("  - "), F.col("code_type"), F.lit(": "), F.col("name"))
    return [
        F.concat(F.lit(heading + "\n"), _listed(F.col("change_type") == change, line))
        for change, heading in headings.items()
    ]


def _by_file(changes: DataFrame, files: DataFrame | None, keys: list[str]) -> DataFrame:
    """The changes and a row for each file, dealt by file: lists gathered before a shuffle would only hold memory."""
    rows = changes.select(*keys, "change_type", "code_type", "name")
    rows = rows if files is None else rows.unionByName(files.select(*keys), allowMissingColumns=True)
    return dealt(rows, keys, TASKS) if keys else rows


def change_report(changes: DataFrame, keys: list[str], files: DataFrame | None = None) -> DataFrame:
    """The changes of one file as text: grouped by kind of change, sorted by name.

    With ``files``, files without changes get a line that says so.
    """
    report = F.concat_ws("\n", *_sections(HEADINGS))
    grouped = _by_file(changes, files, keys).groupBy(*keys).agg(report.alias("report"))
    return grouped.withColumn("report", F.when(F.col("report") == "", F.lit(NO_CHANGES)).otherwise(F.col("report")))


def test_report(tests: DataFrame, keys: list[str], files: DataFrame | None = None) -> DataFrame:
    """The changed tests of one file as text, with a command line for each."""
    name = F.col("name")
    owner, method = F.substring_index(name, ".", 1), F.substr(name, F.instr(name, ".") + 1)
    by_node = F.concat(
        F.lit("  pytest -v -k 'test_file.py::"), owner, F.lit("::"), method, F.lit("'\n  pytest -v -k '"),
        owner, F.lit(" and "), method, F.lit("'"),
    )
    by_name = F.concat(F.lit("  pytest -v -k "), name)
    is_type = lambda kind: F.col("code_type") == kind
    report = F.concat_ws(
        "\n", F.lit(TEST_TITLE), *_sections(TEST_HEADINGS), F.lit(HINT_TITLE),
        F.concat(F.lit(HINT_FUNCTIONS + "\n"), _listed(is_type("function"), by_name)),
        F.concat(F.lit(HINT_METHODS + "\n"), _listed(is_type("method"), by_node)),
    )
    grouped = _by_file(tests, files, keys).groupBy(*keys).agg(report.alias("_text"), F.count("change_type").alias("_n"))
    shown = F.when(F.col("_n") > 0, F.col("_text")).otherwise(F.lit(NO_TEST_CHANGES))
    return grouped.select(*keys, shown.alias("report"))


def run_hints(tests: DataFrame) -> DataFrame:
    """A command line for every changed test."""
    name = F.col("name")
    by_name = F.concat(F.lit("pytest -v -k "), name, F.lit(" "), F.col("path"))
    by_node = F.concat(
        F.lit("pytest -v "), F.col("path"), F.lit("::"), F.substring_index(name, ".", 1), F.lit("::"),
        F.substr(name, F.instr(name, ".") + 1),
    )
    return tests.withColumn("command", F.when(F.col("code_type") == "method", by_node).otherwise(by_name))
