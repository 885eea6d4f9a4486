"""Unified diffs: parse into files, filter, rebuild, tally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taskmine.functions import paths, text

# --- fixed values: diff syntax --------------------------------------------
HEADER = r"(?d)^diff --git a/(.*?) b/(.*)"
FILE_BOUNDARY = r"\n(?=diff --git)"
MARKERS = {"new file mode": "added", "deleted file mode": "removed", "rename from": "renamed"}
TEMPLATES = {
    "added": "diff --git a/{new} b/{new}\nnew file mode 100644\nindex 0000000..1111111\n"
             "--- /dev/null\n+++ b/{new}\n{body}\n",
    "removed": "diff --git a/{new} b/{new}\ndeleted file mode 100644\nindex 1111111..0000000\n"
               "--- a/{new}\n+++ /dev/null\n{body}\n",
    "renamed": "diff --git a/{old} b/{new}\nsimilarity index 100%\nrename from {old}\n"
               "rename to {new}\n{body}\n",
    "modified": "diff --git a/{new} b/{new}\nindex 1111111..2222222 100644\n"
                "--- a/{new}\n+++ b/{new}\n{body}\n",
}


def _status(piece: Column, leading: int | None) -> Column:
    """Status by the first marker before the first hunk, or among so many leading lines; the first line is the header."""
    head = F.substring_index(piece, "\n", leading) if leading is not None else F.substring_index(piece, "\n@@", 1)
    first = F.regexp_extract(head, r"\n(" + "|".join(MARKERS) + ")", 1)
    status = F
    for marker, name in MARKERS.items():
        status = status.when(first == marker, F.lit(name))
    return status.otherwise(F.lit("modified"))


def _hunks(piece: Column) -> Column:
    """Lines that belong to hunks, from the first ``@@`` on; "no newline" notes anywhere.

    Other lines are cut out of the text, so a piece is never taken apart into lines.
    """
    at = F.instr(piece, "\n@@")
    body = F.regexp_replace(F.substr(piece, at), r"\n(?!@@|[-+ \\\n]|\z)[^\n]*+", "")
    head = F.substring_index(piece, "\n@@", 1)
    notes = F.when(F.contains(head, F.lit("\n\\")), F.regexp_replace(F.concat(F.lit("\n"), head), r"\n(?!\\)[^\n]*+", "")).otherwise("")
    return F.substr(F.concat(notes, F.when(at > 0, body).otherwise("")), F.lit(2))


def parse_diffs(diffs: DataFrame, column: str = "diff", marker_lines: int | None = None) -> DataFrame:
    """One row per file of each diff; pieces without a header are dropped.

    The status is looked for in the whole header, or in ``marker_lines`` lines of it.
    """
    keys = [name for name in diffs.columns if name != column]
    pieces = diffs.select(*keys, F.posexplode(F.split(column, FILE_BOUNDARY)).alias("piece", "_text"))
    trimmed = pieces.select(*keys, "piece", text.strip(F.col("_text")).alias("_text"))
    header = F.substring_index("_text", "\n", 1)
    headed = trimmed.where(header.rlike(HEADER)).select(
        *keys, "piece", "_text",
        F.regexp_extract(header, HEADER, 1).alias("_old"), F.regexp_extract(header, HEADER, 2).alias("_new"),
    )
    parsed = headed.withColumn("status", _status(F.col("_text"), marker_lines))
    named = parsed.withColumn("filename", F.when(F.col("status") == "removed", F.col("_old")).otherwise(F.col("_new")))
    both = (F.col("_old") != "") & (F.col("_new") != "")
    return named.where(both | (F.col("filename") != "")).select(
        *keys, "piece", "filename", "status",
        F.when(F.col("status") == "renamed", F.col("_old")).alias("old_filename"),
        _hunks(F.col("_text")).alias("patch_content"),
        paths.is_test_patch(F.col("filename")).alias("is_test_file"),
    )


def usable_changes(changes: DataFrame) -> DataFrame:
    """File changes with a name, a patch and a status; the others cannot be applied."""
    complete = text.non_empty(F.col("filename")) & text.non_empty(F.col("patch")) & text.non_empty(F.col("status"))
    return changes.where(complete).withColumn("is_test_file", paths.is_test_patch(F.col("filename")))


def filter_patches(patches: DataFrame, include_test: bool = True, include_source: bool = True) -> DataFrame:
    wanted = F.when(F.col("is_test_file"), F.lit(include_test)).otherwise(F.lit(include_source))
    return patches.where(wanted)


def complete_diff(filename: Column, status: Column, body: Column, old_filename: Column) -> Column:
    """A self-contained diff of one file; an unknown status counts as modified."""
    from taskmine.operators.changes import fill

    old = F.when(text.non_empty(old_filename), old_filename).otherwise(filename)
    slots = {"old": old, "new": filename, "body": body}
    built = F
    for name in ("added", "removed", "renamed"):
        built = built.when(status == name, fill(TEMPLATES[name], slots))
    return built.otherwise(fill(TEMPLATES["modified"], slots))


def rebuild(patches: DataFrame) -> DataFrame:
    diff = complete_diff(F.col("filename"), F.col("status"), F.col("patch_content"), F.col("old_filename"))
    return patches.withColumn("diff", diff)


def application_tally(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """How many files of a patch there were, how many were applied, and which."""
    applied = F.coalesce("applied", F.lit(False))
    ordered = F.array_sort(F.collect_list(F.when(applied, F.struct("piece", "filename"))))
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("total_files_num"), F.count_if(applied).alias("applied_files_num"),
        F.transform(ordered, lambda entry: entry["filename"]).alias("applied_files"),
    )
