"""Categorised release changes: prompts out, answers in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taskmine import defaults as d
from taskmine.functions import text
from taskmine.sources import schemas

# --- fixed values: answer field -> feature type --------------------------
CATEGORIES = {
    "new_features": "new_feature",
    "improvements": "improvement",
    "bug_fixes": "bug_fix",
    "other_changes": "other",
}

README_SECTION = "Project background, taken from its README:\n{readme}\n\n"
RELEASE_PROMPT = (
    "{readme_section}Sort the changes in the release notes below into new_features, improvements, "
    "bug_fixes and other_changes, and list the pull requests each change names.\n\n"
    "Version: {tag_name}\nNotes:\n{body}\n\n"
    "Answer with one JSON object. Its keys are the four category names; each holds a list of "
    'objects {"description": text, "pr_ids": [numbers as text]}. Give only pull requests that '
    "the notes name for that very change, and leave out mere version bumps."
)


def fill(template: str, slots: dict[str, Column]) -> Column:
    """A text template with ``{name}`` slots as one column; other braces stay as they are."""
    pieces, rest = [], template
    while rest:
        at, name = min(
            ((rest.find("{" + slot + "}"), slot) for slot in slots if "{" + slot + "}" in rest),
            default=(-1, ""),
        )
        if at < 0:
            pieces.append(F.lit(rest))
            break
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(text.or_empty(slots[name]))
        rest = rest[at + len(name) + 2:]
    return F.concat(*pieces)


def release_requests(
    releases: DataFrame, readme: DataFrame | None = None, template: str = RELEASE_PROMPT, readme_section: str = README_SECTION,
    readme_length: int | None = None,
) -> DataFrame:
    """One categorisation request per release, with the README (or so much of it) as context.

    Without a ``readme`` table the releases bring their own ``readme_content``.
    """
    joined = releases if readme is None else releases.join(readme.select("repo", "readme_content"), "repo", "left")
    content = text.or_empty(F.col("readme_content"))
    section = fill(readme_section, {"readme": text.excerpt(content, readme_length)})
    has_readme = F.length(text.strip(content)) > 0
    prompt = fill(template, {
        "readme_section": F.when(has_readme, section),
        "tag_name": F.col("tag_name"),
        "body": F.col("body"),
    })
    return joined.select("repo", "tag_name", prompt.alias("prompt"))


def parsed_answers(answers: DataFrame, column: str = "response") -> DataFrame:
    """Answers as four arrays; an unreadable answer gives four empty ones."""
    keys = [name for name in answers.columns if name != column]
    parsed = answers.select(*keys, F.from_json(column, schemas.RELEASE_ANSWER).alias("_answer"))
    empty = F.array().cast("array<struct<description:string,pr_ids:array<string>>>")
    return parsed.select(*keys, *[F.coalesce(f"_answer.{name}", empty).alias(name) for name in CATEGORIES])


def analysed(parsed: DataFrame) -> DataFrame:
    """The four arrays with category names, and links in place of pull-request numbers."""
    keys = [name for name in parsed.columns if name not in CATEGORIES]
    before, after = d.PR_URL.format(repo="\0", number="").split("\0")

    def entry(item: Column, feature_type: str) -> Column:
        numbers = F.coalesce(item["pr_ids"], F.array().cast("array<string>"))
        links = F.transform(numbers, lambda number: F.concat(F.lit(before), F.col("repo"), F.lit(after), number))
        description = text.or_empty(item["description"])
        return F.struct(
            F.lit(feature_type).alias("feature_type"), description.alias("description"), links.alias("pr_links")
        )

    def typed(field: str, feature_type: str) -> Column:
        return F.transform(field, lambda item: entry(item, feature_type)).alias(field)

    return parsed.select(*keys, *[typed(*category) for category in CATEGORIES.items()])


def release_changes(analyses: DataFrame) -> DataFrame:
    """One row per change, with its category, position in it, and links."""
    keys = [name for name in analyses.columns if name not in CATEGORIES]
    placed = [
        F.transform(field, lambda item, pos: F.struct(
            item["feature_type"].alias("feature_type"), pos.alias("feature_pos"),
            item["description"].alias("description"), item["pr_links"].alias("pr_links"),
        )) for field in CATEGORIES
    ]
    return analyses.select(*keys, F.inline(F.concat(*placed)))


def analysis_records(analyses: DataFrame, releases: DataFrame) -> DataFrame:
    """The stored analysis of each release (for export), with the notes it was made from."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    notes = releases.select("repo", "tag_name", F.col("body").alias("processed_body"))
    joined = analyses.join(notes, ["repo", "tag_name"], "left")
    record = F.struct(
        "tag_name", F.col("repo").alias("repo_name"), *CATEGORIES,
        text.or_empty(F.col("processed_body")).alias("processed_body"), stamp.alias("analyzed_at"),
    )
    return joined.select("repo", "tag_name", "release_pos", record.alias("original_analysis"))


def change_counts(parsed: DataFrame) -> DataFrame:
    """New features, improvements and fixes per repository, and in total (null repository)."""
    return parsed.rollup("repo").agg(
        F.count("*").alias("releases"),
        *[F.sum(F.size(name)).alias(name) for name in ("new_features", "improvements", "bug_fixes")],
    )
