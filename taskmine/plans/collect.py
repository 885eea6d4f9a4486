"""Collect repositories and their releases, and categorise release changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskmine import defaults as d
from taskmine.operators import changes, releases as rel, repos as rep, requests
from taskmine.sources.stages import staged


def candidates(
    mode: str, listing: DataFrame | None = None, names: DataFrame | None = None, details: DataFrame | None = None
) -> DataFrame:
    """Repositories to look at: ranked by ``"stars"``, or a ``"specified"`` list of names."""
    if mode == "stars":
        return rep.rank_candidates(listing)
    if mode == "specified":
        return rep.detail_lookup(names, details)
    raise ValueError(mode)


def qualify_repositories(
    candidates: DataFrame, processed: DataFrame, files: DataFrame, releases: DataFrame,
    min_releases: int = d.MIN_RELEASES, min_release_date: str = d.MIN_RELEASE_DATE,
) -> DataFrame:
    """Candidates that are new, on topic, tested, and have enough valid releases."""
    fresh = rep.without_topics(rep.unprocessed(candidates, processed))
    # the candidates are few next to all landed files and releases
    own = lambda frame: frame.join(fresh.select(F.col("full_name").alias("repo")), "repo", "left_semi")
    tested = rep.tested_repos(own(files)).where("has_tests").select(F.col("repo").alias("full_name"))
    counts = rel.release_counts(rel.valid_releases(own(releases), min_date=min_release_date), min_releases)
    return fresh.join(tested, "full_name", "left_semi").join(
        counts.withColumnRenamed("repo", "full_name"), "full_name"
    )


def build_repositories(
    qualified: DataFrame, releases: DataFrame, files: DataFrame,
    limit: int | None = None, min_release_date: str = d.MIN_RELEASE_DATE,
) -> DataFrame:
    """Records of qualified repositories: top releases, README, workflow files.

    The few qualified rows become a stage table, since every part is narrowed to them.
    """
    qualified = staged(qualified, "qualified")
    wanted = qualified.select(F.col("full_name").alias("repo"))
    own = lambda frame: frame.join(wanted, "repo", "left_semi")
    valid = rel.valid_releases(own(releases), min_date=min_release_date)
    landed = own(files)
    return rep.assemble(qualified, rel.top_versions(valid, limit), rep.readmes(landed), rep.ci_configs(landed))


def release_requests(repositories: DataFrame, analysed: DataFrame, readme_length: int | None = None, **wording: str) -> DataFrame:
    """Categorisation requests for releases without a stored analysis, one per release however often its repository is named.

    They are keyed by their prompts. ``wording``: ``template`` and ``readme_section`` of ``changes.release_requests``.
    """
    once = repositories.dropDuplicates(["full_name"])
    rows = once.select(F.col("full_name").alias("repo"), "readme_content", F.inline("major_releases"))
    return requests.keyed(changes.release_requests(cache_misses(rows, analysed), readme_length=readme_length, **wording))


def cache_misses(releases: DataFrame, analysed: DataFrame) -> DataFrame:
    """Releases without a stored analysis."""
    return releases.join(analysed.select("repo", "tag_name"), ["repo", "tag_name"], "left_anti")


def with_cached(answers: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored analyses and new ones; a stored one is never replaced. One row per release."""
    keys = ["repo", "tag_name"]
    known = stored.dropDuplicates(keys)
    fresh = answers.join(known.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return known.unionByName(fresh, allowMissingColumns=True)


def parse_release_changes(answers: DataFrame) -> DataFrame:
    """Answers to change rows with category, position and links."""
    return changes.release_changes(changes.analysed(changes.parsed_answers(answers)))
