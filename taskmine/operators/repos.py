"""Repository listings, screening and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from taskmine import defaults as d
from taskmine.functions import paths, text
from taskmine.operators.ranking import ranked

ONE_TASK_RANKS = 1_000


def rank_candidates(
    listing: DataFrame,
    min_stars: int = d.MIN_STARS,
    rank_start: int = d.RANK_START,
    rank_end: int = d.RANK_END,
) -> DataFrame:
    """Repositories ranked by stars (ties in listing order), from rank to rank.

    Up to ``ONE_TASK_RANKS`` ranks a window in one task runs on what a distributed top-k
    leaves; beyond that rows are ranked by ranges (``ranking.ranked``).
    """
    order = [F.desc("stargazers_count"), F.asc("api_pos")]
    known = listing.where(F.col("stargazers_count") >= min_stars)
    if rank_end <= ONE_TASK_RANKS:
        head = known.orderBy(*order).limit(rank_end)
        numbered = head.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    else:
        numbered = ranked(known, order, "rank").withColumn("rank", F.col("rank").cast("int"))
    return numbered.where(F.col("rank").between(rank_start, rank_end))


def detail_lookup(names: DataFrame, details: DataFrame) -> DataFrame:
    """The listed names with their details; unknown repositories are dropped."""
    found = names.join(details, "full_name")
    return found.select(
        "full_name", "stargazers_count", "size",
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
        text.or_empty(F.col("language")).alias("language"),
        *[F.coalesce(flag, F.lit(False)).alias(flag) for flag in ("archived", "disabled", "fork")],
    )


def unprocessed(repos: DataFrame, processed: DataFrame) -> DataFrame:
    """Repositories that are not in the store yet."""
    return repos.join(processed.select("full_name"), "full_name", "left_anti")


def with_processed(processed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored records and new ones together."""
    return processed.unionByName(fresh, allowMissingColumns=True)


def without_topics(repos: DataFrame, excluded: list[str] = d.EXCLUDED_TOPICS) -> DataFrame:
    hit = F.arrays_overlap("topics", paths.literal_array(excluded))
    return repos.where(~F.coalesce(hit, F.lit(False)))


def tested_repos(files: DataFrame, words: list[str] = d.TEST_DIRECTORIES) -> DataFrame:
    """Repositories with a test file at the root or Python code under a test-like root directory."""
    path, top = F.col("path"), F.lower(paths.top_component(F.col("path")))
    at_root = ~path.contains("/")
    test_like = top.rlike("|".join(words))
    name = paths.file_name(path)
    evidence = F.when(at_root, paths.is_test_name(name)).otherwise(
        test_like & (name.endswith(".py") | paths.is_test_name(name))
    )
    return files.groupBy("repo").agg(F.bool_or(evidence).alias("has_tests"))


def readmes(files: DataFrame) -> DataFrame:
    """The first README in listing order of each repository that has one."""
    is_readme = F.lower("path").isin(d.README_NAMES)
    reachable = text.non_empty(F.col("download_url"))
    first = F.min_by("content", "pos").alias("readme_content")
    return files.where(is_readme & reachable).groupBy("repo").agg(first)


def ci_configs(files: DataFrame) -> DataFrame:
    """Workflow files and where to fetch them, one row per file (the last one listed counts)."""
    path = F.col("path")
    direct = F.substring_index(path, "/", 2) == d.WORKFLOW_DIR
    depth = F.size(F.split(path, "/")) == 3
    named = path.endswith(".yml") | path.endswith(".yaml")
    reachable = text.non_empty(F.col("download_url"))
    rows = files.where(direct & depth & named & reachable)
    return rows.groupBy("repo", "path").agg(F.max_by("download_url", "pos").alias("download_url"))


def test_dirs(files: DataFrame) -> DataFrame:
    """Directories to run tests in: those at the root, else deeper ones, else a default.

    One row per directory. Whether a repository has a root directory is a flag
    aggregated per repository; the directory lists are never gathered.
    """
    wanted = paths.literal_array(d.TEST_RUN_DIRECTORIES)
    parts = F.split("path", "/")
    top = paths.top_component(F.col("path"))
    at_root = F.col("path").contains("/") & top.isin(d.TEST_RUN_DIRECTORIES)
    per_repo = files.groupBy("repo").agg(F.bool_or(at_root).alias("has_root"))

    depths = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: (n < F.size(parts)) & F.array_contains(wanted, F.get(parts, n - 1)),
    )
    deep = files.where(~top.isin(d.TEST_RUN_IGNORED)).select(
        "repo", parts.alias("_parts"), F.explode(depths).alias("_depth")
    )
    directory = F.array_join(F.slice("_parts", F.lit(1), F.col("_depth")), "/")
    found = deep.select(
        F.col("repo").alias("_repo"), (F.col("_depth") == 1).alias("_root"),
        # the leading "./" of a listing goes, and with it the dot of a hidden directory
        F.regexp_replace(directory, r"^[./]+", "").alias("_dir"),
    ).distinct()
    match = (F.col("repo") == F.col("_repo")) & (F.col("has_root") == F.col("_root"))
    joined = per_repo.join(found, match, "left")
    return joined.select("repo", F.coalesce("_dir", F.lit(d.TEST_RUN_FALLBACK)).alias("test_dir"))


def python_versions(repos: DataFrame, versions: DataFrame, default: str = d.DEFAULT_PYTHON_VERSION) -> DataFrame:
    """Recommended interpreter per repository, or the default."""
    recommended = versions.select("full_name", "python_version")
    joined = repos.select("full_name").join(recommended, "full_name", "left")
    return joined.select("full_name", F.coalesce("python_version", F.lit(default)).alias("python_version"))


def assemble(qualified: DataFrame, top_releases: DataFrame, readme: DataFrame, workflows: DataFrame) -> DataFrame:
    """Repository records; a repository without any usable release gives none.

    Nested lists are bounded: releases by the per-repository limit, workflow files
    by one directory listing.
    """
    release = F.struct(
        "rank", "tag_name", "name", "body", "published_at", "target_commitish", "version_tuple", "version_key"
    )
    releases = top_releases.groupBy("repo").agg(F.array_sort(F.collect_list(release)).alias("major_releases"))
    configs = workflows.groupBy("repo").agg(
        F.map_from_entries(F.collect_list(F.struct("path", "download_url"))).alias("ci_configs")
    )
    record = qualified.withColumn("repo", F.col("full_name")).join(releases, "repo")
    record = record.join(readme, "repo", "left").join(configs, "repo", "left")
    return record.select(
        "full_name", "stargazers_count", "size", "topics", "releases_count", "major_releases",
        text.or_empty(F.col("readme_content")).alias("readme_content"),
        F.coalesce("ci_configs", F.create_map().cast("map<string,string>")).alias("ci_configs"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("processed_at"),
    )
