"""Release validity, version order and the per-repository pick."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskmine import defaults as d
from taskmine.functions import text, versions
from taskmine.operators.ranking import first_n


def valid_releases(
    releases: DataFrame,
    min_body: int = d.MIN_RELEASE_BODY_LENGTH,
    min_date: str = d.MIN_RELEASE_DATE,
    bots: list[str] = d.BOT_USERS,
) -> DataFrame:
    """Releases by people, with a substantial body, published on or after ``min_date``.

    An unknown author is not a bot; a missing, unreadable or offset-free date drops
    the release.
    """
    by_bot = F.coalesce(F.col("author_login").isin(bots), F.lit(False))
    body = text.strip(text.or_empty(F.col("body")))
    earliest = F.to_timestamp(F.lit(f"{min_date}T00:00:00Z"))
    return releases.where(~by_bot & (F.length(body) >= min_body) & (text.instant(F.col("published_at")) >= earliest))


def release_counts(valid: DataFrame, min_releases: int = d.MIN_RELEASES) -> DataFrame:
    """Repositories with enough valid releases, and how many they have."""
    counted = valid.groupBy("repo").agg(F.count("*").alias("releases_count"))
    return counted.where(F.col("releases_count") >= min_releases)


def versioned(releases: DataFrame) -> DataFrame:
    """Releases whose tag holds a version, with the version as array and as text."""
    found = releases.where(versions.has_version(F.col("tag_name")))
    parts = found.withColumn("_parts", versions.version_parts(F.col("tag_name")))
    return parts.withColumns({
        "version_tuple": versions.version_tuple(F.col("_parts")), "version_order": versions.version_order(F.col("_parts")), "version_key": versions.version_key(F.col("_parts")),
    }).drop("_parts")


def stable(releases: DataFrame) -> DataFrame:
    """Versioned releases that are not pre-releases."""
    return versioned(releases).where(~versions.is_pre_release(F.col("tag_name")))


def _order():
    return [F.desc("version_order"), F.asc("api_pos")]


def top_versions(releases: DataFrame, limit: int | None = None) -> DataFrame:
    """Releases ranked by version in each repository, all or the first ``limit``; equal versions stay in listing order."""
    return first_n(stable(releases), ["repo"], _order(), limit, rank="rank")


def latest_per_major(releases: DataFrame) -> DataFrame:
    """The highest release of each major version (an option; the default is ``top_versions``)."""
    major = stable(releases).withColumn("major", F.split_part("version_key", F.lit("."), F.lit(1)))
    return first_n(major, ["repo", "major"], _order(), 1)
