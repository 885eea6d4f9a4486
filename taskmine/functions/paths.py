"""The different "is this a test file" rules, and other path predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from taskmine import defaults as d


def any_of(patterns: list[str], anchored: bool = False) -> str:
    """One regular expression out of several; ``anchored`` matches from the start only."""
    joined = "|".join(patterns)
    return f"(?d)^(?:{joined})" if anchored else f"(?d){joined}"


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(value) for value in values])


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def top_component(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def is_test_name(name: Column, patterns: list[str] = d.TEST_FILE_PATTERNS) -> Column:
    return name.rlike(any_of(patterns, anchored=True))


def is_test_file(
    path: Column,
    directories: list[str] = d.TEST_DIRECTORIES,
    patterns: list[str] = d.TEST_FILE_PATTERNS,
) -> Column:
    """Rule for pull-request files: a whole path component, or the file name."""
    in_directory = F.arrays_overlap(F.split(F.lower(path), "/"), literal_array(directories))
    return in_directory | is_test_name(file_name(path), patterns)


def is_test_patch(path: Column, patterns: list[str] = d.PATCH_TEST_PATTERNS) -> Column:
    """Rule for diff files: a pattern anywhere in the lower-cased path."""
    # a search finds the same without a leading ".*", which would only be tried at every place
    bare = [re.sub(r"^\.\*(?![?+])", "", pattern) for pattern in patterns]
    return F.lower(path).rlike(any_of(bare))


def is_source_file(path: Column) -> Column:
    return path.endswith(".py") & ~is_test_file(path)
