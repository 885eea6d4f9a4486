"""Version numbers inside release tags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from taskmine import defaults as d

NUMBER = "decimal(38,0)"
LARGEST = "9" * 38


def has_version(tag: Column) -> Column:
    """A tag holds a version exactly if it holds a digit; cheap enough to push to the scan."""
    return tag.rlike(r"\d")


def version_parts(tag: Column) -> Column:
    """Digits of the first dotted, dashed or underscored run of one to four numbers in a tag."""
    run = F.regexp_extract(F.coalesce(tag, F.lit("")), d.VERSION_NUMBER, 0)
    return F.filter(F.split(run, d.VERSION_SEPARATOR), lambda part: part != "")


def version_tuple(parts: Column) -> Column:
    """The parts as numbers. Arrays order element by element with the shorter prefix
    first; numbers beyond 38 digits are all the largest, so rank by ``version_order``.
    """
    return F.transform(parts, lambda part: F.coalesce(part.try_cast(NUMBER), F.lit(LARGEST).cast(NUMBER)))


def version_order(parts: Column) -> Column:
    """One text that sorts as the parts do as numbers of any length: each part without
    leading zeros behind its own length in ten digits. A shorter prefix comes first.
    """
    bare = F.transform(parts, lambda part: F.regexp_replace(part, r"^0+(?=\d)", ""))
    return F.array_join(F.transform(bare, lambda part: F.concat(F.lpad(F.length(part).cast("string"), 10, "0"), part)), ".")


def version_key(parts: Column) -> Column:
    """The parts without leading zeros, joined by dots."""
    return F.array_join(F.transform(parts, lambda part: F.regexp_replace(part, r"^0+(?=\d)", "")), ".")


def is_pre_release(tag: Column) -> Column:
    return F.lower(tag).rlike(d.PRE_RELEASE)
