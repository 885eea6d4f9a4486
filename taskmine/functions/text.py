"""String columns: trimming, excerpts, log cleaning, dates, byte decoding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from taskmine import defaults as d


def strip(text: Column) -> Column:
    """Trim every Unicode white-space character (SQL ``trim`` knows only the blank)."""
    return F.btrim(text, F.lit(d.WHITESPACE))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def non_empty(text: Column) -> Column:
    """True only for a present, non-empty string; never null."""
    return F.length(or_empty(text)) > 0


def excerpt(text: Column, limit: int | None = None, suffix: str = d.README_SUFFIX) -> Column:
    """The first ``limit`` characters (None: all), marked with ``suffix`` when something was cut."""
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(suffix))).otherwise(text)


def preview(text: Column, limit: int) -> Column:
    """The first ``limit`` characters, always followed by dots."""
    return F.concat(F.left(text, F.lit(limit)), F.lit("..."))


def without_colours(log: Column) -> Column:
    return F.regexp_replace(log, d.ANSI_COLOUR, "")


def from_marker(text: Column, marker: str) -> Column:
    """``text`` from the first ``marker`` on; the whole text when it is absent."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substr(text, at)).otherwise(text)


def normalised_code(code: Column) -> Column:
    """Code with every line trimmed and blank lines dropped."""
    trimmed = F.transform(F.split(code, "\n"), strip)
    return F.array_join(F.filter(trimmed, lambda line: line != ""), "\n")


def fingerprint(value: Column) -> list[Column]:
    """128 bits of a value as two numbers; unlike a text digest they aggregate by hashing."""
    return [F.xxhash64(value), F.xxhash64(F.lit(1), value)]


def instant(iso: Column) -> Column:
    """ISO text with a UTC offset as a timestamp; null if unreadable or without offset."""
    has_offset = iso.rlike(r"[T ].*(Z|[+-]\d\d(:?\d\d)?)$")
    return F.when(has_offset, F.try_to_timestamp(iso))


def calendar_date(iso: Column) -> Column:
    """``yyyy-MM-dd`` as written in an ISO time stamp; other text stays, null becomes ''."""
    readable = iso.rlike(r"^\d{4}-\d\d-\d\d") & F.try_to_timestamp(iso).isNotNull()
    return or_empty(F.when(readable, F.left(iso, F.lit(10))).otherwise(iso))


# One well-formed UTF-8 sequence, seen as Latin-1 characters (one per byte).
_UTF8_SEQUENCE = (
    r"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]"
    r"|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    r"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)


def utf8_lossy(data: Column) -> Column:
    """Decode bytes as UTF-8, dropping (not replacing) whatever is not UTF-8."""
    text = data.cast("string")
    one_char_per_byte = F.decode(data, "ISO-8859-1")
    kept = F.regexp_replace(one_char_per_byte, f"(?s)({_UTF8_SEQUENCE})|.", "$1")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.encode(kept, "ISO-8859-1").cast("string"))


def landed_content(encoding: Column, content: Column) -> Column:
    """Text of a landed file answer; null unless it is readable base64."""
    # answers wrap their base64 into lines; whatever is not of the alphabet is skipped
    letters = F.regexp_replace(content, "[^A-Za-z0-9+/=]", "")
    return F.when(encoding == "base64", utf8_lossy(F.try_to_binary(letters, F.lit("base64"))))
