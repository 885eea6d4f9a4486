import random
import re

from pyspark.sql import functions as F

from taskmine import defaults as d
from taskmine.functions import paths, text, versions


def test_strip_is_unicode_strip(column):
    values = ["", " a ", "\t\n b\x0b\x1c", "\xa0c\u2003", "a b", "\u200bx ", None, " \n\t"]
    assert column(text.strip, values) == [v if v is None else v.strip() for v in values]


def test_excerpt_and_preview(column):
    assert column(lambda c: text.excerpt(c, 3, "…"), ["abc", "abcd", "", None]) == ["abc", "abc…", "", None]
    assert column(lambda c: text.preview(c, 3), ["abcd", "a"]) == ["abc...", "a..."]


def test_ansi_and_marker(column):
    assert column(text.without_colours, ["\x1b[36mx\x1b[0m", "\x1b[1;31mFAILED", "\x1b[K"]) == ["x", "FAILED", "\x1b[K"]
    assert column(lambda c: text.from_marker(c, "mark"), ["a mark b mark", "none"]) == ["mark b mark", "none"]


def test_normalised_code(column):
    assert column(text.normalised_code, ["  a\n\n\t b \n", "", "\n"]) == ["a\nb", "", ""]


def test_instant_needs_an_offset(column):
    made = lambda c: F.date_format(text.instant(c), "yyyy-MM-dd HH:mm")
    values = ["2024-06-01T00:00:00Z", "2024-06-01T02:00:00+02:00", "2024-06-01T00:00:00", "2024-06-01", "", "x", None]
    assert column(made, values) == ["2024-06-01 00:00", "2024-06-01 00:00", None, None, None, None, None]


def test_calendar_date_keeps_the_written_day(column):
    values = ["2025-04-11T22:41:15Z", "2025-04-11T23:59:00-05:00", "soon", "2025-13-01T00:00:00Z", "", None]
    assert column(text.calendar_date, values) == ["2025-04-11", "2025-04-11", "soon", "2025-13-01T00:00:00Z", "", ""]


def test_invalid_bytes_are_dropped_as_python_does(spark):
    rng = random.Random(5)
    pool = [b"a", b"\n", "é".encode(), "│".encode(), "🟢".encode(), "\ufffd".encode(), b"\xff", b"\xc3", b"\xe2\x82", b"\x80", b"\xed\xa0\x80", b"\xf4\x90"]
    blobs = [b"".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(300)]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, b binary")
    got = rows.select("i", text.utf8_lossy(F.col("b")).alias("t")).orderBy("i").collect()
    assert [row["t"] for row in got] == [b.decode("utf-8", errors="ignore") for b in blobs]


def test_landed_content(spark):
    rows = [("base64", "aGVs\nbG8=\n"), ("none", "aGk="), ("base64", "a"), ("base64", None), ("base64", "")]
    frame = spark.createDataFrame(rows, "e string, c string")
    got = [r["t"] for r in frame.select(text.landed_content(F.col("e"), F.col("c")).alias("t")).collect()]
    assert got == ["hello", None, None, None, ""]


def test_version_goldens(column):
    key = lambda c: versions.version_key(versions.version_parts(c))
    values = ["release-v1.2.3", "v 1. 2", "2024-01-02-03-04", "none", None, "v1.0a1", "1_2 - 3", "007.00", "9" * 50 + ".1"]
    assert column(key, values) == ["1.2.3", "1.2", "2024.1.2.3", "", "", "1.0", "1.2.3", "7.0", "9" * 50 + ".1"]
    numbers = lambda c: versions.version_tuple(versions.version_parts(c))
    assert [[int(n) for n in v] for v in column(numbers, values)] == [
        [1, 2, 3], [1, 2], [2024, 1, 2, 3], [], [], [1, 0], [1, 2, 3], [7, 0], [10**38 - 1, 1]]
    assert column(versions.has_version, values) == [v and any(c.isdigit() for c in v) for v in values]


def test_versions_of_random_tags(column):
    rng = random.Random(1)
    tags = ["".join(rng.choices(["v", "1", "23", ".", "-", "_", " ", "rc", "x", "0"], k=rng.randint(0, 9))) for _ in range(500)]

    def leftmost(tag):
        found = re.search(r"\d+", tag)
        numbers, at = [], found.start() if found else len(tag)
        while len(numbers) < 4:
            nxt = re.match(r"\d+" if not numbers else r"\s*[.\-_]\s*(\d+)", tag[at:])
            if not nxt:
                break
            numbers.append(str(int(nxt.group(nxt.lastindex or 0))))
            at += nxt.end()
        return ".".join(numbers)

    assert column(lambda c: versions.version_key(versions.version_parts(c)), tags) == [leftmost(tag) for tag in tags]


def test_versions_order_as_tuples(spark):
    frame = spark.createDataFrame([("1.2",), ("1.10",), ("1",), ("1.2.0",)], "t string")
    ordered = frame.orderBy(F.desc(versions.version_tuple(versions.version_parts(F.col("t"))))).collect()
    assert [row["t"] for row in ordered] == ["1.10", "1.2.0", "1.2", "1"]


def test_pre_release(column):
    assert column(versions.is_pre_release, ["source-1.2", "v1.0a1", "v1.0", "V2-RC1", "march-1"]) == [True, True, False, True, True]


def test_test_file_rules(column):
    values = ["a/Tests/x.txt", "contest/x.py", "x_test.py", "conftest.py", "src/a_spec.py", "my_test_a.py", "test_a.pyc"]
    assert column(paths.is_test_file, values) == [True, False, True, True, True, False, False]
    assert column(paths.is_test_patch, ["contest.py", "src/x.py", "a/testing/b.py", "latest_x.py", "tests/data.txt"]) == [True, False, True, True, False]
    assert column(paths.is_source_file, ["src/x.py", "tests/x.py", "README.md"]) == [True, False, False]


def test_whitespace_list_is_complete():
    assert set(d.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_versions_sort_exactly_at_any_length(spark):
    big = "1" * 40
    tags = ["v2", "v10", "v2.0", "v2.1", f"v{big}", f"v{big[:-1]}2", "v002.0001", "v9" + "0" * 45, "v1-2_3.4.5"]
    frame = spark.createDataFrame([(t,) for t in tags], "t string")
    parts = versions.version_parts(F.col("t"))
    numbers = lambda tag: [int(n) for n in __import__("re").findall(r"\d+", tag)][:4]
    got = [r["t"] for r in frame.orderBy(versions.version_order(parts), "t").collect()]
    assert got == sorted(tags, key=lambda t: (numbers(t), t))
