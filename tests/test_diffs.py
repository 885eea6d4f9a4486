import random

import pytest
from pyspark.sql import functions as F

from taskmine.operators import diffs as df


def parse(spark, *texts, **options):
    frame = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "n int, diff string")
    keys = ["n", "piece", "filename", "status", "old_filename", "patch_content", "is_test_file"]
    return [tuple(r) for r in df.parse_diffs(frame, **options).select(*keys).orderBy("n", "piece").collect()]


def test_statuses_and_names(spark):
    text = ("diff --git a/x.py b/x.py\nnew file mode 100644\n@@ -0,0 +1 @@\n+a\n"
            "diff --git a/old.py b/new.py\nsimilarity index 90%\nrename from old.py\nrename to new.py\n@@ -1 +1 @@\n-a\n+b\n"
            "diff --git a/tests/g.py b/tests/g.py\ndeleted file mode 100644\n@@ -1 +0,0 @@\n-a\n\\ No newline at end of file")
    assert parse(spark, text) == [
        (0, 0, "x.py", "added", None, "@@ -0,0 +1 @@\n+a", False),
        (0, 1, "new.py", "renamed", "old.py", "@@ -1 +1 @@\n-a\n+b", False),
        (0, 2, "tests/g.py", "removed", None, "@@ -1 +0,0 @@\n-a\n\\ No newline at end of file", True),
    ]


def test_the_whole_header_is_searched_unless_a_limit_is_given(spark):
    head = "diff --git a/x b/x\n" + "\n".join(f"index {i}" for i in range(9))
    late = head + "\nnew file mode 100644"
    assert parse(spark, late)[0][3] == "added"
    assert parse(spark, late, marker_lines=10)[0][3] == "modified"
    assert parse(spark, head[:head.rindex("\n")] + "\nnew file mode 100644", marker_lines=10)[0][3] == "added"
    assert parse(spark, head + "\n@@ -1 +1 @@\n new file mode\nnew file mode 100644")[0][3] == "modified"


def test_text_without_headers_gives_nothing(spark):
    assert parse(spark, "", "hello", "diff --git x y", "\n\n") == []


def plain(text, leading=None):
    """The files of a diff, found line by line."""
    found, pieces = [], []
    for line in text.split("\n"):
        if line.startswith("diff --git") or not pieces:
            pieces.append([])
        pieces[-1].append(line)
    for piece in pieces:
        lines = "\n".join(piece).strip().split("\n")
        head = lines[0]
        if not head.startswith("diff --git a/") or " b/" not in head:
            continue
        old, new = head[len("diff --git a/"):].split(" b/", 1)
        status = "modified"
        hunk = next((n for n, line in enumerate(lines) if line.startswith("@@")), len(lines))
        for line in lines[:leading or hunk]:
            marks = {"new file mode": "added", "deleted file mode": "removed", "rename from": "renamed"}
            hit = [kind for mark, kind in marks.items() if line.startswith(mark)]
            if hit:
                status = hit[0]
                break
        body, inside = [], False
        for line in lines:
            inside = inside or line.startswith("@@")
            if line.startswith("\\") or (inside and (line == "" or line[0] in "+- " or line.startswith("@@"))):
                body.append(line)
        name = old if status == "removed" else new
        if name:
            found.append((name, status, old if status == "renamed" else None, "\n".join(body)))
    return found


def test_random_diffs(spark):
    rng = random.Random(11)
    pieces = ["diff --git a/f.py b/f.py", "diff --git a/a b/c b/d", "diff --git a/x y", "new file mode 100644", "deleted file mode 1", "rename from f", "index 1..2",
              "--- a/f", "+++ b/f", "@@ -1 +1 @@", "+new", "-old", " same", "", "\\ No newline", "junk", "  ", "x diff --git a/q b/q"]
    texts = ["\n".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(600)]
    for leading in (None, 10):
        got = {}
        for n, _, name, status, old, body, _ in parse(spark, *texts, marker_lines=leading):
            got.setdefault(n, []).append((name, status, old, body))
        for n, text in enumerate(texts):
            assert got.get(n, []) == plain(text, leading), text


@pytest.mark.parametrize("status", ["added", "removed", "renamed", "modified"])
def test_rebuilt_diffs_parse_back(spark, status):
    row = ("src/a.py", status, "@@ -1 +1 @@\n-x\n+y", "src/b.py" if status == "renamed" else None)
    frame = spark.createDataFrame([row], "filename string, status string, patch_content string, old_filename string")
    (text,) = [r["diff"] for r in df.rebuild(frame).collect()]
    assert [tuple(r[i] for i in (2, 3, 5, 4)) for r in parse(spark, text)] == [row]


def test_unknown_status_counts_as_modified(spark):
    build = lambda status: df.complete_diff(F.lit("a"), F.lit(status), F.lit("@@"), F.lit(None).cast("string"))
    row = spark.range(1).select(build("copied").alias("x"), build("modified").alias("y")).first()
    assert row["x"] == row["y"] == "diff --git a/a b/a\nindex 1111111..2222222 100644\n--- a/a\n+++ b/a\n@@\n"


def test_incomplete_changes_are_not_usable(spark):
    rows = [("a.py", "modified", "@@"), (None, "modified", "@@"), ("a.py", "", "@@"), ("a.py", "modified", None), ("tests/test_a.py", "added", "@@")]
    frame = spark.createDataFrame(rows, "filename string, status string, patch string")
    usable = df.usable_changes(frame)
    assert sorted(r["filename"] for r in usable.collect()) == ["a.py", "tests/test_a.py"]
    pick = lambda **flags: sorted(r["filename"] for r in df.filter_patches(usable, **flags).collect())
    assert pick(include_test=False) == ["a.py"] and pick(include_source=False) == ["tests/test_a.py"]


def test_pieces_are_not_taken_apart_into_lines(spark):
    from taskmine.functions import paths

    lines = ["", "@", "@x", "@@ -1 +1 @@", "+a", "-b", " c", "d", "\\\\ No newline", "rename from x", "new file mode 1", "\t", "deleted file mode 2"]
    rng = random.Random(5)
    pieces = [["diff --git a/x b/test_y.py"] + [rng.choice(lines) for _ in range(rng.randrange(12))] + ["+z"] for _ in range(300)]
    frame = spark.createDataFrame([(n, "\n".join(piece)) for n, piece in enumerate(pieces)], "n long, diff string")
    for marker_lines in (None, 1, 3):
        found = df.parse_diffs(frame, marker_lines=marker_lines)
        assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
        for row in found.collect():
            piece = pieces[row["n"]]
            start = next((k for k, line in enumerate(piece) if line.startswith("@@")), None)
            head = piece[:marker_lines] if marker_lines else piece[:start]
            marks = [name for line in head for marker, name in df.MARKERS.items() if line.startswith(marker)]
            kept = [line for k, line in enumerate(piece) if line.startswith(("@@", "\\"))
                    or (start is not None and k > start and (line == "" or line[0] in "+- "))]
            assert (row["status"], row["patch_content"]) == ((marks + ["modified"])[0], "\n".join(kept))
    names = ["a/test/b.py", "a/tests/b.py", "x_test.py", "contest.py", "test.txt", "a/testing/b.py", "b.py", "TEST_a.py"]
    flags = spark.createDataFrame([(n,) for n in names], "f string").select(paths.is_test_patch(F.col("f")).alias("t")).collect()
    assert [r["t"] for r in flags] == [True, True, True, True, False, True, False, True]
