"""Periodic runs, prefix tries and repeated windows against plain Python on small inputs with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("taskmine.llm")

from checks.compare import differences, duckdb_on
from taskmine.llm import prefixes, runs, substrings
from taskmine.llm.arrays import SpacedWords, packed
from taskmine.llm.queries import ORACLES, QUERIES
from taskmine.sources.stages import staged, temporary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, runs string, best string, key string, spans string, alive string, longest string, _words string"


def frame(spark, texts, parts=3):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i, t, "x", "y", "z", None, "w", "v", "u") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- periodic runs

def plain_runs(words, least=24):
    """(start, period, length) by comparing all words at every distance."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, q, length) for (start, length), q in found.items())


def periodic(rng):
    kind = rng.random()
    if kind < 0.3:
        return [rng.choice("ab") for _ in range(rng.randint(0, 120))]
    out = []
    while len(out) < rng.randint(20, 300):
        base = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
        out += base * rng.randint(1, 9) + base[:rng.randint(0, len(base))] if rng.random() < 0.6 else [str(rng.random()) for _ in range(20)]
    return out


@pytest.mark.parametrize("least", [24, 6])
def test_runs_of_random_words(least):
    rng = random.Random(least)
    for _ in range(25):
        texts = [periodic(rng) for _ in range(rng.randint(1, 20))]
        words = SpacedWords(*packed(pa.array([" ".join(t) or None for t in texts])))
        found = defaultdict(list)
        for t, start, length, period in runs.runs_of(words, least):
            found[t].append((start, period, length))
        for t, own in enumerate(texts):
            assert found[t] == plain_runs(own, least)


def test_runs_of_very_long_texts():
    """A text of one word, and one of many runs of the same word: no work by the square."""
    many = (["a"] * 30 + ["x", "y"] * 20 + ["z"]) * 2000
    for own, n in ((["a"] * 200_000, 1), (many, None)):
        found = runs.runs_of(SpacedWords(*packed(pa.array([" ".join(own)]))))
        assert n is None or len(found) == n
        assert all(length >= max(24, 3 * period) for _, _, length, period in found)
    assert (0, 0, len(many), 71) in found and len(found) == 4001


def test_collapsed(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "a " * 24, "a " * 23, "é b\x0bc " * 12, "ab c\r\n" * 15 + " \x1c end"]
    texts += [rng.choice([" ", "\n", " \t "]).join(periodic(rng)) for _ in range(30)]
    texts += texts[:8]
    rows = {r["doc_id"]: r for r in runs.collapsed(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        words, row = WORD.findall(text or ""), rows[i]
        expected, gone = plain_runs(words), set()
        for start, q, length in expected:
            gone.update(range(start + q, start + length))
        assert [(r["start"], r["period"], r["length"]) for r in row["runs"]] == expected
        assert row["collapsed"] == " ".join(w for k, w in enumerate(words) if k not in gone)
        best = min(expected, key=lambda r: (-r[2] / r[1], r[0], r[1]), default=None)
        assert (row["best"] and (row["best"]["start"], row["best"]["period"], row["best"]["length"])) == best
        assert (row["text"], row["key"], row["spans"]) == (text, "z", None)
    assert runs.collapsed(frame(spark, [])).count() == 0


def test_repeated_end(spark):
    texts = [f"w{i} x y\nz {i} é" * (i % 4) for i in range(60)] + [None] * 20
    docs = frame(spark, texts)
    changed = runs.with_repeated_end(docs)
    assert set(changed.columns) == set(docs.columns)
    for row in changed.collect():
        i, words = row["doc_id"], WORD.findall(texts[row["doc_id"]] or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        assert WORD.findall(row["text"] or "") == words


# ---------------------------------------------------------------- prefix tries

def plain_trie(sequences):
    """{conv_id: [(role, text), …]} to rows, node by node."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        leaves, saved = (0 if children[node] else 1), (len(members[node]) - 1) * (len(WORD.findall(node[-1][1])) if node else 0)
        for child in children[node]:
            more = below(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(sequences[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), *below(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(conversations):
    turns = defaultdict(list)
    for c, turn, role, text in conversations:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(rows)] for c, rows in turns.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


CONVERSATION = "conv_id long, turn long, role string, text string, depth string, k1 string, words string, top string"


def talk(rng, ids):
    rows = []
    for c in ids:
        length = rng.choice([1, 1, 2, 3, 6])
        for turn in range(length):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "user", None, ""]), rng.choice(["a b", "a\tb c", "", None, "é"]) if turn else "hello to all"))
    return rows


@pytest.mark.parametrize(("shard", "pending"), [(prefixes.SHARD, prefixes.PENDING), (3, 2), (1, 1)])
def test_trie(spark, shard, pending):
    rng = random.Random(8)
    rows = talk(rng, list(range(0, 90)) + [1000, 1007, 5000, 9999]) + [(None, 0, "user", "lost"), (41, 3, "user", "again"), (41, 3, "user", "again")]
    rows += [(77, k, "user", f"long {k % 3}") for k in range(10, 60)]
    table = spark.createDataFrame([(*r, "x", "y", None, "z") for r in rows], CONVERSATION).repartition(3)
    turns = staged(prefixes.numbered(table), "test-turns")
    convs = turns.select("conv_id").distinct()
    found = prefixes.trie(prefixes.with_shared_start(turns, convs), convs, shard=shard, pending=pending)
    sequences = rebuilt(rows)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_trie(sequences)
    assert any(not turns for turns in sequences.values()) or any(len(t) > 50 for t in sequences.values())


def test_trie_of_long_conversations(spark, monkeypatch):
    """Blocks of turns: more turns than one block holds, and ids over several blocks."""
    monkeypatch.setattr(prefixes, "_BLOCK", 8)
    monkeypatch.setattr(prefixes, "_IDS", 2)
    rows = [(c, k, "user", "same" if k < 30 else f"{c % 3}") for c in (3, 40, 44, 61) for k in range(37)] + [(c, 0, None, None) for c in range(200, 240)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = prefixes.numbered(table)
    found = prefixes.trie(prefixes.with_shared_start(turns, turns.select("conv_id").distinct()), turns.select("conv_id").distinct(), shard=2)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_trie(rebuilt(rows))


def test_trie_of_nothing(spark):
    turns = prefixes.numbered(spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string"))
    convs = turns.select("conv_id").distinct()
    assert prefixes.trie(prefixes.with_shared_start(turns, convs), convs).count() == 0


def test_queue_spills_in_order():
    rng = random.Random(2)
    queue, sent = prefixes.SpillingQueue(7), []
    for _ in range(5000):
        record = (rng.randrange(9), rng.randint(1, 4), 0, 0, rng.randint(-3, 3), rng.randint(-2, 2), *[rng.randrange(99) for _ in range(5)])
        sent.append(record)
        queue.push(record)
    assert len(queue.runs) > 100 and len(queue.fresh) <= 7
    for receiver in sorted({queue.receiver(r) for r in sent}):
        assert sorted(queue.taken(receiver)) == sorted(r for r in sent if queue.receiver(r) == receiver)


# ---------------------------------------------------------------- repeated windows

def plain_windows(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    gone = [np.zeros(len(w), bool) for w in words]
    longest = [None] * len(words)
    length = window
    while length <= max(map(len, words)):
        first = {}
        for i, own in enumerate(words):
            for k in range(len(own) - length + 1):
                if first.setdefault(tuple(own[k:k + length]), i) < i:
                    longest[i] = length
                    if length == window:
                        gone[i][k:k + length] = True
        length *= 2
    return [(len(w), int(g.sum()), " ".join(x for x, y in zip(w, g) if not y), most) for w, g, most in zip(words, gone, longest)]


@pytest.mark.parametrize("window", [50, 4])
def test_repeated_windows(spark, window):
    rng = random.Random(window)
    passage = [f"p{k}" for k in range(130)]
    texts = [None, "", " \n", "one word", " ".join(passage[:49]), " ".join(passage[:50]), "\n".join(passage), "\t".join(passage)]
    for k in range(40):
        a, size = rng.randrange(60), rng.choice([3, 49, 50, 51, 70])
        texts.append(" ".join([f"x{rng.randrange(5)}" for _ in range(rng.randrange(30))] + passage[a:a + size] + [f"y{k}"] * rng.randrange(3)))
    copy = " ".join(f"c{rng.randrange(40)}" for _ in range(260))
    texts += [copy] * 6 + [copy.replace("c7", "C7")] * 3 + [copy + " end", "a " * 400, "b a " * 130, "a " * 90 + copy, " ".join(passage * 3)]
    rows = {r["doc_id"]: r for r in substrings.without_repeated_windows(frame(spark, texts), window=window).collect()}
    for i, (n, gone, kept, longest) in enumerate(plain_windows(texts, window)):
        row = rows[i]
        assert (row["n_words"], sum(s["end"] - s["start"] for s in row["spans"]), row["kept"], row["longest"]) == (n, gone, kept, longest)


def test_repeated_windows_of_odd_tables(spark):
    assert substrings.without_repeated_windows(frame(spark, [])).count() == 0
    long = " ".join(f"w{k % 997}" for k in range(60))
    rows = substrings.without_repeated_windows(spark.createDataFrame([(None, long), (None, long), (7, long), (9, long), (3, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["spans"])) for r in rows) == [(False, 3, 0), (False, 7, 0), (False, 9, 1), (True, 0, 0), (True, 0, 0)]
    with pytest.raises(ValueError):
        substrings.without_repeated_windows(frame(spark, []), window=7)


def test_stage_tables_end_with_their_block(spark):
    with temporary(spark) as keep:
        gone = staged(spark.range(3), "test-gone")
        stays = keep(staged(spark.range(4), "test-stays"))
    assert stays.count() == 4
    with pytest.raises(Exception, match="(?i)not exist|FileNotFound|FAILED_READ"):
        gone.count()


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_periodic_runs", "op13_substrings"])
def test_queries_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert differences(QUERIES[name](spark, folder), duckdb_on(folder), ORACLES[name]) == []


# ---------------------------------------------------------------- fingerprints of long texts

def test_fingerprints_of_very_long_texts(spark):
    """Thousands of clauses of which all or few differ: exact, and in time that follows their number."""
    import time

    from taskmine.llm import fingerprints

    def took(n):
        texts = [". ".join(f"{name} {i}" for i in range(n)) for name in ("clause", "clauze")] + [". ".join(f"clause {i + i // (n - 3) * n}" for i in range(n))]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        begin = time.time()
        rows = {r["doc_id"]: r for r in fingerprints.compared(docs).collect()}
        cuts = [set(fingerprints_of(t)) for t in texts]
        for i, own in enumerate(texts):
            after = texts[i - 1] if i else texts[2]
            half = len(own) // 2
            for name, other in (("near_edited", own[:len(own) - half] + after[:half]), ("near_next", after)):
                a, b = cuts[i], set(fingerprints_of(other))
                assert rows[i][name] == pytest.approx(1 - len(a ^ b) / (len(a) + len(b)))
        return time.time() - begin

    took(100)
    short, long = took(4000), took(16_000)
    assert long < 8 * short + 5


def fingerprints_of(text):
    return [p for p in re.split(r"(?:(?<=[.])|(?<=\S{12})) ", text) if p]


def test_cut_is_that_of_the_plain_pattern(spark, column):
    """The cut that looks at blanks first gives the paragraphs of the pattern that looks behind everywhere."""
    from taskmine.llm import fingerprints

    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "bc", "abcdefghijkl", "mnopqrstuvwxyz", ".", ",", "。", "、", " ", " ", "  ", "\n", "\n\n", "é", "|"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    plain = r"\n+|(?<=[\p{P}\p{S}]|\S{12})[ ]+|(?<=[。！？，、；：．｡､])(?![ \n])"
    old = lambda c: F.array_distinct(F.transform(F.filter(F.split(c, plain, -1), lambda p: p != ""), lambda p: fingerprints._checked(F.xxhash64(p))))
    assert column(fingerprints.paragraph_digests, texts) == column(old, texts)
