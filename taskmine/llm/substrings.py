"""Passages that stand in several documents: windows of words, found by doubling their length level by level.

A level goes from windows of G words to windows of 2 G. Every 2 G-window is filed under one of
the G-windows in it, that of the least hash (the first of equal ones), so equal windows are
filed alike and about two of G + 2 places are filed at all. Consecutive windows under one place
are one piece.

1. G-windows that stand in one document only end here, with all that is filed under them.
2. What is left is extended to 2 G words. Where all pieces of a G-window are alike to the last
   word, so are their windows. Else each different piece is taken once, its windows are listed
   by hash, and each gets the smallest document it starts in.
3. A 2 G-window that starts in several documents survives. At the next level only windows whose
   halves both survived are candidates; levels follow until none is left.

The first level ends at ``window`` words; what a smaller id has at this length is removed, each
word covered by such a window. Longer levels tell how long the passages are (``longest``).

Only hashes, places and ids are shuffled, besides the texts that a level still needs. Copies of
a text are one piece each time, so thousands of them add rows, not pairs; a hot G-window is a
count, and both sides of each join are tables, which lets Spark split a hot key. Windows are
equal if two 64-bit hashes are, that of the G-window and that of the window.

Null, empty and shorter texts have no windows; null becomes the empty text. Ids are unique; a
row without id has no smaller one, loses nothing and takes nothing from others. Repeats inside
one document do not count. Very long texts are one row, worked on in arrays. Other columns are
not read, so clashing names do no harm. Runs jobs when called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from taskmine.llm.arrays import SpacedWords, U, columns_of, mixed, packed, powers, ramp, sized
from taskmine.sources.stages import staged, temporary

WINDOW = 50
_CHUNK = 1 << 19
_PLACE_BITS = U(40)  # of a packed number; the rest is hash


class _Hashes:
    """Hashes of any stretch of words."""

    def __init__(self, words: SpacedWords):
        n = len(words.start)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words.hash * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + mixed(np.asarray(salt).astype(np.uint64)))


def _anchors(hashes: _Hashes, count: int, window: int, gram: int) -> np.ndarray:
    """For each of the first ``count`` windows, the place of the gram of least hash in it."""
    span = window - gram + 1
    place = np.arange(count + span - 1)
    value = (hashes.of(place, place + gram) >> _PLACE_BITS << _PLACE_BITS) | place.astype(np.uint64)
    grid = np.full(-(-len(value) // span) * span, ~U(0))
    grid[:len(value)] = value
    grid = grid.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:count], ahead[span - 1:span - 1 + count])
    return (least & ((U(1) << _PLACE_BITS) - U(1))).astype(np.int64)


def _covered(size: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of 0 … size - 1 lie in any of the stretches (end exclusive)."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def _listed(column: pa.Array, names: list[str]) -> tuple[np.ndarray, ...]:
    """Row number and fields of all items of a list column; null counts as empty."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    items = column.flatten()
    fields = [np.asarray(pc.struct_field(items, name).to_numpy(zero_copy_only=False)).astype(np.int64) for name in names]
    return np.repeat(np.arange(len(column)), lengths), *fields


def _stretches(flags: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of flagged places of one text."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])])
    head = np.flatnonzero(new)
    return at[head], at[np.append(head[1:], len(at)) - 1]


_PLACE = pa.struct([("first", pa.int32()), ("last", pa.int32())])
_PLACES = "array<struct<first:int,last:int>>"


def _lists(first: np.ndarray, last: np.ndarray, words: SpacedWords, rows: int) -> pa.Array:
    """Stretches of places, numbered inside their text, as a list column; texts without any have null."""
    text = words.text[first]
    counts = np.bincount(text, minlength=rows)
    begin = words.first[text]
    items = pa.StructArray.from_arrays([pa.array((first - begin).astype(np.int32)), pa.array((last - begin).astype(np.int32))], fields=list(_PLACE))
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(counts == 0, False))
    return pa.ListArray.from_arrays(ends, items)


def _pieces(docs: DataFrame, gram: int) -> DataFrame:
    """(key, mark, doc_id, first, width) of the pieces of all windows of 2 ``gram`` words that are alive."""
    window = 2 * gram

    def work(batches):
        for batch in batches:
            ids, texts, alive = columns_of(batch, ["doc_id", "text", "alive"])
            for lo, to in sized(texts, _CHUNK):
                words = SpacedWords(*packed(texts.slice(lo, to - lo)))
                count = len(words.start) - window + 1
                if count <= 0:
                    continue
                valid = words.text[:count] == words.text[window - 1:]
                lists = alive.slice(lo, to - lo)
                if lists.null_count < len(lists):
                    row, first, last = _listed(lists, ["first", "last"])
                    stands = _covered(len(words.start), words.first[row] + first, words.first[row] + last + 1)
                    valid &= stands[:count] | np.asarray(pc.is_null(lists))[words.text[:count]]
                at = np.flatnonzero(valid)
                if not len(at):
                    continue
                hashes = _Hashes(words)
                anchor = _anchors(hashes, count, window, gram)[at]
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
                head = np.flatnonzero(new)
                first, last = at[head], at[np.append(head[1:], len(at)) - 1]
                key = hashes.of(anchor[head], anchor[head] + gram)
                mark = hashes.of(first, last + window, anchor[head] - first + 1)
                text = words.text[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(mark.view(np.int64)), ids.slice(lo, to - lo).take(pa.array(text)),
                     pa.array((first - words.first[text]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))],
                    names=["key", "mark", "doc_id", "first", "width"])

    return docs.select("doc_id", "text", "alive").mapInArrow(work, "key long, mark long, doc_id long, first int, width int")


def _windows(docs: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """(key, mark, i, value, least, most): each window of one piece of each class, by the hash of its words."""
    wanted = classes.groupBy("doc_id").agg(F.collect_list(F.struct("key", "mark", "first", "width", "most")).alias("pieces"))

    def work(batches):
        for batch in batches:
            ids, texts, pieces = columns_of(batch, ["doc_id", "text", "pieces"])
            for lo, to in sized(texts, _CHUNK):
                words = SpacedWords(*packed(texts.slice(lo, to - lo)))
                row, key, mark, first, width, most = _listed(pieces.slice(lo, to - lo), ["key", "mark", "first", "width", "most"])
                hashes = _Hashes(words)
                each, i = np.repeat(np.arange(len(row)), width), ramp(width)
                start = (words.first[row] + first)[each] + i
                value = hashes.of(start, start + window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[each]), pa.array(mark[each]), pa.array(i.astype(np.int32)), pa.array(value.view(np.int64)),
                     ids.slice(lo, to - lo).take(pa.array(row[each])), pa.array(most[each])],
                    names=["key", "mark", "i", "value", "least", "most"])

    joined = docs.select("doc_id", "text").join(wanted, "doc_id")
    return joined.mapInArrow(work, "key long, mark long, i int, value long, least long, most long")


def _extended(docs: DataFrame, gram: int) -> DataFrame:
    """(doc_id, first, last, least): windows of 2 ``gram`` words that start in several documents, and the smallest of these."""
    window = 2 * gram
    pieces = staged(_pieces(docs, gram), f"windows-{window}-pieces")
    of_gram = pieces.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("mark").alias("a"), F.max("mark").alias("b"))
    often = staged(of_gram.where("least < most").select("key", "least", (F.col("a") != F.col("b")).alias("mixed")), f"windows-{window}-grams")
    met = staged(pieces.join(often, "key"), f"windows-{window}-met")
    last = F.col("first") + F.col("width") - 1
    alike = met.where("not mixed").select("doc_id", "first", last.alias("last"), "least")
    mixed_ = met.where("mixed").drop("least")
    classes = staged(mixed_.groupBy("key", "mark").agg(F.min(F.struct("doc_id", "first", "width")).alias("p"), F.max("doc_id").alias("most"))
                     .select("key", "mark", "p.*", "most"), f"windows-{window}-classes")
    windows = staged(_windows(docs, classes, window), f"windows-{window}-each")
    several = staged(windows.groupBy("key", "value").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").drop("most"),
                     f"windows-{window}-several")
    hits = windows.drop("least", "most").join(several, ["key", "value"])
    island = F.col("i") - F.row_number().over(Window.partitionBy("key", "mark", "least").orderBy("i"))
    ranges = hits.withColumn("island", island).groupBy("key", "mark", "least", "island").agg(F.min("i").alias("from"), F.max("i").alias("to"))
    ranges = staged(ranges.drop("island"), f"windows-{window}-ranges")
    placed = mixed_.join(ranges, ["key", "mark"]).select(
        "doc_id", (F.col("first") + F.col("from")).alias("first"), (F.col("first") + F.col("to")).alias("last"), "least")
    return alike.unionByName(placed)


def _settled(docs: DataFrame, found: DataFrame, window: int, how: str) -> DataFrame:
    """doc_id, text, ``removed`` (windows a smaller id has) and ``alive`` (candidates of twice the length), null where there are none."""
    lists = found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "least")).alias("found"))

    def work(batches):
        for batch in batches:
            ids, texts, found = columns_of(batch, ["doc_id", "text", "found"])
            for lo, to in sized(texts, _CHUNK):
                part, own = texts.slice(lo, to - lo), ids.slice(lo, to - lo)
                words = SpacedWords(*packed(part))
                row, first, last, least = _listed(found.slice(lo, to - lo), ["first", "last", "least"])
                n, begin = len(words.start), words.first[row]
                repeated = _covered(n, begin + first, begin + last + 1)
                after = least < pc.fill_null(own, 0).to_numpy(zero_copy_only=False)[row]
                later = _covered(n, (begin + first)[after], (begin + last + 1)[after])
                both = np.zeros(n, bool)
                if n > window:
                    both[:-window] = repeated[:-window] & repeated[window:] & (words.text[:-window] == words.text[window:])
                lists = [_lists(*_stretches(flags, words.text), words, to - lo) for flags in (later, both)]
                yield pa.RecordBatch.from_arrays([own, part, *lists], names=["doc_id", "text", "removed", "alive"])

    return docs.select("doc_id", "text").join(lists, "doc_id", how).mapInArrow(work, f"doc_id long, text string, removed {_PLACES}, alive {_PLACES}")


def without_repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, ``spans`` (removed words, start and end, end exclusive), ``kept`` (the words left,
    joined by one space) and ``longest``: the greatest ``window`` times a power of two of which a window also starts in a document
    with a smaller id; null where none does. ``window`` is even."""
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast(_PLACES).alias("alive"))
    known = plain.where(F.col("doc_id").isNotNull())
    with temporary(spark) as keep:
        whole = keep(staged(_settled(plain, _extended(known, window // 2), window, "left"), f"windows-{window}"))
    length, lengths = window, []
    at_level, alive = whole, whole.where(F.col("alive").isNotNull())
    while True:
        lengths.append(at_level.where(F.col("removed").isNotNull()).select("doc_id", F.lit(length).cast("long").alias("longest")))
        if alive.isEmpty():
            break
        length *= 2
        with temporary(spark) as keep:
            at_level = keep(staged(_settled(alive, _extended(alive, length // 2), length, "inner"), f"windows-{length}"))
        alive = at_level.where(F.col("alive").isNotNull())
    longest = lengths[0]
    for one in lengths[1:]:
        longest = longest.unionByName(one)
    longest = longest.groupBy("doc_id").agg(F.max("longest").alias("longest"))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def work(batches):
        for batch in batches:
            ids, texts, removed = columns_of(batch, ["doc_id", "text", "removed"])
            for lo, to in sized(texts, _CHUNK):
                words = SpacedWords(*packed(texts.slice(lo, to - lo)))
                row, first, last = _listed(removed.slice(lo, to - lo), ["first", "last"])
                gone = _covered(len(words.start), words.first[row] + first, words.first[row] + last + window)
                spans: list[list[dict]] = [[] for _ in range(to - lo)]
                for a, b in zip(*_stretches(gone, words.text)):
                    t = words.text[a]
                    spans[t].append({"start": int(a - words.first[t]), "end": int(b - words.first[t]) + 1})
                out, ends = words.joined(~gone)
                kept = pa.LargeStringArray.from_buffers(to - lo, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, to - lo), pa.array(np.diff(words.first).astype(np.int64)), pa.array(spans, pa.list_(span)), kept],
                    names=["doc_id", "n_words", "spans", "kept"])

    out = whole.select("doc_id", "text", "removed").mapInArrow(work, "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept string")
    return out.join(longest, "doc_id", "left")
