"""Byte strings of a fixed length that stand in more than one place of a corpus, by suffix arrays.

Every window of ``length`` bytes is filed under the smallest hash of the short strings in
it (its anchor), and there under the bytes that all windows at about this distance from
the anchor share (its core). Equal windows have equal anchors and cores, so they meet
under one key; consecutive windows with one key are one piece of text.

1. A key with one piece is done: nothing in it repeats.
2. Pieces of one key that are equal to the last byte count once; each that stands twice
   repeats as a whole.
3. Where a key has several different pieces, they are joined to one string, whose suffix
   array (``suffixes``) brings equal windows together; a window whose 400 bytes equal
   those of a neighbour in the array repeats.
4. A key with more than ``members`` different pieces is filed again by narrower cores,
   down to single windows, which need no comparison; so no task ever holds a hot key.

Only keys, digests and places are shuffled, besides one text of each different piece and
the texts that are cut in the end. Equality of windows is that of 64-bit hashes of their
400 bytes together with their key and neighbourhood in the array.

Null, empty and shorter texts have no windows. Ids must be unique. Repeated rows with
different ids are copies and lose everything from 400 bytes on. Matches never cross texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from taskmine.llm.arrays import columns_of, mixed, packed, powers, sized
from taskmine.llm.suffixes import suffix_arrays
from taskmine.sources.stages import staged

LENGTH, GRAM = 400, 32
WIDTHS = (128, 16, 1)  # distances from the anchor that share a core, level by level
MEMBERS = 48
_CHUNK = 1 << 18
_SEGMENT = 8 << 20
_CALL = 1 << 19  # bytes of one call for suffix arrays
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class _Hashes:
    """Hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + mixed(salt.astype(np.uint64)))


def _anchors(data: np.ndarray, hashes: _Hashes, length: int) -> np.ndarray:
    """For each window, the place of its anchor: the smallest hashed gram, the first of equal ones."""
    n, span = len(data), length - GRAM + 1
    grams = np.arange(n - GRAM + 1)
    value = hashes.of(grams, grams + GRAM, np.zeros(1, np.uint64))
    value = (value >> np.uint64(24) << np.uint64(24)) | grams.astype(np.uint64)
    grid = np.full(-(-len(value) // span) * span, ~np.uint64(0))
    grid[:len(value)] = value
    grid = grid.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(behind[:count], ahead[span - 1:span - 1 + count])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)


def _filed(hashes: _Hashes, first: np.ndarray, last: np.ndarray, distance: np.ndarray, width: int, length: int, salt: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows first..last (``distance``: of the first one's anchor), all in one file: key, mark and place of each."""
    file = distance // width
    far = np.minimum(file * width + width - 1, length - GRAM)
    anchor = first + distance
    key = hashes.of(anchor - file * width, anchor - far + length, salt ^ file.astype(np.uint64))
    mark = hashes.of(first, last + length, distance)
    return {"key": key.view(np.int64), "mark": mark.view(np.int64), "first": first, "width": last - first + 1, "distance": distance}


def _pieces(data: np.ndarray, offsets: np.ndarray, width: int, length: int):
    """(text, key, mark, first, width, distance) of the pieces of packed texts; a huge text comes in overlapping segments."""
    for begin in range(0, max(1, len(data)), _SEGMENT):
        part = data[begin:begin + _SEGMENT + length - 1]
        if len(part) < length:
            continue
        hashes = _Hashes(part)
        anchor = _anchors(part, hashes, length)
        window = np.arange(len(anchor))
        text = np.searchsorted(offsets, window + begin, "right") - 1
        whole = window + begin + length <= offsets[text + 1]
        window, anchor, text = window[whole], anchor[whole], text[whole]
        if not len(window):
            continue
        distance = anchor - window
        file = distance // width
        new = np.ones(len(window), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (file[1:] != file[:-1]) | (text[1:] != text[:-1])
        head = np.flatnonzero(new)
        last = window[np.append(head[1:], len(window)) - 1]
        out = _filed(hashes, window[head], last, distance[head], width, length, np.zeros(len(head), np.uint64))
        out["text"] = text[head]
        out["first"] = out["first"] + begin - offsets[out["text"]]
        yield out


_PIECE = "key long, mark long, doc_id long, first int, width int, distance int"


def _all_pieces(docs: DataFrame, width: int, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, texts = columns_of(batch, ["doc_id", "text"])
            ids = ids.to_numpy()
            for lo, to in sized(texts, _CHUNK):
                for p in _pieces(*packed(texts.slice(lo, to - lo)), width, length):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(p["key"]), pa.array(p["mark"]), pa.array(ids[lo + p["text"]])] + [pa.array(p[c].astype(np.int32)) for c in ("first", "width", "distance")],
                        names=["key", "mark", "doc_id", "first", "width", "distance"])

    return docs.mapInArrow(run, _PIECE)


def _with_bytes(places: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Adds the bytes of each piece; its places in one text travel together."""
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("key", "mark", "copies", "first", "width", "distance", "hot")).alias("pieces"))

    def run(batches):
        for batch in batches:
            texts, lists = columns_of(batch, ["text", "pieces"])
            for text, pieces in zip(texts, lists):
                data = text.as_py().encode()
                rows = pieces.as_py()
                columns = {c: [p[c] for p in rows] for c in ("key", "mark", "copies", "width", "distance", "hot")}
                cut = [data[p["first"]:p["first"] + p["width"] + length - 1] for p in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[c], t) for c, t in (("key", pa.int64()), ("mark", pa.int64()), ("copies", pa.int64()), ("width", pa.int32()), ("distance", pa.int32()), ("hot", pa.bool_()))] + [pa.array(cut, pa.binary())],
                    names=["key", "mark", "copies", "width", "distance", "hot", "piece"])

    return docs.join(wanted, "doc_id").select("text", "pieces").mapInArrow(
        run, "key long, mark long, copies long, width int, distance int, hot boolean, piece binary")


def _repeated_windows(groups: list[list[bytes]], length: int) -> list[list[np.ndarray]]:
    """For each piece of each group, whether each of its windows stands elsewhere in the group: by suffix array."""
    out: list = [None] * len(groups)
    order = sorted(range(len(groups)), key=lambda g: sum(map(len, groups[g])))
    at = 0
    while at < len(order):
        own, total = [], 0
        while at < len(order) and (not own or total < _CALL):
            own.append(order[at])
            total += sum(len(p) + 1 for p in groups[order[at]]) + 1
            at += 1
        sizes, symbols = [], []
        for g in own:
            for piece in groups[g]:
                symbols.append(np.frombuffer(piece, np.uint8).astype(np.int16) + 2)
                symbols.append(np.ones(1, np.int16))  # between pieces
            symbols.append(np.zeros(1, np.int16))  # below all others
            sizes.append(sum(len(p) + 1 for p in groups[g]) + 1)
        text = np.concatenate(symbols)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        array = suffix_arrays(text, offsets).astype(np.int64)
        # windows that hold no separator
        small = np.concatenate([[0], np.cumsum(text < 2)])
        inside = np.zeros(len(text), bool)
        count = len(text) - length + 1
        if count > 0:
            inside[:count] = small[length:] == small[:-length]
        hashes = _Hashes(np.where(text < 2, 0, text - 2).astype(np.uint8))
        value = np.zeros(len(text), np.uint64)
        full = np.flatnonzero(inside)
        value[full] = hashes.of(full, full + length, np.zeros(1, np.uint64))
        owner = np.repeat(np.arange(len(own)), sizes)
        left, right = array[:-1], array[1:]
        same = inside[left] & inside[right] & (value[left] == value[right]) & (owner[left] == owner[right])
        twice = np.zeros(len(text), bool)
        twice[left[same]] = True
        twice[right[same]] = True
        for k, g in enumerate(own):
            place, flags = int(offsets[k]), []
            for piece in groups[g]:
                flags.append(twice[place:place + len(piece) - length + 1])
                place += len(piece) + 1
            out[g] = flags
    return out


_RANGE = ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType())]))


def _ranges(flags: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _by_suffix_arrays(pieces: DataFrame, length: int) -> DataFrame:
    """(key, mark, ranges of windows) for the pieces of keys with few members."""
    schema = StructType([StructField("key", LongType()), StructField("mark", LongType()), StructField("ranges", _RANGE)])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches):
        keys, groups, size = [], [], 0

        def done():
            rows = [(key, mark, _ranges(flags)) for marks, (key, own) in zip(_repeated_windows(groups, length), zip(keys, members)) for flags, mark in zip(marks, own)]
            rows = [r for r in rows if r[2]]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind)],
                                              names=["key", "mark", "ranges"])

        members: list[list[int]] = []
        for batch in batches:
            for key, mark, piece in zip(*(c.to_pylist() for c in columns_of(batch, ["key", "mark", "piece"]))):
                if not keys or keys[-1] != key:
                    if size > 4 * _CALL:
                        yield done()
                        keys, groups, members, size = [], [], [], 0
                    keys.append(key)
                    groups.append([])
                    members.append([])
                groups[-1].append(piece)
                members[-1].append(mark)
                size += len(piece)
        if keys:
            yield done()

    return pieces.select("key", "mark", "piece").repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _narrower(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """Pieces filed again under narrower cores: (sub_key, sub_mark, key, mark, copies, from, width, distance, piece)."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["piece"], np.uint8)
                hashes = _Hashes(data)
                window = np.arange(row["width"])
                distance = row["distance"] - window
                file = distance // width
                head = np.flatnonzero(np.r_[True, file[1:] != file[:-1]])
                last = np.append(head[1:], len(window)) - 1
                salt = np.full(len(head), row["key"], np.int64).view(np.uint64)
                p = _filed(hashes, head, last, distance[head], width, length, salt)
                k = len(head)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p["key"]), pa.array(p["mark"]), pa.array(np.full(k, row["key"])), pa.array(np.full(k, row["mark"])), pa.array(np.full(k, row["copies"])),
                     pa.array(p["first"].astype(np.int32)), pa.array(p["width"].astype(np.int32)), pa.array(p["distance"].astype(np.int32)),
                     pa.array([row["piece"][a:b + length] for a, b in zip(head.tolist(), last.tolist())], pa.binary())],
                    names=["sub_key", "sub_mark", "key", "mark", "copies", "from", "width", "distance", "piece"])

    return pieces.select("key", "mark", "copies", "width", "distance", "piece").mapInArrow(
        run, "sub_key long, sub_mark long, key long, mark long, copies long, from int, width int, distance int, piece binary")


def _settled(pieces: DataFrame, widths: tuple[int, ...], length: int, members: int) -> DataFrame:
    """(key, mark, first, last): repeated windows of pieces with their bytes; ``hot`` ones by narrower files."""
    cold = _by_suffix_arrays(pieces.where("not hot"), length).select("key", "mark", F.inline("ranges"))
    hot = pieces.where("hot")
    if not widths or hot.isEmpty():
        return cold
    filed = staged(_narrower(hot, widths[0], length), f"repeats-narrow-{widths[0]}")
    sub = filed.groupBy("sub_key", "sub_mark").agg(F.sum("copies").alias("copies"))
    of_key = sub.groupBy("sub_key").agg(F.sum("copies").alias("all_copies"), F.count("*").alias("different")).where("all_copies > 1")
    known = staged(sub.join(of_key, "sub_key"), f"repeats-known-{widths[0]}")
    places = filed.select("sub_key", "sub_mark", "key", "mark", "from", "width")
    # pieces that stand twice repeat as a whole
    whole = places.join(known.where("copies > 1").select("sub_key", "sub_mark"), ["sub_key", "sub_mark"]).select(
        "key", "mark", F.col("from").alias("first"), (F.col("from") + F.col("width") - 1).alias("last"))
    out = cold.unionByName(whole)
    several = known.where("different > 1").select("sub_key", "sub_mark", "copies", (F.col("different") > members).alias("hot"))
    if several.isEmpty():
        return out
    texts = filed.groupBy("sub_key", "sub_mark").agg(F.first(F.struct("width", "distance", "piece")).alias("p"))
    deeper = texts.join(several, ["sub_key", "sub_mark"]).select(
        F.col("sub_key").alias("key"), F.col("sub_mark").alias("mark"), "copies", "p.width", "p.distance", "hot", "p.piece")
    found = _settled(staged(deeper, f"repeats-deeper-{widths[0]}"), widths[1:], length, members).select(
        F.col("key").alias("sub_key"), F.col("mark").alias("sub_mark"), F.col("first").alias("f"), F.col("last").alias("l"))
    return out.unionByName(places.join(found, ["sub_key", "sub_mark"]).select(
        "key", "mark", (F.col("from") + F.col("f")).alias("first"), (F.col("from") + F.col("l")).alias("last")))


def repeated_windows(docs: DataFrame, length: int = LENGTH, widths: tuple[int, ...] = WIDTHS, members: int = MEMBERS) -> DataFrame:
    """(doc_id, first, last): ranges of window starts whose bytes stand elsewhere too. Takes doc_id and text; runs jobs when called."""
    pieces = staged(_all_pieces(docs.where(F.octet_length("text") >= length), widths[0], length), "repeats-pieces")
    often = pieces.groupBy("key").agg(F.count("*").alias("places"), F.min("mark").alias("least"), F.max("mark").alias("most")).where("places > 1")
    # written, so that the join has a shuffle of its own on both sides and Spark can split a hot key
    often = staged(often.select("key", (F.col("least") != F.col("most")).alias("mixed")), "repeats-often")
    met = staged(pieces.join(often, "key"), "repeats-met")
    equal = met.where("not mixed").select("doc_id", "first", (F.col("first") + F.col("width") - 1).alias("last"))
    mixed_ = met.where("mixed")
    different = mixed_.groupBy("key", "mark").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "first", "width", "distance")).alias("p"))
    sizes = different.groupBy("key").agg((F.count("*") > members).alias("hot"))
    known = staged(different.join(sizes, "key").select("key", "mark", "copies", "p.*", "hot"), "repeats-different")
    whole = known.where("copies > 1").select("key", "mark", F.lit(0).alias("from"), (F.col("width") - 1).alias("to"))
    bytes_of = staged(_with_bytes(known, docs, length), "repeats-bytes")
    found = staged(_settled(bytes_of, widths[1:], length, members), "repeats-found").select("key", "mark", F.col("first").alias("from"), F.col("last").alias("to"))
    by_array = mixed_.select("key", "mark", "doc_id", "first").join(whole.unionByName(found), ["key", "mark"]).select(
        "doc_id", (F.col("first") + F.col("from")).alias("first"), (F.col("first") + F.col("to")).alias("last"))
    return equal.unionByName(by_array)


_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, ``spans`` (maximal removed runs of bytes, end exclusive) and ``kept`` (the bytes that stay)."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = repeated_windows(plain, length, **options)
    lists = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    schema = StructType([StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("spans", _SPANS), StructField("kept", BinaryType())])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            ids, texts, lists = columns_of(batch, ["doc_id", "text", "ranges"])
            for lo, to in sized(texts, _CHUNK):
                sizes, spans, kept = [], [], []
                for value, own in zip(texts.slice(lo, to - lo), lists.slice(lo, to - lo)):
                    data = value.as_py().encode()
                    cut = []
                    for one in sorted((r["first"], r["last"] + length) for r in own.as_py() or []):
                        if cut and one[0] <= cut[-1][1]:
                            cut[-1][1] = max(cut[-1][1], one[1])
                        else:
                            cut.append(list(one))
                    sizes.append(len(data))
                    spans.append([{"start": a, "end": b} for a, b in cut])
                    ends = [0] + [x for pair in cut for x in pair] + [len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, to - lo), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                                                 names=schema.names)

    return plain.join(lists, "doc_id", "left").mapInArrow(run, schema)
