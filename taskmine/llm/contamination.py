"""Benchmark passages in documents: a prefix-filtered set join, checked exactly.

Every item is cut into windows of ``window`` consecutive words (a shorter item is one
window). A window is the set of its shingles; a document stretch holds the window only if
it holds all of them, so one necessary prefix token is enough to find it: its rarest
shingle, by counts over all documents. Occurrences of these tokens fix where the window
would start and end (positional and length bound); the words there are then compared.

Items come in blocks of ``block_bytes`` of text, which bounds what is sent to the workers;
every block goes over all documents, without a shuffle.

Null and empty texts have no words; an item without words has no window. Equal items are
each reported; repeated documents are treated alike. Other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from taskmine.llm.arrays import LOWER, Words, packed, ramp, sized

WINDOW, SHINGLE, BLOCK_BYTES = 10, 3, 8 << 20
_CHUNK = 1 << 18
_BITS = 20  # of the first, approximate look at a shingle


class _Table:
    """Sorted 64-bit keys, with a bitmap that most other values fail."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[keys >> np.uint64(64 - _BITS)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into values, index into keys) where they are equal."""
        maybe = np.flatnonzero(self.seen[values >> np.uint64(64 - _BITS)])
        if not len(maybe) or not len(self.keys):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.keys, values[maybe]), len(self.keys) - 1)
        same = self.keys[at] == values[maybe]
        return maybe[same], at[same]


class Block:
    """Windows of some items and, once counts are known, the prefix token of each."""

    def __init__(self, names: list[str], texts: list[str | None], window: int, shingle: int):
        self.window = window
        data, offsets = packed(pa.array(texts, pa.string()))
        words = Words(data, offsets)
        sizes = np.diff(words.first)
        width = np.minimum(sizes, window)
        count = np.where(sizes > 0, sizes - width + 1, 0)
        item = np.repeat(np.arange(len(texts)), count)
        self.names = np.array(names, object)
        self.item, self.width = item, width[item]
        self.begin = words.first[:-1][item] + ramp(count)
        self.hash, self.length = words.hash, words.end - words.start
        self.low, self.start = LOWER[data], words.start
        self.tables = {}
        for size in sorted(set(np.minimum(self.width, shingle).tolist())):
            _, values = words.runs(size)
            self.tables[size] = _Table(np.unique(values))
        self.shingle, self._words = shingle, words

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Give every window its rarest shingle: sorted keys, and windows and offsets by key."""
        self.prefix = {}
        sizes = np.minimum(self.width, self.shingle)
        for size, table in self.tables.items():
            first, values = self._words.runs(size)
            code = np.full(len(self.hash), -1)
            code[first] = np.searchsorted(table.keys, values)
            mine = np.flatnonzero(sizes == size)
            places = self.width[mine] - size + 1
            each = np.repeat(mine, places)
            offset = ramp(places)
            key = code[self.begin[each] + offset]
            order = np.lexsort((offset, counts[size][key], each))
            best = order[np.r_[True, each[order][1:] != each[order][:-1]]] if len(order) else order
            best = best[np.argsort(key[best], kind="stable")]
            used, start = np.unique(key[best], return_index=True)
            self.prefix[size] = (_Table(table.keys[used]), np.append(start, len(best)), each[best], offset[best])
        del self._words, self.tables

    def counted(self, words: Words) -> dict[int, np.ndarray]:
        return {size: np.bincount(t.find(words.runs(size)[1])[1], minlength=len(t.keys)) for size, t in self.tables.items()}

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence of a window in the texts."""
        out_at, out_window = [], []
        low = None
        for size, (table, start, window, offset) in self.prefix.items():
            first, values = words.runs(size)
            value, key = table.find(values)
            many = start[key + 1] - start[key]
            pick = np.repeat(start[key], many) + ramp(many)
            w = window[pick]
            at = np.repeat(first[value], many) - offset[pick]
            text = words.text[np.repeat(first[value], many)]
            fits = (at >= words.first[text]) & (at + self.width[w] <= words.first[text + 1])
            at, w = at[fits], w[fits]
            for k in range(self.window):  # words that differ are dropped early
                if not len(at):
                    break
                inside = k < self.width[w]
                i, j = np.where(inside, at + k, at), np.where(inside, self.begin[w] + k, self.begin[w])
                same = (words.hash[i] == self.hash[j]) & (words.end[i] - words.start[i] == self.length[j])
                at, w = at[same], w[same]
            if len(at):
                low = LOWER[words.data] if low is None else low
                sure = self._equal(words, low, at, w)
                at, w = at[sure], w[sure]
            out_at.append(at)
            out_window.append(w)
        return np.concatenate(out_at or [np.zeros(0, int)]), np.concatenate(out_window or [np.zeros(0, int)])

    def _equal(self, words: Words, low: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Whether the bytes of all words are equal; only their lengths are known to be."""
        sure = np.ones(len(at), bool)
        for lo in range(0, len(at), 20_000):
            a, b = at[lo:lo + 20_000], w[lo:lo + 20_000]
            n = self.width[b]
            i, j = np.repeat(a, n) + ramp(n), np.repeat(self.begin[b], n) + ramp(n)
            size = self.length[j]
            step = ramp(size)
            differ = low[np.repeat(words.start[i], size) + step] != self.low[np.repeat(self.start[j], size) + step]
            owner = np.repeat(np.repeat(np.arange(len(a)), n), size)
            sure[lo + owner[differ]] = False
        return sure


def _blocks(items: DataFrame, item_id: str, text: str, limit: int):
    """Items in blocks of about ``limit`` bytes; the driver holds one at a time."""
    names, texts, size = [], [], 0
    for row in items.select(F.col(item_id).cast("string"), text).toLocalIterator():
        names.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "") * 4
        if size >= limit:
            yield names, texts
            names, texts, size = [], [], 0
    if names:
        yield names, texts


def _corpus_counts(docs: DataFrame, text: str, block) -> dict[int, np.ndarray]:
    """How often each shingle of the block stands in all documents."""
    def run(batches):
        total = None
        for batch in batches:
            for lo, to in sized(batch.column(0), _CHUNK):
                counts = block.value.counted(Words(*packed(batch.column(0).slice(lo, to - lo))))
                total = counts if total is None else {k: total[k] + v for k, v in counts.items()}
        for size, values in (total or {}).items():
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size)), pa.array(at), pa.array(values[at])], names=["size", "code", "n"])

    counts = {size: np.zeros(len(t.keys), np.int64) for size, t in block.value.tables.items()}
    rows = docs.select(text).mapInArrow(run, "size long, code long, n long").groupBy("size", "code").agg(F.sum("n").alias("n"))
    for size, code, n in rows.toLocalIterator():  # at most the shingles of one block
        counts[size][code] = n
    return counts


def _marked(words: Words, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of words that some occurrence covers, as (first, one past the last), never across texts."""
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    hit = np.cumsum(edge[:-1]) > 0
    new = np.r_[True, words.text[1:] != words.text[:-1]] if len(hit) else hit
    before = np.r_[False, hit[:-1]] if len(hit) else hit
    after = np.r_[hit[1:], False] if len(hit) else hit
    last = np.r_[new[1:], True] if len(hit) else hit
    return np.flatnonzero(hit & (new | ~before)), np.flatnonzero(hit & (last | ~after)) + 1


SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
ADDED = StructType([StructField("n_words", LongType()), StructField("hits", ArrayType(SPAN)), StructField("items", ArrayType(StringType()))])


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (runs of covered words, end exclusive) and ``items`` (ids of occurring items, sorted as strings).

    Counting runs jobs when this is called: one pass over the documents for each block of items.
    """
    kept = [f for f in docs.schema.fields if f.name not in ADDED.names]
    plain = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    context = docs.sparkSession.sparkContext
    parts = 0
    for names, texts in _blocks(items, item_id, item_text, block_bytes):
        bare = Block(names, texts, window, shingle)
        counts = _corpus_counts(docs, text, context.broadcast(bare))
        ready = Block(names, texts, window, shingle)
        ready.choose(counts)
        plain = _with_hits(plain, text, context.broadcast(ready), kept, parts > 0)
        parts += 1
    return plain if parts else _with_hits(plain, text, None, kept, False)


def _with_hits(docs: DataFrame, text: str, block, kept: list, more: bool) -> DataFrame:
    """Adds the block's hits to those of the blocks before it, if there were any."""
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, to in sized(column, _CHUNK):
                words = Words(*packed(column.slice(lo, to - lo)))
                part = batch.slice(lo, to - lo)
                rows = to - lo
                at, width = np.zeros(0, int), np.zeros(0, int)
                named = [set() for _ in range(rows)]
                if block is not None:
                    at, window = block.value.found(words)
                    width = block.value.width[window]
                    pairs = np.unique(np.stack([words.text[at], block.value.item[window]]), axis=1) if len(at) else np.zeros((2, 0), int)
                    for row, item in pairs.T.tolist():
                        named[row].add(block.value.names[item])
                if more:
                    old = part.column(part.schema.get_field_index("hits")).to_pylist()
                    spans = [(words.first[row] + s["start"], s["end"] - s["start"]) for row, one in enumerate(old) for s in one]
                    at, width = np.append(at, [s[0] for s in spans]).astype(int), np.append(width, [s[1] for s in spans]).astype(int)
                    for row, one in enumerate(part.column(part.schema.get_field_index("items")).to_pylist()):
                        named[row].update(one)
                start, end = _marked(words, at, width)
                owner = words.text[start]
                base = words.first[owner]
                lists = pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32))
                spans = pa.StructArray.from_arrays([pa.array((start - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], ["start", "end"])
                added = [pa.array(np.diff(words.first).astype(np.int64)), pa.ListArray.from_arrays(lists, spans),
                         pa.array([sorted(x) for x in named], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(f.name)) for f in kept] + added,
                                                 names=[f.name for f in kept] + ADDED.names)

    return docs.mapInArrow(run, StructType(kept + ADDED.fields))
