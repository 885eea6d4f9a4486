"""Byte-level byte-pair encoding and decoding.

Boundaries of the pre-tokens are found without a regular expression: every code point
gets a symbol (its class, and what follows it), every symbol is a function between the
eight states of an automaton, and since composing such functions is associative, the
state at every code point comes from a blocked scan over whole batches of texts. Equal
slices are merged once per worker and looked up afterwards.

Null and empty texts have no tokens and decode to nothing; repeated rows are encoded
alike; other columns of the input pass through, except those the operator writes.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from taskmine.llm.arrays import packed, sized

MAX_RANK_FILE = 64 << 20  # bytes of a rank file that may be sent to every worker
_CHUNK = 1 << 20
_CACHE, _ENTRY = 48 << 20, 250  # bytes of a worker's known slices; of one besides its text and ids

# code points with the Unicode property White_Space, fixed values
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# symbols: letter, number, other, apostrophe of a suffix of one or two letters, blank
# before a visible character, other white space before one, white space before more or the end
_L, _N, _O, _A1, _A2, _P, _W1, _W = range(8)
# states: in a run of letters, numbers, others; after a blank; one or two letters of a
# suffix to come; a token just ended; in white space
_IN_L, _IN_N, _IN_O, _BLANK, _ONE, _TWO, _ENDED, _IN_W = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and starts[symbol, state]; symbols from 8 on are the first of a text."""
    to = np.zeros((16, 8), np.uint8)
    starts = np.ones((16, 8), bool)
    for symbol, own in ((_L, _IN_L), (_N, _IN_N), (_O, _IN_O)):
        to[symbol] = own
        starts[symbol, [own, _BLANK]] = False
    to[_L, _ONE], to[_L, _TWO] = _ENDED, _ONE
    starts[_L, [_ONE, _TWO]] = False
    for symbol, left in ((_A1, _ONE), (_A2, _TWO)):
        to[symbol] = left
        to[symbol, [_IN_O, _BLANK]] = _IN_O
        starts[symbol, [_IN_O, _BLANK]] = False
    to[_P], to[_W1], to[_W] = _BLANK, _ENDED, _IN_W
    starts[_W, _IN_W] = False
    to[8:] = to[:8, [_ENDED]]
    return to, starts


_TO, _STARTS = _automaton()
_CLASS: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of every code point: letter, number, other or white space."""
    if not _CLASS:
        kinds = {"L": _L, "N": _N}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _O) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE] = _W
        _CLASS.append(table)
    return _CLASS[0]


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of the code points of several texts; ``first``: where each non-empty text starts."""
    kind = _classes()[points]
    last = np.zeros(len(points), bool)
    last[first[1:] - 1] = True
    last[-1] = True
    after = np.empty_like(kind)
    after[:-1], after[-1] = kind[1:], _W
    after[last] = _W
    white = kind == _W
    seen = white & (after != _W)
    kind[seen] = np.where(points[seen] == 32, _P, _W1)
    quote = np.flatnonzero((points == 39) & (after == _L))
    if len(quote):
        one = points[quote + 1]
        kind[quote[np.isin(one, [115, 116, 109, 100])]] = _A1  # 's 't 'm 'd
        rest = quote[np.isin(one, [114, 118, 108]) & ~last[quote + 1]]
        one, two = points[rest + 1], points[np.minimum(rest + 2, len(points) - 1)]
        pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)  # 're 've 'll
        kind[rest[pair]] = _A2
    kind[first] += 8
    return kind


def _states(symbols: np.ndarray) -> np.ndarray:
    """State before every symbol: functions of blocks are composed, the blocks scanned, the states filled in."""
    n, width = len(symbols), 64
    if n <= width:
        before = np.empty(n, np.uint8)
        state = _ENDED
        for i, symbol in enumerate(symbols.tolist()):
            before[i] = state
            state = int(_TO[symbol, state])
        return before
    rows = -(-n // width)
    grid = np.full(rows * width, _W, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    total = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8)).copy()
    flat = _TO.ravel()
    for column in grid:
        total = flat[(column.astype(np.uint16) * 8)[:, None] + total]
    entry = _entries(total)
    before = np.empty((width, rows), np.uint8)
    for k, column in enumerate(grid):
        before[k] = entry
        entry = flat[column.astype(np.uint16) * 8 + entry]
    return before.T.ravel()[:n]


def _entries(functions: np.ndarray) -> np.ndarray:
    """State that enters each block, given the functions of the blocks, by prefix doubling."""
    scan, step = functions.copy(), 1
    while step < len(scan):
        scan[step:] = np.take_along_axis(scan[step:], scan[:-step].copy(), 1)
        step *= 2
    entry = np.empty(len(scan), np.uint8)
    entry[0], entry[1:] = _ENDED, scan[:-1, _ENDED]
    return entry


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all pre-tokens (with the end), and how many stand before each text and after the last."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    filled = offsets[:-1][np.diff(offsets) > 0]
    symbols = _symbols(points, np.searchsorted(at, filled))
    starts = at[_STARTS[symbols & 7, _states(symbols)] | (symbols > 7)]
    edges = np.append(starts, len(data))
    return edges, np.searchsorted(starts, offsets)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank, leftmost first, is joined until none is known."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= 64:
        return _merged_short(piece, ranks)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(ranks[piece[i:i + 2]], i, i + 2) for i in range(n - 1) if piece[i:i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != to:
            continue
        alive[j], end[i] = False, to
        if to < n:
            before[to] = i
            joined = ranks.get(piece[i:end[to]])
            if joined is not None:
                heapq.heappush(heap, (joined, i, end[to]))
        k = before[i]
        if k >= 0:
            joined = ranks.get(piece[k:to])
            if joined is not None:
                heapq.heappush(heap, (joined, k, to))
    return [ranks[piece[i:end[i]]] for i in range(n) if alive[i]]


def _merged_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a few bytes, where looking through all pairs is cheaper than a heap."""
    none = len(ranks) + (1 << 32)
    cut = list(range(len(piece) + 1))
    pairs = [ranks.get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        lowest = min(pairs)
        if lowest == none:
            break
        i = pairs.index(lowest)
        del pairs[i], cut[i + 1]
        if i < len(pairs):
            pairs[i] = ranks.get(piece[cut[i]:cut[i + 2]], none)
        if i:
            pairs[i - 1] = ranks.get(piece[cut[i - 1]:cut[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cut, cut[1:])]


class _Merges:
    """Ids of slices, kept per worker; forgotten when they take much memory."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.known, self.size = ranks, {}, 0

    def of(self, slices: list[bytes]) -> list[list[int]]:
        if self.size > _CACHE:
            self.known.clear()
            self.size = 0
        known, out = self.known, []
        for piece in slices:
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = merged(piece, self.ranks)
                self.size += len(piece) + 8 * len(ids) + _ENTRY
            out.append(ids)
        return out


def _encoded(column: pa.Array, merges: _Merges, offsets: bool) -> list[pa.Array]:
    """Lists of ids, and of the byte offset at which each token ends."""
    data, at = packed(column)
    edges, first = boundaries(data, at)
    slices = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])
    coded = slices.dictionary_encode()
    ids = merges.of(coded.dictionary.to_pylist())
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
    where = np.concatenate([[0], np.cumsum(sizes)])
    index = coded.indices.to_numpy()
    count = sizes[index]
    ends = np.concatenate([[0], np.cumsum(count)])
    order = np.repeat(where[index] - ends[:-1], count) + np.arange(ends[-1])
    tokens = flat[order]
    lists = pa.array(ends[first].astype(np.int32))
    out = [pa.ListArray.from_arrays(lists, pa.array(tokens))]
    if offsets:
        width = np.array([len(x) for x in merges.vocabulary], np.int64)
        stop = np.cumsum(width[tokens])
        base = np.repeat(at[:-1], np.diff(ends[first]))
        out.append(pa.ListArray.from_arrays(lists, pa.array((stop - base).astype(np.int32))))
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: one line per token, its bytes in base 64 and its rank."""
    with open(path, "rb") as file:
        text = file.read(MAX_RANK_FILE + 1)
    if len(text) > MAX_RANK_FILE:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in text.splitlines() if line)}


def _vocabulary(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _decoded(ids: pa.Array, ends: pa.Array | None, words: pa.Array) -> pa.Array:
    """The bytes of each list of ids, put down token by token; with ``ends`` each token must end where that says."""
    ids = pc.fill_null(ids, [])
    values = words.take(ids.flatten())
    _, stops, data = values.buffers()
    stops = np.frombuffer(stops, np.int32)[:len(values) + 1] if len(values) else np.zeros(1, np.int32)
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
    if ends is not None:
        own = stops[1:] - np.repeat(stops[at[:-1]], np.diff(at))
        if not np.array_equal(own, np.asarray(pc.fill_null(ends, []).flatten())):
            raise ValueError("a token does not end at its offset")
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(stops[at].astype(np.int32)), data if data is not None else pa.py_buffer(b"")])


def _encoding(docs: DataFrame, ranks: dict[bytes, int], text: str, added: list[StructField], decoding: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    new = [f.name for f in added]
    kept = [f for f in docs.schema.fields if f.name not in new]
    schema = StructType([*kept, *added])

    def run(batches):
        merges = _Merges(shared.value)
        offsets = "ends" in new
        merges.vocabulary = _vocabulary(shared.value) if offsets else []
        words = pa.array(merges.vocabulary, pa.binary()) if decoding else None
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, to in sized(column, _CHUNK):
                lists = _encoded(column.slice(lo, to - lo), merges, offsets)
                if decoding:
                    lists.append(_decoded(*lists, words))
                part = batch.slice(lo, to - lo)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(f.name)) for f in kept] + lists,
                                                 names=schema.names)

    return docs.mapInArrow(run, schema)


_IDS, _ENDS, _DECODED = StructField("ids", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType())), StructField("decoded", BinaryType())


def encode(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", offsets: bool = True) -> DataFrame:
    """``docs`` with ``ids`` and, if asked for, ``ends``: the byte of the text at which each token ends."""
    return _encoding(docs, ranks, text, [_IDS, _ENDS] if offsets else [_IDS], False)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``ends`` and ``decoded``: encoding and decoding in one pass, with one copy of the ranks a worker."""
    return _encoding(docs, ranks, text, [_IDS, _ENDS, _DECODED], True)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its ``ids`` (null and empty lists: no bytes).

    Where there are ``ends``, every token is held against its own; one that differs is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    kept = [f for f in encoded.schema.fields if f.name != "decoded"]
    schema = StructType([*kept, _DECODED])
    checked = "ends" in encoded.columns and encoded.schema["ends"].dataType == _ENDS.dataType

    def run(batches):
        words = pa.array(_vocabulary(shared.value), pa.binary())
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            size = max(1, len(ids) and (1 << 20) * len(ids) // max(1, len(ids.flatten())))
            for lo in range(0, len(ids), size):
                rows = batch.slice(lo, size)
                ends = rows.column(rows.schema.get_field_index("ends")) if checked else None
                joined = _decoded(ids.slice(lo, size), ends, words)
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(f.name)) for f in kept] + [joined],
                                                 names=schema.names)

    return encoded.mapInArrow(run, schema)
