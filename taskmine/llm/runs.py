"""Periodic runs of words: stretches that repeat with a period, found by maximal pairs.

A run is a stretch with smallest period q and length of at least max(``least``, 3 q) that no
neighbouring word extends. Then its first length - q words stand again q words later, and the
two places differ in the word before and in the word behind: they are a maximal pair. Turned
round, every maximal pair of length m at a distance q with 2 q <= m and q + m >= ``least`` is a
run, with no extension needed; pairs at multiples of the period give the same stretch, whose
smallest distance is its period.

Maximal pairs come from the LCP-interval tree of a text's suffixes, bottom up. Each interval
holds its places in classes by the word to their left. Where two children of an interval meet,
the smaller one's places look up those of the larger one that are near enough, in the classes
of other left words only: the right words differ since the children do. As m >= 2/3 ``least``,
only suffixes whose first words (``_gram`` of them) stand twice in the text are sorted and put
into the tree, and only subtrees that hold two near places and two left words are walked.

A text is the unit of work: its suffixes are sorted in arrays, many texts at once. Null and
empty texts have no words and no runs. Texts of one word repeated, ties (equal exponents: the
smallest start, then the smallest period) and repeated rows are defined; rows stay one for one.
Columns other than the text pass through, except those the operator writes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from taskmine.llm.arrays import SpacedWords, U, columns_of, mixed, packed, powers, sized

LEAST = 24
_CHUNK = 1 << 20
_RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])


def _gram(least: int) -> int:
    """Words that both places of every pair in question share: a power of two up to 2/3 of ``least``."""
    return 1 << ((2 * least // 3).bit_length() - 1)


def _repeated(words: SpacedWords, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that begin a gram which stands twice in their text, and a number for each gram."""
    n = len(words.start) - size + 1
    if n <= 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value, width = words.hash, 1
    while width < size:
        value = mixed(value[:-width] * U(0x9E3779B97F4A7C15) + value[width:])
        width *= 2
    at = np.flatnonzero(words.text[:n] == words.text[size - 1:])
    value = mixed(value[at] ^ mixed(words.text[at].astype(np.uint64) + U(1)))
    order = np.argsort(value, kind="stable")
    ordered = value[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] = same
    twice[:-1] |= same
    number = np.cumsum(np.concatenate([[False], ~same]))[twice]
    place = at[order[twice]]
    back = np.argsort(place, kind="stable")
    return place[back], number[back]


def _ranked(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks from 1 of rows of keys, the first key leading."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        ordered = key[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def _sorted_suffixes(words: SpacedWords, place: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """Order of ``place`` by group, and inside a group by the words that follow: prefix doubling of ranks."""
    last = words.first[words.text[place] + 1]  # the first word behind the text
    n = len(words.start)
    behind = place[place + size < last] + size
    need = np.union1d(place, behind)
    end = words.first[words.text[need] + 1]
    number = np.unique(words.hash, return_inverse=True)[1].astype(np.int64) + 1
    bits = int(number.max()).bit_length()
    keys, packed_key, used = [], np.zeros(len(need), np.int64), 0
    for k in range(size):
        if used + bits > 62:
            keys.append(packed_key)
            packed_key, used = np.zeros(len(need), np.int64), 0
        symbol = np.where(need + k < end, number[np.minimum(need + k, n - 1)], 0)
        packed_key = (packed_key << bits) | symbol
        used += bits
    rank = np.zeros(n, np.int64)
    rank[need] = _ranked([*keys, packed_key])
    span = size
    while True:
        order = np.lexsort((rank[place], group))
        tied = (group[order[1:]] == group[order[:-1]]) & (rank[place[order[1:]]] == rank[place[order[:-1]]])
        if not tied.any():
            return order
        # what follows a tied place is ranked too; other places of ``need`` differ from all others by now
        follow = np.zeros(n, np.int64)
        inner = place[place + span < last]
        follow[inner] = rank[inner + span]
        rank[need] = _ranked([rank[need], follow[need]])
        span *= 2


def _common(words: SpacedWords, left: np.ndarray, right: np.ndarray, least: int) -> np.ndarray:
    """How many words two places of one text share from there on (``least`` at least), by prefix hashes."""
    up, down = powers(len(words.start) + 1)
    sums = np.zeros(len(words.start) + 1, np.uint64)
    np.cumsum(words.hash * up[:len(words.start)], out=sums[1:])
    low = np.full(len(left), least, np.int64)
    high = words.first[words.text[left] + 1] - np.maximum(left, right)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        a, b = left[open_], right[open_]
        middle = (low[open_] + high[open_] + 1) // 2
        equal = (sums[a + middle] - sums[a]) * down[a] == (sums[b + middle] - sums[b]) * down[b]
        low[open_] = np.where(equal, middle, low[open_])
        high[open_] = np.where(equal, high[open_], middle - 1)
        open_ = open_[low[open_] < high[open_]]
    return low


def _meet(one: tuple, other: tuple, shared: int, least: int, out: list) -> tuple:
    """Two children of an interval: pairs between them go to ``out``; the larger one takes in the smaller."""
    if len(one[0]) < len(other[0]):
        one, other = other, one
    places, classes = one
    reach, nearest = shared // 2, least - shared
    for left, own in other[1].items():
        if len(classes) == 1 and left in classes:
            continue
        for x in own:
            lo, hi = bisect_left(places, x - reach), bisect_right(places, x + reach)
            if lo == hi:
                continue
            if hi - lo <= len(classes):
                near = [(y, None) for y in places[lo:hi]]
            else:
                near = [(y, c) for c, of in classes.items() if c != left for y in of[bisect_left(of, x - reach):bisect_right(of, x + reach)]]
            here = classes.get(left, ())
            for y, c in near:
                if abs(x - y) >= nearest:
                    if c is None:
                        k = bisect_left(here, y)
                        if k < len(here) and here[k] == y:
                            continue
                    out.append((min(x, y), max(x, y), shared))
    for left, own in other[1].items():
        mine = classes.setdefault(left, [])
        for x in own:
            insort(mine, x)
            insort(places, x)
    return one


def _pairs(place: list[int], left: list[int], common: list[int], least: int) -> list[tuple[int, int, int]]:
    """Maximal pairs that are runs, (place, later place, words shared), of suffixes in order, bottom up."""
    out, stack = [], []
    current = ([place[0]], {left[0]: [place[0]]})
    for k, shared in enumerate(common):
        while stack and stack[-1][1] >= shared:
            waiting, its = stack.pop()
            current = _meet(waiting, current, its, least, out)
        stack.append((current, shared))
        current = ([place[k + 1]], {left[k + 1]: [place[k + 1]]})
    while stack:
        waiting, its = stack.pop()
        current = _meet(waiting, current, its, least, out)
    return out


def runs_of(words: SpacedWords, least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs, in order of text, start and period."""
    size = _gram(least)
    place, group = _repeated(words, size)
    if not len(place):
        return []
    order = _sorted_suffixes(words, place, group, size)
    place, group = place[order], group[order]
    together = group[1:] == group[:-1]
    common = np.zeros(len(place) - 1, np.int64)
    pair = np.flatnonzero(together)
    common[pair] = _common(words, place[pair], place[pair + 1], size)
    # a subtree is walked only if two places are near enough and left words differ
    first = words.first[words.text[place]]
    left = np.where(place > first, words.hash[np.maximum(place - 1, 0)].view(np.int64), np.int64(-1))
    left = np.unique(left, return_inverse=True)[1]
    left[place == first] = -1
    head = np.flatnonzero(np.concatenate([[True], ~together]))
    stop = np.append(head[1:], len(place))
    by_place = np.lexsort((place, group))
    gap = np.full(len(place), np.iinfo(np.int64).max)
    moved = place[by_place]
    inner = np.flatnonzero(group[by_place][1:] == group[by_place][:-1])
    gap[inner] = moved[inner + 1] - moved[inner]
    start_of = np.searchsorted(group[by_place], group[head])
    nearest = np.minimum.reduceat(gap, start_of)
    longest = np.maximum.reduceat(np.append(common, 0), head)
    varied = np.maximum.reduceat(left, head) != np.minimum.reduceat(left, head)
    found: dict[tuple[int, int], int] = {}
    for a, b in zip(head[(2 * nearest <= longest) & varied], stop[(2 * nearest <= longest) & varied]):
        for x, y, shared in _pairs(place[a:b].tolist(), left[a:b].tolist(), common[a:b - 1].tolist(), least):
            key = (x, shared + y - x)
            found[key] = min(found.get(key, y - x), y - x)
    rows = sorted((x, q, length) for (x, length), q in found.items())
    text = words.text[[r[0] for r in rows]].tolist() if rows else []
    return [(t, x - int(words.first[t]), length, q) for t, (x, q, length) in zip(text, rows)]


def _best(runs: list[dict]) -> dict | None:
    best = None
    for run in runs:  # by start, then period: of equal exponents the first stays
        if best is None or run["length"] * best["period"] > best["length"] * run["period"]:
            best = run
    return best


def collapsed(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period; word numbers, by start, then period), ``best``
    (the run of the greatest length / period, null if there is none) and ``collapsed``: the words
    left when each run keeps its first period, joined by one space."""
    added = [StructField("runs", ArrayType(_RUN)), StructField("best", _RUN), StructField("collapsed", StringType())]
    names = [f.name for f in added]
    passed = docs.drop(*names)
    if text not in passed.columns:
        raise ValueError(f"the operator writes {text}; rename the column first")
    schema = StructType([*passed.schema.fields, *added])
    columns = [*passed.columns, *names]
    run_type = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def work(batches):
        for batch in batches:
            (column,) = columns_of(batch, [text])
            for lo, to in sized(column, _CHUNK):
                data, offsets = packed(column.slice(lo, to - lo))
                words = SpacedWords(data, offsets)
                lists: list[list[dict]] = [[] for _ in range(to - lo)]
                kept = np.ones(len(words.start), bool)
                for t, start, length, period in runs_of(words, least):
                    lists[t].append({"start": start, "length": length, "period": period})
                    kept[words.first[t] + start + period:words.first[t] + start + length] = False
                out, ends = words.joined(kept)
                texts = pa.LargeStringArray.from_buffers(to - lo, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out))
                part = batch.slice(lo, to - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lists, pa.list_(run_type)), pa.array([_best(x) for x in lists], run_type), texts.cast(pa.string())],
                    names=columns)

    return passed.mapInArrow(work, schema)


def with_repeated_end(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where every text whose crc32(doc_id) ends in 0 goes on, from a word on, with one stretch of its words again and again."""
    h = F.crc32(F.col(doc_id).cast("string"))
    chosen = h % 10 == 0
    words = F.when(chosen, F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    read = docs.select(F.struct(*docs.columns).alias("row"), words.alias("words"), F.floor(h / 10).alias("g")).withColumn("n", F.size("words"))
    n, g = F.col("n"), F.col("g")
    read = read.withColumn("a", F.when(n > 0, g % n).cast("int"))
    a = F.col("a")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    edited = F.concat_ws(" ", F.slice("words", F.lit(1), a), again)
    value = F.when(n > 0, edited).otherwise(F.col("row")[text])
    return read.select(*[(value if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
