"""Suffix arrays of many strings at once, by linear grouping of Lyndon-prefix suffix groups.

Grouping: suffixes are grouped by their first symbol. Groups are taken in descending order
of their Lyndon prefixes; every suffix of the group finds its previous smaller suffix (the
nearest earlier one in a lower group) by following the pointers of what lies between. The
suffixes pointed to extend their Lyndon prefix by one copy of the group's for each suffix
that points to them: they leave their group for new ones right behind it, in order of the
number of copies. Emission: the array is filled from the smallest suffix on; each ranked
suffix puts the suffixes whose Lyndon prefix ends where it begins, which are the one before
it and those down its chain of pointers, to the front of their groups. There is no recursion
and no renaming.

Strings are independent, so a step handles the current group (or rank) of all strings at
once in arrays; the number of steps is that of the longest string. Strings of similar
length belong in one call.
"""

from __future__ import annotations

import numpy as np

from taskmine.llm.arrays import ramp


def suffix_arrays(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted suffix starts (positions in ``symbols``) of each string, strings one after the other.

    Each string must end with a symbol below all its others.
    """
    n = len(symbols)
    sa, start, previous = _groups(symbols, offsets)
    del sa
    return _ordered(offsets, start, previous, n)


def _groups(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Array in groups, the group start of each suffix, and the previous smaller suffix of each (-1: none)."""
    n, count = len(symbols), len(offsets) - 1
    owner = np.repeat(np.arange(count, dtype=np.int32), np.diff(offsets))
    key = owner.astype(np.int64) * 512 + symbols
    sa = np.argsort(key, kind="stable").astype(np.int32)
    ordered = key[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    heads = np.flatnonzero(new)
    size = np.zeros(n, np.int32)
    size[heads] = np.diff(np.append(heads, n))
    start = np.empty(n, np.int32)
    start[sa] = np.repeat(heads, size[heads])
    place = np.empty(n, np.int32)
    place[sa] = np.arange(n, dtype=np.int32)
    previous = np.arange(-1, n - 1, dtype=np.int32)
    base = offsets[:-1].astype(np.int64)
    end = offsets[1:].astype(np.int64).copy()
    moved = np.zeros(n, bool)
    active = np.flatnonzero(end > base + 1)
    while len(active):
        head = start[sa[end[active] - 1]].astype(np.int64)
        length = end[active] - head
        index = np.repeat(head, length) + ramp(length)
        suffix = sa[index].astype(np.int64)
        limit, low = np.repeat(head, length), np.repeat(base[active], length)
        # previous smaller suffixes: what lies between a suffix and its pointer is never smaller
        open_ = np.arange(len(suffix))
        while len(open_):
            s = suffix[open_]
            p = previous[s]
            inside = p >= low[open_]
            climb = inside.copy()
            climb[inside] = start[p[inside]] >= limit[open_[inside]]
            open_, s, p = open_[climb], s[climb], p[climb]
            previous[s] = previous[p]
        p = previous[suffix]
        p = p[p >= low]
        end[active] = head
        active = active[head > base[active] + 1]
        if not len(p):
            continue
        parent, copies = np.unique(p, return_counts=True)
        group = start[parent]
        order = np.lexsort((copies, group))
        parent, copies, group = parent[order], copies[order], group[order].astype(np.int64)
        first = np.ones(len(parent), bool)
        first[1:] = group[1:] != group[:-1]
        block = np.flatnonzero(first)
        many = np.diff(np.append(block, len(parent)))
        of_block = group[block]
        tail = of_block + size[of_block] - many
        spot = np.repeat(tail, many) + ramp(many)
        moved[parent] = True
        there = sa[spot]
        displaced = there[~moved[there]]
        left = place[parent]
        vacated = left[left < np.repeat(tail, many)]
        moved[parent] = False
        sa[vacated], place[displaced] = displaced, vacated
        sa[spot], place[parent] = parent, spot
        size[of_block] -= many
        split = first.copy()
        split[1:] |= copies[1:] != copies[:-1]
        cut = np.flatnonzero(split)
        members = np.diff(np.append(cut, len(parent)))
        begin = spot[cut]
        size[begin] = members
        start[parent] = np.repeat(begin, members)
    return sa, start, np.where(previous >= np.repeat(base, np.diff(offsets)), previous, -1).astype(np.int32)


def _ordered(offsets: np.ndarray, start: np.ndarray, previous: np.ndarray, n: int) -> np.ndarray:
    """Suffixes in order, from the groups and the pointers."""
    out = np.zeros(n, np.int32)
    front = np.arange(n, dtype=np.int32)
    placed = np.zeros(n, bool)
    base = offsets[:-1].astype(np.int64)
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    base, length = base[order], length[order]
    filled = length > 0
    last = base[filled] + length[filled] - 1
    out[base[filled]] = last
    placed[last] = True
    alive = int(filled.sum())
    for rank in range(int(length[0]) if len(length) else 0):
        while alive and length[alive - 1] <= rank:
            alive -= 1
        low = base[:alive]
        s = out[low + rank].astype(np.int64) - 1
        keep = s >= low
        s, low = s[keep], low[keep]
        keep = ~placed[s]
        s, low = s[keep], low[keep]
        while len(s):
            group = start[s]
            out[front[group]] = s
            front[group] += 1
            placed[s] = True
            s = previous[s].astype(np.int64)
            keep = s >= low
            s, low = s[keep], low[keep]
            keep = ~placed[s]
            s, low = s[keep], low[keep]
    return out
