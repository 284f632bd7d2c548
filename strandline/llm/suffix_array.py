"""Suffix arrays by grouping.

Suffixes start in groups by their first symbol. Groups are taken in descending order. Every suffix of a group points to
the nearest earlier suffix of a smaller group; those suffixes have the group's Lyndon word as their next context, once
or several times in a row, and move into new groups right behind the ones they leave. When all groups are done, all
suffixes of a group share their Lyndon prefix. One ascending sweep then emits the order: placing a suffix places, in
their groups' next free places, the suffixes whose Lyndon prefix ends where it starts, along the same pointers. Nothing
is renamed and no smaller string is sorted on the way.

suffix_arrays() does the same for many strings in step: each step takes the highest open group, later the next place, of
every string at once, in numpy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _grouped(text: Sequence[int]) -> tuple[list[int], list[int]]:
    """(group of each suffix, named by its first place in the order; the nearest earlier suffix of a smaller group)."""
    n = len(text)
    buckets: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        if c in buckets:
            buckets[c].append(i)
        else:
            buckets[c] = [i]
    group, previous = [0] * n, [-1] * n
    members: dict[int, list[int]] = {}
    size: dict[int, int] = {}
    begins: dict[int, int] = {}  # where a group ends -> where it begins
    at = 0
    for c in sorted(buckets):
        own = buckets[c]
        for i in own:
            group[i] = at
        members[at], size[at] = own, len(own)
        begins[at + len(own)] = at
        at += len(own)
    end = n
    while end > 0:
        g = begins[end]
        own = [i for i in members.pop(g) if group[i] == g]
        own.sort()
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            if len(times) == 1 or max(times.values()) == 1:
                levels = [list(times)]
            else:
                by: dict[int, list[int]] = {}
                for p, k in times.items():
                    by.setdefault(k, []).append(p)
                levels = [by[k] for k in sorted(by, reverse=True)]
            for level in levels:
                leaving: dict[int, list[int]] = {}
                for p in level:
                    h = group[p]
                    if h in leaving:
                        leaving[h].append(p)
                    else:
                        leaving[h] = [p]
                for h, moved in leaving.items():
                    whole, part = size[h], len(moved)
                    if part == whole:
                        continue
                    new = h + whole - part
                    size[h], size[new] = whole - part, part
                    begins[h + whole], begins[new] = new, h
                    members[new] = moved
                    for p in moved:
                        group[p] = new
        end = g
    return group, previous


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """The starts of all suffixes of a string of whole numbers, in lexicographic order."""
    if not len(symbols):
        return []
    text = [*symbols, min(symbols) - 1]
    group, previous = _grouped(text)
    n = len(text)
    order, free, placed = [0] * n, list(range(n)), bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return order[1:]


def _initial(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Slots of all suffixes in their first groups, by string and symbol."""
    n = len(symbols)
    order = np.lexsort((symbols, owner))
    new = np.ones(n, bool)
    new[1:] = (symbols[order[1:]] != symbols[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    start = np.flatnonzero(new)
    group = np.full(n + 1, -1, np.int64)  # the last entry answers for "no suffix"
    group[order] = np.repeat(start, np.diff(np.append(start, n)))
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    size, begins = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
    size[start] = np.diff(np.append(start, n))
    begins[np.append(start[1:], n)] = start
    return order, where, group, size, begins


def _split(moved: np.ndarray, times: np.ndarray, order: np.ndarray, where: np.ndarray, group: np.ndarray, size: np.ndarray, begins: np.ndarray) -> None:
    """Moves suffixes behind what their groups keep; those with more repetitions of the word come later."""
    by = np.lexsort((times, group[moved])) if times.max() > 1 else np.argsort(group[moved], kind="stable")
    moved, times = moved[by], times[by]
    h = group[moved]
    n = len(h)
    fresh = np.ones(n, bool)
    fresh[1:] = h[1:] != h[:-1]
    heads = np.flatnonzero(fresh)
    count = np.diff(np.append(heads, n))
    base = h[heads] + size[h[heads]] - count  # where a group's moved suffixes begin
    target = np.arange(n) + np.repeat(base - heads, count)
    old = where[moved]
    there = order[target]
    # who sits in the way takes the slots that are left, group by group
    first = np.repeat(base, count)
    left = old < first
    if left.any():
        where[moved] = -1
        staying = where[there] >= 0
        displaced, free = there[staying], old[left]
        order[free] = displaced
        where[displaced] = free
    order[target] = moved
    where[moved] = target
    level = fresh
    level[1:] |= times[1:] != times[:-1]
    levels = np.flatnonzero(level)
    starts = target[levels]
    ends = np.append(starts[1:], 0)
    last = np.append(np.flatnonzero(np.diff(h[levels])), len(levels) - 1)
    ends[last] = base + count
    rest = base > h[heads]
    kept = h[heads][rest]
    size[kept] = base[rest] - kept
    begins[base[rest]] = kept
    size[starts] = ends - starts
    begins[ends] = starts
    group[moved] = np.repeat(starts, np.diff(np.append(levels, n)))


def suffix_arrays(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of many strings, string by string, each in lexicographic order.

    symbols: the strings one after the other, longest first, each ending in a symbol that is its least and stands nowhere
    else in it; starts count from the beginning of all.
    """
    n, bases = len(symbols), np.cumsum(lengths) - lengths
    order, where, group, size, begins = _initial(symbols, np.repeat(np.arange(len(lengths)), lengths))
    behind = np.arange(-1, n - 1)
    behind[bases] = -1
    previous = np.append(behind, -1)
    end = bases + lengths
    live = np.arange(len(lengths))
    while len(live):
        g = begins[end[live]]
        count = end[live] - g
        limit = np.repeat(g, count)
        slots = np.arange(len(limit)) + np.repeat(g - (np.cumsum(count) - count), count)
        own = order[slots]
        p = previous[own]
        active = np.flatnonzero(group[p] >= limit)
        while len(active):
            q = previous[p[active]]
            p[active] = q
            previous[own[active]] = q
            active = active[group[q] >= limit[active]]
        p = np.sort(p[p >= 0])
        if len(p):
            first = np.ones(len(p), bool)
            first[1:] = p[1:] != p[:-1]
            at = np.flatnonzero(first)
            _split(p[at], np.diff(np.append(at, len(p))), order, where, group, size, begins)
        end[live] = g
        live = live[g > bases[live]]
    # one ascending sweep
    free, placed = np.arange(n), np.zeros(n + 1, bool)
    placed[n] = True
    order = np.zeros(n, np.int64)
    order[bases] = bases + lengths - 1
    placed[order[bases]] = True
    many = len(lengths)
    for k in range(int(lengths[0]) if n else 0):
        while lengths[many - 1] <= k:
            many -= 1
        j = behind[order[bases[:many] + k]]
        j = j[~placed[j]]
        while len(j):
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = previous[j]
            j = j[~placed[j]]
    return order
