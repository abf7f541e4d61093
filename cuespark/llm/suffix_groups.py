"""Suffix array by linear grouping construction.

Suffixes are first put into groups by their Lyndon prefix.  Groups start as those of
the first symbol and are taken in descending order; when a group with prefix u is
taken, it is final, and for each of its suffixes the nearest earlier suffix in a
lower group (its previous smaller suffix) gets its prefix extended by u: those
suffixes leave their group v for new groups v u, v u u, ... just above it.  Then one
pass in ascending order emits every group: a suffix is its Lyndon prefix followed by
its next smaller suffix, so when that one is emitted, it takes the next place of its
group.  No names are given to substrings and nothing recurs.

Defined cases: no symbols have an empty array; symbols are whole numbers of any size and
may all be equal; a suffix that begins another one comes before it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def suffix_array(symbols) -> np.ndarray:
    """Starts of the suffixes of a sequence of integers, in ascending order."""
    given = np.asarray(symbols)
    n = len(given)
    if not n:
        return np.zeros(0, np.int64)
    text = np.empty(n + 1, np.int64)
    text[:n] = np.unique(given, return_inverse=True)[1] + 1
    text[n] = 0
    order = np.argsort(text, kind="stable")
    firsts = np.flatnonzero(np.diff(text[order], prepend=-1))
    sizes = np.diff(firsts, append=n + 1)
    group_of = np.empty(n + 1, np.int64)
    group_of[order] = np.repeat(firsts, sizes)
    place_of = np.empty(n + 1, np.int64)
    place_of[order] = np.arange(n + 1)
    held, place, group = order.tolist(), place_of.tolist(), group_of.tolist()  # held[place]: suffix; group: place of its group's first
    size = dict(zip(firsts.tolist(), sizes.tolist()))
    smaller = [-1] * (n + 1)  # the previous smaller suffix

    high = n
    while high > 0:
        start = group[held[high]]
        if start == high:
            i = held[high]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:  # one suffix to extend
                g = group[j]
                left = size[g] - 1
                if left:
                    size[g] = left
                    last, p = g + left, place[j]
                    other = held[last]
                    held[p], held[last] = other, j
                    place[other], place[j] = p, last
                    group[j] = last
                    size[last] = 1
            high = start - 1
            continue
        extended = Counter()
        for i in sorted(held[start : high + 1]):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = smaller[j]
            smaller[i] = j
            extended[j] += 1
        extended.pop(-1, None)
        if extended:
            by_times: dict[int, list[int]] = {}
            for j, times in extended.items():
                by_times.setdefault(times, []).append(j)
            for times in sorted(by_times, reverse=True):
                members = by_times[times]
                for j in members:
                    g = group[j]
                    left = size[g] = size[g] - 1
                    last, p = g + left, place[j]
                    other = held[last]
                    held[p], held[last] = other, j
                    place[other], place[j] = p, last
                new = Counter()
                for j in members:
                    g = group[j]
                    group[j] = first = g + size[g]
                    new[first] += 1
                size.update(new)  # where a whole group was extended, it keeps its place
        high = start - 1

    # Ascending: the suffixes whose next smaller suffix is s are s - 1 and its previous smaller ones, down to that of s.
    out = [0] * (n + 1)
    out[0] = n
    smaller[n] = -1
    free = {g: g for g in group}
    for k in range(n + 1):
        s = out[k]
        stop, j = smaller[s], s - 1
        while j != stop:
            g = group[j]
            at = free[g]
            out[at] = j
            free[g] = at + 1
            j = smaller[j]
    return np.array(out[1:], np.int64)
