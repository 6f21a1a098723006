"""Suffix arrays by grouping (Baier 2016): linear, without recursive renaming.

Phase 1 refines the groups of suffixes that share a first symbol into groups that share their
longest Lyndon prefix: groups are taken in descending order; each suffix of the group points to the
nearest suffix before it that is in a lower group, and the suffixes pointed to most often move up
into new groups right behind their old ones. Phase 2 walks the suffix array from its start and puts
each suffix before the current one, and all along its pointers, into the next free slot of its group.
"""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """The suffix array of s, non-negative integers below len(s) + 1 or so; a smaller sentinel is implied (and left out)."""
    n = len(s) + 1
    if n == 1:
        return []
    # groups by first symbol; the sentinel alone comes first
    counts = [0] * (max(s) + 2)
    for c in s:
        counts[c + 1] += 1
    starts, total = [], 1
    for c in counts[1:]:
        starts.append(total)
        total += c
    order, place, group = [0] * n, [0] * n, [0] * n
    order[0], place[n - 1], group[n - 1] = n - 1, 0, 0
    free = starts[:]
    for i, c in enumerate(s):
        k = free[c]
        free[c] = k + 1
        order[k] = i
        place[i] = k
        group[i] = starts[c]
    end = [0] * (n + 1)  # of the group that starts there
    end[0] = 1
    for a, b in zip(starts, free):
        end[a] = b
    prev = _pointers(order, place, group, end, n)
    return _emit(group, prev, n)


def _pointers(order: list[int], place: list[int], group: list[int], end: list[int], n: int) -> list[int]:
    """Phase 1: refines order, place, group and end in place; returns previous-smaller pointers."""
    prev = [-1] * n
    e = n
    while e > 0:
        last = order[e - 1]
        s = group[last]
        if s == e - 1:  # a group of one, the usual case
            j = last - 1
            while j >= 0 and group[j] >= s:
                j = prev[j]
            prev[last] = j
            if j >= 0:
                t = group[j]
                u = end[t] - 1
                if u != t:  # j moves up behind its group
                    k, other = place[j], order[u]
                    order[k], place[other] = other, k
                    order[u], place[j] = j, u
                    group[j] = u
                    end[t], end[u] = u, u + 1
            e = s
            continue
        hits: dict[int, int] = {}
        for i in sorted(order[s:e]):
            j = i - 1
            while j >= 0 and group[j] >= s:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        levels: dict[int, dict[int, list[int]]] = {}
        for j, c in hits.items():
            levels.setdefault(c, {}).setdefault(group[j], []).append(j)
        for c in sorted(levels, reverse=True):
            for t, moved in levels[c].items():
                u = end[t]
                new = u - len(moved)
                if new == t:
                    continue
                for j in moved:
                    u -= 1
                    k, other = place[j], order[u]
                    order[k], place[other] = other, k
                    order[u], place[j] = j, u
                for j in moved:
                    group[j] = new
                end[new], end[t] = end[t], new
        e = s
    return prev


def _emit(group: list[int], prev: list[int], n: int) -> list[int]:
    """Phase 2: the order of each group, from the groups and pointers alone."""
    out, free, done = [-1] * n, list(range(n)), [False] * n
    out[0], done[n - 1] = n - 1, True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            t = group[j]
            k = free[t]
            out[k] = j
            free[t] = k + 1
            done[j] = True
            j = prev[j]
    return out[1:]
