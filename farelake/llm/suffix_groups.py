"""Suffix array of an integer string by linear grouping construction.

A suffix's Lyndon prefix is its longest prefix that is a Lyndon word; it ends
where the next smaller suffix begins. Phase 1 finds the groups of suffixes with
equal Lyndon prefix. Groups start as first letters and are taken in descending
order. A taken group's suffixes look for their previous smaller suffix by
following pointers set before; the suffixes pointed at move, by how often they
are pointed at, to new groups right above their own, since their Lyndon prefix
grows by that of the group taken as often. Phase 2 emits the order: each suffix
that gets its place lets the suffixes whose next smaller one it is, found along the
same pointers, take the first free places of their groups. Nothing is renamed or
solved recursively.
"""

from __future__ import annotations


def _groups(text: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Previous smaller suffix of each suffix (-1: none), its group, group sizes, and groups in ascending order."""
    start: dict[int, list[int]] = {}
    for i, letter in enumerate(text):
        start.setdefault(letter, []).append(i)
    members = [set(start[letter]) for letter in sorted(start)]
    count = len(members)
    lower, higher = list(range(-1, count - 1)), [*range(1, count), -1]
    group = [0] * len(text)
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    unknown = -2
    previous = [unknown] * len(text)
    descending = []
    taken = count - 1
    while taken >= 0:
        descending.append(taken)
        pointed: dict[int, int] = {}
        for i in sorted(members[taken]):
            j = i - 1
            while j >= 0 and previous[j] != unknown:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        moving: dict[int, dict[int, list[int]]] = {}
        for j, times in pointed.items():
            moving.setdefault(group[j], {}).setdefault(times, []).append(j)
        for g, by_times in moving.items():
            times_up = sorted(by_times)
            if sum(map(len, by_times.values())) == len(members[g]):
                times_up = times_up[1:]  # all move: the lowest of them may keep the group
            below = g
            for times in times_up:
                new, above = len(members), higher[below]
                members.append(set(by_times[times]))
                members[g].difference_update(by_times[times])
                for j in by_times[times]:
                    group[j] = new
                lower.append(below)
                higher.append(above)
                higher[below] = lower[above] = new
                below = new
        taken = lower[taken]
    return previous, group, [len(m) for m in members], descending[::-1]


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in lexicographic order."""
    n = len(text)
    if not n:
        return []
    previous, group, sizes, ascending = _groups(text)
    free, at = [0] * len(sizes), 0
    for g in ascending:
        free[g] = at
        at += sizes[g]
    order, placed = [-1] * n, bytearray(n)
    smaller = n  # the end of the text is smaller than all suffixes
    for k in range(-1, n):
        if k >= 0:
            smaller = order[k]
        j = smaller - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return order


def neighbour_overlaps(text: list[int], order: list[int]) -> list[int]:
    """For each suffix the longer of its common prefixes with the suffixes before and after it in the order."""
    n = len(text)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    longest, h = [0] * n, 0
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            longest[i] = max(longest[i], h)
            longest[j] = max(longest[j], h)
            h = max(0, h - 1)
        else:
            h = 0
    return longest
