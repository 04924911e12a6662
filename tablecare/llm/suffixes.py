"""Suffix sorting by groups of Lyndon prefixes.

First phase. Suffixes start in groups by their first symbol. Groups are processed from the
highest to the lowest; what a processed group's members have to their left, the nearest suffix
of a lower group, is their previous-smaller pointer. A suffix that is pointed at has its Lyndon
prefix extended by the group's, as often as it is pointed at, and so moves, with all that move
from its group by the same count, to a new group right above its old one. In the end, a group is
all suffixes with the same Lyndon prefix.

Second phase. Going through the order from the front, each suffix puts the one before it, and
that one's previous-smaller pointers in turn until one is placed, at the front of what is left of
their groups. No symbols are renamed and nothing recurs.

Processed suffixes drop out of a forest in which each leads to the nearest left that is still
there, so finding pointers takes next to linear time.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` in order; a suffix comes before those it begins."""
    n = len(symbols)
    # Positions count from 1; 0 stands for no position.
    order = sorted(range(1, n + 1), key=[0, *symbols].__getitem__)
    slot, group, size = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    begin, last = 0, None
    for k, p in enumerate(order):
        if symbols[p - 1] != last:
            begin, last = k, symbols[p - 1]
        slot[p], group[p] = k, begin
        size[begin] += 1

    left = list(range(n + 1))
    smaller = [0] * (n + 1)
    end = n - 1
    while end >= 0:
        begin = group[order[end]]
        members = order[begin : end + 1]
        end = begin - 1
        for p in members:
            left[p] = p - 1
        targets = []
        for p in members:
            r = p - 1
            while left[r] != r:
                left[r] = left[left[r]]
                r = left[r]
            left[p] = r
            smaller[p] = r
            if r:
                targets.append(r)
        if len(targets) == 1:
            levels = [targets]
        elif not targets:
            continue
        else:
            unique = set(targets)
            if len(unique) == len(targets):
                levels = [targets]
            else:
                times: dict[int, int] = {}
                for r in targets:
                    times[r] = times.get(r, 0) + 1
                by_times: dict[int, list[int]] = {}
                for r, t in times.items():
                    by_times.setdefault(t, []).append(r)
                levels = [by_times[t] for t in sorted(by_times, reverse=True)]
        for moving in levels:
            # Swap those that move to the end of their groups, which then become groups.
            gone: dict[int, int] = {}
            for r in moving:
                g = group[r]
                m = gone.get(g, 0)
                gone[g] = m + 1
                to, at = g + size[g] - 1 - m, slot[r]
                if at != to:
                    q = order[to]
                    order[at], slot[q] = q, at
                    order[to], slot[r] = r, to
            for g, m in gone.items():
                rest = size[g] - m
                if rest:
                    size[g] = rest
                    size[g + rest] = m
                    for r in order[g + rest : g + rest + m]:
                        group[r] = g + rest

    out = [0] * n
    front = list(range(n))
    placed = bytearray(n + 1)
    placed[0] = 1
    p = n
    for k in range(-1, n):
        if k >= 0:
            p = out[k] - 1
        while not placed[p]:
            placed[p] = 1
            g = group[p]
            out[front[g]] = p
            front[g] += 1
            p = smaller[p]
    return [p - 1 for p in out]
