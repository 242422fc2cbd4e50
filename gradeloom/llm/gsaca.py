"""Linear suffix sorting by grouping, for sequences of integers.

Phase 1 sorts the suffixes into groups that share their longest Lyndon prefix. Groups are taken in descending
order; each member i gets its pointer to the previous suffix in a smaller group. The prefix of the suffix pointed
at goes on with the group's own, as many times as members point there, which moves it into a new group directly
above its old one, further above the more often. Phase 2 runs through the result from its smallest suffix s: the
suffixes whose Lyndon prefix ends at s are s - 1, its pointer, and so on down to the pointer of s; each takes
the next free place of its group. Nothing is renamed and sorted again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    n = len(text)
    members: list[list[int]] = []
    by_symbol: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(text):
        by_symbol[c].append(i)
    group = [0] * n
    for g, c in enumerate(sorted(by_symbol)):
        members.append(by_symbol[c])
        for i in by_symbol[c]:
            group[i] = g
    live = [len(m) for m in members]  # members that have not moved up
    below = [*range(-1, len(members) - 1)]  # the next smaller group
    above = [*range(1, len(members)), -1]
    g = len(members) - 1
    done = [False] * len(members)
    prev = [-1] * n
    order: list[list[int]] = []

    def lift(old: int, which: list[int]) -> None:
        """Members of a group that move into a new one directly above it; all of them may as well stay."""
        if live[old] == len(which):
            return
        new, top = len(members), above[old]
        live[old] -= len(which)
        members.append(which)
        live.append(len(which))
        done.append(False)
        below.append(old)
        above.append(top)
        above[old] = new
        if top >= 0:
            below[top] = new
        for j in which:
            group[j] = new

    while g >= 0:
        own = members[g]
        if len(own) != live[g]:
            own = [i for i in own if group[i] == g]
        done[g] = True
        if len(own) == 1:  # as most groups are
            (i,) = own
            j = i - 1
            while j >= 0 and done[group[j]]:
                j = prev[j]
            prev[i] = j
            if j >= 0 and live[group[j]] > 1:
                lift(group[j], [j])
        else:
            own.sort()
            times: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and done[group[j]]:
                    j = prev[j]
                prev[i] = j
                if j >= 0 and live[group[j]] > 1:
                    times[j] = times.get(j, 0) + 1
            moved: dict[tuple[int, int], list[int]] = defaultdict(list)
            for j, k in times.items():
                moved[-k, group[j]].append(j)
            for (_, old), which in sorted(moved.items()) if len(moved) > 1 else moved.items():
                lift(old, which)
        order.append(own)
        g = below[g]
    at, free, place = 0, [0] * len(order), group
    for r, own in enumerate(reversed(order)):
        free[r] = at
        at += len(own)
        for i in own:
            place[i] = r
    sa = [-1] * n
    s, stop = n, -1
    for r in range(-1, n):
        if r >= 0:
            s = sa[r]
            stop = prev[s]
        j = s - 1
        while j > stop:
            g = place[j]
            sa[free[g]] = j
            free[g] += 1
            j = prev[j]
    return sa


def common_prefixes(text: Sequence[int], sa: list[int]) -> list[int]:
    """lcp[r]: symbols that suffixes sa[r - 1] and sa[r] share (0 at r = 0)."""
    n = len(text)
    rank, lcp, h = [0] * n, [0] * n, 0
    for r, i in enumerate(sa):
        rank[i] = r
    for i in range(n):
        r = rank[i]
        if r:
            j = sa[r - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            lcp[r] = h
            h = h - 1 if h else 0
        else:
            h = 0
    return lcp
