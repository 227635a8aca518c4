"""Suffix sorting by linear grouping, without recursion or renaming.

Phase one keeps suffixes in groups ordered by the prefix that their members share (first
the smallest letter, last the largest) and works through the groups from the last to the
first. A group's members that share the same place of the next smaller group before them
(their previous-smaller pointer) lengthen that predecessor's prefix by the group's: the
predecessors are moved behind what remains of their own group. After it every group is one
Lyndon prefix. Phase two walks the order from the front: each suffix put down puts down the
suffixes whose previous-smaller chain leads to it, at the front of their groups.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of a sequence of integers, in order. The end sorts before all."""
    n = len(text)
    if n < 2:
        return list(range(n))
    # A sentinel smaller than any letter ends the sequence.
    letters = {c: i + 1 for i, c in enumerate(sorted(set(text)))}
    t = [letters[c] for c in text] + [0]
    n += 1
    sizes = [0] * (len(letters) + 1)
    for c in t:
        sizes[c] += 1
    starts, at = [], 0
    for k in sizes:
        starts.append(at)
        at += k
    order, spot, group = [0] * n, [0] * n, [0] * n  # suffixes by group; a suffix's place; its group's start
    fill = starts[:]
    for i in range(n):
        c = t[i]
        order[fill[c]], spot[i], group[i] = i, fill[c], starts[c]
        fill[c] += 1
    length = {s: k for s, k in zip(starts, sizes)}  # group start -> members
    prev = [-1] * n
    # Every group, from the last; groups split off behind a start not yet reached are met in turn.
    stop = n
    while stop > 0:
        start = group[order[stop - 1]]
        members = order[start:stop]
        for i in sorted(members):
            # The nearest position before i whose group is smaller; equal or larger ones are skipped along their pointers.
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[i] = p
        # How often each predecessor is pointed at from this group; those of most come last.
        seen: dict[int, int] = {}
        for i in members:
            if prev[i] >= 0:
                seen[prev[i]] = seen.get(prev[i], 0) + 1
        by: dict[int, list[int]] = {}
        for p, k in seen.items():
            by.setdefault(k, []).append(p)
        for k in sorted(by, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by[k]:
                moved.setdefault(group[p], []).append(p)
            for g, ps in moved.items():
                m = length[g]
                if len(ps) == m:
                    continue
                end = g + m
                new = end - len(ps)
                leave = set(ps)
                tail = [x for x in order[new:end] if x not in leave]
                holes = [spot[p] for p in ps if spot[p] < new]
                for x, h in zip(tail, holes):
                    order[h], spot[x] = x, h
                for j, p in enumerate(ps):
                    order[new + j], spot[p], group[p] = p, new + j, new
                length[g], length[new] = m - len(ps), len(ps)
        stop = start
    # Phase two.
    out, front, done = [0] * n, dict.fromkeys(length, 0), [False] * n
    out[0] = n - 1
    for r in range(n):
        i = out[r]
        p = i - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[g + front[g]] = p
            front[g] += 1
            done[p] = True
            p = prev[p]
    return out[1:]
