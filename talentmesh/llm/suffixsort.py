"""Suffix sorting by linear grouping, after Baier's construction.

First every suffix is put into the group of its longest Lyndon prefix; groups are processed in
descending order, and each member points to the nearest suffix before it in a lower group (the
previous smaller one). Suffixes that gather pointers move up into a group of their own: the
members' prefix continues theirs. Then the groups, in ascending order, emit the suffix array
from left to right along the same pointers. There is no recursion and no renaming.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; a shorter suffix precedes its extensions.

    ``text`` holds integers of any size, repeated and empty texts included.
    """
    n = len(text)
    if not n:
        return []
    # Group 0 belongs to the sentinel, the empty suffix at n, which is below all others.
    alphabet = {c: g for g, c in enumerate(sorted(set(text)), 1)}
    group = [alphabet[c] for c in text]
    group.append(0)
    members: list[list[int]] = [[] for _ in range(len(alphabet) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(alphabet)))
    above = [*range(1, len(alphabet) + 1), -1]
    before, done = [-1] * (n + 1), bytearray(n + 1)

    g = len(alphabet)
    while g > 0:
        own = [i for i in members[g] if group[i] == g]
        own.sort()
        pointers: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            before[i] = p
            done[i] = 1
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
        members[g] = own
        if pointers:
            by_count: dict[int, list[int]] = {}
            for p, count in pointers.items():
                by_count.setdefault(count, []).append(p)
            for count in sorted(by_count, reverse=True):
                moved: dict[int, int] = {}
                for p in by_count[count]:
                    low = group[p]
                    high = moved.get(low)
                    if high is None:
                        high = moved[low] = len(members)
                        members.append([])
                        up = above[low]
                        below.append(low)
                        above.append(up)
                        below[up] = high
                        above[low] = high
                    members[high].append(p)
                    group[p] = high
        g = below[g]

    start, at, g = [0] * len(members), 1, above[0]
    while g != -1:
        start[g] = at
        at += sum(1 for i in members[g] if group[i] == g)
        g = above[g]
    order, placed = [-1] * (n + 1), bytearray(n + 1)
    order[0] = n
    placed[n] = 1
    for at in range(n + 1):
        j = order[at] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = before[j]
    return order[1:]
