"""Suffix array by linear grouping.

Suffixes are grouped by their longest Lyndon prefix. Groups are taken in descending order: each suffix of the group
points at the last suffix before it that lies in a lower group, its previous smaller one; the suffixes pointed at
leave their group for a new one right behind it, those with more pointers behind those with fewer. When all groups
are done, a walk over the suffixes in ascending order follows the pointers and fills each group from its front. Nothing is
renamed and no shorter text is sorted first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` (codes of 0 and more) in ascending order; a suffix that is a prefix of
    another comes before it."""
    n = len(text)
    order, group, size = _by_first_code(text)
    previous = [-1] * (n + 1)
    place = [0] * (n + 1)
    for i, s in enumerate(order):
        place[s] = i

    end = n
    while end > 0:
        start = group[order[end]]
        members = order[start : end + 1]
        members.sort()
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[s] = p
        if len(members) == 1:
            p = previous[members[0]]
            if p >= 0:
                _move([p], order, place, group, size)
        else:
            pointers = Counter(map(previous.__getitem__, members))
            pointers.pop(-1, None)
            by_count: dict[int, list[int]] = {}
            for p, count in pointers.items():
                by_count.setdefault(count, []).append(p)
            for count in sorted(by_count, reverse=True):
                _move(by_count[count], order, place, group, size)
        end = start - 1

    # Second phase: the suffix behind a Lyndon prefix decides the order within a group.
    result = [-1] * (n + 1)
    front = list(range(n + 1))
    placed = bytearray(n + 1)
    result[0] = n
    placed[n] = 1
    for i in range(n + 1):
        s = result[i] - 1
        while s >= 0 and not placed[s]:
            at = group[s]
            result[front[at]] = s
            front[at] += 1
            placed[s] = 1
            s = previous[s]
    return result[1:]


def _by_first_code(text: Sequence[int]) -> tuple[list[int], list[int], dict[int, int]]:
    """Suffixes by first code with the empty one in front, the start of each suffix's group, and group sizes."""
    n = len(text)
    order = [n, *sorted(range(n), key=text.__getitem__)]
    group = [0] * (n + 1)
    size = {0: 1}
    start = 0
    for i in range(1, n + 1):
        if i == 1 or text[order[i]] != text[order[i - 1]]:
            start = i
            size[start] = 0
        group[order[i]] = start
        size[start] += 1
    return order, group, size


def _move(chosen: list[int], order: list[int], place: list[int], group: list[int], size: dict[int, int]) -> None:
    """Take the chosen suffixes out of their groups; those of one group become a new group right behind its rest."""
    parts: dict[int, list[int]] = {}
    for p in chosen:
        parts.setdefault(group[p], []).append(p)
    for old, part in parts.items():
        rest = size[old] - len(part)
        if not rest:
            continue
        new = old + rest
        last = old + size[old] - 1
        for p in part:  # swap to the end of the old group
            at, other = place[p], order[last]
            order[at], order[last] = other, p
            place[other], place[p] = at, last
            group[p] = new
            last -= 1
        size[old], size[new] = rest, len(part)
