"""Suffix array by Lyndon-prefix grouping (after Baier, 2016), in linear time.

First all suffixes are grouped by their longest Lyndon prefix. Groups are handled from the
highest down. For each member the nearest earlier suffix of a lower group is found by
previous-smaller pointers, which skip whole processed stretches; those suffixes have their
known prefix grow by the member's, and move to a group of their own right behind the one they
were in. A suffix before several equal members in a row goes behind one before fewer.

Then each group's order is emitted: members of a group share their Lyndon prefix, and what
follows it is a smaller suffix. Walking the array from the left, each suffix places
those it directly follows, found through the same pointers, at the front of their groups.
Nothing is renamed and nothing sorted recursively.
"""

from __future__ import annotations


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int]]:
    """``start``: each suffix's group, as the place of the group's first suffix; ``prev``: the nearest earlier suffix of a lower group, or -1."""
    n = len(text)
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    order: list[int] = []
    start, size, place, prev = [0] * n, [0] * n, [0] * n, [-1] * n
    for c in sorted(first):
        at = len(order)
        size[at] = len(first[c])
        for i in first[c]:
            start[i] = at
        order += first[c]
    for k, i in enumerate(order):
        place[i] = k

    end = n - 1
    while end >= 0:
        s = order[end]
        at = start[s]
        if at == end:  # a group of one
            q = s - 1
            while q >= 0 and start[q] > at:
                q = prev[q]
            prev[s] = q
            if q >= 0:
                g = start[q]
                m = size[g] - 1
                if m:
                    to, k = g + m, place[q]
                    other = order[to]
                    order[k], order[to] = other, q
                    place[other], place[q] = k, to
                    size[g], size[to], start[q] = m, 1, to
        else:
            ahead: dict[int, int] = {}
            for s in sorted(order[at : end + 1]):
                q = s - 1
                while q >= 0 and start[q] > at:
                    q = prev[q]
                if q >= 0 and start[q] == at:  # an equal member: take what it follows
                    q = prev[q]
                    ahead[q] = ahead.get(q, 0) + 1
                else:
                    ahead[q] = 1
                prev[s] = q
            ahead.pop(-1, None)
            rows: dict[int, list[int]] = {}
            for q, times in ahead.items():
                rows.setdefault(times, []).append(q)
            for times in sorted(rows, reverse=True):
                moved: dict[int, list[int]] = {}
                for q in rows[times]:
                    g = start[q]
                    size[g] -= 1
                    to, k = g + size[g], place[q]
                    other = order[to]
                    order[k], order[to] = other, q
                    place[other], place[q] = k, to
                    moved.setdefault(g, []).append(q)
                for g, members in moved.items():
                    to = g + size[g]
                    size[to] = len(members)
                    for q in members:
                        start[q] = to
        end = at - 1
    return start, prev


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in order. The last symbol must be smaller than all others."""
    n = len(text)
    if n < 2:
        return list(range(n))
    free, prev = lyndon_groups(text)
    out = [0] * n
    out[0] = n - 1
    done = bytearray(n)
    done[n - 1] = 1
    free = free.copy()
    head = list(range(n))  # the next free place of each group
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            done[s] = 1
            g = free[s]
            out[head[g]] = s
            head[g] += 1
            s = prev[s]
    return out
