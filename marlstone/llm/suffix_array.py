"""Suffix array by linear grouping construction (Lyndon-prefix groups, previous-smaller pointers, no recursive renaming)."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of text in order; text is integers from 1, a sentinel below all is understood at its end.

    Phase 1 goes through the groups of suffixes, the greatest first. A group is the suffixes of one prefix; as its turn comes,
    that prefix is the longest Lyndon word they start with. Each suffix i of the group points to prev[i], the last suffix before
    it in a smaller group, whose prefix then grows by the group's; so those suffixes leave their group for a new one just above
    it, one for each number of times they were pointed to. Phase 2 emits the suffixes in order: whatever precedes an emitted
    suffix, and in turn what that points to, is next in its group.
    """
    n = len(text)
    counts: dict[int, int] = {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    start_of, at = {}, 0
    for c in sorted(counts):
        start_of[c] = at
        at += counts[c]
    group = [start_of[c] for c in text]
    free = dict.fromkeys(start_of.values(), 0)
    order, place = [0] * n, [0] * n
    for i in range(n):
        g = group[i]
        k = g + free[g]
        free[g] += 1
        order[k] = i
        place[i] = k
    size = free
    prev = [-1] * n
    end = n - 1
    while end >= 0:
        start = group[order[end]]
        if start == end:
            i = order[end]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                g = group[j]
                m = size[g]
                if m > 1:
                    k, b = place[j], g + m - 1
                    other = order[b]
                    order[k], place[other] = other, k
                    order[b], place[j] = j, b
                    size[g] = m - 1
                    size[b] = 1
                    group[j] = b
            end -= 1
            continue
        times: dict[int, int] = {}
        for i in sorted(order[start : end + 1]):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, k in times.items():
            moved.setdefault((group[j], -k), []).append(j)
        # of one old group, those pointed to most often go to its very end
        for (g, _), members in sorted(moved.items()):
            top = g + size[g]
            for j in members:
                top -= 1
                k, other = place[j], order[top]
                order[k], place[other] = other, k
                order[top], place[j] = j, top
            size[g] -= len(members)
            if size[g]:
                size[top] = len(members)
                for j in members:
                    group[j] = top
            else:
                size[g] = len(members)
        end = start - 1
    out, fill = [0] * n, {}
    # the empty suffix comes first, and what precedes it is the last one
    s = n - 1
    k = -1
    while True:
        while s >= 0:
            g = group[s]
            if g < 0:
                break
            at = fill.get(g, g)
            out[at] = s
            fill[g] = at + 1
            group[s] = -1
            s = prev[s]
        k += 1
        if k == n:
            return out
        s = out[k] - 1
