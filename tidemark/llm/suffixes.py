"""Suffix arrays by linear grouping, after U. Baier (2016), and longest common prefixes."""

from __future__ import annotations


def _grouped(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Phase 1. Sorts suffixes into groups by their longest Lyndon prefix.

    Groups begin as equal first symbols and are processed in descending order. A suffix of the
    current group points to the last one before it in a lower group (all between are higher, so
    the pointers already made lead there); the prefix of the one pointed to then goes on with
    the current group's. So pointed-to suffixes leave their group for one just above it, those
    that are pointed to more often further above.

    Returns each suffix's group, the pointers, and the groups in ascending order.
    """
    # a bucket for each symbol; positions lie in ascending order in every list from here on
    buckets: list[list[int]] = [[] for _ in range(max(text, default=-1) + 2)]
    for at, symbol in enumerate(text):
        buckets[symbol + 1].append(at)
    members = [b for b in buckets if b]
    group = [0] * len(text)
    for g, some in enumerate(members):
        for at in some:
            group[at] = g
    order = list(range(len(members)))
    above, below = {}, {}
    for low, high in zip(order, order[1:]):
        above[low], below[high] = high, low
    size = [len(m) for m in members]
    finished = [False] * len(members)
    smaller = [-1] * len(text)
    g = order[-1] if order else None
    while g is not None:
        finished[g] = True
        times: dict[int, int] = {}
        for at in members[g]:
            if group[at] != g:
                continue  # it has left
            to = at - 1
            while to >= 0 and finished[group[to]]:
                to = smaller[to]
            smaller[at] = to
            if to >= 0:
                times[to] = times.get(to, 0) + 1
        # pointed-to suffixes by how often, then by their group; each list ascends, as pointers do
        often: list[list[int]] = [[] for _ in range(max(times.values(), default=0) + 1)]
        for to, n in times.items():
            often[n].append(to)
        for some_often in reversed(often):
            leaving: dict[int, list[int]] = {}
            for to in some_often:
                leaving.setdefault(group[to], []).append(to)
            for old, some in leaving.items():
                if len(some) == size[old]:
                    continue  # the whole group: its order among the groups stays
                new = len(members)
                members.append(some)
                size[old] -= len(some)
                size.append(len(some))
                finished.append(False)
                for to in some:
                    group[to] = new
                high = above.get(old)
                above[old], below[new] = new, old
                if high is not None:
                    above[new], below[high] = high, new
        members[g] = []
        g = below.get(g)
    lowest = order[0] if order else None
    ascending = []
    while lowest is not None:
        ascending.append(lowest)
        lowest = above.get(lowest)
    return group, smaller, ascending


def suffix_array(text: list[int]) -> list[int]:
    """The starts of the suffixes of text in ascending order. Symbols are numbers from 0 on, about
    as large as the text is long at most: they are bucketed, and nothing else is sorted.

    Phase 2 walks the array from its least suffix: what precedes a suffix in place, and what
    that points to in turn, takes the next place of its group, without any renaming.
    """
    text = [*text, -1]
    group, smaller, ascending = _grouped(text)
    count: dict[int, int] = {}
    for g in group:
        count[g] = count.get(g, 0) + 1
    place, total = {}, 0
    for g in ascending:
        place[g] = total
        total += count.get(g, 0)
    out = [-1] * len(text)
    placed = [False] * len(text)
    out[0], placed[-1] = len(text) - 1, True
    for k in range(len(text)):
        at = out[k] - 1
        while at >= 0 and not placed[at]:
            out[place[group[at]]] = at
            place[group[at]] += 1
            placed[at] = True
            at = smaller[at]
    return out[1:]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each place in order: the symbols that its suffix has in common with the one before."""
    n = len(text)
    rank = [0] * n
    for k, at in enumerate(order):
        rank[at] = k
    out, h = [0] * n, 0
    for at in range(n):
        if rank[at]:
            other = order[rank[at] - 1]
            while at + h < n and other + h < n and text[at + h] == text[other + h]:
                h += 1
            out[rank[at]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out
