"""Linear-time suffix sorting by Lyndon prefixes, without recursion or renaming.

The suffixes stand in groups, at first by first symbol. Groups are processed from the highest to the lowest: each member
looks up its previous smaller pointer, the nearest place to the left whose group is lower, by jumping along the pointers
of places in higher or the same group. The places pointed at get the group's prefix appended to theirs, so each of their
groups splits; one with more pointers goes higher. When all groups are done, a group holds the suffixes with one longest
Lyndon prefix, and its pointers are those to previous smaller suffixes. One scan from the smallest suffix upwards then
emits every group's order: a suffix settles the places just before it, along the pointers, in their groups.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """The starts of all suffixes in order; an end of the sequence is less than any symbol."""
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    group, place, last = [0] * n, [0] * n, [-1] * n
    before, start = None, 0
    for slot, i in enumerate(order):
        if symbols[i] != before:
            before, start = symbols[i], slot
        place[i] = slot
        group[i] = start
        last[start] = slot
    smaller = [-1] * n
    end = n - 1
    while end >= 0:
        start = group[order[end]]
        if start == end:  # one member, so one pointer
            i = order[end]
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                g = group[p]
                slot = last[g]
                if g != slot:
                    at, q = place[p], order[slot]
                    order[slot], order[at], place[p], place[q] = p, q, slot, at
                    last[g] = slot - 1
                    group[p] = slot
                    last[slot] = slot
            end = start - 1
            continue
        pointed: dict[int, list[int]] = {}
        run_of, run = -1, 0
        for i in sorted(order[start : end + 1]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            if p == run_of:
                run += 1
            else:
                if run_of >= 0:
                    pointed.setdefault(run, []).append(run_of)
                run_of, run = p, 1
        if run_of >= 0:
            pointed.setdefault(run, []).append(run_of)
        for count in sorted(pointed, reverse=True):
            own = pointed[count]
            for p in own:
                g = group[p]
                slot = last[g]
                at, q = place[p], order[slot]
                order[slot], order[at] = p, q
                place[q] = at
                place[p] = slot
                last[g] = slot - 1
            heads = [last[group[p]] + 1 for p in own]
            for p, head in zip(own, heads):
                group[p] = head
                if place[p] > last[head]:
                    last[head] = place[p]
        end = start - 1
    free = list(range(n))
    out = [0] * n
    settled = bytearray(n)
    p, slot = n - 1, 0
    while True:
        while p >= 0 and not settled[p]:
            settled[p] = 1
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            p = smaller[p]
        if slot == n:
            return out
        p = out[slot] - 1
        slot += 1
