"""Suffix sorting by linear grouping.

First the suffixes are put into groups that share their longest Lyndon prefix: groups are taken in descending order, each member's
previous smaller suffix is found by pointer jumping, and suffixes that are pointed to move up behind their old group, the
more often pointed to the higher. Then the order inside groups follows from the order of what stands behind
them, in one pass over the sorted suffixes. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np


def suffix_array(text) -> array:
    """Start positions of all suffixes of ``text`` (bytes or whole numbers), ascending; a suffix precedes those it is a prefix of."""
    n = len(text)
    if not n:
        return array("i")
    codes = np.frombuffer(bytes(text), np.uint8) if isinstance(text, bytes) else np.asarray(text)
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.flatnonzero(first)
    start_of = starts[np.cumsum(first) - 1]
    group = np.empty(n, np.int64)
    group[order] = start_of
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group, place, at = (array("i", x.astype(np.int32).tobytes()) for x in (group, place, order))
    end = array("i", [0]) * n  # of the group that starts there
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
        end[low] = high
    smaller = array("i", [-1]) * n

    # groups by Lyndon prefixes
    top = n
    while top:
        low = group[at[top - 1]]
        if top - low == 1:  # a group of one, as most are
            i = at[low]
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                g = group[j]
                stop = end[g]
                tail = stop - 1
                if tail != g:
                    other, mine = at[tail], place[j]
                    at[mine], place[other] = other, mine
                    at[tail], place[j] = j, tail
                    end[tail], end[g], group[j] = stop, tail, tail
            top = low
            continue
        members = sorted(at[low:top])
        pointed = []
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed.append(j)
        if pointed:
            count = Counter(pointed) if len(set(pointed)) < len(pointed) else None
            tiers = [[j for j, c in count.items() if c == k] for k in range(max(count.values()), 0, -1)] if count else [pointed]
            for tier in tiers:
                tails: dict[int, int] = {}
                for j in tier:
                    g = group[j]
                    tail = tails.get(g)
                    if tail is None:
                        tail = end[g]
                    tail -= 1
                    tails[g] = tail
                    other, mine = at[tail], place[j]
                    at[mine], place[other] = other, mine
                    at[tail], place[j] = j, tail
                for g, tail in tails.items():
                    if tail != g:
                        stop = end[g]
                        end[tail], end[g] = stop, tail
                        for k in range(tail, stop):
                            group[at[k]] = tail
        top = low

    # order inside groups
    free = array("i", range(n))  # the next slot of the group that starts there
    out = array("i", [-1]) * n
    placed = bytearray(n)
    i, follow = 0, n
    while True:
        j = follow - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            slot = free[g]
            out[slot] = j
            free[g] = slot + 1
            placed[j] = 1
            j = smaller[j]
        if i == n:
            return out
        follow = out[i]
        i += 1
