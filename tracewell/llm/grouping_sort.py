"""Suffix arrays of many short texts at once, by linear grouping (numpy).

A suffix's Lyndon prefix ends where the next smaller suffix begins. Suffixes start out grouped by their first value. From the
greatest group down, every suffix of the group looks up the nearest place before it whose group is smaller; such a place's
Lyndon prefix grows by the group's, once for each suffix that points to it, and so it moves into a new group right above its
old one, above those that were pointed to less often. When all groups are done, equal Lyndon prefixes are one group and
groups are in order. Then the order within groups is emitted: going up the suffix array, each suffix puts those suffixes whose
next smaller suffix it is into the next free slot of their groups.

Every text takes these steps on its own; numpy takes one step of all texts together.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + counts[i] - 1 for each i, joined."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def suffix_arrays(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values: the texts end to end, integers from 1 on, each text ending in a 0 that it has nowhere else; lengths: of the
    texts, that 0 included. Returns each text's suffix array in the text's own place, as positions in `values`."""
    n, first = len(values), np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
    text, most = np.repeat(np.arange(len(lengths)), lengths), int(values.max(initial=0)) + 1
    sa = np.argsort(text * most + values)
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    by_value = (text * most + values).take(sa)
    starts = np.flatnonzero(np.r_[True, by_value[1:] != by_value[:-1]])
    group = np.full(n + 1, -1, np.int64)  # of a suffix: where its group starts; behind the last one, and before the first: none
    group[sa] = np.repeat(starts, np.diff(np.r_[starts, n]))
    end = np.zeros(n, np.int64)  # of a group, by its start
    end[starts] = np.r_[starts[1:], n]
    length, before, marked = np.ones(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
    top, owner = first + lengths, np.arange(len(lengths))  # of texts that have groups left
    longest, growth = int(lengths.max(initial=0)) + 1, np.zeros(len(lengths), np.int64)
    while len(top):
        low = group.take(sa.take(top - 1))
        sizes = top - low
        member, base, floor = sa.take(_ranges(low, sizes)), np.repeat(low, sizes), np.repeat(first.take(owner), sizes)
        # The nearest place before each member whose group is smaller: places of greater groups hold a pointer past them. The
        # text before ends in a place of a smaller group.
        at = member - 1
        live = np.flatnonzero(group.take(at) >= base)
        while len(live):
            here, own = at.take(live), base.take(live)
            here = np.where(group.take(here) == own, here - 1, before.take(here))
            at[live] = here
            live = live.compress(group.take(here) >= own)
        before[member] = at
        step = np.sort(at.compress(at >= floor))
        if len(step):
            growth[owner] = length.take(sa.take(low))
            head = np.flatnonzero(np.r_[True, step[1:] != step[:-1]])
            place, times = step.take(head), np.diff(np.r_[head, len(step)])
            old = group.take(place)
            order = np.argsort(old * longest + times)
            place, times, old = place.take(order), times.take(order), old.take(order)
            length[place] += times * growth.take(text.take(place))
            head = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
            count = np.diff(np.r_[head, len(old)])
            stop = end.take(old.take(head))
            slot = _ranges(stop - count, count)  # the tail of the old group
            marked[place] = True
            occupant, had = sa.take(slot), isa.take(place)
            leaving = occupant.compress(~marked.take(occupant))
            free = had.compress(had < np.repeat(stop - count, count))
            marked[place] = False
            sa[free], isa[leaving] = leaving, free
            sa[slot], isa[place] = place, slot
            fresh = np.flatnonzero(np.r_[True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])])
            span, begin = np.diff(np.r_[fresh, len(old)]), slot.take(fresh)
            end[old.take(head)] = stop - count
            group[place] = np.repeat(begin, span)
            end[begin] = begin + span
        more = np.flatnonzero(low > first.take(owner))
        top, owner = low.take(more), owner.take(more)

    smaller = np.arange(n) + length  # where the next smaller suffix begins
    children = np.argsort(smaller)
    child = np.r_[0, np.cumsum(np.bincount(smaller, minlength=n)[:n])]
    slot, out = np.arange(n), np.empty(n, np.int64)
    out[first] = first + lengths - 1
    owner = np.argsort(-lengths, kind="stable")
    alive = np.searchsorted(-lengths.take(owner), -np.arange(longest), side="left")
    for t in range(longest - 1):
        owner = owner[: alive[t]]
        i = out.take(first.take(owner) + t)
        count = child.take(i + 1) - child.take(i)
        j = children.take(_ranges(child.take(i), count))
        j = j.compress(text.take(j) == np.repeat(owner, count))  # the last 0 of the text before has its "next" in this one
        place = group.take(j)
        at = slot.take(place)
        out[at] = j
        slot[place] = at + 1
    return out
