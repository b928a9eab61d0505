"""Suffix orders of many small sets of strings at once, by linear grouping over Lyndon prefixes.

Every set of strings is sorted by itself, and all sets advance in step, so that each step is a few numpy calls over all of them.

1. Suffixes are grouped by their first byte. Groups are taken in descending order; each member's previous-smaller pointer leads to the nearest suffix before it in a
   lower group, and that suffix is extended by the group's Lyndon prefix, once for each member that points to it: it moves to the upper end of its own group.
   In the end suffixes of one group have the same longest Lyndon prefix, and groups stand in lexicographic order.
2. Groups are taken in ascending order. A suffix that comes out puts every suffix whose Lyndon prefix ends just before it into the next free place of its group.

No ranks are renamed and nothing recurs.
"""

from __future__ import annotations

import numpy as np


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (n[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal neighbours begin, and their lengths."""
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(x)))


class _Groups:
    """Positions: each string's bytes behind a border; the next border is its end. Slots: all suffixes, set by set."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, of_set: np.ndarray):
        border = np.cumsum(size + 1) - size - 1
        n = int((size + 1).sum()) + 1
        at = ranges(border + 1, size)
        self.ends, self.source = border + 1 + size, np.zeros(n, np.int64)
        self.source[at] = ranges(start, size)
        key = np.repeat(of_set, size) * 256 + data[self.source[at]]
        order = np.argsort(key, kind="stable")
        self.at, self.slots = at, at[order]
        first, count = runs(key[order])
        self.group, self.count = np.full(n, -1, np.int64), np.zeros(len(at), np.int64)
        self.group[self.slots], self.count[first] = np.repeat(first, count), count
        self.slot_of, self.length, self.before = np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int64)
        self.slot_of[self.slots] = np.arange(len(at))
        self.moving = np.zeros(n, bool)
        total = np.bincount(np.cumsum(np.concatenate([[0], of_set[1:] != of_set[:-1]])), size).astype(np.int64)
        total = total[total > 0]
        self.high = np.cumsum(total)
        self.low = self.high - total

    def previous(self, members: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The nearest position before each member in a lower group; borders are lower than all."""
        p = members - 1
        open_ = np.flatnonzero(self.group[p] >= group)
        while len(open_):
            q, g = p[open_], group[open_]
            q = np.where(self.group[q] > g, self.before[q], q - 1)  # higher groups have been taken already
            p[open_] = q
            open_ = open_[self.group[q] >= g]
        return p

    def extend(self, target: np.ndarray, unit: np.ndarray) -> None:
        """Every target grows by `unit` as often as it is named; those that grow go to the upper end of their groups, more often named ones above."""
        order = np.argsort(target)
        begin, times = runs(target[order])
        target, unit = target[order][begin], unit[order][begin]
        order = np.lexsort((times, self.group[target]))
        target, unit, times = target[order], unit[order], times[order]
        group = self.group[target]
        begin, moved = runs(group)
        home = group[begin]
        floor = home + self.count[home] - moved
        to, was = ranges(floor, moved), self.slot_of[target]
        self.moving[target] = True
        there = self.slots[to]
        there = there[~self.moving[there]]
        self.moving[target] = False
        free = was[was < np.repeat(floor, moved)]
        self.slots[free], self.slot_of[there] = there, free
        self.slots[to], self.slot_of[target] = target, to
        begin, count = runs(group * (times.max() + 1) + times)
        self.count[home] -= moved
        self.count[to[begin]] = count
        self.group[target] = np.repeat(to[begin], count)
        self.length[target] += times * unit

    def group_all(self) -> None:
        high, low = self.high, self.low
        while len(high):
            first = self.group[self.slots[high - 1]]
            n = high - first
            members = self.slots[ranges(first, n)]
            p = self.previous(members, np.repeat(first, n))
            self.before[members] = p
            inside = self.group[p] >= 0
            if inside.any():
                self.extend(p[inside], self.length[members[inside]])
            left = first > low
            high, low = first[left], low[left]

    def emit(self) -> np.ndarray:
        follower = self.at + self.length[self.at]
        kids = self.at[np.argsort(follower, kind="stable")]
        n_kids = np.bincount(follower, minlength=len(self.group))
        first_kid = np.cumsum(n_kids) - n_kids
        group_at, free = self.group[self.slots], np.arange(len(self.slots))
        out = np.zeros(len(self.slots), np.int64)
        items, cursor, high = self.ends, self.low, self.high
        while True:
            k = kids[ranges(first_kid[items], n_kids[items])]
            order = np.argsort(self.group[k], kind="stable")
            k = k[order]
            begin, n = runs(self.group[k])
            home = self.group[k][begin]
            out[ranges(free[home], n)] = k
            free[home] += n
            cursor, high = cursor[cursor < high], high[cursor < high]
            if not len(cursor):
                return out
            ready = free[group_at[cursor]]
            if (ready == cursor).any():
                raise RuntimeError("a suffix group has no next member")
            items = out[ranges(cursor, ready - cursor)]
            cursor = ready


def suffix_order(data: np.ndarray, start: np.ndarray, size: np.ndarray, of_set: np.ndarray) -> np.ndarray:
    """Positions in data of all suffixes of the strings [start, start + size), set by set, each set's in lexicographic order.

    of_set doesn't decrease. A suffix ends with its string; equal ones stand in the order of their strings. Empty strings have none; no strings give no positions.
    """
    if not size.sum():
        return np.zeros(0, np.int64)
    groups = _Groups(data, start, size, of_set)
    groups.group_all()
    return groups.source[groups.emit()]
