"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, and binary search in sorted windows."""

from __future__ import annotations

import numpy as np


def _eight(buf: np.ndarray) -> np.ndarray:
    """Big-endian 64-bit load at every position (zero bytes follow the end)."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), dtype=">u8", buffer=padded.data, strides=(1,))[: len(buf)]


def suffix_array(buf: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``buf`` by at least their first ``depth`` bytes.

    Larsson-Sadakane: suffixes sorted by their first h bytes carry their
    group's number; one refinement sorts only the members of groups that
    still have several, by the number of the suffix h bytes further on,
    which doubles h. Ends when no group has two members or h reaches
    ``depth``.
    """
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64)
    first = _eight(buf).astype(np.uint64)
    order = np.argsort(first)  # the order of equal ones is left open here and below
    key = first[order]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    group = np.empty(n + 1, np.int64)  # a group is named by its last place
    group[n] = -1
    sizes = np.diff(np.append(starts, n))
    group[order] = np.repeat(starts + sizes - 1, sizes)
    # shorter than eight bytes: zero bytes of the text and the end must not tie
    tail = np.arange(max(0, n - 7), n)
    h = 8
    if len(tail):
        group, order = _exact_tail(buf, order, group)
    while h < depth:
        last = group[order]
        several = np.ones(n, bool)
        several[1:] = last[1:] != last[:-1]
        several[:-1] &= several[1:]
        if n > 1:
            several[-1] = last[-1] != last[-2]
        at = np.flatnonzero(~several)
        if len(at) == 0:
            break
        rows = order[at]
        following = group[np.minimum(rows + h, n)]
        own = group[rows]
        both = own * (n + 1) + following + 1  # one number sorts faster than two keys
        move = np.argsort(both)
        rows, both = rows[move], both[move]
        order[at] = rows
        edge = np.empty(len(at), bool)
        edge[-1] = True
        edge[:-1] = both[1:] != both[:-1]
        ends = np.flatnonzero(edge)
        name = at[ends]
        group[rows] = np.repeat(name, np.diff(np.concatenate([[-1], ends])))
        h *= 2
    return order


def _exact_tail(buf, order, group):
    """Put the last seven suffixes, cut short by the end, before longer ones with the same eight bytes."""
    n = len(buf)
    first = _eight(buf)
    for p in range(max(0, n - 7), n):
        g = group[p]
        lo = g
        while lo > 0 and group[order[lo - 1]] == g:
            lo -= 1
        if lo == g:
            continue
        members = order[lo: g + 1]
        short = members[members > n - 8]
        short = short[np.argsort(n - short)]
        rest = members[members <= n - 8]
        order[lo: g + 1] = np.concatenate([short, rest])
        group[short] = lo + np.arange(len(short))
        group[rest] = g
    del first
    return group, order


def common_prefixes(buf: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """lcp[k]: bytes that suffixes order[k-1] and order[k] share, up to ``most`` (lcp[0] = 0).

    Kasai's recurrence: if the bytes before a suffix and before its
    neighbour in the order are equal, its value is that of the suffix one
    byte earlier less one. Only the other positions are compared byte by
    byte; runs take their values from them.
    """
    n = len(buf)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    has = before >= 0
    derived = np.zeros(n, bool)
    inner = has[1:] & has[:-1] & (before[1:] > 0)
    derived[1:] = inner & (buf[np.maximum(before[1:] - 1, 0)] == buf[:-1]) & (before[:-1] == before[1:] - 1)
    roots = np.flatnonzero(~derived)
    value = np.zeros(len(roots), np.int64)
    a, b = roots, before[roots]
    # values derived from a root fall by one a byte, so a root is compared up to ``most`` plus its run's length
    run = np.diff(np.append(roots, n)) - 1
    active = np.flatnonzero(b >= 0)
    words = _eight(np.concatenate([buf, np.zeros(1, np.uint8)]))
    limit = most + run
    while len(active):
        x, y = a[active] + value[active], b[active] + value[active]
        ok = (x < n) & (y < n) & (value[active] < limit[active])
        active, x, y = active[ok], x[ok], y[ok]
        same = words[x] == words[y]
        inside = (x + 8 <= n) & (y + 8 <= n)
        go = same & inside
        stop = active[~go]
        sx, sy = x[~go], y[~go]
        grow = np.ones(len(stop), bool)
        for _ in range(8):
            ok2 = grow & (sx < n) & (sy < n)
            grow = ok2.copy()
            grow[ok2] = buf[sx[ok2]] == buf[sy[ok2]]
            value[stop[grow]] += 1
            sx, sy = sx + 1, sy + 1
        active = active[go]
        value[active] += 8
    which = np.repeat(np.arange(len(roots)), np.diff(np.append(roots, n)))
    by_place = np.maximum(value[which] - (i - roots[which]), 0)
    by_place[~has] = 0
    lcp[1:] = np.minimum(by_place[order[1:]], most)
    return lcp


def _against(words_a: np.ndarray, at_a: np.ndarray, words_b: np.ndarray, at_b: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 per pair of windows of ``length`` bytes, compared eight bytes at a time."""
    out = np.zeros(len(at_a), np.int8)
    open_ = np.arange(len(at_a))
    cut = np.uint64(8 * max(0, 8 - length))
    for k in [*range(0, max(1, length - 7), 8), *([length - 8] if length > 8 and length % 8 else [])]:
        x, y = words_a[at_a[open_] + k] >> cut, words_b[at_b[open_] + k] >> cut
        differ = x != y
        out[open_[differ]] = np.where(x[differ] < y[differ], -1, 1)
        open_ = open_[~differ]
        if not len(open_):
            break
    return out


def found_in(buf_a: np.ndarray, at_a: np.ndarray, buf_b: np.ndarray, sorted_b: np.ndarray, length: int) -> np.ndarray:
    """Which windows of ``buf_a`` (starts ``at_a``) equal one of ``buf_b``, whose starts ``sorted_b`` are in order of their windows."""
    if not len(at_a) or not len(sorted_b):
        return np.zeros(len(at_a), bool)
    a, b = _eight(buf_a).astype(np.uint64), _eight(buf_b).astype(np.uint64)
    lo, hi = np.zeros(len(at_a), np.int64), np.full(len(at_a), len(sorted_b), np.int64)
    todo = np.arange(len(at_a))
    while len(todo):
        mid = (lo[todo] + hi[todo]) // 2
        above = _against(a, at_a[todo], b, sorted_b[mid], length) > 0
        lo[todo[above]] = mid[above] + 1
        hi[todo[~above]] = mid[~above]
        todo = todo[lo[todo] < hi[todo]]
    inside = np.flatnonzero(lo < len(sorted_b))
    out = np.zeros(len(at_a), bool)
    out[inside] = _against(a, at_a[inside], b, sorted_b[lo[inside]], length) == 0
    return out
