"""Common prefixes of suffixes by interval expansion on a Burrows-Wheeler transform, up to a given length."""

from __future__ import annotations

import numpy as np

#: Stands between strings; UTF-8 has no such byte.
BREAK = 0xFF
STEP = 8


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one big-endian number; zeros follow the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * STEP, np.uint8)])
    out = np.empty(n + STEP, np.uint64)
    for shift in range(STEP):
        part = padded[shift:shift + (n + STEP - shift) // STEP * STEP].view(">u8")
        out[shift::STEP][:len(part)] = part
    return out[:n]


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first ``depth`` bytes or more, by doubling ranks; only ties are sorted again."""
    n = len(data)
    key = words_at(data)
    order = np.argsort(key, kind="stable")
    first = np.r_[True, np.diff(key[order]) != 0]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    known = STEP
    while known < depth:
        size = np.diff(np.r_[np.flatnonzero(first), n])
        open_rows = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_rows):
            break
        at = order[open_rows]
        after = at + known
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = (rank[at].astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64)
        again = np.argsort(both, kind="stable")
        both, at = both[again], at[again]
        order[open_rows] = at
        new = np.r_[True, np.diff(both) != 0]
        first[open_rows] = new
        fresh = np.maximum.accumulate(np.where(new, open_rows, 0))
        rank[at] = fresh
        known *= 2
    return order


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges, one range after another."""
    size = end - begin
    shift = np.cumsum(size) - size
    return np.arange(int(size.sum()), dtype=np.int64) + np.repeat(begin - shift, size)


def prefix_classes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): places in suffix order, and where in it a common prefix of ``length`` bytes ends.

    Places between two ``starts`` begin with the same ``length`` bytes. The data must end with two ``BREAK`` bytes,
    which stand together nowhere else; strings that hold a ``BREAK`` are not told apart reliably.

    Breadth first: the interval of every string of l bytes whose right end was not known before is extended backwards
    by each byte that stands before its suffixes. A right end found this way parts suffixes that have l bytes in
    common, so common prefixes come by increasing value, and the search stops at ``length``.
    """
    n = len(data)
    rows = np.empty(n + 1, np.int64)  # row 0 is the empty suffix
    rows[0], rows[1:] = n, suffix_order(data, length)
    before = data[rows - 1].astype(np.int16)
    before[rows == 0] = -1  # nothing stands before the first byte
    by_byte = np.argsort(before, kind="stable")  # row k of the sorted first bytes belongs to row by_byte[k]
    step = np.empty(n + 1, np.int64)
    step[by_byte] = np.arange(n + 1)
    alike = np.diff(before[by_byte]) == 0
    next_row, last_row = np.full(n + 1, n + 1, np.int64), np.full(n + 1, -1, np.int64)
    next_row[by_byte[:-1][alike]] = by_byte[1:][alike]
    last_row[by_byte[1:][alike]] = by_byte[:-1][alike]
    cut = np.zeros(n + 2, bool)
    cut[0] = True
    begin, end = np.array([0]), np.array([n + 1])
    for _ in range(length):
        inside = _ranges(begin, end)
        size = end - begin
        opening = last_row[inside] < np.repeat(begin, size)
        closing = next_row[inside] >= np.repeat(end, size)
        low = np.sort(step[inside[opening]])
        high = np.sort(step[inside[closing]]) + 1
        new = ~cut[high]
        begin, end = low[new], high[new]
        cut[end] = True
        if not len(begin):
            break
    return rows[1:], np.flatnonzero(cut[1:n + 1])
