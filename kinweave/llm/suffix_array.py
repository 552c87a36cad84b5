"""Suffix arrays in numpy by prefix doubling with refinement of unsorted groups."""

from __future__ import annotations

import numpy as np


def pack(codes: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The ``width`` codes from each position on as one number; 0 past the end."""
    key = np.zeros(len(codes), np.int64)
    for k in range(width):
        key <<= bits
        key[: max(0, len(codes) - k)] |= codes[k:]
    return key


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``codes`` (small positive numbers) in the order of the ``depth`` codes that follow.

    Larsson-Sadakane: after the first sort by a packed prefix, a group of equal
    prefixes of length h is sorted by the ranks of the positions h further on, and
    h doubles; groups of one are settled and not touched again. Positions that
    agree in ``depth`` codes come in no particular order.
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(codes.max()).bit_length())
    h = max(1, min(depth, 62 // bits))
    key = pack(codes.astype(np.int64), h, bits)
    small = np.int32 if n < 1 << 31 else np.int64  # half the memory to walk through
    sa = np.argsort(key).astype(small)
    ordered = key[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    # rank: number of the group's last place, so that settled ranks never change
    rank = np.zeros(n + 1, small)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    rank[sa] = np.repeat(starts + sizes, sizes)
    open_places = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while h < depth and len(open_places):
        at = sa[open_places]
        group = rank[at]
        beyond = rank[np.minimum(at + h, n)]
        order = np.argsort(group.astype(np.int64) * (n + 1) + beyond)
        at, group, beyond = at[order], group[order], beyond[order]
        sa[open_places] = at
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (beyond[1:] != beyond[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(at)))
        rank[at] = np.repeat(open_places[starts] + sizes, sizes)
        open_places = open_places[np.repeat(sizes > 1, sizes)]
        h *= 2
    return sa.astype(np.int64)


def common_prefixes(codes: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Length up to ``most`` of the prefix each place shares with the one before it (Kasai).

    ``sa`` must be in full order, not cut at a depth. Kasai's bound - a position's value is at least that of its left neighbour less
    one - is applied by halving steps: positions at multiples of a step are
    extended first, and each position in between starts from what its neighbour at
    that step leaves it, so matched codes are not compared again.
    """
    n = len(sa)
    small = np.int32 if n < 1 << 31 else np.int64
    # one code past the end that no position has: two places that differ never both stand there
    codes = np.append(codes, 0).astype(np.uint8 if n and codes.max() < 256 else np.int64)
    before = np.full(n, -1, small)
    before[sa[1:]] = sa[:-1]
    length = np.zeros(n, small)
    step = 1
    while step < most:
        step *= 2
    done = None
    while step >= 1:
        if done is None:
            here = np.arange(0, n, step)
            start = np.zeros(len(here), np.int64)
        else:
            here = np.arange(step, n, 2 * step)
            start = np.maximum(length[here - step] - step, 0)
        length[here] = _extend(codes, here, before[here], start, most)
        done, step = step, step // 2
    out = length[sa]
    out[:1] = 0
    return out


def _extend(codes: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, most: int) -> np.ndarray:
    """Length up to ``most`` of what the places ``a`` and ``b`` share, known to be ``start`` at least; no ``b`` (-1): 0."""
    out = np.where(b < 0, 0, start)
    live = np.flatnonzero((b >= 0) & (out < most))
    i, j = a[live] + out[live], b[live] + out[live]
    while len(live):
        same = codes[i] == codes[j]
        live, i, j = live[same], i[same] + 1, j[same] + 1
        out[live] += 1
        on = out[live] < most
        if not on.all():
            live, i, j = live[on], i[on], j[on]
    return out
