"""Repeated substrings by a Burrows-Wheeler transform with threshold-bounded interval expansion.

``repeats`` finds, in a bounded set of byte strings, every position at which a
string of ``length`` bytes starts that starts elsewhere in the set as well.  It
sorts suffixes only as deep as the threshold asks, takes the transform, and
derives common prefixes breadth first, by increasing value: a boundary between
suffixes whose common prefix is l, extended backward by each byte that precedes
its interval, gives the boundaries of value l + 1.  The expansion stops at
``length``; boundaries that have no value by then separate suffixes that share
at least ``length`` bytes.
"""

from __future__ import annotations

import numpy as np

#: Levels at which intervals are wide and all open boundaries are looked at together.
WIDE = 10
#: Single steps back in an interval before the runs of equal bytes that are left of it are looked at together.
WALK = 3


def sorted_places(key: np.ndarray, bits: int) -> np.ndarray:
    """Places in the order of their keys (of at most 63 - ``bits`` bits), ties by place."""
    if len(key) < 1 << bits:
        placed = key << bits
        placed |= np.arange(len(key))
        placed.sort()
        placed &= (1 << bits) - 1
        return placed
    return np.argsort(key, kind="stable")


def suffix_order(codes: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` (or more) codes, ties by position.

    ``codes`` are 1 to 256, and 0 ends a string; ``left`` counts what is left of a string.
    """
    n, h = len(codes), 4
    key = np.zeros(n, np.int64)
    for j in range(h):
        key <<= 9
        m = max(0, n - j)
        key[:m] |= np.where(left[:m] > j, codes[j:], codes.dtype.type(0))
    while True:
        order = sorted_places(key, 21)
        held = key[order]
        new = np.r_[False, held[1:] != held[:-1]]
        if h >= depth or new.sum() == n - 1:
            return order
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32)
        key = rank.astype(np.int64)
        key *= n + 1
        m = max(0, n - h)
        key[:m] += np.where(left[:m] > h, rank[h:] + np.int32(1), np.int32(0))
        h *= 2


def short_prefixes(codes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the order, whether it shares fewer than ``length`` codes with the one before."""
    n = len(codes)
    before = codes[order - 1]
    before[order == 0] = 0
    by_code = np.argsort(before, kind="stable").astype(np.int32)  # by_code[k] is the place whose backward step is k
    step = np.empty(n, np.int32)
    step[by_code] = np.arange(n, dtype=np.int32)
    same = np.zeros(n, bool)  # k and k - 1 are extensions by the same byte
    same[1:] = before[by_code[1:]] == before[by_code[:-1]]
    same[: int((before == 0).sum()) + 1] = False
    open_ = np.flatnonzero(same).astype(np.int32)  # boundaries without a value
    following = np.full(n, n, np.int32)  # the next place that the same byte precedes
    here, prior = by_code[open_], by_code[open_ - 1]
    following[prior] = here
    run_last = np.append(np.flatnonzero(before[1:] != before[:-1]), n - 1).astype(np.int32)  # the last place of each run of equal bytes before
    run_of = np.repeat(np.arange(len(run_last), dtype=np.int32), np.diff(run_last, prepend=-1))
    held = bytearray((~same).tobytes())
    known = np.frombuffer(held, bool)
    fresh = np.flatnonzero(known).astype(np.int32)
    for level in range(length - 1):
        if not len(fresh):
            break
        narrow = level >= WIDE
        if narrow:
            border = fresh[fresh > 0]
            at, found = border - 1, []

            def extend(at: np.ndarray, border: np.ndarray) -> None:
                ext = step[at[following[at] >= border]] + 1
                ext = ext[ext < n]
                found.append(ext[~known[ext]])  # noqa: B023

            for _ in range(WALK):  # back to the start of the interval
                extend(at, border)
                more = ~known[at]
                at, border = at[more] - 1, border[more]
                if not len(at):
                    break
            if len(at):
                extend(at, border)
                first = run_of[[held.rfind(1, 0, x + 1) for x in at.tolist()]]
                size = (run_of[at] - first).astype(np.int64)
                narrow = size.sum() <= n
                if narrow:
                    runs = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
                    extend(run_last[runs], np.repeat(border, size))
        if narrow:
            fresh = np.unique(np.concatenate(found))
        else:
            hit = ~known[open_]
            open_, here, prior = open_[hit], here[hit], prior[hit]
            mark = np.zeros(n, np.int32)
            mark[fresh] = 1
            np.cumsum(mark, out=mark)
            hit = mark[here] > mark[prior]
            fresh = open_[hit]
            open_, here, prior = open_[~hit], here[~hit], prior[~hit]
        known[fresh] = True
    return known


def repeats(strings: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string the starts of its substrings of ``length`` bytes that occur again.

    A string of weight w counts as w equal strings.
    """
    if not strings:
        return []
    sizes = np.array([len(s) for s in strings])
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    codes = data.astype(np.int16) + np.int16(1)
    codes[ends] = 0
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), sizes + 1)
    left = ends.astype(np.int32)[owner] - np.arange(len(codes), dtype=np.int32)
    order = suffix_order(codes, left, length + 1)
    starts = short_prefixes(codes, order, length)
    group = np.cumsum(starts) - 1
    whole = left[order] >= length
    total = np.bincount(group[whole], weights[owner[order[whole]]], minlength=int(group[-1]) + 1)
    hit = np.sort(order[whole & (total[group] >= 2)])
    base = ends - sizes
    cut = np.searchsorted(hit, np.r_[base, len(codes)])
    return [hit[cut[i] : cut[i + 1]] - base[i] for i in range(len(strings))]
