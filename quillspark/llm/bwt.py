"""Repeated windows of a bounded set of texts, by interval expansion on a Burrows-Wheeler transform.

The suffixes of all texts (each ended by a symbol of its own, below all bytes) are sorted as far as the window is long.
Breadth first, intervals of suffixes that share a string w are extended backward to those that share cw, for each symbol c
before them: where such an interval ends, the common prefix of the neighbours is as long as w. Lengths are met in rising
order, so the expansion stops at the window's length; neighbours that no interval has parted by then share a whole window.
"""

from __future__ import annotations

import numpy as np

#: Symbols that are packed into the first sort key, of 9 bits each.
PACKED = 7


def _order(symbols: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, place of each) by their first `depth` symbols; suffixes that end sooner are told apart by their ends."""
    n = len(symbols)
    every = np.arange(n, dtype=np.int32)
    left = np.repeat(ends.astype(np.int32), np.diff(np.concatenate([[-1], ends]))) - every  # symbols before the end
    key, ahead = np.zeros(n, np.int64), np.concatenate([symbols, np.zeros(PACKED, np.uint16)])
    for i in range(PACKED):
        key <<= 9
        key |= np.where(left >= i, ahead[i : i + n], np.uint16(0))
    suffixes = np.argsort(key, kind="stable").astype(np.int32)
    ordered = key[suffixes]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    new |= left[suffixes] < PACKED  # of equal short ones the order of the texts decides
    place = np.empty(n, np.int32)
    place[suffixes] = np.maximum.accumulate(np.where(new, every, 0))
    alone = new & np.concatenate([new[1:], [True]])
    open_, known = suffixes[~alone], PACKED
    while len(open_) and known < depth:
        key = place[open_].astype(np.int64) << 32 | place[open_ + known]
        by = np.argsort(key)  # equal ones stay in one group: their order is free
        open_, key = open_[by], key[by]
        first, k = (key >> 32).astype(np.int32), every[: len(by)]
        starts = np.concatenate([[True], first[1:] != first[:-1]])
        at = first + k - np.maximum.accumulate(np.where(starts, k, 0))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        place[open_] = np.maximum.accumulate(np.where(new, at, 0))
        suffixes[at] = open_
        open_ = open_[~(new & np.concatenate([new[1:], [True]]))]
        known *= 2
    place[suffixes] = every
    return suffixes, place


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, number of the interval) of all places of the intervals."""
    size = last - first + 1
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(first - before, size), np.repeat(np.arange(len(first)), size)


def repeated(texts: list[bytes], window: int) -> list[np.ndarray]:
    """For each text, whether the window that starts at each of its places also starts anywhere else."""
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
    symbols[ends] = 0
    n = len(symbols)
    suffixes, place = _order(symbols, ends, window)
    before = symbols[suffixes - 1]  # the transform; -1 is the last end
    by_symbol = np.argsort(before, kind="stable")
    back = np.empty(n, np.int64)
    back[by_symbol] = np.arange(n) << 32
    head = symbols[suffixes]
    parted = np.zeros(n + 1, bool)  # parted[i]: suffixes i - 1 and i are known to share less than a window
    parted[: len(texts) + 1] = parted[n] = True
    parted[1:n] |= head[1:] != head[:-1]
    first = np.flatnonzero(parted[:n])
    last = np.append(first[1:], n) - 1
    for _ in range(1, window):
        places, own = _ranges(first, last)
        met = np.sort((back[places] | own)[before[places] > 0])
        if not len(met):
            break
        target, own = met >> 32, met & 0xFFFFFFFF
        symbol = head[target]
        cut = (target[1:] != target[:-1] + 1) | (own[1:] != own[:-1]) | (symbol[1:] != symbol[:-1])
        starts, stops = target[np.concatenate([[True], cut])], target[np.concatenate([cut, [True]])]
        new = ~parted[stops + 1]
        first, last = starts[new], stops[new]
        parted[last + 1] = True
    shares = ~parted[place] | ~parted[place + 1]
    return [shares[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]
