"""Simple-8b word-aligned coding of unsigned integers, vectorised over blocks.

A 64-bit word holds a 4-bit selector (top bits) and as many values as the
selector says, of equal width, lowest bits first. Selector 0 is the escape: the
word after it is one raw value of more than 60 bits. Values are cut into blocks of
``BLOCK``; every block starts a new word and its word offset is kept, so blocks are
coded and decoded side by side.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Values in a word and bits of each, by selector; 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word offset of each block."""
    values = np.ascontiguousarray(values, np.uint64)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    padded = np.zeros((blocks, BLOCK + 60), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(values)] = values
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = len(values) - BLOCK * (blocks - 1)

    bits = np.frexp(padded.astype(np.float64))[1].astype(np.uint8)
    if values.max() >= 1 << 53:  # not exact as a double, but its upper half is
        high = padded >> np.uint64(32)
        bits = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], bits).astype(np.uint8)
    peak = {1: bits}  # largest width among the next n values
    n = 1
    while n < 60:
        peak[2 * n] = np.maximum(peak[n], np.concatenate((peak[n][:, n:], np.zeros((blocks, n), np.uint8)), axis=1))
        n *= 2
    selector = np.zeros((blocks, BLOCK), np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):
        n = int(COUNTS[s])
        p = 1 << (n.bit_length() - 1)
        most = np.maximum(peak[p][:, :BLOCK], peak[p][:, n - p : n - p + BLOCK])
        selector[most <= WIDTHS[s]] = s

    rows, at, starts = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(live := np.nonzero(at < lengths)[0]):
        step = np.full(blocks, -1, np.int64)
        step[live] = at[live]
        starts.append(step)
        at[live] += COUNTS[selector[live, at[live]]]
    starts = np.stack(starts, axis=1)
    used = starts >= 0
    row, col = np.repeat(rows, used.sum(axis=1)), starts[used]
    chosen = selector[row, col]
    word = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if s:
            mine = np.nonzero(chosen == s)[0]
            packed = word[mine]
            for j in range(int(COUNTS[s])):
                packed |= padded[row[mine], col[mine] + j] << np.uint64(j * int(WIDTHS[s]))
            word[mine] = packed
    size = 1 + (chosen == 0)
    place = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    out[place] = word
    out[place[chosen == 0] + 1] = padded[row, col][chosen == 0]
    first = np.concatenate(([0], np.cumsum(used.sum(axis=1))[:-1]))
    return out, place[first]


def decode(words: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` values of consecutive blocks; ``offsets``: word offset of each block."""
    out = np.zeros(count, np.uint64)
    if not count:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    # a raw value has more than 60 bits, so its own top bits are never 0
    raw = np.zeros(len(words), bool)
    raw[np.nonzero(selector == 0)[0] + 1] = True
    counts = np.where(raw, 0, COUNTS[np.where(raw, 0, selector)])
    ends = np.cumsum(counts)
    block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    base = np.concatenate(([0], ends))[offsets]
    start = ends - counts - base[block] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, count)
    for s in np.unique(selector[~raw]):
        mine = np.nonzero((selector == s) & ~raw)[0]
        if s == 0:
            out[start[mine]] = words[mine + 1]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(int(COUNTS[s])):
            to = start[mine] + j
            inside = to < limit[mine]
            out[to[inside]] = (words[mine[inside]] >> np.uint64(j * int(WIDTHS[s]))) & mask
    return out
