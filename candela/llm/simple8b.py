"""Simple-8b coding of unsigned integers in numpy.

A 64-bit word has a 4-bit selector on top and 60 bits of payload; selector k packs
``COUNTS[k]`` values of ``WIDTHS[k]`` bits, first value lowest. A value of over 60
bits takes a word with selector 15 and lies, whole, in the escape list. Values are cut
into blocks of ``BLOCK``; a word never crosses a block, and the offset tables tell
each block's first word and first escape, so blocks decode independently and all
at once. Layout, little-endian: n, number of blocks (64 bit each), word offsets, escape
offsets (32 bit, one more than blocks each), words, escapes (64 bit).
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: fixed values of the format
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 0])
ESCAPE = 15
_U = np.uint64
#: the narrowest selector for a number of bits (0 to 64)
_CLASS = np.array([next((k for k in range(14) if WIDTHS[k] >= b), ESCAPE) for b in range(65)], np.uint8)


def _bits(v: np.ndarray) -> np.ndarray:
    high = v >> _U(32)
    big = high > 0
    out = np.frexp((v & _U(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(big, np.frexp(high.astype(np.float64))[1] + 32, out) if big.any() else out


def _selectors(cls: np.ndarray) -> np.ndarray:
    """For each place the selector that packs most values from there on."""
    rows, width = cls.shape[0], BLOCK
    runs = {1: cls}

    def power(p: int) -> np.ndarray:
        if p not in runs:
            half = power(p // 2)
            runs[p] = np.maximum(half[:, : half.shape[1] - p // 2], half[:, p // 2:])
        return runs[p]

    def most(c: int) -> np.ndarray:
        """The largest class among c values from each place."""
        p = 1 << (c.bit_length() - 1)
        m = power(p)
        return m[:, :width] if p == c else np.maximum(m[:, :width], m[:, c - p: c - p + width])

    sel = np.where(cls[:, :width] == ESCAPE, np.uint8(ESCAPE), np.uint8(13))
    for k in range(12, -1, -1):
        fit = most(int(COUNTS[k])) <= k
        if not fit.any():  # what a narrower selector packs, this one packs in part
            break
        sel[fit] = k
    return sel.reshape(rows, width)


def encode(values: np.ndarray) -> bytes:
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    rows = -(-n // BLOCK)
    grid = np.zeros((rows, BLOCK + 64), np.uint64)
    flat = np.zeros(rows * BLOCK, np.uint64)
    flat[:n] = v
    grid[:, :BLOCK] = flat.reshape(rows, BLOCK)
    cls = _CLASS[_bits(grid)]
    cls[:, BLOCK:] = 0
    first = np.zeros((rows, BLOCK), bool)
    if rows:
        if n % BLOCK:
            cls[-1, n % BLOCK:] = 0
        sel = _selectors(cls)
        size = np.full(rows, BLOCK)
        size[-1] = n - (rows - 1) * BLOCK
        at, live = np.zeros(rows, np.int64), np.arange(rows)
        while len(live):  # one word of every block at a time
            first[live, at[live]] = True
            at[live] += COUNTS[sel[live, at[live]]]
            live = live[at[live] < size[live]]
    r, c = np.nonzero(first)
    s = sel[r, c].astype(np.int64) if rows else np.zeros(0, np.int64)
    words = s.astype(np.uint64) << _U(60)
    padded, base = grid.ravel(), r * (BLOCK + 64) + c
    for k in range(14):
        at = np.flatnonzero(s == k)
        if len(at):
            j = np.arange(COUNTS[k])
            part = padded[base[at][:, None] + j] << (j * WIDTHS[k]).astype(np.uint64)
            words[at] |= np.bitwise_or.reduce(part, axis=1)
    out = s == ESCAPE
    offsets = np.zeros(rows + 1, np.uint32), np.zeros(rows + 1, np.uint32)
    offsets[0][1:] = np.cumsum(np.bincount(r, minlength=rows))
    offsets[1][1:] = np.cumsum(np.bincount(r[out], minlength=rows))
    return b"".join(x.tobytes() for x in (np.array([n, rows], np.uint64), *offsets, words, padded[base[out]]))


def decode(data: bytes) -> np.ndarray:
    n, rows = (int(x) for x in np.frombuffer(data, np.uint64, 2))
    starts, escapes = np.frombuffer(data, np.uint32, 2 * (rows + 1), 16).reshape(2, rows + 1)
    at = 16 + 8 * (rows + 1)
    words = np.frombuffer(data, np.uint64, int(starts[-1]), at)
    raw = np.frombuffer(data, np.uint64, int(escapes[-1]), at + 8 * len(words))
    out = np.zeros(n, np.uint64)
    s = (words >> _U(60)).astype(np.int64)
    count = COUNTS[s]
    total = np.concatenate([[0], np.cumsum(count)])
    per = np.diff(starts.astype(np.int64))
    block = np.repeat(np.arange(rows), per)
    place = total[:-1] - total[starts[:-1].astype(np.int64)][block] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, n)  # the last word of a block may be filled in part
    for k in range(14):
        i = np.flatnonzero(s == k)
        if len(i):
            j = np.arange(COUNTS[k])
            to = place[i][:, None] + j
            got = (words[i][:, None] >> (j * WIDTHS[k]).astype(np.uint64)) & _U((1 << int(WIDTHS[k])) - 1)
            keep = to < limit[i][:, None]
            out[to[keep]] = got[keep]
    out[place[s == ESCAPE]] = raw
    return out
