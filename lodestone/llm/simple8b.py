"""Simple-8b: as many ids as fit go into each 64-bit word, a selector in its top four bits tells how many.

Ids come in blocks of BLOCK, each beginning at a word of its own, with the word offsets beside them. So blocks are
encoded side by side (one step of all blocks at a time) and any block can be decoded alone.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
# Ids per word and bits per id of selectors 1 to 14. Selector 15 is the escape: its value is in the next word.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
_N = np.array([0, *(n for n, _ in SELECTORS), 1], np.int64)
_PAD = 60


_SHORT = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    out = _SHORT[ids & np.uint64(0xFFFF)]
    for shift in (16, 32, 48):
        rest = np.flatnonzero(ids >> np.uint64(shift))
        if not len(rest):
            break
        out[rest] = shift + _SHORT[ids[rest] >> np.uint64(shift) & np.uint64(0xFFFF)]
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) of the ids (unsigned, up to 64 bits), and the first word of each block, with the number of words at the end."""
    total = len(ids)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    rows = -(-total // BLOCK)
    grid = np.zeros((rows, BLOCK + _PAD), np.uint64)
    whole = total // BLOCK
    grid[:whole, :BLOCK] = ids[: whole * BLOCK].reshape(whole, BLOCK)
    if total % BLOCK:
        grid[-1, : total % BLOCK] = ids[whole * BLOCK :]
    stride, flat = grid.shape[1], grid.reshape(-1)
    width = _widths(flat)
    # Widest of the n ids from each position, for every n of the selectors, each from a smaller n.
    widest = {1: width}
    for n, _ in sorted(SELECTORS)[1:]:
        a = max(k for k in widest if 2 * k >= n or k == max(widest))
        shift = n - a
        w = widest[a].copy()
        w[: len(w) - shift] = np.maximum(w[: len(w) - shift], widest[a][shift:])
        widest[n] = w
    choice = np.full(flat.shape, ESCAPE, np.uint8)
    for k in range(len(SELECTORS), 0, -1):
        n, bits = SELECTORS[k - 1]
        np.copyto(choice, k, where=widest[n] <= bits, casting="unsafe")
    del widest
    end = np.full(rows, BLOCK)
    if total % BLOCK:
        end[-1] = total % BLOCK
    at, alive = np.zeros(rows, np.int64), np.arange(rows)
    starts, owners = [], []
    while len(alive):
        here = alive * stride + at[alive]
        starts.append(here)
        owners.append(alive)
        at[alive] += _N[choice[here]]
        alive = alive[at[alive] < end[alive]]
    start, owner = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(start, kind="stable")
    start, owner = start[order], owner[order]
    kind = choice[start].astype(np.int64)
    size = 1 + (kind == ESCAPE)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for k in np.unique(kind).tolist():
        mine = np.flatnonzero(kind == k)
        if k == ESCAPE:
            words[place[mine]] = np.uint64(ESCAPE << 60)
            words[place[mine] + 1] = flat[start[mine]]
            continue
        n, bits = SELECTORS[k - 1]
        value = np.full(len(mine), k << 60, np.uint64)
        for j in range(n):
            value |= flat[start[mine] + j] << np.uint64(j * bits)
        words[place[mine]] = value
    offsets = np.zeros(rows + 1, np.int64)
    np.add.at(offsets, owner + 1, size)
    return words, np.cumsum(offsets)


def decode(words: np.ndarray, offsets: np.ndarray, total: int) -> np.ndarray:
    """The ``total`` ids (uint64) of what ``encode`` gave, all blocks at once."""
    if not total:
        return np.zeros(0, np.uint64)
    rows, stride = len(offsets) - 1, BLOCK + _PAD
    kind = (words >> np.uint64(60)).astype(np.int64)
    # The word after an escape is raw; escapes can't be told by looking at single words, so mark them in order.
    raw = np.zeros(len(words), bool)
    marks = np.flatnonzero(kind == ESCAPE)
    if len(marks):
        first = set(offsets.tolist())
        after = -1
        for m in marks.tolist():
            if m == after and m not in first:
                continue
            after = m + 1
            raw[after] = True
    count = np.where(raw, 0, _N[kind])
    run = np.cumsum(count) - count
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    at = run - run[offsets[:-1]][owner] + owner * stride
    grid = np.zeros(rows * stride, np.uint64)
    for k, (n, bits) in enumerate(SELECTORS, 1):
        mine = np.flatnonzero((kind == k) & ~raw)
        mask = np.uint64((1 << bits) - 1)
        for j in range(n):
            grid[at[mine] + j] = words[mine] >> np.uint64(j * bits) & mask
    if len(marks):
        values = np.flatnonzero(raw)
        grid[at[values - 1]] = words[values]
    return grid.reshape(rows, stride)[:, :BLOCK].reshape(-1)[:total]
