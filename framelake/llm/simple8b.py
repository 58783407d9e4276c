"""Simple-8b: unsigned integers in 64-bit words, four bits of selector and sixty of payload.

The numbers are coded in runs of ``RUN``; each run begins a fresh word, so runs are coded side by side with numpy and
decoded alike. In a run the selector is the one that packs the most of the next numbers. A number of 2**60 - 1 or
more is an escape: selector 15 with a payload of ones, and the number as the next word.
"""

from __future__ import annotations

import numpy as np

RUN = 256
#: Zeros behind a run, as many as one word can hold at most.
PAD = 240
#: (numbers per word, bits of each) by selector, as the code fixes them.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12),
             (4, 15), (3, 20), (2, 30), (1, 60))
_COUNT = np.array([c for c, _ in SELECTORS])
_BITS = np.array([b for _, b in SELECTORS])
_PAYLOAD = np.uint64((1 << 60) - 1)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each number needs; 61 for an escape."""
    exact = np.array([0] + [1 << k for k in range(60)] + [(1 << 60) - 1], np.uint64)
    if len(values) and values.max() < 1 << 20:
        return np.frexp(values.astype(np.float32))[1].astype(np.uint8)
    return np.where(values == 0, 0, np.searchsorted(exact, values, "right") - 1).astype(np.uint8)


def _best_selectors(width: np.ndarray) -> np.ndarray:
    """Selector for a word that begins at each place; 16 is an escape. Rows are runs with ``PAD`` zeros behind."""
    # widest[c][i] is the most bits among the c numbers from i on, built from shorter windows
    widest = {1: width}

    def join(a: int, b: int) -> None:
        got = widest[a].copy()
        np.maximum(got[:, :-a], widest[b][:, a:], out=got[:, :-a])
        widest[a + b] = got

    for a, b in ((1, 1), (2, 1), (2, 2), (4, 1), (4, 2), (4, 3), (4, 4), (8, 2), (8, 4), (8, 7), (10, 10), (15, 15), (30, 30),
                 (60, 60), (120, 120)):
        join(a, b)
    best = np.full(width.shape, 16, np.uint8)
    for sel in range(15, -1, -1):
        count, bits = SELECTORS[sel]
        best[widest[count] <= bits] = sel
    return best


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each run of 256 numbers)."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    runs = -(-n // RUN)
    flat = np.zeros(runs * RUN, np.uint64)
    flat[:n] = values
    padded = np.zeros((runs, RUN + PAD), np.uint64)
    padded[:, :RUN] = flat.reshape(runs, RUN)
    width = np.zeros((runs, RUN + PAD), np.uint8)
    width[:, :RUN] = _widths(flat).reshape(runs, RUN)
    best = _best_selectors(width).reshape(-1)
    padded = padded.reshape(-1)
    step = np.append(_COUNT, 1)
    row = np.arange(runs) * (RUN + PAD)
    stop = row + np.minimum(RUN, n - np.arange(runs) * RUN)
    cursor, live = row.copy(), np.arange(runs)
    places, owners = [], []
    while len(live):  # all runs go on by a word at once
        places.append(cursor)
        owners.append(live)
        cursor = cursor + step[best[cursor]]
        more = cursor < stop[live]
        cursor, live = cursor[more], live[more]
    place, owner = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    place, owner = place[order], owner[order]
    sel = best[place]
    word = sel.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        count, bits = SELECTORS[s]
        mine = np.flatnonzero(sel == s)
        at, got = place[mine], np.zeros(len(mine), np.uint64)
        for k in range(count):
            got |= padded[at + k] << np.uint64(k * bits)
        word[mine] |= got
    escaped = np.flatnonzero(sel == 16)
    if len(escaped):
        word[escaped] = ~np.uint64(0)
        word = np.insert(word, escaped + 1, padded[place[escaped]])
        owner = np.insert(owner, escaped + 1, owner[escaped])
    per_run = np.bincount(owner, minlength=runs)
    return word, (np.cumsum(per_run) - per_run).astype(np.int32)


def decode(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The numbers of all runs, from words and first words as ``encode`` gives them."""
    words = np.ascontiguousarray(words, np.uint64)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    marks = np.flatnonzero(words == ~np.uint64(0))
    raw = np.zeros(len(words), bool)
    if len(marks):  # a raw word may itself look like a mark: read them in order
        skip = -1
        for m in marks.tolist():
            if m != skip:
                skip = m + 1
                raw[skip] = True
    count = _COUNT[sel]
    count[raw] = 1
    count[np.flatnonzero(raw) - 1] = 0
    run = np.zeros(len(words), np.int64)
    run[first[1:]] = 1
    run = np.cumsum(run)
    upto = np.cumsum(count) - count
    place = upto - upto[first][run] + run * RUN
    stop = np.minimum((run + 1) * RUN, n)
    out[place[raw]] = words[raw]
    plain = ~raw & (count > 0)
    for s in range(2, 16):
        mine = np.flatnonzero(plain & (sel == s))
        if not len(mine):
            continue
        c, bits = SELECTORS[s]
        mask = np.uint64((1 << bits) - 1)
        payload = words[mine] & _PAYLOAD
        for k in range(c):
            here = place[mine] + k
            inside = here < stop[mine]
            out[here[inside]] = ((payload >> np.uint64(k * bits)) & mask)[inside]
    return out
