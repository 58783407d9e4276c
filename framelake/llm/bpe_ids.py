"""Token ids of whole texts by the tokenizers library, a distinct piece at a time.

A byte-level BPE never merges across the pieces of its splitting pattern, so the ids of a text are those of its
pieces in a row. Corpora repeat their pieces: the pieces of a slice of texts are found by byte class with numpy, and
a worker encodes each distinct one once and looks it up afterwards by a 64-bit hash. Texts with bytes outside ASCII
and the Latin letters U+00C0-U+024F, or with the text of a special token, are encoded whole. Results equal
``Tokenizer.encode(text, add_special_tokens=False)``; tests compare them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from framelake.llm.text_blocks import byte_hash, raw

#: Pieces that a worker remembers, some 40 MB.
KEPT_PIECES = 700_000
TABLE_BITS = 21
JOINED = 2_000

SPACE, LETTER, DIGIT, OTHER = range(4)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER
_CLASS[48:58] = DIGIT
#: Bytes that the classes above do not settle.
_UNSETTLED = np.zeros(256, bool)
_UNSETTLED[[*range(0x1C, 0x20), 0xC2, *range(0xCA, 0x100)]] = True
#: Endings that the splitting pattern keeps with their apostrophe (fixed by the vocabulary).
_ENDINGS = ((b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll"))


def piece_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First bytes of the pieces that the splitting pattern makes of texts with settled bytes.

    Runs of letters, of digits or of other marks, each with one blank before it; of white space before such a run
    the last character stands apart; ``'s 't 're 've 'm 'll 'd`` are pieces where one may begin.
    """
    n = len(data)
    kind = _CLASS[data]
    sign = np.flatnonzero((data[1:] == 0x97) | (data[1:] == 0xB7))
    sign = sign[data[sign] == 0xC3]  # the multiplication and division signs are no letters
    kind[sign] = kind[sign + 1] = OTHER
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = edge[:-1].copy()
    if n > 1:
        change = kind[1:] != kind[:-1]
        start[1:] |= change & ((data[:-1] != 0x20) | (kind[1:] == SPACE))
        start[:-1] |= (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:-1]
        start[1:] |= edge[1:-1]
    for mark in np.flatnonzero((data == 0x27) & start).tolist():
        stop = int(at[np.searchsorted(at, mark, "right")])
        tail = data[mark + 1:min(mark + 3, stop)].tobytes()
        size = 1 if tail[:1] in _ENDINGS[0] else 2 if tail in _ENDINGS[1] else 0
        if size:
            start[mark + 1:mark + 1 + size] = False
            if mark + 1 + size < stop:
                start[mark + 1 + size] = True
    return np.flatnonzero(start)


class _HashTable:
    """64-bit hash -> slot, with open addressing in two arrays; lookups and inserts take whole arrays."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.slots = np.full(1 << bits, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        left, place = np.arange(len(hashes)), hashes & self.mask
        while len(left):
            used = self.slots[place] >= 0
            same = used & (self.keys[place] == hashes[left])
            out[left[same]] = self.slots[place[same]]
            on = used & ~same
            left, place = left[on], (place[on] + np.uint64(1)) & self.mask
        return out

    def insert(self, hashes: np.ndarray, first: int) -> None:
        """Gives distinct unknown hashes the slots from ``first`` on."""
        left, place = np.arange(len(hashes)), hashes & self.mask
        while len(left):
            free = np.flatnonzero(self.slots[place] < 0)
            self.slots[place[free]] = first + left[free]  # of several for one place the last stays
            got = self.slots[place] == first + left
            self.keys[place[got]] = hashes[left[got]]
            left, place = left[~got], (place[~got] + np.uint64(1)) & self.mask


class PieceEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.feed = self.whole.encode("\n", add_special_tokens=False).ids[0]
        self._forget()

    def _forget(self) -> None:
        self.table = _HashTable(TABLE_BITS)
        self.pool = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int32)

    def _slots(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pool slot of each distinct piece; unknown ones are encoded."""
        if len(self.size) + len(hashes) > KEPT_PIECES:
            self._forget()
            if len(hashes) > KEPT_PIECES:
                self.table = _HashTable(len(hashes).bit_length() + 1)
        found = self.table.find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            whole = data.tobytes()
            text = [whole[a:b] for a, b in zip(start[missing].tolist(), end[missing].tolist(), strict=True)]
            blank = _CLASS[data[end[missing] - 1]] == SPACE
            size, fresh = self._encode(text, blank)
            base = len(self.size)
            self.first = np.concatenate([self.first, (len(self.pool) + np.cumsum(size) - size).astype(np.int32)])
            self.size = np.concatenate([self.size, size.astype(np.int32)])
            self.pool = np.concatenate([self.pool, fresh])
            found[missing] = base + np.arange(len(missing))
            self.table.insert(hashes[missing], base)
        return found

    def _encode(self, pieces: list[bytes], blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids per piece, all ids) of distinct pieces.

        A line feed between two pieces is a piece and an id of its own, so thousands of pieces make one text; pieces
        of white space alone (``blank``) are encoded one by one.
        """
        size = np.zeros(len(pieces), np.int64)
        plain, rest = np.flatnonzero(~blank), np.flatnonzero(blank)
        joined = [b"\n".join([pieces[i] for i in plain[k:k + JOINED].tolist()]).decode() for k in range(0, len(plain), JOINED)]
        parts = []
        for k, got in enumerate(self.whole.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(got.ids, np.uint32)
            feeds = np.flatnonzero(ids == self.feed)
            ends = np.append(feeds, len(ids))
            size[plain[k * JOINED:(k + 1) * JOINED]] = np.diff(np.concatenate([[-1], ends])) - 1
            parts.append(np.delete(ids, feeds))
        alone = [pieces[i].decode() for i in rest.tolist()]
        for i, got in zip(rest.tolist(), self.whole.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            size[i] = len(got.ids)
            parts.append(np.array(got.ids, np.uint32))
        order = np.concatenate([plain, rest])
        first = np.zeros(len(pieces), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return size, ids[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def _set_apart(self, data: np.ndarray, at: np.ndarray) -> set[int]:
        """Texts that are to be encoded whole."""
        places = [np.flatnonzero(_UNSETTLED[data])]
        plain = data.tobytes()
        for mark in self.special:
            hits, i = [], plain.find(mark)
            while i >= 0:
                hits.append(i)
                i = plain.find(mark, i + 1)
            places.append(np.array(hits, np.int64))
        return set(np.unique(np.searchsorted(at, np.concatenate(places), "right") - 1).tolist())

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a slice, in order."""
        data, at = raw(texts)
        start = piece_starts(data, at)
        end = np.append(start[1:], len(data))
        hashes, where, back = np.unique(byte_hash(data, start, end), return_index=True, return_inverse=True)
        apart = self._set_apart(data, at)
        if apart:  # their pieces may be cut inside a character: keep them out of the pool
            owner = np.searchsorted(at, start, "right") - 1
            keep = ~np.isin(owner, list(apart))
            start, end = start[keep], end[keep]
            hashes, where, back = np.unique(byte_hash(data, start, end), return_index=True, return_inverse=True)
        slot = self._slots(hashes, data, start[where], end[where])[back]
        size = self.size[slot].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.first[slot] - upto[:-1], size) + np.arange(upto[-1])]
        piece = np.searchsorted(start, at)
        for i in range(len(texts)):
            if i in apart:
                yield np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[upto[piece[i]]:upto[piece[i + 1]]]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    return PieceEncoder(path)


def default_path() -> str:
    """File of the public byte-level vocabulary with 50,257 ids, as installed."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
