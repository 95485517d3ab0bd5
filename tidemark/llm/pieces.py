"""Cuts whole Arrow batches of texts into pieces and encodes each distinct piece once.

All work per byte and per piece is numpy: a piece is looked up by a 64-bit
hash, taken as the difference of two prefix sums, and its bytes are compared
with those of the piece found there.  Only pieces not seen before reach the encoder.  The table is emptied when it is full, and the pieces of a
long text are looked up range by range, so memory is bounded whatever a text holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

BITS = 20
SLOTS = 1 << BITS
FULL = 600_000
#: Bytes of one step; a longer text is one step by itself.  Less than FULL, so
#: the pieces of a range of so many bytes always fit an empty table.
STEP = 500_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets of a text column; null is the empty text."""
    a = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64)[a.offset:a.offset + len(a) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def steps(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``STEP`` bytes together, or one longer text."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + STEP, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks of ASCII white space, of letters (ASCII and Latin-1) and of ASCII punctuation."""
    space, letter, punct = _SPACE[data], _LETTER[data], _PUNCT[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs of multiplication and division
    letter[lead] = letter[lead + 1] = True
    return space, letter, punct


def tight(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of pieces between white space, cut before punctuation that follows a letter."""
    space, letter, punct = classes(data)
    head = np.zeros(len(data) + 1, bool)
    head[off] = True
    start = head[:-1].copy()
    start[1:] |= space[:-1] | (letter[:-1] & punct[1:])
    stop = np.empty(len(data), bool)
    stop[:-1] = start[1:] | space[1:]
    stop[-1:] = True
    return np.flatnonzero(start & ~space), np.flatnonzero(stop & ~space) + 1


def covering(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of pieces that cover every byte: white space, then what follows it, cut before punctuation after a letter."""
    space, letter, punct = classes(data)
    start = np.zeros(len(data) + 1, bool)
    start[off] = True
    start[1:-1] |= (space[1:] & ~space[:-1]) | (letter[:-1] & punct[1:])
    at = np.flatnonzero(start[:-1])
    return at, np.append(at[1:], len(data))


class Table:
    """Pieces -> runs of token ids, through a hash table in numpy arrays."""

    def __init__(self, encode: Callable[[list[bytes]], list[Sequence[int]]], flag: Callable[[bytes], bool] | None = None, lower: bool = False):
        self.encode, self.flag, self.lower = encode, flag, lower
        rng = np.random.Generator(np.random.Philox(key=[3, 5]))
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        if lower:
            self.value = self.value[LOWER]
        self.base = int(rng.integers(1, 1 << 63, dtype=np.uint64)) | 1
        self.power = self.inverse = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(SLOTS, np.uint64)
        self.at = np.full(SLOTS, -1, np.int32)
        self.n = 0
        self.first = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.flags = np.zeros(1024, bool)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0
        self.head = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.bytes = np.zeros(4096, np.uint8)
        self.stored = 0
        self.twins: dict[bytes, int] = {}

    def powers(self, n: int) -> None:
        if n >= len(self.power):
            n = max(n + 1, STEP + 1)
            self.power, self.inverse = np.ones(n, np.uint64), np.ones(n, np.uint64)
            self.power[1:] = self.base
            self.inverse[1:] = pow(self.base, -1, 1 << 64)
            np.multiply.accumulate(self.power, out=self.power)
            np.multiply.accumulate(self.inverse, out=self.inverse)

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self.powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[:len(data)], out=total[1:])
        h = (total[end] - total[start]) * self.inverse[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 if new; linear probing for all at once."""
        slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
        got = self.at[slot]
        miss = np.flatnonzero((got >= 0) & (self.key[slot] != h))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & (SLOTS - 1)
            got[miss] = self.at[slot[miss]]
            miss = miss[(got[miss] >= 0) & (self.key[slot[miss]] != h[miss])]
        return got

    def insert(self, h: np.ndarray, number: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.at[slot[todo]] < 0]
            self.at[slot[free]] = number[free]
            self.key[slot[free]] = h[free]
            todo = todo[self.at[slot[todo]] != number[todo]]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)

    def differing(self, number: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which pieces are not the ones of their numbers: another piece has the same hash."""
        size = end - start
        wrong = self.size[number] != size
        at = np.flatnonzero(~wrong)
        if not len(at):
            return np.flatnonzero(wrong)
        size = size[at]
        stop = np.cumsum(size)
        step = np.arange(int(stop[-1])) - np.repeat(stop - size, size)
        mine = data[np.repeat(start[at], size) + step]
        unlike = (LOWER[mine] if self.lower else mine) != self.bytes[np.repeat(self.head[number[at]], size) + step]
        wrong[at[np.unique(np.searchsorted(stop, np.flatnonzero(unlike), "right"))]] = True
        return np.flatnonzero(wrong)

    def learn(self, words: list[bytes]) -> None:
        """Numbers the words from ``n`` on."""
        got = self.encode(words)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while self.n + len(got) > len(self.first):
            self.first, self.count, self.flags, self.head, self.size = (np.resize(x, 2 * len(x)) for x in (self.first, self.count, self.flags, self.head, self.size))
        raw = np.frombuffer(b"".join(words), np.uint8)
        while self.stored + len(raw) > len(self.bytes):
            self.bytes = np.resize(self.bytes, 2 * len(self.bytes))
        self.flat[self.used:self.used + total] = np.fromiter((t for ids in got for t in ids), np.uint32, total)
        mine = slice(self.n, self.n + len(got))
        self.first[mine] = self.used + np.cumsum(lengths) - lengths
        self.count[mine] = lengths
        self.size[mine] = np.fromiter(map(len, words), np.int64, len(words))
        self.head[mine] = self.stored + np.cumsum(self.size[mine]) - self.size[mine]
        self.bytes[self.stored:self.stored + len(raw)] = raw
        if self.flag:
            self.flags[mine] = [self.flag(w) for w in words]
        self.n += len(got)
        self.used += total
        self.stored += len(raw)

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each piece; holds until the next call.  At most ``FULL`` pieces."""
        h = self.hashes(data, start, end)
        got = self.find(h)
        new = np.flatnonzero(got < 0)
        if len(new):
            fresh, index = np.unique(h[new], return_index=True)
            if self.n and self.n + len(fresh) > FULL:
                self.clear()
                new = np.arange(len(h))
                fresh, index = np.unique(h, return_index=True)
            words = self.words(data, start, end, new[index])
            first = self.n
            self.learn(words)
            self.insert(fresh, np.arange(first, self.n, dtype=np.int32))
            got = self.find(h)
        unlike = self.differing(got, data, start, end)
        if len(unlike):  # the table holds one piece per hash, ``twins`` the others
            words = self.words(data, start, end, unlike)
            more = [w for w in dict.fromkeys(words) if w not in self.twins]
            self.twins.update(zip(more, range(self.n, self.n + len(more))))
            if more:
                self.learn(more)
            got[unlike] = [self.twins[w] for w in words]
        return got

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> list[bytes]:
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
        return [w.lower() for w in words] if self.lower else words

    def runs(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of the pieces in a row, where each piece ends among them, and the pieces' flags.

        Pieces are taken in ranges of at most ``STEP`` bytes, or one longer
        piece; the table may be emptied between two ranges.
        """
        ids, ends, flags = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        at, used = 0, 0
        while at < len(start):
            low = int(start[at])
            to = max(at + 1, int(np.searchsorted(end, low + STEP, "right")))
            number = self.numbers(data[low:int(end[to - 1])], start[at:to] - low, end[at:to] - low)
            got, stop = self.expand(number)
            ids.append(got)
            ends.append(stop + used)
            flags.append(self.flags[number])
            at, used = to, used + len(got)
        return np.concatenate(ids), np.concatenate(ends), np.concatenate(flags)

    def expand(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pieces in a row, and where each piece ends among them."""
        count = self.count[number]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(self.first[number] - (ends - count), count)
        where += np.arange(total)
        return self.flat[where], ends
