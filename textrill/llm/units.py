"""Encoding many texts at once: cut them into units, and encode each distinct unit once.

A unit is a stretch of text that a tokenizer encodes by itself. The cuts made here hold for every
pre-tokenizer that separates letters, digits, other characters and blanks: before a blank that
stands alone between others (which begins the next word), around any other such blank, and
where an ASCII sign follows a letter or digit. Where that is not sure, there is no cut, so that a unit may
hold several words. Cutting and looking up run over arrays of bytes; Python sees new units only.

Long texts are taken in pieces that end where a unit does, so that the arrays are of a set size whatever the text's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# bytes cut and looked up at once; pieces of a text are no longer unless they are one unit
RUN = 1 << 19
# what a table of units may hold; units beyond a length aren't kept in it
TABLE_BYTES = 32 << 20
LONG_UNIT = 1 << 12

_LETTER, _SIGN, _BLANK, _SPACE, _HIGH, _LATIN = 1, 2, 4, 8, 16, 32


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    for b in range(0x21, 0x7F):
        kind[b] = _LETTER if chr(b).isalnum() else _SIGN
    for b in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20):
        kind[b] = _BLANK
    kind[0x20] |= _SPACE
    kind[0x80:] = _HIGH
    kind[0xC3] |= _LATIN
    return kind


@lru_cache(maxsize=1)
def _mixers() -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(20240917)
    values = rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1, 2**62)) * 2 + 1
    return values, base, pow(base, -1, 1 << 64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse; kept for a usual run, made anew for a longer one."""
    return _kept_powers() if n <= RUN + 1 else _powers(n)


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(RUN + 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    _, base, inverse = _mixers()
    out = []
    for b in (base, inverse):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def cuts(data: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where units begin in the bytes of texts laid end to end."""
    kind = _classes()[data]
    begins = np.zeros(len(data) + 1, bool)
    blank = (kind & _BLANK) > 0
    alone = blank.copy()
    # next to a blank, or to a character that may be one of Unicode's (none of those with the lead
    # bytes C3 to C9 is), a blank doesn't stand alone
    high, lead = (kind & _HIGH) > 0, (data >= 0xC3) & (data <= 0xC9)
    alone[:-1] &= ~blank[1:] & (~high[1:] | lead[1:])
    alone[1:] &= ~blank[:-1]
    alone[2:] &= ~high[1:-1] | lead[:-2]
    begins[:-1] |= alone
    begins[1:] |= alone & ((kind & _SPACE) == 0)
    letter = (kind & _LETTER) > 0
    # the second byte of U+00C0 to U+00FF but the signs for times and division
    letter[1:] |= ((kind[:-1] & _LATIN) > 0) & ((kind[1:] & _HIGH) > 0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    begins[1:-1] |= letter[:-1] & ((kind[1:] & _SIGN) > 0)
    begins[doc_starts] = True
    return np.flatnonzero(begins[:-1])


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A digest of 63 bits for each stretch: random values of the bytes times powers of a random base.

    It says where to look for a unit, not which unit it is: some unlike stretches share it whatever the base.
    """
    values = _mixers()[0]
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h | np.uint64(1)


def pieces(text: bytes, size: int = RUN) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes that end where a unit does; a unit is never parted."""
    begin, reach = 0, size
    while len(text) - begin > reach:
        # the last bytes of a window don't show what follows them
        found = cuts(np.frombuffer(text, np.uint8, reach, begin), np.zeros(1, np.int64))
        found = found[(found > 0) & (found < reach - 4)]
        if len(found):
            yield text[begin : begin + int(found[-1])]
            begin, reach = begin + int(found[-1]), size
        else:
            reach *= 2
    yield text[begin:] if begin else text


# ids of all units given, one after the other, and how many each has
Learn = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


class UnitTable:
    """The units seen so far with their ids, in arrays: an open table by digest, one pool of bytes, one of ids.

    A digest finds an entry, then length and bytes are compared, so that no digest decides an id. Units that
    share the digest of another, and those longer than ``LONG_UNIT``, are encoded each time. The table is
    emptied when its arrays hold more than ``limit`` bytes.
    """

    def __init__(self, learn: Learn, limit: int = TABLE_BYTES):
        self.learn, self.limit = learn, limit
        self.clear()

    def clear(self) -> None:
        self.size = 1 << 14
        self.keys, self.entry = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32)
        self.count = 0
        self.first, self.length = np.zeros(1 << 13, np.int64), np.zeros(1 << 13, np.int32)
        self.pool, self.used = np.zeros(1 << 15, np.uint32), 0
        self.at, self.bytes_of = np.zeros(1 << 13, np.int64), np.zeros(1 << 13, np.int32)
        self.text, self.text_used = np.zeros(1 << 16, np.uint8), 0

    def nbytes(self) -> int:
        held = (self.keys, self.entry, self.first, self.length, self.pool, self.at, self.bytes_of, self.text)
        return sum(a.nbytes for a in held)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each digest, -1 if it is new."""
        mask = np.uint64(self.size - 1)
        slot = ((h >> np.uint64(1)) & mask).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.entry[slot], -1)
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (self.size - 1)
            key = self.keys[slot[left]]
            same = key == h[left]
            out[left[same]] = self.entry[slot[left[same]]]
            left = left[~same & (key != 0)]
        return out

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        """Put distinct new digests into the table."""
        slot = ((h >> np.uint64(1)) & np.uint64(self.size - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            left = left[np.argsort(slot[left], kind="stable")]
            at = slot[left]
            first = np.ones(len(left), bool)
            first[1:] = at[1:] != at[:-1]
            first &= self.keys[at] == 0
            won = left[first]
            self.keys[slot[won]], self.entry[slot[won]] = h[won], entry[won]
            left = left[~first]
            slot[left] = (slot[left] + 1) & (self.size - 1)

    def _grow(self, new: int, ids: int, text: int) -> None:
        for names, used, more in (
            (("first", "length", "at", "bytes_of"), self.count, new), (("pool",), self.used, ids), (("text",), self.text_used, text),
        ):
            for name in names:
                array = getattr(self, name)
                if used + more > len(array):
                    setattr(self, name, np.resize(array, max(2 * len(array), used + more)))
        if 2 * (self.count + new) > self.size:
            held = self.keys != 0
            h, entry = self.keys[held], self.entry[held]
            while 2 * (self.count + new) > self.size:
                self.size *= 2
            self.keys, self.entry = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32)
            self._place(h, entry)

    def _add(self, h: np.ndarray, units: list[bytes]) -> None:
        found, counts = self.learn(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        total, text = len(found), b"".join(units)
        self._grow(len(h), total, len(text))
        entry = np.arange(self.count, self.count + len(h))
        self.first[entry], self.length[entry] = self.used + np.cumsum(counts) - counts, counts
        self.at[entry], self.bytes_of[entry] = self.text_used + np.cumsum(sizes) - sizes, sizes
        self.pool[self.used : self.used + total] = found
        self.text[self.text_used : self.text_used + len(text)] = np.frombuffer(text, np.uint8)
        self._place(h, entry.astype(np.int32))
        self.count += len(h)
        self.used += total
        self.text_used += len(text)

    def _same(self, data: np.ndarray, sizes: np.ndarray, units: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Whether each of ``units`` (places among stretches of ``sizes`` that fill ``data``) is its entry's unit."""
        mine = sizes[units]
        same = self.bytes_of[entry] == mine
        begins = np.cumsum(mine) - mine
        if len(units) < len(sizes):
            held = np.zeros(len(sizes), bool)
            held[units] = True
            data = data[np.repeat(held, sizes)]
        place = np.repeat(self.at[entry] - begins, mine) + np.arange(len(data))
        equal = self.text[np.minimum(place, self.text_used - 1)] == data
        return same if equal.all() else same & np.logical_and.reduceat(equal, begins)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (and the last's end)."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = b"".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(joined, np.uint8)
        doc_starts = np.cumsum(lengths) - lengths
        starts = cuts(data, doc_starts[lengths > 0])
        ends = np.append(starts[1:], len(data))
        sizes = ends - starts
        if self.nbytes() > self.limit:
            self.clear()
        slices = lambda at: [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        alone = sizes > LONG_UNIT
        kept = np.flatnonzero(~alone)
        first, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        pool = self.pool
        if len(kept):
            h = hashes(data, starts[kept], ends[kept])
            entry = self._find(h)
            missing = np.flatnonzero(entry < 0)
            if len(missing):
                new, at = np.unique(h[missing], return_index=True)
                self._add(new, slices(kept[missing[at]]))
                entry[missing] = self._find(h[missing])
            alone[kept] = ~self._same(data, sizes, kept, entry)
            first[kept], counts[kept] = self.first[entry], self.length[entry]
            pool = self.pool
        if alone.any():
            by_unit: dict[bytes, list[int]] = {}
            at = np.flatnonzero(alone)
            for i, unit in zip(at.tolist(), slices(at), strict=True):
                by_unit.setdefault(unit, []).append(i)
            found, of_unit = self.learn(list(by_unit))
            pool, used = np.concatenate([self.pool[: self.used], found]), self.used
            for places, n in zip(by_unit.values(), of_unit.tolist(), strict=True):
                first[places], counts[places] = used, n
                used += n
        behind = np.cumsum(counts)
        ids = pool[np.repeat(first - (behind - counts), counts) + np.arange(int(behind[-1]))]
        before = np.concatenate([[0], behind])
        offsets = np.append(before[np.searchsorted(starts, doc_starts)], behind[-1])
        return ids, offsets


class TextEncoder:
    """Whole texts to ids: special strings are tokens of their own, what stands around them is cut into
    pieces and runs of a set size, and each run is encoded by its units."""

    def __init__(self, special: dict[str, int], units: UnitTable, lower: bool = False):
        self.units, self.lower = units, lower  # lower: A-Z may be lower-cased outside special strings
        self.special = {s.encode(): i for s, i in special.items()}
        longest = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.pattern = re.compile(b"(" + b"|".join(longest) + b")") if longest else None

    def _parts(self, texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        """``(text, id of a special string or -1, piece)``"""
        for i, text in enumerate(texts):
            split = self.pattern.split(text) if self.pattern and self.pattern.search(text) else [text]
            for k, part in enumerate(split):
                if k % 2:
                    yield i, self.special[part], b""
                elif part:
                    yield from ((i, -1, piece.lower() if self.lower else piece) for piece in pieces(part, RUN))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (and the last's end)."""
        out = bytearray()  # grows in place
        counts = np.zeros(len(texts) + 1, np.int64)
        run: list[tuple[int, int, bytes]] = []
        held = 0

        def close() -> None:
            ids, offsets = self.units.encode([piece for _, _, piece in run])
            of, marks = np.array([i for i, _, _ in run]), np.array([m for _, m, _ in run])
            at = np.flatnonzero(marks >= 0)
            np.add.at(counts, of + 1, np.diff(offsets) + (marks >= 0))
            out.extend((np.insert(ids, offsets[at], marks[at].astype(np.uint32)) if len(at) else ids).tobytes())
            run.clear()

        for part in self._parts(texts):
            run.append(part)
            held += len(part[2]) + 1
            if held >= RUN:
                close()
                held = 0
        if run:
            close()
        return np.frombuffer(out, np.uint32), np.cumsum(counts)


def byte_batches(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """The UTF-8 texts of a batch, null as empty, in runs of about ``size`` bytes, with the row each begins at."""
    texts, held, begun = [], 0, 0
    for i, text in enumerate(batch.column(column)):
        texts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
        held += len(texts[-1])
        if held >= size or i + 1 == batch.num_rows:
            yield begun, texts
            texts, held, begun = [], 0, i + 1
