"""Words of whole Arrow columns of text as 64-bit hashes, without a Python loop over words.

A column is handled in pieces of about a megabyte, so memory does not grow with
the batch; one text is never cut, so a piece can be one very long text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
PIECE_ROWS = 60_000

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*excluded: tuple[int, int]) -> np.ndarray:
    """Which bytes belong to words: all but those in the inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for first, last in excluded:
        table[first : last + 1] = False
    return table


#: Everything but blanks and control white space.
NOT_BLANK = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Digits, small ASCII letters and all that is not ASCII.
LETTERS = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(count: int, seed: int) -> np.ndarray:
    """Fixed odd 64-bit numbers drawn from a seed."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)
        return mix(steps * np.uint64(_BASE)) | np.uint64(1)


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, dtype=np.uint64)
    steps[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(steps, dtype=np.uint64)


class Powers:
    """Powers of the base and of its inverse, grown to the longest piece seen."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def reach(self, count: int) -> None:
        if count > len(self.up):
            self.up, self.down = _powers(_BASE, count), _powers(_BASE_INVERSE, count)


@dataclass
class Piece:
    """Some consecutive texts of a batch: their bytes and the words in them."""

    first: int  # row of the batch
    data: np.ndarray  # bytes, folded to lower case if asked
    offsets: np.ndarray  # of the rows in data, one more than rows
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    row: np.ndarray  # of each word, from 0
    powers: Powers

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def _sums(self) -> np.ndarray:
        self.powers.reach(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * self.powers.up[: len(self.data)], out=sums[1:])
        return sums

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span."""
        sums = self._sums
        lengths = (ends - starts).astype(np.uint64)
        return mix((sums[ends] - sums[starts]) * self.powers.down[starts] + lengths)

    def beginnings(self, characters: int) -> tuple[np.ndarray, np.ndarray]:
        """Words with at least so many characters, and a hash of each one's first ones."""
        begins = np.flatnonzero((self.data & 0xC0) != 0x80)
        begins = np.concatenate((begins, [len(self.data)]))
        at = np.searchsorted(begins, self.starts) + characters
        ends = begins[np.minimum(at, len(begins) - 1)]
        words = np.flatnonzero((at < len(begins)) & (ends <= self.ends))
        return words, mix(self.spans(self.starts[words], ends[words]) + np.uint64(characters))

    def hashes(self) -> np.ndarray:
        """A hash of each word."""
        return self.spans(self.starts, self.ends)

    def counts(self) -> np.ndarray:
        """Words of each row."""
        return np.bincount(self.row, minlength=self.rows)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, is_word: np.ndarray, lower: bool, powers: Powers) -> Iterator[Piece]:
    """Cut a column into pieces and find their words: runs of bytes in ``is_word``."""
    data, offsets = text_bytes(column)
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), first + PIECE_ROWS, rows)
        own = data[offsets[first] : offsets[last]]
        own = LOWER[own] if lower else own
        marks = offsets[first : last + 1] - offsets[first]
        inside = is_word[own]
        before = np.zeros(len(own), dtype=bool)
        before[1:] = inside[:-1]
        before[marks[marks < len(own)]] = False
        after = np.zeros(len(own), dtype=bool)
        after[:-1] = inside[1:]
        after[marks[marks > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        row = np.searchsorted(marks[1:], starts, side="right")
        yield Piece(first, own, marks, starts, ends, row, powers)
        first = last


def first_words(counts: np.ndarray) -> np.ndarray:
    """Index of the first word of each row."""
    return np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
