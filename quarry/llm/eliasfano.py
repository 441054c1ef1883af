"""Elias-Fano coded monotone sequences, searched in whole arrays at a time.

A sequence of n values below u takes about 2 + log2(u / n) bits a value: the
low bits are packed one after the other, the high parts stand in unary in a
bit vector.  The words may live in a memory-mapped file.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np

U = np.uint64


def in_memory(words: np.ndarray) -> np.ndarray:
    return words


def mapped(words: np.ndarray) -> np.ndarray:
    """The array in a memory-mapped file of the task's own, which vanishes with the mapping."""
    if not len(words):
        return words
    with tempfile.TemporaryFile() as f:
        words.tofile(f)
        f.flush()
        return np.memmap(f, words.dtype, "r", shape=words.shape)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, one after the other, in 64-bit words and a spare one."""
    if not width:
        return np.zeros(2, U)
    out = []
    for at in range(0, len(values), 64 * 1024):  # a multiple of 64 values fills whole words
        part = values[at : at + 64 * 1024]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width].ravel()
        out.append(np.packbits(np.concatenate((bits, np.zeros(-len(bits) % 64, np.uint8))), bitorder="little").view(U))
    return np.concatenate((*out, np.zeros(1, U)))


class Selector:
    """Positions of the k-th one (or zero) of a bit vector."""

    def __init__(self, words: np.ndarray, ones: bool):
        self.words, self.flip = words, U(0) if ones else U(0xFFFFFFFFFFFFFFFF)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words ^ self.flip), dtype=np.int64)))

    def __call__(self, k: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.before, k, side="right") - 1
        rest = (k - self.before[at]).astype(np.int64)
        word = self.words[at] ^ self.flip
        place = np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count((word >> place.astype(U)) & U((1 << step) - 1)).astype(np.int64)
            over = rest >= low
            rest -= np.where(over, low, 0)
            place += np.where(over, step, 0)
        return at * 64 + place


class EliasFano:
    """A monotone sequence of values below 2**63."""

    def __init__(self, values: np.ndarray, universe: int, keep: Callable[[np.ndarray], np.ndarray] = in_memory):
        values = np.ascontiguousarray(values, U)
        self.n = n = len(values)
        self.low_bits = width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        self.mask = U((1 << width) - 1)
        self.low = keep(pack(values & self.mask, width))
        high = values >> U(width)
        self.top = (universe >> width) + 1
        bits = np.zeros((n + self.top + 64) // 64 + 1, U)
        at = high.astype(np.int64) + np.arange(n)
        word = at >> 6
        np.bitwise_or.at(bits, word, U(1) << (at & 63).astype(U))
        self.high = keep(bits)
        self.one, self.zero = Selector(self.high, True), Selector(self.high, False)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(U)
        above = np.where(shift > 0, self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return ((self.low[word] >> shift) | above) & self.mask

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at some positions."""
        return ((self.one(i) - i).astype(U) << U(self.low_bits)) | self.lows(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the position of the first value not below it, and whether that value is x."""
        high = np.minimum(x >> U(self.low_bits), U(self.top)).astype(np.int64)
        low = x & self.mask
        first = np.where(high > 0, self.zero(np.maximum(high - 1, 0)) + 1 - high, 0)
        last = end = self.zero(high) - high
        while True:
            busy = first < last
            if not busy.any():
                break
            middle = (first + last) >> 1
            below = busy & (self.lows(np.where(busy, middle, 0)) < low)
            first, last = np.where(below, middle + 1, first), np.where(busy & ~below, middle, last)
        there = first < end
        return first, there & (self.lows(np.where(there, first, 0)) == low) if self.n else there
