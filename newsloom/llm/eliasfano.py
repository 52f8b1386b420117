"""Elias-Fano lists: non-decreasing whole numbers in about two bits each and the low bits of their mean gap, in whole bytes.

The high parts stand in unary in a bit vector, the low parts in an array beside it. All operations take arrays of
questions; directories of ones and zeros lead to a word of 64 bits, and a table to the bit in it.
"""

from __future__ import annotations

import numpy as np

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Every so many values one stands in the directory of a sampled list.
SAMPLED = 16
#: Widths of low parts and how they are written: whole bytes are read by one index. A list takes the width that makes it smallest.
LOW = {0: np.uint8, 8: np.uint8, 16: np.uint16, 32: np.uint32}


def _select_table() -> np.ndarray:
    """Place of the k-th set bit of every 16-bit number, at number * 16 + k."""
    bits = (np.arange(1 << 16, dtype=np.uint32)[:, None] >> np.arange(16, dtype=np.uint32)) & 1
    at = np.cumsum(bits, axis=1) - 1
    table = np.zeros((1 << 16, 16), np.uint8)
    number, place = np.nonzero(bits)
    table[number, at[number, place]] = place
    return table.reshape(-1)


_PLACES = _select_table()


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit of each word."""
    k = k.astype(np.uint8)
    below = np.bitwise_count(words.astype(np.uint32))
    upper = k >= below
    k -= below * upper
    words = words >> (upper.astype(np.uint64) << np.uint64(5))
    below = np.bitwise_count(words.astype(np.uint16))
    second = k >= below
    k -= below * second
    words >>= second.astype(np.uint64) << np.uint64(4)
    place = _PLACES[words.astype(np.uint16).astype(np.int64) << 4 | k]
    place += upper * np.uint8(32) + second * np.uint8(16)
    return place.astype(np.int64)


class EliasFano:
    """A list that was built by `arrays` and is read from them by `EliasFano(arrays, name)`."""

    @staticmethod
    def arrays(values: np.ndarray, name: str, sampled: bool = False) -> dict[str, np.ndarray]:
        """sampled: a directory of values shortens searches where many values share their high part."""
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = min(LOW, key=lambda w: w * n + 2 * (top >> w))
        ones = (values >> low) + np.arange(n)
        bits = np.zeros(-(-((top >> low) + n + 1) // 64) * 64, bool)
        bits[ones] = True
        high = np.packbits(bits, bitorder="little").view("<u8")
        upto = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])[:-1]
        packed = (values & ((1 << low) - 1)).astype(LOW[low])
        place = np.int32 if 64 * len(high) < 1 << 31 else np.int64
        return {f"{name}_high": high, f"{name}_ones": upto.astype(place), f"{name}_zeros": (64 * np.arange(len(high)) - upto).astype(place), f"{name}_low": packed, f"{name}_is": np.array([n, low, top], np.int64), **({f"{name}_sample": values[::SAMPLED]} if sampled else {})}

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.high, self.ones, self.zeros, self.packed = (arrays[f"{name}_{x}"] for x in ("high", "ones", "zeros", "low"))
        self.n, self.low, self.top = arrays[f"{name}_is"].tolist()
        self.sample = arrays.get(f"{name}_sample")

    def _place_of_one(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, k.astype(self.ones.dtype), "right") - 1
        return word * 64 + _select_in_word(self.high[word], k - self.ones[word])

    def _place_of_zero(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), "right") - 1
        return word * 64 + _select_in_word(self.high[word] ^ _FULL, k - self.zeros[word])

    def _low_bits(self, at: np.ndarray) -> np.ndarray:
        return self.packed[at].astype(np.int64) if self.low else np.zeros(len(at), np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at these places."""
        return (self._place_of_one(at) - at) << self.low | self._low_bits(at)

    def spans(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at these places and at the next ones: the next one bit lies in the same word as a rule."""
        place = self._place_of_one(at)
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        above = (self.high[word] >> shift) >> np.uint64(1)
        after = place + 1 + np.bitwise_count((above & (~above + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        over = np.flatnonzero(above == 0)
        if len(over):
            after[over] = self._place_of_one(at[over] + 1)
        return (place - at) << self.low | self._low_bits(at), (after - at - 1) << self.low | self._low_bits(at + 1)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first place that holds each value, or -1: a successor search among the equal high parts."""
        out = np.full(len(values), -1, np.int64)
        able = np.flatnonzero((values >= 0) & (values <= self.top)) if self.n else np.zeros(0, np.int64)
        if not len(able):
            return out
        if len(able) < len(values):
            values = values[able]
        high = values >> self.low
        begin = self._place_of_zero(np.maximum(high - 1, 0)) + 1
        begin[high == 0] = 0
        # Ones from `begin` on up to the next zero: within one word as a rule.
        word, shift = begin >> 6, (begin & 63).astype(np.uint8)
        free = ~self.high[word] >> shift.astype(np.uint64)
        run = np.bitwise_count(~free & (free - np.uint64(1)))
        over = np.flatnonzero(run + shift >= 64)
        run = run.astype(np.int64)
        if len(over):
            run[over] = self._place_of_zero(high[over]) - begin[over]
        left = begin - high
        end = left + run
        if not self.low:
            out[able] = np.where(run > 0, left, -1)
            return out
        rest = (values & ((1 << self.low) - 1)).astype(self.packed.dtype)
        right = end
        if self.sample is not None:
            block = np.searchsorted(self.sample, values) * SAMPLED
            left, right = np.maximum(left, block - SAMPLED + 1), np.minimum(right, block)
        open_ = np.flatnonzero(left < right)
        if len(open_):
            a, b, asked = left[open_], right[open_], rest[open_]
            while len(open_):
                middle = (a + b) >> 1
                less = self.packed[middle] < asked
                a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
                still = a < b
                left[open_] = a
                if not still.all():
                    open_, a, b, asked = open_[still], a[still], b[still], asked[still]
        hit = np.flatnonzero(left < end)
        hit = hit[self.packed[left[hit]] == rest[hit]]
        out[able[hit]] = left[hit]
        return out
