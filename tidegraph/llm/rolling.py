"""64-bit polynomial fingerprints of byte ranges, for whole batches of texts at once (numpy).

A prefix sum of ``table[byte] * B**position`` (modulo 2**64, B odd and so invertible) gives the
fingerprint of any range by one subtraction and one multiplication. Two bases and two tables
give two independent halves where 128 bits are wanted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
#: One random value for each byte; ``LOWER`` gives A-Z the values of a-z.
TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = TABLE.copy()
LOWER[65:91] = LOWER[97:123]
BASE, BASE_2 = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
TABLE_2 = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)

_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1)."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        out = np.ones(max(n, 1 << 16), np.uint64)
        out[1:] = base
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        _powers[int(base)] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (finaliser of the public-domain MurmurHash3)."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Prefix:
    """Fingerprints of ranges of ``data`` (uint8)."""

    def __init__(self, data: np.ndarray, table: np.ndarray = TABLE, base: np.uint64 = BASE):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * powers(base, n), out=self.sums[1:])
        self.inverse = powers(U(pow(int(base), -1, 1 << 64)), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def every(self, k: int) -> np.ndarray:
        """Of each range of ``k`` bytes, by its start."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.inverse[:n] if n > 0 else np.zeros(0, np.uint64)


def text_chunks(column: pa.Array, most: int = 1 << 20):
    """(first row, bytes, offsets) of consecutive rows, about ``most`` bytes at a time; null is empty.

    Zero-copy views of the Arrow buffers; a text longer than ``most`` is a chunk of its own.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
