"""CRC-32 of joined strings from the CRC-32 of their parts, in whole arrays."""

from __future__ import annotations

import numpy as np

#: The reversed polynomial of CRC-32 (fixed by the format).
POLYNOMIAL = 0xEDB88320

_SHORT = 64


def _byte_table() -> np.ndarray:
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = (v >> np.uint32(1)) ^ np.where(v & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return v


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of CRC states, given by its value on each byte of the state (4 x 256)."""
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


class Joiner:
    """``join(a, b, n)``: the CRC of a string with CRC ``a`` followed by one of ``n`` bytes with CRC ``b``.

    A state moves over n zero bytes by a linear map; the maps of under 64 bytes are tabulated, as are those of 64 times a power of two.
    """

    def __init__(self) -> None:
        step = _byte_table()
        at = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
        for _ in range(_SHORT):
            at.append((at[-1] >> np.uint32(8)) ^ step[at[-1] & 255])
        self.short = np.stack(at[:_SHORT])
        self.long = [at[_SHORT]]

    def join(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        low, high = n & (_SHORT - 1), n >> 6
        t = self.short
        out = t[low, 0, a & 255] ^ t[low, 1, (a >> 8) & 255] ^ t[low, 2, (a >> 16) & 255] ^ t[low, 3, a >> 24]
        level = 0
        while high.any():
            if level == len(self.long):
                self.long.append(np.stack([_through(self.long[-1], row) for row in self.long[-1]]))
            odd = np.flatnonzero(high & 1)
            out[odd] = _through(self.long[level], out[odd])
            high, level = high >> 1, level + 1
        return out ^ b
