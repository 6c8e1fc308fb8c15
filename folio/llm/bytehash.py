"""Position-independent hashes of byte windows, for whole buffers at once.

``Windows(buf).of(starts, ends)`` names each window by two polynomial hashes modulo the prime 2**31 - 1, with
random byte values and two bases, finished by an avalanche. Prefix sums make every window two reads a
base, whatever its length. A prime modulus keeps strings of two letters that are built against powers
of two (Thue-Morse strings) apart: unequal windows of n bytes agree with probability (n / 2**31)**2 at most.
"""

from __future__ import annotations

import numpy as np

_P = np.uint64(2**31 - 1)
_BITS = np.uint64(31)
_BASES = (1366128661, 1847906173)
#: Fixed values of the bytes, so that all tasks agree.
_VALUES = np.random.default_rng(20240607).integers(1, 2**31 - 1, 256, dtype=np.uint64)
#: Positions handled at a time, so that they stay in the processor's cache.
_BLOCK = 1 << 14


def _mod(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, for values below 2**62; works in the array it is given."""
    high = x >> _BITS
    x &= _P
    x += high
    np.right_shift(x, _BITS, out=high)
    x &= _P
    x += high
    x[x == _P] = 0
    return x


class _Powers:
    """base**k modulo the prime, grown by doubling and kept."""

    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint32)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = np.uint64(pow(self.base, len(self.table), int(_P)))
            self.table = np.concatenate((self.table, _mod(self.table * step).astype(np.uint32)))
        return self.table[:n]


_up = [_Powers(b) for b in _BASES]
_down = [_Powers(pow(b, -1, int(_P))) for b in _BASES]


def mix(x: np.ndarray) -> np.ndarray:
    """An avalanche of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Windows:
    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = [np.zeros(n + 1, np.uint32) for _ in _BASES]
        self.up = [up.upto(n + 1) for up in _up]
        for sums, down in zip(self.sums, (d.upto(n) for d in _down), strict=True):
            before = np.uint64(0)
            for a in range(0, n, _BLOCK):
                x = _mod(_VALUES[buf[a : a + _BLOCK]] * down[a : a + _BLOCK])
                x[0] += before
                x = _mod(np.cumsum(x, out=x))
                before = x[-1]
                sums[a + 1 : a + 1 + len(x)] = x

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ``[start, end)``; empty windows are equal to each other only."""
        out = np.empty(len(starts), np.uint64)
        for a in range(0, len(starts), _BLOCK):
            s, e = starts[a : a + _BLOCK], ends[a : a + _BLOCK]
            h = np.zeros(len(s), np.uint64)
            for sums, up in zip(self.sums, self.up, strict=True):
                x = sums[e].astype(np.uint64)
                x += _P - sums[s]
                h <<= _BITS
                # below 2**32 times below 2**31
                x = _mod(x)
                x *= up[s]
                h |= _mod(x)
            out[a : a + _BLOCK] = mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return out


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buffer, and the starts and ends of its words between ASCII white space."""
    buf = np.frombuffer(data, np.uint8)
    gap = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    return buf, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
