"""Murmur3 (x86, 32 bits, seed 0) of terms, vectorised, and a 48-bit linear congruential generator."""

from __future__ import annotations

import math
import struct
from typing import Any

import numpy as np

# Fixed values of the published algorithm.
C1, C2, M5, N1, F1, F2 = 0xCC9E2D51, 0x1B873593, 5, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
_MASK = 0xFFFFFFFF


def _signed(h: int) -> int:
    return h - (1 << 32) if h & 0x80000000 else h


def murmur3(data: bytes) -> int:
    """Signed 32-bit hash of whole 4-byte little-endian blocks and the tail."""
    return int(murmur3_many([data])[0])


def murmur3_many(items: list[bytes]) -> np.ndarray:
    """Signed 32-bit hashes of byte strings: those of one length are hashed side by side."""
    out = np.zeros(len(items), np.int64)
    by: dict[int, list[int]] = {}
    for k, b in enumerate(items):
        by.setdefault(len(b), []).append(k)
    for n, at in by.items():
        block = np.frombuffer(b"".join(items[k] for k in at), np.uint8).reshape(len(at), n).astype(np.uint64)
        h = np.zeros(len(at), np.uint64)
        mask = np.uint64(_MASK)

        def rotated(x: np.ndarray, r: int) -> np.ndarray:
            return ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & np.uint64(_MASK)

        def mixed(k: np.ndarray) -> np.ndarray:
            return rotated((k * np.uint64(C1)) & np.uint64(_MASK), 15) * np.uint64(C2) & np.uint64(_MASK)

        for i in range(0, n - n % 4, 4):
            word = block[:, i] | block[:, i + 1] << np.uint64(8) | block[:, i + 2] << np.uint64(16) | block[:, i + 3] << np.uint64(24)
            h = (rotated(h ^ mixed(word), 13) * np.uint64(M5) + np.uint64(N1)) & mask
        if n % 4:
            tail = sum((block[:, n - n % 4 + i] << np.uint64(8 * i) for i in range(n % 4)), np.zeros(len(at), np.uint64))
            h = h ^ mixed(tail)
        h ^= np.uint64(n)
        for factor, shift in ((F1, 16), (F2, 13)):
            h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & mask
        out[at] = (h ^ (h >> np.uint64(16))).astype(np.int64)
    return np.where(out >= 1 << 31, out - (1 << 32), out)


def term_bytes(v: Any) -> bytes:
    """What is hashed of a term: strings as UTF-16, integers that fit 4 bytes so, others 8, doubles by their bits, booleans as 0 or 1."""
    if v is None:
        return b""
    if isinstance(v, bool):
        return struct.pack("<i", int(v))
    if isinstance(v, str):
        return v.encode("utf-16-le", "surrogatepass")
    if isinstance(v, float):
        return struct.pack("<d", math.nan if math.isnan(v) else v)
    return struct.pack("<q", v)


def term_hashes(values: list[Any], integers: int = 8) -> np.ndarray:
    """Hashes of terms; null hashes to 0.  ``integers``: bytes that an integer is hashed as (4 for int columns, else 8)."""
    raw = [struct.pack("<i", v) if integers == 4 and isinstance(v, int) and not isinstance(v, bool) else term_bytes(v) for v in values]
    out = murmur3_many(raw)
    out[[k for k, v in enumerate(values) if v is None]] = 0
    return out


class JavaRandom:
    """The documented 48-bit generator of java.util.Random, so that coefficients drawn from a seed are portable."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return _signed32(self.state >> (48 - n), n)

    def next_int(self, bound: int) -> int:
        r = self.bits(31)
        if bound & (bound - 1) == 0:
            return (bound * r) >> 31
        u = r
        while u - (r := u % bound) + bound - 1 >= 1 << 31:
            u = self.bits(31)
        return r


def _signed32(x: int, n: int) -> int:
    return x - (1 << 32) if n == 32 and x >= 1 << 31 else x
