"""MD5 of many texts that differ in a number at their end, all at once; for the draws of `operators.resampling`."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Numbers at a time, so that the arrays of one step stay in a core's cache.
STEP = 16384


def _block(prefix: bytes, low: int, high: int, digits: int) -> np.ndarray:
    """Numbers low to high - 1, all of so many digits."""
    size, n = len(prefix) + digits, high - low
    if size > 55:  # more than one block of the digest
        return np.array([int(hashlib.md5(b"%s%d" % (prefix, k)).hexdigest()[:13], 16) for k in range(low, high)], np.uint64) / 2.0**52
    fixed = np.frombuffer((prefix + bytes(digits) + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little"), "<u4")
    words: dict[int, np.ndarray] = {}
    rest = np.arange(low, high, dtype=np.uint32 if high < 2**32 else np.uint64)
    for at in range(size - 1, len(prefix) - 1, -1):
        less = rest // 10
        digit = (rest - less * 10 + 48).astype(np.uint32) << np.uint32(8 * (at % 4))
        words[at // 4] = words[at // 4] | digit if at // 4 in words else digit | fixed[at // 4]
        rest = less
    a, b, c, d = (np.full(n, x, np.uint32) for x in _BEGIN)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        word = _WORD[i]
        if word in words:
            f += words[word]
        f += np.uint32((_ADD[i] + (0 if word in words else int(fixed[word]))) % 2**32)
        np.left_shift(f, np.uint32(_TURN[i]), out=t)
        np.right_shift(f, np.uint32(32 - _TURN[i]), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_BEGIN[0])
    b += np.uint32(_BEGIN[1])
    return ((a.byteswap().astype(np.uint64) << np.uint64(20)) | (b.byteswap() >> np.uint32(12))) / 2.0**52


def fractions(prefix: bytes, low: int, high: int) -> np.ndarray:
    """Of prefix + k for k from low to high - 1 the digest's first 52 bits, as numbers in [0, 1)."""
    out, at = np.empty(max(0, high - low)), low
    while at < high:
        digits = len(str(at))
        end = min(high, at + STEP, 10**digits)
        out[at - low : end - low] = _block(prefix, at, end, digits)
        at = end
    return out
