"""Words of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

import numpy as np

#: An odd multiplier and its inverse modulo 2**64, for hashes of substrings by prefix sums.
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


_VALUE = _byte_values()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Space and 0x09 to 0x0D part words.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word [^\\x20\\x09-\\x0D]+ of a buffer, A-Z lower-cased."""
    raw = np.frombuffer(buffer, np.uint8)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        n = len(raw)
        power = _powers(_MUL, n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[_LOWER[raw]] * power, out=total[1:])
        key = (total[end] - total[start]) * _powers(_INV, n)[start]
        return start, end, mix(key + (end - start).astype(np.uint64))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), kept between calls for usual sizes."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:
            _POWERS[int(base)] = have
    return have[:n]


def batches_by_bytes(texts: list[bytes], most: int = 1 << 20):
    """(first, last) of runs of texts of about `most` bytes each; a longer text is a run of its own."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end]) + 1
            end += 1
        yield at, end
        at = end
