"""Words, hashes of words and of word windows of many texts at once, with numpy.

Hashes are polynomials modulo 2^64 over random byte values, mixed afterwards. They
choose buckets and candidates; results that must be exact are compared as bytes.
"""

from __future__ import annotations

import numpy as np

_SPAN = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_P, _SPAN), _powers(_P_INVERSE, _SPAN)


def word_table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], bool)


#: Bytes of words that end at ASCII white space only.
SPACED = word_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line feed around each text, and where each text starts."""
    data = b"\n" + b"\n".join(texts) + b"\n"
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])[: len(texts)]
    return np.frombuffer(data, np.uint8), starts.astype(np.int64)


def words(buffer: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in a buffer that begins and ends between words."""
    inside = table[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edges[0::2], edges[1::2]


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, computed over spans of bounded size."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + _SPAN, "right")))
        n = int(ends[j - 1] - at)
        up, down = (_UP, _DOWN) if n <= _SPAN else (_powers(_P, n), _powers(_P_INVERSE, n))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[buffer[at:at + n]] * up[:n], out=total[1:])
        first, last = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (total[last] - total[first]) * down[first]
        i = j
    return mix(out)


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive items, by doubling; unmixed."""
    if len(h) < length:
        return h[:0]
    part, size, out, done = h, 1, None, 0
    while True:
        if length & size:
            if out is None:
                out, done = part, size
            else:  # the run so far, then ``part`` behind it
                n = len(h) - done - size + 1
                out = out[:n] * np.uint64(pow(int(_Q), size, 1 << 64)) + part[done:done + n]
                done += size
        if done == length:
            return out
        n = len(part) - size
        part = part[:n] * np.uint64(pow(int(_Q), size, 1 << 64)) + part[size:size + n]
        size *= 2


def sliding(h: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Least (or greatest) of every ``width`` consecutive items."""
    if len(h) < width:
        return h[:0]
    part, size = h, 1
    while size * 2 <= width:
        part = pick(part[:-size], part[size:])
        size *= 2
    rest = width - size
    return pick(part[:len(part) - rest], part[rest:]) if rest else part


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of equal items."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(values)]))


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` items lie in any of the half-open intervals."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(change)[:n] > 0
