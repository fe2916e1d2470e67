"""Vectorised hashes of bytes, words and runs of symbols, on whole batches of texts."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(64)
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
PLACE = _RNG.integers(0, 2**64, 1 << 16, dtype=np.uint64) | np.uint64(1)
STEP = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
#: ASCII capitals to small letters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: What separates alphanumeric words: ASCII but letters and digits.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_bounds(raw: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    gap = np.concatenate(([True], separator[raw], [True]))
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    since = np.zeros(len(raw), dtype=np.int64)
    since[starts] = starts
    place = np.arange(len(raw)) - np.maximum.accumulate(since)
    factor = PLACE[place & 0xFFFF]
    far = np.flatnonzero(place > 0xFFFF)
    if len(far):  # words of more bytes than there are factors
        factor[far] = mix(factor[far] + (place[far] >> 16).astype(np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[raw] * factor, dtype=np.uint64)))
    return mix(sums[ends] - sums[starts])


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive symbols, by doubling."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    whole, size, out, done = h, 1, None, 0
    level = 0
    while True:
        if n & size:
            if out is None:
                out = whole[: len(h) - size + 1]
            else:
                m = len(h) - done - size + 1
                out = mix(out[:m] * STEP[level + 32] + whole[done : done + m])
            done += size
        if done == n:
            return out[: len(h) - n + 1]
        m = len(whole) - size
        whole = mix(whole[:m] * STEP[level] + whole[size:])
        size, level = size * 2, level + 1


def sorted_member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted array."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values
