"""Words of many texts at once, as arrays: places, owners and 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import HELD

MASK = (1 << 64) - 1
#: Odd multiplier of the rolling polynomial, and its inverse modulo 2**64.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on each other."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A pseudo-random value for each byte.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Weights of the words of an n-gram.
WORD_STEPS = mixed(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)

_powers: dict[int, np.ndarray] = {}
HELD.append(_powers)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        size = 1 << max(18, (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


@dataclass
class Words:
    data: np.ndarray  # lower-cased bytes, each text followed by a line feed
    start: np.ndarray
    stop: np.ndarray
    text: np.ndarray  # index of each word's text
    first: np.ndarray  # first word of each text, and the total at the end
    hash: np.ndarray
    offset: np.ndarray  # of each text in data


def words_of(texts: list[bytes]) -> Words:
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    offset = np.concatenate(([0], np.cumsum(size)[:-1])) if len(texts) else np.empty(0, np.int64)
    inside = ~IS_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, stop = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(STEP, len(data)), out=sums[1:])
    hashed = mixed((sums[stop] - sums[start]) * powers(BACK, len(data))[start] + (stop - start).astype(np.uint64))
    text = np.searchsorted(offset, start, side="right") - 1
    return Words(data, start, stop, text, np.searchsorted(text, np.arange(len(texts) + 1)), hashed, offset)


def ngram_hashes(hashed: np.ndarray, n: int) -> np.ndarray:
    """Of each n consecutive words (the caller minds the ends of texts)."""
    count = max(0, len(hashed) - n + 1)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total += hashed[k : k + count] * WORD_STEPS[k]
    return mixed(total)
