"""Identities of words, and Rabin-Karp hashes over bytes and words, vectorised: prefix sums of a polynomial modulo 2^64, shifted back by the base's inverse.

A polynomial modulo 2^64 alone has strings that collide whatever its base (Thue-Morse words of 1024 letters), so bytes are only hashed so over pieces of less
than 512, to deal rows out. What counts as equal is decided by 128 bits over words that are told apart exactly or by a strong hash.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers modulo 2^64 (so that each has an inverse) for words, windows of words and windows of bytes.
BASE_WORD, BASE_WINDOW, BASE_WINDOW_2, BASE_BYTE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9
M64 = (1 << 64) - 1
#: 64-bit values that stand for the 256 bytes.
BYTE_VALUES = np.random.Generator(np.random.PCG64(20_240_611)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept and grown per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base & M64, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """n + 1 prefix sums of values[i] * base^i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[start:end], independent of where they start."""
    inverse = pow(base, -1, 1 << 64)
    return (sums[ends] - sums[starts]) * powers(inverse, len(sums))[starts]


def windows(sums: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hashes of every window of `size` values, as spans() gives them."""
    n = len(sums) - size
    return (sums[size:] - sums[:n]) * powers(pow(base, -1, 1 << 64), n) if n > 0 else np.zeros(0, np.uint64)


def words_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


#: Bytes of a word that its identity holds as they are; longer words are hashed.
SHORT = 15
#: Masks that leave the first k bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two rows of 64 bits for each word. A word of up to SHORT bytes is its bytes and its length, permuted by rounds that can be undone, so no two such words
    are equal; a longer one is its 128 bits of xxh3."""
    n = len(starts)
    if not n:
        return np.zeros((2, 0), np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    pair = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 16)[starts]).view("<u8")
    size = ends - starts
    low = pair[:, 0] & _FIRST[np.minimum(size, 8)]
    high = pair[:, 1] & _FIRST[np.clip(size - 8, 0, 7)] | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    for key in (0x243F6A8885A308D3, 0x13198A2E03707344):
        high = high ^ mix(low + np.uint64(key))
        low = low ^ mix(high + np.uint64(key))
    out = np.stack([low, high])
    for k in np.flatnonzero(size > SHORT).tolist():
        found = xxhash.xxh3_128_intdigest(data[starts[k] : ends[k]])
        out[0, k], out[1, k] = found & M64, found >> 64
    return out


def word_sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the two rows of word_identities(), each to a base of its own."""
    return prefix(words[0], BASE_WINDOW), prefix(words[1], BASE_WINDOW_2)


def word_windows(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two Rabin-Karp hashes of every window of `size` words, over independent halves of the words' identities: 128 bits in all."""
    one, two = word_sums(words)
    return mix(windows(one, size, BASE_WINDOW)), mix(windows(two, size, BASE_WINDOW_2))


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each window of `size` values, from prefix and suffix minima within blocks of that size."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    pad = -len(values) % size
    top = np.iinfo(values.dtype).max
    blocks = np.concatenate([values, np.full(pad, top, values.dtype)]).reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[size - 1 : size - 1 + n])


def merge_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals that cover the given ones; intervals that touch merge."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[first], ends[np.concatenate([first[1:] - 1, [len(ends) - 1]])]
