"""Hashes of words and of runs of words, for whole batches of texts at once.

Words are maximal runs of bytes other than the ASCII white space 0x20 and
0x09-0x0D of a text's UTF-8 form. A word has 128 bits in two lanes. Up to 15
bytes, it is its own bytes and length after a permutation (Feistel rounds over
a 64-bit mixer), so that different words never collide; longer words have the
128 bits of BLAKE2b. Runs of words are hashed lane by lane from these, so no
substring is ever built.
"""

from __future__ import annotations

import hashlib

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, no other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words of more bytes are hashed one by one; the sixteenth byte holds the length of the others.
SHORT = 15
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ROUNDS = tuple(np.uint64(k) for k in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a permutation in which every input bit reaches every output bit."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(two lanes of a hash per word, first word of each text and one past the last)."""
    data = b" ".join([*texts, bytes(16)])
    inside = ~SPACE[np.frombuffer(data, np.uint8)[: len(data) - 16]]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begins, ends = edge[::2], edge[1::2]
    size = ends - begins
    # the eight bytes from any place on, as numbers
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    low = eight[begins] & _MASK[np.minimum(size, 8)]
    high = eight[begins + 8] & _MASK[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
    for i, k in enumerate(_ROUNDS):
        if i % 2:
            high ^= mix(low ^ k)
        else:
            low ^= mix(high ^ k)
    for i in np.flatnonzero(size > SHORT).tolist():
        digest = hashlib.blake2b(data[begins[i] : ends[i]], digest_size=16).digest()
        low[i], high[i] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    return np.stack((low, high)), np.searchsorted(begins, at)


def lane(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k words that begin at each word, from one lane; the last k - 1 begin none. Texts must be cut apart by the caller."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, seed, np.uint64)
    for i in range(k):
        out = mix(out ^ hashes[i : i + n]) + np.uint64(i)
    return out


def runs(hashes: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the k words that begin at each word: 64 that hold both lanes, and the second lane."""
    second = lane(hashes[1], k, seed)
    return mix(lane(hashes[0], k, seed) ^ mix(second)), second
