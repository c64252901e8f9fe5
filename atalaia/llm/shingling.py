"""Sets of word shingles: their members, names, likeness, and byte signatures by minwise hashing with bands."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash

from .suffix import mixed

#: Words of a shingle.
WIDTH = 5
#: Members that are hashed at a time.
CHUNK = 512


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct XXH64 (seed 42) of a text's shingles, sorted. Words as in ``simhash.fingerprint``; fewer words are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return np.frombuffer(digest(joined, 42), np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.unique(np.frombuffer(b"".join([digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[width:], strict=False)]), np.uint64))


def key_of(members: np.ndarray) -> int:
    """The name of a set, a signed 64-bit number."""
    mark = xxhash.xxh64_intdigest(members.tobytes(), 7)
    return mark - (mark >> 63 << 64)


def alike(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have a Jaccard likeness of ``num / den`` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * den >= num * (len(a) + len(b) - both)


_DRAWN = np.random.default_rng(13)
_FLIP, _TIMES = _DRAWN.integers(0, 2**32, 1024, np.uint32), _DRAWN.integers(0, 2**31, 1024, np.uint32) * np.uint32(2) + np.uint32(1)


def signature(members: np.ndarray, size: int) -> bytes:
    """``size`` bytes, each the low byte of the least of the members' hashes by a function of its own; at most 1024.

    Two sets have the same byte with their likeness as probability, or else with 1 in 256.
    """
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    x = (members ^ (members >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(x), CHUNK):
        h = (x[i : i + CHUNK, None] ^ _FLIP[:size]) * _TIMES[:size]
        h ^= h >> np.uint32(15)
        np.minimum(least, h.min(0), out=least)
    return least.astype(np.uint8).tobytes()


def bands(signatures: list[bytes], rows: int) -> np.ndarray:
    """A number for each band of ``rows`` bytes (7 at most) of each signature, a row a signature; no two different bands share one."""
    x = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1, rows).astype(np.uint64)
    packed = (x << (np.arange(rows, dtype=np.uint64) * np.uint64(8))).sum(2, dtype=np.uint64)
    return mixed(packed | np.arange(x.shape[1], dtype=np.uint64) << np.uint64(56)).view(np.int64)
