"""Hashed character n-grams of many words at once."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words end to end, each word's length, and which code points are letters."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array(list(map(len, words)), np.int64)
    kinds, where = np.unique(flat, return_inverse=True)
    letters = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)
    return flat, lengths, letters[where] if len(flat) else np.zeros(0, bool)


#: Words hashed at once; bounds memory.
AT_ONCE = 50_000


def gram_buckets(words: list[str], orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of each n-gram of the lower-cased words, with a mark at both ends.

    Characters that are no letters count as marks, so that "dog" and "dog," share
    most n-grams.
    """
    if len(words) > AT_ONCE:
        parts = [gram_buckets(words[k : k + AT_ONCE], orders, buckets) for k in range(0, len(words), AT_ONCE)]
        owners = [owner + np.int32(k * AT_ONCE) for k, (_, owner) in enumerate(parts)]
        return np.concatenate([bucket for bucket, _ in parts]), np.concatenate(owners)
    lower = [w.lower() for w in words]
    flat, lengths, letters = codes(lower)
    n = int(lengths.sum() + 2 * len(words))
    owner = np.repeat(np.arange(len(words)), lengths + 2)
    text = np.zeros(n, np.uint64)
    inner = np.ones(n, bool)
    ends = np.cumsum(lengths + 2)
    inner[ends - 1] = inner[ends - lengths - 2] = False
    text[inner] = np.where(letters, flat, 0).astype(np.uint64) + np.uint64(1)
    found, owners = [], []
    for order in orders:
        if n < order:
            continue
        h = np.full(n - order + 1, order, np.uint64)
        for k in range(order):
            h = h * _ODD + text[k : n - order + 1 + k]
        h = (h ^ (h >> np.uint64(29))) * _MIX
        h = (h ^ (h >> np.uint64(32))) % np.uint64(buckets)
        same = owner[: n - order + 1] == owner[order - 1 :]
        found.append(h[same].astype(np.int32))
        owners.append(owner[: n - order + 1][same].astype(np.int32))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(found), np.concatenate(owners)
