"""Word shingles as 64-bit hashes, for near-duplicate work."""

from __future__ import annotations

import numpy as np

WORDS = 5


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants by the splitmix rule."""
    with np.errstate(over="ignore"):
        x = np.uint64(seed) + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, n + 1, dtype=np.uint64)
        z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) | np.uint64(1)


PLACE = constants(WORDS, 11)


def slices(batches, rows: int = 512):
    """Arrow batches cut to few rows, so that few texts at a time become Python strings."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of the whole text.

    A-Z are lower-cased; words lie between ASCII white space. Fewer than five words make one
    shingle; no word makes an empty set."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(w) < WORDS:
        h = (w * PLACE[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w))
    else:
        n = len(w) - WORDS + 1
        h = w[:n] * PLACE[0]
        for k in range(1, WORDS):
            h += w[k : n + k] * PLACE[k]
    return np.unique(mix(h))


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and of the union of sorted distinct sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common, len(both) - common
