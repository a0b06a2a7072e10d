"""Word and shingle hashes of many texts at once, in numpy; used inside Arrow functions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20250101)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=U) | U(1)
BASE = U(0x9E3779B97F4A7C17)
BASE_INV = U(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def give_back() -> None:
    """Returns what this process has freed to the system; called between Arrow batches."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i, mod 2**64, for i < n at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        for k, b in (("up", BASE), ("down", BASE_INV)):
            a = np.full(max(n, 1 << 20), b, U)
            a[0] = U(1)
            _powers[k] = np.cumprod(a, dtype=U)
    return _powers["up"], _powers["down"]


def chunks(texts: Iterable[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about limit bytes; a longer text is a run of its own."""
    run, n = [], 0
    for t in texts:
        if run and n + len(t) > limit:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t) + 1
    if run:
        yield run


def word_bounds(texts: list[bytes], space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes (texts joined by a space), starts and ends of words, and where each text's words begin."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = space[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return buf, starts, ends, np.searchsorted(starts, at)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    up, down = powers(len(buf))
    total = np.zeros(len(buf) + 1, U)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles, A-Z lowered; shorter texts are one shingle."""
    buf, starts, ends, first = word_bounds(texts)
    h = span_hashes(LOWER[buf], starts, ends)
    grams = np.zeros(max(len(h) - n + 1, 0), U)
    for j in range(n):
        grams += h[j : j + len(grams)] * U(pow(0xD6E8FEB86659FD93, j, 2**64))
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            one = np.array([b - a], U)
            for x in h[a:b]:
                one = mix(one * U(0xA0761D6478BD642F) + x)
            out.append(one)
        else:
            out.append(np.zeros(0, U))
    return out
