"""Whole texts as byte arrays: words, hashes and slices, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

GOLD = np.uint64(0x9E3779B97F4A7C15)
_P, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = _powers[base] = np.multiply.accumulate(got)
    return got[:n]


def slices(batch, column: str = "text", limit: int = 2 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, UTF-8 texts) of at most `limit` bytes, or of one row; null is empty.

    One text is never cut, so that a slice takes as much memory as the longest text may need.
    """
    import pyarrow as pa

    texts = batch.column(column).cast(pa.large_binary()).to_pylist()
    first, size = 0, 0
    for i, t in enumerate(texts):
        texts[i] = t = t or b""
        if size and size + len(t) > limit:
            yield first, i, texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts), texts[first:]


def buffer_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with one space after each text, and where each text begins."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8), np.cumsum(sizes) - sizes


def words_of(buf: np.ndarray, gaps: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words; `gaps` tells which bytes part them. The last byte must be a gap."""
    gap = gaps[buf]
    turn = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        turn = np.concatenate(([0], turn))
    return turn[0::2], turn[1::2]


def word_hashes(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[buf] * powers(_P, n), out=sums[1:])
    return mix((sums[ends] - sums[begins]) * powers(_INVERSE, n)[begins])


def per_text(starts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where each text's words begin in the list of words, and at last the number of words."""
    return np.append(np.searchsorted(begins, starts), len(begins))


def tidy(function):
    """`function` over batches, giving free memory back to the system at its end.

    Spark keeps a task's Python for later tasks, and one task may use several; the allocators would
    else hold on to what the largest batch took.
    """

    def run(batches):
        try:
            yield from function(batches)
        finally:
            _powers.clear()
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return run


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
