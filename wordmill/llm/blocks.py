"""Words and word hashes of many texts at once, on numpy arrays.

Texts are joined into one byte array; prefix sums of a polynomial give the hash of any
slice, so that no Python loop runs over words. Work is cut into pieces of a quarter of a
megabyte, which bounds memory whatever the texts' lengths; only a single longer text makes
a longer piece.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np

#: Bytes of text of a quarter of a batch, and of what is worked on at once.
PIECE, CUT = 1 << 20, 1 << 18
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_P = np.uint64(FIRST)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

# what str.lower does to A-Z, and the bytes that end a word
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def trim() -> None:
    """Gives back memory that a worker process has freed but keeps, so that workers that wait hold little."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim_heap = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim_heap is not None:
        trim_heap(0)


def small(batches: Iterator, size: int = 4 * PIECE) -> Iterator:
    """The same rows in batches of about ``size`` bytes of ``text``, where there is such a column; a longer text is a batch of its own."""
    for batch in batches:
        if "text" not in batch.schema.names or batch.num_rows < 2:
            yield batch
            continue
        lengths = _lengths(batch.column("text"))
        begins = np.cumsum(lengths) - lengths
        home = begins // size
        cuts = np.flatnonzero(np.diff(home)) + 1
        for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(first, end - first)


def _lengths(column) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def trimmed(task):
    """A task over batches that trims its worker's memory when it ends."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            trim()

    return run


def frugal(task):
    """``trimmed``, and the task gets its texts in small batches, so that what it makes of a batch is small, too."""

    @functools.wraps(task)
    def run(batches):
        yield from task(small(batches))

    return trimmed(run)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base, and of its inverse, modulo 2**64."""
    if base in _powers and len(_powers[base][0]) > n:
        return _powers[base]
    m = max(1 << 18, 1 << max(n, 1).bit_length()) + 1
    both = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, x, np.uint64)])) for x in (base, pow(base, -1, 1 << 64)))
    if m <= 2 * CUT + 1:  # longer ones, for a single very long text, aren't kept
        _powers[base] = both
    return both


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = FIRST) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]; equal slices have equal hashes wherever they stand."""
    up, down = _power(len(data), base)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def pieces(texts: list, size: int = CUT) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts (bytes or None) of about ``size`` bytes."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > size:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and where each text's words begin (one entry more than texts).

    A word is a run of bytes other than ASCII white space; A-Z count as a-z.
    """
    joined = (b"\n".join(t or b"" for t in texts) + b"\n").translate(LOWER)
    data = np.frombuffer(joined, np.uint8)
    space = SPACE[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(ends) < len(starts):
        ends = np.append(ends, len(data))
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    return slice_hashes(data, starts, ends), np.searchsorted(starts, begins)


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its k-word runs; of its whole sequence if it has fewer words."""
    for first, end in pieces(texts):
        hashes, begins = words(texts[first:end])
        runs = np.full(max(len(hashes) - k + 1, 0), np.uint64(k))
        for i in range(k):
            runs = mix(runs * _P + hashes[i : len(runs) + i])
        for b, e in zip(begins[:-1].tolist(), begins[1:].tolist()):
            if e - b >= k:
                yield np.unique(runs[b : e - k + 1])
            elif e > b:
                h = np.full(1, np.uint64(e - b))
                for i in range(b, e):
                    h = mix(h * _P + hashes[i : i + 1])
                yield h
            else:
                yield hashes[:0]


def encoded(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist() if pa.types.is_large_string(column.type) else column.cast(pa.binary()).to_pylist()
