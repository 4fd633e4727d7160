"""Whole texts as one byte buffer: words, lines and polynomial hashes of spans, worked out with numpy inside Arrow batches.

Hashes of spans up to SHORT bytes are polynomials modulo 2^64 with an odd base, so they come from two prefix sums and one inverse power, in chunks, so that a very long text needs
memory for its words only. For longer spans such polynomials are known to meet whatever the base is (Thue-Morse words of 1,024 letters do); these have their bytes hashed one by one.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: space and \t \n \v \f \r.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
WORD = r"[^\x20\x09-\x0D]+"

IN_WORD = np.ones(256, np.uint8)
IN_WORD[list(SPACES)] = 0
#: First bytes of code points that are not white space.
CHAR_IN_WORD = IN_WORD.copy()
CHAR_IN_WORD[0x80:0xC0] = 0

CHUNK = 1 << 16
#: Longest span whose hash is a polynomial.
SHORT = 64
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS = [powers(b, CHUNK + 1) for b in BASES]
INVERSES = [powers(pow(b, -1, 1 << 64), CHUNK + 1) for b in BASES]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads what is in the high bits to all bits; one to one."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Whole rows, cut into batches whose texts have ``most`` bytes together, or one longer text alone."""
    for batch in batches:
        column = batch.column(text)
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        first = 0
        while first < len(ends):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(first, last - first)
            first = last
    give_back()


def per_text(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of small numbers, one for each byte, over each text."""
    out, total = np.zeros(len(at), np.int64), 0
    for a in range(0, len(marks), 1 << 20):
        run = np.cumsum(marks[a : a + (1 << 20)], dtype=np.int64)
        lo, hi = np.searchsorted(at, (a, a + len(run)), "right")
        inside = slice(lo, hi)
        out[inside] = total + run[at[inside] - a - 1]
        total += int(run[-1])
    return np.diff(out)


def runs_of(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of all runs of marked bytes, none of which reaches over two texts, and the number of runs in each text."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[:-1][np.diff(at) > 0]
    first[edge] = inside[edge]
    edge = at[1:][np.diff(at) > 0] - 1
    last[edge] = inside[edge]
    begins = np.flatnonzero(first)
    return begins, np.flatnonzero(last) + 1, np.diff(np.searchsorted(begins, at))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of all words, and the number of words in each text."""
    return runs_of(IN_WORD[data].view(bool), at)


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each span; begins and ends both ascend. Equal bytes have equal hashes, wherever they stand."""
    base, power, inverse = BASES[which], POWERS[which], INVERSES[which]
    out = np.zeros(len(begins), np.uint64)
    shift = np.zeros(len(begins), np.uint64)
    total, scale, unscale = 0, 1, 1
    whole, unwhole = pow(base, CHUNK, 1 << 64), pow(base, -CHUNK, 1 << 64)
    for a in range(0, len(data) + 1, CHUNK):
        part = data[a : a + CHUNK]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        sums *= np.uint64(scale)
        sums += np.uint64(total)
        lo, hi = np.searchsorted(begins, (a, a + CHUNK))
        out[lo:hi] -= sums[begins[lo:hi] - a]
        shift[lo:hi] = inverse[begins[lo:hi] - a] * np.uint64(unscale)
        lo, hi = np.searchsorted(ends, (a, a + CHUNK))
        out[lo:hi] += sums[ends[lo:hi] - a]
        total, scale, unscale = int(sums[-1]), scale * whole % (1 << 64), unscale * unwhole % (1 << 64)
    out *= shift
    content, salt = memoryview(np.ascontiguousarray(data)), bytes([which])
    for k in np.flatnonzero(ends - begins > SHORT).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(content[begins[k] : ends[k]], digest_size=8, salt=salt).digest(), "big")
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; all other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def give_back() -> None:
    """Return memory that is not in use: a worker that waits for its next task should not hold what the last one needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def threads_off() -> None:
    """Each task has one core: libraries that start threads of their own would take those of other tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    pa.set_cpu_count(1)
