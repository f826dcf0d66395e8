"""Vectorised views of text columns inside Arrow batches: bytes, words, shingles."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about so many bytes, so that memory doesn't follow the batch size.
SLICE_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SAME = np.arange(256, dtype=np.uint8)
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base modulo 2**64."""
    global _powers
    while len(_powers) < n:
        step = np.uint64(pow(_BASE, len(_powers), 1 << 64))
        _powers = np.concatenate([_powers, _powers * step])
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, rows + 1, from 0) and bytes of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0] if len(at) else np.zeros(1, np.int64), body[at[0] : at[-1]] if len(at) else body


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice have about `most` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = flat(batch.column(column))[0][1:]
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
    _give_back()


def _give_back() -> None:
    """Return freed memory to the system: workers are used again, and stay as large as their largest task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def words(data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of the bytes; lower: A-Z count as a-z.

    Long inputs are hashed piece by piece, cut at white space, so temporary arrays stay small.
    """
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    hashes = np.empty(len(starts), np.uint64)
    table = _LOWER if lower else _SAME
    begin = 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(ends, starts[begin] + SLICE_BYTES, side="right")))
        s, e = starts[begin:end], ends[begin:end]
        lengths = e - s
        total = int(lengths.sum())
        before = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        within = np.arange(total, dtype=np.int64) - np.repeat(before, lengths)
        codes = _BYTE_CODE[table[data[np.repeat(s, lengths) + within]]]
        sums = np.add.reduceat(codes * powers(int(lengths.max()))[within], before)
        hashes[begin:end] = mix(sums + lengths.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        begin = end
    return starts, ends, hashes


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of all k neighbours; len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x2545F4914F6CDD1D) + hashes[i : i + n]
        out = out ^ (out >> np.uint64(31))
    return mix(out)


def per_row(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where each row's words begin in `starts`, with one more entry for the end."""
    return np.searchsorted(starts, at)


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte (length n + 1)."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def row_words(at: np.ndarray, data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes (rows end with a space), and starts, ends, hashes and row of each word; no word crosses rows."""
    rows = len(at) - 1
    joined = np.full(len(data) + rows, 0x20, np.uint8)
    joined[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(at))] = data
    starts, ends, hashes = words(joined, lower)
    return joined, starts, ends, hashes, np.searchsorted(at[1:] + np.arange(1, rows + 1), starts, side="right")


def shingle_sets(at: np.ndarray, data: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row, words lower-cased; with fewer words, the whole sequence is one."""
    *_, hashes, owner = row_words(at, data, True)
    first = np.searchsorted(owner, np.arange(len(at)))
    windows = rolled(hashes, width)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(windows[lo : hi - width + 1]))
        else:
            out.append(mix(rolled(hashes[lo:hi], hi - lo) + np.uint64(hi - lo)) if hi > lo else np.zeros(0, np.uint64))
    return out


def set_digest(hashes: np.ndarray) -> int:
    """A 64-bit digest of a sorted set, as a signed integer."""
    if not len(hashes):
        return 0
    places = mix(np.arange(1, len(hashes) + 1, dtype=np.uint64))
    return int(mix(np.asarray([np.add.reduce(mix(hashes ^ places)) + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])
