"""Words of many texts at once, as flat Arrow and numpy arrays."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = 0x20
LEVEL = 3


def byte_table(blanks: bytes, marks: bytes = b"", mark: bytes = b".") -> bytes:
    """A table for ``bytes.translate``: A-Z become a-z, ``blanks`` a space, ``marks`` the byte ``mark``."""
    table = bytearray(range(256))
    for c in range(0x41, 0x5B):
        table[c] = c + 32
    for c in blanks:
        table[c] = BLANK
    for c in marks:
        table[c] = mark[0]
    return bytes(table)


def flat_words(raw: bytes) -> pa.Array:
    """What stands between spaces, in order."""
    solid = np.frombuffer(raw, np.uint8) != BLANK
    starts = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
    letters = np.frombuffer(raw, np.uint8)[solid]
    offsets = np.empty(len(starts) + 1, np.int32)
    offsets[:-1] = np.cumsum(solid)[starts] - 1
    offsets[-1] = len(letters)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])


def squeezed(*arrays) -> bytes:
    """Arrays as one compressed value."""
    raw = pickle.dumps(arrays, protocol=5)
    return pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True) + len(raw).to_bytes(8, "little")


def opened(packed: bytes) -> tuple:
    raw = pa.decompress(packed[:-8], decompressed_size=int.from_bytes(packed[-8:], "little"), codec="zstd", asbytes=True)
    return pickle.loads(raw)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes; a longer value comes alone."""
    for b in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0)).astype(np.int64)
        at, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += size
        if at < b.num_rows:
            yield b.slice(at)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    if not len(starts):
        return np.empty(0, np.int64)
    return np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())


def places(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of each run in sorted buckets."""
    if len(bucket):
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        yield from zip(bucket[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(bucket)])


def low_planes(keys: np.ndarray, width: int = 5) -> np.ndarray:
    """The low bytes of sorted keys, plane by plane: the high ones compress."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def from_planes(planes: np.ndarray) -> np.ndarray:
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : len(planes)] = planes.T
    return wide.view("<u8").ravel()
