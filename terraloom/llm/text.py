"""Helpers for text columns inside Arrow batches: buffers, words, and hashes of any span of a batch.

All hashes are 64-bit and depend on content only. A span's hash is a polynomial over random 64-bit values
per byte, so every span of a batch costs two look-ups; equality of spans of any length is decided on sound ones.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text handled by numpy at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 19
#: Bytes of a batch between Spark and a Python worker; one row may be larger.
BATCH_BYTES = 8 << 20
#: White space that parts words: space and the control characters 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_VALUES = tuple(np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (17, 29))
#: The prime field of a second polynomial, and its bases.
_PRIME, _FIELD_BASES = np.uint64((1 << 31) - 1), (1_117_695_901, 798_330_367)
_LIBC = ctypes.CDLL(None)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose batches to Python are no larger than ``BATCH_BYTES``, so that a worker's memory is bounded."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(setting).rstrip("b")) <= BATCH_BYTES:
        conf.set(setting, str(BATCH_BYTES))
    return docs


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``limit`` bytes of text, never fewer than one row."""
    offsets, _ = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and the UTF-8 bytes of a string column; a null has no bytes."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(content, dtype=np.uint8) if content is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all their bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power_tables(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers) < len(_BASES):
        _powers.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    if len(_powers[kind][0]) < n:
        size = max(n, SLICE_BYTES * 2)
        base = _BASES[kind]
        up, down = (np.cumprod(np.full(size, b, dtype=np.uint64)) for b in (base, pow(base, -1, 1 << 64)))
        if size > SLICE_BYTES * 2:
            return up, down
        _powers[kind] = (up, down)
    return _powers[kind]


class SpanHash:
    """Hashes of any span ``[start, end)`` of ``data``."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        up, self._down = _power_tables(kind, len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[kind][data] * up[: len(data)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])


def _field_powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, int(_PRIME)))
        out[done : 2 * done] = out[: min(done, n - done)] * step % _PRIME
        done *= 2
    return out


class SoundSpanHash(SpanHash):
    """Hashes of spans of any length, for deciding equality.

    Polynomials modulo 2^64 agree for some long texts whatever their base (a Thue-Morse word and its complement); a
    second polynomial over a prime field tells those apart.
    """

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, kind: int = 0):
        super().__init__(data, kind)
        size = max(len(data) + 1, SLICE_BYTES + (SLICE_BYTES >> 1))
        up, self._field_down = self._tables.get(kind, (np.zeros(0, np.uint64),) * 2)
        if len(up) < size:
            base = _FIELD_BASES[kind]
            up, self._field_down = (_field_powers(b, size) for b in (base, pow(base, -1, int(_PRIME))))
            if size <= SLICE_BYTES * 2:
                self._tables[kind] = (up, self._field_down)
        self._field = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((_VALUES[kind] % _PRIME)[data] * up[: len(data)] % _PRIME, out=self._field[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        field = (self._field[end] - self._field[start]) % _PRIME * self._field_down[start] % _PRIME
        return mix(super().__call__(start, end) ^ field * np.uint64(_BASES[0]))


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every word; words never run across rows."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags within each row."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def release_memory() -> None:
    """Gives freed memory back to the system: a worker process lives on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def row_wise(column: pa.Array, work: Callable[[pa.Array], list], names: list[str]) -> pa.Array:
    """``work`` over pieces of a text column; its lists of values become the fields of one struct array."""
    parts = []
    for piece in slices(pa.RecordBatch.from_arrays([column], names=["text"])):
        values = [v if isinstance(v, pa.Array) else pa.array(v) for v in work(piece.column(0))]
        parts.append(pa.StructArray.from_arrays(values, names=names))
    if not parts:
        empty = pa.array([], type=column.type)
        return pa.StructArray.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in work(empty)], names=names)
    out = parts[0] if len(parts) == 1 else pa.concat_arrays(parts)
    del parts
    release_memory()
    return out
