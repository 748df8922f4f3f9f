"""Whole texts as byte arrays: words, hashes and packed blobs, inside tasks."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: The word separators: blank, tab, newline, vertical tab, form feed, carriage return.
SPACES = (9, 10, 11, 12, 13, 32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in runs of at most ``limit`` bytes of text (one text may be longer)."""
    for batch in batches:
        sizes = batch.column(column)
        sizes = np.diff(text_bytes(sizes)[1])
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each row begins; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (n + 1)."""
    text = ~_SPACE[data]
    first, last = text.copy(), text.copy()
    first[1:] &= ~text[:-1]
    last[:-1] &= ~text[1:]
    inner = offsets[1:-1]
    begin, end = inner[inner < len(data)], inner[inner > 0] - 1
    first[begin] = text[begin]
    last[end] = text[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every bit of the input moves every bit of the result."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time for all spans at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    h = mix(length.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    at, active = 0, None
    while True:
        if active is None:
            left = length
            block = eight[starts] & _MASKS[np.minimum(left, 8)]
            h = mix(h ^ block)
        else:
            left = length[active] - at
            block = eight[starts[active] + at] & _MASKS[np.minimum(left, 8)]
            h[active] = mix(h[active] ^ block)
        at += 8
        active = np.flatnonzero(length > at) if active is None else active[left > 8]
        if not len(active):
            return h


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes one after another, ``gap`` bytes after each, and where each begins."""
    size = ends - starts + gap
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    if gap and len(data):
        np.minimum(index, len(data) - 1, out=index)
    return data[index] if len(data) else np.zeros(offsets[-1], np.uint8), offsets


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    out, offsets = gather(data, starts, ends)
    return pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())
    ).cast(pa.string())


def joined_words(data, starts, ends, sep: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """All words one after another, each followed by one separator; begin of each word."""
    out, offsets = gather(data, starts, ends, 1)
    out[offsets[1:] - 1] = sep
    return out, offsets


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob; unsigned integers take their narrowest type."""
    raw = [struct.pack("<B", len(arrays))]
    for a in arrays:
        if a.dtype.kind == "u":
            top = int(a.max()) if len(a) else 0
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16
                         else np.uint32 if top < 1 << 32 else np.uint64)
        body = a.tobytes()
        raw += [struct.pack("<2sq", a.dtype.str[1:].encode(), len(body)), body]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count, at, out = raw[0], 1, []
    for _ in range(count):
        kind, size = struct.unpack_from("<2sq", raw, at)
        at += 10
        out.append(np.frombuffer(raw, dtype=kind.decode(), count=size // np.dtype(kind.decode()).itemsize, offset=at))
        at += size
    return out


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def id_array(column: pa.Array) -> np.ndarray:
    """Row ids as integers; a null id is the smallest integer (see ``id_column``)."""
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).min)
