"""Kernels over the buffers of Arrow strings: a byte a base, many reads at once, in pieces of about a megabyte."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: About the bytes that a kernel works on at once, which bounds its memory.
CHUNK = 1 << 20


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1] if offsets is not None and len(texts) else np.zeros(len(texts) + 1, kind)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at.astype(np.int64)


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte a character: continuation bytes of UTF-8 go."""
    keep = (data & 0xC0) != 0x80
    if keep.all():
        return data, offsets
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def packed(data: list[np.ndarray] | list[bytes], lengths: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """A string array of the rows whose bytes follow each other in ``data``."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    large = offsets[-1] > 2**31 - 1
    valid = pa.array(~null).buffers()[1] if null is not None and null.any() else None
    held = pa.py_buffer(b"".join(data))
    return (pa.LargeStringArray if large else pa.StringArray).from_buffers(len(lengths), pa.py_buffer(offsets if large else offsets.astype(np.int32)), held, valid)


def nulls(*columns: pa.Array) -> np.ndarray:
    """Where any of the columns is null."""
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        if c.null_count:
            out |= c.is_null().to_numpy(zero_copy_only=False)
    return out


def of_chars(texts: pa.Array, one: Callable[[np.ndarray, np.ndarray, slice], np.ndarray]) -> pa.Array:
    """Texts with a byte a character of ``texts``: ``one(bytes, offsets, rows)`` gives those of some rows."""
    data, offsets = flat(texts)
    out, lengths = [], [np.zeros(0, np.int64)]
    for a, b in chunks(offsets):
        x, o = characters(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        out.append(one(x, o, slice(a, b)))
        lengths.append(np.diff(o))
    return packed(out, np.concatenate(lengths), nulls(texts))


def cycle(offsets: np.ndarray, period: int, step: int = 1, first: np.ndarray | int = 0) -> np.ndarray:
    """A number for each place: its (``first`` of the row + place in the row * ``step``) modulo ``period``, or that plus ``period``."""
    n = int(offsets[-1])
    one = (np.arange(period) * step % period).astype(np.uint8)
    return np.resize(one, n) + np.repeat(((first - offsets[:-1] * step) % period).astype(np.uint8), np.diff(offsets))


def rows_of(texts: pa.Array) -> list[bytes | None]:
    """The rows as bytes."""
    data, offsets = flat(texts)
    whole, null = data.tobytes(), nulls(texts)
    return [None if z else whole[a:b] for a, b, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), null.tolist(), strict=True)]


def joined(rows: list[bytes | None]) -> pa.Array:
    """A string array of rows as bytes."""
    return packed([x for x in rows if x], np.fromiter((len(x) if x else 0 for x in rows), np.int64, len(rows)), np.fromiter((x is None for x in rows), bool, len(rows)))


def numbers(column: pa.Array) -> np.ndarray:
    """64-bit integers; nulls are 0."""
    return (column.fill_null(0) if column.null_count else column).to_numpy(zero_copy_only=False).astype(np.int64)


def table(pairs: dict[str, str], other: str | None = None) -> np.ndarray:
    """Bytes to bytes: ``pairs`` of equally long texts, else ``other`` or the byte itself."""
    out = np.arange(256, dtype=np.uint8) if other is None else np.full(256, ord(other), np.uint8)
    for a, b in pairs.items():
        out[np.frombuffer(a.encode(), np.uint8)] = np.frombuffer(b.encode(), np.uint8)
    return out
