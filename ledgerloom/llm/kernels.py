"""Vectorised text kernels over Arrow string buffers (UTF-8 bytes, many documents at once).

A *chunk* is a run of consecutive rows of one Arrow batch whose bytes lie side by side. All kernels work on
whole chunks with numpy, never row by row, and never look at a prefix only. Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 16)
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[key] = np.multiply.accumulate(run)
    return _powers["p"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """Yields (first row, end row, bytes, offsets from 0) of runs of rows of about `limit` bytes; one row at least."""
    raw, offsets = texts(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags within each [offsets[i], offsets[i+1])."""
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a document: (starts, ends, first run of each document, with the end)."""
    if len(inside) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = offsets[(offsets > 0) & (offsets < len(inside))]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of a chunk."""
    return spans(~_SPACE[raw], offsets)


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash takes the hash of any span."""
    p, _ = powers(len(raw) + 1)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)], out=run[1:])
    return run


def span_hash(run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: equal bytes, equal hash, wherever they stand."""
    _, inverse = powers(len(run))
    h = (run[ends] - run[starts]) * inverse[starts]
    return mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hash(symbols: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` consecutive symbols (uint64), document ends not regarded; len - width + 1 of them."""
    n = len(symbols)
    if n < width:
        return np.zeros(0, np.uint64)
    p, inverse = powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * p[:n], out=run[1:])
    return mix((run[width:] - run[: n - width + 1]) * inverse[: n - width + 1] + np.uint64(width))


def doc_of(first: np.ndarray) -> np.ndarray:
    """Document number of each item, from the first item of each document."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def inside_docs(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the n - width + 1 windows lie in one document."""
    total = max(n - width + 1, 0)
    ok = np.ones(total, bool)
    if total:
        for back in range(1, width):
            at = first[1:-1] - back
            ok[at[(at >= 0) & (at < total)]] = False
    return ok


def cover(starts: np.ndarray, lengths, n: int) -> np.ndarray:
    """True where any [start, start + length) lies."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, starts, 1) if len(starts) < 64 else depth.__iadd__(np.bincount(starts, minlength=n + 1).astype(np.int32))
    ends = starts + lengths
    depth -= np.bincount(ends, minlength=n + 1).astype(np.int32)
    return np.cumsum(depth[:n]) > 0


def kept_bytes(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """Per document, the kept words joined by one space."""
    out = []
    data = raw.tobytes()
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        k = keep[a:b]
        if k.all():
            out.append(b" ".join(data[offsets[i] : offsets[i + 1]].split()))
        else:
            out.append(b" ".join([data[s:e] for s, e in zip(starts[a:b][k].tolist(), ends[a:b][k].tolist(), strict=True)]))
    return out
