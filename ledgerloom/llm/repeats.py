"""What the two substring operators share: anchors, their repeats, and what is cut in the end.

A *window* is `span` consecutive units (words or bytes) of one document. Its anchor is the leftmost smallest k-gram in
it, so equal windows have equal anchors at equal offsets, and a window can only repeat if its anchor does. Anchors are
one in about span / 2 units.

1. `repeated_anchors`: every anchor's hash goes to a bucket. A sender keeps one record for each hash and flush and
   answers for the others itself, so a hash that a third of all rows hold is a few records a flush. The result names,
   for each document, its anchors that occur elsewhere too, and the hashes with many occurrences.
2. The operator sends the contexts of those anchors to shards by the anchor's hash and finds repeated windows there. A
   hash of more than `hot` occurrences is dealt by whole windows instead. `hot` grows with the input so that at most
   MAX_HOT hashes (8 MB) are broadcast.
3. `with_marks` brings the found windows back to their documents. Both joins read the texts by row key in the same
   columns, in one job, so Spark shuffles the texts once and uses that exchange twice.

Every row is a document of its own, under a `row` key (see `keyed`); doc_id only orders rows (a null one before all
others) and is put out. Equal rows (doc_id and text) share a key, as they share anchors and marks; `with_marks` numbers
them, and every copy is a repeat of the one before it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .exchange import PACKED, bucket_bits, bucket_of, pack, reduce_packed

MAX_HOT = 1_000_000
NULL_ID = -(1 << 63)
_REF = np.dtype([("h", "<u8"), ("doc", "<i8"), ("ord", "<i4"), ("n", "<i4")])
MARK = np.dtype([("doc", "<i8"), ("first", "<i4"), ("last", "<i4")])
_FLUSH = 1 << 20


@dataclass(frozen=True)
class Units:
    """How texts are cut into units: units(raw, offsets) -> (hash of each unit, first unit of each document, starts, ends)."""

    span: int
    gram: int
    cut: Callable


def word_units(raw, offsets):
    starts, ends, first = K.word_spans(raw, offsets)
    return K.span_hash(K.prefix_hash(raw), starts, ends), first, starts, ends


_BYTE_CODES = K.mix(np.arange(256, dtype=np.uint64) + np.uint64(0x1F3))


def byte_units(raw, offsets):
    return _BYTE_CODES[raw], offsets, None, None


def _sliding(f, values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while span * 2 <= width:
        out = f(out[:-span], out[span:])
        span *= 2
    return f(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


@dataclass
class Anchors:
    """Anchors of a chunk in the order of windows: position, hash, first and last window start, document, number in it."""

    at: np.ndarray
    h: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    ord: np.ndarray


def anchors(codes: np.ndarray, first: np.ndarray, span: int, gram: int) -> Anchors:
    n, width = len(codes), span - gram + 1
    none = np.zeros(0, np.int64)
    if n < span:
        return Anchors(none, none.astype(np.uint64), none, none, none, none)
    full = K.window_hash(codes, gram)
    g = (full >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    total = n - span + 1
    low = _sliding(np.minimum, g, width)[:total]
    # windows that leave their document
    depth = np.zeros(total + 1, np.int32)
    a, b = np.maximum(first[1:] - span + 1, first[:-1]), first[1:]
    a, b = np.minimum(a, total), np.minimum(b, total)
    np.add.at(depth, a, 1)
    np.add.at(depth, b, -1)
    valid = np.cumsum(depth[:total]) == 0
    low = np.where(valid, low, np.uint32(0))
    # positions that are smallest in some window
    wide = np.zeros(total + 2 * (width - 1), np.uint32)
    wide[width - 1 : width - 1 + total] = low
    most = _sliding(np.maximum, wide, width)
    m = min(len(most), len(g))
    is_small = most[:m] == g[:m]
    small = np.flatnonzero(is_small)
    before = np.zeros(total, np.int64)
    np.cumsum(is_small[: total - 1], out=before[1:])
    change = np.ones(total, bool)
    change[1:] = (low[1:] != low[:-1]) | is_small[: total - 1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], total)
    keep = valid[starts]
    starts, ends = starts[keep], ends[keep]
    j, want = before[starts].copy(), low[starts]
    todo = np.arange(len(starts))
    while len(todo):
        todo = todo[g[small[j[todo]]] != want[todo]]
        j[todo] += 1
    at = small[j]
    # neighbouring runs of one anchor are one
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != ends[:-1])
    at, s = at[new], starts[new]
    e = ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)] if len(at) else ends
    doc = np.searchsorted(first, s, "right") - 1
    of = np.searchsorted(doc, np.arange(len(first)))
    return Anchors(at, full[at], s, e - 1, doc, np.arange(len(at)) - of[doc])


def by_doc(doc: np.ndarray, *columns: np.ndarray):
    """Rows (doc, blob) with the columns of each document side by side, as int32."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    body = np.stack([c[order].astype("<i4") for c in columns], 1) if len(doc) else np.zeros((0, len(columns)), "<i4")
    at = np.append(cut, len(doc)).astype(np.int64) * 4 * len(columns)
    blob = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
    return pa.array(doc[cut]), blob


def row_key(alone: bool) -> Column:
    """A key of every row: its id, or where ids are shared a hash of doc_id and text, a function of the row alone."""
    row = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    return row if alone else F.xxhash64(row, F.col("doc_id").isNull(), F.col("text").isNull(), "text")


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(row, doc_id, text) of every row, and whether all rows differ in doc_id; no copy of the table is written and every scan gives the same keys."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    alone = own.groupBy(row_key(True).alias("id")).count().where("count > 1").isEmpty()
    return own.select(row_key(alone).alias("row"), "doc_id", "text"), alone


def repeated_anchors(docs: DataFrame, units: Units, hot_from: int) -> DataFrame:
    """(row, ords): numbers of the row's anchors that occur elsewhere; (null, null, h, n): hashes of n > hot_from occurrences."""
    bits = bucket_bits(docs.sparkSession)

    def send(batches):
        held: list[np.ndarray] = []

        def flush():
            rec = np.concatenate(held)
            held.clear()
            rec = rec[np.argsort(rec["h"], kind="stable")]
            new = np.ones(len(rec), bool)
            new[1:] = rec["h"][1:] != rec["h"][:-1]
            cut = np.flatnonzero(new)
            count = np.diff(np.append(cut, len(rec)))
            heads, rest = rec[cut], rec[~new]
            heads["n"], rest["n"] = count, 0
            again = heads[count > 1]  # known here to repeat
            again["n"] = 0
            rest = np.concatenate([rest, again])
            both = np.concatenate([heads, rest])
            return pack(both, bucket_of(np.concatenate([heads["h"], K.mix(rest["doc"].view(np.uint64))]), bits))

        for b in batches:
            ids = b.column("row").to_numpy(zero_copy_only=False)
            for row, _, raw, off in K.chunks(b.column("text")):
                codes, first, _, _ = units.cut(raw, off)
                a = anchors(codes, first, units.span, units.gram)
                rec = np.empty(len(a.at), _REF)
                rec["h"], rec["doc"], rec["ord"], rec["n"] = a.h, ids[row + a.doc], a.ord, 1
                held.append(rec)
                if sum(map(len, held)) >= _FLUSH:
                    yield flush()
        if held:
            yield flush()

    def join(rec):
        known, rec = rec[rec["n"] == 0], rec[rec["n"] > 0]
        rec = rec[np.argsort(rec["h"], kind="stable")]
        new = np.ones(len(rec), bool)
        new[1:] = rec["h"][1:] != rec["h"][:-1]
        cut = np.flatnonzero(new)
        total = np.add.reduceat(rec["n"].astype(np.int64), cut) if len(cut) else np.zeros(0, np.int64)
        size = np.diff(np.append(cut, len(rec)))
        found = np.concatenate([known, rec[np.repeat(size > 1, size)]])
        found["n"] = 0
        big = rec[cut][total > hot_from]
        big["n"] = np.minimum(total[total > hot_from], np.iinfo(np.int32).max)
        both = np.concatenate([found, big])
        yield pack(both, bucket_of(K.mix(both["doc"].view(np.uint64)), bits))

    def gather(rec):
        big, rec = rec[rec["n"] > 0], rec[rec["n"] == 0]
        doc, blob = by_doc(rec["doc"], rec["ord"])
        yield pa.RecordBatch.from_arrays([doc, blob, pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.int64())], ["row", "ords", "h", "n"])
        k = len(big)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(big["h"].view(np.int64)), pa.array(big["n"].astype(np.int64))], ["row", "ords", "h", "n"])

    repeats = reduce_packed(docs.select("row", "text").mapInArrow(send, PACKED), _REF, join, PACKED)
    return reduce_packed(repeats, _REF, gather, "row long, ords binary, h long, n long")


def packed_marks(marks: np.ndarray, bits: int) -> pa.RecordBatch:
    return pack(marks, bucket_of(K.mix(marks["doc"].view(np.uint64)), bits))


def marks_by_doc(packed: DataFrame, dtype: np.dtype = MARK) -> DataFrame:
    """One row for each row key with marks; the fields after the key stand side by side as int32."""

    def gather(rec):
        doc, blob = by_doc(rec["doc"], *(rec[c] for c in dtype.names[1:]))
        yield pa.RecordBatch.from_arrays([doc, blob], ["row", "marks"])

    return reduce_packed(packed, dtype, gather, "row long, marks binary")


def hot_hashes(found: DataFrame, hot_from: int) -> np.ndarray:
    """Sorted hashes of the most frequent anchors: above a count that leaves at most MAX_HOT of them."""
    big = found.where("h is not null")
    total = big.agg(F.sum("n")).first()[0] or 0
    least = max(hot_from, total // MAX_HOT)
    rows = big.where(F.col("n") > least).select("h").collect()  # at most MAX_HOT
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def with_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Texts of the documents that have repeated anchors, with the list of their numbers."""
    return docs.select("row", "doc_id", "text").join(found.where("row is not null").select("row", "ords").hint("merge"), "row")


def chosen(a: Anchors, ords: pa.Array, n_docs: int) -> np.ndarray:
    """Which anchors of a chunk the lists in ords name."""
    of = np.searchsorted(a.doc, np.arange(n_docs + 1))
    on = np.zeros(len(a.at), bool)
    for d, blob in enumerate(ords):
        on[of[d] + np.frombuffer(blob.as_buffer(), "<i4")] = True
    return on


def with_marks(docs: DataFrame, alone: bool, marks: DataFrame) -> DataFrame:
    """Every row of docs with its marks (a blob of (first, last) window starts), its number among equal rows and their count."""
    own, same = docs.select("row", "doc_id", "text"), Window.partitionBy("row")
    if not alone:
        own = own.withColumns({"copy": F.row_number().over(same.orderBy("row")), "copies": F.count("*").over(same)})
    out = own.join(marks.hint("merge"), "row", "left")
    if alone:
        out = out.withColumns({"copy": F.lit(1), "copies": F.lit(1).cast("long")})
    return out.select("doc_id", "text", "marks", "copy", "copies")


def marked(marks: pa.Array, first: np.ndarray, span: int, whole: np.ndarray, kind: int | None = None) -> np.ndarray:
    """Units that a marked window of `span` units covers; of documents marked as a whole, every unit that is in a window.

    With a kind, marks are (first, last, kind) and only those of that kind count.
    """
    n = int(first[-1]) if len(first) else 0
    starts, sizes = [], []
    for d, blob in enumerate(marks):
        if blob.is_valid:
            m = np.frombuffer(blob.as_buffer(), "<i4").reshape(-1, 2 if kind is None else 3).astype(np.int64)
            if kind is not None:
                m = m[m[:, 2] == kind]
            starts.append(m[:, 0] + first[d])
            sizes.append(m[:, 1] - m[:, 0] + span)
    size = np.diff(first)
    gone = np.repeat(whole & (size >= span), size)
    return gone | K.cover(np.concatenate(starts), np.concatenate(sizes), n) if starts else gone
