"""Substring dedup by FM-indexes of shards (operator 2).

Shards are made by content: the contexts of repeated anchors (see `repeats`) go to the shard of the anchor's hash, so
equal windows meet in one shard and all work is in proportion to the repeated text, not to shards times documents. Each
shard gets a compressed FM-index (wavelet matrix with packed bits over its word codes). All windows are streamed against
it by vectorised backward search: the interval of a window's matching statistic shrinks word by word and is dropped as
soon as it holds one suffix; what still holds two or more after `span` words repeats, and the smallest text position in
its interval is the first occurrence, since shards are laid out by (doc_id, row key, start).

Senders and shards first fold equal contexts (a later copy of a whole context repeats as a whole). Contexts of hashes
with more than HOT occurrences are dealt by single windows, which spreads a passage that a third of all rows share.

Words are `[^\\x20\\x09-\\x0D]+`, compared by 40-bit codes within the contexts of one anchor (a 64-bit hash). A null or empty text has no
words and nothing is removed; documents shorter than `span` words lose nothing. See `repeats` for equal and null ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import repeats as R
from .exchange import PACKED, bucket_bits, bucket_of, equal_runs, reduce_blobs, rows, written

SPAN = 20
GRAM = 6
HOT = 4096
_HEAD = np.dtype([("h", "<u8"), ("id", "<i8"), ("doc", "<i8"), ("start", "<i4"), ("size", "<i4")])
CODE_BYTES = 5
_MARK = R.MARK
_FLUSH_WORDS = 1 << 21


class FMIndex:
    """FM-index of a sequence of symbols 0..sigma-1; 0 separates texts and never occurs in a pattern.

    Suffixes are sorted by their first `order` symbols, which is enough for patterns of up to `order` symbols.
    """

    def __init__(self, text: np.ndarray, sigma: int, order: int = 32):
        n = len(text)
        self.n, self.sigma, self.order = n, sigma, order
        rank = text.astype(np.int64)
        width, suffixes = 1, np.argsort(rank, kind="stable")
        while width < order:
            second = np.zeros(n, np.int64)
            second[: n - width] = rank[width:] + 1
            key = rank * (n + sigma + 2) + second
            suffixes = np.argsort(key, kind="stable")
            k = key[suffixes]
            fresh = np.empty(n, np.int64)
            fresh[suffixes] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
            rank, width = fresh, width * 2
            if n and rank[suffixes[-1]] == n - 1:
                break
        self.suffixes = suffixes.astype(np.int32)
        count = np.bincount(text, minlength=sigma + 1)
        self.before = np.concatenate([[0], np.cumsum(count)])
        self._levels(text[suffixes - 1])

    def _levels(self, bwt: np.ndarray) -> None:
        self.bits = max(int(self.sigma).bit_length(), 1)
        self.words, self.sums, self.zeros = [], [], []
        n = self.n
        place = np.zeros(self.sigma + 1, np.int64)  # where each symbol's run begins after the last level
        symbols = np.arange(self.sigma + 1)
        for level in range(self.bits - 1, -1, -1):
            bit = ((bwt >> level) & 1).astype(bool)
            packed = np.zeros((n + 63) // 64 * 8 + 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            word = packed.view(np.uint64)
            sums = np.zeros(len(word), np.int32)
            sums[1:] = np.cumsum(np.bitwise_count(word[:-1]), dtype=np.int32)
            self.words.append(word)
            self.sums.append(sums)
            self.zeros.append(int(n - bit.sum()))
            ones = self._ones(len(self.words) - 1, place)
            place = np.where((symbols >> level) & 1, self.zeros[-1] + ones, place - ones)
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        self.shift = self.before[: self.sigma + 1] - place

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.sums[level][block] + np.bitwise_count(self.words[level][block] & mask)

    def back(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One step of backward search for each (symbol, boundary)."""
        start = symbol
        for k in range(self.bits):
            ones = self._ones(k, at)
            bit = (symbol >> (self.bits - 1 - k)) & 1
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return self.shift[start] + at

    def matches(self, symbols: np.ndarray, ends: np.ndarray, span: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the patterns that end (exclusive) at `ends`, up to `span` symbols each.

        Returns (length, lo, hi): the longest suffix of each pattern with at least `least` occurrences, and its interval.
        """
        length, lo, hi = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        live = np.arange(len(ends))
        for step in range(1, span + 1):
            s = symbols[ends[live] - step]
            both = self.back(np.concatenate([s, s]), np.concatenate([lo[live], hi[live]]))
            a, b = both[: len(live)], both[len(live) :]
            ok = (b - a >= least) & (s > 0)
            live, a, b = live[ok], a[ok], b[ok]
            lo[live], hi[live], length[live] = a, b, step
            if not len(live):
                break
        return length, lo, hi

    def first_places(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest text position in each interval; intervals are equal or disjoint."""
        ulo, at, inverse = np.unique(lo, return_index=True, return_inverse=True)
        if not len(ulo):
            return np.zeros(0, np.int64)
        cuts = np.stack([ulo, hi[at]], 1).ravel()
        return np.minimum.reduceat(np.append(self.suffixes, self.n), cuts)[::2][inverse]


def _take(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all [start, start + size), one after the other."""
    total = int(sizes.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total) if len(sizes) else np.zeros(0, np.int64)


def _span_codes(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    p, inverse = K.powers(len(codes) + 1)
    run = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * p[: len(codes)], out=run[1:])
    return K.mix((run[starts + sizes] - run[starts]) * inverse[starts] + sizes.astype(np.uint64))


def _coded(words: np.ndarray) -> bytes:
    """The low CODE_BYTES of each word's code."""
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES].tobytes()


def _decoded(blob) -> np.ndarray:
    part = np.frombuffer(blob, np.uint8).reshape(-1, CODE_BYTES)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :CODE_BYTES] = part
    return out.view("<u8").ravel()


def _fold(heads: np.ndarray, content: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the first contexts of each content, marks of all windows of the later ones)."""
    order = np.lexsort((heads["start"], heads["doc"], heads["id"], content, heads["h"]))
    r, content = heads[order], content[order]
    new = np.ones(len(r), bool)
    new[1:] = (r["h"][1:] != r["h"][:-1]) | (content[1:] != content[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    later = ~new & ((r["doc"] != r["doc"][lead]) | (r["start"] != r["start"][lead]))
    marks = np.empty(int(later.sum()), _MARK)
    marks["doc"], marks["first"], marks["last"] = r["doc"][later], r["start"][later], r["start"][later] + r["size"][later] - span
    return np.sort(order[new]), marks


def _send(hot: np.ndarray, span: int, gram: int, bits: int):
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            heads = np.concatenate([h for h, _ in held])
            sizes = heads["size"].astype(np.int64)
            base = np.repeat(np.cumsum([0] + [len(w) for _, w in held])[:-1], [len(h) for h, _ in held])
            words = np.concatenate([w for _, w in held])
            at = base + np.concatenate([np.concatenate([[0], np.cumsum(h["size"])[:-1]]) for h, _ in held]).astype(np.int64)
            held.clear()
            keep, marks = _fold(heads, _span_codes(words, at, sizes), span)
            heads, at = heads[keep], at[keep]
            bucket = bucket_of(K.mix(heads["h"]), bits)
            order = np.argsort(bucket, kind="stable")
            heads, at, bucket = heads[order], at[order], bucket[order]
            body = words[_take(at, heads["size"].astype(np.int64))]
            ends = np.concatenate([[0], np.cumsum(heads["size"])])
            names, blobs = [], []
            for s, e in equal_runs(bucket):
                names.append(int(bucket[s]))
                blobs.append(np.int32(e - s).tobytes() + heads[s:e].tobytes() + _coded(body[ends[s] : ends[e]]))
            mb = bucket_of(K.mix(marks["doc"].view(np.uint64)), bits)
            order = np.argsort(mb, kind="stable")
            marks, mb = marks[order], mb[order]
            for s, e in equal_runs(mb):
                names.append(int(mb[s]))
                blobs.append(np.int32(-1).tobytes() + marks[s:e].tobytes())
            return rows(names, blobs)

        for b in batches:
            keys, ids, ords = b.column("row").to_numpy(zero_copy_only=False), b.column("doc_id").fill_null(R.NULL_ID).to_numpy(zero_copy_only=False), b.column("ords")
            for row, end, raw, off in K.chunks(b.column("text")):
                codes, first, _, _ = R.word_units(raw, off)
                a = R.anchors(codes, first, span, gram)
                on = R.chosen(a, ords.slice(row, end - row), end - row)
                at, last, h, doc = a.first[on], a.last[on], a.h[on], a.doc[on]
                if len(hot) and len(h):
                    is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                    n = (last - at + 1)[is_hot]
                    one = _take(at[is_hot], n)
                    at, last = np.concatenate([at[~is_hot], one]), np.concatenate([last[~is_hot], one])
                    doc = np.concatenate([doc[~is_hot], np.repeat(doc[is_hot], n)])
                    h = np.concatenate([h[~is_hot], K.window_hash(codes, span)[one]])
                heads = np.empty(len(at), _HEAD)
                heads["h"], heads["id"], heads["doc"], heads["start"], heads["size"] = h, ids[row + doc], keys[row + doc], at - first[doc], last - at + span
                sizes = heads["size"].astype(np.int64)
                held.append((heads, codes[_take(at, sizes)]))
                size += int(sizes.sum())
                if size >= _FLUSH_WORDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _search(span: int, bits: int):
    def run(held):
        heads, words, marks = [], [], []
        for _, blob in held:
            k = int(np.frombuffer(blob[:4], "<i4")[0])
            if k < 0:
                marks.append(np.frombuffer(blob[4:], _MARK))
                continue
            end = 4 + k * _HEAD.itemsize
            heads.append(np.frombuffer(blob[4:end], _HEAD))
            words.append(_decoded(blob[end:]))
        if heads:
            marks += shard_marks(np.concatenate(heads), np.concatenate(words), span)
        if marks:
            yield R.packed_marks(np.concatenate(marks), bits)

    return run


def shard_marks(heads: np.ndarray, words: np.ndarray, span: int) -> list[np.ndarray]:
    """Marks of the windows of a shard's contexts that occur earlier."""
    at = np.concatenate([[0], np.cumsum(heads["size"])[:-1]]).astype(np.int64)
    keep, marks = _fold(heads, _span_codes(words, at, heads["size"].astype(np.int64)), span)
    keep = keep[np.lexsort((heads["start"][keep], heads["doc"][keep], heads["id"][keep]))]
    heads, at = heads[keep], at[keep]
    sizes = heads["size"].astype(np.int64)
    codes, inverse = np.unique(words[_take(at, sizes)], return_inverse=True)
    place = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    text[_take(place, sizes)] = inverse + 1
    index = FMIndex(text, len(codes) + 1)
    windows = sizes - span + 1
    starts = _take(place, windows)
    length, lo, hi = index.matches(text, starts + span, span, least=2)
    full = length == span
    again = np.zeros(len(starts), bool)
    again[full] = index.first_places(lo[full], hi[full]) < starts[full]
    owner = np.repeat(np.arange(len(heads)), windows)[again]
    offset = (starts - np.repeat(place, windows))[again]
    found = np.empty(len(owner), _MARK)
    found["doc"], found["first"] = heads["doc"][owner], heads["start"][owner] + offset
    if len(found):  # neighbouring windows are one mark
        new = np.ones(len(found), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
        cut = np.flatnonzero(new)
        last = found["first"][np.append(cut[1:], len(found)) - 1]
        found = found[cut]
        found["last"] = last
    return [marks, found]


def repeated_windows(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(row, marks) of keyed docs: first and last starts of windows whose words also start earlier."""
    units, bits = R.Units(span, gram, R.word_units), bucket_bits(docs.sparkSession)
    found = written(R.repeated_anchors(docs, units, hot), "anchors")
    top = docs.sparkSession.sparkContext.broadcast(R.hot_hashes(found, hot))
    sent = R.with_repeats(docs, found).mapInArrow(lambda it: _send(top.value, span, gram, bits)(it), PACKED)
    return R.marks_by_doc(reduce_blobs(sent, _search(span, bits), PACKED, limit=8 << 20))


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and kept_text (kept words joined by one space)."""

    def cut(batches):
        for b in batches:
            for row, end, raw, off in K.chunks(b.column("text")):
                starts, ends, first = K.word_spans(raw, off)
                gone = R.marked(b.column("marks").slice(row, end - row), first, span, b.column("copy").to_numpy()[row:end] > 1)
                kept = K.kept_bytes(raw, off, starts, ends, first, ~gone)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(row, end - row), pa.array(np.diff(first)), pa.array(K.per_doc(gone, first)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    own, alone = R.keyed(docs)
    return R.with_marks(own, alone, repeated_windows(own, span, gram, hot)).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
