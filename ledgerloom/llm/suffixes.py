"""Suffix-array dedup by distributed, common-prefix-aware merge sort (operator 3).

A text is a string of UTF-8 bytes; every byte covered by a `span`-byte string that also starts elsewhere is cut. Bytes
covered by shorter strings, of `report` bytes, that also start elsewhere are counted (n_repeated) and kept: a passage of
more than 50 words is often shorter than `span`. It is seldom shorter than the letters alone of 51 words of the usual
mean length in English (4.7), which `report` is. Only suffixes at repeated anchors (see `repeats`) of `report`-byte windows are
sorted: a repeated string of either length holds such an anchor at the same offset.

Senders fold equal contexts, sort the suffixes that start at anchors and send each bucket one front-coded run (shared
prefix with the previous suffix, then the rest). A bucket merges its runs with a loser tree whose players carry their
common prefix with the last output: two suffixes are compared only beyond what both are known to share, and a run's next
suffix knows its prefix from the coding. The merge yields the suffix array of the bucket with its LCP array; the texts to
the left of the anchors are sorted from right to left in the same manner. A window that starts `o` bytes before its anchor
repeats exactly if another suffix is in the same LCP >= span - o group to the right and in the same LCP >= o group to the
left, so one pass over offsets decides all windows of a length without comparing pairs.

Hashes with more than HOT occurrences are dealt by 128-bit fingerprints of whole windows, folded by the senders, so one
passage in a third of all rows is spread over all tasks. Null and empty texts have no bytes; equal texts are
repeats of each other, under whatever ids (see `repeats`).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import repeats as R
from .exchange import PACKED, bucket_bits, bucket_of, equal_runs, pack, reduce_blobs, reduce_packed, rows, written

SPAN = 400
PASSAGE_WORDS, LETTERS_A_WORD = 51, 4.7
REPORT = round(PASSAGE_WORDS * LETTERS_A_WORD)  # 240
GRAM = 32
HOT = 1 << 16
_ENTRY = np.dtype([("lcp", "<u2"), ("rest", "<u2"), ("left", "<u2"), ("many", "<u2"), ("low", "<u4"), ("doc", "<i8"), ("first", "<i4")])
_MARK = np.dtype([("doc", "<i8"), ("first", "<i4"), ("last", "<i4"), ("span", "<i4")])
_PRINT = np.dtype([("w", "<u8"), ("v", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i4"), ("span", "<i4")])
_FLUSH_BYTES = 24 << 20


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, which are known to share `at` bytes."""
    end = min(len(a), len(b))
    step = 32
    while at < end and a[at : at + step] == b[at : at + step]:
        at += step
    if at >= end:
        return end
    stop = min(at + step, end)
    while at < stop and a[at] == b[at]:
        at += 1
    return at


def merged(runs: list):
    """Merges sorted runs of (known prefix with the previous one, string, payload) into one sorted stream of the same form.

    A loser tree: each player holds its next string and its common prefix with the last winner it met.
    """
    iters = [iter(r) for r in runs]
    heads = [next(i, None) for i in iters]
    k = len(runs)
    if k == 0:
        return
    lcp = [0] * k

    def beats(x: int, y: int) -> bool:
        """Whether x's string comes first; the loser's common prefix is brought up to date."""
        a, b = heads[x], heads[y]
        if a is None or b is None:
            return b is None
        if lcp[x] != lcp[y]:
            return lcp[x] > lcp[y]
        n = common(a[1], b[1], lcp[x])
        first = a[1][n:] <= b[1][n:] if n == len(a[1]) or n == len(b[1]) else a[1][n] < b[1][n]
        lcp[y if first else x] = n
        return first

    losers = [-1] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        x, y = play(2 * node), play(2 * node + 1)
        if beats(x, y):
            losers[node] = y
            return x
        losers[node] = x
        return y

    winner = play(1) if k > 1 else 0
    while heads[winner] is not None:
        yield lcp[winner], heads[winner][1], heads[winner][2]
        heads[winner] = nxt = next(iters[winner], None)
        lcp[winner] = nxt[0] if nxt is not None else 0
        node = (winner + k) >> 1
        while node:
            other = losers[node]
            if beats(other, winner):
                losers[node], winner = winner, other
            node >>= 1


def front_coded(entries: list) -> bytes:
    """A sorted run of (string, left text, doc, first, low, many) as one blob."""
    head = np.empty(len(entries), _ENTRY)
    body, before, cols = [], b"", []
    for key, left, doc, first, low, many in entries:
        n = common(before, key)
        cols.append((n, len(key) - n, len(left), many, low, doc, first))
        body.append(key[n:])
        body.append(left)
        before = key
    head[:] = cols
    return np.int32(len(entries)).tobytes() + head.tobytes() + b"".join(body)


def decoded(blob) -> list:
    """The run of a blob, for `merged`: the payload is (left text, doc, first, low, many)."""
    n = int(np.frombuffer(blob[:4], "<i4")[0])
    end = 4 + n * _ENTRY.itemsize
    data, at, before, out = bytes(blob[end:]), 0, b"", []
    for lcp, rest, left, many, low, doc, first in np.frombuffer(blob[4:end], _ENTRY).tolist():
        before = before[:lcp] + data[at : at + rest]
        at += rest
        out.append((lcp, before, (data[at : at + left], doc, first, low, many)))
        at += left
    return out


def _whole_marks(doc: int, first: int, windows: int, size: int, span: int, report: int) -> list[tuple[int, int, int, int]]:
    """Marks of all windows of a context whose `windows` report windows start at `first` and which holds `size` bytes."""
    out = [(doc, first, first + windows - 1, report)]
    last = min(first + windows - 1, first + size - span)
    return [*out, (doc, first, last, span)] if span > report and last >= first else out


def _send(hot: np.ndarray, span: int, report: int, gram: int, bits: int):
    def run(batches):
        held: dict = {}
        marks: list[tuple[int, int, int, int]] = []
        size = 0

        def flush():
            entries = [(key, left, v[0], v[1], v[2], v[3]) for (key, left), v in held.items()]
            entries.sort(key=lambda e: e[0])
            names, blobs = [], []
            h = np.array([int.from_bytes(e[0][:8], "big") for e in entries], np.uint64)
            bucket = bucket_of(K.mix(h), bits)
            order = np.argsort(bucket, kind="stable")
            for s, e in equal_runs(bucket[order]):
                names.append(int(bucket[order[s]]))
                blobs.append(front_coded([entries[i] for i in order[s:e]]))
            m = np.array(marks, _MARK)
            mb = bucket_of(K.mix(m["doc"].view(np.uint64) if len(m) else np.zeros(0, np.uint64)), bits)
            order = np.argsort(mb, kind="stable")
            for s, e in equal_runs(mb[order]):
                names.append(int(mb[order[s]]))
                blobs.append(np.int32(-1).tobytes() + m[order[s:e]].tobytes())
            held.clear()
            marks.clear()
            return rows(names, blobs)

        for b in batches:
            ids, ords = b.column("row").to_numpy(zero_copy_only=False), b.column("ords")
            for row, end, raw, off in K.chunks(b.column("text")):
                codes, first, _, _ = R.byte_units(raw, off)
                a = R.anchors(codes, first, report, gram)
                on = R.chosen(a, ords.slice(row, end - row), end - row)
                if len(hot):
                    on &= hot[np.minimum(np.searchsorted(hot, a.h), len(hot) - 1)] != a.h
                data = raw.tobytes()
                doc = a.doc[on]
                cols = (a.at[on].tolist(), a.h[on].astype(">u8").tobytes(), a.first[on].tolist(), a.last[on].tolist(), ids[row + doc].tolist(), (a.first[on] - first[doc]).tolist(), first[doc + 1].tolist())
                for i, (p, s, z, d, f, stop) in enumerate(zip(cols[0], *cols[2:], strict=True)):
                    key = (cols[1][8 * i : 8 * i + 8] + data[p : min(z + span, stop)], data[s:p])
                    seen = held.get(key)
                    if seen is None:
                        held[key] = [d, f, p - z, 0]
                        size += len(key[0]) + len(key[1]) + 200
                    elif (d, f) != (seen[0], seen[1]):
                        seen[3] = 1
                        marks += _whole_marks(d, f, z - s + 1, min(z + span, stop) - s, span, report)
                if size >= _FLUSH_BYTES:
                    yield flush()
                    size = 0
        if held or marks:
            yield flush()

    return run


def _shard(span: int, report: int, bits: int):
    def run(held):
        by_bucket: dict[int, list] = {}
        marks = []
        for k, blob in held:
            if int(np.frombuffer(blob[:4], "<i4")[0]) < 0:
                marks.append(np.frombuffer(blob[4:], _MARK))
            else:
                by_bucket.setdefault(k, []).append(blob)
        stream = (x for k in sorted(by_bucket) for x in merged([decoded(b) for b in by_bucket[k]]))
        marks += shard_marks(stream, span, report)
        if marks:
            yield R.packed_marks(np.concatenate(marks), bits)

    return run


def shard_marks(stream, span: int, report: int) -> list[np.ndarray]:
    """Marks of repeated windows, from a stream of sorted suffixes with their common prefixes."""
    right, lefts, low, many, refs, owner, lead, size = [], [], [], [], [], [], [], []
    key_before, here = None, {}
    for lcp, key, (left, doc, first, o, dup) in stream:
        if key_before is None or lcp < len(key) or len(key) != len(key_before) or key != key_before:
            here = {}
            n = lcp if key_before is not None else 0
        else:
            n = len(key)
        key_before = key
        j = here.get(left)
        if j is None:
            j = here[left] = len(right)
            right.append(n)
            lefts.append(key[:8] + left[::-1])
            low.append(o)
            size.append(len(key) - 8)
            many.append(dup)
            lead.append((doc, first))
        elif (doc, first) != lead[j]:
            many[j] = 1
        refs.append((doc, first))
        owner.append(j)
    n = len(right)
    if not n:
        return []
    # the first suffix of a bucket follows one of another bucket: they share no hash
    r = np.array(right) - 8
    r[0] = -1
    low, high = np.array(low), np.array([len(x) - 8 for x in lefts])
    order = sorted(range(n), key=lefts.__getitem__)
    left = np.array([common(lefts[x], lefts[y]) - 8 for x, y in zip(order, order[1:], strict=False)], np.int64)
    order = np.array(order)
    # windows of offset o start high - o after the first one
    refs = np.array(refs, np.dtype([("doc", "<i8"), ("first", "<i8")]))
    owner = np.array(owner)
    by = np.argsort(owner, kind="stable")
    at, count = np.searchsorted(owner[by], np.arange(n)), np.bincount(owner, minlength=n)
    whole, size = np.flatnonzero(np.array(many)), np.array(size)
    found = []
    for width in {span, report}:
        least = np.maximum(low, width - size)  # a text's end cuts off the windows that would begin nearer to the anchor
        again = np.zeros((n, int(high.max()) + 1), bool)
        for o in range(again.shape[1]):
            on = np.flatnonzero((least <= o) & (o <= high))
            if len(on) < 2:
                continue
            rid = np.cumsum(r < width - o)
            lid = np.empty(n, np.int64)
            lid[order] = np.concatenate([[0], np.cumsum(left < o)])
            both = rid[on] * (n + 1) + lid[on]
            rank = np.argsort(both, kind="stable")
            s = both[rank]
            same = s[1:] == s[:-1]
            hit = np.zeros(len(on), bool)
            hit[rank[1:]] |= same
            hit[rank[:-1]] |= same
            again[on[hit], o] = True
        for j in whole:
            again[j, least[j] : high[j] + 1] = True
        flat = np.diff(np.concatenate([np.zeros((n, 1), np.int8), again.astype(np.int8), np.zeros((n, 1), np.int8)], 1), axis=1)
        who, start = np.nonzero(flat == 1)
        _, stop = np.nonzero(flat == -1)
        stop = stop - 1
        times = count[who]
        ref = refs[by[np.repeat(at[who] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())]] if len(who) else refs[:0]
        out = np.empty(len(ref), _MARK)
        out["doc"], out["span"] = ref["doc"], width
        out["first"] = ref["first"] + np.repeat(high[who] - stop, times)
        out["last"] = ref["first"] + np.repeat(high[who] - start, times)
        found.append(out)
    return found


def _prints(hot: np.ndarray, span: int, report: int, gram: int, bits: int):
    """Fingerprints of the windows of frequent anchors; equal ones of a flush are one record."""

    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            rec = np.concatenate(held)
            held.clear()
            rec = rec[np.lexsort((rec["start"], rec["doc"], rec["v"], rec["w"]))]
            same = (rec["w"][1:] == rec["w"][:-1]) & (rec["v"][1:] == rec["v"][:-1])
            copy = np.concatenate([[False], same & (rec["doc"][1:] == rec["doc"][:-1]) & (rec["start"][1:] == rec["start"][:-1])])
            rec = rec[~copy]
            new = np.ones(len(rec), bool)
            new[1:] = (rec["w"][1:] != rec["w"][:-1]) | (rec["v"][1:] != rec["v"][:-1])
            cut = np.flatnonzero(new)
            count = np.diff(np.append(cut, len(rec)))
            heads, rest, again = rec[cut], rec[~new], rec[cut][count > 1]
            heads["n"] = count
            rest = np.concatenate([rest, again])
            rest["n"] = 0
            return pack(np.concatenate([heads, rest]), bucket_of(np.concatenate([K.mix(heads["w"]), K.mix(rest["doc"].view(np.uint64))]), bits))

        for b in batches:
            ids, ords = b.column("row").to_numpy(zero_copy_only=False), b.column("ords")
            for row, end, raw, off in K.chunks(b.column("text")):
                codes, first, _, _ = R.byte_units(raw, off)
                a = R.anchors(codes, first, report, gram)
                on = R.chosen(a, ords.slice(row, end - row), end - row)
                on &= hot[np.minimum(np.searchsorted(hot, a.h), len(hot) - 1)] == a.h
                n = a.last[on] - a.first[on] + 1
                if not n.sum():
                    continue
                every = np.repeat(a.first[on] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                owner = np.repeat(a.doc[on], n)
                for width in {span, report}:
                    inside = every + width <= first[owner + 1]
                    at, doc = every[inside], owner[inside]
                    rec = np.empty(len(at), _PRINT)
                    rec["w"], rec["v"] = K.window_hash(codes, width)[at], K.window_hash(K.mix(codes ^ np.uint64(0x5DEECE66D)), width)[at]
                    rec["doc"], rec["start"], rec["n"], rec["span"] = ids[row + doc], at - first[doc], 1, width
                    held.append(rec)
                if sum(map(len, held)) >= 1 << 19:
                    yield flush()
        if held:
            yield flush()

    return run


def _print_marks(rec, bits: int):
    known, rec = rec[rec["n"] == 0], rec[rec["n"] > 0]
    rec = rec[np.lexsort((rec["start"], rec["doc"], rec["v"], rec["w"]))]
    same = np.concatenate([[False], (rec["w"][1:] == rec["w"][:-1]) & (rec["v"][1:] == rec["v"][:-1])]) if len(rec) else np.zeros(0, bool)
    cut = np.flatnonzero(~same)
    group = np.cumsum(~same) - 1
    other = np.zeros(len(rec), bool)
    other[1:] = same[1:] & ((rec["doc"][1:] != rec["doc"][:-1]) | (rec["start"][1:] != rec["start"][:-1]))
    hit = np.zeros(len(cut), bool)
    hit[group[other]] = True
    m = np.concatenate([known, rec[hit[group]]]) if len(rec) else known
    marks = np.empty(len(m), _MARK)
    marks["doc"], marks["first"], marks["last"], marks["span"] = m["doc"], m["start"], m["start"], m["span"]
    yield R.packed_marks(marks, bits)


def repeated_strings(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT, report: int = REPORT) -> DataFrame:
    """(row, marks) of keyed docs: first and last starts of strings of `span` or `report` bytes that also start elsewhere, with their length."""
    bits = bucket_bits(docs.sparkSession)
    found = written(R.repeated_anchors(docs, R.Units(report, gram, R.byte_units), hot), "anchors")
    top = docs.sparkSession.sparkContext.broadcast(R.hot_hashes(found, hot))
    ready = R.with_repeats(docs, found)
    marks = reduce_blobs(ready.mapInArrow(lambda it: _send(top.value, span, report, gram, bits)(it), PACKED), _shard(span, report, bits), PACKED, limit=8 << 20)
    if len(top.value):
        marks = marks.union(reduce_packed(ready.mapInArrow(lambda it: _prints(top.value, span, report, gram, bits)(it), PACKED), _PRINT, lambda rec: _print_marks(rec, bits), PACKED))
    return R.marks_by_doc(marks, _MARK)


def remove_strings(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT, report: int = REPORT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated (bytes covered by repeated strings of `report` bytes, removed ones among them) and kept (the remaining bytes)."""
    report = min(report, span)

    def cut(batches):
        for b in batches:
            for row, end, raw, off in K.chunks(b.column("text")):
                marks, copies = b.column("marks").slice(row, end - row), b.column("copies").to_numpy()[row:end] > 1
                gone = R.marked(marks, off, span, copies, span)
                again = R.marked(marks, off, report, copies, report)
                starts, _, first = K.spans(gone, off)
                data, at, kept = raw.tobytes(), off.tolist(), []
                removed = K.per_doc(gone, off)
                for i in range(end - row):
                    kept.append(raw[at[i] : at[i + 1]][~gone[at[i] : at[i + 1]]].tobytes() if removed[i] else data[at[i] : at[i + 1]])
                digests = pa.array([hashlib.sha256(k).hexdigest() for k in kept])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(row, end - row), pa.array(np.diff(off)), pa.array(removed), pa.array(np.diff(first)), digests, pa.array(K.per_doc(again, off)), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "kept"],
                )

    own, alone = R.keyed(docs)
    return R.with_marks(own, alone, repeated_strings(own, span, gram, hot, report)).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, kept binary")
