"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items (operator 6).

Text is normalised byte by byte (A-Z lower-cased; every other ASCII byte but 0-9 and a-z separates words), so a
normalised word stands where its original stands and offsets map back by a table of word positions. Patterns are the
items' windows of `width` words, as sequences of word numbers: a word is one step of the automaton, its text is stored
once whatever the number of windows around it, and a word outside the items' vocabulary (told by a 64-bit hash) leads
back to the root. A text is scanned once; stretches without any vocabulary word are skipped.

The items are the stated query set. They go to the executors in blocks of at most `block_bytes` of text, so what is
broadcast, and the automaton of about ten nodes a word (some 150 MB for 2 MB of text), is bounded whatever the table's
size; each block is one automaton, built once in a worker process, and one scan. Null and empty texts have no words.
Items with equal windows are all reported, one without an id as null, after the others. Every row is a row of its own
whatever its doc_id and the number of blocks. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

WIDTH = 10
BLOCK_BYTES = 2 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_NORMAL = np.frombuffer(_TABLE, np.uint8)
_IS_WORD = _NORMAL != 32
SCAN_SCHEMA = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long>>"


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def in_order(ids: set[int | None]) -> list[int | None]:
    """Ids in order, a null one last."""
    return sorted(ids, key=lambda x: (x is None, x or 0))


@dataclass
class Automaton:
    """Sorted hashes of the items' words, the automaton over their numbers (from 1), and each pattern's length and items."""

    vocabulary: np.ndarray
    steps: ahocorasick.Automaton
    sizes: list[int]
    items: list[tuple[int | None, ...]]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word; 0 for a word that no item holds."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def _hashes(words: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return K.span_hash(K.prefix_hash(raw), ends - [len(w) for w in words], ends)


def build(items: list[tuple[int | None, str]], width: int = WIDTH) -> Automaton | None:
    """The automaton of some items, or None if they have no words. A shorter item than `width` is one window."""
    split = [(item, normal_words(text)) for item, text in items]
    words = sorted({w for _, ws in split for w in ws})
    if not words:
        return None
    hashes = _hashes(words)
    order = np.argsort(hashes)
    number = {words[i]: k + 1 for k, i in enumerate(order.tolist())}
    found: dict[tuple[int, ...], set[int | None]] = {}
    for item, ws in split:
        seq = tuple(number[w] for w in ws)
        for i in range(max(len(seq) - width + 1, 1) if seq else 0):
            found.setdefault(seq[i : i + width], set()).add(item)
    steps = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, w in enumerate(found):
        steps.add_word(w, k)
    steps.make_automaton()
    return Automaton(hashes[order], steps, [len(w) for w in found], [tuple(in_order(ids)) for ids in found.values()])


_built: dict[str, Automaton | None] = {}


def built(key: str, items: list[tuple[int | None, str]], width: int) -> Automaton | None:
    """The block's automaton, built once in a worker process, which holds one at a time."""
    if key not in _built:
        _built.clear()
        _built[key] = build(items, width)
    return _built[key]


def scan_chunk(auto: Automaton | None, raw: np.ndarray, offsets: np.ndarray):
    """(words of each document, hit words, item ids, spans in original bytes and in words) of a chunk, by one pass of the automaton."""
    n = len(offsets) - 1
    starts, ends, first = K.spans(_IS_WORD[raw], offsets)
    out_items: list[list[int | None]] = [[] for _ in range(n)]
    out_spans: list[list[dict]] = [[] for _ in range(n)]
    hit = np.zeros(len(starts), bool)
    if auto is not None and len(starts):
        # a 0 stands before each document, so no match crosses two
        at = np.arange(len(starts)) + K.doc_of(first) + 1
        numbers = np.zeros(len(starts) + n + 1, np.int64)
        numbers[at] = auto.numbers(K.span_hash(K.prefix_hash(_NORMAL[raw]), starts, ends))
        use = numbers > 0
        use[1:] |= use[:-1]
        use = np.flatnonzero(use)
        word = np.zeros(len(numbers), np.int64)
        word[at] = np.arange(len(starts))
        stops, which = [], []
        for end, k in auto.steps.iter(tuple(numbers[use].tolist())):
            stops.append(end)
            which.append(k)
        if stops:
            sizes = np.array(auto.sizes)[which]
            to = word[use[stops]] + 1
            hit = K.cover(to - sizes, sizes, len(starts))
            doc = np.searchsorted(first, to - 1, "right") - 1
            per: dict[int, set[int | None]] = {}
            for d, k in zip(doc.tolist(), which, strict=True):
                per.setdefault(d, set()).update(auto.items[k])
            for d, ids in per.items():
                out_items[d] = in_order(ids)
            a, b, f = K.spans(hit, first)
            for d in per:
                out_spans[d] = [{"start": int(starts[i] - offsets[d]), "end": int(ends[j - 1] - offsets[d]), "word": int(i - first[d]), "stop": int(j - first[d])} for i, j in zip(a[f[d] : f[d + 1]], b[f[d] : f[d + 1]], strict=True)]
    return np.diff(first), K.per_doc(hit, first), out_items, out_spans


def blocks(benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES):
    """Yields lists of (item_id, text) of at most block_bytes (or one item); they stream to the driver one by one."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        own = len(row.text.encode())
        if held and size + own > block_bytes:
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += own
    yield held


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, and hit spans in bytes of the original text."""
    spark, parts = docs.sparkSession, []
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    for items in blocks(benchmark, width, block_bytes):
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent, key=uuid.uuid4().hex):
            auto = built(key, sent.value, width)
            for b in batches:
                for row, end, raw, off in K.chunks(b.column("text")):
                    n_words, n_hit, ids, spans = scan_chunk(auto, raw, off)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").slice(row, end - row), b.column("text_hash").slice(row, end - row), pa.array(n_words), pa.array(n_hit), pa.array(ids, pa.list_(pa.int64())), pa.array(spans, _SPANS)],
                        ["doc_id", "text_hash", "n_words", "n_hit", "items", "spans"],
                    )

        parts.append(own.mapInArrow(run, _PART))
    if len(parts) == 1:
        return parts[0].select("doc_id", "n_words", "n_hit", "items", F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return _merged(both, len(parts))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without any hit word; columns as they are."""
    for items in blocks(benchmark, width, block_bytes):
        docs = _without(docs, docs.sparkSession.sparkContext.broadcast(items), width)
    return docs


def _without(docs: DataFrame, sent, width: int) -> DataFrame:
    at, key = docs.columns.index("text"), uuid.uuid4().hex

    def run(batches):
        auto = built(key, sent.value, width)
        for b in batches:
            for row, end, raw, off in K.chunks(b.column(at)):
                yield b.slice(row, end - row).filter(pa.array(scan_chunk(auto, raw, off)[1] == 0))

    return docs.mapInArrow(run, docs.schema)


def _merged(both: DataFrame, n_blocks: int) -> DataFrame:
    """Several blocks: items are united; hit words are counted anew from the united spans.

    Rows of one doc_id and text have equal results, so they are counted and put out again as often as they stood.
    """
    found = both.groupBy("doc_id", "text_hash", "n_words").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("items") > 0, F.col("items")))))).alias("items"), F.flatten(F.collect_list(F.when(F.size("spans") > 0, F.col("spans")))).alias("spans"))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                runs: list[dict] = []
                for x in sorted(r["spans"], key=lambda x: x["word"]):
                    if not runs or x["word"] > runs[-1]["stop"]:
                        runs.append(x)
                    elif x["stop"] > runs[-1]["stop"]:
                        runs[-1] |= {"stop": x["stop"], "end": x["end"]}
                n_hit = sum(x["stop"] - x["word"] for x in runs)
                out.append({"doc_id": r["doc_id"], "n_words": r["n_words"], "n_hit": n_hit, "items": r["items"], "spans": [{"start": x["start"], "end": x["end"]} for x in runs]})
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    again = F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"n div {n_blocks}")))
    return found.withColumn("copy", again).select("doc_id", "n_words", "items", "spans").mapInArrow(run, SCAN_SCHEMA)


_PART = "doc_id long, text_hash long, n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long,word:long,stop:long>>"
_SPANS = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "word", "stop")]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def items_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
