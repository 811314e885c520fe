"""MinHash near-duplicates by chosen-path set similarity join (operator 5).

A document is the set of its distinct five-word shingles (A-Z lower-cased; a shorter text is one shingle, an empty one
has none and is linked with nothing). Documents with equal sets are folded first; one representative goes on.

Join. Each of TREES independent trees branches all documents by their minwise token at one coordinate. A node of up to
SMALL members is a leaf. A larger one chooses coordinates of its own, by a hash of its path: one, and in BRANCH of the
nodes a second, so that a pair at the threshold keeps one shared child on average. Each member moves to the child of its
minwise token there, and so on until nodes are small or DEPTH tokens long. A pair at similarity 0.75 shares a leaf of a
tree with probability 0.75 where nodes are small at once, and 0.45 where they stay large down to DEPTH; 20 trees miss it
with probability 1e-12 and 6e-6.

A group of near copies would stay together and move in full at every level: 109.6 rows a member on average at most. So
members of large first nodes are tied to the document that leads most of their nodes, if the signatures agree, and bear
its label. A large node with few members (BESIDE times SMALL) outside its largest label is settled: those are compared
with each other and with all of the label, which is dealt into parts, and nothing of it moves on. That compares
each pair that moving on could bring together. Node sizes are aggregates that combine before the shuffle; members of the most frequent
nodes find theirs by a broadcast of at most MAX_HOT of them, all others by an equi-join.

Small leaves are compared exhaustively, all pairs of their members in one task, by signatures of four bits a coordinate
(ALIKE of 128 agree; at similarity 0.75 fewer do with probability 2e-6); what agrees is tied together by a spanning
forest, so no list of pairs leaves the task. A leaf of DEPTH tokens that is still large ties its members to the smallest.
Documents that ties connect make a family: documents that could be linked.
A family of up to MAX_FAMILY shingles and MAX_MEMBERS members is compared exhaustively in one task, which gets each
member's full set once: every pair that is not yet in one component is judged by its signature (LIKELY of all places
agree; at similarity 0.75 fewer do with probability 3e-7) and then confirmed on the full sets. Larger families are worked
by several tasks: stars are confirmed first (SALTS parts of each), then all pairs across components by crossing_pairs,
which deals the members of the largest component into parts and copies the others to each part. So no pair is left out
and there is no cap on partners; the work on a family of very many unlinked members grows with their number times the
family's size.

Rows with equal doc_id belong to one component. A null doc_id is linked with nothing (component_id null, kept); see
one_of_each for rows that share an id or have none. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .exchange import PACKED, bucket_bits, bucket_of, dropped, free_name, pack, partitions, reduce_packed, written
from .repeats import keyed, row_key

WIDTH = 5
THRESHOLD = 75
TREES = 20
DEPTH = 4
SMALL = 64
"""Members of a leaf."""
BESIDE = 4
"""Times SMALL: members of a settled node outside its largest label."""
PART = 16
"""Times SMALL: members of the largest label that are compared in one part."""
LEADS = 6
"""First nodes of a document that one other must lead to be compared with it for a label."""
BRANCH = 1 / 3
"""Share of the large nodes that branch by two tokens: 1 + 1/3 children for a member, the inverse of the threshold."""
ALIKE = 76
BANDS = 32
LIKELY = 0.55
MAX_FAMILY = 1 << 22
MAX_MEMBERS = 8192
SHORT = 96
"""Coordinates of which one byte each serves to compare members of a large family."""
SURE = 53
"""Places of SHORT that must agree (0.55; at similarity 0.75 fewer agree with probability 1e-5)."""
HOT = 1024
HOT_NODE = 1 << 16
MAX_HOT = 1_000_000
SALTS = 64
_FLUSH = 1 << 19
_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SIZE = np.dtype([("key", "<u8"), ("comp", "<i8"), ("n", "<i8")])
_PART = np.dtype([("key", "<u8"), ("doc", "<i8"), ("comp", "<i8"), ("short", "u1", (SHORT,))])


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each document side by side, first of each document)."""
    n = len(offsets) - 1
    low = _LOWER[raw]
    starts, ends, first = K.word_spans(low, offsets)
    words = K.span_hash(K.prefix_hash(low), starts, ends)
    counts = np.diff(first)
    w = K.window_hash(words, WIDTH)
    ok = np.flatnonzero(K.inside_docs(first, WIDTH, len(words)))
    h, doc = w[ok], K.doc_of(first)[ok]
    brief = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(brief):
        own = np.array([K.window_hash(words[first[d] : first[d + 1]], int(counts[d]))[0] for d in brief], np.uint64)
        h, doc = np.concatenate([h, own]), np.concatenate([doc, brief])
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minwise values (upper 32 bits), one row for each document; rows of empty sets are all ones."""
    out = np.full((len(first) - 1, len(_MULT)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        at = first[full]
        for i in range(len(_MULT)):
            out[full, i] = np.minimum.reduceat((h ^ _XOR[i]) * _MULT[i], at) >> np.uint64(32)
    return out


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig): size, digest and signature of every row's set."""

    def run(batches):
        for b in batches:
            for row, end, raw, off in K.chunks(b.column("text")):
                h, first = shingle_sets(raw, off)
                size = np.diff(first)
                cum = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(h ^ np.uint64(s)), dtype=np.uint64)]) for s in (0x51ED27, 0xA0761D6478BD642F)]
                d1, d2 = ((c[first[1:]] - c[first[:-1]]).view(np.int64) for c in cum)
                sig = signatures(h, first)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(row, end - row), pa.array(size), pa.array(d1), pa.array(d2), _blobs(sig)], ["doc_id", "n_shingles", "d1", "d2", "sig"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def _blobs(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    at = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _sigs(column: pa.Array) -> np.ndarray:
    raw, off = K.texts(column)
    return raw[off[0] : off[-1]].view(np.uint32).reshape(len(column), -1)


def _child(path: np.ndarray, sig: np.ndarray, row: np.ndarray, turn: int) -> np.ndarray:
    """Paths of the children that members (rows of sig) move to, at the coordinate which their nodes choose in this turn."""
    draw = K.mix(path + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    at = (draw % np.uint64(sig.shape[1])).astype(np.int64)
    return K.mix(draw ^ K.mix(sig[row, at].astype(np.uint64) + np.uint64(1)))


def roots(sig: np.ndarray) -> np.ndarray:
    """Path of each document's first node in each tree; a tree's root chooses one coordinate."""
    n = len(sig)
    root = K.mix(np.arange(1, TREES + 1, dtype=np.uint64))
    return _child(np.tile(root, n), sig, np.repeat(np.arange(n), TREES), 0).reshape(n, TREES)


def branches(path: np.ndarray, sig: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(paths, rows) of the next level for members of large nodes."""
    two = (K.mix(path ^ np.uint64(0xB5297A4D)) >> np.uint64(11)) < np.uint64(int(BRANCH * (1 << 53)))
    return np.concatenate([_child(path, sig, row, 0), _child(path[two], sig, row[two], 1)]), np.concatenate([row, row[two]])


def deep_keys(sig: np.ndarray) -> np.ndarray:
    """Key of the node of DEPTH tokens that each document reaches in each of BANDS trees, for families that one task can't hold."""
    out = np.empty((len(sig), BANDS), np.uint64)
    for t in range(BANDS):
        h = np.full(len(sig), t + 1, np.uint64)
        for i in range(t * DEPTH, (t + 1) * DEPTH):
            h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, i])
        out[:, t] = h
    return out


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group starts with the end) of equal keys."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return order, np.append(cut, len(k))


def _paths(paths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(ids)], ["path", "doc_id"])


def first_nodes(reps: DataFrame) -> DataFrame:
    """(path, doc_id): every document in its first node of each tree."""

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            yield _paths(roots(_sigs(b.column("sig"))).ravel(), np.repeat(ids, TREES))

    return reps.select("doc_id", "sig").mapInArrow(run, "path long, doc_id long")


def next_nodes(reps: DataFrame, members: DataFrame) -> DataFrame:
    """(path, doc_id): the members of large nodes in their nodes' children."""
    mine = members.groupBy("doc_id").agg(F.collect_list("path").alias("paths"))  # a few paths a tree

    def run(batches):
        for b in batches:
            ids, paths = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("paths")
            row = np.repeat(np.arange(len(ids)), np.asarray(pa.compute.list_value_length(paths)))
            path, row = branches(paths.flatten().to_numpy(zero_copy_only=False).view(np.uint64), _sigs(b.column("sig")), row)
            yield _paths(path, ids[row])

    return reps.select("doc_id", "sig").join(mine.hint("merge"), "doc_id").mapInArrow(run, "path long, doc_id long")


def with_sizes(members: DataFrame, rows: int | None = None) -> DataFrame:
    """(path, doc_id, n, lead) of the members of nodes of two or more; n is the node's size, lead its smallest member."""
    nodes = written(members.groupBy("path").agg(F.count("*").alias("n"), F.min("doc_id").alias("lead")).where("n > 1"), "nodes", rows=rows)
    total = nodes.agg(F.sum("n")).first()[0] or 0
    hot = nodes.where(F.col("n") > max(HOT_NODE, total // MAX_HOT))  # at most MAX_HOT
    cold = members.join(F.broadcast(hot), "path", "left_anti").join(nodes.hint("merge"), "path")
    return members.join(F.broadcast(hot), "path").unionByName(cold)


def forest(alike: np.ndarray) -> np.ndarray:
    """Smallest member of each member's connected part, from a symmetric matrix."""
    part = np.arange(len(alike))
    while True:
        new = np.where(alike, part[None, :], len(alike)).min(1)
        if (new == part).all():
            return part
        part = new


def halves_of(sig: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, two coordinates a byte."""
    half = (sig & np.uint32(15)).astype(np.uint8)
    return half[:, ::2] << 4 | half[:, 1::2]


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many coordinates halves agree; a and b as numpy broadcasts them."""
    return (a >> 4 == b >> 4).sum(-1) + (a & 15 == b & 15).sum(-1)


def lead_labels(reps: DataFrame, large: DataFrame) -> DataFrame:
    """(doc_id, label): members of large first nodes and the smaller document that leads most of these, where signatures agree."""
    led = large.groupBy("doc_id", "lead").agg(F.count("*").alias("k"))
    best = led.groupBy("doc_id").agg(F.min(F.struct((-F.col("k")).alias("less"), "lead")).alias("m"))
    some = best.where(F.col("m.less") <= -LEADS).select("doc_id", F.col("m.lead").alias("label")).where("label < doc_id")

    def run(batches):
        for b in batches:
            same = agreeing(halves_of(_sigs(b.column("sig"))), halves_of(_sigs(b.column("other")))) >= ALIKE
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(same)) for c in ("doc_id", "label")], ["doc_id", "label"])

    both = some.join(reps.select("doc_id", "sig").hint("merge"), "doc_id").join(reps.select(F.col("doc_id").alias("label"), F.col("sig").alias("other")).hint("merge"), "label")
    return both.select("doc_id", "label", "sig", "other").mapInArrow(run, "doc_id long, label long")


def settled(large: DataFrame, labels: DataFrame, small: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(leaves, open): parts of settled nodes as path, doc_id, main (of the largest label); (path, doc_id) of all other large nodes."""
    own = large.select("path", "doc_id").join(labels.hint("merge"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    most = own.groupBy("path", "label").agg(F.count("*").alias("k")).groupBy("path").agg(F.sum("k").alias("n"), F.max(F.struct("k", "label")).alias("m"))
    most = most.select("path", F.col("m.label").alias("main"), F.ceil(F.col("m.k") / (PART * small)).alias("parts"), (F.col("n") - F.col("m.k")).alias("beside"), "m.k")
    done = written(most.where(F.col("beside") <= F.least(F.lit(BESIDE * small), "k")).drop("k"), "settled", rows=rows // PART)
    part = F.when(F.col("label") == F.col("main"), F.array(F.pmod(F.xxhash64("doc_id"), "parts"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    leaves = own.join(done.where("beside > 0"), "path").select("path", "doc_id", (F.col("label") == F.col("main")).alias("main"), F.explode(part).alias("part"))
    return leaves.select(F.xxhash64("path", "part").alias("path"), "doc_id", "main"), large.select("path", "doc_id").join(done, "path", "left_anti")


def leaf_ties(reps: DataFrame, leaves: DataFrame) -> DataFrame:
    """(a, b), a < b: ties of the members of leaves whose signatures agree; those of a leaf's main label are tied already."""
    mine = leaves.groupBy("doc_id").agg(F.collect_list(F.struct("path", "main")).alias("paths"))  # a few paths a tree

    def send(batches):
        for b in batches:
            ids, paths, half = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("paths"), halves_of(_sigs(b.column("sig")))
            row, flat = np.repeat(np.arange(len(ids)), np.asarray(pa.compute.list_value_length(paths))), paths.flatten()
            for s in range(0, len(row), _FLUSH // 8):
                r, f = row[s : s + _FLUSH // 8], flat.slice(s, _FLUSH // 8)
                yield pa.RecordBatch.from_arrays([pa.compute.struct_field(f, 0), pa.array(ids[r]), pa.compute.struct_field(f, 1), _blobs(half[r])], ["path", "doc_id", "main", "half"])

    def compare(batches):
        at, ids, mains, halves = None, [], [], []

        def done():
            order = np.argsort(np.array(ids), kind="stable")
            got, both, main = np.array(ids)[order], np.stack(halves)[order], np.array(mains)[order]
            mine, own, rest, others = both[main], got[main], both[~main], got[~main]
            part = forest(agreeing(rest[:, None], rest[None, :]) >= ALIKE)
            tied = part != np.arange(len(part))
            left, right = others[part[tied]].tolist(), others[tied].tolist()
            for x, half in zip(others.tolist(), rest, strict=True):
                if len(hit := np.flatnonzero(agreeing(mine, half) >= ALIKE)):  # one tie to the label joins all of it
                    left.append(min(x, int(own[hit[0]])))
                    right.append(max(x, int(own[hit[0]])))
            return left, right

        for b in batches:
            left, right = [], []
            body = np.frombuffer(b.column(3).buffers()[2], np.uint8, count=b.column(3).buffers()[2].size)
            off = np.frombuffer(b.column(3).buffers()[1], np.int32)[b.column(3).offset : b.column(3).offset + len(b) + 1]
            for k, (path, doc, main) in enumerate(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)):
                if path != at:
                    if len(ids) > 1:
                        x, y = done()
                        left += x
                        right += y
                    at, ids, mains, halves = path, [], [], []
                ids.append(doc)
                mains.append(main)
                halves.append(body[off[k] : off[k + 1]].copy())
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
        if len(ids) > 1:
            x, y = done()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    n = partitions(reps.sparkSession)
    sent = reps.select("doc_id", "sig").join(mine.hint("merge"), "doc_id").mapInArrow(send, "path long, doc_id long, main boolean, half binary")
    return sent.repartition(n, "path").sortWithinPartitions("path").mapInArrow(compare, "a long, b long")


def star_links(reps: DataFrame, small: int = SMALL) -> DataFrame:
    """Candidate ties (a, b), a < b, as a written table."""
    members, ties, leaves, labels, inside = written(first_nodes(reps), "members"), None, None, None, None
    rows = reps.count() * TREES  # most members stay in as many nodes or leave
    for depth in range(1, DEPTH + 1):
        sized = written(with_sizes(members, rows), "sized", rows=rows)
        some = sized.where(F.col("n") <= small).select("path", "doc_id", F.lit(False).alias("main"))
        leaves = some if leaves is None else leaves.union(some)
        large = sized.where(F.col("n") > small)
        if large.isEmpty():
            break
        if labels is None:  # who is in a large node later is in one now
            inside = written(reps.select("doc_id", "sig").join(large.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "inside", rows=rows // TREES)
            labels = written(lead_labels(inside, large), "labels", rows=rows)
            ties = labels.select(F.col("label").alias("a"), F.col("doc_id").alias("b"))
        if depth < DEPTH:
            some, large = settled(large, labels, small, rows)
            leaves = leaves.union(some)
            members = written(next_nodes(inside, large), "members", members, rows)
        else:
            ties = ties.union(large.where("lead < doc_id").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")))
    dropped(members)
    found = leaf_ties(reps, leaves)
    return written((found if ties is None else found.union(ties)).distinct(), "stars", rows=rows)


def set_links(reps: DataFrame, small: int = SMALL) -> DataFrame:
    """star_links of sets of which several may share a doc_id; reps has their d1, d2, n_shingles too.

    Each set is a member of its own, else every set of an id would move along the paths of all the others.
    """
    if (reps.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0) < 2:
        return star_links(reps, small)
    own = reps.withColumn("set", F.xxhash64("doc_id", "d1", "d2", "n_shingles"))
    links, ends = star_links(own.select(F.col("set").alias("doc_id"), "sig"), small), own.select("set", "doc_id").hint("merge")
    for end in ("a", "b"):
        links = links.join(ends.withColumnRenamed("doc_id", f"{end}_id"), F.col(end) == F.col("set")).drop(end, "set")
    return written(links.where("a_id <> b_id").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct(), "stars", rows=reps.count())


def confirmed(docs: DataFrame, links: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The links whose full sets have 100 * intersection >= threshold * union.

    Each document's set is made once and sent to the links' smaller ends, which SALTS parts share; a task holds one set
    of the smaller end and streams the others.
    """
    e = links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    asks = e.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(1).alias("kind")).union(e.select("a", "a", "salt", F.lit(0)).distinct())
    asks = asks.groupBy("doc_id").agg(F.collect_list(F.struct("a", "salt", "kind")).alias("asks"))

    def sets(batches):
        for b in batches:
            for row, end, raw, off in K.chunks(b.column("text")):
                h, first = shingle_sets(raw, off)
                want = b.column("asks").slice(row, end - row).to_pylist()
                ids = b.column("doc_id").slice(row, end - row).to_pylist()
                out, size = [], 0
                for i, (doc, ask) in enumerate(zip(ids, want, strict=True)):
                    blob = h[first[i] : first[i + 1]].tobytes()
                    for x in ask:
                        out.append((x["a"], x["salt"], x["kind"], doc, blob))
                        size += len(blob)
                        if size > 8 << 20:
                            yield _table(out)
                            out, size = [], 0
                if out:
                    yield _table(out)

    def _table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["a", "salt", "kind", "doc_id", "blob"])

    def compare(batches):
        at, own = None, []
        for b in batches:
            left, right = [], []
            for a, salt, kind, doc, blob in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                h = np.frombuffer(blob.as_buffer(), np.uint64)
                if (a, salt) != at:
                    at, own = (a, salt), []
                if kind == 0:
                    own.append(h.copy())
                    continue
                if any(linked(o, h, threshold) for o in own):
                    left.append(a)
                    right.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    n = partitions(docs.sparkSession)
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asks.hint("merge"), "doc_id")
    made = ready.mapInArrow(sets, "a long, salt int, kind int, doc_id long, blob binary")
    return made.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "kind").mapInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every end of a link, by alternating large and small stars; each round is written."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen, rows = None, edges.count()
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m < u").select("u", F.col("m").alias("v")))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "links", edges, rows)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "doc_id")
        seen = now


def _with_component(reps: DataFrame, comps: DataFrame) -> DataFrame:
    return reps.join(comps, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def crossing_pairs(reps: DataFrame, hot: int | None = None) -> DataFrame:
    """(a, b) in one node but in different components, with signatures that agree in SURE places. reps: doc_id, sig, component_id."""
    spark = reps.sparkSession
    bits = bucket_bits(spark)
    hot = hot or max(HOT, reps.count() * BANDS // MAX_HOT)

    def sizes(batches):
        held: list[np.ndarray] = []

        def flush():
            rec = np.concatenate(held)
            held.clear()
            rec = rec[np.lexsort((rec["comp"], rec["key"]))]
            cut = np.flatnonzero(np.concatenate([[True], (rec["key"][1:] != rec["key"][:-1]) | (rec["comp"][1:] != rec["comp"][:-1])]))
            one = rec[cut]
            one["n"] = np.add.reduceat(rec["n"], cut)
            return pack(one, bucket_of(one["key"], bits))

        for b in batches:
            keys = deep_keys(_sigs(b.column("sig")))
            rec = np.empty(keys.size, _SIZE)
            rec["key"], rec["comp"], rec["n"] = keys.ravel(), np.repeat(b.column("component_id").to_numpy(zero_copy_only=False), BANDS), 1
            held.append(rec)
            if sum(map(len, held)) >= _FLUSH:
                yield flush()
        if held:
            yield flush()

    def large(rec):
        order, cut = _groups(rec["key"])
        rec = rec[order]
        total = np.add.reduceat(rec["n"], cut[:-1])
        keys, main, parts = [], [], []
        for g in np.flatnonzero(total > hot):
            r = rec[cut[g] : cut[g + 1]]
            comps, at = np.unique(r["comp"], return_inverse=True)
            keys.append(int(r["key"][0].view(np.int64)))
            main.append(int(comps[np.bincount(at, r["n"]).argmax()]))
            parts.append(0 if len(comps) == 1 else int(-(-total[g] // hot)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, main, parts)], ["key", "main", "parts"])

    found = reduce_packed(reps.select("component_id", "sig").mapInArrow(sizes, PACKED), _SIZE, large, "key long, main long, parts long").collect()  # at most MAX_HOT
    table = np.array(sorted((np.int64(r.key).view(np.uint64), r.main, r.parts) for r in found), np.dtype([("key", "<u8"), ("main", "<i8"), ("parts", "<i8")]))
    sent = spark.sparkContext.broadcast(table)

    def send(batches):
        big, held = sent.value, []

        def flush():
            rec = np.concatenate(held)
            held.clear()
            return pack(rec, bucket_of(rec["key"], bits))

        for b in batches:
            sig = _sigs(b.column("sig"))
            keys, ids, comp = deep_keys(sig), b.column("doc_id").to_numpy(zero_copy_only=False), b.column("component_id").to_numpy(zero_copy_only=False)
            rec = np.empty(keys.size, _PART)
            rec["key"], rec["doc"], rec["comp"], rec["short"] = keys.ravel(), np.repeat(ids, BANDS), np.repeat(comp, BANDS), np.repeat(sig[:, :SHORT].astype(np.uint8), BANDS, axis=0)
            if len(big):
                at = np.minimum(np.searchsorted(big["key"], rec["key"]), len(big) - 1)
                is_big = big["key"][at] == rec["key"]
                rest, extra = rec[~is_big], []
                for r, w in zip(rec[is_big], big[at[is_big]], strict=True):
                    if w["parts"]:
                        every = range(int(w["parts"])) if r["comp"] != w["main"] else [int(K.mix(np.array([r["doc"]], np.int64).view(np.uint64))[0] % np.uint64(w["parts"]))]
                        for s in every:
                            x = r.copy()
                            x["key"] = K.mix(np.array([r["key"] + np.uint64(s + 1)], np.uint64))[0]
                            extra.append(x)
                rec = np.concatenate([rest, np.array(extra, _PART)]) if extra else rest
            held.append(rec)
            if sum(map(len, held)) >= _FLUSH // 8:
                yield flush()
        if held:
            yield flush()

    def pairs(rec):
        order, cut = _groups(rec["key"])
        rec = rec[order]
        left, right = [], []
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            r = rec[s:e]
            if (r["comp"] == r["comp"][0]).all():
                continue
            for i in range(len(r) - 1):
                o = r[i + 1 :]
                o = o[o["comp"] != r["comp"][i]]
                if len(o):
                    o = o[(o["short"] == r["short"][i]).sum(1) >= SURE]
                    left += np.minimum(o["doc"], r["doc"][i]).tolist()
                    right += np.maximum(o["doc"], r["doc"][i]).tolist()
        both = sorted(set(zip(left, right, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in both], pa.int64()) for k in (0, 1)], ["a", "b"])

    return reduce_packed(reps.select("doc_id", "component_id", "sig").mapInArrow(send, PACKED), _PART, pairs, "a long, b long").distinct()


def linked(o: np.ndarray, h: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether two sorted sets have 100 * intersection >= threshold * union."""
    if 100 * min(len(o), len(h)) < threshold * max(len(o), len(h)) or not len(h):
        return False
    both = len(np.intersect1d(o, h, assume_unique=True))
    return 100 * both >= threshold * (len(o) + len(h) - both)


def united(sets: list[np.ndarray], sig: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Component (number of its first member) of each member of a family, by all pairs that can matter."""
    comp = np.arange(len(sets))
    for i in range(1, len(sets)):
        alike = (sig[:i] == sig[i]).mean(1)
        for j in np.argsort(-alike, kind="stable"):
            if alike[j] < LIKELY:
                break
            if comp[j] != comp[i] and linked(sets[i], sets[j], threshold):
                a, b = sorted((comp[i], comp[j]))
                comp[comp == b] = a
    return comp


def family_components(docs: DataFrame, family: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, component_id) within each family; family: doc_id, family."""

    def sets(batches):
        for b in batches:
            for row, end, raw, off in K.chunks(b.column("text")):
                h, first = shingle_sets(raw, off)
                own = pa.Array.from_buffers(pa.binary(), end - row, [None, pa.py_buffer((first * 8).astype(np.int32).tobytes()), pa.py_buffer(h.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column("family").slice(row, end - row), b.column("doc_id").slice(row, end - row), own, _blobs(signatures(h, first))], ["family", "doc_id", "own", "sig"])

    def unite(batches):
        at, ids, own, sig = None, [], [], []

        def done():
            order = np.argsort(ids, kind="stable")
            comp = united([own[i] for i in order], np.stack([sig[i] for i in order]), threshold)
            got = np.array(ids)[order]
            return pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(got[comp], pa.int64())], ["doc_id", "component_id"])

        for b in batches:
            for f, d, o, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if f != at:
                    if ids:
                        yield done()
                    at, ids, own, sig = f, [], [], []
                ids.append(d)
                own.append(np.frombuffer(o.as_buffer(), np.uint64).copy())
                sig.append(np.frombuffer(g.as_buffer(), np.uint32).copy())
        if ids:
            yield done()

    n = partitions(docs.sparkSession)
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(family.hint("merge"), "doc_id")
    made = ready.mapInArrow(sets, "family long, doc_id long, own binary, sig binary")
    return made.repartition(n, "family").sortWithinPartitions("family").mapInArrow(unite, "doc_id long, component_id long")


def large_families(docs: DataFrame, reps: DataFrame, stars: DataFrame, threshold: int, hot: int | None = None) -> DataFrame:
    """Confirmed links within families that one task can't hold. reps: doc_id, sig of their members."""
    sure = written(confirmed(docs, stars, threshold), "sure")
    open_reps = written(_with_component(reps, components(sure)), "open")
    more = confirmed(docs, crossing_pairs(open_reps, hot).join(stars, ["a", "b"], "left_anti"), threshold)
    return sure.union(more)


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, max_family: int = MAX_FAMILY, hot: int | None = None, small: int = SMALL) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is that id)."""
    sets = written(describe(docs), "sets")
    full, rows = sets.where("n_shingles > 0 and doc_id is not null"), sets.count()
    reps = written(full.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("r")).select("r.doc_id", "r.sig", "d1", "d2", "n_shingles"), "reps", rows=rows)
    stars = set_links(reps, small)
    found = components(stars).withColumnRenamed("component_id", "family")
    family = written(found.union(found.select("family", "family").distinct()), "families", rows=rows)
    size = family.join(reps.groupBy("doc_id").agg(F.sum("n_shingles").alias("n")), "doc_id").groupBy("family").agg(F.sum("n").alias("n"), F.count("*").alias("members"))
    wide = written(size.where((F.col("n") > max_family) | (F.col("members") > min(MAX_MEMBERS, max_family))).select("family"), "wide", rows=rows)
    links = family_components(docs, family.join(wide, "family", "left_anti"), threshold).where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    if not wide.isEmpty():
        some = family.join(wide, "family", "left_semi")
        links = links.union(large_families(docs, reps.select("doc_id", "sig").join(some.select("doc_id"), "doc_id"), stars.join(some.select(F.col("doc_id").alias("a")), "a", "left_semi"), threshold, hot))
    # equal doc_ids with different texts tie their sets together
    folded = full.select("doc_id", "d1", "d2", "n_shingles").join(reps.select(F.col("doc_id").alias("rep"), "d1", "d2", "n_shingles"), ["d1", "d2", "n_shingles"]).select("doc_id", "rep")
    again = folded.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    last = components(links.union(again))
    ends = folded.join(last.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("component_id", "rep").alias("component_id"))
    ends = ends.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = sets.select("doc_id", "n_shingles").join(ends, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id (null ids last).

    Where ids repeat or are null, rows are told apart by a hash of id and text, so that equal rows are copies of each
    other and rows without an id are compared like any other.
    """
    own, alone = keyed(docs)
    if alone and own.where("doc_id is null").isEmpty():
        gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
        return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)
    rows = own.select(F.xxhash64("row", "text").alias("near_row"), "doc_id", "text").dropDuplicates(["near_row"])
    part = near_duplicates(rows.select(F.col("near_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("near_row"), "component_id")
    lead = rows.select("near_row", "doc_id").join(part, "near_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "near_row")).alias("r"))
    kept = lead.select(F.col("r.near_row").alias("near_row"))
    key, name = F.xxhash64(row_key(alone), "text"), free_name("near_row", docs.columns)
    return docs.withColumn(name, key).dropDuplicates([name]).join(kept.withColumnRenamed("near_row", name).hint("merge"), name, "left_semi").select(docs.columns)
