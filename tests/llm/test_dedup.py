"""Substring and near-duplicate operators against brute force, on edge cases and on all code paths."""

import collections
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fmindex, neardup, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, marks string, family string, kept string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "m", "f", "k") for i, t in rows], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(400)]
    passage = [rng.choice(vocab) for _ in range(70)]
    base = [rng.choice(vocab) for _ in range(150)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        kind = i % 6
        if kind == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 20) : rng.randint(40, 70)]
        elif kind == 1:
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind == 2:
            w = w + w[: rng.randint(0, 60)] + w
        rows.append((i * 3 + 1, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(2, None), (5, ""), (8, " \n "), (11, "one two"), (14, "one two"), (17, "x " * 500), (20, "a" * 3000), (23, rows[7][1]), (26, rows[7][1]), (29, "Ab cD eF gh ij kl"), (32, "aB Cd Ef gh IJ kl")]
    return rows


def brute_words(rows, span):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - span + 1):
            k = tuple(w[s : s + span])
            if k in seen:
                gone[s : s + span] = [True] * span
            seen.add(k)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [fmindex.HOT, 3])
def test_fm_index_removes_exactly_what_repeats(spark, hot):
    rows = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fmindex.remove_repeats(docs_of(spark, rows), hot=hot).collect()}
    assert got == brute_words(rows, 20)


def test_fm_index_short_span_and_order_of_rows(spark):
    rows = corpus(3, 40)
    random.Random(0).shuffle(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fmindex.remove_repeats(docs_of(spark, rows).repartition(7), span=6, gram=3, hot=2).collect()}
    assert got == brute_words(rows, 6)


def test_fm_index_counts_like_a_scan():
    import numpy as np

    rng = np.random.default_rng(0)
    text = np.append(rng.integers(1, 5, 400), 0)
    index = fmindex.FMIndex(text, 5)
    ends = np.arange(6, 400)
    length, lo, hi = index.matches(text, ends, 6)
    assert (length == 6).all()
    for e, a, b in zip(ends[:50], lo, hi, strict=False):
        where = [i for i in range(395) if (text[i : i + 6] == text[e - 6 : e]).all()]
        assert b - a == len(where) and sorted(index.suffixes[a:b]) == where
    assert (index.first_places(lo, hi) <= ends - 6).all()


def brute_bytes(rows, span):
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[s : s + span] for s in range(len(b) - span + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - span + 1):
            if count[b[s : s + span]] > 1:
                gone[s : s + span] = b"\1" * span
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k, _ in itertools.groupby(gone) if k), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("span,gram,hot,report", [(400, 32, suffixes.HOT, 240), (60, 12, suffixes.HOT, 60), (60, 12, 2, 25), (60, 12, suffixes.HOT, 25)])
def test_suffix_runs_remove_exactly_what_repeats(spark, span, gram, hot, report):
    rows = corpus(2)
    got = suffixes.remove_strings(docs_of(spark, rows), span, gram, hot, report).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(rows, span)
    assert {r.doc_id: r.n_repeated for r in got} == {i: x[1] for i, x in brute_bytes(rows, report).items()}


def test_loser_tree_merges_and_never_goes_back():
    rng = random.Random(4)
    for k in (1, 2, 3, 5, 8):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randint(1, 12))) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        coded = [suffixes.decoded(suffixes.front_coded([(s, b"l", 1, 2, 3, 0) for s in r])) for r in runs]
        assert [[c[1] for c in run] for run in coded] == runs
        out = list(suffixes.merged(coded))
        assert [s for _, s, _ in out] == sorted(itertools.chain(*runs))
        before = None
        for lcp, s, _ in out:
            if before is not None:
                assert lcp == suffixes.common(before, s)
            before = s


def brute_near(rows):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(low).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("max_family,hot,small", [(neardup.MAX_FAMILY, None, neardup.SMALL), (100, None, 2), (100, 2, 1)])
def test_near_duplicates_find_all_components(spark, max_family, hot, small):
    rows = corpus(5, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs_of(spark, rows), max_family=max_family, hot=hot, small=small).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_null_and_equal_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(None, t), (None, t), (3, t), (3, t), (9, t + " end"), (4, "other text of some words here"), (3, "quite another text of five words")]
    out = neardup.near_duplicates(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    assert [r.component_id for r in out if r.doc_id is None] == [None, None]
    assert {r.component_id for r in out if r.doc_id in (3, 9)} == {3}
    assert [r.component_id for r in out if r.doc_id == 4] == [4]


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(None, t), (None, t), (3, t), (3, t), (9, t + " end"), (None, "a text of its own without id"), (None, None), (5, ""), (5, "")]
    out = neardup.one_of_each(docs_of(spark, rows))
    assert out.columns == docs_of(spark, []).columns
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert got == {(3, t): 1, (None, "a text of its own without id"): 1, (None, None): 1, (5, ""): 1}


def test_large_nodes_branch_until_small(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    sig = np.tile(rng.integers(0, 1 << 32, 128, dtype=np.uint32), (300, 1))
    sig[rng.random(sig.shape) < 0.14] = 7  # pairs agree in about three places of four
    reps = spark.createDataFrame([(i, bytes(x.tobytes())) for i, x in enumerate(sig)], "doc_id long, sig binary")
    links = neardup.star_links(reps, 8)
    assert links.where("a >= b").isEmpty()
    assert neardup.components(links).select("component_id").distinct().count() == 1
    path = neardup.roots(sig)
    kids, row = neardup.branches(path.ravel(), sig, np.repeat(np.arange(300), neardup.TREES))
    assert 1.1 < len(kids) / path.size < 1.6 and len(np.unique(kids)) > len(np.unique(path))


def moved(monkeypatch):
    """Gets the rows that next_nodes makes, level by level."""
    rows, move = [], neardup.next_nodes

    def counted(*a):
        out = neardup.written(move(*a), "moved")
        rows.append(out.count())
        return out

    monkeypatch.setattr(neardup, "next_nodes", counted)
    return rows


def test_near_copies_do_not_move_on_together(spark, monkeypatch):
    import numpy as np

    rng, rows = np.random.default_rng(11), moved(monkeypatch)
    sig = np.tile(rng.integers(0, 1 << 32, 128, dtype=np.uint32), (500, 1))
    change = rng.random(sig.shape) < 0.1
    for i in range(400, 500):  # a chain that leaves the others step by step
        sig[i], change[i] = sig[i - 1], rng.random(128) < 0.12
        sig[i][change[i]] = rng.integers(0, 1 << 32, int(change[i].sum()), dtype=np.uint32)
    change[400:] = False
    sig[change] = rng.integers(0, 1 << 32, int(change.sum()), dtype=np.uint32)
    sig = sig[(order := rng.permutation(500))]
    reps = spark.createDataFrame([(i, bytes(x.tobytes())) for i, x in enumerate(sig)], "doc_id long, sig binary")
    links = neardup.star_links(reps, 16)
    assert sum(rows) < 20 * 500  # 46,415 where all move on
    assert links.where("a >= b").isEmpty()
    part = dict(enumerate(range(500))) | {r.doc_id: r.component_id for r in neardup.components(links).collect()}
    alike = (sig[:, None] == sig[None, :]).sum(2) >= 96
    assert alike[order >= 400].sum() > 200 and all(part[a] == part[b] for a, b in np.argwhere(alike).tolist() if a != b)


def test_one_of_each_settles_near_copies(spark, monkeypatch):
    rng, rows = random.Random(6), moved(monkeypatch)
    base = [f"w{i}" for i in range(300)]
    near = [(i, " ".join(x if rng.random() > 0.006 else f"x{i}" for x in base)) for i in range(150)]
    out = neardup.one_of_each(docs_of(spark, near))
    assert [(r.doc_id, r.text) for r in out.collect()] == [near[0]]
    assert len({t for _, t in near}) > 2 * neardup.SMALL and sum(rows) < 20 * 150


def test_sets_that_share_an_id_are_members_of_their_own(spark, monkeypatch):
    rows, words = moved(monkeypatch), [f"w{i}" for i in range(200)]
    near = [(7, " ".join([*words[:-k], *(f"x{k}" for _ in range(k))])) for k in range(1, 13)]
    docs = [*near, (9, " ".join(words)), (3, " ".join(f"v{i}" for i in range(90))), (7, " ".join(f"u{i}" for i in range(90)))]
    out = neardup.near_duplicates(docs_of(spark, docs), small=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(3, 3), *[(7, 7)] * 13, (9, 7)]
    assert sum(rows) < 110 * 14  # 1,148,987 where each moves along the paths of all


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert fmindex.remove_repeats(none).count() == 0
    assert suffixes.remove_strings(none).count() == 0
    assert neardup.near_duplicates(none).count() == 0


def test_equal_rows_are_copies_of_one_document(spark):
    t = " ".join(f"w{i}" for i in range(60))
    out = fmindex.remove_repeats(docs_of(spark, [(1, t), (1, t), (None, t)])).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [r.n_removed for r in out] == [0, 60, 60]
    out = suffixes.remove_strings(docs_of(spark, [(1, t * 3), (1, t * 3)]), 400).collect()
    assert out[0] == out[1]


@pytest.mark.parametrize("hot", [fmindex.HOT, 2])
def test_rows_with_null_and_equal_ids_are_rows_of_their_own(spark, hot):
    long, short = " ".join(f"w{i}" for i in range(200)), " ".join(f"v{i}" for i in range(60))
    rows = [(None, long + " " + short), (None, short), (None, short), (7, "x y z " + long), (7, short + " end"), (7, short + " end"), (8, " ".join(f"u{i}" for i in range(90))), (None, None), (None, "")]
    own = lambda key: [(k, t) for k, (_, t) in enumerate(sorted(rows, key=key))]
    count = lambda xs: collections.Counter(xs)
    got = fmindex.remove_repeats(docs_of(spark, rows).repartition(5), hot=hot).collect()
    assert count(r.doc_id for r in got) == count(i for i, _ in rows)
    # one id's rows may stand in any order among themselves: what is kept of each repeated passage is one occurrence
    assert sum(r.n_words - r.n_removed for r in got) == len({w for _, t in rows for w in (t or "").split()})
    assert [(r.n_words, r.n_removed) for r in got if r.doc_id == 8] == [(90, 0)]
    assert sorted(r.n_removed for r in got if r.doc_id == 7) == [60, 61, 200]
    got = suffixes.remove_strings(docs_of(spark, rows).repartition(5), 60, 12, hot).collect()
    want = brute_bytes(own(lambda r: (r[0] is not None, r[0] or 0)), 60)
    assert count((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == count(want.values())


def test_one_of_each_leaves_columns_of_any_name_alone(spark):
    docs = spark.createDataFrame([(1, "a b c", "own", 7), (1, "a b c", "own", 7), (None, "d e f", None, 8)], "doc_id long, text string, Near_Row string, near_row_ long")
    got = sorted(map(str, neardup.one_of_each(docs).collect()))
    assert got == ["Row(doc_id=1, text='a b c', Near_Row='own', near_row_=7)", "Row(doc_id=None, text='d e f', Near_Row=None, near_row_=8)"]


def test_near_duplicates_write_few_files_for_few_rows(spark, monkeypatch):
    rows, files, write = corpus(), collections.defaultdict(int), neardup.written
    want = {tuple(r) for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}

    def counted(df, name, *a, **b):
        out = write(df, name, *a, **b)
        files[name] = len(out.inputFiles())  # of the last one: the first links are not counted yet
        return out

    monkeypatch.setattr(neardup, "written", counted)
    conf = {"spark.sql.shuffle.partitions": "33", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert {tuple(r) for r in neardup.near_duplicates(docs_of(spark, rows), small=4).collect()} == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"reps", "nodes", "sized", "members", "stars", "links", "families"} <= set(files)
    assert max(files.values()) <= 2 * spark.sparkContext.defaultParallelism, files
