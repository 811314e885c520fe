"""Centroid clustering, filter audit and license scans against brute force and on edge cases."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import filteraudit, hamerly, licenses

VECTORS = "vec_id long, embedding array<double>, cluster string, v int, label int"


def brute_clusters(rows, k, rounds, dims):
    """Lloyd's rounds with Python integers."""
    import hashlib
    import math

    kept = [(i, [max(min(math.floor(256 * x), hamerly.LIMIT), -hamerly.LIMIT) if abs(x) < 1e300 else int(math.copysign(hamerly.LIMIT, x)) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(cents)]
    return sorted((i if i is not None else -1, near(v)[1], near(v)[0]) for i, v in kept), cents


def vectors(seed, n, dims, grid):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(12)]
    point = lambda c: [(round(x * 3) / 3 if grid else x) + (0 if grid else rng.gauss(0, 0.1)) for x in c]
    return [(i, point(rng.choice(centres))) for i in range(n)]


@pytest.mark.parametrize(("grid", "dims", "k"), [(False, 8, 10), (True, 3, 9), (False, 64, 40)])
def test_clusters_match_full_scans(spark, grid, dims, k):
    bad = [(900, None), (901, []), (902, [0.0] * (dims - 1)), (903, [float("nan")] * dims), (904, [None] * dims), (905, [float("inf")] + [0.0] * (dims - 1))]
    far = [(906, [1e30] + [0.0] * (dims - 1)), (None, [0.5] * dims), (None, [0.25] * dims), (7, [0.1] * dims), (7, [0.1] * dims)]
    rows = vectors(1, 400, dims, grid) + bad + far
    df = spark.createDataFrame([(i, e, "c", 1, 0) for i, e in rows], VECTORS).repartition(5)
    out, cents = hamerly.cluster(df, k=k, rounds=5, dims=dims)
    got = out.collect()
    want, want_cents = brute_clusters(rows, k, 5, dims)
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in got) == want
    assert cents == want_cents
    assert all(1 <= r.scans <= 6 for r in got)
    if not grid:
        assert sum(r.scans for r in got) < 4 * len(got)  # bounds spare scans
    by = {}
    for _, j, d in want:
        by[j] = by.get(j, 0) + d
    for r in hamerly.clustered(df, k=k, rounds=5, dims=dims).collect():
        assert (r.cluster_inertia, r.inertia, r.centroid) == (by[r.cluster], sum(by.values()), want_cents[r.cluster])


def test_few_equal_and_no_vectors(spark):
    df = spark.createDataFrame([(i, [0.5, -0.5], "c", 1, 0) for i in range(3)], VECTORS)
    assert [(r.cluster, r.distance, r.inertia) for r in hamerly.clustered(df, k=5, dims=2).collect()] == [(0, 0, 0)] * 3
    assert hamerly.clustered(df.where("vec_id = 1"), k=5, dims=2).count() == 1
    assert hamerly.clustered(df.limit(0), dims=2).count() == 0


def test_bounds_never_lie():
    rng = np.random.default_rng(3)
    v = rng.integers(-2000, 2000, (500, 6))
    old = rng.integers(-2000, 2000, (7, 6))
    cluster, own, lower = hamerly.nearest(v, old)
    upper = np.sqrt(own.astype(float)) * (1 + 1e-12)
    for _ in range(6):
        new = old + rng.integers(-300, 300, old.shape) * (rng.random((7, 1)) < 0.5)
        cluster, upper, lower, _ = hamerly.reassigned(v, cluster, upper, lower, hamerly.Step.between(old, new))
        best, own, second = hamerly.nearest(v, new)
        assert (cluster == best).all() and (upper >= np.sqrt(own)).all() and (lower <= second * (1 + 1e-9)).all()
        old = new


def brute_audit(rows, labels):
    said = {}
    for i, q, t in labels:
        a, b = said.get(i, (0, 0))
        said[i] = (a or int(q == 1), b or int(t == 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs.append((s or "", {x for x, v in fails.items() if v}, *(said.get(i, (0, 0)) if i is not None else (0, 0))))
    out = {}
    for part in {d[0] for d in docs}:
        own, shapley = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                out[part, order, step] = [len(left), len(gone), sum(x in d[1] for d in own) - len(gone), sum(d[1] == {x} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[x] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audit_rows():
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA", "d#e", "é", "x"]) + str(rng.randint(0, 40))
    texts = [" ".join(word() for _ in range(n)) for n in (0, 3, 49, 50, 51, 80, 200)] + [None, "", "  \n\t", "A", "plain " * 60]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice([None, "", "s", "t"])) for _ in range(300)]
    return rows + [(rng.randint(0, 99), "the same text in a third of all rows", "hot") for _ in range(200)] + [(5, "one id and one text", "hot")] * 60


def test_audit_matches_every_order_played_out(spark):
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(3, 0, None), (None, 1, 1), (4, 1, 1)]
    docs = spark.createDataFrame([(*r, "m", 1) for r in rows], "doc_id long, text string, source string, mask string, pid int").repartition(6)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, labels)
    for n in ("4", "37"):  # groups of copies span many partitions
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = filteraudit.audit(filteraudit.counters(filteraudit.failure_masks(docs), said)).collect()
        assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want and len(got) == len(want)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert filteraudit.audit(filteraudit.counters(filteraudit.failure_masks(docs.limit(0)), said.limit(0))).count() == 0


def brute_licenses(text, templates, threshold):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for label, p in licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    found = []
    for t, (label, body) in enumerate(templates):
        own = licenses.normal_words(body)
        s, own_set = licenses.stride(len(own)), {w.decode() for w in own}
        for b in range(0, len(ws), s):
            shared = len(own_set & set(ws[b : b + 2 * s]))
            if own_set and shared >= licenses.need(len(own_set), threshold):
                found.append((t, label, b, min(b + 2 * s, len(ws)), shared / len(own_set)))
    labels = sorted({x for _, x in places} | {f[1] for f in found})
    score = 1.0 if places else max((f[4] for f in found), default=0.0)
    return len(ws), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places})), ",".join(labels), score, sorted(found)


@pytest.mark.parametrize("templates", [licenses.TEMPLATES, [("short", "alpha Beta"), ("one", "gamma"), ("none", "..."), ("again", "alpha beta alpha delta é9 gamma gamma")]])
def test_license_scan_matches_brute_force(spark, templates):
    rng = random.Random(6)
    vocab = ["alpha", "BETA", "gamma", "delta", "é9", "the", "of", "license", "MIT", "Apache", "general public"]
    cut = lambda t, p: " ".join(w for w in t.split() if rng.random() < p)
    noise = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [noise(rng.randint(0, 60)) + " " + cut(rng.choice(templates)[1], rng.choice([0.7, 0.85, 1.0])) + rng.choice([" ", "\n"]) + noise(rng.randint(0, 90)) for _ in range(150)]
    texts += [None, "", " . ", "mit license", "MIT-License mit license", "mit", "Apache\nLicense, GNU General Public License", "word " * 50_000, "the license " * 9_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (3, "mit license")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, labels string, score int")
    out = licenses.labelled(licenses.scan(docs, templates)).collect()
    key = lambda x: (str(x[0]), repr(x[1:]))
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, sorted((m.template, m.label, m.first_word, m.end_word, m.containment) for m in r.matches)) for r in out]
    assert sorted(got, key=key) == sorted(((i, *brute_licenses(t, templates, licenses.THRESHOLD)) for i, t in rows), key=key)
    assert sum(bool(r.matches) for r in out) > 20
    for r in out:
        for m in r.matches:
            if r.doc_id is not None and r.doc_id != 3:
                assert len(licenses.normal_words(texts[r.doc_id].encode()[m.start : m.end].decode())) == m.end_word - m.first_word
    assert licenses.scan(docs.limit(0), templates).count() == 0


def test_templates_are_bounded(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="templates"):
        licenses.scan(docs, [("big", "word " * (1 << 20))])
    assert licenses.labelled(licenses.scan(docs, [])).select(F.col("labels")).collect()[0].labels == ""
