"""Quality rules, decontamination, tokens, mixing, secrets, toxicity and PII on edge cases and against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, mixing, pii, quality, secretscan, tokens, toxicity

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, n_words string, label string"
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "é"), (5, "same line\nsame line\n\nsame line"), (5, "same line\nsame line\n\nsame line"), (None, "no id"), (7, "word " * 40_000), (8, "a#b|c <x> 100% $5 &*")]


def docs_of(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, None, source, None, "q", "w", "l") for i, t in rows], SCHEMA)


def brute_stats(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = [False] * len(w)
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(hit))


def test_quality_statistics_match_brute_force(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id % 4 = 0").collect()]
    rows = EDGE + [(i + 100, t) for i, t in real]
    got = quality.statistics(docs_of(spark, rows), ["quality", "n_words"]).collect()
    assert sorted(((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)) == sorted((i or -1, *brute_stats(t)) for i, t in rows)
    assert {(r.k_0, r.k_1) for r in got} == {("q", "w")}


def test_decision_list_separates_and_is_ordered(spark):
    rng = np.random.default_rng(0)
    x = {"a": rng.random(600), "b": rng.random(600)}
    low = (x["a"] > 0.8) | (x["b"] < 0.1)
    rules = quality.learn(x, low)
    got = np.any([r.holds(x) for r in rules], axis=0)
    assert (got == low).mean() > 0.97
    assert quality.learn(x, np.zeros(600, bool)) == []
    out = quality.judge(docs_of(spark, EDGE), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.where("kept").count() == 0 or out.where("kept and base_failed").count() == 0


def test_quality_rules_follow_the_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = quality.judge(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r.quality: r.k for r in out}
    assert kept[1] > 0.95 and kept[0] < 0.2


def brute_decontam(docs, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = norm(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, ids = norm(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    ids |= wins[k]
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out)


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 200])
def test_decontamination_matches_brute_force(spark, block):
    rng = random.Random(2)
    vocab = ["ab", "cd", "é1", "Xy", "zz9", "q"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(12)] + [(90, None), (91, ""), (92, "AB cd")]
    docs = [(i, text(rng.randint(0, 200))) for i in range(20)] + [(50, None), (51, ""), (52, items[6][1].upper()), (53, "ab cd"), (54, "xab cdx")]
    found = decontam.scan(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found) == brute_decontam(docs, items)
    for r in found:
        body = (dict(docs)[r.doc_id] or "").encode()
        assert (r.n_hit > 0) == bool(r.spans) and sum(len(decontam.normal_words(body[s.start : s.end].decode())) for s in r.spans) == r.n_hit


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 60])
def test_decontamination_rows_of_equal_ids_and_items_without_id(spark, block):
    item = lambda k: " ".join(f"{k}{i}" for i in range(12))
    items = [(1, item("a")), (None, item("b")), (3, item("c")), (None, item("a"))]
    docs = [(None, item("a") + " x"), (None, "no hit"), (None, "no hit"), (4, item("b")), (4, item("c") + " " + item("a")), (4, "no hit"), (4, "no hit"), (5, item("b")), (5, item("b"))]
    found = decontam.scan(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), len(r.spans)) for r in found)
    assert got == collections.Counter([(None, 13, 12, (1, None), 1), (None, 2, 0, (), 0), (None, 2, 0, (), 0), (4, 12, 12, (None,), 1), (4, 24, 24, (1, 3, None), 1), (4, 2, 0, (), 0), (4, 2, 0, (), 0), (5, 12, 12, (None,), 1), (5, 12, 12, (None,), 1)])
    kept = decontam.clean(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
    assert [r.text for r in kept] == ["no hit"] * 4


def test_decontamination_scans_many_items_with_int_ids(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.randint(1, 40))) for i in range(200)]
    docs = [(i, text(rng.randint(0, 40)) + " " + rng.choice(items)[1] + " unknown " + rng.choice(items)[1]) for i in range(60)]
    found = decontam.scan(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found) == brute_decontam(docs, items)


def test_decontamination_clean_keeps_columns(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    out = decontam.clean(docs_of(spark, [*EDGE, (70, "Alpha, beta; GAMMA!")]), bench)
    assert out.columns == docs_of(spark, []).columns and out.count() == len(EDGE)
    assert decontam.clean(docs_of(spark, EDGE), bench.limit(0)).count() == len(EDGE)


def test_secrets_base_rules(spark):
    hexa = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'é password = "abc123" x token:ab PASSWD=hunter22 key {hexa} AKIA{"A" * 16} AKIA12'), (2, None), (3, ""), (4, "api_key='zzzzzz' secret: tooo"), (5, "thntblere " * 3000)]
    got = {r.doc_id: r for r in secretscan.scan(docs_of(spark, rows)).collect()}
    t = rows[0][1]
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    want = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (2, 1, 1)
    assert got[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[1].spans == want
    assert got[2].spans == got[3].spans == got[5].spans == "" and got[4].n_assign == 1


def test_markov_models_tell_random_from_ordinary(spark):
    secret, plain = secretscan.labelled_samples(seed=99, n=400)
    plain = [x for x in plain if len(x) >= secretscan.MIN_RUN]
    one = lambda x: [float(v[0]) for v in secretscan.best_segments(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x)]))]
    assert np.mean([one(x)[0] >= secretscan.THRESHOLD for x in secret]) > 0.98 and np.mean([one(x)[0] >= secretscan.THRESHOLD for x in plain]) < 0.01
    letters = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=24)) for i in range(100)]
    assert np.mean([one(x)[0] >= secretscan.THRESHOLD for x in letters]) > 0.95


def test_best_segments_match_a_plain_loop():
    secret, plain = secretscan.labelled_samples(seed=7, n=30)
    runs = [x for pair in zip(secret, plain, strict=True) for x in (pair[0], pair[1], f"{pair[1]}/{pair[0]}_{pair[1]}") if len(x) >= secretscan.MIN_RUN]
    raw = np.frombuffer(" ".join(runs).encode(), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in runs]) - 1
    starts = ends - [len(x) for x in runs]
    score, begin, stop = secretscan.best_segments(raw, starts, ends)
    t = secretscan.ratio_table()
    for x, s0, got, b, e in zip(runs, starts, score, begin, stop, strict=True):
        c = x.encode()
        step = [min(max(t[0 if i == 0 else c[i - 1], c[i]], -secretscan.CLIP), secretscan.CLIP) - secretscan.DRIFT for i in range(len(c))]
        best = max(sum(step[i:j]) for i in range(len(c)) for j in range(i + secretscan.MIN_RUN, len(c) + 1))
        assert abs(best - got) < 1e-6 and abs(sum(step[b - s0 : e - s0]) - got) < 1e-6 and e - b >= secretscan.MIN_RUN


def test_markov_spans_around_base_spans(spark):
    hexa, key = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "Zk3vQ9xT7bLm2Rw8Yp4JZ"
    text = f"é total_account_balance/{key}/update and {key}{hexa}Q7xKw9ZtPq3L end"
    row = secretscan.scan(docs_of(spark, [(1, text)])).first()
    spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in row.spans.split(","))]
    at = text.index(hexa)
    assert ("hex", at, at + 40) in spans and row.n_hex == 1
    inside = [text[a:b] for k, a, b in spans if k == "markov"]
    assert inside == [key, key, "Q7xKw9ZtPq3L"]


def loop_base(text):
    """Base spans character by character, without regular expressions."""
    word = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    out, names = [], ("password", "passwd", "secret", "token", "api_key", "apikey")
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    i = 0
    while i < len(text):
        name = next((n for n in names if low.startswith(n, i)), None)
        end = None
        if name:
            j = i + len(name)
            for quote in (True, False):  # the optional quote is taken if the rest fits, as is the second one
                k = j + 1 if quote and text[j : j + 1] in ('"', "'") and text[j : j + 1] else j
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] in (":", "=") and text[k : k + 1]:
                    k += 1
                    while text[k : k + 1] == " ":
                        k += 1
                    k += text[k : k + 1] in ('"', "'") and bool(text[k : k + 1])
                    v = k
                    while v < len(text) and text[v] in word:
                        v += 1
                    if v > k:
                        end = (k, v)
                        break
        if end:
            if end[1] - end[0] >= 6:
                out.append((i, 0, end[1]))
            i = end[1]
        else:
            i += 1
    for kind, begin, chars, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), (2, "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(text):
            j = i + len(begin)
            if text.startswith(begin, i):
                while j < len(text) and text[j] in chars:
                    j += 1
            if text.startswith(begin, i) and j > i + len(begin):
                if j - i >= least:
                    out.append((i, kind, j))
                i = j
            else:
                i += 1
    return [(s, e, secretscan.KINDS[k]) for s, k, e in sorted(out)]


def test_base_spans_match_a_plain_loop(spark):
    rng = random.Random(12)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "AKIA", "é", '"', "'", ":", "=", " ", " ", "abc123", "0a1b2c3d4e5f", "XYZ0123456789ABC", "AKIAAKIA", "\n", ".", "/"]
    rows = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(400)]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for t in rows + [t for _, t in docs]:
        assert secretscan.base_spans(t) == loop_base(t)
    got = {r.doc_id: r for r in secretscan.scan(docs_of(spark, docs)).collect()}
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got.values()) > 5
    for i, t in docs:
        want = secretscan.listed(loop_base(t))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(filter(None, want.split(","))) <= set(got[i].spans.split(","))


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_no_part_of_a_found_key_stays(spark):
    rng = random.Random(11)
    key = lambda chars, n: "".join(rng.choices(chars, k=n))
    plain = [(i, f"key {key(ALNUM, 40)} end") for i in range(2000)]
    mixed = [(5000 + i, f"key {key(ALNUM + rng.choice(['+/', '-_']), rng.choice([40, 64]))} end") for i in range(1000)]
    out = {r.doc_id: r.text for r in secretscan.redacted(docs_of(spark, plain + mixed)).collect()}
    assert all(out[i] == "key [secret] end" for i, _ in plain)
    assert sum(out[i] == "key [secret] end" for i, _ in mixed) >= 980 and all("[secret]" in out[i] for i, _ in mixed)
    path = "internal/configuration/settings/directory"
    k = [key(ALNUM, 24) for _ in range(5)]
    cases = {
        f"{k[0]}/{path}/{k[1]}": f"[secret]/{path}/[secret]", f"x {k[0]}/{path}/{k[1]}/{path}/{k[2]}/{path}/{k[3]} é {k[4]}": f"x [secret]/{path}/[secret]/{path}/[secret]/{path}/[secret] é [secret]",
        "aws key wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY1": "aws key [secret]", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY": "[secret]", "id 550e8400-e29b-41d4-a716-446655440000": "id [secret]", "A" * 24: "A" * 24, "=" * 50: "=" * 50, "-" * 60: "-" * 60, path: path, "é" + path + "_2024_v3": "é" + path + "_2024_v3",
    }
    out = {r.doc_id: r.text for r in secretscan.redacted(docs_of(spark, list(enumerate(cases)))).collect()}
    assert [out[i] for i in range(len(cases))] == list(cases.values())


def test_secrets_are_redacted(spark):
    out = secretscan.redacted(docs_of(spark, [(1, "key Zk3vQ9xT7bLm2Rw8Yp4Jd6 here"), (2, None), (3, "total_account_balance_update_2024 ok")]))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "key [secret] here", 2: None, 3: "total_account_balance_update_2024 ok"}
    assert out.schema == docs_of(spark, []).schema


def test_token_histogram_is_exact(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("ab cé12\n", k=rng.randint(0, 9000)))) for i in range(40)] + [(90, None), (91, ""), (92, "<|endoftext|>")]
    enc = tokens.encoder()
    want = [len(enc.encode_ordinary(t)) if t else 0 for _, t in rows]
    sums = tokens.suffix_sums(tokens.histogram(tokens.lengths(docs_of(spark, rows))))
    got = sums.collect()
    assert {r.n_tokens: r.n_docs for r in got} == collections.Counter(want)
    for r in got:
        assert r.docs_at_least == sum(x >= r.n_tokens for x in want) and r.tokens_at_most == sum(x for x in want if x <= r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in want) and r.total_tokens == sum(want)
    assert tokens.truncated_total(sums, 700).first().tokens == sum(min(x, 700) for x in want)
    assert tokens.quantile_length(sums, 0.5).first().n_tokens == sorted(want)[(len(want) + 1) // 2 - 1]
    assert tokens.suffix_sums(tokens.histogram(tokens.lengths(docs_of(spark, [])))).count() == 0


def test_pfair_keeps_every_prefix_within_one_block(spark):
    sizes = spark.createDataFrame([("s:a", 500_000), ("s:b", 200_000), ("", 90_000), ("s:c", 10)], "source_key string, n_size long")
    units = mixing.target_units(sizes, None, 0.5, 97)
    plan = mixing.cycle_schedule(units).orderBy("cycle_slot").collect()
    total, done = plan[0].cycle_slots, collections.Counter()
    share = {r.source_key: r.units for r in plan}
    assert [r.cycle_slot for r in plan] == list(range(total)) and sum(share.values()) == total
    for r in plan:
        assert r.release <= r.cycle_slot < r.deadline
        done[r.source_key] += 1
        for s, u in share.items():
            assert abs(done[s] * total - u * (r.cycle_slot + 1)) < total


def test_mixing_keeps_all_rows_and_edge_cases(spark):
    rows = [(i, "x" * (i % 50), f"s{i % 3}") for i in range(300)] + [(None, None, None), (1, "dup", "s0"), (1, "dup", "s0"), (5, "y" * 70_000, "s1")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, text string, source string, slot string, n_size int")
    out = mixing.mix(df, block_chars=1000, keep=["doc_id", "source"])
    assert out.count() == len(rows)
    per = collections.defaultdict(list)
    for r in out.collect():
        per[r.source].append((r.block * 1000 + r.block_offset, r.n_size))
        assert r.release <= r.slot < r.deadline
    for places in per.values():
        at = 0
        for start, size in sorted(places):
            assert start == at
            at += size
    assert mixing.mix(df.limit(0)).count() == 0
    both = mixing.mix(df)  # columns of the table that have the names of added ones
    assert both.columns == [*df.columns, "mix_n_size", "block", "mix_slot", "release", "deadline", "block_offset"]
    assert both.where("slot <> 'extra' or n_size <> 1").isEmpty() and both.where("mix_slot is null").isEmpty()


def test_mixing_follows_asked_weights_exactly(spark):
    asked = {"s0": 0.5, "s1": 0.0625, None: 0.125, "s9": 0.3125, "zero": 0}
    rows = [(i, "x" * 100, ["s0", "s1", None, "s9", "zero", "unnamed"][i % 6]) for i in range(1200)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=asked, block_chars=100).collect()
    assert len(out) == len(rows)
    assert all(r.slot is None and r.block is None for r in out if r.source in ("zero", "unnamed"))
    slots = {r.slot: r.source for r in out if r.slot is not None}
    done = collections.Counter()
    for t in range(380):  # until the largest share is used up
        done[slots[t]] += 1
        assert all(abs(done[s] - w * (t + 1)) < 1 for s, w in asked.items() if w)
    assert mixing.exact_units({"a": 1, "b": 0, "c": 2}) == {"a": 1, "c": 2}
    assert mixing.exact_units({"a": 1 / 3, "b": 0.5}, 1000) == {"a": 400, "b": 600}


def test_mixing_plan_without_sources_of_the_table(spark):
    out = mixing.mix(spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string"), weights={"b": 1.0}).collect()
    assert [(r.doc_id, r.slot) for r in out] == [(1, None)]


def test_toxicity_held_out_accuracy_and_gradients(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    net = toxicity.fit(docs, labels, 1500)
    rows = toxicity.score(docs.join(labels.where(toxicity.held_out()), "doc_id"), net).join(labels, "doc_id").collect()
    y, s = np.array([r.toxic for r in rows], bool), np.array([r.score for r in rows])
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.9 and ((s >= 0.5) == y).mean() > 0.95
    edge = toxicity.score(docs_of(spark, EDGE), net).collect()
    assert len(edge) == len(EDGE) and all(0 <= r.score <= 1 for r in edge)
    assert {r.score for r in toxicity.toxicity(docs_of(spark, EDGE), labels.limit(0)).collect()} == {0.0}


def test_toxicity_trains_on_six_thousand_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, natural, *a: seen.append(len(texts)))
    rows = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), (F.col("id") % 2).cast("int").alias("toxic"))
    toxicity.fit(rows, rows)
    assert seen == [6000]


def test_toxicity_gradients_are_right():
    rng = np.random.default_rng(0)
    n = lambda *s: rng.standard_normal(s) * 0.5
    h, e, a = toxicity.HIDDEN, toxicity.EMBED, toxicity.ATTEND
    p = {"embed": n(31, e), "in": n(e, 6 * h), "bias": n(6 * h), "uf": n(h, 3 * h), "ub": n(h, 3 * h), "att": n(2 * h, a), "att0": n(a), "attv": n(a), "out": n(2 * h), "out0": n(1)}
    p["embed"][0] = 0
    net = toxicity.Network(np.sort(rng.integers(1, 1 << 60, 30).astype(np.uint64)), p)
    units, mask, y, w = rng.integers(1, 31, (32, 5, toxicity.N_UNITS)), np.arange(32)[:, None] < np.array([32, 7, 1, 20, 0])[None], np.array([1, 0, 1, 0, 1], bool), np.ones(5)
    g = net.gradients(units, mask, y, w)[1]
    for k in p:
        i = (int(units[0, 0, 0]), 1) if k == "embed" else tuple(rng.integers(0, d) for d in p[k].shape)
        old, step = p[k][i], 1e-2
        p[k][i] = old + step
        up = net.gradients(units, mask, y, w)[0]
        p[k][i] = old - step
        down = net.gradients(units, mask, y, w)[0]
        p[k][i] = old
        assert abs(g[k][i] - (up - down) / (2 * step)) < 2e-4 + 0.02 * abs(g[k][i])


TEXT = "Ask Mrs. Anna Maria Smith or MR JOHN DOE, anna.smith9@mail3.example.com and ANNA.SMITH9@MAIL3.EXAMPLE.COM; Mr John Doe calls +1 (017) 555-7713 or 4111 1111 1111 1111 / 4111111111111111, id 123-45-6789, host 169.122.221.182. Г-жа Анна Петрова."


def test_pii_surrogates(spark):
    rows = [(1, TEXT), (1, TEXT), (2, None), (3, ""), (4, "nothing here"), (None, "mail a@b.co"), (6, "mail a@b.co " * 5000), (7, "10.1.2.3.4 and 1.2.3.4")]
    out = {r.doc_id: r for r in pii.pseudonymised(docs_of(spark, rows)).collect()}
    assert pii.pseudonymised(docs_of(spark, rows)).count() == len(rows)
    new = out[1].text
    for gone in ("anna.smith9", "4111", "555-7713", "123-45-6789", "169.122", "Smith", "DOE", "Петрова"):
        assert gone not in new
    first, last = re.search(r"MR ([A-Z]+) ([A-Z]+)", new).groups()
    assert f"Mr {first.title()} {last.title()}" in new and first.title() in pii.POOLS["m_latin"]
    assert re.search(r"Mrs\. (\w+) (\w+) (\w+)", new)[1] in pii.POOLS["f_latin"]
    assert re.search(r"Г-жа (\w+)", new)[1] in pii.POOLS["f_cyrillic"]
    spaced, joined = re.search(r"or (\d{4} \d{4} \d{4} \d{4}) / (\d{16})", new).groups()
    assert spaced.replace(" ", "") == joined
    digits = [int(c) for c in joined[::-1]]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert out[2].text is None and out[3].text == "" and out[4].text == "nothing here"
    mail = out[None].text.split()[1]
    assert out[6].text == f"mail {mail} " * 5000 and mail.endswith(".co")
    assert out[7].text.startswith("10.1.2.3.4 and 10.")
    assert pii.pseudonymised(docs_of(spark, [])).count() == 0


def test_pii_surrogates_keep_country_codes_and_do_not_run_out(spark):
    rows = [(1, "call +1 415 555 7713"), (2, "call +358 40 123 4567"), (3, "call +49 30 1234 5678")]
    out = {r.doc_id: r.text for r in pii.pseudonymised(docs_of(spark, rows)).collect()}
    for (i, t), code in zip(rows, ("+1 ", "+358 ", "+49 "), strict=True):
        assert out[i].startswith("call " + code) and out[i] != t and re.sub("[0-9]", "0", out[i]) == re.sub("[0-9]", "0", t)
    nets = lambda attempt: {r.x.split(".")[0] for r in spark.range(200).select(pii.drawn(F.lit("ip"), F.col("id").cast("string"), F.lit(attempt), "k").alias("x")).collect()}
    assert nets(0) == {"10"} and all(int(x) >= 240 for x in nets(9)) and len(nets(9)) > 8 and len(nets(30)) > 60


def test_pii_surrogates_are_distinct_and_keyed(spark):
    rows = [(i, f"Mr {a}{b} and x{i}@y.org") for i, (a, b) in enumerate((a, b) for a in "ABCDEFGHIJ" for b in ("an", "er", "os", "il"))]
    ents = pii.pseudonymised(docs_of(spark, rows))
    names = [r.text.split(" ")[1] for r in ents.collect()]
    assert len(set(names)) == len(rows) and not set(names) & {t.split(" ")[1] for _, t in rows}
    other = pii.pseudonymised(docs_of(spark, rows), key="other").collect()
    assert {r.text for r in other} != {r.text for r in ents.collect()}


def test_mixing_keeps_columns_of_the_names_it_adds(spark):
    docs = spark.createDataFrame([(1, "abc", "s", "x", "y")], "doc_id long, text string, source string, Slot string, mix_slot string")
    out = mixing.mix(docs)
    row = out.first()
    assert (row["Slot"], row["mix_slot"], row["mix_slot_"]) == ("x", "y", 0) and len({c.lower() for c in out.columns}) == len(out.columns)


def test_pii_names_are_coreferent(spark):
    rows = [(1, "Mr John Smith met Mr Smith and MR JOHN SMITH; Dr Smith, Prof. Jane Smith, Mrs Jane Smith-Jones, Mr Jones"), (2, "Mr. John Doe and Mr Smith"), (3, "Frau Анна Петрова, Г-н Петрова, Dr Анна Петрова")]
    out = {r.doc_id: r for r in pii.pseudonymised(docs_of(spark, rows)).collect()}
    a, b, c = (out[i].text for i in (1, 2, 3))
    assert (out[1].n_person, out[2].n_person, out[3].n_person) == (7, 2, 3)
    first, last = re.match(r"Mr (\w+) (\w+) met", a).groups()
    assert f"met Mr {last} and MR {first.upper()} {last.upper()}; Dr {last}, Prof. " in a and b == f"Mr. {first} {b.split()[2]} and Mr {last}"
    assert not re.search("(?i)john|smith|jane|jones|doe", a + b)
    other = re.search(r"Mrs (\w+) (\w+), Mr (\w+)$", a).groups()
    assert len({last, other[1], other[2], b.split()[2]}) == 4 and other[0] != first  # distinct names stay distinct
    family = c.split(",")[0].split()[-1]
    assert c.split(",")[1] == f" Г-н {family}" and c.endswith(family) and re.search(r"[А-Яа-я]", family) and not re.search("Петрова|Анна", c)


def iban_right(x):
    x = x.replace(" ", "")
    return int("".join(str(int(ch, 36)) for ch in x[4:] + x[:4])) % 97 == 1


def test_pii_account_numbers_keep_form_and_check_digits(spark):
    good = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FR14 2004 1010 0505 0001 3M02 606", "NL91 ABNA 0417 1643 00", "ES91 2100 0418 4502 0005 1332", "CH93 0076 2011 6238 5295 7", "BE68 5390 0754 7034", "IT60 X054 2811 1010 0000 0123 456", "AT61 1904 3002 3457 3201"]
    bad = ["DE88 3704 0044 0532 0130 00"]
    rows = [(i, f"pay {x} now") for i, x in enumerate(good + bad)] + [(50, "DE89370400440532013000 or DE89 3704 0044 0532 0130 00, code AB12 CDEF GHIJ")]
    out = {r.doc_id: r for r in pii.pseudonymised(docs_of(spark, rows)).collect()}
    shape = lambda x: re.sub("[0-9]", "0", re.sub("[A-Z]", "A", x))
    for i, x in enumerate(good + bad):
        new = out[i].text[4:-4]
        assert out[i].n_iban == 1 and new != x and new[:2] == x[:2] and shape(new) == shape(x) and iban_right(x) == iban_right(new) == (i < len(good))
    plain, spaced = re.match(r"(\S+) or (.+), code AB12 CDEF GHIJ$", out[50].text).groups()
    assert plain == spaced.replace(" ", "") == out[0].text[4:-4].replace(" ", "")
