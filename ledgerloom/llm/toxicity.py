"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy (operator 7).

A word (letters and digits, A-Z lower-cased) enters as the sum of its word vector and of the vectors of its character
grams (starts of 4, 5, 6 and 8 bytes, end of 4 bytes); units that fewer than MIN_DOCS training documents hold have no
vector. Two gated recurrent layers read windows of WINDOW words in both directions, attention pools their states, and
a linear unit scores the window. Every window (they overlap by half) of the whole text is scored; a document's score is
the calibrated largest one.

Training: at most MAX_TRAIN labelled documents (half of each class where there are enough; texts of more than
MAX_TRAIN_CHARS characters are left out of the sample), never a held-out one (crc32 of doc_id as text mod 5 = 0). The
network learns from the window of each document that scores highest, which is chosen anew after each round; the first
choice follows from log-odds of the units. Labels, language, source and doc_id are no inputs.

Null and empty texts are one window without words and get the network's score for it. Without labels of both classes
every score is 0. Rows with equal doc_id are scored each; contradicting labels of one doc_id count as toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

WINDOW = 32
STEP = 16
HIDDEN = 8
EMBED = 8
ATTEND = 8
MIN_DOCS = 4
MAX_TRAIN = 6000
MAX_TRAIN_CHARS = 200_000
ROUNDS = 4
EPOCHS = 3
STARTS = (4, 5, 6, 8)
END = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
N_UNITS = 2 + len(STARTS)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def word_units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the units of each distinct word: words x N_UNITS, number of each word, first word of each document)."""
    low = _LOWER[raw]
    starts, ends, first = K.spans(_LETTER[low], offsets)
    run = K.prefix_hash(low)
    _, at, inverse = np.unique(K.span_hash(run, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[at], ends[at]
    cols = [K.span_hash(run, s, e)]
    for size in STARTS:
        h = K.span_hash(run, s, np.minimum(s + size, e)) ^ np.uint64(0xABCD)
        cols.append(np.where(e - s >= size, h, np.uint64(0)))
    h = K.span_hash(run, np.maximum(e - END, s), e) ^ np.uint64(0x1234)
    cols.append(np.where(e - s >= END, h, np.uint64(0)))
    return np.stack(cols, 1), inverse, first


def window_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, document) of all windows; a document without words has one of none."""
    n = np.diff(first)
    count = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // STEP) + 1)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][doc] + k * STEP
    return start, np.minimum(first[1:][doc] - start, WINDOW), doc


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """known: sorted hashes of units with vectors; row k + 1 of `embed` is known[k]'s, row 0 is zero."""

    known: np.ndarray
    p: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)

    def ids(self, units: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, units), len(self.known) - 1)
        return np.where(self.known[at] == units, at + 1, 0)

    def projected(self, ids: np.ndarray) -> np.ndarray:
        """Input of both layers' gates for each distinct word, given the numbers of its units (last row: no word)."""
        table = self.p["embed"] @ self.p["in"]
        out = np.repeat(self.p["bias"][None], len(ids) + 1, 0).astype(np.float32)
        for k in range(ids.shape[1]):
            out[:-1] += table[ids[:, k]]
        return out

    def window_logits(self, projected: np.ndarray, words: np.ndarray, start: np.ndarray, size: np.ndarray, batch: int = 4096) -> np.ndarray:
        out = np.empty(len(start), np.float32)
        words = np.append(words, len(projected) - 1)
        for a in range(0, len(start), batch):
            s, n = start[a : a + batch], size[a : a + batch]
            t = np.arange(WINDOW)
            mask = t[:, None] < n[None]
            ids = words[np.where(mask, s[None] + t[:, None], len(words) - 1)]
            out[a : a + batch] = self.forward(projected, ids, mask)[0]
        return out

    def forward(self, projected: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; ids and mask are steps x windows."""
        p, (steps, m), h3 = self.p, ids.shape, 3 * HIDDEN
        states = np.zeros((steps, m, 2 * HIDDEN), np.float32)
        cache: dict = {"f": [None] * steps, "b": [None] * steps}
        for way, order, cols in (("f", range(steps), slice(0, h3)), ("b", range(steps - 1, -1, -1), slice(h3, 2 * h3))):
            u, h = p["u" + way], np.zeros((m, HIDDEN), np.float32)
            side = projected[:, cols]
            place = slice(0, HIDDEN) if way == "f" else slice(HIDDEN, 2 * HIDDEN)
            for t in order:
                x, g = side[ids[t]], h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                new = n + z * (h - n)
                on = mask[t][:, None]
                if keep:
                    cache[way][t] = (h, z, r, n, g[:, 2 * HIDDEN :])
                h = np.where(on, new, h)
                states[t, :, place] = h
        a = np.tanh(states @ p["att"] + p["att0"])
        score = np.where(mask, a @ p["attv"], np.float32(-1e9))
        w = np.exp(score - score.max(0))
        w = np.where(mask, w, 0)
        w = w / np.maximum(w.sum(0), 1e-9)
        pooled = (w[..., None] * states).sum(0)
        logit = pooled @ p["out"] + p["out0"][0]
        return logit, (states, a, w, pooled, cache)

    def gradients(self, units: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients on windows; units: steps x windows x N_UNITS numbers of vectors."""
        p, (steps, m), h3 = self.p, mask.shape, 3 * HIDDEN
        x_all = p["embed"][units].sum(2)
        flat = (x_all.reshape(-1, EMBED) @ p["in"] + p["bias"]).astype(np.float32)
        ids = np.arange(steps * m).reshape(steps, m)
        logit, (states, a, w, pooled, cache) = self.forward(flat, ids, mask, keep=True)
        prob = _sigmoid(logit)
        loss = float(-(weight * np.where(target, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))).sum() / weight.sum())
        d = (weight * (prob - target) / weight.sum()).astype(np.float32)
        g = {"out": pooled.T @ d, "out0": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * p["out"][None]
        d_states = w[..., None] * d_pooled[None]
        d_w = (states * d_pooled[None]).sum(2)
        d_score = w * (d_w - (w * d_w).sum(0))
        g["attv"] = np.einsum("tma,tm->a", a, d_score)
        d_a = d_score[..., None] * p["attv"] * (1 - a * a)
        g["att"] = states.reshape(-1, 2 * HIDDEN).T @ d_a.reshape(-1, ATTEND)
        g["att0"] = d_a.sum((0, 1))
        d_states = d_states + d_a @ p["att"].T
        d_flat = np.zeros((steps, m, 2 * h3), np.float32)
        for way, order, cols, place in (("f", range(steps - 1, -1, -1), slice(0, h3), slice(0, HIDDEN)), ("b", range(steps), slice(h3, 2 * h3), slice(HIDDEN, 2 * HIDDEN))):
            u, back, du = p["u" + way], np.zeros((m, HIDDEN), np.float32), np.zeros_like(p["u" + way])
            for t in order:
                h, z, r, n, gn = cache[way][t]
                total = d_states[t, :, place] + back
                on = mask[t][:, None]
                dn_h = np.where(on, total, 0)
                dz, dn = dn_h * (h - n) * z * (1 - z), dn_h * (1 - z) * (1 - n * n)
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], 1)
                d_flat[t, :, cols] = np.concatenate([dz, dr, dn], 1)
                du += h.T @ dg
                back = np.where(on, dn_h * z, total) + dg @ u.T
            g["u" + way] = du
        df = d_flat.reshape(-1, 2 * h3)
        g["in"] = x_all.reshape(-1, EMBED).T @ df
        g["bias"] = df.sum(0)
        dx = df @ p["in"].T
        de = np.zeros_like(p["embed"])
        for k in range(units.shape[2]):
            np.add.at(de, units[:, :, k].ravel(), dx)
        de[0] = 0
        g["embed"] = de
        return loss, g

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * logit.astype(float) + b, -30, 30)))


class _Sample:
    """Training documents cut into windows once; `parts` are the chunks, so nothing is expanded for all at once."""

    def __init__(self, texts: list[str]):
        units, words, firsts, base, at = [], [], [np.zeros(1, np.int64)], 0, 0
        self.parts: list[tuple[int, int, int, int]] = []
        for _, _, raw, off in K.chunks(pa.array(texts, pa.string())):
            u, w, f = word_units(raw, off)
            self.parts.append((base, base + len(u), at, at + len(w)))
            units.append(u)
            words.append((w + base).astype(np.int32))
            firsts.append(f[1:] + at)
            base, at = base + len(u), at + len(w)
        self.units, self.words, self.first = np.concatenate(units), np.concatenate(words), np.concatenate(firsts)
        self.start, self.size, self.doc = window_starts(self.first)
        self.begin = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def scores(self, net: Network, ids: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), np.float32)
        for lo, hi, a, b in self.parts:
            w = slice(np.searchsorted(self.start, a), np.searchsorted(self.start, b)) if b > a else slice(0, 0)
            out[w] = net.window_logits(net.projected(ids[lo:hi]), self.words[a:b] - lo, self.start[w] - a, self.size[w])
        none = self.size == 0
        if none.any():
            out[none] = net.window_logits(net.projected(ids[:0]), self.words[:0], np.zeros(int(none.sum()), np.int64), self.size[none])
        return out


def log_odds(s: _Sample, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of units in MIN_DOCS documents or more, their log-odds in toxic against other documents)."""
    doc = K.doc_of(s.first).astype(np.int32)
    total, all_pos, parts = len(toxic), toxic.sum(), []
    for k in range(N_UNITS):
        h = s.units[:, k][s.words]
        on = h != 0
        h, d = h[on], doc[on]
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.append(cut, len(h)))
        pos = np.add.reduceat(toxic[d].astype(np.int64), cut) if len(cut) else n
        enough = n >= MIN_DOCS
        parts.append((h[cut][enough], (np.log((pos + 0.5) / (all_pos + 1)) - np.log((n - pos + 0.5) / (total - all_pos + 1)))[enough]))
    known, at = np.unique(np.concatenate([h for h, _ in parts]), return_index=True)
    return known, np.concatenate([o for _, o in parts])[at]


def train(texts: list[str], toxic: np.ndarray, natural: float, seed: int = 3) -> Network | None:
    """natural: share of toxic documents outside the sample, for calibration."""
    toxic = toxic.astype(bool)
    if not toxic.any() or toxic.all():
        return None
    s, rng = _Sample(texts), np.random.default_rng(seed)
    known, odds = log_odds(s, toxic)
    if not len(known):
        known, odds = np.zeros(1, np.uint64), np.zeros(1)
    n = lambda *shape, size=0.1: (rng.standard_normal(shape) * size).astype(np.float32)
    p = {"embed": n(len(known) + 1, EMBED, size=0.02), "in": n(EMBED, 6 * HIDDEN, size=0.3), "bias": np.zeros(6 * HIDDEN, np.float32), "uf": n(HIDDEN, 3 * HIDDEN, size=0.3), "ub": n(HIDDEN, 3 * HIDDEN, size=0.3), "att": n(2 * HIDDEN, ATTEND, size=0.4), "att0": np.zeros(ATTEND, np.float32), "attv": n(ATTEND, size=0.4), "out": n(2 * HIDDEN, size=0.4), "out0": np.zeros(1, np.float32)}
    p["embed"][1:, 0] = 0.2 * np.where(odds > 2, odds, 0)
    p["embed"][0] = 0
    net = Network(known, p)
    ids = np.concatenate([net.ids(s.units[lo:hi]).astype(np.int32) for lo, hi, _, _ in s.parts])
    s.units = s.units[:0]
    power = np.append(0.0, np.where(odds > 2, odds, 0))[ids].max(1)[s.words]
    cum = np.append(0, np.cumsum(power))
    score = cum[s.start + s.size] - cum[s.start]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    weight = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean())).astype(np.float32)
    full_ids = np.concatenate([ids, np.zeros((1, N_UNITS), ids.dtype)])
    words = np.append(s.words, np.int32(len(ids)))
    t = np.arange(WINDOW)[:, None]
    for turn in range(ROUNDS + 1):
        if turn:
            score = s.scores(net, ids)
        order = np.lexsort((-score, s.doc))
        best = order[s.begin[:-1]]  # the highest window of each document
        if turn == ROUNDS:
            break
        chance = rng.integers(s.begin[:-1], s.begin[1:])  # and a clean document's any other one
        pick = np.concatenate([best, chance[~toxic]])
        y, wt = np.concatenate([toxic, np.zeros((~toxic).sum(), bool)]), np.concatenate([weight, weight[~toxic]])
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(pick)), max(1, len(pick) // 128)):
                w = pick[part]
                mask = t < s.size[w][None]
                units = full_ids[words[np.where(mask, s.start[w][None] + t, len(words) - 1)]]
                _, g = net.gradients(units, mask, y[part], wt[part])
                step += 1
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                for k, v in g.items():
                    v = v * min(1.0, 5.0 / (norm + 1e-9))
                    m1, m2 = moment[k]
                    m1 += 0.1 * (v - m1)
                    m2 += 0.001 * (v * v - m2)
                    rate = 0.01 * (1 - 0.8 * turn / ROUNDS)
                    p[k] -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-7)
    top = score[best].astype(float)
    # logistic calibration with the classes in their natural proportion
    w = np.where(toxic, natural / toxic.mean(), (1 - natural) / (1 - toxic.mean()))
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
        ga, gb = (w * (q - toxic) * top).sum() + 0.05 * (a - 1), (w * (q - toxic)).sum()
        v = w * q * (1 - q) + 1e-6
        haa, hab, hbb = (v * top * top).sum() + 0.05, (v * top).sum(), v.sum()
        det = haa * hbb - hab * hab + 1e-9
        a, b = a - 0.5 * (hbb * ga - hab * gb) / det, b - 0.5 * (haa * gb - hab * ga) / det
    net.scale = (float(max(a, 0.05)), float(b))
    return net


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Network | None:
    """Trains on at most max_train labelled documents that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    count = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = count.get(1, 0), count.get(0, 0)
    if not pos or not neg:
        return None
    half = max_train // 2
    n_pos = min(pos, max(half, max_train - neg))
    parts = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k) for v, k in ((1, n_pos), (0, max_train - n_pos))]
    picked = parts[0].union(parts[1])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= MAX_TRAIN_CHARS)
    rows = own.join(F.broadcast(picked), "doc_id").orderBy("doc_id", "text").limit(2 * max_train).collect()
    return train([r.text for r in rows], np.array([r.toxic for r in rows], bool), pos / (pos + neg)) if rows else None


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, n_windows, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = sent.value
        for b in batches:
            for row, end, raw, off in K.chunks(b.column("text")):
                units, words, first = word_units(raw, off)
                start, size, doc = window_starts(first)
                if net is None:
                    out = np.zeros(end - row)
                else:
                    logit = net.window_logits(net.projected(net.ids(units)), words, start, size)
                    out = net.calibrated(np.maximum.reduceat(logit, np.searchsorted(doc, np.arange(end - row))))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, end - row), pa.array(np.bincount(doc, minlength=end - row)), pa.array(out)], ["doc_id", "n_windows", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_windows long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), "n_windows")
