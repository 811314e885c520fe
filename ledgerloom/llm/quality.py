"""Quality rules: learned decision lists (operator 4).

Document statistics are counted in whole texts by vectorised kernels. From labelled documents, sequential covering
grows conjunctions of thresholds on one part of the sample and prunes them on the other; the ordered rules become one
Spark conditional expression, so scoring stays in the JVM.

Null or empty texts have zero statistics (and fail the base rule). Repeated doc_ids are rows of their own. Further
columns of the input, whatever their names, are not read. Without labels of both classes the list has no rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

MAX_LABELLED = 20_000
"""Bound on the labelled sample that a list is learned from (those with the smallest hashes of doc_id)."""

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_punct", "n_lines", "n_distinct_words", "n_chars"]
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
FEATURES = {
    "symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "mean_word": ("word_chars", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"), "digit_ratio": ("n_digits", "word_chars"), "punct_ratio": ("n_punct", "word_chars"), "words_per_line": ("n_words", "n_lines"), "distinct_ratio": ("n_distinct_words", "n_words"),
}


def _among(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _UPPER, _DIGIT = _among(b"#*$%&|<>"), _among(bytes(range(65, 91))), _among(bytes(range(48, 58)))
_PUNCT = _among(b"!?.,;:")


def chunk_stats(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each document of a chunk."""
    n = len(offsets) - 1
    starts, ends, first = K.word_spans(raw, offsets)
    doc = K.doc_of(first).astype(np.uint64)
    run = K.prefix_hash(raw)
    words = K.span_hash(run, starts, ends)
    salt = K.mix(np.arange(n, dtype=np.uint64) + np.uint64(7))
    out = {"n_words": np.diff(first)}
    starts_char = (raw & 0xC0) != 0x80
    out["n_chars"] = K.per_doc(starts_char, offsets)
    out["word_chars"] = K.per_doc(starts_char & ~K._SPACE[raw], offsets)
    for name, among in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_punct", _PUNCT)):
        out[name] = K.per_doc(among[raw], offsets)
    # lines
    brk = raw == 10
    line_from, line_to, line_first = _lines(brk, offsets)
    line_doc = K.doc_of(line_first)
    in_words = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~K._SPACE[raw], out=in_words[1:])
    full = in_words[line_to] > in_words[line_from]
    out["n_lines"] = np.bincount(line_doc[full], minlength=n)
    h = K.span_hash(run, line_from[full], line_to[full]) ^ salt[line_doc[full]]
    _, at = np.unique(h, return_index=True)
    again = np.ones(len(h), bool)
    again[at] = False
    out["n_dup_lines"] = np.bincount(line_doc[full][again], minlength=n)
    # words in windows found twice
    _, at = np.unique(words ^ salt[doc], return_index=True)
    out["n_distinct_words"] = np.bincount(doc[at].astype(np.int64), minlength=n)
    w = K.window_hash(words, 5)
    ok = np.flatnonzero(K.inside_docs(first, 5, len(words)))
    _, inverse, count = np.unique(w[ok] ^ salt[doc[ok]], return_inverse=True, return_counts=True)
    hit = K.cover(ok[count[inverse] > 1], 5, len(words))
    out["n_repeat_words"] = K.per_doc(hit, first)
    return out


def _lines(brk: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each document: between newlines and document ends (an empty document has one empty line)."""
    cuts = np.flatnonzero(brk)
    line_from = np.concatenate([offsets[:-1], cuts + 1])
    line_to = np.concatenate([cuts, offsets[1:]])
    doc_from = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, cuts, "right") - 1])
    order = np.lexsort((line_from, doc_from))
    line_from, doc_from = line_from[order], doc_from[order]
    doc_to = np.concatenate([np.searchsorted(offsets, cuts, "right") - 1, np.arange(len(offsets) - 1)])
    line_to = line_to[np.lexsort((line_to, doc_to))]
    return line_from, line_to, np.searchsorted(doc_from, np.arange(len(offsets)))


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id and COUNTS for every row; the columns of docs named in `keep` are carried along as k_0, k_1, ..."""
    keep = keep or []
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)])
    fields = picked.schema.fields[2:]
    schema = STATS_SCHEMA + "".join(f", {f.name} {f.dataType.simpleString()}" for f in fields)

    def run(batches):
        for b in batches:
            parts = [chunk_stats(raw, off) for _, _, raw, off in K.chunks(b.column("text"))]
            if parts:
                cols = [b.column("doc_id")] + [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in COUNTS] + b.columns[2:]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *COUNTS, *(f.name for f in fields)])

    return picked.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '>=' or '<=', threshold) that says `low`."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, at in self.conditions:
            out = out & (feature(name) >= F.lit(at) if op == ">=" else feature(name) <= F.lit(at))
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, at in self.conditions:
            out &= x[name] >= at if op == ">=" else x[name] <= at
        return out


def _grow(x: dict, y: np.ndarray, most: int = 4) -> list[tuple[str, str, float]]:
    """Adds the condition of the best information gain until no row of the other class is covered."""
    conditions: list = []
    on = np.ones(len(y), bool)
    while len(conditions) < most and (~y[on]).any() and y[on].any():
        p0, n0 = y[on].sum(), (~y[on]).sum()
        best = (1e-9, None)
        for name, v in x.items():
            order = np.argsort(v[on], kind="stable")
            s, t = v[on][order], y[on][order]
            edge = np.flatnonzero(np.diff(s) > 0)
            cp = np.cumsum(t)[edge]
            cn = np.cumsum(~t)[edge]
            for op, p, n in (("<=", cp, cn), (">=", p0 - cp, n0 - cn)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1)
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), (name, op, float((s[edge[k]] + s[edge[k] + 1]) / 2)))
        if best[1] is None:
            break
        conditions.append(best[1])
        on = Rule(tuple(conditions)).holds(x)
    return conditions


def _prune(conditions: list, x: dict, y: np.ndarray) -> list:
    """Drops final conditions as long as precision on the pruning part doesn't fall."""

    def worth(c):
        on = Rule(tuple(c)).holds(x)
        p, n = int((y & on).sum()), int((~y & on).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = conditions
    for k in range(len(conditions) - 1, 0, -1):
        if worth(conditions[:k]) >= worth(best):
            best = conditions[:k]
    return best


def learn(x: dict[str, np.ndarray], low: np.ndarray, seed: int = 11, max_rules: int = 12, min_precision: float = 0.75) -> list[Rule]:
    """Sequential covering: an ordered list of rules for `low`. Empty without rows of both classes."""
    low = low.astype(bool)
    if not low.any() or low.all():
        return []
    part = np.random.default_rng(seed).random(len(low)) < 2 / 3
    left, rules = np.ones(len(low), bool), []
    while len(rules) < max_rules and (left & low).sum() >= 3:
        grow, prune = left & part, left & ~part
        if not (low & grow).any():
            break
        conditions = _grow({k: v[grow] for k, v in x.items()}, low[grow])
        if not conditions:
            break
        if prune.any():
            conditions = _prune(conditions, {k: v[prune] for k, v in x.items()}, low[prune])
        rule = Rule(tuple(conditions))
        on = rule.holds(x) & left
        if on.sum() == 0 or (low & on).sum() / on.sum() < min_precision:
            break
        rules.append(rule)
        left &= ~on
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learns from at most max_labelled labelled documents that the base rule passes; a doc_id counts once."""
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    sample = statistics(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), ["quality"])
    rows = sample.where(~base_failed()).select("doc_id", F.col("k_0").alias("quality"), *[feature(k).alias(k) for k in FEATURES]).toPandas().sort_values("doc_id")
    return learn({k: rows[k].to_numpy(float) for k in FEATURES}, (rows["quality"] == 0).to_numpy())


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: the number of the rule that fires, null for none."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(rules[0].column(), F.lit(1))
    for k, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(), F.lit(k))
    return out


def describe(rules: list[Rule]) -> str:
    return "\n".join(f"{k}. reject if " + " and ".join(f"{n} {o} {t:.6g}" for n, o, t in r.conditions) for k, r in enumerate(rules, 1))


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Statistics, base_failed, rule (number of the rule that rejects) and kept for every row."""
    rules = fit(docs, labels)
    out = statistics(docs, keep).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all columns of docs."""
    return judge(docs, labels, docs.columns).where("kept").select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(docs.columns)])
