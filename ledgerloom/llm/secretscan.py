"""Secret scans: character Markov models of random strings and of ordinary identifiers (operator 10).

Base patterns (an assigned credential, an access-key id, long hexadecimal runs) are always reported. Besides, every run
of `[A-Za-z0-9+/_=-]` of MIN_RUN characters or more is scored by two first-order character models: each character adds
its log-likelihood ratio (CLIP at most, as the models know rare pairs badly) less DRIFT. The segment of MIN_RUN or more
characters with the largest sum decides, so ordinary characters around a key don't dilute it; a sum of THRESHOLD nats or
more is a secret, nothing else gates it, and the rest of the run to both sides is searched in the same way, so several
keys of one run are all found (a round for each level of these splits).

A key is reported whole: a found segment is widened to the ends of the letters and digits it cuts, then over the next
stretch of letters and digits to either side as long as that is likelier random than ordinary (or too short to tell, or digits), and over
`+` beside it, `=` after it and whatever separators are left to the ends of the run.
Widened segments that meet are one span of kind `markov`. Where base spans cover a part of it, what is left of it is
reported, piece by piece. The models are trained from labelled samples that `labelled_samples` makes from a seed: random
strings over the usual alphabets against identifiers composed of ordinary words and counters, and repeated characters.

Null texts are empty and have no spans. Offsets are code points, the end exclusive. Runs may be of any length.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

MIN_RUN = 16
CLIP = 2.0
DRIFT = 0.25
THRESHOLD = 6.0
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_KEYS = re.compile(rb"password|passwd|secret|token|api_?key", re.IGNORECASE)
_RUN, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = True
_RUN[:] = _ALNUM
_RUN[list(b"+/_=-")] = True
# Ordinary words that identifiers are composed of in the labelled samples.
WORDS = """account address amount balance batch bucket buffer cache category chain check client column commit config
count create cursor data date delete digest document driver engine entry error event export field file filter final
format frame group handler hash header image import index input insert item join journal kernel label ledger level
line link list load local lock log match memory merge message method model module month name node number object offset
order output page parent parse part path pattern payment period plan point policy prefix price process profile query
queue random range rate receipt record region report request result return row rule sample schema scope score script
search section session shard size sort source spark split stage state status stream string table tax text thread time
total trace transfer type union update user value vendor version view window word write year der und nicht eine haus
wasser zeit strasse que para como casa tiempo agua les dans pour maison temps rue monde chose""".split()


def labelled_samples(seed: int = 5, n: int = 4000) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers)."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "-_", upper + digits, lower + digits, "0123456789abcdef", "0123456789ABCDEF"]
    secret = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 64))) for _ in range(n)]
    plain = []
    for _ in range(n):
        parts = [rng.choice(WORDS) for _ in range(rng.randint(2, 6))]
        style = rng.randrange(5)
        if style == 0:
            s = "_".join(parts)
        elif style == 1:
            s = parts[0] + "".join(p.title() for p in parts[1:])
        elif style == 2:
            s = "-".join(parts)
        elif style == 3:
            s = "_".join(parts).upper()
        else:
            s = "/".join(parts)
        tail = rng.choice(["", "", str(rng.randint(0, 99)), f"_{rng.randint(1, 9999)}", f"-{rng.randint(2000, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"_v{rng.randint(1, 20)}", f"={rng.randint(0, 100000)}"])
        plain.append(s + tail)
    for c in lower + upper + digits + "+/_=-":
        plain += [c * rng.randint(16, 40) for _ in range(n // 1000)]
    return secret, plain


def train(samples: list[str], smoothing: float = 0.5) -> np.ndarray:
    """Log transition probabilities between bytes; state 0 begins a string."""
    count = np.zeros((256, 256))
    for s in samples:
        b = np.frombuffer(b"\0" + s.encode("ascii"), np.uint8)
        np.add.at(count, (b[:-1], b[1:]), 1)
    seen = np.flatnonzero(_RUN)
    probs = np.full((256, 256), np.log(1 / len(seen)))
    rows = np.concatenate([[0], seen])
    sub = count[np.ix_(rows, seen)] + smoothing
    probs[np.ix_(rows, seen)] = np.log(sub / sub.sum(1, keepdims=True))
    return probs


_ratio: list[np.ndarray] = []


def ratio_table() -> np.ndarray:
    if not _ratio:
        secret, plain = labelled_samples()
        _ratio.append(train(secret) - train(plain))
    return _ratio[0]


def best_segments(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, start, end) of the segment of MIN_RUN or more characters of each run (as long at least) with the largest sum."""
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0), none, none
    t = ratio_table()
    before = np.concatenate([[0], raw[:-1]])
    before[starts] = 0
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.repeat(starts - first, sizes) + np.arange(sizes.sum())
    steps = np.clip(t[before[at], raw[at]], -CLIP, CLIP) - DRIFT
    run = np.repeat(np.arange(len(starts)), sizes)
    # sums within each run, before and after every character
    total = np.cumsum(steps)
    total -= np.repeat(np.concatenate([[0.0], total[first[1:] - 1]]), sizes)
    prior = total - steps
    prior[first] = 0.0
    # every run lies below the one before it, so a running minimum starts anew with each run
    below = run * (float(total.max() - min(prior.min(), 0.0)) + float(prior.max()) + 1.0)
    low = np.minimum.accumulate(prior - below)
    place = np.arange(len(steps))
    shift = np.maximum(place - (MIN_RUN - 1), 0)
    gain = np.where(place - np.repeat(first, sizes) >= MIN_RUN - 1, total - below - low[shift], -np.inf)
    best = np.maximum.reduceat(gain, first)
    hit = np.flatnonzero(gain == np.repeat(best, sizes))
    stop = hit[np.concatenate([[True], run[hit][1:] != run[hit][:-1]])]  # the first best end of each run
    begin = np.maximum.accumulate(np.where(prior - below == low, place, 0))[shift[stop]]
    return best, at[begin], at[stop] + 1


def segments(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end) of every segment that is a secret: the best of each run, then the best of what is left to both sides."""
    run = np.arange(len(starts))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(starts):
        score, s, e = best_segments(raw, starts, ends)
        ok = score >= THRESHOLD
        run, s, e = run[ok], s[ok], e[ok]
        found.append((run, s, e))
        left, right = s - starts[ok] >= MIN_RUN, ends[ok] - e >= MIN_RUN
        run, starts, ends = np.concatenate([run[left], run[right]]), np.concatenate([starts[ok][left], e[right]]), np.concatenate([s[left], ends[ok][right]])
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _likely_random(raw: np.ndarray, a: int, b: int, run_start: int) -> bool:
    """Whether the characters of [a, b) are likelier random than ordinary; digits alone or up to three characters say nothing against it."""
    if b - a <= 3 or raw[a:b].max() <= 57:
        return True
    before = np.concatenate([[0 if a == run_start else raw[a - 1]], raw[a : b - 1]])
    return float(np.clip(ratio_table()[before, raw[a:b]], -CLIP, CLIP).sum()) >= 0


def widened(raw: np.ndarray, s: int, e: int, start: int, end: int) -> tuple[int, int]:
    """A found segment of the run [start, end), to the ends of its key."""
    word = _ALNUM[raw[start:end]]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    firsts, lasts = edge[::2] + start, edge[1::2] + start  # stretches of letters and digits
    i, j = int(np.searchsorted(lasts, s, "right")), int(np.searchsorted(firsts, e, "left")) - 1
    if i <= j:
        s, e = int(firsts[i]), int(lasts[j])
    while i > 0 and _likely_random(raw, int(firsts[i - 1]), int(lasts[i - 1]), start):
        i -= 1
        s = int(firsts[i])
    while j + 1 < len(firsts) and _likely_random(raw, int(firsts[j + 1]), int(lasts[j + 1]), start):
        j += 1
        e = int(lasts[j])
    while e < end and raw[e] in (43, 61):
        e += 1
    while s > start and raw[s - 1] == 43:
        s -= 1
    # separators between a key and the end of its run belong to it
    return start if i <= 0 else s, end if j + 1 >= len(firsts) else e


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Base matches: leftmost and non-overlapping for each kind, by start, then kind as listed."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


def scan_chunk(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[list, list]]:
    """(base spans, added spans) of each document. Documents that can hold none are told apart in numpy."""
    n = len(offsets) - 1
    starts, ends, first = K.spans(_RUN[raw], offsets)
    long = np.flatnonzero(ends - starts >= MIN_RUN)
    which, s, e = segments(raw, starts[long], ends[long])
    doc = np.searchsorted(first, long, "right") - 1
    data = raw.tobytes()
    look = set(doc.tolist())
    at = offsets.tolist()
    pos = -1
    for m in _KEYS.finditer(data):
        if m.start() > pos:
            d = int(np.searchsorted(offsets, m.start(), "right")) - 1
            look.add(d)
    more: dict[int, list[tuple[int, int]]] = {}
    for k, a, b in sorted(zip(which.tolist(), s.tolist(), e.tolist(), strict=True)):
        a, b = widened(raw, a, b, int(starts[long[k]]), int(ends[long[k]]))
        spans = more.setdefault(int(doc[k]), [])
        if spans and a <= spans[-1][1]:
            spans[-1] = (min(a, spans[-1][0]), max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    out: list[tuple[list, list]] = [([], [])] * n
    for d in look:
        body = data[at[d] : at[d + 1]]
        text = body.decode()
        base = base_spans(text)
        added = []
        for a, b in more.get(d, ()):
            a, b = a - at[d], b - at[d]
            if len(text) != len(body):
                a, b = len(body[:a].decode()), len(body[:b].decode())
            for x, y, _ in base:  # by start
                if x < b and a < y:
                    if a < x:
                        added.append((a, x, "markov"))
                    a = max(a, y)
            if a < b:
                added.append((a, b, "markov"))
        out[d] = (base, added)
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def digest(base: list) -> str:
    return hashlib.sha256(listed(base).encode()).hexdigest()


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"


def scan(docs: DataFrame) -> DataFrame:
    """Spans of every document."""

    def run(batches):
        for b in batches:
            for row, end, raw, off in K.chunks(b.column("text")):
                found = scan_chunk(raw, off)
                kinds = [[k for _, _, k in base] for base, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(row, end - row), *(pa.array([k.count(x) for k in kinds], pa.int64()) for x in KINDS[:3]), pa.array([digest(base) for base, _ in found]), pa.array([listed(base + more) for base, more in found]), pa.array([len(more) for _, more in found], pa.int64())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by `mark` (overlapping spans once); a null text stays null. n_chars follows if present."""
    at_text, at_n = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            col = b.column(at_text)
            for row, end, raw, off in K.chunks(col):
                part = b.slice(row, end - row)
                found = scan_chunk(raw, off)
                if any(base or more for base, more in found):
                    new = [_redact(t, base + more, mark) if t is not None else None for t, (base, more) in zip(part.column(at_text).to_pylist(), found, strict=True)]
                    cols = list(part.columns)
                    cols[at_text] = pa.array(new, part.schema.field(at_text).type)
                    if at_n is not None:
                        old = part.column(at_n).to_pylist()
                        cols[at_n] = pa.array([len(t) if (base or more) and t is not None else o for t, o, (base, more) in zip(new, old, found, strict=True)], part.schema.field(at_n).type)
                    part = pa.RecordBatch.from_arrays(cols, schema=part.schema)
                yield part

    return docs.mapInArrow(run, docs.schema)


def _redact(text: str, spans: list, mark: str) -> str:
    if not spans:
        return text
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])
