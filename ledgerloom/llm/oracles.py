"""SQL twins (DuckDB) of the operators that SQL can express over whole tables."""

from __future__ import annotations

from . import decontam, hamerly, licenses, mixing

WORD = r"[^\x20\x09-\x0D]+"
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LOW_TEXT = LOW.format("coalesce(text, '')")

OP2 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
 g AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, ws FROM d WHERE len(ws) >= 20),
 f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY doc_id, s) > 1 AS again FROM g),
 w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
 x AS (SELECT w.doc_id, w.i, w.w, coalesce(max(CASE WHEN f.again THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM w LEFT JOIN f ON f.doc_id = w.doc_id AND f.s = w.i),
 r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM x GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""

OP5 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOW_TEXT}, '{WORD}') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0))),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
 u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 w AS (SELECT a AS id, a AS r FROM u UNION SELECT w.id, u.b FROM w JOIN u ON u.a = w.r),
 m AS (SELECT id, min(r) AS c FROM w GROUP BY id)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.doc_id"""

_ITEM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP6 = f"""WITH b AS (SELECT item_id, regexp_extract_all({LOW_TEXT}, '{_ITEM}') AS ws FROM benchmark),
 k AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS k FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
 d AS (SELECT doc_id, regexp_extract_all({LOW_TEXT}, '{_ITEM}') AS ws FROM documents),
 g AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k))),
 h AS (SELECT g.doc_id, g.i, g.n, k.item_id FROM g JOIN k ON k.k = g.k AND k.n = g.n),
 c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS j FROM h) GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s:' || source, '') AS key, CAST(length(coalesce(text, '')) AS BIGINT) AS n_size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
 w AS (SELECT key, pow(greatest(sum(n_size), 1), {mixing.ALPHA}) AS w FROM d GROUP BY key),
 u AS (SELECT key, CAST(greatest(floor(w * {mixing.CYCLE} / (SELECT sum(w) FROM w) + 0.5), 1) AS BIGINT) AS units FROM w),
 par AS (SELECT list(units ORDER BY key) AS us, list(key ORDER BY key) AS ks, CAST(sum(units) AS BIGINT) AS a FROM u),
 sim AS (SELECT CAST(-1 AS BIGINT) AS t, list_transform(us, lambda x: CAST(0 AS BIGINT)) AS done, CAST(-1 AS BIGINT) AS m FROM par
  UNION ALL SELECT t + 1, list_transform(done, lambda x, i: x + CASE WHEN i - 1 = pick % 65536 THEN 1 ELSE 0 END), pick FROM
  (SELECT t, done, list_min(list_transform(us, lambda x, i: CASE WHEN done[i] < x AND (done[i] * a) // x <= t + 1 THEN ((done[i] + 1) * a + x - 1) // x * 65536 + i - 1 ELSE 9000000000000000 END)) AS pick FROM sim, par WHERE t + 1 < a)),
 plan AS (SELECT ks[m % 65536 + 1] AS key, us[m % 65536 + 1] AS units, a, done[m % 65536 + 1] - 1 AS k, t AS slot, m // 65536 AS deadline FROM sim, par WHERE t >= 0),
 b AS (SELECT *, coalesce(sum(n_size) OVER (PARTITION BY key ORDER BY o, n_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM d),
 z AS (SELECT *, CAST(s // {mixing.BLOCK_CHARS} AS BIGINT) AS block FROM b)
 SELECT doc_id, source, n_size, block, block // units * a + slot AS slot, block // units * a + (k * a) // units AS release, block // units * a + deadline AS deadline, CAST(s % {mixing.BLOCK_CHARS} AS BIGINT) AS block_offset
 FROM z JOIN plan ON plan.key = z.key AND plan.k = z.block % plan.units"""


def _clusters() -> str:
    """Lloyd's rounds with full scans, written out one after another."""
    d = "CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({hamerly.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {hamerly.DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {hamerly.DIMS}),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('{hamerly.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT {hamerly.K}))"""
    for i in range(hamerly.ROUNDS + 1):
        out += f""",
 a{i} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, CAST(arg_min(k, d * {hamerly.K} + k) AS BIGINT) AS k, min(d) AS d FROM (SELECT row, vec_id, v, k, {d} AS d FROM v, c{i}) GROUP BY row)"""
        if i < hamerly.ROUNDS:
            out += f""",
 m{i} AS (SELECT k, list(s ORDER BY i) AS c FROM (SELECT k, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS s FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY k, i) GROUP BY k),
 c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON m{i}.k = c{i}.k)"""
    n = hamerly.ROUNDS
    return f"""{out}
 SELECT vec_id, CAST(a{n}.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{n}.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{n} JOIN c{n} ON c{n}.k = a{n}.k"""


OP11 = _clusters()

_FAILS = """CAST(len(ws) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INTEGER) + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS INTEGER)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER)"""
OP12 = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
 m AS (SELECT doc_id, part, {_FAILS} AS mask FROM d),
 y AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS q, max(CAST(toxic = 1 AS INTEGER)) AS x FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
 c AS (SELECT part, mask, count(*) AS n, sum(coalesce(q, 0)) AS good, sum(coalesce(x, 0)) AS toxic FROM m LEFT JOIN y ON y.doc_id = m.doc_id GROUP BY part, mask),
 f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(letter, bit)),
 o AS (SELECT '' AS o, 0 AS used UNION ALL SELECT o || letter, used + bit FROM o, f WHERE used & bit = 0),
 s AS (SELECT o AS filter_order, step, substr(o, step, 1) AS letter FROM (SELECT o FROM o WHERE used = 31), range(1, 6) r(step)),
 p AS (SELECT s.filter_order, s.step, f.bit, CAST(coalesce((SELECT sum(bit) FROM f b WHERE instr(s.filter_order, b.letter) < s.step), 0) AS INTEGER) AS before FROM s JOIN f ON f.letter = s.letter),
 z AS (SELECT part, filter_order, step, any_value(p.bit) AS bit, {{sums}} FROM c, p GROUP BY part, filter_order, step)
 SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM z"""
_SUMS = {
    "kept": ("mask & (before | p.bit) = 0", "n"), "removed": ("mask & before = 0 AND mask & p.bit <> 0", "n"), "redundant": ("mask & before <> 0 AND mask & p.bit <> 0", "n"), "unique_fails": ("mask = p.bit", "n"),
    "good_lost": ("mask & before = 0 AND mask & p.bit <> 0", "good"), "toxic_lost": ("mask & before = 0 AND mask & p.bit <> 0", "toxic"),
}
OP12 = OP12.replace("{sums}", ", ".join(f"CAST(coalesce(sum({v}) FILTER ({cond}), 0) AS BIGINT) AS {name}" for name, (cond, v) in _SUMS.items()))


def _licenses() -> str:
    """All blocks against all templates that share a word with them, without any filter."""
    rows = []
    for t, (label, text) in enumerate(licenses.TEMPLATES):
        ws = [w.decode() for w in decontam.normal_words(text)]
        own = sorted(set(ws))
        rows += [f"({t}, '{label}', {licenses.stride(len(ws))}, {licenses.need(len(own))}, {len(own)}, '{w}')" for w in own]
    at = lambda phrase: " AND ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(phrase.split()))
    kinds = " ".join(f"WHEN {at(p)} THEN '{label}'" for label, p in licenses.PHRASES.items())
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOW_TEXT}, '{_ITEM}') AS ws FROM documents),
 w AS (SELECT doc_id, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
 b AS (SELECT doc_id, i - 1 AS p, label FROM (SELECT doc_id, i, CASE {kinds} END AS label FROM w) WHERE label IS NOT NULL),
 g AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word FROM b GROUP BY doc_id),
 t AS (SELECT * FROM (VALUES {", ".join(rows)}) t(template, label, s, need, n, w)),
 h AS (SELECT doc_id, template, label, need, n, (i - 1) // s - back AS block, t.w FROM w JOIN t ON t.w = w.w, (VALUES (0), (1)) x(back) WHERE (i - 1) // s >= back),
 k AS (SELECT doc_id, label, count(DISTINCT w) / any_value(n) AS share FROM h GROUP BY doc_id, template, label, block HAVING count(DISTINCT w) >= any_value(need)),
 l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM k UNION SELECT doc_id, label FROM b) GROUP BY doc_id),
 e AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id),
 r AS (SELECT doc_id, max(share) AS score FROM k GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(e.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END AS score
 FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id"""


OP13 = _licenses()
