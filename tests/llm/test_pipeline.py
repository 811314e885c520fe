"""The pipeline against brute force, stage by stage, on whole small tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import quality, secretscan

from .test_dedup import brute_near
from .test_text import brute_decontam, brute_stats

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    rules = quality.fit(docs, labels)
    said = {r.doc_id: r.rule for r in quality.statistics(docs).withColumn("rule", quality.verdict(rules)).collect()}
    kept = []
    for i, r in rows.items():
        n, _, _, _, repeat = brute_stats(r.text)
        if not (n < 10 or 100 * repeat > 20 * n) and said[i] is None:
            kept.append((i, r.text))
    near = brute_near(kept)
    kept = [(i, t) for i, t in kept if near[i][2]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i for i, _, n, _ in brute_decontam(kept, items) if n}
    kept = {i: t for i, t in kept if i not in hit}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[: len(corpus_pipeline.COLUMNS)] == corpus_pipeline.COLUMNS
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(kept) and len(kept) > 50
    for i, r in got.items():
        assert (r.lang, r.source) == (rows[i].lang, rows[i].source)
        if r.text == kept[i]:
            assert not secretscan.base_spans(kept[i])
        else:
            assert "[secret]" in r.text and not secretscan.base_spans(r.text) and r.n_chars == len(r.text)
        assert r.release <= r.slot < r.deadline


def test_stages_handle_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "some text without an id that is long enough to pass every rule of the list", "en", None, 5), (2, "", "en", "s", 0), (3, "word " * 30_000, "en", "s", None), (4, "a b c", "en", "s", 1), (4, "a b c", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("extra"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[:5] == corpus_pipeline.COLUMNS, name
        n = out.count()
        assert n <= len(rows) and (n == len(rows) or name in ("quality_rules", "near_duplicates", "decontamination"))
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[1][1](spark, docs, SF).where("doc_id = 4").count() == 1
