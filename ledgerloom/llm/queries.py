"""The operators as queries over their whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, filteraudit, fmindex, hamerly, licenses, mixing, neardup, oracles, pii, quality, secretscan, suffixes, tokens, toxicity
from .exchange import table


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_strings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.suffix_sums(tokens.histogram(tokens.lengths(table(spark, sf_dir, "documents").select("text"))))


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hamerly.clustered(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filteraudit.failure_masks(table(spark, sf_dir, "documents"))
    return filteraudit.audit(filteraudit.counters(masks, table(spark, sf_dir, "labels")))


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.labelled(licenses.scan(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": pipeline} | {f.__name__: f for f in (op1_pii_surrogates, op2_substring_dedup, op3_suffix_array_dedup, op4_quality_rules, op5_minhash_near_dedup, op6_benchmark_decontamination, op7_toxicity, op8_token_length_histogram, op9_pfair_mixing, op10_secret_scans, op11_hamerly_clusters, op12_filter_audit, op13_license_scans)}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": oracles.OP2, "op5_minhash_near_dedup": oracles.OP5, "op6_benchmark_decontamination": oracles.OP6, "op9_pfair_mixing": oracles.OP9, "op11_hamerly_clusters": oracles.OP11, "op12_filter_audit": oracles.OP12, "op13_license_scans": oracles.OP13}
