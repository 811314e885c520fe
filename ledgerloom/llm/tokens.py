"""Token counts from an exact length histogram (operator 8).

Each document is encoded whole by a public byte-level BPE (its file is a parameter; special tokens are ordinary text) and
only its length is kept. Documents are aggregated by length; suffix sums over the distinct lengths then answer, for every
context limit, documents and tokens within it, tokens left after truncation, and quantiles, all exactly.

Null and empty texts have length 0. Equal rows count each. Sums run over ranges of RANGE lengths, so no task needs all
lengths. Only `text` is read.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
RANGE = 1024


def encoder(path: str = TOKENIZER, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Encoded length of every row, as n_tokens (and doc_id if docs has it)."""
    with_id = "doc_id" in docs.columns

    def run(batches):
        enc = encoder(path)
        for b in batches:
            out = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            cols = [pa.array(out, pa.int64())] + ([b.column("doc_id")] if with_id else [])
            yield pa.RecordBatch.from_arrays(cols, ["n_tokens", "doc_id"][: len(cols)])

    cols = ["text", "doc_id"][: 1 + with_id]
    return docs.select(*cols).mapInArrow(run, "n_tokens long" + (", doc_id long" if with_id else ""))


def histogram(lengths_df: DataFrame) -> DataFrame:
    """Documents by length; written, so that the sums below don't encode the corpus again."""
    return written(_counts(lengths_df), "lengths")


def _counts(lengths_df: DataFrame) -> DataFrame:
    return lengths_df.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per distinct length: documents and tokens of at least and at most that length, truncated total, quantile."""
    h = hist.withColumn("range_id", F.expr(f"n_tokens div {RANGE}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    by_range = h.groupBy("range_id").agg(F.sum("n_docs").alias("rd"), F.sum("tokens").alias("rt"))
    # as many rows as ranges, which the longest text bounds, not the number of documents
    longer = Window.orderBy(F.col("range_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = by_range.select("range_id", F.coalesce(F.sum("rd").over(longer), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("rt").over(longer), F.lit(0)).alias("tokens_after"))
    total = by_range.agg(F.sum("rd").alias("all_docs"), F.sum("rt").alias("all_tokens"))
    w = Window.partitionBy("range_id").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = h.withColumn("d", F.sum("n_docs").over(w)).withColumn("t", F.sum("tokens").over(w)).join(after, "range_id").join(F.broadcast(total))
    at_least, tokens_at_least = F.col("d") + F.col("docs_after"), F.col("t") + F.col("tokens_after")
    return out.select(
        "n_tokens", "n_docs", at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"),
        (F.col("all_docs") - at_least + F.col("n_docs")).alias("docs_at_most"), (F.col("all_tokens") - tokens_at_least + F.col("tokens")).alias("tokens_at_most"),
        (F.col("all_tokens") - tokens_at_least + F.col("n_tokens") * at_least).alias("truncated_tokens"),
        ((F.col("all_docs") - at_least + F.col("n_docs")) / F.col("all_docs")).alias("quantile"), F.col("all_docs").alias("total_docs"), F.col("all_tokens").alias("total_tokens"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens that remain when every document is cut at `limit`, from the histogram's sums alone."""
    below = F.col("n_tokens") < limit
    kept = F.sum(F.when(below, F.col("n_tokens") * F.col("n_docs")).otherwise(F.lit(limit) * F.col("n_docs")))
    return sums.agg(F.coalesce(kept, F.lit(0)).alias("tokens"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"))


def quantile_length(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of all documents doesn't exceed."""
    return sums.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
