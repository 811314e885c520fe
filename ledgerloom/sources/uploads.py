"""Uploaded files: what kind each is, which were seen before, and statements that no job will finish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of receipts, states of jobs that are still to end
RECEIPTS = [".pdf", ".jpg", ".jpeg", ".png", ".jfif", ".webp"]
WAITING = ["queued", "running", "waiting_for_model"]


def files(spark: SparkSession, path: str) -> DataFrame:
    """(name, file_hash) of the files under a path; the hash is SHA-256 of the bytes. Files without any are not read."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("file_hash"))


def kind(name: Column) -> Column:
    """receipt, csv, or null for what isn't supported, by the extension."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when(ext.isin(RECEIPTS), "receipt").when(ext == ".csv", "csv")


def arrivals(uploads: DataFrame, seen: DataFrame) -> DataFrame:
    """uploads (user_id, name, file_hash) with kind and outcome; seen: user_id, file_hash of documents held.

    Receipts of a hash that the tenant holds are duplicates, as are all but the first by name of those that arrive
    together. CSV files are always read (their rows are told apart later). A hash is reduced to its first name before
    anything is joined, so a file that arrives very often is one row.
    """
    rows = uploads.withColumn("kind", kind(F.col("name")))
    first = rows.where("kind = 'receipt'").groupBy("user_id", "file_hash").agg(F.min("name").alias("first"))
    held = first.join(seen.select("user_id", "file_hash").distinct().withColumn("held", F.lit(True)), ["user_id", "file_hash"], "left")
    out = rows.join(held, ["user_id", "file_hash"], "left")
    again = F.col("held").isNotNull() | (F.col("name") != F.col("first"))
    outcome = F.when(F.col("kind").isNull(), "unsupported").when((F.col("kind") == "receipt") & again, "duplicate").otherwise("new")
    return out.select("user_id", "name", "file_hash", "kind", outcome.alias("outcome"))


def orphaned(statements: DataFrame, jobs: DataFrame) -> DataFrame:
    """(user_id, id) of statements (user_id, id, status) in processing that no waiting job names; jobs: user_id, kind, status, result (JSON with statement_id)."""
    live = jobs.where((F.col("kind") == "statement") & F.col("status").isin(WAITING)).select("user_id", F.get_json_object("result", "$.statement_id").alias("key")).where("key is not null").distinct()
    rows = statements.where("status = 'processing'").select("user_id", "id", F.col("id").cast("string").alias("key"))
    return rows.join(live, ["user_id", "key"], "left_anti").select("user_id", "id")
