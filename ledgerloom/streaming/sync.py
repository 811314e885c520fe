"""Incremental sync: closed months are never read again, the open month is replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.sinks import ROW_KEY


def merge_month(target: DataFrame, batch: DataFrame, open_month: str) -> DataFrame:
    """Late-data rule, by tenant: rows of a closed month already held are dropped; an open month is replaced where the batch has it."""
    batch = batch.withColumn("ym", F.substring("date_posted", 1, 7)).dropDuplicates(ROW_KEY)
    held = target.where(F.col("ym") < open_month).select("user_id", "ym").distinct()
    fresh = batch.where(F.col("ym") < open_month).join(held, ["user_id", "ym"], "left_anti").unionByName(batch.where(F.col("ym") >= open_month))
    again = batch.where(F.col("ym") >= open_month).select("user_id", "ym").distinct()
    return target.join(again, ["user_id", "ym"], "left_anti").select(*target.columns).unionByName(fresh.select(*target.columns))


def stream_months(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, open_month: str):
    """merge_month over files: a table partitioned by tenant and month, of which a micro-batch overwrites only its own tenants' open months and months not yet held."""
    held_schema = StructType([*schema.fields, StructField("ym", StringType())])

    def apply(batch: DataFrame, _epoch: int) -> None:
        rows = batch.withColumn("ym", F.substring("date_posted", 1, 7)).dropDuplicates(ROW_KEY)
        try:
            held = spark.read.schema(held_schema).parquet(target).where(F.col("ym") < open_month).select("user_id", "ym").distinct()
            rows = rows.join(held, ["user_id", "ym"], "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.repartition("user_id", "ym").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user_id", "ym").parquet(target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_unique(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str):
    """Rows into an append-only table, each key once across all files (state is the set of keys)."""
    rows = spark.readStream.schema(schema).parquet(source).dropDuplicates(ROW_KEY)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remembered(pairs: DataFrame, memory: DataFrame) -> DataFrame:
    """Verdicts of earlier runs for pairs whose inputs have not changed. memory: inputs_hash, verdict."""
    keyed = pairs.withColumn("inputs_hash", F.sha2(F.to_json(F.struct(*sorted(pairs.columns))), 256))
    return keyed.join(memory.select("inputs_hash", "verdict"), "inputs_hash", "left")


def retry_state(events: DataFrame) -> DataFrame:
    """State of each job from its failures: waits of 10, 30, 60 s while transient, failed at three hard ones or a permanent code. events: job_id, at, outcome."""
    n = lambda kind: F.count_if(F.col("outcome") == kind)
    waits = F.array(F.lit(10), F.lit(30), F.lit(60))
    out = events.groupBy("job_id").agg(n("transient").alias("waits"), n("hard").alias("hard"), n("timeout").alias("timeouts"), n("permanent").alias("permanent"), F.bool_or(F.col("outcome") == "done").alias("done"))
    status = F.when(F.col("done"), "done").when((F.col("permanent") > 0) | (F.col("hard") >= 3) | (F.col("timeouts") >= 3), "failed").when(F.col("waits") + F.col("hard") + F.col("timeouts") > 0, "waiting").otherwise("queued")
    return out.withColumn("status", status).withColumn("wait_seconds", F.when(F.col("status") == "waiting", F.coalesce(F.try_element_at(waits, F.least(F.greatest("waits", F.lit(1)), F.lit(3)).cast("int")), F.lit(60))))
