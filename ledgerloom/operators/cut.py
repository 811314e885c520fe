"""Cutting lineage: tables written to the shared folder, so iterative plans survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

ROWS = 100_000
"""Rows of a file at least, where a table's rows are known, unless that leaves cores idle."""
_own: list[str] = []
_path: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only on a local master, where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="ledgerloom-"))
        at = _own[0]
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the folder's owner cleans it
        pass


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """df of about so many rows in as many partitions as they need: ROWS each, but two a core; never in more than it has.

    A file costs a task and, where Hadoop has no native library, processes started by the executor, however small it is.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)))


def written(df: DataFrame, name: str, instead: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder, read back. `instead` is a table of `written` that nothing needs any more: it goes.

    rows: about how many df has, where that is known; see few_files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = few_files(df, rows)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _path[out] = path
    if instead is not None:
        dropped(instead)
    return out


def dropped(df: DataFrame) -> None:
    """Removes a table of `written` before the session ends; no plan may read it afterwards."""
    if path := _path.pop(df, None):
        _remove(df.sparkSession, path)
