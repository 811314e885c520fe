"""Exchange of packed records: numpy records travel in blobs, one row for each bucket and flush.

Rows of a few bytes cost a JVM more than their data, so Python stages pack fixed-width records by bucket. A bucket is
a part of a hash, so buckets are even whatever the documents are; senders aggregate equal keys before they pack, so a
key that a third of all rows hold sends one record a flush. Buckets are at least four times the shuffle partitions, so
one grows with a partition, not with the input. `reduce_packed` reads a partition bucket by bucket and holds one whole
bucket, or several of about `limit` bytes together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.cut import dropped, written

__all__ = ["PACKED", "bucket_bits", "bucket_of", "dropped", "equal_runs", "free_name", "pack", "partitions", "reduce_blobs", "reduce_packed", "rows", "table", "written"]
LEAST_BITS = 13
PACKED = "bucket int, payload binary"


def pack(records: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket with records."""
    most = int(buckets.max()) if len(buckets) else 0
    order = np.argsort(buckets.astype(np.uint16 if most < 1 << 16 else np.uint32), kind="stable")
    runs = equal_runs(buckets[order])
    which = buckets[order][[s for s, _ in runs]] if runs else np.zeros(0, np.int64)
    at = np.array([0, *(e for _, e in runs)], np.int64) * records.dtype.itemsize
    at = at.astype(np.int32)
    payload = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(records[order].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), payload], ["bucket", "payload"])


def bucket_bits(spark: SparkSession) -> int:
    """Bits of a bucket's number: 8,192 buckets, or four for each shuffle partition if that is more."""
    return min(max(LEAST_BITS, (4 * partitions(spark) - 1).bit_length()), 24)


def bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of a mixed 64-bit hash."""
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def equal_runs(sorted_buckets: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal values."""
    n = len(sorted_buckets)
    if not n:
        return []
    at = np.flatnonzero(np.concatenate([[True], sorted_buckets[1:] != sorted_buckets[:-1]]))
    return list(zip(at.tolist(), [*at[1:].tolist(), n], strict=True))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def reduce_blobs(df: DataFrame, fn: Callable[[list[tuple[int, memoryview]]], Iterator[pa.RecordBatch]], schema: str, limit: int = 24 << 20) -> DataFrame:
    """Sends packed rows to their buckets and calls fn on (bucket, payload) of some whole buckets at a time."""
    n = partitions(df.sparkSession)

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            which = batch.column(0).to_numpy(zero_copy_only=False)
            for k, blob in zip(which.tolist(), batch.column(1), strict=True):
                if k != last and size >= limit:
                    yield from fn(held)
                    held, size = [], 0
                last = k
                held.append((k, memoryview(blob.as_buffer())))
                size += len(held[-1][1])
        if held:
            yield from fn(held)

    return df.select("bucket", "payload").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def reduce_packed(df: DataFrame, dtype: np.dtype, fn: Callable[[np.ndarray], Iterator[pa.RecordBatch]], schema: str, limit: int = 24 << 20) -> DataFrame:
    """reduce_blobs for payloads of fixed-width records."""
    return reduce_blobs(df, lambda held: fn(np.concatenate([np.frombuffer(x, dtype) for _, x in held])), schema, limit)


def rows(buckets: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])


def free_name(name: str, taken: list[str]) -> str:
    """name, or name with as many underscores as it takes to clash with no column, however it is cased."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
