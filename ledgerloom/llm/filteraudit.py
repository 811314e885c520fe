"""Filter interaction audit: what each filter removes, alone and after others, in every order (operator 12).

Five filters judge whole texts: A too few words, B too few distinct ones, C too many capitals, D a marked symbol, E a
copy of a smaller doc_id's text. E is found by sorting: rows are dealt by ranges of (SHA-256 of the text, doc_id, row),
sorted by fingerprint, text and doc_id, and each is compared with its predecessor. A group of copies may span any
number of partitions: each partition tells its first and last fingerprint and their smallest ids, and the smallest id
of a group that goes on is carried along these few rows, one for each partition. Range bounds hold fingerprints and ids,
never texts. The other four filters are judged in the same pass, so texts are moved once.

A document is then one mask of five bits; masks are counted by part, and these counters (32 for each part at most) add
up across partitions. All orders and steps follow from them: nothing is read again.

A null text is empty and a null source the part ''. A row without a doc_id is neither an original nor a copy and has no
label; rows of one doc_id are documents of their own and don't make copies of each other. A document is good or toxic
if any row of labels says so. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import partitions, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COPY = 1 << FILTERS.index("E")
_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"
_MASKS = "kind int, pid int, part string, doc_id long, mask int, head boolean, first_fp binary, last_fp binary, first_id long, last_id long"
_ARROW = pa.schema([("kind", pa.int32()), ("pid", pa.int32()), ("part", pa.string()), ("doc_id", pa.int64()), ("mask", pa.int32()), ("head", pa.bool_()), ("first_fp", pa.binary()), ("last_fp", pa.binary()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def own_mask(text: bytes) -> int:
    """Failures of A to D, from the text alone."""
    words = text.split()  # bytes: exactly \x20 and \x09-\x0D separate
    points = len(text.translate(None, _CONTINUED))
    mask = 1 if len(words) < 50 else 0
    mask |= 2 if 100 * len(set(words)) < 65 * len(words) else 0
    mask |= 4 if 100 * (len(text) - len(text.translate(None, _UPPER))) > 5 * points else 0
    return mask | (8 if len(text.translate(None, _MARKS)) < len(text) else 0)


def _judged(batches):
    """Rows of one sorted partition with their masks, and at the end one row on its first and last group of copies."""
    pid = TaskContext.get().partitionId()
    group = first = None  # (fingerprint, text, smallest id)
    first_group, mask = True, 0
    for b in batches:
        cols: tuple[list, list, list] = ([], [], [])
        fps, ids = b.column(0).to_pylist(), b.column(2).to_pylist()
        body = b.column(1).cast(pa.large_binary())
        for fp, value, doc_id in zip(fps, body, ids, strict=True):
            text = value.as_py()
            if group is None or fp != group[0] or text != group[1]:
                first_group = group is None
                group, mask = (fp, text, doc_id), own_mask(text)
                first = first or (fp, doc_id)
            copy = doc_id is not None and group[2] is not None and doc_id > group[2]
            for out, x in zip(cols, (doc_id, mask | (COPY if copy else 0), first_group), strict=True):
                out.append(x)
        n = len(fps)
        empty = [pa.nulls(n, t) for t in (pa.binary(), pa.binary(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([pid] * n, pa.int32()), b.column(3).cast(pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_()), *empty], schema=_ARROW)
    if group is not None:
        row = {"kind": 1, "pid": pid, "head": first_group, "first_fp": first[0], "last_fp": group[0], "first_id": first[1], "last_id": group[2]}
        yield pa.RecordBatch.from_pylist([row], schema=_ARROW)


def carried(bounds: list) -> list[tuple[int, int]]:
    """(partition, smallest id of its first group in the partitions before it), for groups that go on across a boundary."""
    out, last_fp, smallest = [], None, None
    for r in sorted(bounds, key=lambda r: r.pid):
        goes_on = r.first_fp == last_fp and smallest is not None
        if goes_on:
            out.append((r.pid, smallest))
        if not (goes_on and r.head):  # head: the partition is one group
            last_fp, smallest = r.last_fp, r.last_id
    return out


def failure_masks(docs: DataFrame) -> DataFrame:
    """(part, doc_id, mask) of every row: bit i is set if filter i fails."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("fp"), text.alias("body"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.monotonically_increasing_id().alias("row"))
    dealt = own.repartitionByRange(partitions(spark), F.col("fp"), F.asc_nulls_last("doc_id"), F.col("row")).sortWithinPartitions(F.col("fp"), F.col("body"), F.asc_nulls_last("doc_id"))
    found = written(dealt.select("fp", "body", "doc_id", "part").mapInArrow(_judged, _MASKS), "masks")
    bounds = found.where("kind = 1").select("pid", "head", "first_fp", "last_fp", "last_id").collect()  # one for each partition
    side = spark.createDataFrame(carried(bounds), "pid int, before long")
    late = F.col("head") & (F.col("doc_id") > F.col("before"))
    mask = F.when(late, F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask"))
    return found.where("kind = 0").join(F.broadcast(side), "pid", "left").select("part", "doc_id", mask.alias("mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by what they fail. Rows are counted before anything is joined."""
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("long").alias("q"), (F.col("toxic") == 1).cast("long").alias("t")).where("doc_id is not null")
    said = said.groupBy("doc_id").agg(F.coalesce(F.max("q"), F.lit(0)).alias("q"), F.coalesce(F.max("t"), F.lit(0)).alias("t"))
    rows = masks.groupBy("part", "doc_id", "mask").agg(F.count("*").alias("n")).join(said, "doc_id", "left")
    flag = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), flag("q").alias("good"), flag("t").alias("toxic"))


def audit(counted: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from counters alone."""
    held = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # 32 at most
    rows = held.select("part", "m", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit_of = lambda letter: F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.instr(F.lit(FILTERS), letter))
    before = sum((F.when(F.instr(F.col("filter_order"), x) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumn("bit", bit_of(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", before)

    def total(fits, value=lambda x: x["n"]) -> Column:
        return F.aggregate(F.filter("m", fits), F.lit(0).cast("long"), lambda s, x: s + value(x))

    fails = lambda x: x["mask"].bitwiseAND(F.col("bit")) != 0
    passed = lambda x: x["mask"].bitwiseAND(F.col("before")) == 0
    here = lambda x: fails(x) & passed(x)
    # of all orders, each filter that a document fails is the first of them equally often
    share = lambda x: x["n"] * F.expr(f"{len(ORDERS)}L") / F.bit_count(x["mask"])
    return rows.select(
        "part", "filter_order", "step", total(lambda x: passed(x) & ~fails(x)).alias("kept"), total(here).alias("removed"), total(lambda x: fails(x) & ~passed(x)).alias("redundant"), total(lambda x: x["mask"] == F.col("bit")).alias("unique_fails"),
        total(here, lambda x: x["good"]).alias("good_lost"), total(here, lambda x: x["toxic"]).alias("toxic_lost"), total(fails, lambda x: share(x).cast("long")).alias("shapley"),
    )
