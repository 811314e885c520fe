"""Mixing sources to target weights by Pfair scheduling (operator 9). DataFrame and SQL functions only.

A source of weight a/A is a periodic task: its i-th block (from 1) is released at floor((i-1)*A/a) and due at
ceil(i*A/a). Earliest deadline first over unit slots meets every deadline, so after any number of slots each source has
received its exact share within less than one block. Weights are whole units of a cycle of A slots, so the schedule
repeats: one cycle is simulated by a SQL fold and block b of a source stands in slot (b div a) * A + slot of (b mod a).
No step needs all rows in order.

Asked weights are taken as exact fractions (a float by its decimal form) and A is their common denominator, so nothing
is rounded, up to A = MAX_CYCLE. Beyond that they are rounded to units of MAX_CYCLE by largest remainders, one at least:
the bound of one block then holds against the rounded weights, and a source drifts from the asked weight w by
|w - a/A| blocks a slot. A source of weight 0 or without a weight has no place in the mixture: its rows stay, with null
places. Without asked weights the target is size ** alpha in whole units of `cycle`, one at least, by definition.

Within a source documents are ordered by md5(doc_id) and cut into blocks of `block_chars` characters; a document belongs
to the block in which it starts. Running sizes come from sums over hash ranges of a source, so a source that holds a
third of all rows is spread over 4,096 groups. Every row is kept: when a source is exhausted its slots stay empty and
the others keep their proportions. Null sources form a source of their own, null or empty texts have size 0 (and stand
at the start of the next document). Equal doc_ids are told apart by size and text hash; full copies of a row tie and
get the neighbouring places. Other columns are carried along untouched; where one has the name of a column that is
added, the added one is called mix_ and that name.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import free_name

BLOCK_CHARS = 1 << 16
CYCLE = 1000
MAX_CYCLE = 1 << 14
ALPHA = 0.5
PLACES = ["n_size", "block", "slot", "release", "deadline", "block_offset"]


def source_key(source: str = "source") -> Column:
    """A null source gets the key '', any other one 's:' and its name."""
    return F.coalesce(F.concat(F.lit("s:"), F.col(source).cast("string")), F.lit(""))


def exact_units(weights: dict[str | None, float], most: int = MAX_CYCLE) -> dict[str | None, int]:
    """Whole units of the least cycle that holds the weights exactly, or of `most` slots where that one is longer."""
    asked = {k: Fraction(v) if isinstance(v, int | Fraction) else Fraction(str(v)) for k, v in weights.items()}
    if any(v < 0 for v in asked.values()):
        raise ValueError("weights are at least 0")
    total = sum(asked.values())
    shares = {k: v / total for k, v in asked.items() if v}
    cycle = lcm(*(v.denominator for v in shares.values()))
    if cycle <= most:
        return {k: int(v * cycle) for k, v in shares.items()}
    units = {k: max(int(v * most), 1) for k, v in shares.items()}
    left = most - sum(units.values())
    for k in sorted(shares, key=lambda k: (int(shares[k] * most) - shares[k] * most, str(k)))[: max(left, 0)]:
        units[k] += 1
    return units


def target_units(sizes: DataFrame, weights: dict[str | None, float] | None, alpha: float, cycle: int) -> DataFrame:
    """(source_key, units) of the sources that have a share. Without weights, in proportion to size ** alpha."""
    if weights is not None:
        rows = [("" if k is None else f"s:{k}", n) for k, n in exact_units(weights).items()]
        return sizes.sparkSession.createDataFrame(rows, "source_key string, units long")
    raw = sizes.select("source_key", F.pow(F.greatest("n_size", F.lit(1)).cast("double"), F.lit(alpha)).alias("w"))
    total = raw.agg(F.sum("w").alias("all_w"))
    return raw.join(F.broadcast(total)).select("source_key", F.greatest(F.floor(F.col("w") * cycle / F.greatest("all_w", F.lit(1e-300)) + 0.5), F.lit(1)).cast("long").alias("units"))


def cycle_schedule(units: DataFrame) -> DataFrame:
    """One cycle of earliest deadline first: (source_key, units, cycle_slots, k, cycle_slot, release, deadline)."""
    one = units.agg(F.array_sort(F.collect_list(F.struct("source_key", "units"))).alias("s"), F.sum("units").alias("cycle_slots")).where("cycle_slots > 0")
    fold = """
      aggregate(
        sequence(0L, cycle_slots - 1),
        named_struct('done', array_repeat(0L, size(s)), 'plan', cast(array() as array<struct<k:bigint,at:int,cycle_slot:bigint,release:bigint,deadline:bigint>>)),
        (state, t) -> element_at(transform(
          array(array_min(filter(
            transform(s, (x, j) -> named_struct(
              'deadline', ((state.done[j] + 1) * cycle_slots + x.units - 1) div x.units, 'j', j, 'k', state.done[j],
              'release', (state.done[j] * cycle_slots) div x.units, 'open', state.done[j] < x.units)),
            c -> c.open and c.release <= t))),
          p -> named_struct(
            'done', transform(state.done, (d, j) -> if(j = p.j, d + 1, d)),
            'plan', concat(state.plan, array(named_struct('k', p.k, 'at', p.j, 'cycle_slot', t, 'release', p.release, 'deadline', p.deadline))))), 1),
        state -> state.plan)
    """
    return one.select("s", "cycle_slots", F.explode(F.expr(fold)).alias("p")).select(
        F.expr("s[p.at].source_key").alias("source_key"), F.expr("s[p.at].units").alias("units"), "cycle_slots", "p.k", "p.cycle_slot", "p.release", "p.deadline"
    )


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, alpha: float = ALPHA, cycle: int = CYCLE, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs with block, slot, release, deadline and offset (characters before it in its block).

    Order by (slot, block_offset) for the interleaved stream. `keep` names the columns carried along (default: all).
    """
    keep = docs.columns if keep is None else keep
    n = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    own = docs.select(
        *[F.col(c).alias(f"c_{i}") for i, c in enumerate(keep)], source_key().alias("source_key"), n.alias("n_size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order_key"), F.xxhash64("text").alias("tie"),
    ).withColumn("range_key", F.substring("order_key", 1, 3))
    ranges = own.groupBy("source_key", "range_key").agg(F.sum("n_size").alias("range_size"))
    before = Window.partitionBy("source_key").orderBy("range_key").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("source_key", "range_key", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_start"))
    plan = cycle_schedule(target_units(ranges.groupBy("source_key").agg(F.sum("range_size").alias("n_size")), weights, alpha, cycle))
    inside = Window.partitionBy("source_key", "range_key").orderBy("order_key", "n_size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("inside", F.coalesce(F.sum("n_size").over(inside), F.lit(0))).join(starts, ["source_key", "range_key"])
    at = F.col("range_start") + F.col("inside")
    units = plan.groupBy("source_key").agg(F.first("units").alias("own_units"))
    placed = placed.withColumn("block", F.expr(f"(range_start + inside) div {block_chars}")).withColumn("block_offset", at % block_chars)
    # both sides are bounded by the cycle and the number of sources
    placed = placed.join(F.broadcast(units), "source_key", "left").withColumn("k", F.col("block") % F.col("own_units")).withColumn("turn", F.expr("block div own_units"))
    turn = F.col("turn") * F.col("cycle_slots")
    in_mix = F.col("own_units").isNotNull()
    places = [F.col("n_size"), F.when(in_mix, F.col("block")), turn + F.col("cycle_slot"), turn + F.col("release"), turn + F.col("deadline"), F.when(in_mix, F.col("block_offset"))]
    held = {c.lower() for c in keep}
    named = [c.alias(free_name(f"mix_{name}", keep) if name in held else name) for c, name in zip(places, PLACES, strict=True)]
    return placed.join(F.broadcast(plan), ["source_key", "k"], "left").select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(keep)], *named)
