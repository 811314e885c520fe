"""Links, proofs and graphs over transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables as X
from . import predicates as P
from .cut import dropped, written


def both_directions(links: DataFrame, txns: DataFrame) -> DataFrame:
    """Every active link seen from each of its transactions, with the other one's row."""
    t = txns.select("user_id", F.col("id").alias("other_id"), F.col("account").alias("other_account"), S.money("amount").alias("other_amount"), F.col("date_posted").alias("other_date"))
    own = txns.select("user_id", F.col("id").alias("transaction_id"))
    ends = links.where(P.active()).select(
        "user_id", F.col("id").alias("link_id"), "link_type",
        F.explode(F.array(
            F.struct(F.col("source_transaction_id").alias("transaction_id"), F.col("target_transaction_id").alias("other_id"), F.lit("source").alias("side")),
            F.struct(F.col("target_transaction_id").alias("transaction_id"), F.col("source_transaction_id").alias("other_id"), F.lit("target").alias("side")),
        )).alias("e"),
    ).select("user_id", "link_id", "link_type", "e.*")
    return ends.join(own, ["user_id", "transaction_id"]).join(t, ["user_id", "other_id"])


def unified_proof(matches: DataFrame, receipts: DataFrame, links: DataFrame, txns: DataFrame) -> DataFrame:
    """Document proofs and link proofs of each transaction, tagged."""
    docs = matches.where(P.shown()).join(receipts.select("user_id", F.col("id").alias("document_id"), "vendor"), ["user_id", "document_id"])
    a = docs.select("user_id", "transaction_id", F.lit("document").alias("kind"), F.col("document_id").alias("proof_id"), F.col("vendor").alias("label"))
    b = both_directions(links, txns).select("user_id", "transaction_id", F.lit("link").alias("kind"), F.col("other_id").alias("proof_id"), F.col("link_type").alias("label"))
    return a.unionByName(b)


def proof_coverage(txns: DataFrame, matches: DataFrame, receipts: DataFrame, enough: str = "0.95") -> DataFrame:
    """Share of the amount that same-currency proofs cover; null where proofs are in other currencies only."""
    docs = receipts.select("user_id", F.col("id").alias("document_id"), S.guarded_money("total").alias("doc_total"), F.col("currency").alias("doc_currency"))
    own = txns.select("user_id", F.col("id").alias("transaction_id"), P.absolute().alias("value"), "currency")
    rows = matches.where(P.proves()).join(docs, ["user_id", "document_id"]).join(own, ["user_id", "transaction_id"])
    same = F.coalesce("doc_currency", "currency") == F.col("currency")
    out = rows.groupBy("user_id", "transaction_id").agg(F.sum(F.when(same, F.abs("doc_total"))).cast(S.MONEY).alias("covered"), F.max("value").alias("value"), F.count("*").alias("proofs"))
    share = F.when((F.col("value") > 0) & F.col("covered").isNotNull(), (F.col("covered") / F.col("value")).cast("double"))
    return out.withColumn("share", share).withColumn("is_covered", F.coalesce(F.col("covered") >= F.col("value") * F.lit(enough).cast("decimal(4,2)"), F.lit(False)))


def stored_coverage(matches: DataFrame) -> DataFrame:
    """A match without a covered amount stands for all of it; otherwise the amounts add up."""
    return matches.where(P.proves()).groupBy("user_id", "transaction_id").agg(F.bool_or(F.col("covered_amount").isNull()).alias("whole"), F.sum(S.guarded_money(F.coalesce("covered_amount", F.lit("0")))).cast(S.MONEY).alias("part"))


def link_offset(links: DataFrame, txns: DataFrame) -> DataFrame:
    """Legs of each anchor (a link's source): opposite direction and same currency count towards the offset."""
    a = txns.select("user_id", F.col("id").alias("source_transaction_id"), P.absolute().alias("anchor"), F.col("currency").alias("ccy"), F.col("transaction_type").alias("kind"))
    b = txns.select("user_id", F.col("id").alias("target_transaction_id"), P.absolute().alias("leg"), F.col("currency").alias("leg_ccy"), F.col("transaction_type").alias("leg_kind"))
    rows = links.where(P.active()).join(a, ["user_id", "source_transaction_id"]).join(b, ["user_id", "target_transaction_id"])
    counts = (F.col("ccy") == F.col("leg_ccy")) & (F.col("kind") != F.col("leg_kind"))
    out = rows.groupBy("user_id", "source_transaction_id").agg(F.max("anchor").alias("anchor"), F.coalesce(F.sum(F.when(counts, F.col("leg"))), F.lit(0)).cast(S.MONEY).alias("offset"), F.count("*").alias("legs"), F.count_if(~counts).alias("ignored_legs"))
    return out.withColumn("net", F.greatest(F.col("anchor") - F.col("offset"), F.lit(0)).cast(S.MONEY)).withColumn("fully", F.col("offset") >= F.col("anchor") * F.lit("0.99").cast("decimal(4,2)"))


def documents_with_transactions(receipts: DataFrame, matches: DataFrame) -> DataFrame:
    """Documents with their active matches folded: first transaction, count and ordered ids."""
    found = matches.where(P.active()).groupBy("user_id", F.col("document_id").alias("id")).agg(F.min("transaction_id").alias("first_transaction"), F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_list("transaction_id")), ",").alias("transaction_ids"))
    return receipts.select("user_id", "id", "vendor", "file_hash").join(found, ["user_id", "id"], "left").fillna({"n_matches": 0})


def matches_with_sides(matches: DataFrame, txns: DataFrame, receipts: DataFrame) -> DataFrame:
    t = txns.select("user_id", F.col("id").alias("transaction_id"), "description", S.money("amount").alias("amount"))
    d = receipts.select("user_id", F.col("id").alias("document_id"), "vendor", S.guarded_money("total").alias("total"))
    return matches.join(t, ["user_id", "transaction_id"], "left").join(d, ["user_id", "document_id"], "left")


def documents_with_counts(receipts: DataFrame, matches: DataFrame) -> DataFrame:
    """Picker rows: number of active matches, unmatched ones first."""
    n = matches.where(P.active()).groupBy("user_id", F.col("document_id").alias("id")).agg(F.count("*").alias("existing"))
    out = receipts.join(n, ["user_id", "id"], "left").fillna({"existing": 0})
    return out.select("user_id", "id", "vendor", "existing", (F.col("status") == "EXTRACTED").alias("is_open"))


def document_twins(receipts: DataFrame) -> DataFrame:
    """(user_id, id, twin): equal file hash, or equal vendor, total, currency and date. Not closed transitively."""
    identity = F.concat_ws("|", S.normal("vendor"), S.guarded_money("total").cast("string"), F.coalesce("currency", F.lit("")), F.col("document_date"))
    full = F.col("vendor").isNotNull() & F.col("total").isNotNull() & F.col("document_date").isNotNull()
    keys = F.array_compact(F.array(F.concat(F.lit("h:"), F.col("file_hash")), F.when(full, F.concat(F.lit("i:"), identity))))
    one = receipts.select("user_id", "id", F.explode(keys).alias("key"))
    return one.join(one.withColumnRenamed("id", "twin"), ["user_id", "key"]).where("id <> twin").select("user_id", "id", "twin").distinct()


def rejected_pairs(matches: DataFrame, receipts: DataFrame) -> DataFrame:
    """Rejected (transaction, document) pairs, with every twin of the document."""
    bad = matches.where(~P.active()).select("user_id", "transaction_id", "document_id").distinct()
    twins = document_twins(receipts).select("user_id", F.col("id").alias("document_id"), "twin")
    return bad.unionByName(bad.join(twins, ["user_id", "document_id"]).select("user_id", "transaction_id", F.col("twin").alias("document_id"))).distinct()


# graphs


def undirected(links: DataFrame) -> DataFrame:
    a = links.select("user_id", F.col("source_transaction_id").alias("u"), F.col("target_transaction_id").alias("v"))
    return a.unionByName(a.select("user_id", F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def walk(links: DataFrame, seeds: DataFrame, max_depth: int = 20) -> DataFrame:
    """(user_id, seed, id, depth): nodes that active links reach from each seed, with the least depth.

    A frontier loop: each round is one equi-join with the edges and one anti-join with what is known.
    """
    edges = written(undirected(links.where(P.active())), "edges")
    known = frontier = written(seeds.select("user_id", F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct(), "walk")
    for depth in range(1, max_depth):
        step = frontier.join(edges, (frontier.user_id == edges.user_id) & (frontier.id == edges.u)).select(frontier.user_id, "seed", F.col("v").alias("id")).distinct()
        frontier = written(step.join(known, ["user_id", "seed", "id"], "left_anti").withColumn("depth", F.lit(depth)), "walk")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def components(edges: DataFrame) -> DataFrame:
    """(user_id, id, component): least id of each connected set, by min-labels with pointer jumping."""
    both = written(edges.select("user_id", "u", "v").unionByName(edges.select("user_id", F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label = written(both.groupBy("user_id", "u").agg(F.least(F.col("u"), F.min("v")).alias("c")), "labels")
    while True:
        near = both.join(label.select("user_id", F.col("u").alias("v"), F.col("c").alias("d")), ["user_id", "v"]).groupBy("user_id", "u").agg(F.min("d").alias("d"))
        least = label.join(near, ["user_id", "u"]).select("user_id", "u", F.least("c", "d").alias("c"))
        jump = least.select("user_id", F.col("u").alias("c"), F.col("c").alias("e"))
        new = written(least.join(jump, ["user_id", "c"]).select("user_id", "u", F.least("c", "e").alias("c")), "labels")
        done = new.join(label.withColumnRenamed("c", "old"), ["user_id", "u"]).where("c <> old").isEmpty()
        dropped(label)
        label = new
        if done:
            return label.select("user_id", F.col("u").alias("id"), F.col("c").alias("component"))


def chains(links: DataFrame) -> DataFrame:
    """Components of two links or more among accepted ones: (user_id, link_id, chain_id, chain_position, total_confidence)."""
    ok = links.where(F.col("status").isin(X.PROOF_STATUSES))
    edges = ok.select("user_id", F.col("source_transaction_id").alias("u"), F.col("target_transaction_id").alias("v"))
    part = ok.join(components(edges).withColumnRenamed("id", "source_transaction_id"), ["user_id", "source_transaction_id"])
    w = Window.partitionBy("user_id", "component")
    out = part.withColumn("n", F.count("*").over(w)).withColumn("total_confidence", F.avg("confidence_score").over(w)).withColumn("chain_position", F.row_number().over(w.orderBy("id")) - 1)
    key = F.sha2(F.concat_ws(":", "user_id", "component"), 256)
    return out.where("n >= 2").select("user_id", F.col("id").alias("link_id"), F.substring(key, 1, 32).alias("chain_id"), "component", "chain_position", "total_confidence")


def cycle_edges(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed edges whose ends are connected already; they would close a cycle."""
    c = components(existing.select("user_id", F.col("source_transaction_id").alias("u"), F.col("target_transaction_id").alias("v")))
    a = c.select("user_id", F.col("id").alias("source_transaction_id"), F.col("component").alias("ca"))
    b = c.select("user_id", F.col("id").alias("target_transaction_id"), F.col("component").alias("cb"))
    return proposed.join(a, ["user_id", "source_transaction_id"]).join(b, ["user_id", "target_transaction_id"]).where("ca = cb").drop("ca", "cb")


def nearest_proof(links: DataFrame, matches: DataFrame, max_depth: int = 20) -> DataFrame:
    """(user_id, id, depth, seed): for transactions without own proof, the nearest proved one over approved links.

    Ties go to the more confident seed, then to the smaller id. Only the best label of a node is carried on.
    """
    seed = matches.where(P.proves()).groupBy("user_id", F.col("transaction_id").alias("id")).agg(F.max("confidence_score").alias("conf"))
    edges = written(undirected(links.where(F.col("status").isin(X.PROOF_STATUSES))), "edges")
    known = frontier = written(seed.select("user_id", "id", F.lit(0).alias("depth"), F.struct(-F.col("conf"), F.col("id")).alias("best")), "proof")
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, (frontier.user_id == edges.user_id) & (frontier.id == edges.u)).groupBy(frontier.user_id, F.col("v").alias("id")).agg(F.min("best").alias("best"))
        frontier = written(step.join(known, ["user_id", "id"], "left_anti").select("user_id", "id", F.lit(depth).alias("depth"), "best"), "proof")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known.where("depth > 0").select("user_id", "id", "depth", F.col("best").getField("id").alias("seed"))


# derived status


def derived_status(txns: DataFrame, matches: DataFrame, links: DataFrame) -> DataFrame:
    """Status that matches and links imply; settled and pending cases keep what they have."""
    m = matches.groupBy("user_id", F.col("transaction_id").alias("id")).agg(F.bool_or(P.proves()).alias("approved"), F.bool_or(F.col("status") == "PENDING_REVIEW").alias("pending"))
    out = P.with_flag(txns.join(m, ["user_id", "id"], "left"), P.endpoints(links.where(F.col("status").isin(X.PROOF_STATUSES))), "linked")
    approved, pending = F.coalesce("approved", F.lit(False)), F.coalesce("pending", F.lit(False))
    return out.withColumn("derived", _cascade(approved, pending, F.col("linked"))).select("user_id", "id", "status", "derived")


def _cascade(approved: Column, pending: Column, linked: Column) -> Column:
    status = F.col("status")
    return F.when(status.isin("EXCLUDED", "IGNORED"), status).when(approved, "MATCHED").when(linked, "LINKED").when(pending, status).otherwise("UNMATCHED")


def status_repair(txns: DataFrame, matches: DataFrame, links: DataFrame) -> DataFrame:
    """Ordered repairs: demotion looks at matches that are not rejected, promotion at approved ones."""
    m = matches.groupBy("user_id", F.col("transaction_id").alias("id")).agg(F.bool_or(P.proves()).alias("approved"), F.bool_or(P.active()).alias("open"))
    out = P.with_flag(txns.join(m, ["user_id", "id"], "left"), P.endpoints(links.where(P.active())), "linked")
    approved, is_open = F.coalesce("approved", F.lit(False)), F.coalesce("open", F.lit(False))
    s1 = F.when((F.col("status") == "MATCHED") & ~is_open, F.when(F.col("linked"), "LINKED").otherwise("UNMATCHED")).otherwise(F.col("status"))
    s2 = F.when((s1 == "LINKED") & ~F.col("linked"), F.lit("UNMATCHED")).otherwise(s1)
    s3 = F.when((s2 == "UNMATCHED") & approved, F.lit("MATCHED")).otherwise(s2)
    s4 = F.when((s3 == "UNMATCHED") & F.col("linked"), F.lit("LINKED")).otherwise(s3)
    return out.select("user_id", "id", "status", s4.alias("repaired")).where("status <> repaired")
