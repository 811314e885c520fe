"""What the overview pages ask for: month summaries, missing proofs, open actions, run results, costs, lists and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables as X
from . import predicates as P

NO_MATCH, NO_PATH, GONE = "no approved match on record", "no path on record", "file is gone"


def month_summary(txns: DataFrame) -> DataFrame:
    """Rows by status for each month, and the percentage documented: matched or linked, of the rows not ignored."""
    of = lambda status: F.count_if(F.col("status") == status)
    rows = txns.where(P.countable()).groupBy("user_id", S.month("date_posted").alias("month")).agg(F.count("*").alias("n"), *[of(s).alias(s.lower()) for s in ("MATCHED", "LINKED", "UNMATCHED", "IGNORED")])
    asked = F.col("n") - F.col("ignored")
    return rows.withColumn("documented", F.when(asked > 0, (F.col("matched") + F.col("linked")) * 100.0 / asked).otherwise(0.0))


def missing_proofs(txns: DataFrame, matches: DataFrame, receipts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """MATCHED rows with no proof file, and why. files: the stored paths that still exist (user_id, original_filename); None means all."""
    docs = receipts.select("user_id", F.col("id").alias("document_id"), S.nullif_blank("original_filename").alias("path"))
    if files is None:
        docs = docs.withColumn("there", F.col("path").isNotNull())
    else:
        kept = files.select("user_id", F.col("original_filename").alias("path"), F.lit(True).alias("there")).distinct()
        docs = docs.join(kept, ["user_id", "path"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    proofs = matches.where(P.proves()).join(docs, ["user_id", "document_id"]).select("user_id", F.col("transaction_id").alias("id"), "there", F.when(F.col("path").isNull(), NO_PATH).when(~F.col("there"), GONE).alias("why"))
    per = proofs.groupBy("user_id", "id").agg(F.bool_or("there").alias("proved"), F.array_join(F.array_sort(F.collect_set("why")), "; ").alias("why"))
    rows = txns.where("status = 'MATCHED'").select("user_id", "id", "date_posted").join(per, ["user_id", "id"], "left").where("not coalesce(proved, false)")
    return rows.select("user_id", "id", "date_posted", F.coalesce("why", F.lit(NO_MATCH)).alias("why"))


def source_files(txns: DataFrame, prefix: str) -> DataFrame:
    return txns.where(F.col("source_file").startswith(prefix)).select("user_id", "source_file").distinct()


def action_items(txns: DataFrame, matches: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """What waits for the user, in one row for each kind that has any: reviews, rows without proof, transfer-service rows.

    With profiles (user_id, onboarded, connected) a tenant who hasn't finished the setup has an item for that, and
    transfer-service rows are told only to those who aren't connected to it; a tenant without a profile is neither.
    """
    waiting = F.col("status") == "UNMATCHED"
    rows = txns.groupBy("user_id").agg(F.count_if(waiting).alias("missing_receipts"), F.count_if(waiting & S.any_match("description", X.WISE_LINES)).alias("wise_detected"))
    reviews = matches.where("status = 'PENDING_REVIEW'").groupBy("user_id").agg(F.count("*").alias("pending_reviews"))
    wide = rows.join(reviews, "user_id", "full").fillna(0)
    kinds = ["pending_reviews", "missing_receipts", "wise_detected"]
    if profiles is not None:
        one = profiles.groupBy("user_id").agg(F.bool_or("onboarded").alias("onboarded"), F.bool_or("connected").alias("connected"))
        wide = wide.join(one, "user_id", "full").fillna(0).fillna(False)
        wide = wide.withColumn("onboarding", (~F.col("onboarded")).cast("long")).withColumn("wise_detected", F.when(~F.col("connected"), F.col("wise_detected")).otherwise(0))
        kinds.insert(2, "onboarding")
    return wide.select("user_id", *kinds).unpivot("user_id", kinds, "item", "n").where("n > 0")


def setup_completeness(profiles: DataFrame, txns: DataFrame, receipts: DataFrame, exports: DataFrame) -> DataFrame:
    """Five set-up steps and the percentage done, for every tenant that occurs. profiles: user_id, company_name."""
    done = lambda df, name: df.groupBy("user_id").agg(F.lit(True).alias(name))
    steps = [
        done(profiles.where(S.nullif_blank("company_name").isNotNull()), "profile"), done(txns, "bank_statement"), done(receipts, "receipt"), done(txns.where("status = 'MATCHED'"), "reconciliation"), done(exports, "export"),
    ]
    names, out = ["profile", "bank_statement", "receipt", "reconciliation", "export"], steps[0]
    for step in steps[1:]:
        out = out.join(step, "user_id", "full")
    out = out.fillna(False)
    count = sum(F.col(n).cast("int") for n in names)
    return out.select("user_id", *names, count.alias("done"), F.bround(count * 100.0 / len(names)).cast("int").alias("percent"))


def run_result(log: DataFrame, txns: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Outcome of a run for each tenant. log: user_id, outcome (stored, refreshed, flagged, displaced). Only newly stored pairs count as matched.

    With the documents that were unmatched before (user_id, one row each) there is nothing to reconcile only if there are
    none of these either, and remaining_documents is told.
    """
    said = log.groupBy("user_id").agg(F.count("*").alias("proposed"), *[F.count_if(F.col("outcome") == k).alias(n) for k, n in (("stored", "matched"), ("refreshed", "refreshed"), ("flagged", "flagged"), ("displaced", "displaced"))])
    is_ = lambda *s: F.col("status").isin(*s)
    asked = is_("UNMATCHED") & ~P.non_reconcilable()
    now = txns.groupBy("user_id").agg(F.count_if(asked).alias("reconcilable"), F.count_if(is_("MATCHED", "LINKED")).alias("reconciled"), F.count_if(is_("MATCHED", "LINKED", "UNMATCHED")).alias("all"))
    out = now.join(said, "user_id", "left").fillna(0)
    if documents is not None:
        out = out.join(documents.groupBy("user_id").agg(F.count("*").alias("documents")), "user_id", "left").fillna(0, ["documents"])
    idle = (F.col("reconcilable") == 0) & (F.lit(True) if documents is None else F.col("documents") == 0)
    label = F.when((F.col("matched") > 0) & (F.col("matched") >= F.col("reconcilable")), "success").when(F.col("matched") > 0, "partial").when(idle, "nothing_to_reconcile").otherwise("no_matches")
    rate = F.when(F.col("all") > 0, F.bround(F.col("reconciled") * 100.0 / F.col("all"), 1)).otherwise(0.0)
    return out.select("user_id", label.alias("run_status"), "matched", "refreshed", "flagged", "displaced", "proposed", "reconcilable", rate.alias("rate"), (F.col("reconcilable") - F.col("matched")).alias("remaining"), *([] if documents is None else [(F.col("documents") - F.col("matched")).alias("remaining_documents")]))


def cost_summary(calls: DataFrame, start: str, end: str) -> DataFrame:
    """Calls, tokens and cost of each tenant, in all (endpoint and model null) and by endpoint and model. The end is excluded."""
    rows = calls.where((F.col("created_at") >= F.lit(start).cast("timestamp")) & (F.col("created_at") < F.lit(end).cast("timestamp")))
    keys = ["user_id", "endpoint", "model"]
    sums = [F.coalesce(F.sum(F.col("estimated_cost").cast("decimal(18,6)")), F.lit(0)).cast("decimal(28,6)").alias("cost"), F.count("*").alias("calls"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out")]
    return rows.groupingSets([["user_id"], keys], *keys).agg(F.grouping("endpoint").cast("int").alias("is_total"), *sums)


def job_list(jobs: DataFrame, most: int = 100) -> DataFrame:
    """The first jobs of each tenant: pending ones in queue order, then the others, newest first."""
    pending = F.col("status") == "pending"
    w = Window.partitionBy("user_id").orderBy(F.when(pending, 0).otherwise(1), F.when(pending, F.col("position")).asc_nulls_first(), F.coalesce("finished_at", "created_at").desc(), F.col("position").desc())
    return jobs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("user_id", "place", "id", "status")


def statement_list(statements: DataFrame, most: int = 100, institution: str | None = None, confidence: str | None = None) -> DataFrame:
    """Statements of each tenant, latest period first; those without a period come before all."""
    rows = statements
    for column, value in (("institution", institution), ("import_confidence", confidence)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    w = Window.partitionBy("user_id").orderBy(F.col("period_end").desc_nulls_first(), F.col("created_at").desc(), "id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= min(most, 200))


def by_hash(files: DataFrame, order: Column, name: str = "original_filename") -> DataFrame:
    """For each file hash the oldest record, the latest name that is known, and the number of records; order must be total."""
    return files.where("file_hash <> ''").groupBy("user_id", "file_hash").agg(F.min_by("id", order).alias("first_id"), F.max_by(name, F.when(F.col(name).isNotNull(), order)).alias("latest_name"), F.count("*").alias("n"))


def matched_file(matches: DataFrame, receipts: DataFrame) -> DataFrame:
    """One file name for each matched row: that of its first active match."""
    docs = receipts.select("user_id", F.col("id").alias("document_id"), "original_filename")
    return matches.where(P.active()).join(docs, ["user_id", "document_id"]).groupBy("user_id", "transaction_id").agg(F.min_by("original_filename", "id").alias("file"))


def linked_or_found(links: DataFrame, found: DataFrame) -> DataFrame:
    """Ids linked on record or in this run (user_id, source_transaction_id, target_transaction_id)."""
    return P.endpoints(links.where(P.active())).union(P.endpoints(found)).distinct()


def partners(links: DataFrame, deleted: DataFrame) -> DataFrame:
    """The other ends of the links of deleted rows (user_id, id), those that are deleted themselves left out."""
    gone = deleted.select("user_id", "id").distinct()
    sides = [links.select("user_id", F.col(a).alias("id"), F.col(b).alias("partner")) for a, b in (("source_transaction_id", "target_transaction_id"), ("target_transaction_id", "source_transaction_id"))]
    ends = sides[0].union(sides[1]).join(gone, ["user_id", "id"], "left_semi")
    return ends.select("user_id", F.col("partner").alias("id")).distinct().join(gone, ["user_id", "id"], "left_anti")


def link_explanations(links: DataFrame, txns: DataFrame) -> DataFrame:
    """A sentence for each link whose two rows exist."""
    side = lambda p: txns.select("user_id", F.col("id").alias(f"{p}_transaction_id"), F.concat(F.col("account"), F.lit(" $"), P.absolute().cast("string"), F.lit(" "), F.col("currency")).alias(p), F.to_date("date_posted").alias(f"{p}_date"))
    both = links.join(side("source"), ["user_id", "source_transaction_id"]).join(side("target"), ["user_id", "target_transaction_id"])
    label = F.lit(None).cast("string")
    for kind, text in X.LINK_LABELS.items():
        label = F.when(F.col("link_type") == kind, text).otherwise(label)
    days = F.abs(F.datediff("source_date", "target_date"))
    apart = F.when(days > 0, F.concat(F.lit(" ("), days.cast("string"), F.lit("d apart)"))).otherwise("")
    return both.select("user_id", "id", F.concat(F.coalesce(label, "link_type"), F.lit(": "), "source", F.lit(" -> "), "target", apart).alias("explanation"))
