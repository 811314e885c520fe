"""Review actions on matches: an ordered log folded into match state, as a batch or as a stream.

Actions of one transaction depend on each other in order (a match that was taken away can't be reassigned, a reassigned
one founds a new match that later actions name), so the fold's key is (user_id, transaction_id): the few matches and
actions of one bank row. `fold` runs it over a table, `stream` keeps the matches as state and takes actions as they come;
both give the same matches and audit rows. Statuses of both ends are then derived anew, for the ends that changed alone.

Actions: LOAD (a match as stored, with its status), MANUAL_MATCH and ADD_PROOF (a new match, approved), REASSIGN (match_id
goes, new_match_id is approved for document_id), REMOVE_PROOF and SUPERSEDE (match_id goes). An action that names an
unknown match or, but for SUPERSEDE, one that is gone is refused, as is a new match under a known id and an action that
comes after a later one was applied. Each action has one audit row. Equal sequence numbers are ordered by match_id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as X
from ..operators import predicates as P

EVENTS = "user_id long, transaction_id long, seq long, action string, match_id long, document_id long, new_match_id long, status string, reason string"
OUT = "user_id long, transaction_id long, kind string, match_id long, document_id long, status string, user_action string, match_type string, seq long, action string, outcome string, old_value string"
GONE = "USER_REJECTED"
USER_ACTION = {"REASSIGN": "reassigned", "REMOVE_PROOF": "remove_proof", "SUPERSEDE": "superseded"}


def _apply(held: dict[int, dict], e: dict) -> tuple[str, str | None, list[int]]:
    """(outcome, the status before, matches touched) of one action; held is changed in place."""
    kind, own = e["action"], held.get(e["match_id"])
    if kind in ("LOAD", "MANUAL_MATCH", "ADD_PROOF"):
        if own is not None:
            return "refused: known match", None, []
        held[e["match_id"]] = {"document_id": e["document_id"], "status": e["status"] if kind == "LOAD" else "USER_APPROVED", "user_action": {"LOAD": None, "MANUAL_MATCH": "manual_match", "ADD_PROOF": "add_proof"}[kind], "match_type": "MANY_TO_ONE" if kind == "ADD_PROOF" else "ONE_TO_ONE"}
        return "applied", None, [e["match_id"]]
    if kind not in USER_ACTION:
        return "refused: unknown action", None, []
    if own is None:
        return "refused: unknown match", None, []
    if own["status"] == GONE and kind != "SUPERSEDE":
        return "refused: already gone", None, []
    if kind == "REASSIGN" and e["new_match_id"] in held:
        return "refused: known match", None, []
    before = own["status"]
    own |= {"status": GONE, "user_action": USER_ACTION[kind]}
    touched = [e["match_id"]]
    if kind == "REASSIGN":
        held[e["new_match_id"]] = {"document_id": e["document_id"], "status": "USER_APPROVED", "user_action": "manual_match", "match_type": "ONE_TO_ONE"}
        touched.append(e["new_match_id"])
    left = [k for k, m in held.items() if m["status"] != GONE]
    if kind == "REMOVE_PROOF" and len(left) == 1 and held[left[0]]["match_type"] != "ONE_TO_ONE":
        held[left[0]]["match_type"] = "ONE_TO_ONE"
        touched.append(left[0])
    return "applied", before, touched


def _act(key: tuple, held: dict[int, dict], last: int | None, changed: dict[int, int], e: dict) -> tuple[tuple, int | None]:
    """The audit row of one action, and the last number applied; held and changed follow."""
    if last is not None and e["seq"] is not None and e["seq"] < last:
        outcome, before, touched = "refused: late", None, []
    else:
        outcome, before, touched = _apply(held, e)
        last = e["seq"] if e["seq"] is not None else last
    for k in touched:
        changed[k] = e["seq"]
    return (*key, "audit", e["match_id"], e["document_id"], None, None, None, e["seq"], e["action"], outcome, before), last


def _matches(key: tuple, held: dict[int, dict], changed: dict[int, int]) -> list[tuple]:
    return [(*key, "match", k, held[k]["document_id"], held[k]["status"], held[k]["user_action"], held[k]["match_type"], seq, None, None, None) for k, seq in changed.items()]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")], dtype=object)
    return out.astype({c: "Int64" for c in ("user_id", "transaction_id", "match_id", "document_id", "seq")})


def _records(pdf: pd.DataFrame) -> list[dict]:
    return [{k: None if pd.isna(v) else int(v) if isinstance(v, float) else v for k, v in r.items()} for r in pdf.astype(object).to_dict("records")]


def fold(events: DataFrame) -> DataFrame:
    """Audit rows (kind audit) and final matches (kind match) of a whole log.

    A task reads its keys one after another in order, so it holds one key's matches at a time, however many actions there are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, last, changed = None, {}, None, {}
        for pdf in batches:
            rows = []
            for e in _records(pdf):
                own = (e["user_id"], e["transaction_id"])
                if own != key:
                    rows += _matches(key, held, changed) if key else []
                    key, held, last, changed = own, {}, None, {}
                row, last = _act(key, held, last, changed, e)
                rows.append(row)
            yield _frame(rows)
        yield _frame(_matches(key, held, changed) if key else [])

    return events.repartition("user_id", "transaction_id").sortWithinPartitions("user_id", "transaction_id", "seq", "match_id").mapInPandas(run, OUT)


def stream(events: DataFrame) -> DataFrame:
    """The same as an update stream: after each micro-batch the audit rows of its actions and the matches they touched."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, last = {}, None
        if state.exists:
            text, last = state.get
            held = {int(k): m for k, m in json.loads(text).items()}
        rows, changed = [], {}
        for e in sorted((e for pdf in batches for e in _records(pdf)), key=lambda e: (e["seq"] is not None, e["seq"] or 0, e["match_id"] is not None, e["match_id"] or 0)):
            row, last = _act(key, held, last, changed, e)
            rows.append(row)
        state.update((json.dumps(held), last))
        yield _frame(rows + _matches(key, held, changed))

    return events.groupBy("user_id", "transaction_id").applyInPandasWithState(run, OUT, "matches string, last long", "update", "NoTimeout")


def latest(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """Matches as they stand after the last micro-batch that touched each."""
    cols = ["transaction_id", "document_id", "status", "user_action", "match_type", "seq"]
    one = rows.where("kind = 'match'").groupBy("user_id", "match_id").agg(F.max_by(F.struct(*cols), F.struct(batch, "seq")).alias("m"))
    return one.select("user_id", "match_id", *[f"m.{c}" for c in cols])


def _either(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def resynced(folded: DataFrame, txns: DataFrame, receipts: DataFrame, links: DataFrame) -> DataFrame:
    """(user_id, side, id, status, derived) of the ends that actions touched and whose status changes; folded holds all matches of those ends.

    Rows: an approved match makes MATCHED, a pending one leaves the status, an open link makes LINKED, nothing UNMATCHED;
    EXCLUDED and PENDING_REVIEW stay, IGNORED only gives way to a link. Receipts: EXTRACTED and MATCHED follow likewise.
    """
    m = folded.where("kind = 'match'")
    acted = m.where("user_action is not null")
    touched = lambda c: m.join(acted.select("user_id", c).distinct(), ["user_id", c], "left_semi")
    flags = [F.bool_or(F.col("status").isin(X.PROOF_STATUSES)).alias("approved"), F.bool_or(F.col("status") == "PENDING_REVIEW").alias("pending")]
    by_txn = touched("transaction_id").groupBy("user_id", F.col("transaction_id").alias("id")).agg(*flags)
    by_doc = touched("document_id").groupBy("user_id", F.col("document_id").alias("id")).agg(*flags)
    t = P.with_flag(txns.join(by_txn, ["user_id", "id"]), P.endpoints(links.where(P.active())), "linked")
    status = F.col("status")
    kept = F.when((status == "IGNORED") & F.col("linked"), "LINKED").when(status.isin("IGNORED", "EXCLUDED", "PENDING_REVIEW"), status)
    row = F.coalesce(kept, F.when(_either("approved"), "MATCHED").when(_either("pending"), status).when(F.col("linked"), "LINKED").otherwise("UNMATCHED"))
    d = receipts.join(by_doc, ["user_id", "id"])
    doc = F.when(_either("approved") & status.isin("EXTRACTED", "MATCHED"), "MATCHED").when(_either("approved") | _either("pending"), status).when(status == "MATCHED", "EXTRACTED").otherwise(status)
    cols = lambda df, side, to: df.select("user_id", F.lit(side).alias("side"), "id", "status", to.alias("derived")).where("status <> derived")
    return cols(t, "transaction", row).unionByName(cols(d, "receipt", doc))
