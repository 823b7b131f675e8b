"""Review items and incidents as append-only transitions.

The latest state comes from partial aggregates (first decision, first valid
resolution, last accepted status), never from replaying an item's history in
one place. Transitions that break a rule are returned as rejects with a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def oversight_state(
    items: DataFrame, decisions: DataFrame, item: str = "item_id", seq: str = "seq"
) -> DataFrame:
    """Items with their first decision; ``pending`` until there is one.

    ``decisions``: item, seq, approve BOOLEAN, reviewer, notes.
    """
    first = decisions.groupBy(item).agg(
        F.min_by(F.struct("approve", "reviewer", "notes", seq), seq).alias("_d")
    )
    status = (
        F.when(F.col("_d").isNull(), "pending")
        .when(F.col("_d.approve"), "approved")
        .otherwise("rejected")
    )
    return (
        items.join(first, item, "left")
        .withColumns(
            {
                "status": status,
                "reviewer": F.col("_d.reviewer"),
                "decision_notes": F.col("_d.notes"),
                "decided_seq": F.col(f"_d.{seq}"),
            }
        )
        .drop("_d")
    )


def rejected_decisions(
    items: DataFrame, decisions: DataFrame, item: str = "item_id", seq: str = "seq"
) -> DataFrame:
    """Decisions on unknown items and decisions after the first one."""
    unknown = decisions.join(items.select(item), item, "left_anti").withColumn(
        "reason", F.lit("unknown_item")
    )
    known = decisions.join(items.select(item), item, "left_semi")
    first = known.groupBy(item).agg(F.min(seq).alias("_first"))
    late = (
        known.join(first, item)
        .filter(F.col(seq) > F.col("_first"))
        .drop("_first")
        .withColumn("reason", F.lit("already_decided"))
    )
    return unknown.unionByName(late)


def _judged(transitions: DataFrame, incident: str, seq: str) -> DataFrame:
    has_notes = F.coalesce(F.length("notes") > 0, F.lit(False))
    resolves = (F.col("status") == "resolved") & has_notes
    closed = transitions.groupBy(incident).agg(
        F.min(F.when(resolves, F.col(seq))).alias("_closed")
    )
    reason = (
        F.when(F.col(seq) > F.col("_closed"), "already_resolved").when(
            (F.col("status") == "resolved") & ~has_notes, "missing_notes"
        )
    )
    return transitions.join(closed, incident).withColumn("reason", reason).drop("_closed")


def incident_state(
    incidents: DataFrame, transitions: DataFrame, incident: str = "incident_id", seq: str = "seq"
) -> DataFrame:
    """Incidents with their last accepted status; ``open`` until one is accepted.

    ``transitions``: incident, seq, status, notes. Resolving needs notes and is
    final.
    """
    accepted = _judged(transitions, incident, seq).filter("reason IS NULL")
    last = accepted.groupBy(incident).agg(
        F.max_by("status", seq).alias("_status"),
        F.max(F.when(F.col("status") == "resolved", F.col("notes"))).alias("resolution_notes"),
        F.max(F.when(F.col("status") == "resolved", F.col(seq))).alias("resolved_seq"),
    )
    return (
        incidents.join(last, incident, "left")
        .withColumn("status", F.coalesce("_status", F.lit("open")))
        .drop("_status")
    )


def rejected_transitions(
    incidents: DataFrame, transitions: DataFrame, incident: str = "incident_id", seq: str = "seq"
) -> DataFrame:
    ids = incidents.select(incident)
    unknown = transitions.join(ids, incident, "left_anti").withColumn(
        "reason", F.lit("unknown_incident")
    )
    known = transitions.join(ids, incident, "left_semi")
    return unknown.unionByName(_judged(known, incident, seq).filter("reason IS NOT NULL"))


def with_status(items: DataFrame, status: str | None = None) -> DataFrame:
    """Items in one status, or all of them."""
    return items if status is None else items.filter(F.col("status").eqNullSafe(status))


def find(items: DataFrame, wanted: DataFrame, item: str = "item_id") -> DataFrame:
    """Look up ids; ``found`` is false where there is no such item."""
    marked = items.withColumn("found", F.lit(True))
    return wanted.join(marked, item, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )
