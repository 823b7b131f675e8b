"""Structured Streaming versions of the operators that carry state.

State per key is a few values: the last turns of a conversation, the last hash
of a chain, what a budget has spent, the status of an item. All use
``transformWithStateInPandas``, which needs the RocksDB state store
(:data:`STATE_STORE`). Rows of a key are put in order inside a micro-batch; the
source must keep the order between micro-batches.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from govlattice.operators.audit import GENESIS, SEGMENT_ROWS
from govlattice.operators.federation import call_snapshot
from govlattice.operators.personal_data import detect_personal_data
from govlattice.operators.privacy import TOLERANCE, UNIT, decide, in_units
from govlattice.operators.prompts import scan_prompts

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
}


def _sorted(rows: Iterator[pd.DataFrame], by: str) -> Iterator[dict[str, Any]]:
    """Rows of one key of one micro-batch in order.

    A micro-batch is bounded by the source's own rate limit, which also bounds
    what is held here.
    """
    frames = [r for r in rows if not r.empty]
    if frames:
        yield from pd.concat(frames, ignore_index=True).sort_values(by).to_dict("records")


# -- stateless -----------------------------------------------------------------------


def scan_prompt_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    return scan_prompts(stream, text)


def scan_personal_data_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    return detect_personal_data(stream, text)


# -- conversations -------------------------------------------------------------------


class _Windows(StatefulProcessor):
    """Last turns of a conversation; emits the joined text of every full window."""

    def __init__(self, window: int, ttl_ms: int | None):
        self.window = window
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState(
            "recent", "turns array<bigint>, texts array<string>, safe array<boolean>",
            self.ttl_ms,
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turns, texts, safe = [], [], []
        if self.recent.exists():
            turns, texts, safe = (list(v) for v in self.recent.get())
        out = []
        for row in _sorted(rows, "turn"):
            turns.append(int(row["turn"]))
            texts.append(row["text"])
            safe.append(bool(row["is_safe"]))
            turns, texts, safe = (v[-self.window :] for v in (turns, texts, safe))
            full = len(turns) == self.window and all(safe)
            out.append(
                {
                    "conv_id": key[0],
                    "turn": turns[-1],
                    "is_safe": safe[-1],
                    "first_turn": turns[0] if full else None,
                    "window_text": " ".join(texts) if full else None,
                }
            )
        keep = self.window - 1
        self.recent.update((turns[-keep:], texts[-keep:], safe[-keep:]))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "is_safe", "first_turn", "window_text"])

    def close(self) -> None:
        pass


def scan_conversation_stream(
    turns: DataFrame, window: int = 3, ttl_ms: int | None = None
) -> DataFrame:
    """Unsafe turns and unsafe windows of a feed of (conv_id, turn, text).

    State is the last ``window - 1`` turns per conversation. With ``ttl_ms`` it
    expires by the clock; such a query runs until it is stopped, also when it
    was started with ``availableNow``.
    """
    if window <= 1:
        raise ValueError("a window has at least two turns")
    scanned = scan_prompts(turns).select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "text", "is_safe"
    )
    joined = scanned.groupBy("conv_id").transformWithStateInPandas(
        _Windows(window, ttl_ms),
        "conv_id bigint, turn bigint, is_safe boolean, first_turn double, window_text string",
        "append",
        # A state that expires needs a clock.
        "processingTime" if ttl_ms else "none",
    )
    out = scan_prompts(joined, "window_text", prefix="w_")
    has_window = F.col("window_text").isNotNull()
    return out.select(
        "conv_id",
        "turn",
        "is_safe",
        F.col("first_turn").cast("bigint").alias("first_turn"),
        F.when(has_window, F.col("w_score")).alias("window_score"),
        (has_window & ~F.col("w_is_safe")).alias("window_unsafe"),
    )


# -- chains -------------------------------------------------------------------------------


class _Sealer(StatefulProcessor):
    """Last hash and position of a chain, appended batch by batch, with the hashes of the batch sealer."""

    def __init__(self, segment_rows: int | None):
        self.segment_rows = segment_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string, seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        prev, seq = self.last.get() if self.last.exists() else (GENESIS, -1)
        out = []
        for row in _sorted(rows, "order_key"):
            seq += 1
            if self.segment_rows and seq and seq % self.segment_rows == 0:
                place = "\x1f".join((GENESIS, str(key[0]), str(seq // self.segment_rows)))
                prev = hashlib.sha256(place.encode()).hexdigest()
            digest = hashlib.sha256((prev + row["body"]).encode()).hexdigest()
            out.append((key[0], seq, int(row["order_key"]), row["body"], prev, digest))
            prev = digest
        self.last.update((prev, seq))
        yield pd.DataFrame(
            out, columns=["chain_id", "seq", "order_key", "body", "prev_hash", "hash"]
        )

    def close(self) -> None:
        pass


def seal_stream(events: DataFrame, segment_rows: int | None = SEGMENT_ROWS) -> DataFrame:
    """Seal a feed of (chain_id STRING, order_key BIGINT, body STRING)."""
    return events.groupBy("chain_id").transformWithStateInPandas(
        _Sealer(segment_rows),
        "chain_id string, seq bigint, order_key bigint, body string, prev_hash string, hash string",
        "append",
        "none",
    )


# -- budgets ------------------------------------------------------------------------------


class _Ledger(StatefulProcessor):
    def __init__(self, total: float):
        self.total = in_units(total) + in_units(TOLERANCE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Whole units, as in the batch ledger.
        self.left = handle.getValueState("left", "units bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        left = int(self.left.get()[0]) if self.left.exists() else self.total
        feed = list(_sorted(rows, "seq"))
        given = [float(row["epsilon"]) for row in feed]
        units = [in_units(e) if math.isfinite(e) else None for e in given]
        out = []
        for row, epsilon, (ok, left) in zip(feed, given, decide(units, left)):  # noqa: B020
            out.append((key[0], int(row["seq"]), epsilon, ok, (self.total - left) / UNIT))
        self.left.update((left,))
        yield pd.DataFrame(out, columns=["budget_id", "seq", "epsilon", "accepted", "spent"])

    def close(self) -> None:
        pass


def spend_stream(spends: DataFrame, total: float) -> DataFrame:
    """Accept or reject a feed of (budget_id BIGINT, seq BIGINT, epsilon DOUBLE)."""
    if total <= 0:
        raise ValueError("the total budget must be positive")
    return spends.groupBy("budget_id").transformWithStateInPandas(
        _Ledger(total),
        "budget_id bigint, seq bigint, epsilon double, accepted boolean, spent double",
        "append",
        "none",
    )


# -- lifecycle ----------------------------------------------------------------------------


class _Incident(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status = self.status.get()[0] if self.status.exists() else "open"
        out = []
        for row in _sorted(rows, "seq"):
            reason = None
            if status == "resolved":
                reason = "already_resolved"
            elif row["status"] == "resolved" and not row["notes"]:
                reason = "missing_notes"
            else:
                status = row["status"]
            out.append((key[0], int(row["seq"]), row["status"], status, reason))
        self.status.update((status,))
        yield pd.DataFrame(
            out, columns=["incident_id", "seq", "requested", "status", "reject_reason"]
        )

    def close(self) -> None:
        pass


def incident_stream(transitions: DataFrame) -> DataFrame:
    """Status after every transition of a feed of (incident_id, seq, status, notes)."""
    return transitions.groupBy("incident_id").transformWithStateInPandas(
        _Incident(),
        "incident_id bigint, seq bigint, requested string, status string, reject_reason string",
        "append",
        "none",
    )


class _Review(StatefulProcessor):
    """First decision on a review item; later ones are rejected."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.decided = handle.getValueState("decided", "status string, reviewer string, seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        decided = tuple(self.decided.get()) if self.decided.exists() else None
        out = []
        for row in _sorted(rows, "seq"):
            reason = "already_decided" if decided else None
            if not decided:
                decided = ("approved" if row["approve"] else "rejected", row["reviewer"], int(row["seq"]))
                self.decided.update(decided)
            out.append((key[0], int(row["seq"]), *decided, reason))
        yield pd.DataFrame(out, columns=["item_id", "seq", "status", "reviewer", "decided_seq", "reject_reason"])

    def close(self) -> None:
        pass


def review_stream(decisions: DataFrame) -> DataFrame:
    """Status of a review item after every decision of a feed of (item_id, seq, approve, reviewer)."""
    return decisions.groupBy("item_id").transformWithStateInPandas(
        _Review(),
        "item_id bigint, seq bigint, status string, reviewer string, decided_seq bigint, reject_reason string",
        "append",
        "none",
    )


def distinct_transitions(
    transitions: DataFrame, ts: str = "ts", delay: str = "1 hour", keys: tuple = ("incident_id", "seq")
) -> DataFrame:
    """Drop repeated deliveries of a transition within the watermark."""
    return transitions.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


# -- windows in event time ------------------------------------------------------------------


def call_metrics_stream(
    calls: DataFrame,
    ts: str = "ts",
    width: str = "1 hour",
    slide: str | None = None,
    delay: str = "10 minutes",
) -> DataFrame:
    """Calls, errors and mean duration per module and time window."""
    return (
        calls.withWatermark(ts, delay)
        .groupBy(F.window(ts, width, slide), "module")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if(F.col("status") == "error").alias("errors"),
            F.round(F.avg("duration_ms"), 4).alias("avg_duration_ms"),
        )
        .select(F.col("window.start").alias("window_start"), "module", "calls", "errors",
                "avg_duration_ms")
    )


def trace_sessions_stream(
    events: DataFrame,
    key: str,
    payload: str = "payload_json",
    ts: str = "ts",
    gap: str = "1 hour",
    delay: str = "10 minutes",
) -> DataFrame:
    """Sessions of events that share a correlation value, closed by a gap."""
    value = F.get_json_object(payload, f"$.{key}")
    return (
        events.withColumn("trace_value", value)
        .filter("trace_value IS NOT NULL")
        .withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap), "trace_value")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            "trace_value",
            F.col("session_window.start").alias("first_ts"),
            F.col("session_window.end").alias("closed_at"),
            "events",
        )
    )


def snapshot_per_batch(path: str):
    """``foreachBatch`` function writing the call snapshot of every micro-batch.

    The batch number names the folder, so a repeated batch overwrites itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        call_snapshot(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
