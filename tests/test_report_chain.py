"""The audit chain of reports makes each report once."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from govlattice.catalog import reports
from govlattice.operators import audit


def test_every_report_event_carries_the_hash_of_the_one_before(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    docs = [(i, f"text {i} of a person", "en") for i in range(3_000)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, "a passage of law")], "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
    made, seal = [], audit.seal
    monkeypatch.setattr(audit, "seal", lambda *a, **k: made.append(seal(*a, **k)) or made[-1])
    verdicts = reports.report_audit_chain(spark, base).collect()
    chains = defaultdict(list)
    for r in made[0].orderBy("seq").collect():
        chains[r.chain_id].append(r)
    # Longer than a segment.
    assert max(len(rows) for rows in chains.values()) > audit.SEGMENT_ROWS
    for rows in chains.values():
        before = audit.GENESIS
        for r in rows:
            assert r.prev_hash == before
            before = hashlib.sha256((before + r.event_type + r.actor + r.timestamp + r.payload_json).encode()).hexdigest()
            assert r.hash == before
    assert {r.chain_id: (r.events, r.valid) for r in verdicts} == {k: (len(rows), True) for k, rows in chains.items()}


def test_reports_are_made_once_for_their_chain(spark, tmp_path):
    base = str(tmp_path)
    docs = [(i, f"text {i} of a person", "en") for i in range(6)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, "a passage of law")], "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
    chains = reports.report_audit_chain(spark, base)
    # What numbers and seals the events reads them as written, not the documents.
    assert not [f for f in chains.inputFiles() if "documents.parquet" in f]
    rows = chains.collect()
    assert sum(r.events for r in rows) == 6 and all(r.valid for r in rows)
