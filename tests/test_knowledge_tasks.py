"""How the made-up people are dealt to tasks."""

from __future__ import annotations

from govlattice.catalog import knowledge


def test_customers_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(knowledge, "CUSTOMERS_PER_TASK", 10)
    spark.range(200).selectExpr("id AS c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    rows = knowledge.synthetic_customers(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 20
    assert rows.count() == 200
