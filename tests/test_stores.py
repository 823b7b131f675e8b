"""Stored checkpoints and reports: repeated, failed and rival writes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from govlattice.operators import audit as A
from govlattice.operators import merkle as M
from govlattice.sources import stores


def sealed(spark, many):
    rows = spark.createDataFrame([(c, i, f"{c}/{i}") for c in "ab" for i in range(many)], "chain string, seq bigint, body string")
    return A.seal(rows, "chain", "seq", F.col("body"))


def test_checkpoints_of_two_runs_and_a_repeated_one(spark, tmp_path):
    path = str(tmp_path / "checkpoints")
    assert stores.read_checkpoints(spark, path) is None
    first = M.create_checkpoints(sealed(spark, 32), "chain", "seq", 8)
    assert stores.append_checkpoints(first, path, "run 1/a")
    assert not stores.append_checkpoints(first, path, "run 1/a")
    held = stores.read_checkpoints(spark, path)
    assert held.count() == 8
    covered = stores.covered_ranges(held, "chain")
    assert {(r["chain"], r["range_end"]) for r in covered.collect()} == {("a", 32), ("b", 32)}
    more = M.create_checkpoints(sealed(spark, 48), "chain", "seq", 8, since=covered)
    assert stores.append_checkpoints(more, path, "run 2")
    ids = [r["checkpoint_id"] for r in stores.read_checkpoints(spark, path).collect()]
    assert sorted(ids) == sorted(f"{c}:{k}" for c in "ab" for k in range(6))


def test_a_failed_write_leaves_no_rows_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "reports")
    good = spark.range(100, numPartitions=4).select(F.col("id").alias("n"), F.lit("p").alias("project_name"))
    # The last partition fails after others have written their files.
    bad = good.withColumn("n", F.when(F.col("n") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("n")))
    name = F.concat(F.lit("r"), F.col("n").cast("string"))
    with pytest.raises(Exception, match="lost"):
        stores.append_reports(bad, path, name, "today")
    assert stores.read_reports(spark, path) is None
    assert stores.append_reports(good, path, name, "today")
    # What a dead writer left behind: rows without a commit, and a commit without a name.
    good.write.parquet(f"{path}/rows/orphan")
    (tmp_path / "reports" / "commits" / "dead").write_text("")
    held = stores.read_reports(spark, path)
    assert held.count() == 100 and held.select("report_id").distinct().count() == 100


def test_the_first_of_two_writers_counts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rival = spark.range(3)
    slow = spark.range(5)
    keep = stores.uuid.uuid4
    calls = []

    def at_the_same_time():
        if not calls:
            calls.append(1)
            assert stores.append_once(rival, path, "b")  # commits while the other still writes
        return keep()

    monkeypatch.setattr(stores.uuid, "uuid4", at_the_same_time)
    assert not stores.append_once(slow, path, "b")
    assert stores.read_committed(spark, path).count() == 3


def test_reports_with_more_columns_and_summaries(spark, tmp_path):
    path = str(tmp_path / "r")
    one = spark.createDataFrame([("p", "t1", "low")], "project_name string, generated_at string, risk_level string")
    assert stores.append_reports(one, path, F.lit("r1")) and stores.append_reports(one, path, F.lit("r2"))
    assert stores.append_reports(one.withColumn("lines", F.lit(3)), path, F.lit("r3"))
    held = stores.read_reports(spark, path)
    assert sorted(tuple(r) for r in stores.report_summaries(held).collect()) == [(f"r{k}", "p", "t1", "low") for k in (1, 2, 3)]
