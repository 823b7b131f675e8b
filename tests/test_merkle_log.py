"""Merkle logs that grow by appends, against whole trees."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from govlattice.operators import merkle as M
from govlattice.operators.merkle_log import append_leaves, log_proofs, log_roots


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(leaves):
    while len(leaves) > 1:
        pairs = [leaves[i : i + 2] for i in range(0, len(leaves), 2)]
        leaves = [sha(p[0] + p[-1]) for p in pairs]
    return leaves[0]


def leaf(log, pos):
    return sha(f"{log}/{pos}")


def frame(spark, spans):
    rows = [(log, i, leaf(log, i)) for log, lo, hi in spans for i in range(lo, hi)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "log int, pos bigint, hash string")


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_appends_give_the_root_of_the_whole_tree(spark, bits):
    """Three appends to logs of many sizes; some logs start late, some rest in between."""
    rng = random.Random(bits)
    cuts = {log: sorted(rng.choices(range(40), k=3)) for log in range(12)} | {50: [1, 1, 1], 51: [0, 0, 5], 52: [16, 16, 33], 53: [31, 32, 32]}
    peaks, nodes, olds = None, None, []
    for k in range(3):
        spans = [(log, c[k - 1] if k else 0, c[k]) for log, c in cuts.items()]
        fresh, peaks = append_leaves(peaks, frame(spark, spans), ["log"], bits=bits)
        nodes = fresh if nodes is None else nodes.unionByName(fresh)
        wanted = {log: (c[k], plain_root([leaf(log, i) for i in range(c[k])])) for log, c in cuts.items() if c[k]}
        assert {r["log"]: (r["leaves"], r["root"]) for r in log_roots(peaks, ["log"]).collect()} == wanted
        held = {}
        for r in peaks.collect():
            held.setdefault(r["log"], []).append(r["height"])
        assert {log: sum(1 << h for h in hs) for log, hs in held.items()} == {log: n for log, (n, _) in wanted.items()}
        olds.append(peaks)
    # No node is made twice: an append hashes only what is new.
    assert nodes.count() == nodes.select("log", "height", "at").distinct().count()
    everything = frame(spark, [(log, 0, c[2]) for log, c in cuts.items()])
    for k, peaks in enumerate(olds):
        got = log_proofs(nodes, peaks, everything, ["log"]).join(everything, ["log", "pos"])
        rows = M.verify_proofs(got).collect()
        assert len(rows) == sum(c[k] for c in cuts.values())
        assert all(r["valid"] for r in rows)
        assert all(r["root"] == plain_root([leaf(r["log"], i) for i in range(r["leaves"])]) for r in rows[:40])


def test_proofs_of_the_log_are_those_of_the_tree(spark):
    leaves = frame(spark, [(1, 0, 21), (2, 0, 8), (3, 0, 1)])
    nodes, peaks = append_leaves(None, leaves, ["log"], bits=2)
    wanted = {(r["log"], r["pos"]): (r["root"], r["path"]) for r in M.merkle_proofs(leaves, ["log"]).collect() if r["log"] != 3}
    got = {(r["log"], r["pos"]): (r["root"], r["path"]) for r in log_proofs(nodes, peaks, leaves, ["log"]).collect()}
    assert {k: v for k, v in got.items() if k[0] != 3} == wanted
    assert got[3, 0] == (leaf(3, 0), [])


def test_blocks_are_exchanged_by_log_and_block(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = []
        import govlattice.operators.merkle_log as module

        keep = module.cut_lineage

        def watch(df):
            seen.append(df._jdf.queryExecution().executedPlan().toString())
            return keep(df)

        module.cut_lineage = watch
        try:
            append_leaves(None, frame(spark, [(1, 0, 50)]), ["log"], bits=2)
        finally:
            module.cut_lineage = keep
        # Those that gather nodes; the peaks, 64 rows a log at most, are put together by log.
        climbing = [p for p in seen if "_items" in p]
        assert len(climbing) == 3
        for plan in climbing:
            dealt = re.findall(r"Exchange hashpartitioning\((.*)", plan)
            # The block's number has a name of its own where Spark groups by it.
            assert dealt and all("_block" in d or "_groupingexpression" in d for d in dealt)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_empty_append(spark):
    none = frame(spark, []).filter(F.lit(False))
    nodes, peaks = append_leaves(None, none, ["log"])
    assert nodes.count() == 0 and peaks.count() == 0
    _, one = append_leaves(peaks, frame(spark, [(7, 0, 6)]), ["log"])
    _, same = append_leaves(one, none, ["log"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, same.select(one.columns).collect()))


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_proofs_by_blocks_pass_columns_on(spark, bits):
    """Several blocks a log; leaves that occur twice are proved twice, those behind the end not at all."""
    leaves = frame(spark, [(1, 0, 21), (2, 0, 8), (3, 0, 1), (4, 0, 33)])
    nodes, peaks = append_leaves(None, leaves, ["log"], bits=bits)
    asked = leaves.unionByName(leaves.filter("log = 1")).unionByName(frame(spark, [(2, 8, 9), (5, 0, 2)]))
    # Nodes that are stored twice count once.
    got = log_proofs(nodes.unionByName(nodes), peaks, asked, ["log"], bits=bits, keep=["hash"])
    rows = M.verify_proofs(got).collect()
    assert len(rows) == 2 * 21 + 8 + 1 + 33 and all(r["valid"] for r in rows)
    wanted = {(r["log"], r["pos"]): r["path"] for r in M.merkle_proofs(leaves, ["log"]).collect() if r["log"] != 3}
    assert all(r["path"] == wanted.get((r["log"], r["pos"]), []) for r in rows)


def test_no_path_is_shuffled(spark):
    leaves = frame(spark, [(1, 0, 21)])
    nodes, peaks = append_leaves(None, leaves, ["log"], bits=2)
    plan = log_proofs(nodes, peaks, leaves, ["log"], bits=10, keep=["hash"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Generate explode" in line and "sibling_hash" in line]
    # Paths are made by the topmost generator, behind every join.
    assert joins and plan.index(joins[0]) < plan.index("Join ")


def test_a_leaf_without_a_hash_is_a_step(spark):
    leaves = frame(spark, [(1, 0, 8)]).withColumn("hash", F.when(F.col("pos") != 3, F.col("hash")))
    nodes, peaks = append_leaves(None, leaves, ["log"], bits=2)
    steps = {r["pos"]: [s["sibling_hash"] for s in r["path"]] for r in log_proofs(nodes, peaks, leaves, ["log"], bits=2).collect()}
    assert {len(s) for s in steps.values()} == {3}
    assert steps[2][0] is None and steps[5][0] == leaf(1, 4) and steps[5][2] is None


def test_hashes_are_stored_as_bytes(spark, monkeypatch):
    """Any text comes back as it was; hexadecimal ones, in small letters, are stored as half as many bytes."""
    import govlattice.operators.merkle_log as module

    texts = [leaf(1, 0), "ABCDEF", "abc", "no hash", "", None, "é" * 3, leaf(1, 7)]
    leaves = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "log int, pos bigint, hash string")
    seen, keep = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: (seen.append(df), keep(df))[1])
    nodes, _ = append_leaves(None, leaves, ["log"], bits=2)
    assert [r["hash"] for r in nodes.filter("height = 0").orderBy("at").collect()] == texts
    blocks = next(df for df in seen if "_own" in df.columns)
    stored = [n["hash"] for r in blocks.orderBy("_block").collect() for n in r["_own"]]
    assert [n["raw"] is not None for n in stored] == [True, False, False, False, True, False, False, True]
    assert bytes(stored[0]["raw"]).hex() == texts[0] and stored[0]["text"] is None
