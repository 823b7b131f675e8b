import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from govlattice.functions import scale, stats
from govlattice.operators import audit as A
from govlattice.operators import drift, fairness, federation, graph, lifecycle, privacy, retrieval
from govlattice.operators import merkle as M
from govlattice.operators import robustness as B


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def chain(spark, n=25, chains=2):
    rows = [(f"c{c}", i, f"type{i % 3}", "me", f'{{"n": {i}}}') for c in range(chains) for i in range(n)]
    return spark.createDataFrame(rows, "chain_id string, seq bigint, event_type string, actor string, payload_json string")


BODY = lambda: A.event_body(F.col("event_type"), F.col("actor"), F.col("payload_json"))


def test_seal_matches_plain_chain(spark):
    rows = A.seal(chain(spark), "chain_id", "seq", BODY()).filter("chain_id = 'c0'").orderBy("seq").collect()
    prev = "0" * 64
    for r in rows:
        assert r.prev_hash == prev
        prev = sha(prev + r.event_type + r.actor + r.payload_json)
        assert r.hash == prev


@pytest.mark.parametrize("segment", [4, 1024])
def test_tampering_is_noticed(spark, segment):
    sealed = A.seal(chain(spark), "chain_id", "seq", BODY(), segment)

    def verdict(df):
        rows = A.verify_rows(df, "chain_id", "seq", BODY(), segment, chunk=8)
        return {r.chain_id: (r.valid, r.first_bad) for r in A.verify_chains(rows, "chain_id", "seq").collect()}

    ok = (True, None)
    assert verdict(sealed) == {"c0": ok, "c1": ok}
    here = (F.col("chain_id") == "c1") & (F.col("seq") == 10)
    changed = sealed.withColumn("payload_json", F.when(here, F.lit("{}")).otherwise(F.col("payload_json")))
    assert verdict(changed) == {"c0": ok, "c1": (False, 10)}
    rehashed = sealed.withColumn("hash", F.when(here, F.lit(sha("x"))).otherwise(F.col("hash")))
    assert verdict(rehashed)["c1"] == (False, 10)
    assert verdict(sealed.filter(~here))["c1"] == (False, 11)
    heads = A.seal_heads(sealed, "chain_id", "seq", segment)
    assert heads.count() == 2 * -(-25 // segment)


@pytest.mark.parametrize("segment", [4, None])
def test_moved_and_removed_segments_are_noticed(spark, segment):
    sealed = A.seal(chain(spark, chains=1), "chain_id", "seq", BODY(), segment)

    def verdict(df):
        row = A.verify_chains(A.verify_rows(df, "chain_id", "seq", BODY(), segment, chunk=8), "chain_id", "seq").first()
        return row.valid, row.first_bad

    assert verdict(sealed) == (True, None)
    swapped = sealed.withColumn("seq", F.expr("CASE WHEN seq < 4 THEN seq + 4 WHEN seq < 8 THEN seq - 4 ELSE seq END"))
    assert verdict(swapped) == (False, 0)
    cut = sealed.filter("seq < 8 OR seq >= 12").withColumn("seq", F.expr("CASE WHEN seq >= 12 THEN seq - 4 ELSE seq END"))
    assert verdict(cut) == (False, 8)


def test_heads_notice_a_cut_tail_and_a_chain_sealed_anew(spark):
    events = chain(spark)
    sealed = A.seal(events, "chain_id", "seq", BODY(), 8)
    stored = A.segment_heads(sealed, "chain_id", "seq")
    check = lambda df: {(r.chain_id, r.segment, r.finding) for r in A.verify_heads(df, stored, "chain_id", "seq").collect()}
    assert check(sealed) == set()
    assert check(sealed.filter("seq < 24 OR chain_id = 'c1'")) == {("c0", 3, "missing")}
    anew = A.seal(events.filter("chain_id = 'c0'").withColumn("actor", F.lit("other")), "chain_id", "seq", BODY(), 8)
    assert check(anew.unionByName(sealed.filter("chain_id = 'c1'"))) == {("c0", i, "changed") for i in range(4)}
    more = sealed.unionByName(sealed.filter("seq = 0 AND chain_id = 'c0'").withColumn("chain_id", F.lit("c9")))
    assert check(more) == {("c9", 0, "unknown")}


def test_long_paths_are_found(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(18)], "src string, dst string")
    pairs = spark.createDataFrame([("n00", "n18"), ("n05", "n04")], "src string, dst string")
    found = graph.shortest_paths(edges.coalesce(1), pairs.coalesce(1), cut_every=3)
    assert [(r.src, r.hops) for r in found.collect()] == [("n00", 18)]


def brute_root(leaves):
    if not leaves:
        return sha("")
    while len(leaves) > 1:
        leaves = [sha(leaves[i] + leaves[min(i + 1, len(leaves) - 1)]) for i in range(0, len(leaves), 2)]
    return leaves[0]


def test_merkle_blocks_equal_plain_tree(spark):
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33]
    rows = [(n, i, sha(f"{n}-{i}")) for n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "t int, pos bigint, hash string")
    want = {n: brute_root([h for t, _, h in rows if t == n]) for n in sizes}
    for bits in (2, 10):
        got = {r.t: (r.root, r.leaves) for r in M.merkle_roots(df, ["t"], bits=bits).collect()}
        assert got == {n: (want[n], n) for n in sizes}
    proofs = M.verify_proofs(M.merkle_proofs(df, ["t"], bits=2))
    out = proofs.collect()
    assert len(out) == len(rows) and all(r.valid and r.root == want[r.t] for r in out)
    assert [r.path for r in out if r.t == 1] == [[]]
    assert M.EMPTY_ROOT == sha("")


def test_checkpoints(spark):
    sealed = A.seal(chain(spark), "chain_id", "seq", BODY())
    points = M.create_checkpoints(sealed, "chain_id", "seq", 8)
    assert [r.event_count for r in points.filter("chain_id = 'c0'").orderBy("batch").collect()] == [8, 8, 8, 1]
    since = spark.createDataFrame([("c0", 16)], "chain_id string, range_end bigint")
    later = M.create_checkpoints(sealed, "chain_id", "seq", 8, since).filter("chain_id = 'c0'")
    assert later.count() == 2
    proofs = M.event_proofs(sealed, points, "chain_id", "seq", 8)
    assert proofs.filter("valid").count() == 50
    wrong = points.withColumn("merkle_root", F.lit(sha("no")))
    assert M.event_proofs(sealed, wrong, "chain_id", "seq", 8).filter("valid").count() == 0


def test_positions_and_neighbours(spark):
    rows = [(k, random.Random(k * 100 + i).randrange(10**6), i) for k in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v int, id int")
    out = scale.dense_position(df, ["k"], ["v", "id"], F.floor(F.col("v") / 50_000)).collect()
    for k in range(3):
        mine = sorted((r.v, r.id, r.pos) for r in out if r.k == k)
        assert [m[2] for m in mine] == list(range(200))
    placed = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("pos"), (F.col("id") * 2).alias("x"))
    near = scale.with_neighbours(placed, ["k"], "pos", ["x"], following=2, preceding=1, chunk=7).collect()
    assert len(near) == 100
    for r in near:
        assert r.x_next2 == ((r.pos + 2) * 2 if r.pos < 98 else None)
        assert r.x_prev1 == ((r.pos - 1) * 2 if r.pos else None)


def test_exact_quantiles(spark):
    values = [random.Random(i).random() for i in range(777)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = scale.exact_quantiles(df, "v", {"a": 0.95, "b": 0.05, "c": 0.5, "d": 0.0, "e": 1.0}, 16).collect()[0]
    for n, q in zip("abcde", (0.95, 0.05, 0.5, 0.0, 1.0)):
        assert row[n] == pytest.approx(float(np.quantile(values, q)))
    assert scale.nth_smallest(df, "v", 10).collect()[0].threshold == sorted(values)[9]


def test_p_values():
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert stats.chi2_tail(9.487729036781154, 4) == pytest.approx(0.05)
    assert stats.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert stats._ks_same_size_tail(6, 20) == pytest.approx(stats._ks_lattice_tail(6, 20, 20))
    # All of 2 against all of 2 apart: 2 of the 6 orders.
    assert stats.ks_tail(1.0, 2, 2) == pytest.approx(2 / 6)
    assert stats.ks_tail(1.0, 2, 3) == pytest.approx(2 / 10)
    assert stats.ks_tail(0.03, 20_000, 20_000) < 1e-6


def groups(spark, spec):
    return spark.createDataFrame(
        [(g, i < k) for g, k, n in spec for i in range(n)], "grp string, ok boolean"
    )


def test_fairness(spark):
    def audit(spec):
        df = groups(spark, spec)
        m = {(r.group, r.metric_name): r for r in fairness.fairness_metrics(df, "grp", F.col("ok")).collect()}
        return fairness.fairness_audit(df, "grp", F.col("ok")).collect()[0], m

    row, m = audit([("A", 90, 100), ("B", 40, 100)])
    assert row.reference_group == "A" and not row.overall_fair
    assert m[("B", "disparate_impact_ratio")].value == 0.4444
    row, m = audit([("A", 50, 100), ("B", 50, 100)])
    assert row.overall_fair and len(m) == 2
    row, m = audit([("A", 80, 100), ("B", 78, 100), ("C", 20, 100)])
    assert not row.overall_fair and {g for g, _ in m} == {"B", "C"}
    row, m = audit([("A", 5, 10)])
    assert row.overall_fair and not m
    row, m = audit([("A", 0, 10), ("B", 0, 10)])
    assert row.overall_fair and m[("B", "disparate_impact_ratio")].value == 1.0
    chi = fairness.chi_square_significance(groups(spark, [("A", 90, 100), ("B", 40, 100)]), "grp", F.col("ok")).collect()[0]
    assert chi.chi2_statistic == pytest.approx(52.769, abs=1e-3) and chi.significant and chi.degrees_of_freedom == 1
    for spec, status in ([("A", 5, 10)], "single_group"), ([("A", 0, 9), ("B", 0, 9)], "degenerate_outcome"):
        row = fairness.chi_square_significance(groups(spark, spec), "grp", F.col("ok")).collect()[0]
        assert row.status == status and row.chi2_statistic is None


def test_simpson(spark):
    rows = []
    for g, d, k, n in (("M", "A", 80, 90), ("F", "A", 9, 10), ("M", "B", 1, 10), ("F", "B", 10, 90)):
        rows += [(g, d, i < k) for i in range(n)]
    df = spark.createDataFrame(rows, "grp string, dept string, ok boolean")
    out = fairness.stratified_audit(df, "grp", F.col("ok"), "dept")
    assert [(r.overall_fair, r.aggregate_fair, r.paradox) for r in out.collect()] == [(True, False, True)] * 2
    assert fairness.simpson_summary(out).collect()[0].simpsons_paradox


def test_drift(spark):
    rng = np.random.default_rng(0)
    same, far = rng.normal(50, 5, 200), rng.normal(90, 5, 200)
    rows = [("same", False, float(v)) for v in same] + [("same", True, float(v)) for v in same]
    rows += [("far", False, float(v)) for v in same] + [("far", True, float(v)) for v in far] + [("few", True, 1.0)]
    df = spark.createDataFrame(rows, "metric string, cur boolean, v double")
    out = {r.metric: r for r in drift.detect_drift(df, ["metric"], F.col("cur"), "v", buckets=9).collect()}
    assert out["same"].ks_statistic == 0.0 and not out["same"].drift_detected
    assert out["far"].drift_detected and out["far"].p_value < 1e-10
    assert out["few"].status == "too_few_values" and out["few"].drift_detected is None


def test_privacy(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 5, 5, 1000)], "v double")
    row = privacy.private_mean(df, "v", 0, 10, seed=1, keep_true=True).collect()[0]
    assert row.true_value == 6.25 and row.sensitivity == 2.5
    counts = privacy.private_count(spark.range(100), F.col("id") % 2 == 0, epsilon=1000, seed=3, keep_true=True)
    first, again = counts.collect()[0], counts.collect()[0]
    assert first.true_value == 50 and abs(first.noisy_value - 50) < 1 and first.noisy_value == again.noisy_value
    unseeded = privacy.private_count(spark.range(100), F.lit(True))
    assert unseeded.collect() == unseeded.collect() and "true_value" not in unseeded.columns
    noise = spark.range(20000).select(privacy.laplace_noise(F.lit(2.0), [F.col("id")], 5).alias("n"))
    stat = noise.agg(F.avg("n").alias("m"), F.avg(F.abs("n")).alias("a")).collect()[0]
    assert abs(stat.m) < 0.1 and stat.a == pytest.approx(2.0, rel=0.05)
    for bad in (0, -1):
        with pytest.raises(ValueError):
            privacy.private_count(df, F.lit(True), epsilon=bad)
    assert privacy.advanced_composition_value(0.05, 50, 1e-6) == pytest.approx(
        (2 * 50 * np.log(1e6)) ** 0.5 * 0.05 + 50 * 0.05 * (np.exp(0.05) - 1)
    )


@pytest.mark.parametrize("chunk_rows", [8_192, 7])
def test_budget(spark, chunk_rows):
    rnd = random.Random(1)
    rows = [(b, i, rnd.choice([0.001, 0.05, 0.4, -1.0]) * rnd.random()) for b in (1, 2) for i in range(150 if b == 1 else 20)]
    want, spent = {}, {}
    for b, i, e in rows:
        s = spent.get(b, 0.0)
        ok = e > 0 and e <= round(1.0 - s, 10) + 1e-9
        spent[b] = s + e if ok else s
        want[(b, i)] = (ok, round(spent[b], 6))
    df = spark.createDataFrame(rows, "budget_id int, seq bigint, epsilon double")
    out = privacy.spend_budget(df, 1.0, chunk_rows=chunk_rows).collect()
    assert {(r.budget_id, r.seq): (r.accepted, round(r.spent, 6)) for r in out} == want


@pytest.mark.parametrize("chunk_rows", [8_192, 3, 1])
def test_budget_of_any_shape(spark, chunk_rows):
    """Nearly fitting spends in every chunk, powers of two, one unit too much, nulls, repeated rows, no rows."""
    rnd = random.Random(2)
    nearly = [x for i in range(40) for x in (0.01, 1.0 - 0.01 * i)]
    powers = [2.0 ** -rnd.randint(0, 30) for _ in range(60)]
    exact = [0.1] * 10 + [1e-9, 2e-9, 1e-12, None, float("nan"), float("inf"), -1.0, 0.0]
    ledgers = {"nearly": nearly, "powers": powers, "exact": exact, None: [0.7, 0.2, 0.7, 0.1]}
    rows = [(b, 5 * i, e) for b, spends in ledgers.items() for i, e in enumerate(spends)]
    rows += [("again", 1, 0.6), ("again", 1, 0.6), ("again", None, 0.3)]
    ledgers["again"] = [0.3, 0.6, 0.6]
    want = []
    for b, spends in ledgers.items():
        units = [None if e is None or not -9 < e < 9 else privacy.in_units(e) for e in spends]
        verdicts = [ok for ok, _ in privacy.decide(units, privacy.in_units(1.0) + privacy.in_units(privacy.TOLERANCE))]
        spent = 0.0
        for ok, e in zip(verdicts, spends):
            spent += e if ok else 0.0
            want.append((str(b), ok, round(spent, 9)))
    df = spark.createDataFrame(rows, "budget_id string, seq bigint, epsilon double")
    out = privacy.spend_budget(df, 1.0, chunk_rows=chunk_rows)
    got = sorted((str(r.budget_id), r.accepted, round(r.spent, 9)) for r in out.collect())
    assert got == sorted(want) and out.columns == ["budget_id", "seq", "epsilon", "accepted", "spent", "remaining"]
    assert privacy.spend_budget(df.limit(0), 1.0).count() == 0
    nothing = privacy.spend_budget(df, privacy.F.lit(None)).filter("accepted or spent > 0 or remaining is not null")
    assert nothing.count() == 0


def test_federation(spark):
    df = spark.createDataFrame(
        [("a", 100.0, "low"), ("a", 50.005, "medium"), ("b", 5.0, "critical")], "node string, score double, risk_level string"
    )
    reports = federation.node_reports(df)
    out = {r.node: r for r in reports.collect()}
    assert out["a"].risk_level_counts == {"low": 1, "medium": 1} and out["b"].deny_count == 1
    row = federation.aggregate_federation(reports).collect()[0]
    assert (row.node_count, row.worst_node, row.best_node) == (2, "b", "a")
    checks = spark.createDataFrame([("a", True), ("a", True), ("a", False), ("b", True)], "node string, healthy boolean")
    nodes = {r.node: r for r in federation.node_compliance(checks, 0.6667).collect()}
    # The shown rate rounds up to the threshold, the verdict does not.
    assert nodes["a"].compliance_rate == 0.6667 and not nodes["a"].compliant


def test_lifecycle(spark):
    items = spark.createDataFrame([(1,), (2,)], "item_id int")
    dec = spark.createDataFrame(
        [(1, 5, True, "x", None), (1, 3, False, "y", "no"), (9, 1, True, "z", None)],
        "item_id int, seq int, approve boolean, reviewer string, notes string",
    )
    out = {r.item_id: r for r in lifecycle.oversight_state(items, dec).collect()}
    assert out[1].status == "rejected" and out[1].reviewer == "y" and out[2].status == "pending"
    rej = {(r.item_id, r.reason) for r in lifecycle.rejected_decisions(items, dec).collect()}
    assert rej == {(1, "already_decided"), (9, "unknown_item")}
    assert lifecycle.find(items, spark.createDataFrame([(1,), (7,)], "item_id int")).filter("found").count() == 1


def test_graph(spark):
    corpus = spark.createDataFrame(
        [("38º", "r", "a.txt", "Art. 38 cita o Art. 11 e art 20."), ("11", "s", "b.txt", "art. 99"), ("20", "t", "c.txt", "Art.9º"),
         ("9", "u", "d.txt", ""), ("48", "v", "e.txt", "part 5"), ("5", "w", "f.txt", "")],
        "article string, tema string, source string, text string",
    )
    edges = graph.mention_edges(corpus)
    assert {(r.src, r.dst) for r in edges.collect()} == {("art_38", "art_11"), ("art_38", "art_20"), ("art_20", "art_9"), ("art_48", "art_5")}
    assert graph.mention_edges(corpus, graph.MENTION_STRICT).count() == 3
    src = spark.createDataFrame([("art_9",)], "id string")
    assert {(r.id, r.distance) for r in graph.find_related(edges, src, 3).collect()} == {("art_20", 1), ("art_38", 2), ("art_11", 3)}
    pairs = spark.createDataFrame([("art_38", "art_9"), ("art_48", "art_9"), ("art_38", "art_38")], "src string, dst string")
    out = {(r.src, r.dst): r.path for r in graph.shortest_paths(edges, pairs).collect()}
    assert out == {("art_38", "art_9"): ["art_38", "art_20", "art_9"], ("art_38", "art_38"): ["art_38"]}


def test_retrieval_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, query_vector array<double>")
    sims = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    want = {(i, r + 1): int(j) for i in range(7) for r, j in enumerate(np.argsort(-sims[i])[:4])}
    for size in (512, 3):
        monkeypatch.setattr(retrieval, "QUERIES_PER_BLOCK", size)
        got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.nearest_vectors(corpus, queries, 4).collect()}
        assert got == want


def test_robustness(spark):
    rng = np.random.default_rng(2)
    pts = [(i, (rng.normal(-1 if i % 2 else 1, 0.6, 2)).tolist(), i % 2) for i in range(400)]
    df = spark.createDataFrame(pts, "id bigint, x array<double>, y int")
    model = B.fit_linear(df)
    none = B.attack_report(B.fgsm(df, model, 0.0), model, "fgsm", 0.0).collect()[0]
    assert none.accuracy_drop == 0.0 and none.clean_accuracy > 0.9
    moved = B.pgd(B.fgsm(df, model, 0.5, name="f"), model, 0.5, 0.1)
    far = moved.select(F.max(F.array_max(F.zip_with("x", "x_adv", lambda a, b: F.abs(a - b)))).alias("m")).collect()[0].m
    assert far <= 0.5 + 1e-9
    f = B.attack_report(moved, model, "fgsm", adversarial="f").collect()[0]
    p = B.attack_report(moved, model, "pgd").collect()[0]
    assert f.accuracy_drop > 0 and p.adversarial_accuracy <= f.adversarial_accuracy + 1e-9
    curve = [r.adversarial_accuracy for r in B.robustness_curve(df, model).orderBy("epsilon").collect()]
    assert all(a + 0.1 >= b for a, b in zip(curve, curve[1:]))
    one = spark.createDataFrame([(0.0, 0.9), (0.1, 0.6), (0.2, 0.4)], "epsilon double, adversarial_accuracy double")
    assert B.min_perturbation_budget(one, F.lit(0.5)).collect()[0][0] == 0.2
    risk = spark.range(1).select(B.robustness_risk(F.lit(0.95), F.lit(0.93)), B.robustness_risk(F.lit(0.95), F.lit(0.10))).collect()[0]
    assert tuple(risk) == ("low", "critical")
    # The start of the attack does not depend on the partitioning.
    a = {r.id: r.x_adv for r in B.pgd(df, model).collect()}
    b = {r.id: r.x_adv for r in B.pgd(df.repartition(7), model).collect()}
    assert a == b


def test_article_paths_of_any_length(spark):
    """Equal to a plain search over the whole table; many paths have five mentions or more."""
    from govlattice.catalog import knowledge as K

    base = "/root/testdata/sf0.001"
    orders = [(r.o_orderkey, r.o_custkey) for r in spark.read.parquet(f"{base}/orders.parquet").collect()]
    m = max(k for k, _ in orders) + 1
    known = {k for k, _ in orders}
    to = {k: sorted({f"art_{x}" for x in ((k * 31 + c * 7 + 1) % m, (k * 7 + 3) % m) if x != k and x in known}) for k, c in orders}
    wanted = {}
    for k, _ in orders:
        src, dst = f"art_{k}", f"art_{(k * 49 + 5) % m}"
        level = {src: [src]}
        seen = {src}
        while level and dst not in level:
            following = {}
            for at, path in level.items():
                for x in to[int(at[4:])]:
                    if x not in seen:
                        following[x] = min(following.get(x, [*path, x]), [*path, x])
            seen |= set(following)
            level = following
        if dst in level:
            wanted[src, dst] = (">".join(level[dst]), len(level[dst]) - 1)
    got = {(r.src, r.dst): (r.path, r.hops) for r in K.QUERIES["shortest_article_paths_of_any_length"](spark, base).collect()}
    assert got == wanted
    assert sum(hops > 4 for _, hops in got.values()) > len(got) // 2
