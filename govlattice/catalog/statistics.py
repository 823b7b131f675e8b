"""Queries: fairness, drift, privacy, federation, observability."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlattice.operators import drift, fairness, federation, privacy
from govlattice.session import table
from govlattice.sources import exports

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


APPLICANTS_SQL = """WITH ap AS (SELECT c_mktsegment AS segment, o_orderpriority AS priority,
      c_nationkey AS nation, o_totalprice > 150000 AS ok
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def applicants(spark, base):
    orders = table(spark, base, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    customers = table(spark, base, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_nationkey").alias("nation"),
        (F.col("o_totalprice") > 150000).alias("ok"),
    )


def _fair_sql(keys: str, group: str) -> str:
    sel = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""{APPLICANTS_SQL}, g AS (SELECT {sel}{group} AS grp, count(*) AS size,
        count(*) FILTER (WHERE ok) AS fav, count(*) FILTER (WHERE ok) / count(*) AS rate
        FROM ap GROUP BY ALL),
      r AS (SELECT *, first_value(grp) OVER w AS ref, first_value(rate) OVER w AS refrate
        FROM g WINDOW w AS ({part} ORDER BY rate DESC, grp)),
      m AS (SELECT *, CASE WHEN refrate > 0 THEN rate / refrate ELSE 1.0 END AS di, refrate - rate AS dp FROM r)"""


@query(
    "fairness_metrics",
    _fair_sql("", "segment")
    + """ SELECT grp AS "group", ref AS reference_group, metric_name, value, threshold, passed FROM (
        SELECT grp, ref, 'disparate_impact_ratio' AS metric_name, round(di, 4)::DOUBLE AS value,
          0.8::DOUBLE AS threshold, di >= 0.8 AS passed FROM m WHERE grp <> ref
        UNION ALL SELECT grp, ref, 'demographic_parity_difference', round(dp, 4)::DOUBLE,
          0.2::DOUBLE, dp <= 1.0 - 0.8 FROM m WHERE grp <> ref)""",
)
def fairness_metrics(spark, base):
    return fairness.fairness_metrics(applicants(spark, base), "segment", F.col("ok"))


@query(
    "fairness_by_nation",
    _fair_sql("nation", "segment")
    + """ SELECT nation, sum(size)::BIGINT AS n, count(*)::BIGINT AS groups, min(ref) AS reference_group,
        bool_and(grp = ref OR (di >= 0.8 AND dp <= 1.0 - 0.8)) AS overall_fair FROM m GROUP BY nation""",
)
def fairness_by_nation(spark, base):
    return fairness.fairness_audit(applicants(spark, base), "segment", F.col("ok"), ["nation"])


@query(
    "fairness_of_labels",
    """WITH l AS (SELECT lang, quality = 1 AS ok FROM documents JOIN labels USING (doc_id)),
       g AS (SELECT lang, count(*) AS size, count(*) FILTER (WHERE ok) / count(*) AS rate FROM l GROUP BY 1),
       r AS (SELECT *, first_value(lang) OVER (ORDER BY rate DESC, lang) AS ref,
               max(rate) OVER () AS refrate FROM g)
       SELECT sum(size)::BIGINT AS n, count(*)::BIGINT AS groups, min(ref) AS reference_group,
         bool_and(lang = ref OR (rate / refrate >= 0.8 AND refrate - rate <= 1.0 - 0.8)) AS overall_fair FROM r""",
)
def fairness_of_labels(spark, base):
    docs = table(spark, base, "documents").select("doc_id", "lang")
    labels = table(spark, base, "labels").select("doc_id", "quality")
    return fairness.fairness_audit(docs.join(labels, "doc_id"), "lang", F.col("quality") == 1)


CHI_SQL = """, c AS (SELECT {key}{grp} AS grp, count(*) AS size, count(*) FILTER (WHERE ok) AS fav FROM ap {where} GROUP BY ALL),
    t AS (SELECT *, sum(size) OVER w AS n, sum(fav) OVER w AS f, count(*) OVER w AS k FROM c WINDOW w AS ({part})),
    e AS (SELECT *, size * f / n AS e1, size * (n - f) / n AS e0 FROM t),
    d AS (SELECT *, abs(fav - e1) - CASE WHEN k = 2 THEN least(0.5, abs(fav - e1)) ELSE 0 END AS g1,
       abs(size - fav - e0) - CASE WHEN k = 2 THEN least(0.5, abs(size - fav - e0)) ELSE 0 END AS g0 FROM e)"""


@query(
    "chi_square_by_nation",
    APPLICANTS_SQL
    + CHI_SQL.format(key="nation, ", grp="segment", where="", part="PARTITION BY nation")
    + """ SELECT nation, CASE WHEN min(f) > 0 AND min(f) < min(n) AND count(*) > 1 THEN
         round(sum(g1*g1/e1 + g0*g0/e0), 6)::DOUBLE END AS chi2_statistic,
         (count(*) - 1)::INT AS degrees_of_freedom FROM d GROUP BY nation""",
)
def chi_square_by_nation(spark, base):
    return fairness.chi_square_significance(
        applicants(spark, base), "segment", F.col("ok"), ["nation"]
    ).select("nation", "chi2_statistic", "degrees_of_freedom")


@query(
    "chi_square_two_groups",
    APPLICANTS_SQL
    + CHI_SQL.format(
        key="priority, ", grp="(segment = 'BUILDING')", where="", part="PARTITION BY priority"
    )
    + """ SELECT priority, round(sum(g1*g1/e1 + g0*g0/e0), 6)::DOUBLE AS chi2_statistic,
         (count(*) - 1)::INT AS degrees_of_freedom,
         sum(g1*g1/e1 + g0*g0/e0) > 3.841458820694124 AS significant FROM d GROUP BY priority""",
)
def chi_square_two_groups(spark, base):
    """One degree of freedom: the verdict is the statistic against a constant."""
    rows = applicants(spark, base).withColumn("building", F.col("segment") == "BUILDING")
    return fairness.chi_square_significance(rows, "building", F.col("ok"), ["priority"]).select(
        "priority", "chi2_statistic", "degrees_of_freedom", "significant"
    )


@query(
    "stratified_fairness",
    _fair_sql("priority", "segment").replace("WITH ap", "WITH ap", 1)
    + """, s AS (SELECT priority AS stratum, sum(size)::BIGINT AS n, count(*)::BIGINT AS groups,
          bool_and(grp = ref OR (di >= 0.8 AND dp <= 1.0 - 0.8)) AS overall_fair FROM m GROUP BY 1),
        og AS (SELECT segment AS grp, count(*) FILTER (WHERE ok) / count(*) AS rate FROM ap GROUP BY 1),
        o AS (SELECT bool_and(rate = mx OR (CASE WHEN mx > 0 THEN rate / mx ELSE 1 END >= 0.8 AND mx - rate <= 1.0 - 0.8)) AS aggregate_fair
          FROM (SELECT *, max(rate) OVER () AS mx FROM og))
        SELECT stratum, n, groups, overall_fair, groups > 1 AS has_comparison, aggregate_fair,
          groups > 1 AND overall_fair <> aggregate_fair AS paradox FROM s, o""",
)
def stratified_fairness(spark, base):
    return fairness.stratified_audit(applicants(spark, base), "segment", F.col("ok"), "priority")


@query("simpson_paradox")
def simpson_paradox(spark, base):
    return fairness.simpson_summary(
        fairness.stratified_audit(applicants(spark, base), "segment", F.col("ok"), "priority")
    )


@query(
    "drift_by_event_type",
    """WITH s AS (SELECT event_type, value AS v, ts >= TIMESTAMP '2024-01-16' AS cur FROM events WHERE value IS NOT NULL),
       g AS (SELECT event_type, v, count(*) FILTER (WHERE NOT cur) AS a, count(*) FILTER (WHERE cur) AS b FROM s GROUP BY 1, 2),
       c AS (SELECT event_type, sum(a) OVER w AS ca, sum(b) OVER w AS cb,
          sum(a) OVER (PARTITION BY event_type) AS na, sum(b) OVER (PARTITION BY event_type) AS nb
          FROM g WINDOW w AS (PARTITION BY event_type ORDER BY v))
       SELECT event_type, max(na)::BIGINT AS n_baseline, max(nb)::BIGINT AS n_current,
         round(max(abs(ca / na - cb / nb)), 9)::DOUBLE AS ks_statistic FROM c GROUP BY 1""",
)
def drift_by_event_type(spark, base):
    events = table(spark, base, "events").select("event_type", "value", "ts")
    current = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    return drift.detect_drift(events, ["event_type"], current, "value").select(
        "event_type", "n_baseline", "n_current", "ks_statistic"
    )


@query(
    "drift_of_prices",
    """WITH s AS (SELECT l_extendedprice AS v, l_shipdate >= TIMESTAMP '1995-06-17' AS cur FROM lineitem),
       g AS (SELECT v, count(*) FILTER (WHERE NOT cur) AS a, count(*) FILTER (WHERE cur) AS b FROM s GROUP BY 1),
       c AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb
          FROM g WINDOW w AS (ORDER BY v))
       SELECT max(na)::BIGINT AS n_baseline, max(nb)::BIGINT AS n_current,
         round(max(abs(ca / na - cb / nb)), 9)::DOUBLE AS ks_statistic FROM c""",
)
def drift_of_prices(spark, base):
    """One metric over the whole line items: a single key with all rows."""
    items = table(spark, base, "lineitem").select("l_extendedprice", "l_shipdate")
    current = F.col("l_shipdate") >= F.lit("1995-06-17").cast("timestamp_ntz")
    return drift.detect_drift(items, [], current, "l_extendedprice").select(
        "n_baseline", "n_current", "ks_statistic"
    )


@query("drift_verdicts")
def drift_verdicts(spark, base):
    events = table(spark, base, "events").select("event_type", "value", "ts")
    current = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    return drift.detect_drift(events, ["event_type"], current, "value")


# -- privacy -------------------------------------------------------------------------


# A seeded draw: 52 bits of a hash of the seed and the group, as a uniform number in (-0.5, 0.5).
NOISE_SQL = """, u AS (SELECT *, (('0x' || substr(sha256('seed:7' || chr(31) || {key}), 1, 13))::BIGINT + 0.5) / 4503599627370496 - 0.5 AS u FROM c)
       SELECT * EXCLUDE (u, raw, sens), 'laplace' AS mechanism,
         round(raw - sens / epsilon * sign(u) * ln(1 - 2 * abs(u)), 6)::DOUBLE AS noisy_value FROM u"""


@query(
    "private_counts",
    """WITH c AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 150000)::DOUBLE AS true_value,
         0.5::DOUBLE AS epsilon, 1.0::DOUBLE AS sensitivity, true_value AS raw, sensitivity AS sens FROM orders GROUP BY 1)"""
    + NOISE_SQL.format(key="o_orderpriority"),
)
def private_counts(spark, base):
    """Seeded, so that the released values can be compared; ``private_release`` draws its own secret."""
    orders = table(spark, base, "orders").select("o_orderpriority", "o_totalprice")
    return privacy.private_count(
        orders,
        F.col("o_totalprice") > 150000,
        epsilon=0.5,
        by=["o_orderpriority"],
        seed=7,
        keep_true=True,
    ).withColumn("noisy_value", F.round("noisy_value", 6))


@query(
    "private_means",
    """WITH c AS (SELECT c_mktsegment, avg(least(greatest(c_acctbal, 0), 5000)) AS raw, 5000.0::DOUBLE / count(*) AS sens,
         round(raw, 6)::DOUBLE AS true_value, round(sens, 9)::DOUBLE AS sensitivity, 1.0::DOUBLE AS epsilon FROM customer GROUP BY 1)"""
    + NOISE_SQL.format(key="c_mktsegment"),
)
def private_means(spark, base):
    customers = table(spark, base, "customer").select("c_mktsegment", "c_acctbal")
    out = privacy.private_mean(
        customers, "c_acctbal", 0, 5000, by=["c_mktsegment"], seed=7, keep_true=True
    )
    digits = {"true_value": 6, "sensitivity": 9, "noisy_value": 6}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("private_release")
def private_release(spark, base):
    orders = table(spark, base, "orders").select("o_orderpriority", "o_totalprice")
    return privacy.private_count(
        orders, F.col("o_totalprice") > 150000, epsilon=0.5, by=["o_orderpriority"]
    )


@query(
    "advanced_composition",
    """WITH k AS (SELECT user_id, count(*) AS k FROM events GROUP BY 1)
       SELECT user_id, k::BIGINT AS k,
         round(sqrt(2 * k * ln(1 / 1e-6)) * 0.05 + k * 0.05 * (exp(0.05) - 1), 9)::DOUBLE AS epsilon FROM k""",
)
def advanced_composition(spark, base):
    per_user = table(spark, base, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("k"))
    eps = privacy.advanced_composition(F.lit(0.05), F.col("k"), F.lit(1e-6))
    return per_user.select("user_id", "k", F.round(eps, 9).alias("epsilon"))


def _ledger(spark, base):
    return table(spark, base, "events").select(
        F.col("user_id").alias("budget_id"),
        F.col("event_id").alias("seq"),
        (F.col("value") / 100).alias("epsilon"),
    )


@query(
    "budget_ledger",
    """WITH RECURSIVE l AS (SELECT user_id AS budget_id, event_id AS seq, value / 100 AS epsilon,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
       w AS (SELECT budget_id, seq, epsilon, rn, epsilon > 0 AND epsilon <= round(5.0 - 0.0, 10) + 1e-9 AS accepted,
           CASE WHEN epsilon > 0 AND epsilon <= round(5.0 - 0.0, 10) + 1e-9 THEN epsilon ELSE 0.0 END::DOUBLE AS spent FROM l WHERE rn = 1
         UNION ALL
         SELECT l.budget_id, l.seq, l.epsilon, l.rn,
           l.epsilon > 0 AND l.epsilon <= round(5.0 - w.spent, 10) + 1e-9,
           (w.spent + CASE WHEN l.epsilon > 0 AND l.epsilon <= round(5.0 - w.spent, 10) + 1e-9 THEN l.epsilon ELSE 0.0 END)::DOUBLE
         FROM w JOIN l ON l.budget_id = w.budget_id AND l.rn = w.rn + 1)
       SELECT budget_id, seq, accepted, round(spent, 6) AS spent FROM w""",
)
def budget_ledger(spark, base):
    out = privacy.spend_budget(_ledger(spark, base), 5.0)
    return out.select("budget_id", "seq", "accepted", F.round("spent", 6).alias("spent"))


@query(
    "budget_summary",
    """WITH RECURSIVE l AS (SELECT user_id AS budget_id, value / 100 AS epsilon,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
       w AS (SELECT budget_id, rn, CASE WHEN epsilon > 0 AND epsilon <= 20 + 1e-9 THEN epsilon ELSE 0 END::DOUBLE AS spent,
           CASE WHEN epsilon > 0 AND epsilon <= 20 + 1e-9 THEN 1 ELSE 0 END AS n FROM l WHERE rn = 1
         UNION ALL
         SELECT l.budget_id, l.rn, (w.spent + CASE WHEN l.epsilon > 0 AND l.epsilon <= round(20.0 - w.spent, 10) + 1e-9 THEN l.epsilon ELSE 0 END)::DOUBLE,
           w.n + CASE WHEN l.epsilon > 0 AND l.epsilon <= round(20.0 - w.spent, 10) + 1e-9 THEN 1 ELSE 0 END
         FROM w JOIN l ON l.budget_id = w.budget_id AND l.rn = w.rn + 1)
       SELECT budget_id, max(rn)::BIGINT AS spends, max(n)::BIGINT AS accepted, round(max(spent), 6) AS spent FROM w GROUP BY 1""",
)
def budget_summary(spark, base):
    return (
        privacy.spend_budget(_ledger(spark, base), 20.0)
        .groupBy("budget_id")
        .agg(
            F.count(F.lit(1)).alias("spends"),
            F.count_if("accepted").alias("accepted"),
            F.round(F.max("spent"), 6).alias("spent"),
        )
    )


# -- federation and observability --------------------------------------------------------

NODE_SQL = """WITH s AS (SELECT c_nationkey AS node, least(100.0, greatest(0.0, o_totalprice / 4000.0))::DOUBLE AS score
      FROM orders JOIN customer ON o_custkey = c_custkey),
    b AS (SELECT *, CASE WHEN score >= 80 THEN 'low' WHEN score >= 50 THEN 'medium' WHEN score >= 20 THEN 'high' ELSE 'critical' END AS risk FROM s),
    n AS (SELECT node, count(*)::BIGINT AS total_evaluations, round(avg(score), 2) AS avg_trust_score,
      count(*) FILTER (WHERE score <= 5)::BIGINT AS deny_count, count(*) FILTER (WHERE risk = 'critical')::BIGINT AS n_critical FROM b GROUP BY 1)"""


def _node_scores(spark, base):
    from govlattice.operators.trust import risk_band

    orders = table(spark, base, "orders").select("o_custkey", "o_totalprice")
    customers = table(spark, base, "customer").select("c_custkey", "c_nationkey")
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("o_totalprice") / 4000.0))
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .select(F.col("c_nationkey").alias("node"), score.alias("score"))
        .withColumn("risk_level", risk_band(F.col("score")))
    )


@query("node_reports", NODE_SQL + " SELECT * FROM n")
def node_reports(spark, base):
    return federation.node_reports(_node_scores(spark, base)).select(
        "node",
        "total_evaluations",
        "avg_trust_score",
        "deny_count",
        F.coalesce(F.try_element_at("risk_level_counts", F.lit("critical")), F.lit(0)).alias(
            "n_critical"
        ),
    )


@query(
    "federation_summary",
    NODE_SQL
    + """ SELECT count(*)::BIGINT AS node_count, sum(total_evaluations)::BIGINT AS total_evaluations,
        round(sum(avg_trust_score * total_evaluations) / sum(total_evaluations), 2)::DOUBLE AS weighted_avg_trust_score,
        sum(deny_count)::BIGINT AS total_deny_count,
        (SELECT node FROM n ORDER BY avg_trust_score, node LIMIT 1) AS worst_node,
        (SELECT node FROM n ORDER BY avg_trust_score DESC, node LIMIT 1) AS best_node FROM n""",
)
def federation_summary(spark, base):
    return federation.aggregate_federation(
        federation.node_reports(_node_scores(spark, base))
    )


@query(
    "node_compliance",
    """SELECT user_id AS node, count(*)::BIGINT AS checks_total,
        count(*) FILTER (WHERE event_type <> 'error')::BIGINT AS checks_healthy,
        round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 4)::DOUBLE AS compliance_rate,
        count(*) FILTER (WHERE event_type <> 'error') / count(*) >= 0.9 AS compliant FROM events GROUP BY 1""",
)
def node_compliance(spark, base):
    checks = table(spark, base, "events").select(
        F.col("user_id").alias("node"), (F.col("event_type") != "error").alias("healthy")
    )
    return federation.node_compliance(checks, 0.9)


@query(
    "federation_compliance",
    """WITH n AS (SELECT user_id, count(*) AS t, count(*) FILTER (WHERE event_type <> 'error') AS h FROM events GROUP BY 1)
       SELECT count(*)::BIGINT AS nodes, round(sum(h) / sum(t), 4)::DOUBLE AS federation_compliance_rate,
         count(*) FILTER (WHERE h / t < 0.9)::BIGINT AS non_compliant_nodes FROM n""",
)
def federation_compliance(spark, base):
    return federation.federation_compliance(node_compliance(spark, base))


@query(
    "non_compliant_nodes",
    """SELECT user_id AS node, round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 4)::DOUBLE AS compliance_rate,
         count(*) FILTER (WHERE event_type = 'error')::BIGINT AS checks_failed
       FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type <> 'error') / count(*) < 0.9""",
)
def non_compliant_nodes(spark, base):
    return federation.non_compliant_nodes(node_compliance(spark, base))


def _calls(spark, base):
    return table(spark, base, "events").select(
        F.col("event_type").alias("module"),
        F.col("value").alias("duration_ms"),
        F.when(F.expr("event_id % 17 = 0"), "error").otherwise("ok").alias("status"),
    )


@query(
    "call_snapshot",
    """SELECT event_type AS module, count(*)::BIGINT AS calls, count(*) FILTER (WHERE event_id % 17 = 0)::BIGINT AS errors,
         round(coalesce(avg(value), 0), 4)::DOUBLE AS avg_duration_ms, grouping(event_type)::INT AS is_total
       FROM events GROUP BY ROLLUP (event_type)""",
)
def call_snapshot(spark, base):
    return federation.call_snapshot(_calls(spark, base))


@query(
    "metrics_text_export",
    """WITH m AS (SELECT event_type AS module, count(*) AS c FROM events GROUP BY 1),
       t AS (SELECT count(*) FILTER (WHERE event_id % 17 = 0) AS e, round(coalesce(avg(value), 0), 4) AS d FROM events),
       l AS (SELECT 10 AS a, '' AS b, '# HELP governance_module_calls_total Calls recorded for each module.' AS line
         UNION ALL SELECT 11, '', '# TYPE governance_module_calls_total counter'
         UNION ALL SELECT 12, module, 'governance_module_calls_total{module="' || module || '"} ' || c FROM m
         UNION ALL SELECT 20, '', '# HELP governance_module_call_errors_total Calls that ended in an error.'
         UNION ALL SELECT 21, '', '# TYPE governance_module_call_errors_total counter'
         UNION ALL SELECT 22, '', 'governance_module_call_errors_total ' || e FROM t
         UNION ALL SELECT 30, '', '# HELP governance_module_call_duration_ms_avg Mean duration of the recorded calls in milliseconds.'
         UNION ALL SELECT 31, '', '# TYPE governance_module_call_duration_ms_avg gauge'
         UNION ALL SELECT 32, '', 'governance_module_call_duration_ms_avg ' || printf('%.4f', d) FROM t)
       SELECT line FROM l""",
)
def metrics_text_export(spark, base):
    """Exposition lines of all three metrics."""
    return exports.prometheus_lines(federation.call_snapshot(_calls(spark, base))).select("line")


@query(
    "progress_rollup",
    """WITH m AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'done' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'blocked'
           WHEN 3 THEN 'planned' WHEN 4 THEN 'odd' END AS status, p_size AS passed, p_size + 5 AS total FROM part)
       SELECT count(*)::BIGINT AS total_modules, count(*) FILTER (WHERE status IS NULL OR status IN ('planned', 'odd'))::BIGINT AS planned,
         count(*) FILTER (WHERE status = 'in_progress')::BIGINT AS in_progress, count(*) FILTER (WHERE status = 'done')::BIGINT AS done,
         count(*) FILTER (WHERE status = 'blocked')::BIGINT AS blocked,
         round(count(*) FILTER (WHERE status = 'done') / count(*) * 100, 1)::DOUBLE AS percent_done,
         (sum(passed) FILTER (WHERE status IS NOT NULL))::BIGINT AS tests_passed,
         (sum(total) FILTER (WHERE status IS NOT NULL))::BIGINT AS tests_total FROM m""",
)
def progress_rollup(spark, base):
    return federation.progress(_modules(spark, base))


def _modules(spark, base):
    return table(spark, base, "part").select(
        "p_partkey",
        F.expr(
            "CASE p_size % 6 WHEN 0 THEN 'done' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'blocked' "
            "WHEN 3 THEN 'planned' WHEN 4 THEN 'odd' END"
        ).alias("status"),
        F.col("p_size").alias("tests_passed"),
        (F.col("p_size") + 5).alias("tests_total"),
    )


@query(
    "status_badges",
    """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '✅ concluído' WHEN 1 THEN '🔄 em andamento' WHEN 2 THEN '⚠️ bloqueado'
         ELSE '⏳ planejado' END AS badge,
         CASE WHEN p_size % 6 < 5 THEN p_size || '/' || (p_size + 5) ELSE '—' END AS tests FROM part""",
)
def status_badges(spark, base):
    return federation.overview_rows(_modules(spark, base)).select("p_partkey", "badge", "tests")
