"""Queries: rule engines, tribunal, authorisation, what-if, trust score."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlattice.catalog.common import (
    RISK_RANK_SQL,
    STATUS_RANK_SQL,
    clause_sql,
    decisions_sql,
    lit,
    scenario_sql,
    scenarios,
)
from govlattice.operators import policy as P
from govlattice.operators import trust as T
from govlattice.operators import verification as V
from govlattice.plans import whatif as W
from govlattice.rules.policies import (
    AGENTS,
    CONSTITUTION,
    DEFAULT_REMEDIATION,
    POLICIES,
    REMEDIATION,
    RUNBOOKS,
)
from govlattice.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


WITH_DEC = f"WITH {scenario_sql()}, {decisions_sql(POLICIES)}"


@query(
    "policy_decisions",
    WITH_DEC
    + " SELECT o_orderkey, policy_id, status, risk_level, nmit::BIGINT AS n_mitigations FROM dec",
)
def policy_decisions(spark, base):
    evaluated = P.evaluate_policies(scenarios(spark, base))
    return P.explode_decisions(evaluated, ["o_orderkey"]).select(
        "o_orderkey",
        "policy_id",
        "status",
        "risk_level",
        F.size("mitigations").cast("bigint").alias("n_mitigations"),
    )


@query(
    "policy_mitigations",
    WITH_DEC
    + """ SELECT o_orderkey, sum(nmit)::BIGINT AS n_mitigations,
        sum(CASE WHEN status = 'deny' THEN 1 ELSE 0 END)::BIGINT AS n_denied,
        string_agg(policy_id || ':' || status, '; ' ORDER BY pos) AS decisions
        FROM dec GROUP BY o_orderkey""",
)
def policy_mitigations(spark, base):
    """Distinct mitigations and a readable line per scenario (all wordings differ)."""
    evaluated = P.evaluate_policies(scenarios(spark, base)).filter(F.size("decisions") > 0)
    line = F.transform("decisions", lambda d: F.concat(d["policy_id"], F.lit(":"), d["status"]))
    return evaluated.select(
        "o_orderkey",
        F.size(P.distinct_mitigations(F.col("decisions"))).cast("bigint").alias("n_mitigations"),
        F.size(F.filter("decisions", lambda d: d["status"] == "deny"))
        .cast("bigint")
        .alias("n_denied"),
        F.concat_ws("; ", line).alias("decisions"),
    )


@query(
    "worst_three_decisions",
    WITH_DEC
    + f""", r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey
          ORDER BY {STATUS_RANK_SQL}, pos) AS rn FROM dec)
        SELECT o_orderkey, string_agg(policy_id, ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS worst,
          greatest(count(*) - 3, 0)::BIGINT AS more FROM r GROUP BY o_orderkey""",
)
def worst_three(spark, base):
    evaluated = P.evaluate_policies(scenarios(spark, base)).filter(F.size("decisions") > 0)
    top = P.worst_decisions(F.col("decisions"), 3)
    return evaluated.select(
        "o_orderkey",
        F.array_join(F.transform(top, lambda d: d["policy_id"]), ",").alias("worst"),
        F.greatest(F.size("decisions") - 3, F.lit(0)).cast("bigint").alias("more"),
    )


CONST_SQL = "WITH " + scenario_sql() + ", viol AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey, {lit(a['id'])} AS principle_id, {lit(a['severity'])} AS severity FROM sc"
    f" WHERE {clause_sql({'ctx': a['condition']}, False)}"
    for a in CONSTITUTION
) + ")"


@query("constitution_violations", CONST_SQL + " SELECT * FROM viol")
def constitution_violations(spark, base):
    checked = P.check_constitution(scenarios(spark, base))
    return checked.select("o_orderkey", F.inline_outer("violations")).filter(
        "principle_id IS NOT NULL"
    ).select("o_orderkey", "principle_id", "severity")


@query(
    "constitution_compliance",
    CONST_SQL
    + """ SELECT count(*)::BIGINT AS scenarios, count(v.o_orderkey)::BIGINT AS violating,
        sum(coalesce(v.n, 0))::BIGINT AS violations
        FROM sc LEFT JOIN (SELECT o_orderkey, count(*) AS n FROM viol GROUP BY 1) v
        USING (o_orderkey)""",
)
def constitution_compliance(spark, base):
    return P.check_constitution(scenarios(spark, base)).agg(
        F.count(F.lit(1)).alias("scenarios"),
        F.count_if(~F.col("compliant")).alias("violating"),
        F.sum(F.size("violations")).alias("violations"),
    )


def rule_sets(spark, base):
    """One rule set per nation, one article per customer: signals from its columns."""
    entries = F.array_compact(
        F.array(
            F.when(F.expr("c_custkey % 4 < 3"), F.struct(F.lit("segment").alias("k"), F.col("c_mktsegment").alias("v"))),
            F.when(F.expr("c_custkey % 3 > 0"), F.struct(F.lit("debt").alias("k"), F.expr("CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END").alias("v"))),
            F.when(F.expr("c_custkey % 5 = 0"), F.struct(F.lit("tier").alias("k"), F.expr("CAST(c_custkey % 2 AS STRING)").alias("v"))),
        )
    )
    return table(spark, base, "customer").select(
        F.col("c_nationkey").alias("rule_set"),
        F.col("c_custkey").alias("article"),
        F.col("c_custkey").alias("pos"),
        F.map_from_entries(entries).alias("condition"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'critical' END").alias("severity"),
    )


RULE_SET_SQL = """WITH art AS (SELECT c_nationkey AS rule_set, c_custkey AS article,
    CASE WHEN c_custkey % 4 < 3 THEN c_mktsegment END AS seg,
    CASE WHEN c_custkey % 3 > 0 THEN CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END END AS debt,
    CASE WHEN c_custkey % 5 = 0 THEN (c_custkey % 2)::VARCHAR END AS tier,
    CASE c_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'critical' END AS sev
    FROM customer),
  pr AS (SELECT a.rule_set, a.sev <> b.sev AS mixed,
    (a.seg IS NOT NULL)::INT + (a.debt IS NOT NULL)::INT + (a.tier IS NOT NULL)::INT AS na,
    (b.seg IS NOT NULL)::INT + (b.debt IS NOT NULL)::INT + (b.tier IS NOT NULL)::INT AS nb,
    coalesce(a.seg = b.seg, false)::INT + coalesce(a.debt = b.debt, false)::INT
      + coalesce(a.tier = b.tier, false)::INT AS same,
    coalesce(a.seg <> b.seg, false) OR coalesce(a.debt <> b.debt, false)
      OR coalesce(a.tier <> b.tier, false) AS clash
    FROM art a JOIN art b ON a.rule_set = b.rule_set AND a.article < b.article),
  cls AS (SELECT rule_set, CASE WHEN na = 0 OR nb = 0 THEN NULL
    WHEN same = na AND na = nb THEN 'dup' WHEN same = na OR same = nb THEN 'sub'
    WHEN mixed AND NOT clash AND same > 0 THEN 'over'
    WHEN mixed AND NOT clash THEN 'vac' END AS c FROM pr),
  n AS (SELECT rule_set, count(*) AS articles FROM art GROUP BY 1)
  SELECT n.rule_set, n.articles::BIGINT AS articles,
    count(*) FILTER (WHERE c = 'dup')::BIGINT AS duplicates,
    count(*) FILTER (WHERE c = 'sub')::BIGINT AS subsumptions,
    count(*) FILTER (WHERE c = 'over')::BIGINT AS overlaps,
    count(*) FILTER (WHERE c = 'vac')::BIGINT AS vacuous_overlaps,
    count(*) FILTER (WHERE c IN ('dup', 'over')) = 0 AS valid
  FROM n LEFT JOIN cls USING (rule_set) GROUP BY 1, 2"""


@query("rule_set_compilation", RULE_SET_SQL)
def rule_set_compilation(spark, base):
    return P.compile_rules(rule_sets(spark, base), ["rule_set"])


@query(
    "tribunal_verdicts",
    WITH_DEC
    + f""", r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY
          {STATUS_RANK_SQL}, {RISK_RANK_SQL}, pos) AS rn,
          count(*) OVER (PARTITION BY o_orderkey) AS considered FROM dec)
        SELECT o_orderkey, policy_id AS winner, status AS final_status, risk_level,
          considered::BIGINT AS considered FROM r WHERE rn = 1""",
)
def tribunal_verdicts(spark, base):
    long = P.explode_decisions(P.evaluate_policies(scenarios(spark, base)), ["o_orderkey"])
    return P.adjudicate(long, ["o_orderkey"]).select(
        "o_orderkey", "winner", "final_status", "risk_level", "considered"
    )


@query(
    "verdict_per_customer",
    WITH_DEC
    + f""", d2 AS (SELECT sc.o_custkey, dec.*, {STATUS_RANK_SQL} AS sr, {RISK_RANK_SQL} AS rr
          FROM dec JOIN sc USING (o_orderkey)),
        r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY sr, rr, pos) AS rn,
          count(*) OVER (PARTITION BY o_custkey) AS considered FROM d2)
        SELECT o_custkey, policy_id AS winner, status AS final_status, risk_level,
          considered::BIGINT AS considered FROM r WHERE rn = 1""",
)
def verdict_per_customer(spark, base):
    long = P.explode_decisions(
        P.evaluate_policies(scenarios(spark, base)), ["o_orderkey", "o_custkey"]
    )
    return P.adjudicate(long, ["o_custkey"]).select(
        "o_custkey", "winner", "final_status", "risk_level", "considered"
    )


ACTIONS = [
    "pii_detection.detect",
    "audit_logs.verify_chain",
    "red_team_lab.run_suite",
    "human_oversight.decide",
    "regulatory_sandbox.simulate",
    "prompt_security.scan",
    "models.train",
]
REQ_AGENTS = [a["agent_id"] for a in AGENTS] + ["intern"]


def _pick(expr: str, values: list[str]) -> str:
    return (
        f"CASE {expr} % {len(values)} "
        + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values))
        + " END"
    )


REQ_SQL = f"""WITH rq AS (SELECT event_id, {_pick('user_id', REQ_AGENTS)} AS agent_id,
    {_pick('event_id', ACTIONS)} AS action FROM events)"""
ALLOWED_SQL = " OR ".join(
    f"(agent_id = {lit(a['agent_id'])} AND action IN ({', '.join(lit(x) for x in a['allowed_actions'])}))"
    for a in AGENTS
)
KNOWN_SQL = ", ".join(lit(a["agent_id"]) for a in AGENTS)


@query(
    "agent_authorization",
    REQ_SQL
    + f""" SELECT event_id, agent_id, action, ({ALLOWED_SQL}) AS authorized,
        CASE WHEN agent_id NOT IN ({KNOWN_SQL}) THEN 'unknown_agent'
             WHEN {ALLOWED_SQL} THEN 'allowed' ELSE 'action_not_allowed' END AS reason FROM rq""",
)
def agent_authorization(spark, base):
    requests = table(spark, base, "events").select(
        "event_id",
        F.expr(_pick("user_id", REQ_AGENTS)).alias("agent_id"),
        F.expr(_pick("event_id", ACTIONS)).alias("action"),
    )
    return P.authorize(requests)


CHECKS = list(REMEDIATION) + ["disk_space"]


def _steps_sql() -> str:
    sizes = "".join(f" WHEN {lit(k)} THEN {len(v[1])}" for k, v in REMEDIATION.items())
    return f"CASE check_name{sizes} ELSE {len(DEFAULT_REMEDIATION[1])} END"


def _severity_sql() -> str:
    sev = "".join(f" WHEN {lit(k)} THEN {lit(v[0])}" for k, v in REMEDIATION.items())
    return f"CASE check_name{sev} ELSE {lit(DEFAULT_REMEDIATION[0])} END"


@query(
    "remediation_actions",
    f"""WITH ck AS (SELECT event_id, {_pick('event_id', CHECKS)} AS check_name,
        event_type <> 'error' AS healthy FROM events)
        SELECT event_id, check_name, healthy,
          CASE WHEN NOT healthy THEN {_severity_sql()} END AS severity,
          CASE WHEN healthy THEN 0 ELSE {_steps_sql()} END::BIGINT AS n_steps FROM ck""",
)
def remediation_actions(spark, base):
    checks = table(spark, base, "events").select(
        "event_id",
        F.expr(_pick("event_id", CHECKS)).alias("check_name"),
        (F.col("event_type") != "error").alias("healthy"),
    )
    return P.check_and_heal(checks).select(
        "event_id",
        "check_name",
        "healthy",
        "severity",
        F.size("suggested_steps").cast("bigint").alias("n_steps"),
    )


@query(
    "incident_runbooks",
    f"""WITH i AS (SELECT event_id, CASE WHEN value > 60 THEN 'critical' WHEN value > 40 THEN 'high'
          WHEN value > 20 THEN 'medium' WHEN value > 1 THEN 'low' ELSE 'unset' END AS severity
          FROM events WHERE event_type = 'error')
        SELECT event_id, severity, CASE severity {' '.join(f"WHEN {lit(k)} THEN {len(v)}" for k, v in RUNBOOKS.items())} END::BIGINT AS n_steps,
          severity = 'unset' AS runbook_missing FROM i""",
)
def incident_runbooks(spark, base):
    incidents = (
        table(spark, base, "events")
        .filter("event_type = 'error'")
        .select(
            "event_id",
            F.expr(
                "CASE WHEN value > 60 THEN 'critical' WHEN value > 40 THEN 'high' "
                "WHEN value > 20 THEN 'medium' WHEN value > 1 THEN 'low' ELSE 'unset' END"
            ).alias("severity"),
        )
    )
    return P.attach_runbook(incidents).select(
        "event_id",
        "severity",
        F.when(~F.col("runbook_missing"), F.size("runbook")).cast("bigint").alias("n_steps"),
        "runbook_missing",
    )


# -- trust score over scenarios -------------------------------------------------------

TRUST_SQL = """, agg AS (SELECT sc.o_orderkey,
    coalesce(sum(CASE WHEN status = 'requires_human_review' THEN 1 END), 0) AS nr,
    coalesce(sum(CASE WHEN status = 'allow_with_mitigation' THEN nmit END), 0) AS nm,
    coalesce(bool_or(status = 'deny'), false) AS nd
    FROM sc LEFT JOIN dec USING (o_orderkey) GROUP BY 1),
  ts AS (SELECT o_orderkey, CASE WHEN nd THEN least(5.0, greatest(0, least(100, 100 - 20*nr - 5*nm)))
    ELSE greatest(0, least(100, 100 - 20*nr - 5*nm)) END::DOUBLE AS score FROM agg)"""
BAND_SQL = (
    "CASE WHEN score >= 80 THEN 'low' WHEN score >= 50 THEN 'medium' "
    "WHEN score >= 20 THEN 'high' ELSE 'critical' END"
)


@query(
    "scenario_trust_scores",
    WITH_DEC + TRUST_SQL + f" SELECT o_orderkey, score, {BAND_SQL} AS risk_level FROM ts",
)
def scenario_trust_scores(spark, base):
    return W.simulate(scenarios(spark, base)).select("o_orderkey", "score", "risk_level")


OVERRIDE = {"human_review": "true", "explainability_available": "true"}


def _override_sql() -> str:
    return (
        WITH_DEC.replace("sc AS (SELECT", "sc0 AS (SELECT", 1).replace(
            " FROM orders)",
            " FROM orders), sc AS (SELECT * REPLACE ("
            + ", ".join(f"{lit(v)} AS {k}" for k, v in OVERRIDE.items())
            + ") FROM sc0)",
            1,
        )
        + TRUST_SQL
    )


def _compare_sql() -> str:
    first = WITH_DEC + TRUST_SQL
    second = _override_sql()
    return f"""WITH a AS ({first} SELECT ts.o_orderkey, score, list_sort(list(policy_id || ':' || status) FILTER (WHERE policy_id IS NOT NULL)) AS d
          FROM ts LEFT JOIN dec USING (o_orderkey) GROUP BY 1, 2),
        b AS ({second} SELECT ts.o_orderkey, score, list_sort(list(policy_id || ':' || status) FILTER (WHERE policy_id IS NOT NULL)) AS d
          FROM ts LEFT JOIN dec USING (o_orderkey) GROUP BY 1, 2)
        SELECT a.o_orderkey, a.score AS score_a, b.score AS score_b,
          round(b.score - a.score, 2) AS delta,
          coalesce(array_to_string(list_sort(list_filter(b.d, lambda x: NOT list_contains(coalesce(a.d, []), x))), ','), '') AS added,
          coalesce(array_to_string(list_sort(list_filter(a.d, lambda x: NOT list_contains(coalesce(b.d, []), x))), ','), '') AS removed
        FROM a JOIN b USING (o_orderkey)"""


@query("what_if_comparison", _compare_sql())
def what_if_comparison(spark, base):
    out = W.compare_override(scenarios(spark, base), OVERRIDE)
    return out.select(
        "o_orderkey",
        "score_a",
        "score_b",
        "delta",
        F.array_join("added", ",").alias("added"),
        F.array_join("removed", ",").alias("removed"),
    )


@query(
    "regulatory_change_impact",
    f"""WITH cmp AS ({_compare_sql()})
        SELECT count(*)::BIGINT AS scenarios, count(*) FILTER (WHERE delta <> 0)::BIGINT AS changed,
          round(avg(delta), 4) AS mean_delta FROM cmp""",
)
def regulatory_change_impact(spark, base):
    return W.change_impact(scenarios(spark, base), OVERRIDE)


def _narrative_sql() -> str:
    return (
        WITH_DEC
        + TRUST_SQL
        + """, f AS (SELECT o_orderkey, -20.0*nr + 0.0 AS a, -5.0*nm + 0.0 AS b FROM agg),
        e AS (SELECT o_orderkey, 0 AS ord, 'human_review' AS name, a AS v FROM f
          UNION ALL SELECT o_orderkey, 1, 'mitigation', b FROM f),
        o AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(v) DESC, ord) AS rn FROM e)
        SELECT o_orderkey, 'A decisão sobre ''scenario'' foi ' || string_agg(
          CASE WHEN rn = 1 THEN 'principalmente influenciada por' ELSE 'seguido por' END
          || ' ''' || name || ''' (contribuição de ' || CASE WHEN v >= 0 THEN '+' ELSE '' END
          || printf('%.2f', v::DOUBLE) || ', ' || CASE WHEN v > 0 THEN 'aumentando o resultado'
            WHEN v < 0 THEN 'reduzindo o resultado' ELSE 'sem impacto líquido sobre o resultado' END
          || ')', '; ' ORDER BY rn) || '.' AS narrative FROM o GROUP BY 1"""
    )


@query("decision_narratives", _narrative_sql())
def decision_narratives(spark, base):
    scored = W.simulate(scenarios(spark, base))
    factors = F.create_map(
        F.lit("human_review"),
        F.col("components")["policy_human_review_penalty"],
        F.lit("mitigation"),
        F.col("components")["policy_mitigation_penalty"],
    )
    return T.explain(
        scored.withColumn("factors", factors), "factors", F.lit("scenario")
    ).select("o_orderkey", "narrative")


@query(
    "review_queue_from_policies",
    WITH_DEC
    + """ SELECT o_orderkey, policy_id, risk_level, 'pending' AS status FROM dec
        WHERE status = 'requires_human_review'""",
)
def review_queue(spark, base):
    return W.review_items(
        P.evaluate_policies(scenarios(spark, base)), ["o_orderkey"]
    ).select("o_orderkey", "policy_id", "risk_level", "status")


# -- invariants ---------------------------------------------------------------------


@query(
    "price_invariant",
    """WITH d AS (SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS seq, l_orderkey,
          l_linenumber, l_quantity <= 48 AS ok FROM lineitem),
        a AS (SELECT l_returnflag, count(*) AS n, min(CASE WHEN NOT ok THEN seq END) AS bad FROM d GROUP BY 1)
        SELECT a.l_returnflag, CASE WHEN bad IS NULL THEN n ELSE
            (SELECT count(*) FROM d WHERE d.l_returnflag = a.l_returnflag AND d.seq <= a.bad) END::BIGINT AS checked,
          bad IS NULL AS holds, bad AS counterexample_seq FROM a""",
)
def price_invariant(spark, base):
    """Checked up to and including the first failure, per return flag."""
    rows = table(spark, base, "lineitem").select(
        "l_returnflag",
        F.expr("l_orderkey * 10 + l_linenumber").alias("seq"),
        F.col("l_quantity"),
    )
    return V.verify_invariant(
        rows, ["l_returnflag"], "seq", F.col("l_quantity") <= 48, F.col("seq")
    ).select(
        "l_returnflag", "checked", "holds", F.col("counterexample").alias("counterexample_seq")
    )
