"""Rule engines over scenario tables.

A scenario has ``data_categories ARRAY<STRING>``, ``legal_basis STRING`` and
``context MAP<STRING,STRING>`` (booleans as ``true`` / ``false``).

Rules are a small table known when the plan is built. They become literals of
one projection, so evaluating them needs neither a join nor a shuffle, however
many scenarios there are.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlattice.functions.scale import pin
from govlattice.rules.levels import DECISION_STATUSES, RISK_LEVELS, rank_of
from govlattice.rules.policies import (
    AGENTS,
    CONSTITUTION,
    DEFAULT_REMEDIATION,
    POLICIES,
    REMEDIATION,
    RUNBOOKS,
)
from govlattice.session import bounded_rows

MAX_RULES = 2_000
DECISION_TYPE = (
    "struct<pos:int,policy_id:string,status:string,risk_level:string,"
    "rationale:string,mitigations:array<string>>"
)
VIOLATION_TYPE = "struct<principle_id:string,principle:string,severity:string>"


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _matches(
    cond: dict[str, Any], categories: Column | None, basis: Column, context: Column
) -> Column:
    """Conjunction of the clauses a rule states; clauses it lacks pass.

    A missing context key differs from every value: it fails an equality and
    passes an inequality, hence the null-safe comparison.
    """
    tests: list[Column] = []
    if categories is not None:
        if "cats_any" in cond:
            tests.append(F.arrays_overlap(categories, _strings(cond["cats_any"])))
        if "cats_all" in cond:
            tests.append(F.size(F.array_except(_strings(cond["cats_all"]), categories)) == 0)
        if "cats_none" in cond:
            tests.append(~F.arrays_overlap(categories, _strings(cond["cats_none"])))
    if "basis_in" in cond:
        tests.append(basis.isin(*cond["basis_in"]))
    if "basis_not_in" in cond:
        tests.append(~basis.isin(*cond["basis_not_in"]))
    for key, value in (cond.get("ctx") or {}).items():
        tests.append(context[key].eqNullSafe(value))
    for key, value in (cond.get("ctx_ne") or {}).items():
        tests.append(~context[key].eqNullSafe(value))
    return F.coalesce(_all(tests), F.lit(False))


def _decision(pos: int, policy_id: str, outcome: dict[str, Any]) -> Column:
    return F.struct(
        F.lit(pos).alias("pos"),
        F.lit(policy_id).alias("policy_id"),
        F.lit(outcome["status"]).alias("status"),
        F.lit(outcome["risk"]).alias("risk_level"),
        F.lit(outcome.get("rationale")).cast("string").alias("rationale"),
        _strings(outcome.get("mitigations", [])).alias("mitigations"),
    ).cast(DECISION_TYPE)


def decisions_column(
    policies: list[dict[str, Any]],
    categories: Column,
    basis: Column,
    context: Column,
) -> Column:
    """Decisions of one scenario: per triggered policy its first matching outcome."""
    per_policy = []
    for pos, policy in enumerate(policies):
        chosen: Column | None = None
        for outcome in policy.get("outcomes", []):
            test = _matches(outcome, None, basis, context)
            value = _decision(pos, policy["id"], outcome)
            chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
        if chosen is None:
            continue
        trigger = _matches(policy.get("trigger") or {}, categories, basis, context)
        per_policy.append(F.when(trigger, chosen))
    if not per_policy:
        return F.array().cast(f"array<{DECISION_TYPE}>")
    return F.array_compact(F.array(*per_policy))


def policies_from_table(policies: DataFrame, outcomes: DataFrame) -> list[dict[str, Any]]:
    """Policies kept as tables, brought to the driver with a size check.

    ``policies``: policy_id, pos, cats_any, cats_all, cats_none, basis_in,
    basis_not_in ARRAY, ctx, ctx_ne MAP. ``outcomes``: policy_id, ordinal,
    basis_in, basis_not_in, ctx, ctx_ne, status, risk, rationale, mitigations.
    NULL means the clause is absent.
    """

    def given(row, names):
        return {n: row[n] for n in names if n in row and row[n] is not None}

    clauses = ("basis_in", "basis_not_in", "ctx", "ctx_ne")
    by_policy: dict[str, list] = {}
    for row in bounded_rows(outcomes, MAX_RULES, "policy outcomes"):
        by_policy.setdefault(row["policy_id"], []).append(row.asDict())
    out = []
    for row in sorted(bounded_rows(policies, MAX_RULES, "policies"), key=lambda r: r["pos"]):
        p = row.asDict()
        ordered = sorted(by_policy.get(p["policy_id"], []), key=lambda o: o["ordinal"])
        out.append(
            {
                "id": p["policy_id"],
                "trigger": given(p, ("cats_any", "cats_all", "cats_none", *clauses)),
                "outcomes": [
                    given(o, (*clauses, "status", "risk", "rationale", "mitigations"))
                    for o in ordered
                ],
            }
        )
    return out


def evaluate_policies(
    scenarios: DataFrame,
    policies: list[dict[str, Any]] | None = None,
    categories: str = "data_categories",
    basis: str = "legal_basis",
    context: str = "context",
    name: str = "decisions",
) -> DataFrame:
    """Add the array of decisions; a scenario no policy speaks to keeps an empty one."""
    return pin(
        scenarios,
        name,
        decisions_column(
            POLICIES if policies is None else policies,
            F.coalesce(F.col(categories), F.array().cast("array<string>")),
            F.col(basis),
            F.coalesce(F.col(context), F.create_map().cast("map<string,string>")),
        ),
    )


def explode_decisions(evaluated: DataFrame, keys: list[str], name: str = "decisions") -> DataFrame:
    return evaluated.select(*keys, F.inline_outer(name)).filter("policy_id IS NOT NULL")


def distinct_mitigations(decisions: Column) -> Column:
    """Mitigations of all decisions without repeats, first seen first."""
    return F.array_distinct(F.flatten(F.transform(decisions, lambda d: d["mitigations"])))


def worst_decisions(decisions: Column, k: int = 3) -> Column:
    """The k most restrictive decisions, ties in policy order."""
    keyed = F.transform(
        decisions,
        lambda d: F.struct(
            rank_of(d["status"], DECISION_STATUSES).alias("rank"),
            d["pos"].alias("pos"),
            d.alias("decision"),
        ),
    )
    ordered = F.transform(F.sort_array(keyed), lambda x: x["decision"])
    return F.slice(ordered, 1, k)


# -- constitution ----------------------------------------------------------


def check_constitution(
    scenarios: DataFrame,
    articles: list[dict[str, Any]] | None = None,
    context: str = "context",
) -> DataFrame:
    """Add ``violations`` and ``compliant``; an article without condition never fires."""
    ctx = F.coalesce(F.col(context), F.create_map().cast("map<string,string>"))
    found = []
    for a in CONSTITUTION if articles is None else articles:
        if not a["condition"]:
            continue
        holds = _all([ctx[k].eqNullSafe(v) for k, v in a["condition"].items()])
        found.append(
            F.when(
                holds,
                F.struct(
                    F.lit(a["id"]).alias("principle_id"),
                    F.lit(a["principle"]).alias("principle"),
                    F.lit(a["severity"]).alias("severity"),
                ).cast(VIOLATION_TYPE),
            )
        )
    none = F.array().cast(f"array<{VIOLATION_TYPE}>")
    violations = F.array_compact(F.array(*found)) if found else none
    return scenarios.withColumn("violations", violations).withColumn(
        "compliant", F.size("violations") == 0
    )


def rule_signatures(
    articles: DataFrame,
    keys: list[str],
    article: str = "article",
    position: str = "pos",
    condition: str = "condition",
    severity: str = "severity",
) -> DataFrame:
    """Articles of a rule set folded by equal condition and severity.

    One row per signature with its first article and how many articles have it:
    copies are counted here once instead of being paired with each other later.
    Articles without a condition cannot clash and are left out.
    """
    return (
        articles.filter(F.size(condition) > 0)
        .groupBy(
            *keys,
            F.array_sort(F.map_entries(condition)).alias("items"),
            F.coalesce(F.col(severity), F.lit("")).alias("severity"),
        )
        .agg(
            F.min_by(article, position).alias("article"),
            F.min(position).alias("pos"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def rule_conflicts(signatures: DataFrame, keys: list[str]) -> DataFrame:
    """Clashes between the signatures of a rule set, with the article pairs they stand for.

    Classes, first match wins: ``duplicate_condition``, ``subsumption``,
    ``overlapping_condition_different_severity`` (a signal in common, nothing
    contradicting). Signatures are paired through the (signal, value) items
    they share; unrelated ones never meet, see :func:`compile_rules` for those.
    """
    item = signatures.select(*keys, "pos", F.explode("items").alias("_item"))
    left, right = item.alias("l"), item.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    shared = (
        left.join(
            right, [*on, F.col("l._item") == F.col("r._item"), F.col("l.pos") < F.col("r.pos")]
        )
        .groupBy(*[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.pos"), F.col("r.pos"))
        .agg(F.count(F.lit(1)).alias("shared"))
        .toDF(*keys, "_pa", "_pb", "shared")
    )

    def side(tag: str, pos: str) -> DataFrame:
        return signatures.select(
            *keys,
            F.col("pos").alias(pos),
            F.col("article").alias(f"article_{tag}"),
            F.col("items").alias(f"_items_{tag}"),
            F.col("severity").alias(f"_sev_{tag}"),
            F.col("n").alias(f"_n_{tag}"),
        )

    pairs = shared.join(side("a", "_pa"), [*keys, "_pa"]).join(side("b", "_pb"), [*keys, "_pb"])
    size_a, size_b = F.size("_items_a"), F.size("_items_b")
    map_a, map_b = F.map_from_entries("_items_a"), F.map_from_entries("_items_b")
    contradict = F.exists(
        F.map_keys(map_a),
        lambda k: F.map_contains_key(map_b, k) & ~map_a[k].eqNullSafe(map_b[k]),
    )
    kind = (
        F.when((F.col("shared") == size_a) & (size_a == size_b), "duplicate_condition")
        .when((F.col("shared") == size_a) | (F.col("shared") == size_b), "subsumption")
        .when(
            ~contradict & (F.col("_sev_a") != F.col("_sev_b")),
            "overlapping_condition_different_severity",
        )
    )
    across = (
        pairs.withColumn("conflict_type", kind)
        .filter("conflict_type IS NOT NULL")
        .select(
            *keys,
            "article_a",
            "article_b",
            "conflict_type",
            (F.col("_n_a") * F.col("_n_b")).alias("pairs"),
        )
    )
    copies = signatures.filter("n > 1").select(
        *keys,
        F.col("article").alias("article_a"),
        F.col("article").alias("article_b"),
        F.lit("duplicate_condition").alias("conflict_type"),
        F.expr("n * (n - 1) div 2").alias("pairs"),
    )
    return across.unionByName(copies).withColumn(
        "blocking", F.col("conflict_type") != "subsumption"
    )


def compile_rules(articles: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """Per rule set: article pairs in conflict by class, and whether it is valid.

    Weak overlaps (different severity, no signal in common) are counted by
    subtraction: all pairs of different severity, less the pairs of different
    severity that have a signal name in common. The first number comes from
    group sizes and the second from grouping articles by their set of signal
    names, so weak pairs are never formed.
    """
    signatures = rule_signatures(articles, keys, **columns)

    def pairs_of(kind: str) -> Column:
        return F.sum(F.when(F.col("conflict_type") == kind, F.col("pairs")).otherwise(0))

    by_type = (
        rule_conflicts(signatures, keys)
        .groupBy(*keys)
        .agg(
            pairs_of("duplicate_condition").alias("duplicates"),
            pairs_of("subsumption").alias("subsumptions"),
            pairs_of("overlapping_condition_different_severity").alias("overlaps"),
        )
    )
    # Signal-name sets are few: the vocabulary of a rule set, not its articles.
    names = F.transform("items", lambda e: e["key"])
    shapes = signatures.groupBy(*keys, names.alias("_names"), F.col("severity").alias("_sev")).agg(
        F.sum("n").alias("_n")
    )
    by_sev = shapes.groupBy(*keys, "_sev").agg(F.sum("_n").alias("_s"))
    totals = by_sev.groupBy(*keys).agg(
        F.expr("(sum(_s) * sum(_s) - sum(_s * _s)) div 2").alias("_mixed")
    )
    named = shapes.withColumn("_name", F.explode("_names"))
    left, right = named.alias("l"), named.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    # Each pair of shapes meets once per common name; keep the first name only.
    touching = (
        left.join(
            right,
            [*on, F.col("l._name") == F.col("r._name"), F.col("l._sev") < F.col("r._sev")],
        )
        .filter(
            F.col("l._name") == F.array_min(F.array_intersect(F.col("l._names"), F.col("r._names")))
        )
        .groupBy(*[F.col(f"l.{k}").alias(k) for k in keys])
        .agg(F.sum(F.col("l._n") * F.col("r._n")).alias("_touching"))
    )
    counts = articles.groupBy(*keys).agg(F.count(F.lit(1)).alias("articles"))
    zero = F.lit(0).cast("bigint")
    out = (
        counts.join(by_type, keys, "left").join(totals, keys, "left").join(touching, keys, "left")
    )
    return out.select(
        *keys,
        "articles",
        *[F.coalesce(c, zero).alias(c) for c in ("duplicates", "subsumptions", "overlaps")],
        (F.coalesce("_mixed", zero) - F.coalesce("_touching", zero)).alias("vacuous_overlaps"),
    ).withColumn("valid", (F.col("duplicates") == 0) & (F.col("overlaps") == 0))


# -- tribunal, authorisation, catalogues --------------------------------------


def adjudicate(
    decisions: DataFrame, keys: list[str], position: str = "pos"
) -> DataFrame:
    """One verdict per subject: most restrictive status, then highest risk, then order.

    Only aggregates with partial results, so a subject with very many decisions
    is reduced before the shuffle. The overruled decisions stay in the decision
    table: all but ``winner``.
    """
    rank = F.struct(
        rank_of(F.col("status"), DECISION_STATUSES),
        -rank_of(F.col("risk_level"), RISK_LEVELS),
        F.col(position),
    )
    best = F.min_by(F.struct("policy_id", "status", "risk_level"), rank)
    counts = [
        F.count_if(F.col("status") == s).alias(f"n_{s}") for s in DECISION_STATUSES
    ]
    return (
        decisions.groupBy(*keys)
        .agg(best.alias("_w"), F.count(F.lit(1)).alias("considered"), *counts)
        .select(
            *keys,
            F.col("_w.policy_id").alias("winner"),
            F.col("_w.status").alias("final_status"),
            F.col("_w.risk_level").alias("risk_level"),
            "considered",
            *[f"n_{s}" for s in DECISION_STATUSES],
        )
    )


def adjudicate_row(decisions: Column) -> Column:
    """The verdict of a decisions array, without a shuffle."""
    keyed = F.transform(
        decisions,
        lambda d: F.struct(
            rank_of(d["status"], DECISION_STATUSES).alias("s"),
            (-rank_of(d["risk_level"], RISK_LEVELS)).alias("r"),
            d["pos"].alias("p"),
            d["policy_id"].alias("winner"),
            d["status"].alias("final_status"),
            d["risk_level"].alias("risk_level"),
        ),
    )
    win = F.array_min(keyed)
    considered = F.transform(decisions, lambda d: d["policy_id"])
    return F.when(
        F.size(decisions) > 0,
        F.struct(
            considered.alias("considered"),
            win["final_status"].alias("final_status"),
            win["risk_level"].alias("risk_level"),
            win["winner"].alias("winner"),
            F.array_remove(considered, win["winner"]).alias("overruled"),
        ),
    )


def authorize(
    requests: DataFrame,
    agents: list[dict[str, Any]] | None = None,
    agent: str = "agent_id",
    action: str = "action",
) -> DataFrame:
    """Add ``authorized`` and ``reason`` (unknown_agent / action_not_allowed / allowed)."""
    registry = AGENTS if agents is None else agents
    if len(registry) > MAX_RULES:
        raise ValueError(f"agent registry: more than {MAX_RULES} agents, too large for literals")
    allowed: Column | None = None
    for a in registry:
        test, value = F.col(agent) == a["agent_id"], _strings(a["allowed_actions"])
        allowed = F.when(test, value) if allowed is None else allowed.when(test, value)
    allowed = F.lit(None).cast("array<string>") if allowed is None else allowed
    out = requests.withColumn("_allowed", allowed)
    permitted = F.coalesce(F.array_contains("_allowed", F.col(action)), F.lit(False))
    reason = (
        F.when(F.col("_allowed").isNull(), "unknown_agent")
        .when(permitted, "allowed")
        .otherwise("action_not_allowed")
    )
    return out.withColumns({"authorized": permitted, "reason": reason}).drop("_allowed")


def _catalogue(col: Column, table: dict, default):
    value, steps = F.lit(default[0]), _strings(default[1])
    for name, (severity, todo) in table.items():
        value = F.when(col == name, severity).otherwise(value)
        steps = F.when(col == name, _strings(todo)).otherwise(steps)
    return value, steps


def check_and_heal(
    checks: DataFrame, check: str = "check_name", healthy: str = "healthy"
) -> DataFrame:
    """Severity and steps for failed checks; healthy ones pass with no steps."""
    severity, steps = _catalogue(F.col(check), REMEDIATION, DEFAULT_REMEDIATION)
    return checks.withColumns(
        {
            "severity": F.when(~F.col(healthy), severity),
            "suggested_steps": F.when(F.col(healthy), _strings([])).otherwise(steps),
            "opens_incident": ~F.col(healthy),
        }
    )


def attach_runbook(incidents: DataFrame, severity: str = "severity") -> DataFrame:
    """Add ``runbook``; a severity without one is flagged instead of dropped."""
    steps = F.lit(None).cast("array<string>")
    for level, todo in RUNBOOKS.items():
        steps = F.when(F.col(severity) == level, _strings(todo)).otherwise(steps)
    return incidents.withColumn("runbook", steps).withColumn(
        "runbook_missing", F.col("runbook").isNull()
    )
