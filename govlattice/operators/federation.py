"""Node reports, federation roll-ups, compliance, call metrics, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlattice.rules.levels import BADGE_LABELS, RISK_LEVELS, label_of

DENY_FLOOR = 5.0
STATUSES = ("planned", "in_progress", "done", "blocked")


def node_reports(scores: DataFrame, node: str = "node", score: str = "score",
                 risk: str = "risk_level") -> DataFrame:
    """The only thing that leaves a node: counts, mean score, risk histogram."""
    counts = {r: F.count_if(F.col(risk) == r) for r in RISK_LEVELS}
    entries = F.array(
        *[F.struct(F.lit(r).alias("k"), F.col(f"_{r}").alias("v")) for r in RISK_LEVELS]
    )
    return (
        scores.groupBy(node)
        .agg(
            F.count(F.lit(1)).alias("total_evaluations"),
            F.round(F.avg(score), 2).alias("avg_trust_score"),
            F.count_if(F.col(score) <= DENY_FLOOR).alias("deny_count"),
            *[c.alias(f"_{r}") for r, c in counts.items()],
        )
        .withColumn(
            "risk_level_counts",
            F.map_from_entries(F.filter(entries, lambda e: e["v"] > 0)),
        )
        .drop(*[f"_{r}" for r in RISK_LEVELS])
    )


def aggregate_federation(reports: DataFrame, node: str = "node") -> DataFrame:
    """One row for the federation, from node reports only.

    The mean is weighted by evaluations and starts from the rounded node means.
    """
    weighted = F.sum(F.col("avg_trust_score") * F.col("total_evaluations"))
    n = F.sum("total_evaluations")
    low = F.min(F.struct(F.col("avg_trust_score").alias("s"), F.col(node).alias("n")))
    high = F.min(F.struct((-F.col("avg_trust_score")).alias("s"), F.col(node).alias("n")))
    return reports.agg(
        F.count(F.lit(1)).alias("node_count"),
        n.alias("total_evaluations"),
        F.round(F.coalesce(weighted / F.nullif(n, F.lit(0)), F.lit(0.0)), 2).alias(
            "weighted_avg_trust_score"
        ),
        F.sum("deny_count").alias("total_deny_count"),
        low["n"].alias("worst_node"),
        high["n"].alias("best_node"),
    )


def node_compliance(
    checks: DataFrame, threshold: float = 1.0, node: str = "node", healthy: str = "healthy"
) -> DataFrame:
    """Healthy share per node; compliant is judged before rounding."""
    rate = F.count_if(healthy) / F.count(F.lit(1))
    return checks.groupBy(node).agg(
        F.count(F.lit(1)).alias("checks_total"),
        F.count_if(healthy).alias("checks_healthy"),
        F.round(rate, 4).alias("compliance_rate"),
        (rate >= threshold).alias("compliant"),
    )


def federation_compliance(nodes: DataFrame) -> DataFrame:
    """Overall rate; the nodes below the threshold are ``filter(~compliant)``."""
    return nodes.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.round(F.sum("checks_healthy") / F.sum("checks_total"), 4).alias(
            "federation_compliance_rate"
        ),
        F.count_if(~F.col("compliant")).alias("non_compliant_nodes"),
    )


def non_compliant_nodes(nodes: DataFrame, node: str = "node") -> DataFrame:
    """The nodes below the threshold, a row each, with how many checks they lack for it.

    Rows, not a list in one row: a federation may have any number of them.
    """
    failed = F.col("checks_total") - F.col("checks_healthy")
    return nodes.filter(~F.col("compliant")).select(
        node, "compliance_rate", failed.cast("bigint").alias("checks_failed")
    )


def call_snapshot(
    calls: DataFrame, module: str = "module", duration: str = "duration_ms",
    status: str = "status",
) -> DataFrame:
    """Calls, errors and mean duration per module and in total (module NULL)."""
    return calls.rollup(module).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col(status) == "error").alias("errors"),
        F.round(F.coalesce(F.avg(duration), F.lit(0.0)), 4).alias("avg_duration_ms"),
        F.grouping(module).cast("int").alias("is_total"),
    )


def progress(modules: DataFrame, status: str = "status") -> DataFrame:
    """Modules by status; an absent or unknown status counts as planned."""
    known = F.when(F.col(status).isin(*STATUSES), F.col(status)).otherwise("planned")
    with_tests = F.col(status).isNotNull()
    done = F.count_if(known == "done")
    return modules.agg(
        F.count(F.lit(1)).alias("total_modules"),
        *[F.count_if(known == s).alias(s) for s in STATUSES],
        F.round(F.coalesce(done / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)) * 100, 1)
        .alias("percent_done"),
        F.coalesce(F.sum(F.when(with_tests, F.col("tests_passed"))), F.lit(0)).alias(
            "tests_passed"
        ),
        F.coalesce(F.sum(F.when(with_tests, F.col("tests_total"))), F.lit(0)).alias("tests_total"),
    )


def overview_rows(modules: DataFrame, status: str = "status") -> DataFrame:
    """Readable status and test columns of a module table."""
    badge = label_of(
        F.coalesce(F.col(status), F.lit("planned")), BADGE_LABELS, F.lit(BADGE_LABELS["planned"])
    )
    tests = F.when(
        F.col(status).isNotNull(),
        F.concat(
            F.coalesce(F.col("tests_passed").cast("string"), F.lit("0")),
            F.lit("/"),
            F.coalesce(F.col("tests_total").cast("string"), F.lit("0")),
        ),
    ).otherwise("—")
    return modules.withColumns({"badge": badge, "tests": tests})
