"""Fairness audit, its significance and its confounder strata.

All three start from the same small table: favourable and total counts per
(keys, group). It is a partial aggregate, so groups of any size are fine, and
everything after it works on one row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlattice.functions.stats import chi2_p


def group_counts(df: DataFrame, keys: list[str], group: str, favorable: Column) -> DataFrame:
    """``size`` and ``favorable`` per (keys, group); a missing group stays a group."""
    return (
        df.groupBy(*keys, F.col(group).cast("string").alias("group"))
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.count_if(F.coalesce(favorable, F.lit(False))).alias("favorable"),
        )
        .withColumn("rate", F.col("favorable") / F.col("size"))
    )


def _attach(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Bring one row per key back to its groups; without keys it is one row in all."""
    if not keys:
        return rows.join(F.broadcast(per_key))
    right = per_key.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return rows.join(right, on).drop(*[f"_k_{k}" for k in keys])


def _against_reference(counts: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Per group: reference group, ratio, difference and both verdicts."""
    # Highest rate, ties to the smallest name.
    best = F.min(F.struct((-F.col("rate")).alias("r"), F.coalesce("group", F.lit("")).alias("g")))
    per_key = counts.groupBy(*keys).agg(best.alias("_best")).select(
        *keys, F.col("_best.g").alias("reference_group"), (-F.col("_best.r")).alias("_ref")
    )
    slack = 1.0 - threshold
    return _attach(counts, per_key, keys).withColumns(
        {
            "is_reference": F.coalesce("group", F.lit("")) == F.col("reference_group"),
            "di_ratio": F.when(F.col("_ref") > 0, F.col("rate") / F.col("_ref")).otherwise(1.0),
            "parity_difference": F.col("_ref") - F.col("rate"),
        }
    ).withColumns(
        {
            "di_passed": F.col("di_ratio") >= threshold,
            "parity_passed": F.col("parity_difference") <= slack,
        }
    )


def fairness_metrics(
    df: DataFrame,
    group: str,
    favorable: Column,
    keys: list[str] | None = None,
    threshold: float = 0.8,
) -> DataFrame:
    """Two metric rows for every group that is not the reference."""
    keys = keys or []
    judged = _against_reference(group_counts(df, keys, group, favorable), keys, threshold)
    metric = F.explode(
        F.array(
            F.struct(
                F.lit("disparate_impact_ratio").alias("metric_name"),
                F.round("di_ratio", 4).alias("value"),
                F.lit(float(threshold)).alias("threshold"),
                F.col("di_passed").alias("passed"),
            ),
            F.struct(
                F.lit("demographic_parity_difference").alias("metric_name"),
                F.round("parity_difference", 4).alias("value"),
                F.lit(round(1.0 - threshold, 4)).alias("threshold"),
                F.col("parity_passed").alias("passed"),
            ),
        )
    )
    return judged.filter(~F.col("is_reference")).select(
        *keys, "group", "reference_group", metric.alias("_m")
    ).select(*keys, "group", "reference_group", "_m.*")


def _verdict(counts: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    judged = _against_reference(counts, keys, threshold)
    fair = F.bool_and(F.col("is_reference") | (F.col("di_passed") & F.col("parity_passed")))
    return judged.groupBy(*keys).agg(
        F.sum("size").alias("n"),
        F.count(F.lit(1)).alias("groups"),
        F.first("reference_group").alias("reference_group"),
        fair.alias("overall_fair"),
    )


def fairness_audit(
    df: DataFrame,
    group: str,
    favorable: Column,
    keys: list[str] | None = None,
    threshold: float = 0.8,
) -> DataFrame:
    """Verdict per key; sizes and rates by group are :func:`group_counts`."""
    keys = keys or []
    return _verdict(group_counts(df, keys, group, favorable), keys, threshold)


def chi_square_significance(
    df: DataFrame,
    group: str,
    favorable: Column,
    keys: list[str] | None = None,
    alpha: float = 0.05,
) -> DataFrame:
    """Independence of group and outcome, with Yates' correction for two groups.

    ``status`` names what makes a key untestable (one group, or an outcome that
    never / always occurs) instead of failing the job.
    """
    keys = keys or []
    counts = group_counts(df, keys, group, favorable).withColumn(
        "group", F.coalesce("group", F.lit("None"))
    )
    margins = counts.groupBy(*keys).agg(
        F.sum("size").alias("_n"),
        F.sum("favorable").alias("_fav"),
        F.count(F.lit(1)).alias("_groups"),
    )
    cells = _attach(counts, margins, keys).withColumns(
        {
            "_e1": F.col("size") * F.col("_fav") / F.col("_n"),
            "_e0": F.col("size") * (F.col("_n") - F.col("_fav")) / F.col("_n"),
        }
    )

    def cell(observed: Column, expected: str) -> Column:
        gap = F.abs(observed - F.col(expected))
        shrunk = gap - F.when(F.col("_groups") == 2, F.least(F.lit(0.5), gap)).otherwise(0.0)
        return F.when(F.col(expected) > 0, shrunk * shrunk / F.col(expected))

    out = cells.groupBy(*keys).agg(
        F.sum(
            cell(F.col("favorable"), "_e1")
            + cell(F.col("size") - F.col("favorable"), "_e0")
        ).alias("_chi2"),
        (F.count(F.lit(1)) - 1).cast("int").alias("degrees_of_freedom"),
        F.first("_n").alias("_n"),
        F.first("_fav").alias("_fav"),
    )
    status = (
        F.when(F.col("degrees_of_freedom") < 1, "single_group")
        .when((F.col("_fav") == 0) | (F.col("_fav") == F.col("_n")), "degenerate_outcome")
        .otherwise("ok")
    )
    out = out.withColumn("status", status)
    chi2 = F.when(F.col("status") == "ok", F.col("_chi2"))
    return out.withColumn("p_value", chi2_p(chi2, F.col("degrees_of_freedom"))).select(
        *keys,
        F.round(chi2, 6).alias("chi2_statistic"),
        F.round("p_value", 8).alias("p_value"),
        "degrees_of_freedom",
        F.lit(float(alpha)).alias("alpha"),
        (F.col("p_value") < alpha).alias("significant"),
        "status",
    )


def stratified_audit(
    df: DataFrame,
    group: str,
    favorable: Column,
    stratum: str,
    threshold: float = 0.8,
) -> DataFrame:
    """Verdict per stratum next to the overall one; ``paradox`` where they differ.

    Counted once per (stratum, group); the overall counts are sums of those.
    """
    fine = group_counts(
        df.withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("None"))),
        ["stratum"],
        group,
        favorable,
    )
    coarse = (
        fine.groupBy("group")
        .agg(F.sum("size").alias("size"), F.sum("favorable").alias("favorable"))
        .withColumn("rate", F.col("favorable") / F.col("size"))
    )
    overall = _verdict(coarse, [], threshold).select(F.col("overall_fair").alias("aggregate_fair"))
    strata = _verdict(fine, ["stratum"], threshold)
    # A global aggregate: one row.
    joined = strata.join(F.broadcast(overall))
    compared = F.col("groups") > 1
    return joined.select(
        "stratum",
        "n",
        "groups",
        "overall_fair",
        compared.alias("has_comparison"),
        "aggregate_fair",
        (compared & (F.col("overall_fair") != F.col("aggregate_fair"))).alias("paradox"),
    )


def simpson_summary(stratified: DataFrame) -> DataFrame:
    return stratified.agg(
        F.count(F.lit(1)).alias("strata"),
        F.count_if("has_comparison").alias("compared"),
        F.bool_or("paradox").alias("simpsons_paradox"),
    )
