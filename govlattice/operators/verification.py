"""Invariant checks over row domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlattice.operators.policy import DECISION_TYPE, adjudicate_row
from govlattice.rules.levels import DECISION_STATUSES, RISK_LEVELS, code_at


def verify_invariant(
    domain: DataFrame,
    keys: list[str],
    seq: str,
    check: Column,
    describe: Column,
) -> DataFrame:
    """Per property: rows checked up to the first failure, verdict, first counterexample.

    Instead of stopping, every row is tested and the smallest failing ``seq``
    is taken: the same answer from one partially aggregated pass. Rows up to it
    are counted in a second pass against one row per property.
    """
    tested = domain.withColumn("_ok", F.coalesce(check, F.lit(False))).withColumn("_text", describe)
    failed = ~F.col("_ok")
    verdict = tested.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.when(failed, F.col(seq))).alias("_bad"),
        F.min_by("_text", F.when(failed, F.col(seq))).alias("counterexample"),
    )
    if keys:
        bad = verdict.filter("_bad IS NOT NULL").select(*keys, "_bad")
        upto = (
            tested.join(bad, keys).filter(F.col(seq) <= F.col("_bad"))
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("_upto"))
        )
        out = verdict.join(upto, keys, "left")
    else:
        # A global aggregate is one row: broadcasting it is bounded by construction.
        upto = tested.join(F.broadcast(verdict.select("_bad"))).agg(
            F.count_if(F.col(seq) <= F.col("_bad")).alias("_upto")
        )
        out = verdict.join(F.broadcast(upto))
    return out.select(
        *keys,
        F.when(F.col("_bad").isNull(), F.col("_n")).otherwise(F.col("_upto")).alias("checked"),
        F.col("_bad").isNull().alias("holds"),
        "counterexample",
    )


def decision_grid(spark: SparkSession, longest: int = 3) -> DataFrame:
    """Every sequence of 1..longest decisions over 4 statuses and 4 risks."""
    if not 1 <= longest <= 8:
        raise ValueError("longest must be between 1 and 8")
    parts = []
    first = 0
    for n in range(1, longest + 1):
        codes = spark.range(16**n).select(
            (F.col("id") + first).alias("seq"),
            F.array(
                *[F.expr(f"CAST(pmod(shiftright(id, {4 * i}), 16) AS INT)") for i in range(n)]
            ).alias("codes"),
        )
        parts.append(codes)
        first += 16**n
    grid = parts[0]
    for p in parts[1:]:
        grid = grid.unionByName(p)
    decision = F.transform(
        "codes",
        lambda c, i: F.struct(
            i.alias("pos"),
            F.concat(F.lit("D"), i.cast("string")).alias("policy_id"),
            code_at((c / 4).cast("int"), DECISION_STATUSES).alias("status"),
            code_at(F.pmod(c, F.lit(4)), RISK_LEVELS).alias("risk_level"),
            F.lit("").alias("rationale"),
            F.array().cast("array<string>").alias("mitigations"),
        ).cast(DECISION_TYPE),
    )
    return grid.select("seq", decision.alias("decisions"))


def verify_deny_precedence(spark: SparkSession, longest: int = 3) -> DataFrame:
    """Whenever any decision denies, the verdict denies - over the whole grid."""
    grid = decision_grid(spark, longest).withColumn("_v", adjudicate_row(F.col("decisions")))
    has_deny = F.exists("decisions", lambda d: d["status"] == "deny")
    return verify_invariant(
        grid,
        [],
        "seq",
        ~has_deny | (F.col("_v.final_status") == "deny"),
        F.to_json("decisions"),
    )
