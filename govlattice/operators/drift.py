"""Two-sample distribution drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlattice.functions.scale import quantile_bucket, running_totals
from govlattice.functions.stats import ks_p


def pooled_ecdf(
    samples: DataFrame, keys: list[str], is_current: Column, value: str, buckets: int = 256
) -> DataFrame:
    """Both cumulative counts at every distinct value.

    Values are counted before anything is ordered. The order is then built in
    two levels (between quantile buckets, inside a bucket), so no task sorts a
    whole metric even when there is only one.
    """
    counted = (
        samples.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("value"))
        .agg(
            F.count_if(~is_current).alias("n1"),
            F.count_if(is_current).alias("n2"),
        )
    )
    bucketed = quantile_bucket(counted, keys, "value", buckets)
    return running_totals(bucketed, keys, ["value"], "bucket", ["n1", "n2"]).drop("bucket")


def detect_drift(
    samples: DataFrame,
    keys: list[str],
    is_current: Column,
    value: str,
    alpha: float = 0.05,
    buckets: int = 256,
) -> DataFrame:
    """Kolmogorov-Smirnov statistic per key, its p-value and the verdict.

    A key with fewer than two values on a side is flagged, not an error.
    """
    ecdf = pooled_ecdf(samples, keys, is_current, value, buckets)
    sizes = (
        samples.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.count_if(~is_current).alias("_m1"), F.count_if(is_current).alias("_m2"))
    )
    if keys:
        joined = ecdf.join(sizes, keys)
    else:
        joined = ecdf.join(F.broadcast(sizes))
    gap = F.abs(F.col("cum_n1") / F.col("_m1") - F.col("cum_n2") / F.col("_m2"))
    enough = (F.col("n_baseline") >= 2) & (F.col("n_current") >= 2)
    stat = (
        joined.filter("_m1 > 0 AND _m2 > 0")
        .groupBy(*keys)
        .agg(F.max(gap).alias("_d"))
    )
    base = sizes.withColumnsRenamed({"_m1": "n_baseline", "_m2": "n_current"})
    out = base.join(stat, keys, "left") if keys else base.join(F.broadcast(stat), how="left")
    out = out.withColumn("status", F.when(enough, "ok").otherwise("too_few_values"))
    d = F.when(F.col("status") == "ok", F.col("_d"))
    return out.withColumn(
        "p_value", ks_p(d, F.col("n_baseline"), F.col("n_current"))
    ).select(
        *keys,
        "n_baseline",
        "n_current",
        F.round(d, 9).alias("ks_statistic"),
        "p_value",
        F.lit(float(alpha)).alias("alpha"),
        (F.col("p_value") < alpha).alias("drift_detected"),
        "status",
    )
