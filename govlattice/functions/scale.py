"""Building blocks that keep ordered and grouped work spread out.

A window over one key puts the whole key into one task. When a single key may
hold a large share of all rows, these helpers cut it into bounded pieces first:

* :func:`with_neighbours` - look at the next or previous rows of a sequence by
  cutting it into chunks that overlap by just the rows that are looked at;
* :func:`dense_position`, :func:`running_totals` - ranks and prefix sums in two
  levels: totals per bucket, then the order inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    Spark copies the expression of a plain column into filters that move below
    it. Passing an expensive value through a one-element generator stops that.
    """
    if name in df.columns:
        df = df.drop(name)
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: Sequence[str],
    *,
    following: int = 0,
    preceding: int = 0,
    chunk: int = 512,
) -> DataFrame:
    """Add ``<col>_next<i>`` / ``<col>_prev<i>`` from the rows around each row.

    ``pos`` numbers the rows of a key without gaps. Rows are shuffled by
    (key, ``pos`` div ``chunk``); the few rows at a chunk border travel twice,
    so a key of any length is read by many tasks and no row is lost.
    """
    reach = max(following, preceding)
    if reach < 1 or reach > chunk:
        raise ValueError("reach must be between 1 and the chunk size")
    home = F.floor(F.col(pos) / chunk)
    offset = F.pmod(F.col(pos), F.lit(chunk))
    copies = [home]
    if following:
        copies.append(F.when(offset < following, home - 1))
    if preceding:
        copies.append(F.when(offset >= chunk - preceding, home + 1))
    out = df.withColumn("_home", home).withColumn(
        # Outer: a row without a position has no neighbours but stays.
        "_chunk",
        F.explode_outer(F.array_compact(F.array(*copies))),
    )
    window = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    added = {}
    for i in range(1, following + 1):
        added |= {f"{c}_next{i}": F.lead(c, i).over(window) for c in columns}
    for i in range(1, preceding + 1):
        added |= {f"{c}_prev{i}": F.lag(c, i).over(window) for c in columns}
    return out.withColumns(added).filter("_chunk <=> _home").drop("_chunk", "_home")


def _bucket_offsets(df: DataFrame, keys: Sequence[str], bucket: str, totals: dict) -> DataFrame:
    """Totals of all earlier buckets of the same key, one row per bucket."""
    per_bucket = df.groupBy(*keys, bucket).agg(*[t.alias(n) for n, t in totals.items()])
    before = (
        Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    return per_bucket.select(
        *keys,
        bucket,
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in totals],
    )


def dense_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    name: str = "pos",
) -> DataFrame:
    """Number the rows of every key from 0 in the given order.

    ``bucket`` must not decrease along ``order`` and there must be far fewer
    buckets than rows (an hour of a timestamp, a range of an id). Only a bucket
    of a key, never a whole key, is sorted by one task.
    """
    data = df.withColumn("_bucket", bucket)
    offsets = _bucket_offsets(data, keys, "_bucket", {"n": F.count(F.lit(1))})
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    on = [data[k].eqNullSafe(offsets[k]) for k in (*keys, "_bucket")]
    joined = data.join(offsets, on, "left").select(data["*"], offsets["_before_n"])
    return joined.withColumn(
        name, (F.col("_before_n") + F.row_number().over(inner) - 1).cast("bigint")
    ).drop("_before_n", "_bucket")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: str,
    values: Sequence[str],
) -> DataFrame:
    """Inclusive prefix sums ``cum_<value>`` of ``values`` along ``order``.

    ``bucket`` is an existing column with the same meaning as in
    :func:`dense_position`.
    """
    offsets = _bucket_offsets(df, keys, bucket, {v: F.sum(v) for v in values})
    inner = (
        Window.partitionBy(*keys, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    on = [df[k].eqNullSafe(offsets[k]) for k in (*keys, bucket)]
    joined = df.join(offsets, on, "left").select(
        df["*"], *[offsets[f"_before_{v}"] for v in values]
    )
    return joined.withColumns(
        {f"cum_{v}": F.sum(v).over(inner) + F.col(f"_before_{v}") for v in values}
    ).drop(*[f"_before_{v}" for v in values])


def _cuts_below(cuts: Column, marks: Column, value: Column, step: int) -> Column:
    """Number of sorted cut points below a value, in two short scans.

    ``marks`` is every ``step``-th cut point.
    """
    passed = F.size(F.filter(marks, lambda c: c < value)) * step
    rest = F.slice(cuts, passed + 1, F.lit(step))
    found = passed + F.size(F.filter(rest, lambda c: c < value))
    # A key without values has no cut points.
    return F.when(F.size(cuts) >= step, found).otherwise(0)


def quantile_bucket(
    df: DataFrame, keys: Sequence[str], value: str, buckets: int = 256, name: str = "bucket"
) -> DataFrame:
    """Bucket number of ``value`` between approximate quantiles of its key.

    Equal values always share a bucket, so the bucket never decreases along
    ``value``. The cut points are an aggregate of at most ``buckets`` numbers
    per key. How evenly the buckets fill depends on the approximation; results
    built on them do not.
    """
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    step = max(1, int(buckets**0.5))
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, steps, 10 * buckets).alias("_cuts"))
    cuts = cuts.withColumn("_marks", F.filter("_cuts", lambda c, i: (i + 1) % step == 0))
    if keys:
        on = [df[k].eqNullSafe(cuts[k]) for k in keys]
        joined = df.join(cuts, on, "left").select(df["*"], cuts["_cuts"], cuts["_marks"])
    else:
        # One row by construction: a global aggregate.
        joined = df.join(F.broadcast(cuts))
    at = _cuts_below(F.col("_cuts"), F.col("_marks"), F.col(value), step)
    return joined.withColumn(name, at).drop("_cuts", "_marks")


def exact_quantiles(
    df: DataFrame, value: str, quantiles: dict[str, float], buckets: int = 256
) -> DataFrame:
    """One row with exact, linearly interpolated quantiles under the given names.

    The built-in exact percentile keeps every distinct value in one place. Here
    values are counted, cumulated in two levels, and only the two values around
    each rank are picked.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ranked = running_totals(
        quantile_bucket(counted, [], "_v", buckets, "_b"), [], ["_v"], "_b", ["_c"]
    )
    # One row: a global aggregate.
    total = F.broadcast(counted.agg(F.sum("_c").alias("_n")))
    rows = ranked.join(total)
    picks = []
    for name, q in quantiles.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        for tag, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.min(F.when(F.col("cum__c") >= rank + 1, F.col("_v"))).alias(f"{name}_{tag}"))
    picked = rows.agg(*picks, F.first("_n").alias("_n"))
    out = []
    for name, q in quantiles.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        part = at - F.floor(at)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((lo + (hi - lo) * part).alias(name))
    return picked.select(*out)


def nth_smallest(df: DataFrame, value: str, n: int, buckets: int = 256) -> DataFrame:
    """One row ``threshold``: the n-th smallest value (n from 1)."""
    counted = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_totals(
        quantile_bucket(counted, [], "_v", buckets, "_b"), [], ["_v"], "_b", ["_c"]
    )
    return ranked.agg(F.min(F.when(F.col("cum__c") >= n, F.col("_v"))).alias("threshold"))
