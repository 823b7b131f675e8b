"""Differentially private aggregates and the privacy budget."""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from govlattice.functions.scale import running_totals
from govlattice.session import cut_lineage

TOLERANCE = 1e-9


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def _check_parameters(epsilon: float, sensitivity: float | None = None) -> None:
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    if sensitivity is not None and sensitivity <= 0:
        raise ValueError("sensitivity must be positive")


def laplace_noise(scale: Column, row_key: list[Column], seed: str | int | None) -> Column:
    """One Laplace draw per row, the same draw every time the row is computed.

    The uniform behind it is a hash of a secret and the key of the row. Without
    a seed the secret is drawn from the operating system when the plan is
    built. A plain ``rand()`` would be drawn again by every action and every
    retried task, and averaging the draws undoes the privacy.
    """
    secret = secrets.token_hex(16) if seed is None else f"seed:{seed}"
    text = F.concat_ws("\x1f", F.lit(secret), *[k.cast("string") for k in row_key])
    bits = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double")
    u = (bits + 0.5) / float(1 << 52) - 0.5
    return -scale * F.signum(u) * F.log(1.0 - 2.0 * F.abs(u))


def laplace_mechanism(
    df: DataFrame,
    true_value: str,
    sensitivity: Column | float,
    epsilon: float,
    row_key: list[str],
    seed: str | int | None = None,
    keep_true: bool = False,
) -> DataFrame:
    """Add ``noisy_value``; the true value is dropped unless asked for."""
    _check_parameters(epsilon, None if isinstance(sensitivity, Column) else sensitivity)
    sens = sensitivity if isinstance(sensitivity, Column) else F.lit(float(sensitivity))
    keys = [F.col(k) for k in row_key] or [F.lit("all")]
    noise = laplace_noise(sens / epsilon, keys, seed)
    out = df.withColumns(
        {
            "mechanism": F.lit("laplace"),
            "noisy_value": F.col(true_value) + noise,
            "epsilon": F.lit(float(epsilon)),
            "sensitivity": sens,
        }
    )
    return out if keep_true else out.drop(true_value)


def private_count(
    df: DataFrame,
    predicate: Column,
    epsilon: float = 1.0,
    sensitivity: float = 1.0,
    by: list[str] | None = None,
    seed: str | int | None = None,
    keep_true: bool = False,
) -> DataFrame:
    """Noisy number of rows that satisfy ``predicate``, per group."""
    by = by or []
    counts = df.groupBy(*by).agg(
        F.count_if(F.coalesce(predicate, F.lit(False))).cast("double").alias("true_value")
    )
    return laplace_mechanism(counts, "true_value", sensitivity, epsilon, by, seed, keep_true)


def private_mean(
    df: DataFrame,
    value: str,
    low: float,
    high: float,
    epsilon: float = 1.0,
    by: list[str] | None = None,
    seed: str | int | None = None,
    keep_true: bool = False,
) -> DataFrame:
    """Noisy mean of values clipped to [low, high]; sensitivity (high-low)/n."""
    if high <= low:
        raise ValueError("high must exceed low")
    by = by or []
    means = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by)
        .agg(
            F.avg(clip(F.col(value), low, high)).alias("true_value"),
            F.count(F.lit(1)).alias("_n"),
        )
        .filter("_n > 0")
    )
    sens = F.lit(float(high - low)) / F.col("_n")
    return laplace_mechanism(means, "true_value", sens, epsilon, by, seed, keep_true).drop("_n")


def advanced_composition(epsilon: Column, k: Column, delta: Column) -> Column:
    """Total epsilon of k queries under advanced composition; NULL when undefined."""
    total = F.sqrt(2 * k * F.log(1 / delta)) * epsilon + k * epsilon * (F.exp(epsilon) - 1)
    return F.when((epsilon > 0) & (k > 0) & (delta > 0) & (delta < 1), total)


def advanced_composition_value(epsilon: float, k: int, delta: float) -> float:
    _check_parameters(epsilon)
    if k <= 0:
        raise ValueError("k must be positive")
    if not 0 < delta < 1:
        raise ValueError("delta must lie in (0, 1)")
    return math.sqrt(2 * k * math.log(1 / delta)) * epsilon + k * epsilon * math.expm1(epsilon)


# -- budget ------------------------------------------------------------------------


# Spends are decided in whole units of 1e-12, so sums carry no rounding in any order.
UNIT = 10**12


def in_units(value: float) -> int:
    """A number as whole units, from its shortest decimal form."""
    return int((Decimal(repr(float(value))) * UNIT).to_integral_value(ROUND_HALF_UP))


def decide(spends: Iterable[int | None], left: int) -> Iterator[tuple[bool, int]]:
    """Accept or reject spends (in units) in order: the verdict and what is left after it."""
    for epsilon in spends:
        ok = epsilon is not None and 0 < epsilon <= left
        left -= epsilon if ok else 0
        yield ok, left


def _summary(spends: list[int]) -> list[tuple[int, int, int, int | None]]:
    """What positive spends, in order, do to a remainder, by its number of bits.

    For 0 and each number of bits among the spends: (bits, sum of all spends of
    that many bits or fewer, sum of those of fewer, the least remainder at the
    start with which one of exactly that many bits fits if all of fewer do).
    """
    out = []
    for bits in sorted({0} | {e.bit_length() for e in spends}):
        fewer, exactly, least = 0, 0, None
        for e in spends:
            if e.bit_length() < bits:
                fewer += e
            elif e.bit_length() == bits:
                exactly += e
                least = e + fewer if least is None else min(least, e + fewer)
        out.append((bits, fewer + exactly, fewer, least))
    return out


def _chunks(batches) -> Iterator[tuple]:
    """(budget, chunk, start, rows) of sorted Arrow batches; the first three columns are one value in a chunk."""
    key, rows = None, []
    for batch in batches:
        for values in zip(*[column.to_pylist() for column in batch.columns]):
            if key is not None and key[:2] != values[:2]:
                yield *key, rows
                rows = []
            key = values[:3]
            rows.append(values[3:])
    if key is not None:
        yield *key, rows


def _in_order(rows: DataFrame, start: str, more: list[str]) -> DataFrame:
    ordered = rows.repartition("_budget", "_chunk").sortWithinPartitions("_budget", "_chunk", "_seq", "_epsilon")
    return ordered.select("_budget", "_chunk", start, "_epsilon", *more)


def _summaries(base: DataFrame) -> DataFrame:
    kind = base.schema["_budget"].dataType
    names = ["_budget", "_chunk", "_bits", "_upto", "_fewer", "_least"]
    sums = pa.decimal128(38, 0)
    types = [to_arrow_type(kind), pa.int64(), pa.int32(), sums, sums, sums]

    def work(batches):
        for key, chunk, total, rows in _chunks(batches):
            found = _summary([e for (e,) in rows if e is not None and total is not None and 0 < e <= total])
            numbers = [[None if x is None else Decimal(x) for x in row[1:]] for row in found]
            columns = zip(*[(key, chunk, row[0], *more) for row, more in zip(found, numbers)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = f"_budget {kind.simpleString()}, _chunk bigint, _bits int, _upto decimal(38,0), _fewer decimal(38,0), _least decimal(38,0)"
    return _in_order(base, "_total", []).mapInArrow(work, schema)


def _starts(summary: DataFrame, state: DataFrame) -> DataFrame:
    """What is left at the start of each chunk (``_left``), if all chunks before it just pass, and whether it does (``_stops``)."""
    bits = F.when(F.col("_now") > 0, F.length(F.bin("_now"))).otherwise(0)
    begun = state.select(F.col("_budget").alias("_b"), "_now", "_next", bits.alias("_has"))
    ahead = summary.join(begun, F.col("_budget").eqNullSafe(F.col("_b")) & (F.col("_chunk") >= F.col("_next")))
    last = F.max(F.when(F.col("_bits") <= F.col("_has"), F.struct("_bits", "_upto", "_fewer", "_least"))).alias("_s")
    per = ahead.groupBy("_budget", "_chunk", "_now", "_has").agg(last)
    same = F.col("_s._bits") == F.col("_has")
    per = per.select(
        "_budget", "_chunk", "_now", "_has",
        F.when(same, F.col("_s._fewer")).otherwise(F.col("_s._upto")).alias("_sum"),
        F.when(same, F.col("_s._least")).alias("_least"),
        F.floor(F.col("_chunk") / 4_096).alias("_range"),
    )
    summed = running_totals(per, ["_budget"], ["_chunk"], "_range", ["_sum"])
    after = F.col("_now") - F.col("cum__sum")
    before = after + F.col("_sum")
    lowest = F.when(F.col("_has") > 0, F.pow(F.lit(2.0), F.col("_has") - 1)).otherwise(0).cast("decimal(38,0)")
    stops = (F.col("_has") > 0) & ((after < lowest) | F.coalesce(F.col("_least") <= before, F.lit(False)))
    return summed.select("_budget", "_chunk", before.alias("_left"), stops.alias("_stops"))


def spend_budget(
    ledger: DataFrame,
    total: Column | float,
    budget: str = "budget_id",
    seq: str = "seq",
    epsilon: str = "epsilon",
    chunk_rows: int = 8_192,
) -> DataFrame:
    """Decide every spend of every budget in order: accepted or rejected.

    A spend is accepted when it does not exceed what is left; a rejected one
    does not count, so a running sum alone gives wrong answers. One algorithm
    serves ledgers of any size, on whole units of 1e-12 (finer numbers are
    rounded to them), so no result depends on how rows are spread.

    The spends of a budget are cut into chunks, equal ranges of ``seq`` as many as
    give about ``chunk_rows`` rows each if its values are spread evenly. While the remainder of a budget has b bits, each spend of fewer bits fits,
    and one of b bits that fits takes a bit off it. So a chunk just passes,
    subtracting its spends of fewer bits, unless that takes a bit off or a
    spend of b bits fits; a short summary of the chunk tells. A round passes the
    chunks of all budgets at once up to the first that takes a bit off, and
    folds that one alone. There are at most as many rounds as a total has bits,
    however many spends. Last, each chunk is folded from its own start, which for
    the only chunk of a budget is its total. A task holds one chunk at a time.

    Null, negative and non-finite epsilons are rejected. Rows with a null
    ``seq`` come first; rows with equal ``seq``
    follow by epsilon, nulls first. A null total accepts nothing; totals above
    9 million raise. Null budgets are one budget.
    """
    if not isinstance(total, Column):
        if total <= 0:
            raise ValueError("the total budget must be positive")
        total = F.lit(float(total))
    if chunk_rows < 1:
        raise ValueError("a chunk has at least one row")

    def units(value: Column) -> Column:
        return F.round(value.cast("decimal(38,18)") * F.lit(UNIT), 0).cast("bigint")

    number, given, whole = F.col(seq).cast("bigint"), F.col(epsilon).cast("double"), total.cast("double")
    rows = ledger.select(
        F.col(budget).alias("_budget"),
        number.alias("_seq"),
        given.alias("_given"),
        F.when((given > 0) & (given <= whole + 1), units(given)).alias("_epsilon"),
        whole.alias("_whole"),
        (units(whole) + in_units(TOLERANCE)).alias("_total"),
    )
    place = F.col("_seq").cast("double")
    pieces = F.ceil(F.count(F.lit(1)) / chunk_rows)
    sizes = rows.groupBy(F.col("_budget").alias("_b")).agg(
        pieces.alias("_pieces"), F.min(place).alias("_from"), ((F.max(place) - F.min(place) + 1) / pieces).alias("_width")
    )
    of_budget = F.col("_budget").eqNullSafe(F.col("_b"))
    chunk = F.coalesce(F.floor((place - F.col("_from")) / F.col("_width")), F.lit(0)).cast("bigint")
    base = cut_lineage(
        rows.join(sizes, of_budget).select(*rows.columns, chunk.alias("_chunk"), (F.col("_pieces") > 1).alias("_many"))
    )
    kind = base.schema["_budget"].dataType
    key_type = to_arrow_type(kind)
    large = base.filter("_many")

    def fold(batches):
        for key, chunk, left, rows in _chunks(batches):
            for _, left in decide([e for (e,) in rows], int(left)):
                pass
            columns = [pa.array([key], key_type), pa.array([left], pa.int64()), pa.array([chunk + 1], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_budget", "_now", "_next"])

    passed: DataFrame | None = None
    state, summary, last = None, None, None
    if large.limit(1).count():
        summary = cut_lineage(_summaries(large))
        last = cut_lineage(summary.groupBy(F.col("_budget").alias("_b")).agg(F.max("_chunk").alias("_last")))
        state = cut_lineage(
            large.groupBy("_budget").agg(F.coalesce(F.max("_total"), F.lit(0)).alias("_now"), F.min("_chunk").alias("_next"))
        )
    while state is not None and state.limit(1).count():
        reached = cut_lineage(_starts(summary, state))
        first = reached.groupBy(F.col("_budget").alias("_b")).agg(F.min(F.when(F.col("_stops"), F.col("_chunk"))).alias("_stop"))
        until = reached.join(first, F.col("_budget").eqNullSafe(F.col("_b")))
        known = until.filter(F.col("_stop").isNull() | (F.col("_chunk") <= F.col("_stop")))
        known = known.select("_budget", "_chunk", F.col("_left").cast("bigint").alias("_left"), F.col("_chunk").eqNullSafe(F.col("_stop")).alias("_stops"))
        passed = known if passed is None else passed.unionByName(known)
        at = known.join(last, F.col("_budget").eqNullSafe(F.col("_b"))).filter("_stops and _chunk < _last")
        stopped = at.select(F.col("_budget").alias("_b"), F.col("_chunk").alias("_c"), "_left")
        here = F.col("_budget").eqNullSafe(F.col("_b")) & (F.col("_chunk") == F.col("_c"))
        stops = _in_order(large.join(stopped, here), "_left", [])
        state = cut_lineage(stops.mapInArrow(fold, f"_budget {kind.simpleString()}, _now bigint, _next bigint"))

    names = [budget, seq, epsilon, "accepted", "spent", "remaining"]
    types = [key_type, pa.int64(), pa.float64(), pa.bool_(), pa.float64(), pa.float64()]

    def verdicts(batches):
        for key, _, left, rows in _chunks(batches):
            out = []
            for (_, number, given, whole, total), (ok, rest) in zip(rows, decide([r[0] for r in rows], left)):
                spent = 0.0 if total is None else (total - rest) / UNIT
                out.append((key, number, given, ok, spent, None if whole is None else round(whole - spent, 10)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    begun = base.withColumn("_left", F.lit(None).cast("bigint"))
    if passed is not None:
        starts = passed.select(F.col("_budget").alias("_b"), F.col("_chunk").alias("_c"), "_left")
        here = F.col("_budget").eqNullSafe(F.col("_b")) & (F.col("_chunk") == F.col("_c"))
        begun = base.join(starts, here, "left")
    begun = begun.withColumn("_left", F.coalesce("_left", "_total", F.lit(0)))
    rows = _in_order(begun, "_left", ["_seq", "_given", "_whole", "_total"])
    schema = (
        f"`{budget}` {kind.simpleString()}, `{seq}` bigint, `{epsilon}` double, accepted boolean, spent double, remaining double"
    )
    return rows.mapInArrow(verdicts, schema)
