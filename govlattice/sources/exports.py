"""Text exports: metric exposition lines and plain reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


HELP = {
    "calls": "Calls recorded for each module.",
    "errors": "Calls that ended in an error.",
    "mean": "Mean duration of the recorded calls in milliseconds.",
}


def _line(group: int, line: Column | str, key: Column | None = None) -> Column:
    return F.struct(
        F.lit(group).alias("part"),
        (F.lit("") if key is None else key).alias("key"),
        (F.lit(line) if isinstance(line, str) else line).alias("line"),
    )


def prometheus_lines(snapshot: DataFrame, prefix: str = "governance") -> DataFrame:
    """Exposition text of a call snapshot, one row per line.

    Each row of the snapshot contributes its own lines: a module its counter,
    the total row the headers and totals. ``part`` and ``key`` give the order.
    """
    calls, errors, mean = (
        f"{prefix}_module_calls_total",
        f"{prefix}_module_call_errors_total",
        f"{prefix}_module_call_duration_ms_avg",
    )
    module_line = F.concat(
        F.lit(calls + '{module="'), F.col("module"), F.lit('"} '), F.col("calls").cast("string")
    )
    total = F.array(
        _line(10, f"# HELP {calls} {HELP['calls']}"),
        _line(11, f"# TYPE {calls} counter"),
        _line(20, f"# HELP {errors} {HELP['errors']}"),
        _line(21, f"# TYPE {errors} counter"),
        _line(22, F.concat(F.lit(errors + " "), F.col("errors").cast("string"))),
        _line(30, f"# HELP {mean} {HELP['mean']}"),
        _line(31, f"# TYPE {mean} gauge"),
        _line(32, F.concat(F.lit(mean + " "), F.format_string("%.4f", F.col("avg_duration_ms")))),
    )
    one = F.array(_line(12, module_line, F.col("module")))
    return snapshot.select(F.inline(F.when(F.col("is_total") == 1, total).otherwise(one)))


def write_lines(lines: DataFrame, path: str, order: list[str], mode: str = "overwrite") -> None:
    """Write ordered lines as text. Reports are a handful of lines: one file."""
    lines.orderBy(*order).select("line").coalesce(1).write.mode(mode).text(path)
