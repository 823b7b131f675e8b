"""Quality rules as a short-circuit cascade of native expressions.

Each rule says when a text is rejected. On a bounded sample the rules are timed
and their rejections counted; the cascade then asks the rule that rejects most
per second first, and an expression behind it is only evaluated for texts that
got so far. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlattice.functions.scale import pin
from govlattice.llm.common import BLANK, whole


# Longest text in the sample, in bytes.
SAMPLE_BYTES = 64 << 10
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean over the features that ``needs`` names; null counts as false."""

    name: str
    rejects: Column
    needs: tuple[str, ...]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), "")


def _repeated_windows() -> Column:
    """The repeated windows, dealt into lists.

    ``_h`` are the hashes of the windows, ``_twice`` those found twice or more
    in ascending order. They are dealt into about as many lists as the root of
    their number, so that looking one up stays cheap in long texts. Windows
    count as equal if their 64-bit hashes are.
    """
    lists = F.greatest(F.lit(1), F.floor(F.sqrt(F.size("_twice")) / 2)).cast("bigint")
    dealt = F.when(F.size("_twice") <= 64, F.array(F.col("_twice"))).otherwise(
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), lists - 1),
            lambda b: F.filter("_twice", lambda h: F.pmod(h, lists) == b),
        )
    )
    return dealt.alias("_dealt")


def _counts(df: DataFrame, text: Column, wanted: Collection[str]) -> DataFrame:
    if "n_symbols" in wanted:
        df = df.withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint"))
    if "n_dup_lines" in wanted:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
        df = pin(df, "_lines", lines)
        repeated = F.size("_lines") - F.size(F.array_distinct("_lines"))
        df = df.withColumn("n_dup_lines", repeated.cast("bigint")).drop("_lines")
    if not {"n_words", "word_chars", "n_repeat_words"} & set(wanted):
        return df
    df = pin(df, "_w", words_of(text))
    if "n_words" in wanted:
        df = df.withColumn("n_words", F.size("_w").cast("bigint"))
    if "word_chars" in wanted:
        df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("bigint"))
    return _repeats(df) if "n_repeat_words" in wanted else df.drop("_w")


def _repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words from the words ``_w``, which are dropped."""
    windows = F.transform(
        F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)),
    )
    df = pin(df, "_h", windows).drop("_w")
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    df = pin(df, "_s", F.when(twice, F.sort_array("_h")).otherwise(F.array().cast("array<bigint>")))
    df = pin(df, "_twice", F.array_distinct(F.filter("_s", lambda x, i: x == F.get("_s", i + 1)))).drop("_s")
    df = pin(df, "_dealt", _repeated_windows())
    marked = F.transform(
        "_h",
        lambda h, i: F.when(F.array_contains(F.get("_dealt", F.pmod(h, F.size("_dealt")).cast("int")), h), i),
    )
    df = pin(df, "_at", F.when(F.size("_twice") > 0, F.array_compact(marked))).drop("_h", "_twice", "_dealt")
    covered = F.aggregate(
        F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("_at")


def with_features(df: DataFrame, text_column: str = "text", wanted: Collection[str] = FEATURES) -> DataFrame:
    """Add the wanted ones of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text.

    Null is a text without words. Columns of these names are replaced.
    """
    out = df.drop(*wanted)
    kept = out.columns
    return _counts(out, F.coalesce(F.col(text_column), F.lit("")), wanted).select(*kept, *wanted)


def base_rules() -> list[Rule]:
    return [
        Rule("too_few_words", F.col("n_words") < 50, ("n_words",)),
        Rule(
            "repeated_words", 100 * F.col("n_repeat_words") > 50 * F.col("n_words"), ("n_words", "n_repeat_words")
        ),
    ]


def further_rules() -> list[Rule]:
    """More symbols than a tenth of the words, words far too short or long, half as many repeated lines as words."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > words, ("n_words", "n_symbols")),
        Rule("word_length", (chars < 2 * words) | (chars > 25 * words), ("n_words", "word_chars")),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > words, ("n_words", "n_dup_lines")),
    ]


def _fires(rule: Rule) -> Column:
    return F.coalesce(rule.rejects, F.lit(False))


def order_by_gain(docs: DataFrame, text_column: str, rules: Sequence[Rule], sample_rows: int) -> list[Rule]:
    """Rules by rejected rows per second on a sample of at most ``sample_rows``, the best first.

    The sample is the first rows with texts of at most ``SAMPLE_BYTES``, so the
    driver can pass it on. Each rule is run alone with just the features it
    needs, so its time is its own; equal gains keep the given order.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(text.alias("_text")).filter(F.octet_length("_text") <= SAMPLE_BYTES).take(sample_rows)
    sample = docs.sparkSession.createDataFrame(rows, "_text string")
    gains = []
    for rule in rules:
        began = time.perf_counter()
        hits = with_features(sample, "_text", rule.needs).agg(F.count_if(_fires(rule)).alias("n")).first()["n"]
        gains.append(hits / max(time.perf_counter() - began, 1e-6))
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -gains[i])]


def judge_quality(
    docs: DataFrame,
    text_column: str = "text",
    rules: Sequence[Rule] | None = None,
    sample_rows: int = 1_000,
) -> DataFrame:
    """Add all features, ``base_failed``, ``rejected_by`` and ``kept`` to every row.

    ``sample_rows`` bounds the sample on which the order of the rules is
    estimated; ``kept`` is over all rows and does not depend on it, only the
    name in ``rejected_by`` (the first rule of the cascade that fires) does.
    Null and empty texts have no words and fail. Repeated rows are judged
    alike; an empty table gives no rows. Other columns pass through; those
    named like a feature or a verdict are replaced.
    """
    rules = list(rules) if rules is not None else [*base_rules(), *further_rules()]
    docs = docs.drop("base_failed", "rejected_by", "kept")
    first = F.when(F.lit(False), F.lit(""))
    for rule in order_by_gain(docs, text_column, rules, sample_rows):
        first = first.when(_fires(rule), rule.name)
    judged = with_features(docs, text_column).withColumn("rejected_by", first)
    failed = _fires(base_rules()[0]) | _fires(base_rules()[1])
    return judged.withColumns({"base_failed": failed, "kept": ~failed & F.col("rejected_by").isNull()})


def keep_good(
    docs: DataFrame,
    text_column: str = "text",
    rules: Sequence[Rule] | None = None,
    sample_rows: int = 1_000,
) -> DataFrame:
    """Rows that no rule rejects, with their columns as they were.

    The rules filter one after the other, and a feature is computed when the
    first rule needs it, for the rows still there. Nulls, empty texts, repeated
    rows and empty tables: as in :func:`judge_quality`.
    """
    rules = list(rules) if rules is not None else [*base_rules(), *further_rules()]
    out = docs.select(whole(docs).alias("_row"), F.col(text_column).alias("_text"))
    have: set[str] = set()
    for rule in order_by_gain(docs, text_column, rules, sample_rows):
        if new := [f for f in rule.needs if f not in have]:
            out = with_features(out, "_text", new)
            have.update(new)
        out = out.filter(~_fires(rule))
    return out.select("_row.*")
