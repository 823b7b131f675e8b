"""Prompt scanning, single texts and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlattice.functions.scale import dense_position, pin, with_neighbours
from govlattice.functions.text import is_blank, pattern, swap
from govlattice.rules.prompts import (
    PROMPT_RULES,
    SAFE_THRESHOLD,
    SEVERITY_WEIGHT,
    ZERO_WIDTH,
    ZERO_WIDTH_MIN,
    ZERO_WIDTH_RULE,
    PromptRule,
)

FINDING_TYPE = "struct<technique:string,matched_pattern:string,severity:string>"


def _finding(technique: str, label: str, severity: str) -> Column:
    return F.struct(
        F.lit(technique).alias("technique"),
        F.lit(label).alias("matched_pattern"),
        F.lit(severity).alias("severity"),
    ).cast(FINDING_TYPE)


def zero_width_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, ZERO_WIDTH, ""))


def caseless(text: Column) -> Column:
    """Lower case plus the odd letters that match i, k and s without case."""
    return F.lower(swap(text, ("İ", "i"), ("ı", "i"), ("ſ", "s")))


def prompt_findings(
    text: Column, lowered: Column, rules: tuple[PromptRule, ...] = PROMPT_RULES
) -> Column:
    """One entry per rule that matches anywhere in the text, in rule order.

    Patterns are literals, so each is compiled once per task, and they run on a
    lower-cased copy instead of matching without case letter by letter. A plain
    substring test goes first: on most texts it decides, at a fraction of the
    price of the pattern. Rules are tested, not counted, which already removes
    repeats of the same phrase.
    """
    flags = []
    for rule in rules:
        hit = lowered.rlike(pattern(rule.pattern))
        if rule.needs:
            needed = lowered.contains(rule.needs[0])
            for word in rule.needs[1:]:
                needed = needed | lowered.contains(word)
            hit = needed & hit
        flags.append(F.when(hit, _finding(*rule[:3])))
    invisible = text.rlike(f"[{ZERO_WIDTH}]") & (zero_width_count(text) >= ZERO_WIDTH_MIN)
    flags.append(F.when(invisible, _finding(*ZERO_WIDTH_RULE)))
    none = F.array().cast(f"array<{FINDING_TYPE}>")
    return F.when(is_blank(text), none).otherwise(F.array_compact(F.array(*flags)))


def severity_weight(severity: Column) -> Column:
    out = F.when(severity == "low", SEVERITY_WEIGHT["low"])
    for level in ("medium", "high", "critical"):
        out = out.when(severity == level, SEVERITY_WEIGHT[level])
    return out


def prompt_score(findings: Column) -> Column:
    penalty = F.aggregate(
        findings, F.lit(0.0), lambda acc, f: acc + severity_weight(f["severity"])
    )
    return F.greatest(F.lit(0.0), F.round(F.lit(1.0) - penalty, 4))


def scan_prompts(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add ``findings``, ``score`` and ``is_safe`` for a text column."""
    findings, score = f"{prefix}findings", f"{prefix}score"
    lowered = df.withColumn("_lowered", caseless(F.col(text)))
    return (
        pin(lowered, findings, prompt_findings(F.col(text), F.col("_lowered")))
        .drop("_lowered")
        .withColumn(score, prompt_score(F.col(findings)))
        .withColumn(f"{prefix}is_safe", F.col(score) >= SAFE_THRESHOLD)
    )


def scan_turns(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    window: int = 3,
    chunk: int = 256,
) -> DataFrame:
    """Scan every turn and, when it starts a full window, the joined window.

    A window is scanned only if all its turns are safe on their own;
    ``window_score`` is then set and ``window_unsafe`` tells a payload split
    over several turns. Windows follow the order of the turns, whatever numbers
    they have; ``window_last`` is the number of the last one.
    """
    scanned = scan_prompts(turns, text)
    if window <= 1:
        return scanned.withColumns(
            {
                "window_last": F.lit(None).cast("bigint"),
                "window_score": F.lit(None).cast("double"),
                "window_unsafe": F.lit(False),
            }
        )
    placed = dense_position(
        scanned.withColumnRenamed("is_safe", "_safe"),
        [conversation],
        [turn, text],
        F.floor(F.col(turn) / chunk),
        "_pos",
    )
    near = with_neighbours(
        placed,
        [conversation],
        "_pos",
        [text, "_safe", turn],
        following=window - 1,
        chunk=chunk,
    )
    nexts = range(1, window)
    complete = F.col(f"_safe_next{window - 1}").isNotNull()
    all_safe = F.col("_safe")
    for i in nexts:
        all_safe = all_safe & F.col(f"_safe_next{i}")
    joined = F.concat_ws(" ", text, *[f"{text}_next{i}" for i in nexts])
    out = near.withColumn("_window_text", F.when(complete & all_safe, joined))
    out = scan_prompts(out, "_window_text", prefix="_window_")
    has_window = F.col("_window_text").isNotNull()
    return out.select(
        *turns.columns,
        "findings",
        "score",
        F.col("_safe").alias("is_safe"),
        F.when(has_window, F.col(f"{turn}_next{window - 1}")).alias("window_last"),
        F.when(has_window, F.col("_window_score")).alias("window_score"),
        (has_window & ~F.col("_window_is_safe")).alias("window_unsafe"),
    )


def reassembled_windows(
    scanned: DataFrame, conversation: str = "conv_id", turn: str = "turn"
) -> DataFrame:
    """Windows that are unsafe although each of their turns is safe."""
    return scanned.filter("window_unsafe").select(
        conversation,
        F.col(turn).alias("first_turn"),
        F.col("window_last").alias("last_turn"),
        F.col("window_score").alias("score"),
    )


def conversation_summary(scanned: DataFrame, conversation: str = "conv_id") -> DataFrame:
    return (
        scanned.groupBy(conversation)
        .agg(
            F.count(F.lit(1)).alias("turns"),
            F.count_if(~F.col("is_safe")).alias("unsafe_turns"),
            F.count_if("window_unsafe").alias("unsafe_windows"),
        )
        .withColumn(
            "overall_safe", (F.col("unsafe_turns") == 0) & (F.col("unsafe_windows") == 0)
        )
    )


def evaluate_detection(
    payloads: DataFrame,
    scanner=scan_prompts,
    text: str = "payload",
    category: str = "category",
    expected: str = "expected_detection",
) -> DataFrame:
    """Run a scanner over labelled payloads: ``detected`` and ``passed`` per row.

    ``scanner`` is any DataFrame -> DataFrame function that adds ``is_safe``.
    """
    scanned = scanner(payloads, text)
    return scanned.withColumn("detected", ~F.col("is_safe")).withColumn(
        "passed", F.col("detected") == F.col(expected)
    )


def detection_report(
    evaluated: DataFrame, by: list[str] | None = None, expected: str = "expected_detection"
) -> DataFrame:
    """Detection figures over all payloads or per group.

    ``detection_rate`` divides by all payloads including benign controls;
    ``attack_recall`` and ``false_positives`` keep the two kinds apart.
    """
    attacks = F.count_if(expected)
    caught = F.count_if(F.col("detected") & F.col(expected))
    return (
        evaluated.groupBy(*(by or []))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("detected").alias("detected"),
            F.count_if("passed").alias("passed"),
            F.count_if(F.col("detected") & ~F.col(expected)).alias("false_positives"),
            F.round(F.avg(F.col("detected").cast("double")), 4).alias("detection_rate"),
            F.round(caught / F.nullif(attacks, F.lit(0)), 4).alias("attack_recall"),
        )
    )


def coverage_gaps(evaluated: DataFrame, case: str) -> DataFrame:
    """Cases that did not pass, with what kind of gap each is; rows, so any number of them."""
    kind = F.when(F.col("detected"), "false_alarm").otherwise("missed")
    return evaluated.filter(~F.col("passed")).select(case, kind.alias("gap"))


def attack_family(category: Column) -> Column:
    """Evasion and obfuscation variants count as one family each."""
    return (
        F.when(category.startswith("evasion"), "evasion")
        .when(category.startswith("obfuscation"), "obfuscation")
        .otherwise(category)
    )
