"""Trust score and its explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the scoring formula.
BASE = 100.0
SENSITIVE_EACH, SENSITIVE_CAP = 15.0, 45.0
PERSONAL_EACH, PERSONAL_CAP = 4.0, 20.0
REVIEW_EACH = 20.0
MITIGATION_EACH = 5.0
PROMPT_MAX, PROMPT_UNSAFE = 30.0, 15.0
DENY_FLOOR = 5.0
RISK_BANDS = ((80.0, "low"), (50.0, "medium"), (20.0, "high"))


def risk_band(score: Column) -> Column:
    out = F.when(score >= RISK_BANDS[0][0], RISK_BANDS[0][1])
    for bound, level in RISK_BANDS[1:]:
        out = out.when(score >= bound, level)
    return out.otherwise("critical")


def _clamp(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(BASE))


def with_trust_score(
    df: DataFrame,
    *,
    sensitive: Column,
    personal: Column,
    reviews: Column,
    mitigations: Column,
    denied: Column,
    prompt_score: Column | None = None,
    prompt_safe: Column | None = None,
) -> DataFrame:
    """Add ``score``, ``risk_level`` and ``components`` from per-row counts.

    A missing prompt score means no prompt was given: no penalty.
    """
    pii = F.least(sensitive * SENSITIVE_EACH, F.lit(SENSITIVE_CAP)) + F.least(
        personal * PERSONAL_EACH, F.lit(PERSONAL_CAP)
    )
    if prompt_score is None:
        prompt = F.lit(0.0)
    else:
        unsafe = F.when(~prompt_safe, F.lit(PROMPT_UNSAFE)).otherwise(0.0)
        prompt = F.coalesce((1.0 - prompt_score) * PROMPT_MAX + unsafe, F.lit(0.0))
    staged = df.withColumns(
        {
            "_pii": pii.cast("double"),
            "_review": (reviews * REVIEW_EACH).cast("double"),
            "_mitig": (mitigations * MITIGATION_EACH).cast("double"),
            "_prompt": prompt.cast("double"),
            "_denied": F.coalesce(denied, F.lit(False)),
        }
    )
    staged = staged.withColumn("_open", _clamp(F.expr(f"{BASE}D - _pii - _review - _mitig - _prompt")))
    staged = staged.withColumn(
        "score",
        F.when(F.col("_denied"), F.least("_open", F.lit(DENY_FLOOR))).otherwise(F.col("_open")),
    )
    # 0.0 is added so that no penalty shows as 0 and never as minus zero.
    parts = {
        "base_score": F.lit(BASE),
        "pii_penalty": -F.col("_pii") + 0.0,
        "policy_human_review_penalty": -F.col("_review") + 0.0,
        "policy_mitigation_penalty": -F.col("_mitig") + 0.0,
        "policy_deny_penalty": F.col("score") - F.col("_open") + 0.0,
        "prompt_security_penalty": -F.col("_prompt") + 0.0,
        "final_score": F.col("score"),
    }
    pairs = [x for name, c in parts.items() for x in (F.lit(name), c)]
    return (
        staged.withColumn("risk_level", risk_band(F.col("score")))
        .withColumn("components", F.create_map(*pairs))
        .drop("_pii", "_review", "_mitig", "_prompt", "_denied", "_open")
    )


def _size_where(arr: Column, test) -> Column:
    return F.size(F.filter(arr, test))


def trust_of_arrays(
    df: DataFrame,
    pii: str | None = "pii",
    decisions: str | None = "decisions",
    prompt_score: str | None = None,
    prompt_safe: str | None = None,
) -> DataFrame:
    """Trust score of rows that carry findings and decisions as arrays (no shuffle)."""
    zero = F.lit(0)
    d = F.col(decisions) if decisions else None
    return with_trust_score(
        df,
        sensitive=_size_where(F.col(pii), lambda f: f["category"] == "sensitive") if pii else zero,
        personal=_size_where(F.col(pii), lambda f: f["category"] == "personal") if pii else zero,
        reviews=_size_where(d, lambda x: x["status"] == "requires_human_review")
        if decisions
        else zero,
        mitigations=F.aggregate(
            d,
            F.lit(0),
            lambda a, x: a
            + F.when(x["status"] == "allow_with_mitigation", F.size(x["mitigations"])).otherwise(0),
        )
        if decisions
        else zero,
        denied=F.exists(d, lambda x: x["status"] == "deny") if decisions else F.lit(False),
        prompt_score=F.col(prompt_score) if prompt_score else None,
        prompt_safe=F.col(prompt_safe) if prompt_safe else None,
    )


def trust_of_tables(
    subjects: DataFrame,
    key: str,
    findings: DataFrame | None = None,
    decisions: DataFrame | None = None,
    prompts: DataFrame | None = None,
) -> DataFrame:
    """Trust score per subject from long tables of findings, decisions and prompt scores.

    Each table is reduced to one row per subject before it meets the others;
    subjects without signals keep the full score.
    """
    zero = F.lit(0).cast("bigint")
    out = subjects.select(key)
    if findings is not None:
        out = out.join(
            findings.groupBy(key).agg(
                F.count_if(F.col("category") == "sensitive").alias("_ns"),
                F.count_if(F.col("category") == "personal").alias("_np"),
            ),
            key,
            "left",
        )
    else:
        out = out.withColumns({"_ns": zero, "_np": zero})
    if decisions is not None:
        mitig = F.when(F.col("status") == "allow_with_mitigation", F.size("mitigations"))
        out = out.join(
            decisions.groupBy(key).agg(
                F.count_if(F.col("status") == "requires_human_review").alias("_nr"),
                F.coalesce(F.sum(mitig), zero).alias("_nm"),
                F.bool_or(F.col("status") == "deny").alias("_nd"),
            ),
            key,
            "left",
        )
    else:
        out = out.withColumns({"_nr": zero, "_nm": zero, "_nd": F.lit(False)})
    if prompts is not None:
        out = out.join(
            prompts.groupBy(key).agg(
                F.min("score").alias("_ps"), F.bool_and("is_safe").alias("_pk")
            ),
            key,
            "left",
        )
    scored = with_trust_score(
        out,
        sensitive=F.coalesce("_ns", zero),
        personal=F.coalesce("_np", zero),
        reviews=F.coalesce("_nr", zero),
        mitigations=F.coalesce("_nm", zero),
        denied=F.col("_nd"),
        prompt_score=F.col("_ps") if prompts is not None else None,
        prompt_safe=F.col("_pk") if prompts is not None else None,
    )
    return scored.select(key, "score", "risk_level", "components")


# -- explanation -----------------------------------------------------------------

# Fixed Portuguese wording of the narrative.
LEAD_FIRST = "principalmente influenciada por"
LEAD_NEXT = "seguido por"
UP, DOWN, FLAT = (
    "aumentando o resultado",
    "reduzindo o resultado",
    "sem impacto líquido sobre o resultado",
)
NO_FACTOR_BODY = "nenhum fator registrado"


def _mould(template: str, subject: Column, body: Column) -> Column | None:
    """Fill ``{subject}`` and ``{body}``; None when the template is malformed."""
    try:
        filled = template.format(subject="\x00s\x00", body="\x00b\x00")
    except (KeyError, IndexError):
        return None
    parts = {"s": subject, "b": body}
    pieces = filled.split("\x00")
    # Odd positions are the placeholders, even ones the text around them.
    return F.concat(*[parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def narrative(factors: Column, subject: Column, template: str | None = None) -> Column:
    """Sentence listing signed factors by size, ties in the order they were given."""
    entries = F.transform(
        F.map_entries(factors),
        lambda e, i: F.struct(
            (-F.abs(e["value"])).alias("rank"),
            i.alias("at"),
            e["key"].alias("name"),
            e["value"].alias("value"),
        ),
    )

    def clause(e: Column, i: Column) -> Column:
        v = e["value"]
        amount = F.concat(F.when(v >= 0, "+").otherwise(""), F.format_string("%.2f", v))
        way = F.when(v > 0, UP).when(v < 0, DOWN).otherwise(FLAT)
        return F.concat(
            F.when(i == 0, LEAD_FIRST).otherwise(LEAD_NEXT),
            F.lit(" '"),
            e["name"],
            F.lit("' (contribuição de "),
            amount,
            F.lit(", "),
            way,
            F.lit(")"),
        )

    body = F.array_join(F.transform(F.sort_array(entries), clause), "; ")
    if template is None:
        full = F.concat(F.lit("A decisão sobre '"), subject, F.lit("' foi "), body, F.lit("."))
        empty = F.concat(
            F.lit("Não há fatores registrados para explicar a decisão sobre '"),
            subject,
            F.lit("'."),
        )
    else:
        full = empty = None
        if "{subject}" in template or "{body}" in template:
            full = _mould(template, subject, body)
            empty = _mould(template, subject, F.lit(NO_FACTOR_BODY))
        if full is None:
            prefix = template.rstrip()
            if not prefix.endswith((".", ":", ";", "!", "?")):
                prefix += ":"
            full = F.concat(F.lit(f"{prefix} a decisão foi "), body, F.lit("."))
            empty = F.lit(f"{prefix} não há fatores registrados para esta decisão.")
    return F.when(F.size(factors) > 0, full).otherwise(empty)


def explain(
    df: DataFrame, factors: str, subject: Column, template: str | None = None
) -> DataFrame:
    return df.withColumn("narrative", narrative(F.col(factors), subject, template))
