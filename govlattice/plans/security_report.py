"""The full robustness battery and its text report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlattice.operators import robustness as M
from govlattice.rules.levels import RISK_LEVELS

REPORT_SCHEMA = (
    "attack string, epsilon double, clean_accuracy double, adversarial_accuracy double, "
    "accuracy_drop double, success_rate double"
)
RISK_LABEL = {"low": "LOW", "medium": "MEDIUM", "high": "HIGH RISK", "critical": "CRITICAL"}
WIDTH = 52


def evaluate_robustness(
    test: DataFrame, model: M.LinearModel, epsilon: float = 0.1, key: str = "id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(attack rows, curve, one metrics row)."""
    plain = M.attack_report(M.fgsm(test, model, epsilon), model, "fgsm", epsilon)
    strong = M.attack_report(M.pgd(test, model, epsilon, key=key), model, "pgd", epsilon)
    curve = M.robustness_curve(test, model, key=key)
    clean = F.broadcast(plain.select("clean_accuracy"))
    budget = M.min_perturbation_budget(
        curve.join(clean), F.col("clean_accuracy") * 0.5
    )
    metrics = strong.select(
        "clean_accuracy", F.col("adversarial_accuracy").alias("robust_accuracy")
    ).join(F.broadcast(budget))
    metrics = metrics.withColumn(
        "risk_level", M.robustness_risk(F.col("clean_accuracy"), F.col("robust_accuracy"))
    )
    return plain.unionByName(strong), curve, metrics


def overall_risk(robustness: str, gaps: int | None) -> str:
    """The worse of model robustness and prompt-detection gaps."""
    levels = [robustness]
    if gaps is not None:
        levels.append("medium" if gaps else "low")
    return max(levels, key=RISK_LEVELS.index)


def recommendations(risk: str, improved: bool) -> list[str]:
    out = []
    if risk in ("high", "critical"):
        out += [
            "train on attacked inputs before release",
            "limit the range of the input features",
            "watch the input distribution and the scores in production",
        ]
    if improved:
        out.append("replace the model by the retrained one of this report")
    return out or ["keep the usual monitoring"]


def security_assessment(
    train: DataFrame,
    test: DataFrame,
    classes: int,
    model: M.LinearModel | None = None,
    epsilon: float = 0.1,
    key: str = "id",
    gaps: int | None = None,
    name: str = "model",
) -> tuple[DataFrame, DataFrame]:
    """Attack rows and the report as numbered text lines.

    The model fits and the metric rows are driver-side steps, each a handful of
    numbers; every pass over the data is a Spark job.
    """
    spark = test.sparkSession
    model = model or M.fit_linear(train)
    attacks, _, metrics = evaluate_robustness(test, model, epsilon, key)
    before = metrics.collect()[0]
    rows = [r.asDict() for r in attacks.drop("samples").collect()]
    rows.append(M.extraction_report(model, train, test))
    rows.append(M.poisoning_report(train, test, classes, key=key))
    hardened = M.adversarial_training(train, epsilon, key=key)
    after = evaluate_robustness(test, hardened, epsilon, key)[2].collect()[0]
    improved = after["robust_accuracy"] > before["robust_accuracy"]
    risk = overall_risk(before["risk_level"], gaps)
    order = REPORT_SCHEMA.replace(" double", "").replace(" string", "").split(", ")
    table = spark.createDataFrame([tuple(r[c] for c in order) for r in rows], REPORT_SCHEMA)
    text = render_report(name, before, after, rows, risk, gaps, recommendations(risk, improved))
    lines = spark.createDataFrame(list(enumerate(text)), "line_no int, line string")
    return table, lines


def _entry(label: str, value: str) -> str:
    return f"{label + ' ':.<28} {value}"


def render_report(name, before, after, attacks, risk, gaps, advice) -> list[str]:
    rule = "=" * WIDTH
    by_name = {a["attack"]: a for a in attacks}
    out = [rule, f"  MODEL SECURITY REPORT  —  {name}", rule, ""]
    out.append(_entry("Clean Accuracy", f"{before['clean_accuracy']:.1%}"))
    for a in ("fgsm", "pgd"):
        row = by_name[a]
        out.append(
            _entry(f"{a.upper()} Accuracy (eps={row['epsilon']})", f"{row['adversarial_accuracy']:.1%}")
        )
    out += ["", _entry("Robust Accuracy (PGD)", f"{before['robust_accuracy']:.1%}")]
    if before["min_perturbation_budget"] is not None:
        out.append(_entry("Min Perturbation Budget", f"eps={before['min_perturbation_budget']}"))
    out.append(_entry("Adversarial Robustness", RISK_LABEL[before["risk_level"]]))
    out += [
        "",
        _entry("Data Poisoning Risk", f"drop {by_name['poisoning']['accuracy_drop']:.1%}"),
        _entry("Model Extraction Risk", f"fidelity {by_name['extraction']['success_rate']:.1%}"),
        "",
        _entry(
            "Defense [adversarial_training]",
            f"robust {before['robust_accuracy']:.1%} -> {after['robust_accuracy']:.1%}",
        ),
        "",
    ]
    if gaps is not None:
        out += [_entry("Prompt Detection Gaps", str(gaps)), ""]
    out.append(_entry("Overall Risk", RISK_LABEL[risk]))
    out += ["", "Recommended Mitigation:", *[f"  - {a}" for a in advice], rule]
    return out
