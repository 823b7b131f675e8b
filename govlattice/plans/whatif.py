"""What-if scoring of scenarios and the effect of a changed rule context."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlattice.operators.graph import find_related
from govlattice.operators.policy import evaluate_policies, explode_decisions
from govlattice.operators.trust import trust_of_arrays


def simulate(scenarios: DataFrame, policies: list[dict[str, Any]] | None = None) -> DataFrame:
    """Decisions and trust score per scenario; nothing is written."""
    return trust_of_arrays(evaluate_policies(scenarios, policies), pii=None)


def _codes(name: str):
    return F.array_sort(
        F.transform(name, lambda d: F.concat(d["policy_id"], F.lit(":"), d["status"]))
    )


def _direction(delta):
    return F.when(delta > 0, "increases").when(delta < 0, "decreases").otherwise("keeps")


def _compared(both: DataFrame) -> DataFrame:
    delta = F.round(F.col("score_b") - F.col("score_a"), 2)
    return both.withColumns(
        {
            "delta": delta,
            "direction": _direction(delta),
            "added": F.array_except("codes_b", "codes_a"),
            "removed": F.array_except("codes_a", "codes_b"),
        }
    )


def compare_override(
    scenarios: DataFrame,
    override: dict[str, str],
    policies: list[dict[str, Any]] | None = None,
) -> DataFrame:
    """Each scenario before and after overriding parts of its context.

    Both variants sit in one row, so before and after need no join.
    """
    changed = F.create_map(*[F.lit(x) for kv in override.items() for x in kv])
    ctx = F.coalesce(F.col("context"), F.create_map().cast("map<string,string>"))
    keys = F.array(*[F.lit(k) for k in override])
    merged = F.map_concat(F.map_filter(ctx, lambda k, v: ~F.array_contains(keys, k)), changed)
    before = simulate(scenarios, policies).withColumnsRenamed(
        {"score": "score_a", "risk_level": "risk_a", "components": "_components_a"}
    )
    before = before.withColumn("codes_a", _codes("decisions")).drop("decisions", "_components_a")
    after = trust_of_arrays(
        evaluate_policies(before.withColumn("_merged", merged), policies, context="_merged"),
        pii=None,
    )
    after = after.withColumnsRenamed({"score": "score_b", "risk_level": "risk_b"}).withColumn(
        "codes_b", _codes("decisions")
    )
    return _compared(after.drop("decisions", "_merged", "components"))


def compare_scenarios(
    scenarios: DataFrame,
    pair: str = "pair_id",
    side: str = "side",
    policies: list[dict[str, Any]] | None = None,
) -> DataFrame:
    """Side ``a`` against side ``b`` of each pair, scored once on the union."""
    scored = simulate(scenarios, policies).withColumn("codes", _codes("decisions"))

    def only(s: str) -> list:
        test = F.col(side) == s
        return [
            F.max(F.when(test, F.col("score"))).alias(f"score_{s}"),
            F.max(F.when(test, F.col("risk_level"))).alias(f"risk_{s}"),
            F.max(F.when(test, F.col("codes"))).alias(f"codes_{s}"),
        ]

    return _compared(scored.groupBy(pair).agg(*only("a"), *only("b")))


def change_impact(
    scenarios: DataFrame,
    override: dict[str, str],
    policies: list[dict[str, Any]] | None = None,
) -> DataFrame:
    """How many scenarios a changed context would move."""
    return compare_override(scenarios, override, policies).agg(
        F.count(F.lit(1)).alias("scenarios"),
        F.count_if(F.col("delta") != 0).alias("changed"),
        F.round(F.avg("delta"), 4).alias("mean_delta"),
    )


def affected_articles(nodes: DataFrame, edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Articles one mention away from each changed one: ``changed``, ``article``.

    ``numbers``: ``number``, the changed articles; ``nodes`` and ``edges`` as in
    :mod:`govlattice.operators.graph`.
    """
    starts = numbers.select(F.concat(F.lit("art_"), F.col("number").cast("string")).alias("id"))
    near = find_related(edges, starts, 1).select(F.col("src").alias("changed"), "id")
    named = nodes.select("id", F.coalesce("article", "id").alias("article")).distinct()
    return near.join(named, "id").select("changed", "article")


def regulatory_change(
    scenarios: DataFrame,
    number: int,
    override: dict[str, str],
    nodes: DataFrame,
    edges: DataFrame,
    policies: list[dict[str, Any]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Effect of a changed article: (directly affected articles, figures of :func:`change_impact`)."""
    number_row = scenarios.sparkSession.createDataFrame([(number,)], "number int")
    return affected_articles(nodes, edges, number_row), change_impact(scenarios, override, policies)


def review_items(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """A pending review item for every decision that asks for a human."""
    return (
        explode_decisions(evaluated, keys)
        .filter(F.col("status") == "requires_human_review")
        .select(
            *keys,
            "policy_id",
            "risk_level",
            F.col("rationale").alias("reason"),
            F.lit("pending").alias("status"),
        )
    )
