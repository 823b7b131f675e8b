"""Queries: scoring, attacks, defences and the security report on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlattice.operators import robustness as M
from govlattice.plans import security_report as S
from govlattice.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def vectors(spark, base):
    return table(spark, base, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.col("label").alias("y"),
    )


def _split(df):
    """Seven tenths to train on, by a hash of the key."""
    part = F.pmod(F.xxhash64("id"), F.lit(10))
    return df.filter(part < 7), df.filter(part >= 7)


CENTROID_SQL = """WITH x AS (SELECT vec_id, label AS y, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT y AS k, i, avg(x) AS m FROM x GROUP BY 1, 2),
    z AS (SELECT vec_id, y, k, sum(x * m) AS z FROM x JOIN c USING (i) GROUP BY 1, 2, 3),
    e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z),
    p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)"""


@query(
    "linear_predictions",
    CENTROID_SQL
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC) AS rn FROM p)
        SELECT vec_id AS id, max(k) FILTER (WHERE rn = 1)::INT AS predicted, round(max(p), 6) AS top,
          round(max(p) - max(p) FILTER (WHERE rn = 2), 6) AS margin, round(-sum(p * ln(greatest(p, 1e-12))), 6) AS entropy
        FROM o GROUP BY 1""",
)
def linear_predictions(spark, base):
    data = vectors(spark, base)
    scored = M.with_probabilities(data, M.centroid_model(data))
    return scored.select(
        "id",
        "predicted",
        F.round(F.array_max("proba"), 6).alias("top"),
        F.round(M.margin(F.col("proba")), 6).alias("margin"),
        F.round(M.entropy(F.col("proba")), 6).alias("entropy"),
    )


FGSM_SQL = CENTROID_SQL + """, g AS (SELECT vec_id, i, sum((p - CASE WHEN k = y THEN 1 ELSE 0 END) * m) AS g FROM p JOIN c USING (k) GROUP BY 1, 2),
    xa AS (SELECT x.vec_id, x.y, x.i, x.x + 0.02 * sign(g.g) AS x FROM x JOIN g USING (vec_id, i)),
    za AS (SELECT vec_id, y, k, sum(x * m) AS z FROM xa JOIN c USING (i) GROUP BY 1, 2, 3),
    b0 AS (SELECT vec_id, any_value(y) AS y, arg_max(k, z) AS k FROM z GROUP BY 1),
    b1 AS (SELECT vec_id, arg_max(k, z) AS k FROM za GROUP BY 1),
    s AS (SELECT b0.k = y AS c, b1.k = y AS a FROM b0 JOIN b1 USING (vec_id))"""


@query(
    "fgsm_attack",
    FGSM_SQL
    + """ SELECT 'fgsm' AS attack, 0.02::DOUBLE AS epsilon, round(avg(c::INT), 4)::DOUBLE AS clean_accuracy, round(avg(a::INT), 4)::DOUBLE AS adversarial_accuracy,
        round(avg(c::INT) - avg(a::INT), 4)::DOUBLE AS accuracy_drop, round(count(*) FILTER (WHERE c AND NOT a) / greatest(count(*) FILTER (WHERE c), 1), 4)::DOUBLE AS success_rate,
        count(*)::BIGINT AS samples FROM s""",
)
def fgsm_attack(spark, base):
    data = vectors(spark, base)
    model = M.centroid_model(data)
    return M.attack_report(M.fgsm(data, model, 0.02), model, "fgsm", 0.02)


@query(
    "fgsm_inputs",
    FGSM_SQL.split(", za AS")[0]
    + " SELECT vec_id AS id, round(sum(x), 5) AS total, round(min(x), 5) AS lowest FROM xa GROUP BY 1",
)
def fgsm_inputs(spark, base):
    data = vectors(spark, base)
    moved = M.fgsm(data, M.centroid_model(data), 0.02)
    return moved.select(
        "id",
        F.round(F.aggregate("x_adv", F.lit(0.0), lambda a, v: a + v), 5).alias("total"),
        F.round(F.array_min("x_adv"), 5).alias("lowest"),
    )


@query("pgd_attack")
def pgd_attack(spark, base):
    data = vectors(spark, base)
    model = M.centroid_model(data)
    return M.attack_report(M.pgd(data, model, 0.02, 0.005), model, "pgd", 0.02)


@query("robustness_curve")
def robustness_curve(spark, base):
    data = vectors(spark, base)
    return M.robustness_curve(data, M.centroid_model(data))


@query("robustness_metrics")
def robustness_metrics(spark, base):
    data = vectors(spark, base)
    return S.evaluate_robustness(data, M.centroid_model(data), 0.05)[2]


@query(
    "uncertain_inputs",
    CENTROID_SQL
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC) AS rn FROM p),
        u AS (SELECT vec_id, max(p) - max(p) FILTER (WHERE rn = 2) AS mg, -sum(p * ln(greatest(p, 1e-12))) AS en FROM o GROUP BY 1),
        t AS (SELECT quantile_cont(en, 0.95) AS te, quantile_cont(mg, 0.05) AS tm FROM u)
        SELECT count(*)::BIGINT AS inputs, count(*) FILTER (WHERE en > te OR mg < tm)::BIGINT AS flagged,
          round(any_value(te), 6) AS entropy_limit, round(any_value(tm), 6) AS margin_limit FROM u, t""",
)
def uncertain_inputs(spark, base):
    data = vectors(spark, base)
    scored = M.with_probabilities(data, M.centroid_model(data))
    limits = M.detector_thresholds(scored)
    flagged = M.flag_inputs(scored, limits)
    return (
        flagged.agg(
            F.count(F.lit(1)).alias("inputs"), F.count_if("flagged").alias("flagged")
        )
        .join(F.broadcast(limits))
        .select(
            "inputs",
            "flagged",
            F.round("entropy_limit", 6).alias("entropy_limit"),
            F.round("margin_limit", 6).alias("margin_limit"),
        )
    )


@query(
    "squeezed_features",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
       q AS (SELECT vec_id, round_even(least(greatest((x - lo) / (hi - lo + 1e-12), 0), 1) * 15, 0) / 15 * (hi - lo) + lo AS v FROM x, m)
       SELECT vec_id AS id, round(sum(v), 6) AS total, count(DISTINCT round(v, 9))::BIGINT AS levels FROM q GROUP BY 1""",
)
def squeezed_features(spark, base):
    out = M.preprocess(vectors(spark, base))
    return out.select(
        "id",
        F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total"),
        F.size(F.array_distinct(F.transform("x", lambda v: F.round(v, 9))))
        .cast("bigint")
        .alias("levels"),
    )


@query(
    "clipped_features",
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
       r AS (SELECT i, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1)
       SELECT vec_id AS id, round(sum(least(greatest(x * 1.5, lo), hi)), 6) AS total FROM x JOIN r USING (i) GROUP BY 1""",
)
def clipped_features(spark, base):
    """All vectors, stretched by half, cut to the ranges seen in all of them as they were."""
    data = vectors(spark, base)
    stretched = data.withColumn("x", F.transform("x", lambda v: v * 1.5))
    out = M.preprocess(stretched, levels=None, ranges=M.feature_ranges(data))
    return out.select(
        "id", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total")
    )


@query(
    "poisoned_labels",
    "SELECT count(*)::BIGINT AS samples, floor(count(*) * 0.2)::BIGINT AS flipped, true AS in_range FROM embeddings",
)
def poisoned_labels(spark, base):
    data = vectors(spark, base)
    flipped = M.label_flip(data.withColumn("old", F.col("y")), 10, 0.2)
    return flipped.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("old") != F.col("y")).alias("flipped"),
        F.bool_and(F.col("y").between(0, 9)).alias("in_range"),
    )


@query("model_security_attacks")
def model_security_attacks(spark, base):
    train, test = _split(vectors(spark, base))
    return S.security_assessment(train, test, 10, epsilon=0.05)[0]


@query("model_security_report")
def model_security_report(spark, base):
    train, test = _split(vectors(spark, base))
    return S.security_assessment(train, test, 10, epsilon=0.05, gaps=2)[1]
