"""How simple classifiers hold up against adversarial input.

A model is a weight matrix (features x classes) and a bias: a few kilobytes
that travel with the task. Rows are attacked and scored where they are, in
Arrow batches; only counts are shuffled. Training is Spark ML's logistic
regression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlattice.functions.scale import exact_quantiles, nth_smallest
from govlattice.session import bounded_rows

CURVE = (0.0, 0.02, 0.05, 0.1, 0.2, 0.3)
CURVE_ALPHA_RATIO, PGD_STEPS = 0.25, 10
MAX_CLASSES = 10_000


@dataclass(frozen=True)
class LinearModel:
    weights: np.ndarray
    bias: np.ndarray

    @property
    def classes(self) -> int:
        return self.weights.shape[1]


# -- numpy helpers that run inside the tasks ------------------------------------------


def _rows(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.float64)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _gradient(m: LinearModel, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope of the loss along the input: (p - onehot) W'."""
    p = _softmax(x @ m.weights + m.bias)
    p[np.arange(len(y)), y] -= 1.0
    return p @ m.weights.T


def _bounded(x: np.ndarray, clip: tuple[float, float] | None) -> np.ndarray:
    return x if clip is None else np.clip(x, *clip)


def _start(keys: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Uniform numbers in [-1, 1) per (row key, feature): a mixed counter, so a
    row starts at the same place in whatever partition it is."""
    with np.errstate(over="ignore"):
        z = (
            keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
            + np.arange(width, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9)
            + np.uint64(seed + 1) * np.uint64(0x94D049BB133111EB)
        )
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 52) - 1.0


def _pgd(m, x, y, keys, eps, alpha, steps, clip, seed) -> np.ndarray:
    adv = x + eps * _start(keys, x.shape[1], seed)
    for _ in range(steps):
        adv = adv + alpha * np.sign(_gradient(m, adv, y))
        adv = _bounded(np.clip(adv, x - eps, x + eps), clip)
    return adv


# -- models --------------------------------------------------------------------------


def fit_linear(
    df: DataFrame, features: str = "x", label: str = "y", epochs: int = 100, reg: float = 0.0
) -> LinearModel:
    """Multinomial logistic regression by Spark ML; labels 0..k-1."""
    data = df.select(
        array_to_vector(F.col(features).cast("array<double>")).alias("features"),
        F.col(label).cast("double").alias("label"),
    )
    fitted = LogisticRegression(maxIter=epochs, regParam=reg, family="multinomial").fit(data)
    return LinearModel(
        fitted.coefficientMatrix.toArray().T.copy(), fitted.interceptVector.toArray().copy()
    )


def centroid_model(df: DataFrame, features: str = "x", label: str = "y") -> LinearModel:
    """Class means as weights: a model that needs one aggregation."""
    means = (
        df.select(F.col(label).cast("int").alias("y"), F.posexplode(features).alias("i", "v"))
        .groupBy("y", "i")
        .agg(F.avg(F.col("v").cast("double")).alias("m"))
        .groupBy("y")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(
                "m"
            )
        )
    )
    rows = sorted(bounded_rows(means, MAX_CLASSES, "classes"), key=lambda r: r["y"])
    weights = np.array([r["m"] for r in rows]).T
    return LinearModel(weights, np.zeros(weights.shape[1]))


def with_probabilities(
    df: DataFrame, model: LinearModel, features: str = "x", prefix: str = ""
) -> DataFrame:
    """Add ``proba`` and ``predicted``."""

    def proba(x: pd.Series) -> pd.Series:
        return pd.Series(list(_softmax(_rows(x) @ model.weights + model.bias)))

    p = f"{prefix}proba"
    out = df.withColumn(
        p, F.pandas_udf(proba, "array<double>")(F.col(features).cast("array<double>"))
    )
    best = F.array_position(p, F.array_max(p)) - 1
    return out.withColumn(f"{prefix}predicted", best.cast("int"))


def softmax(z: Column) -> Column:
    """Class probabilities of an array of scores."""
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def entropy(proba: Column) -> Column:
    def term(p: Column) -> Column:
        q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0))
        return q * F.log(q)

    return -F.aggregate(proba, F.lit(0.0), lambda a, p: a + term(p))


def margin(proba: Column) -> Column:
    top = F.sort_array(proba, asc=False)
    return F.get(top, F.lit(0)) - F.get(top, F.lit(1))


# -- attacks -------------------------------------------------------------------------


def fgsm(
    df: DataFrame,
    model: LinearModel,
    epsilon: float = 0.1,
    features: str = "x",
    label: str = "y",
    clip: tuple[float, float] | None = None,
    name: str = "x_adv",
) -> DataFrame:
    """Add inputs moved by epsilon along the sign of the gradient."""

    def move(x: pd.Series, y: pd.Series) -> pd.Series:
        at = _rows(x)
        step = epsilon * np.sign(_gradient(model, at, y.to_numpy(dtype=np.int64)))
        return pd.Series(list(_bounded(at + step, clip)))

    udf = F.pandas_udf(move, "array<double>")
    return df.withColumn(
        name, udf(F.col(features).cast("array<double>"), F.col(label).cast("bigint"))
    )


def pgd(
    df: DataFrame,
    model: LinearModel,
    epsilon: float = 0.1,
    alpha: float = 0.02,
    steps: int = PGD_STEPS,
    key: str = "id",
    features: str = "x",
    label: str = "y",
    clip: tuple[float, float] | None = None,
    seed: int = 0,
    name: str = "x_adv",
) -> DataFrame:
    """Add inputs moved by repeated small steps inside the epsilon ball."""

    def move(x: pd.Series, y: pd.Series, k: pd.Series) -> pd.Series:
        adv = _pgd(
            model,
            _rows(x),
            y.to_numpy(dtype=np.int64),
            k.to_numpy(dtype=np.int64),
            epsilon,
            alpha,
            steps,
            clip,
            seed,
        )
        return pd.Series(list(adv))

    udf = F.pandas_udf(move, "array<double>")
    return df.withColumn(
        name,
        udf(
            F.col(features).cast("array<double>"),
            F.col(label).cast("bigint"),
            F.xxhash64(F.col(key)) if key else F.lit(0).cast("bigint"),
        ),
    )


def attack_report(
    attacked: DataFrame,
    model: LinearModel,
    attack: str,
    epsilon: float | None = None,
    features: str = "x",
    adversarial: str = "x_adv",
    label: str = "y",
) -> DataFrame:
    """Clean and adversarial accuracy, drop, share of correct rows that were flipped."""
    scored = with_probabilities(attacked, model, features, "_c_")
    scored = with_probabilities(scored, model, adversarial, "_a_")
    clean = F.col("_c_predicted") == F.col(label)
    adv = F.col("_a_predicted") == F.col(label)
    n = F.count(F.lit(1))
    counts = scored.agg(
        n.alias("samples"),
        F.count_if(clean).alias("_c"),
        F.count_if(adv).alias("_a"),
        F.count_if(clean & ~adv).alias("_f"),
    )
    rate_c, rate_a = F.col("_c") / F.col("samples"), F.col("_a") / F.col("samples")
    return counts.select(
        F.lit(attack).alias("attack"),
        F.lit(epsilon).cast("double").alias("epsilon"),
        F.round(rate_c, 4).alias("clean_accuracy"),
        F.round(rate_a, 4).alias("adversarial_accuracy"),
        F.round(rate_c - rate_a, 4).alias("accuracy_drop"),
        F.round(F.col("_f") / F.greatest(F.col("_c"), F.lit(1)), 4).alias("success_rate"),
        "samples",
    )


def robustness_curve(
    df: DataFrame,
    model: LinearModel,
    epsilons: tuple[float, ...] = CURVE,
    key: str = "id",
    features: str = "x",
    label: str = "y",
    seed: int = 0,
) -> DataFrame:
    """Accuracy under attack per epsilon.

    A row is attacked with all strengths in one visit and gives one flag per
    strength: rows are not multiplied by the strengths.
    """

    def survives(x: pd.Series, y: pd.Series, k: pd.Series) -> pd.Series:
        at, labels = _rows(x), y.to_numpy(dtype=np.int64)
        keys = k.to_numpy(dtype=np.int64)
        flags = []
        for eps in epsilons:
            adv = at
            if eps:
                adv = _pgd(
                    model, at, labels, keys, eps, eps * CURVE_ALPHA_RATIO, PGD_STEPS, None, seed
                )
            flags.append((adv @ model.weights + model.bias).argmax(axis=1) == labels)
        return pd.Series(list(np.stack(flags, axis=1)))

    udf = F.pandas_udf(survives, "array<boolean>")
    flags = df.select(
        udf(
            F.col(features).cast("array<double>"),
            F.col(label).cast("bigint"),
            F.xxhash64(F.col(key)),
        ).alias("_f")
    )
    # One pass, one row of sums; then one row per strength.
    sums = flags.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.get("_f", F.lit(i))).alias(f"_s{i}") for i in range(len(epsilons))],
    )
    points = F.array(
        *[
            F.struct(
                F.lit(round(float(e), 4)).alias("epsilon"),
                F.round(F.col(f"_s{i}") / F.col("_n"), 4).alias("adversarial_accuracy"),
            )
            for i, e in enumerate(epsilons)
        ]
    )
    return sums.select(F.inline(points))


def min_perturbation_budget(curve: DataFrame, target: Column) -> DataFrame:
    """Smallest epsilon at which accuracy falls to the target; NULL if none does."""
    return curve.agg(
        F.min(F.when(F.col("adversarial_accuracy") <= target, F.col("epsilon"))).alias(
            "min_perturbation_budget"
        )
    )


def robustness_risk(clean: Column, robust: Column) -> Column:
    drop = clean - robust
    return (
        F.when((robust < 0.25) | (drop > 0.6), "critical")
        .when((robust < 0.5) | (drop > 0.4), "high")
        .when(drop > 0.15, "medium")
        .otherwise("low")
    )


def label_flip(
    df: DataFrame, classes: int, rate: float = 0.2, key: str = "id", label: str = "y", seed: int = 0
) -> DataFrame:
    """Change the label of exactly floor(n * rate) rows, chosen by a hash of the key."""
    drawn = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    n = int(df.count() * rate)
    if n == 0:
        return df
    # One row: the hash of the n-th chosen row.
    cut = F.broadcast(nth_smallest(drawn, "_h", n))
    shift = 1 + F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(max(classes - 1, 1)))
    flipped = F.pmod(F.col(label) + shift, F.lit(classes)).cast("int")
    chosen = F.col("_h") <= F.col("threshold")
    return (
        drawn.join(cut)
        .withColumn(label, F.when(chosen, flipped).otherwise(F.col(label).cast("int")))
        .drop("_h", "threshold")
    )


def _accuracy(df: DataFrame, model: LinearModel, features: str, label: str) -> float:
    scored = with_probabilities(df.select(features, label), model, features)
    row = scored.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("a"))
    return float(row.collect()[0]["a"] or 0.0)


def poisoning_report(
    train: DataFrame,
    test: DataFrame,
    classes: int,
    rate: float = 0.2,
    key: str = "id",
    features: str = "x",
    label: str = "y",
    seed: int = 0,
) -> dict:
    """Accuracy lost by retraining on flipped labels."""
    clean = _accuracy(test, fit_linear(train, features, label), features, label)
    poisoned_model = fit_linear(label_flip(train, classes, rate, key, label, seed), features, label)
    poisoned = _accuracy(test, poisoned_model, features, label)
    return {
        "attack": "poisoning",
        "epsilon": None,
        "clean_accuracy": round(clean, 4),
        "adversarial_accuracy": round(poisoned, 4),
        "accuracy_drop": round(clean - poisoned, 4),
        "success_rate": round(max(clean - poisoned, 0.0) / max(rate, 1e-9), 4),
    }


def extraction_report(
    target: LinearModel,
    queries: DataFrame,
    test: DataFrame,
    features: str = "x",
    label: str = "y",
) -> dict:
    """Train a copy on the target's answers; how often do both agree?"""
    answered = with_probabilities(queries.select(features), target, features)
    copy = fit_linear(answered, features, "predicted")
    both = with_probabilities(
        with_probabilities(test.select(features, label), target, features, "t_"),
        copy,
        features,
        "s_",
    )
    row = both.agg(
        F.avg((F.col("t_predicted") == F.col("s_predicted")).cast("double")).alias("f"),
        F.avg((F.col("t_predicted") == F.col(label)).cast("double")).alias("t"),
        F.avg((F.col("s_predicted") == F.col(label)).cast("double")).alias("s"),
    ).collect()[0]
    return {
        "attack": "extraction",
        "epsilon": None,
        "clean_accuracy": round(row["t"], 4),
        "adversarial_accuracy": round(row["s"], 4),
        "accuracy_drop": round(row["t"] - row["s"], 4),
        "success_rate": round(row["f"], 4),
    }


# -- defences -------------------------------------------------------------------------


def clip_to_range(x: Column, low: Column, high: Column) -> Column:
    """Each feature cut to its own range."""
    raised = F.zip_with(x, low, lambda a, b: F.greatest(a.cast("double"), b.cast("double")))
    return F.zip_with(raised, high, lambda a, b: F.least(a, b.cast("double")))


def feature_squeezing(x: Column, levels: int, low: Column | float, high: Column | float) -> Column:
    """Each feature rounded (half to even) to one of ``levels`` steps between low and high."""
    lo = F.lit(low) if not isinstance(low, Column) else low
    hi = F.lit(high) if not isinstance(high, Column) else high

    def squeeze(v: Column) -> Column:
        unit = F.least(
            F.greatest((v.cast("double") - lo) / (hi - lo + 1e-12), F.lit(0.0)), F.lit(1.0)
        )
        return F.rint(unit * (levels - 1)) / (levels - 1) * (hi - lo) + lo

    return F.transform(x, squeeze)


def feature_ranges(df: DataFrame, features: str = "x") -> DataFrame:
    """One row: smallest and largest value of every feature."""
    per = (
        df.select(F.posexplode(features).alias("i", "v"))
        .groupBy("i")
        .agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    )
    rows = F.array_sort(F.collect_list(F.struct("i", "lo", "hi")))
    return per.agg(
        F.transform(rows, lambda r: r["lo"]).alias("feature_min"),
        F.transform(rows, lambda r: r["hi"]).alias("feature_max"),
    )


def preprocess(
    df: DataFrame,
    features: str = "x",
    levels: int | None = 16,
    ranges: DataFrame | None = None,
    name: str = "x",
) -> DataFrame:
    """Clip and squeeze inputs; without ranges the batch's own limits are used."""
    x = F.col(features)
    if ranges is not None:
        joined = df.join(F.broadcast(ranges))
        x = clip_to_range(x, F.col("feature_min"), F.col("feature_max"))
        lo, hi = F.array_min("feature_min"), F.array_max("feature_max")
    else:
        limits = df.agg(
            F.min(F.array_min(features)).cast("double").alias("_lo"),
            F.max(F.array_max(features)).cast("double").alias("_hi"),
        )
        joined = df.join(F.broadcast(limits))
        lo, hi = F.col("_lo"), F.col("_hi")
    out = joined.withColumn(name, x)
    if levels:
        out = out.withColumn(name, feature_squeezing(F.col(name), levels, lo, hi))
    return out.drop("feature_min", "feature_max", "_lo", "_hi")


def detector_thresholds(
    clean: DataFrame, proba: str = "proba", entropy_q: float = 0.95, margin_q: float = 0.05
) -> DataFrame:
    """One row with the entropy and margin limits of clean inputs."""
    stats = clean.select(entropy(F.col(proba)).alias("e"), margin(F.col(proba)).alias("m"))
    high = exact_quantiles(stats, "e", {"entropy_limit": entropy_q})
    low = exact_quantiles(stats, "m", {"margin_limit": margin_q})
    return high.join(F.broadcast(low))


def flag_inputs(scored: DataFrame, thresholds: DataFrame, proba: str = "proba") -> DataFrame:
    """Add ``flagged``: more uncertain than clean inputs usually are."""
    joined = scored.join(F.broadcast(thresholds))
    flag = (entropy(F.col(proba)) > F.col("entropy_limit")) | (
        margin(F.col(proba)) < F.col("margin_limit")
    )
    return joined.withColumn("flagged", flag).drop("entropy_limit", "margin_limit")


def adversarial_training(
    train: DataFrame,
    epsilon: float = 0.1,
    alpha: float = 0.02,
    rounds: int = 2,
    key: str = "id",
    features: str = "x",
    label: str = "y",
    seed: int = 0,
) -> LinearModel:
    """Retrain on clean and attacked rows, half and half, a few rounds."""
    model = fit_linear(train, features, label)
    base = train.select(key, features, label)
    for r in range(rounds):
        moved = pgd(base, model, epsilon, alpha, 5, key, features, label, seed=seed + r)
        attacked = moved.select(key, F.col("x_adv").alias(features), label)
        plain = base.withColumn(features, F.col(features).cast("array<double>"))
        model = fit_linear(plain.unionByName(attacked), features, label)
    return model
