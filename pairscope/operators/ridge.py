"""Ridge regression with leave-one-cohort-out validation from Gram statistics.

One scan gives each cohort's count, sums and cross products; these add up, so every outer and inner fold and every alpha is
arithmetic on (features + 2) x (features + 2) matrices on the driver. Predictions and error metrics are JVM expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)


@dataclass(frozen=True)
class Gram:
    """n, sums and cross products of (features, target)."""

    n: float
    s: np.ndarray
    ss: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.n + other.n, self.s + other.s, self.ss + other.ss)


def gram_table(df: DataFrame, cohort: str, features: list[str], target: str) -> DataFrame:
    """One row a cohort: ``n``, ``s_i`` and ``ss_i_j`` (i <= j). Rows with a null or NaN anywhere are left out."""
    cols = [*features, target]
    values = [F.col(c).cast("double") for c in cols]
    whole = df.filter(F.col(cohort).isNotNull())
    for v in values:
        whole = whole.filter(v.isNotNull() & ~F.isnan(v))
    aggs = [F.sum(v).alias(f"s_{i}") for i, v in enumerate(values)]
    aggs += [F.sum(values[i] * values[j]).alias(f"ss_{i}_{j}") for i in range(len(values)) for j in range(i, len(values))]
    return whole.groupBy(F.col(cohort).cast("string").alias("cohort")).agg(F.count(F.lit(1)).alias("n"), *aggs)


def collect_grams(table: DataFrame, k: int) -> dict[str, Gram]:
    """The statistics on the driver: one small row a cohort."""
    out = {}
    for r in table.collect():
        ss = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                ss[i, j] = ss[j, i] = r[f"ss_{i}_{j}"]
        out[r["cohort"]] = Gram(float(r["n"]), np.array([r[f"s_{i}"] for i in range(k)], dtype=float), ss)
    return out


def solve(g: Gram, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and weights of ridge on standardised features (population deviation), unpenalised intercept."""
    p = len(g.s) - 1
    m = g.s / g.n
    c = g.ss / g.n - np.outer(m, m)
    sd = np.sqrt(np.maximum(np.diag(c)[:p], 0))
    sd[sd == 0] = 1.0
    a = c[:p, :p] * g.n / np.outer(sd, sd) + alpha * np.eye(p)
    w = np.linalg.solve(a, c[:p, p] * g.n / sd) / sd
    return float(m[p] - w @ m[:p]), w


def mean_squared_error(g: Gram, intercept: float, w: np.ndarray) -> float:
    v = np.r_[-w, 1.0]
    total = v @ g.ss @ v - 2 * intercept * (v @ g.s) + g.n * intercept**2
    return float(max(total, 0) / g.n)


def choose_alpha(grams: dict[str, Gram], alphas: tuple[float, ...] = ALPHAS, default: float = 1.0) -> float:
    """Alpha of least mean error over left-out cohorts, each cohort weighing the same; ties take the smaller, fewer than two cohorts the default."""
    if len(grams) < 2:
        return default
    scores = []
    for alpha in sorted(alphas):
        errors = []
        for held in sorted(grams):
            rest = [g for c, g in grams.items() if c != held]
            errors.append(mean_squared_error(grams[held], *solve(sum(rest[1:], rest[0]), alpha)))
        scores.append((float(np.mean(errors)), alpha))
    best = min(s for s, _ in scores)
    return min(a for s, a in scores if s <= best)


def assert_folds(df: DataFrame, splits: DataFrame, cohort: str, cluster: str = "participant_id") -> DataFrame:
    """Splits (cluster, ``fold_id``, ``role``) of which every fold holds out one whole cohort and trains on no row of it; raises otherwise.

    One aggregate: one row a fold. Every cluster of ``df`` must have one role in each fold.
    """
    held = F.col("role") != "train"
    joined = splits.join(df.select(cluster, F.col(cohort).cast("string").alias("_c")).distinct(), cluster)
    folds = joined.groupBy("fold_id").agg(
        F.count_distinct(F.when(held, F.col("_c"))).alias("held"), F.count_distinct(F.when(~held, F.col(cluster))).alias("trained"), F.count(F.lit(1)).alias("n"), F.count_distinct(cluster).alias("k"),
        F.max(F.when(held, F.col("_c"))).alias("out"), F.collect_set(F.when(~held, F.col("_c"))).alias("cohorts"),
    ).collect()
    clusters = df.select(cluster).distinct().count()
    for r in folds:
        if r.held != 1 or not r.trained or r.out in r.cohorts:
            raise ValueError(f"fold {r.fold_id} does not hold out one cohort")
        if r.n != r.k or r.k != clusters:
            raise ValueError(f"fold {r.fold_id} does not give every cluster one role")
    if not folds:
        raise ValueError("no folds")
    return splits


def assert_predicted_once(predictions: DataFrame, df: DataFrame, key: str = "pair_id") -> DataFrame:
    """Predictions of which every key of ``df`` has exactly one; raises otherwise."""
    got = predictions.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("k")).first()
    if got.n != got.k or df.select(key).distinct().join(predictions, key, "left_anti").limit(1).count() or got.k != df.select(key).distinct().count():
        raise ValueError("every row needs one prediction")
    return predictions


def leave_one_cohort_out(df: DataFrame, cohort: str, features: list[str], target: str, alphas: tuple[float, ...] = ALPHAS) -> tuple[DataFrame, DataFrame]:
    """(predictions, metrics). Each cohort is predicted by a model fitted and tuned on the others only.

    Predictions: the input columns with ``predicted``, ``alpha``. Metrics: cohort, n, mae, rmse, r2 (null without variance), pearson_r
    (null if either side is constant). Rows with null features or target have no prediction. Fewer than two cohorts give an empty result.
    """
    spark = df.sparkSession
    grams = collect_grams(gram_table(df, cohort, features, target), len(features) + 1)
    models = []
    if len(grams) > 1:
        for held in sorted(grams):
            rest = {c: g for c, g in grams.items() if c != held}
            alpha = choose_alpha(rest, alphas)
            values = list(rest.values())
            b, w = solve(sum(values[1:], values[0]), alpha)
            models.append((held, alpha, b, *map(float, w)))
    names = [f"_w{i}" for i in range(len(features))]
    schema = f"{cohort} string, alpha double, _b double" + "".join(f", {n} double" for n in names)
    table = F.broadcast(spark.createDataFrame(models, schema))  # one row a cohort
    predicted = sum((F.col(n) * F.col(f).cast("double") for n, f in zip(names, features)), F.col("_b"))
    rows = df.withColumn(cohort, F.col(cohort).cast("string")).join(table, cohort).withColumn("predicted", predicted).drop("_b", *names).filter(F.col("predicted").isNotNull() & F.col(target).isNotNull())
    y, e = F.col(target).cast("double"), F.col("predicted") - F.col(target).cast("double")
    metrics = rows.groupBy(cohort).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max("alpha").alias("alpha"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
        F.when(F.count(F.lit(1)) > 1, F.try_divide(F.covar_pop("predicted", y), F.stddev_pop("predicted") * F.stddev_pop(y))).alias("pearson_r"),
    )
    return rows, metrics
