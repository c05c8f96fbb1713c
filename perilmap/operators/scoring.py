"""Weighted scores of coupling and transition, and their sensitivity to the weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS, BASELINE, TOP = 10, 0.5, 15


def join_risks(couplings: DataFrame, paths: DataFrame) -> DataFrame:
    """(order, factor_code, coupling_t, transition_prob): pairs and triples that have both.

    A path of two or three known codes meets the subset of the same codes; both are keyed by
    their sorted codes. ``couplings``: (factors, t_value); ``paths``: (codes, prob).
    """
    left = couplings.select(F.array_sort("factors").alias("key"), "t_value")
    right = paths.filter(F.size("codes").between(2, 3) & ~F.array_contains("codes", F.lit("UNK"))).select(F.array_sort("codes").alias("key"), F.array_join("codes", " ").alias("factor_code"), "prob")
    return right.join(left, "key").select(F.size("key").alias("order"), "factor_code", F.col("t_value").alias("coupling_t"), F.col("prob").alias("transition_prob"))


def weighted(t: Column, p: Column, alpha: Column, beta: Column) -> Column:
    return alpha * t + beta * p


def alpha_grid(scores: DataFrame, steps: int = STEPS) -> DataFrame:
    """Each row once for each weight 0, 1/steps .. 1, with ``alpha`` and ``score``."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    out = scores.select("*", grid.alias("_i"))
    alpha, beta = F.col("_i") / F.lit(float(steps)), (F.lit(steps) - F.col("_i")) / F.lit(float(steps))
    return out.withColumn("alpha", alpha).withColumn("score", weighted(F.col("coupling_t"), F.col("transition_prob"), alpha, beta)).drop("_i")


def top_by_alpha(swept: DataFrame, n: int = TOP) -> DataFrame:
    """Of each weight the ``n`` best rows; NaN and null left out, ties by code."""
    order = Window.partitionBy("alpha").orderBy(F.desc("score"), "factor_code")
    fine = swept.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return fine.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def overlap_with_baseline(top: DataFrame, baseline: float = BASELINE) -> DataFrame:
    """(alpha, overlap): how many codes each weight's best share with the baseline's."""
    base = top.filter(F.col("alpha") == baseline).select("factor_code").distinct().withColumn("hit", F.lit(1))
    codes = top.select("alpha", "factor_code").distinct()
    return codes.join(base, "factor_code", "left").groupBy("alpha").agg(F.count("hit").alias("overlap"))


def baseline_rows(scores: DataFrame, n: int = TOP, baseline: float = BASELINE) -> DataFrame:
    """The ``n`` best rows at the baseline weight."""
    score = weighted(F.col("coupling_t"), F.col("transition_prob"), F.lit(baseline), F.lit(1 - baseline))
    return scores.withColumn("_b", score).filter(F.col("_b").isNotNull() & ~F.isnan("_b")).orderBy(F.desc("_b"), "factor_code").limit(n).drop("_b")


def ceiling(swept: DataFrame, headroom: float = 1.1) -> DataFrame:
    """One row: the largest score or coupling, with headroom."""
    return swept.agg((F.max(F.greatest("score", "coupling_t")) * headroom).alias("ceiling"))


def model_compare(scores: DataFrame, n: int = TOP) -> DataFrame:
    """The first ``n`` rows of each order in file order (``row_pos``): coupling and weighted result side by side."""
    return scores.filter(F.col("row_pos") <= n).select("order", "row_pos", "factor_code", "coupling_t", "score")
