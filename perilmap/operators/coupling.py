"""Multi-information ("coupling") of factor subsets, in bits.

``T(S) = sum over states p * log2(p / product of the factors' marginals)``. Cases are first
reduced to their distinct masks, at most 2 ** factors rows however many cases there are. The
number of cases in any state of a subset follows from the numbers that hold each of its sets of
factors by inclusion and exclusion, exactly, as they are integers.

The counts of all 2 ** factors sets come from a zeta transform: one step for each factor adds the
counts of the masks that hold it to those that don't. All subsets of an order are then rows of
one array.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import Taxonomy
from .encode import bit_string

MAIN_EPS, SUB_EPS = 1e-10, 1e-12
#: Factors of a lattice whose 2 ** factors counts one task holds (8 MB).
MOST_FACTORS = 20


def states(masks: DataFrame) -> DataFrame:
    """(mask, n): how many cases have each mask."""
    return masks.groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


def joint_distribution(states_: DataFrame, size: int) -> DataFrame:
    """(code, mask, n, p) of all 2 ** size masks, those that no case has with 0."""
    spark = states_.sparkSession
    total = states_.agg(F.sum("n").alias("total")).withColumn("one", F.lit(1))
    every = spark.range(1 << size).select(F.col("id").alias("mask"))
    out = every.join(F.broadcast(states_), "mask", "left").withColumn("one", F.lit(1)).join(F.broadcast(total), "one", "left")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return out.select(bit_string(F.col("mask"), size).alias("code"), "mask", n.alias("n"), F.coalesce(F.try_divide(n.cast("double"), F.col("total").cast("double")), F.lit(0.0)).alias("p"))


def factor_counts(states_: DataFrame, size: int) -> DataFrame:
    """One row: the number of cases, and an array with the number that have each factor."""
    has = lambda k: F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << k).cast("bigint")) != 0, F.col("n")).otherwise(F.lit(0)))
    return states_.agg(F.sum("n").alias("total"), F.array(*[F.coalesce(has(k), F.lit(0)) for k in range(size)]).alias("ones"))


def marginals(states_: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """(factor, state, p): each factor's probability of being present and absent."""
    size = len(taxonomy.codes)
    one = factor_counts(states_, size)
    p1 = lambda k: F.try_divide(F.col("ones")[k].cast("double"), F.col("total").cast("double"))
    p0 = lambda k: F.try_divide((F.col("total") - F.col("ones")[k]).cast("double"), F.col("total").cast("double"))
    rows = [F.struct(F.lit(c).alias("factor"), F.lit(s).cast("bigint").alias("state"), F.coalesce(p(k), F.lit(0.0)).alias("p")) for k, c in enumerate(taxonomy.codes) for s, p in ((0, p0), (1, p1))]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.factor", "r.state", "r.p")


def superset_counts(masks: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """For each set of factors, how many cases hold all of it: a zeta transform, a step for each factor."""
    out = np.zeros(1 << size, dtype=np.int64)
    np.add.at(out, masks, n)
    for k in range(size):
        halves = out.reshape(-1, 2, 1 << k)
        halves[:, 0] += halves[:, 1]
    return out


def lattice_values(holding: np.ndarray, size: int, order: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(subset, coupling) of all subsets of one order."""
    bits = 1 << np.array(list(combinations(range(size), order)), dtype=np.int64)
    inside = np.array([[p >> k & 1 for k in range(order)] for p in range(1 << order)], dtype=np.int64)
    counts = holding[bits @ inside.T]  # by the factors that a case must hold
    total = float(holding[0])
    for k in range(order):  # and holds no others of the subset
        halves = counts.reshape(len(bits), -1, 2, 1 << k)
        halves[:, :, 0] -= halves[:, :, 1]
    ones = holding[bits]
    q = np.ones(counts.shape)
    for k in range(order):
        q *= np.where(inside[:, k] == 1, ones[:, k, None] / total, (holding[0] - ones[:, k, None]) / total)
    p = counts / total
    fine = (p > eps) & (q > eps)
    terms = np.where(fine, p * np.log2(np.where(fine, p, 1.0) / np.where(fine, q, 1.0)), 0.0)
    return bits.sum(axis=1), terms.sum(axis=1)


def couplings(states_: DataFrame, taxonomy: Taxonomy, orders: tuple[int, ...], eps: float) -> DataFrame:
    """(order, subset, factors, t_value) of every subset of these orders; no rows for no cases.

    States with p, or a product of marginals, of at most ``eps`` add nothing. The distinct
    masks, 2 ** factors rows at most, are the whole input of one task.
    """
    codes = taxonomy.codes
    if len(codes) > MOST_FACTORS:
        raise ValueError(f"at most {MOST_FACTORS} factors")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([pd.DataFrame({"mask": [], "n": []}, dtype="int64"), *batches])
        if not held["n"].sum():
            return
        holding = superset_counts(held["mask"].to_numpy(), held["n"].to_numpy(), len(codes))
        for order in orders:
            subset, t = lattice_values(holding, len(codes), order, eps)
            yield pd.DataFrame({"order": order, "subset": subset, "factors": [[c for k, c in enumerate(codes) if s >> k & 1] for s in subset.tolist()], "t_value": t})

    return states_.select("mask", "n").repartition(1).mapInPandas(run, "order int, subset long, factors array<string>, t_value double")


def main_couplings(states_: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """All subsets of the main factors (63 of six)."""
    return couplings(states_, taxonomy, tuple(range(1, len(taxonomy.codes) + 1)), MAIN_EPS)


def sub_couplings(states_: DataFrame, taxonomy: Taxonomy, least: float = 1e-6) -> DataFrame:
    """Pairs and triples of the sub-factors (816 of 17) whose coupling exceeds ``least``."""
    return couplings(states_, taxonomy, (2, 3), SUB_EPS).filter(F.col("t_value") > least)


def ranked(couplings_: DataFrame, top: int | None = None) -> DataFrame:
    """By coupling, then order, then factors; with ``top`` the first so many."""
    out = couplings_.orderBy(F.desc("t_value"), "order", "factors")
    return out.limit(top) if top else out
