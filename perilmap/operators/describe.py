"""Frequencies of factors, their shares, and the tables behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.taxonomy import parent_code


def factor_frequency(labels: DataFrame) -> DataFrame:
    """(code, mentions, cases) of labels (case_id, code)."""
    return labels.groupBy("code").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("case_id").alias("cases"))


def parent_share(counts: DataFrame) -> DataFrame:
    """(code, parent, mentions, share): percent of the parent's mentions, one decimal."""
    named = counts.select("code", parent_code(F.col("code")).alias("parent"), "mentions")
    totals = named.groupBy("parent").agg(F.sum("mentions").alias("total"))
    share = F.round(F.try_divide(F.col("mentions").cast("double") * 100, F.col("total").cast("double")), 1)
    return named.join(totals, "parent").select("code", "parent", "mentions", share.alias("share"))


def row_counts(**frames: DataFrame) -> DataFrame:
    """(name, n) of each frame."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def hierarchy(labels: DataFrame) -> DataFrame:
    """(level, parent, code, mentions, cases, share) of labels (case_id, code): sub-factors, their parents and all.

    ``level`` is 0 for a sub-factor, 1 for a parent (no code) and 3 for all (neither). A case counts
    once at each level; ``share`` is the percent of the level above, one decimal, null for all
    and where that is 0. Repeats of a code within a case are added up before the levels are made.
    """
    once = labels.filter("code IS NOT NULL").groupBy("case_id", "code").agg(F.count(F.lit(1)).alias("n"))
    # A case's codes become one row, so each level counts its cases without a distinct key for each case and level in a task's memory.
    cases = once.groupBy("case_id").agg(F.collect_list(F.struct(parent_code(F.col("code")).alias("parent"), "code", "n")).alias("xs"))
    added = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda t, x: t + x["n"])
    entry = lambda level, parent, code, n: F.struct(F.lit(level).alias("level"), parent.alias("parent"), code.alias("code"), n.alias("n"))
    none, parents = F.lit(None).cast("string"), F.array_distinct(F.transform("xs", lambda x: x["parent"]))
    levels = F.concat(
        F.transform("xs", lambda x: entry(0, x["parent"], x["code"], x["n"])),
        F.transform(parents, lambda p: entry(1, p, none, added(F.filter("xs", lambda x: x["parent"].eqNullSafe(p))))),
        F.array(entry(3, none, none, added(F.col("xs")))),
    )
    rows = cases.select("case_id", F.explode(levels).alias("l")).groupBy("l.level", "l.parent", "l.code").agg(F.sum("l.n").alias("mentions"), F.count("case_id").alias("cases"))
    # A row for each sub-factor and parent: the windows see the taxonomy, not the cases.
    of = lambda level, w: F.max(F.when(F.col("level") == level, F.col("mentions"))).over(w)
    above = F.when(F.col("level") == 0, of(1, Window.partitionBy("parent"))).when(F.col("level") == 1, of(3, Window.partitionBy()))
    share = F.round(F.try_divide(F.col("mentions").cast("double") * 100, above.cast("double")), 1)
    return rows.select("level", "parent", "code", "mentions", "cases", share.alias("share"))


def nested_pie(levels: DataFrame) -> DataFrame:
    """(ring, name, parent, value, label) of ``hierarchy``: parents inside, sub-factors outside with their percent of the parent."""
    outer = F.col("level") == 0
    return levels.filter("level < 3").select(
        F.when(outer, "outer").otherwise("inner").alias("ring"), F.coalesce("code", "parent").alias("name"), "parent", F.col("mentions").alias("value"),
        F.when(outer, F.concat(F.format_string("%.1f", "share"), F.lit("%"))).otherwise("").alias("label"),
    )


def overlap_line(overlaps: DataFrame) -> DataFrame:
    """(alpha, beta, overlap, is_baseline) of the line over both weights' axes; weights rounded to one decimal."""
    alpha = F.round("alpha", 1)
    return overlaps.select(alpha.alias("alpha"), F.round(1 - F.col("alpha"), 1).alias("beta"), "overlap", (alpha == 0.5).alias("is_baseline"))


def score_panels(swept: DataFrame, columns: int = 3, headroom: float = 1.1) -> DataFrame:
    """(panel, grid_row, grid_column, alpha, beta, x, factor_code, coupling_t, score, y_limit): a panel for each weight of a grid.

    ``x`` is a path's place by the baseline score, the same in all panels; all share one axis limit.
    """
    base = F.lit(0.5) * F.col("coupling_t") + F.lit(0.5) * F.col("transition_prob")
    x = F.row_number().over(Window.partitionBy("alpha").orderBy(base.desc(), "factor_code"))
    panel = (F.dense_rank().over(Window.orderBy("alpha")) - 1).cast("int")
    limit = F.max(F.greatest("score", "coupling_t")).over(Window.partitionBy()) * headroom
    placed = swept.select("*", x.alias("x"), panel.alias("panel"), limit.alias("y_limit"))
    return placed.select("panel", F.floor(F.col("panel") / columns).cast("int").alias("grid_row"), (F.col("panel") % columns).alias("grid_column"), F.round("alpha", 1).alias("alpha"), F.round(1 - F.col("alpha"), 1).alias("beta"), "x", "factor_code", "coupling_t", "score", "y_limit")
