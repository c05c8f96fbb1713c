"""Transition probabilities between classes and the most probable bounded paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edge_counts(edges: DataFrame, relation: str | None = "LEADS_TO") -> DataFrame:
    """(source, target, cnt) of edges (head, tail[, relation])."""
    if relation is not None:
        edges = edges.filter(F.col("relation") == relation)
    return edges.groupBy(F.col("head").alias("source"), F.col("tail").alias("target")).agg(F.count(F.lit(1)).alias("cnt"))


def classified_frequency(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """(s, t, cnt) after both ends are replaced by their classes; ends without one are skipped.

    ``classes``: (name, cls), one row for each distinct name, so a name is classified once.
    """
    one, two = classes.select(F.col("name").alias("source"), F.col("cls").alias("s")), classes.select(F.col("name").alias("target"), F.col("cls").alias("t"))
    return counts.join(one, "source").join(two, "target").filter("s IS NOT NULL AND t IS NOT NULL").groupBy("s", "t").agg(F.sum("cnt").alias("cnt"))


def transition_probabilities(frequency: DataFrame) -> DataFrame:
    """(s, t, cnt, p): the share of each edge in what leaves its source, self loops included.

    The totals are a plain aggregate joined back, so a source with very many targets is
    summed within each task first and none is sorted in a window.
    """
    totals = frequency.groupBy("s").agg(F.sum("cnt").alias("total")).filter("total > 0")
    return frequency.join(totals, "s").select("s", "t", "cnt", (F.col("cnt").cast("double") / F.col("total").cast("double")).alias("p"))


def strongest_successors(frequency: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent targets of each source, by count, then name."""
    order = Window.partitionBy("s").orderBy(F.desc("cnt"), "t")
    return frequency.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def _moves(transitions: DataFrame) -> DataFrame:
    """(_s, _t, _p): the edges between different nodes. Every hop joins them by ``_s``, so Spark shuffles them once."""
    return transitions.filter("p > 0 AND s <> t").select(F.col("s").alias("_s"), F.col("t").alias("_t"), F.col("p").alias("_p"))


def simple_paths(transitions: DataFrame, hops: int = 4) -> DataFrame:
    """(nodes, prob) of every path without a repeated node and of 1 to ``hops`` edges.

    The product runs left to right from 1. Each hop extends the paths of the hop before.
    """
    move = _moves(transitions)
    now = move.select(F.array("_s", "_t").alias("nodes"), F.col("_t").alias("last"), (F.lit(1.0) * F.col("_p")).alias("prob"))
    out = now
    for _ in range(hops - 1):
        longer = now.join(move, (F.col("last") == F.col("_s")) & ~F.array_contains("nodes", F.col("_t")))
        now = longer.select(F.array_append("nodes", F.col("_t")).alias("nodes"), F.col("_t").alias("last"), (F.col("prob") * F.col("_p")).alias("prob"))
        out = out.unionByName(now)
    return out.drop("last")


def best_paths(transitions: DataFrame, hops: int = 4, include_sinks: bool = False) -> DataFrame:
    """(start_node, end_node, nodes, max_path, prob): the best path of each pair that has one.

    Ends are nodes with an outgoing edge, unless ``include_sinks``. Equal products go to the
    shorter path, then to the smaller text. After each hop one path is left of each pair, so
    work grows with pairs times edges of a node, not with the number of paths. That is enough:
    the best of ``hops`` edges extends a best one of fewer, and as no probability exceeds 1, a
    path that repeats a node is never better than the same one without the loop.
    """
    move = _moves(transitions)
    first = F.struct((-F.col("_p")).alias("minus"), F.lit(2).alias("n"), F.concat("_s", F.lit(" -> "), "_t").alias("path"), F.array("_s", "_t").alias("nodes"))
    now = move.select(F.col("_s").alias("start_node"), F.col("_t").alias("end_node"), first.alias("b"))
    for _ in range(hops - 1):
        joined = now.join(move, F.col("end_node") == F.col("_s"), "left")
        fits = F.coalesce(F.col("start_node") != F.col("_t"), F.lit(False))
        longer = F.struct((F.col("b.minus") * F.col("_p")).alias("minus"), (F.col("b.n") + 1).alias("n"), F.concat("b.path", F.lit(" -> "), "_t").alias("path"), F.array_append("b.nodes", F.col("_t")).alias("nodes"))
        # Each row gives the path as it was and, where an edge leads on, the longer one.
        stays = F.struct(F.col("end_node"), F.col("b"))
        both = F.when(fits, F.array(stays, F.struct(F.col("_t").alias("end_node"), longer.alias("b")))).otherwise(F.array(stays))
        now = joined.select("start_node", F.explode(both).alias("x")).groupBy("start_node", F.col("x.end_node").alias("end_node")).agg(F.min("x.b").alias("b"))
    if not include_sinks:
        now = now.join(transitions.filter("p > 0").select(F.col("s").alias("end_node")).distinct(), "end_node", "left_semi")
    return now.select("start_node", "end_node", F.col("b.nodes").alias("nodes"), F.col("b.path").alias("max_path"), (-F.col("b.minus")).alias("prob"))


def walks(transitions: DataFrame, hops: int = 4) -> DataFrame:
    """(start_node, end_node, nodes, prob) of every walk of 1 to ``hops`` edges that ends on its first arrival.

    Nodes and self loops may be passed again, but not the end; ends are nodes with an outgoing edge.
    By a recursive query, whose rows Spark bounds by ``spark.sql.cteRecursionRowLimit``: their
    number grows with a power of a node's edges, so this is for graphs of classes, not of names.
    """
    edges = transitions.filter("p > 0").select("s", "t", "p")
    every = edges.sparkSession.sql(
        f"""WITH RECURSIVE e AS (SELECT * FROM {{edges}}), w (nodes, last, prob, hop) AS (
        SELECT array(s, t), t, CAST(1.0 AS DOUBLE) * p, 1 FROM e UNION ALL
        SELECT array_append(nodes, e.t), e.t, prob * e.p, hop + 1 FROM w JOIN e ON w.last = e.s WHERE hop < {int(hops)})
        SELECT nodes[0] AS start_node, last AS end_node, nodes, prob FROM w WHERE array_position(nodes, last) = size(nodes)""",
        edges=edges,
    )
    return every.join(edges.select(F.col("s").alias("end_node")).distinct(), "end_node", "left_semi").select("start_node", "end_node", "nodes", "prob")


def top_paths(paths: DataFrame, n: int = 5) -> DataFrame:
    return paths.orderBy(F.desc("prob"), F.size("nodes"), "max_path").limit(n)


def nested_json(frequency: DataFrame, value: str = "cnt") -> DataFrame:
    """(s, targets): each source's targets and values as one JSON object."""
    entries = F.sort_array(F.collect_list(F.struct("t", value)))
    return frequency.groupBy("s").agg(F.to_json(F.map_from_entries(entries)).alias("targets"))
