import itertools
import random

import numpy as np
import pytest

from perilmap.operators import describe, scoring, transitions

EDGES = [("A", "B", 3), ("A", "C", 1), ("B", "C", 2), ("B", "B", 2), ("C", "A", 1), ("C", "D", 1)]


def frequency(spark, edges):
    return spark.createDataFrame(edges, "s string, t string, cnt long")


def test_probabilities_and_best_paths(spark):
    p = transitions.transition_probabilities(frequency(spark, EDGES))
    assert {(r["s"], r["t"]): r["p"] for r in p.collect()} == {("A", "B"): 0.75, ("A", "C"): 0.25, ("B", "C"): 0.5, ("B", "B"): 0.5, ("C", "A"): 0.5, ("C", "D"): 0.5}
    best = {(r["start_node"], r["end_node"]): (r["max_path"], r["prob"]) for r in transitions.best_paths(p).collect()}
    assert best == {
        ("A", "B"): ("A -> B", 0.75), ("A", "C"): ("A -> B -> C", 0.375), ("B", "A"): ("B -> C -> A", 0.25),
        ("B", "C"): ("B -> C", 0.5), ("C", "A"): ("C -> A", 0.5), ("C", "B"): ("C -> A -> B", 0.375),
    }
    assert ("A", "D") in {(r["start_node"], r["end_node"]) for r in transitions.best_paths(p, include_sinks=True).collect()}
    assert [r["max_path"] for r in transitions.top_paths(transitions.best_paths(p), 2).collect()] == ["A -> B", "B -> C"]


def test_tie(spark):
    p = transitions.transition_probabilities(frequency(spark, [("A", "B", 1), ("A", "C", 1), ("B", "D", 1), ("C", "D", 1), ("D", "A", 1)]))
    best = {(r["start_node"], r["end_node"]): r["max_path"] for r in transitions.best_paths(p).collect()}
    assert best[("A", "D")] == "A -> B -> D"


def walks(p, nodes, hops):
    """Best product over all walks, repeats allowed, that stop at the end node."""
    best = {}
    for n in range(1, hops + 1):
        for w in itertools.product(nodes, repeat=n + 1):
            if w[0] != w[-1] and w[-1] not in w[:-1]:
                v = 1.0
                for e in itertools.pairwise(w):
                    v *= p.get(e, 0.0)
                if v:
                    best[(w[0], w[-1])] = max(best.get((w[0], w[-1]), 0), v)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_against_walks(spark, seed):
    rng = random.Random(seed)
    nodes = "abcdef"
    edges = [(x, y, rng.randint(1, 5)) for x in nodes for y in nodes if rng.random() < 0.45]
    df = transitions.transition_probabilities(frequency(spark, edges)).cache()
    p = {(r["s"], r["t"]): r["p"] for r in df.collect()}
    sources = {s for s, _ in p}
    want = {k: v for k, v in walks(p, nodes, 4).items() if k[1] in sources}
    got = {(r["start_node"], r["end_node"]): r["prob"] for r in transitions.best_paths(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    # Every simple path, and the best of them with its ties: the same as what the recurrence keeps.
    paths = [(r["nodes"], r["prob"]) for r in transitions.simple_paths(df).collect()]
    assert len({tuple(n) for n, _ in paths}) == len(paths) == sum(1 for n in range(2, 6) for w in itertools.permutations(nodes, n) if all(e in p for e in itertools.pairwise(w)))
    least = {}
    for n, v in paths:
        if n[-1] in sources:
            key = (-v, len(n), " -> ".join(n))
            least[(n[0], n[-1])] = min(least.get((n[0], n[-1]), key), key)
    assert {(r["start_node"], r["end_node"]): (r["max_path"], r["prob"]) for r in transitions.best_paths(df).collect()} == {k: (v[2], -v[0]) for k, v in least.items()}


def test_dense_graph(spark):
    """150 nodes, all joined: half a billion paths of four edges, of which the recurrence keeps one for each pair."""
    edges = spark.range(150).selectExpr("cast(id as string) AS s").crossJoin(spark.range(150).selectExpr("cast(id as string) AS t")).selectExpr("s", "t", "1 + pmod(xxhash64(s, t), 50) AS cnt")
    df = transitions.transition_probabilities(edges)
    best = transitions.best_paths(df)
    assert best._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 4
    got = {(r["start_node"], r["end_node"]): r["prob"] for r in best.collect()}
    p = np.zeros((150, 150))
    for r in df.collect():
        p[int(r["s"]), int(r["t"])] = r["p"]
    np.fill_diagonal(p, 0)
    now = p.copy()
    for _ in range(3):
        now = np.maximum(now, np.stack([(now[i][:, None] * p).max(0) for i in range(150)]))
    assert len(got) == 150 * 149 and all(abs(got[(str(i), str(j))] - now[i, j]) < 1e-12 for i in range(150) for j in range(150) if i != j)


def test_empty_graph(spark):
    p = transitions.transition_probabilities(frequency(spark, []))
    assert transitions.best_paths(p).count() == 0


def test_classified_and_json(spark):
    counts = spark.createDataFrame([("x", "y", 2), ("x", "z", 1), ("y", "y", 4)], "source string, target string, cnt long")
    classes = spark.createDataFrame([("x", "H1"), ("y", "H1"), ("z", None)], "name string, cls string")
    freq = transitions.classified_frequency(counts, classes)
    assert [tuple(r) for r in freq.collect()] == [("H1", "H1", 6)]
    assert transitions.nested_json(freq).first()["targets"] == '{"H1":6}'


def test_scores(spark):
    rows = [(2, f"A{i} B", i / 100, (30 - i) / 100, i) for i in range(30)] + [(2, "nan B", float("nan"), 1.0, 30), (2, "null B", None, 1.0, 31)]
    df = spark.createDataFrame(rows, "order int, factor_code string, coupling_t double, transition_prob double, row_pos int")
    swept = scoring.alpha_grid(df)
    assert swept.count() == 32 * 11
    top = scoring.top_by_alpha(swept)
    assert top.groupBy("alpha").count().filter("count <> 15").count() == 0
    assert not {"nan B", "null B"} & {r["factor_code"] for r in top.collect()}
    overlap = {round(r["alpha"], 1): r["overlap"] for r in scoring.overlap_with_baseline(top).collect()}
    assert len(overlap) == 11 and overlap[0.5] == 15
    few = scoring.top_by_alpha(scoring.alpha_grid(df.limit(3)))
    assert few.count() == 33
    assert scoring.baseline_rows(df).count() == 15
    assert scoring.ceiling(scoring.alpha_grid(df.limit(2))).first()["ceiling"] == pytest.approx(0.30 * 1.1)
    assert scoring.model_compare(df.withColumnRenamed("transition_prob", "score")).filter("row_pos <= 15").count() == 16


def test_join_of_coupling_and_paths(spark):
    c = spark.createDataFrame([(["H1", "EQ1"], 0.4), (["H1", "H2", "H3"], 0.1)], "factors array<string>, t_value double")
    p = spark.createDataFrame([(["EQ1", "H1"], 0.5), (["H3", "H1", "H2"], 0.2), (["H1", "UNK"], 0.9), (["H1", "H2", "H3", "EQ1"], 0.3)], "codes array<string>, prob double")
    got = {r["factor_code"]: (r["order"], r["coupling_t"], r["transition_prob"]) for r in scoring.join_risks(c, p).collect()}
    assert got == {"EQ1 H1": (2, 0.4, 0.5), "H3 H1 H2": (3, 0.1, 0.2)}


def test_shares(spark):
    counts = {"H3": 140, "H2": 114, "H1": 24, "MG1": 115, "MG2": 14, "MG3": 13, "EQ1": 4, "EQ3": 2, "EQ2": 1}
    df = spark.createDataFrame(list(counts.items()), "code string, mentions long")
    got = {r["code"]: r["share"] for r in describe.parent_share(df).collect()}
    assert got == {"H3": 50.4, "H2": 41.0, "H1": 8.6, "MG1": 81.0, "MG2": 9.9, "MG3": 9.2, "EQ1": 57.1, "EQ3": 28.6, "EQ2": 14.3}
    zero = spark.createDataFrame([("H1", 0)], "code string, mentions long")
    assert describe.parent_share(zero).first()["share"] is None
