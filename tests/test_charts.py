import random

import pytest
from pyspark.sql import functions as F

from perilmap.operators import describe, scoring, transitions

# The goldens' mentions of each sub-factor, and their shares of the parent.
MENTIONS = {"H3": 140, "H2": 114, "H1": 24, "MG1": 115, "MG2": 14, "MG3": 13, "TE2": 27, "TE3": 17, "TE1": 12, "EN2": 9, "EN1": 5, "MA1": 3, "MA2": 3, "MA3": 2, "EQ1": 4, "EQ3": 2, "EQ2": 1}
SHARES = {"H3": 50.4, "H2": 41.0, "H1": 8.6, "MG1": 81.0, "MG2": 9.9, "MG3": 9.2, "TE2": 48.2, "TE3": 30.4, "TE1": 21.4, "EN2": 64.3, "EN1": 35.7, "MA1": 37.5, "MA2": 37.5, "MA3": 25.0, "EQ1": 57.1, "EQ3": 28.6, "EQ2": 14.3}


def labels(spark, rows):
    return spark.createDataFrame(rows, "case_id long, code string")


def test_goldens_of_both_rings(spark):
    df = labels(spark, [(k % 40, c) for c, n in MENTIONS.items() for k in range(n)] + [(1, None)])
    levels = describe.hierarchy(df)
    rows = {(r["level"], r["code"] or r["parent"]): r for r in levels.collect()}
    assert {k[1]: r["share"] for k, r in rows.items() if k[0] == 0} == SHARES
    assert {k[1]: r["mentions"] for k, r in rows.items() if k[0] == 1} == {"H": 278, "MG": 142, "TE": 56, "EN": 14, "MA": 8, "EQ": 7}
    assert (rows[(3, None)]["mentions"], rows[(3, None)]["cases"], rows[(3, None)]["share"]) == (505, 40, None) and rows[(1, "H")]["cases"] == 40
    pie = {r["name"]: (r["ring"], r["label"]) for r in describe.nested_pie(levels).collect()}
    assert len(pie) == 23 and pie["H3"] == ("outer", "50.4%") and pie["H"] == ("inner", "") and pie["MA3"] == ("outer", "25.0%")


def test_levels_against_counting(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(30), rng.choice(["A1", "A2", "B1", "B12", None])) for _ in range(300)]
    got = {(r["level"], r["parent"], r["code"]): (r["mentions"], r["cases"]) for r in describe.hierarchy(labels(spark, rows)).collect()}
    want = {}
    for level, key in ((0, lambda c: (c.rstrip("0123456789"), c)), (1, lambda c: (c.rstrip("0123456789"), None)), (3, lambda c: (None, None))):
        for case, c in rows:
            if c is not None:
                n, cases = want.setdefault((level, *key(c)), ([], set()))
                n.append(1)
                cases.add(case)
    assert got == {k: (len(n), len(cases)) for k, (n, cases) in want.items()}
    assert describe.hierarchy(labels(spark, [])).count() == 0


def test_panels(spark):
    rows = [(2, f"c{k:02}", k / 20, (k * 7 % 20) / 20) for k in range(20)]
    df = spark.createDataFrame(rows, "order int, factor_code string, coupling_t double, transition_prob double")
    made = describe.score_panels(scoring.alpha_grid(scoring.baseline_rows(df))).collect()
    assert len(made) == 165 and {(r["panel"], r["grid_row"], r["grid_column"]) for r in made} == {(k, k // 3, k % 3) for k in range(11)}
    assert all(abs(r["alpha"] - r["panel"] / 10) < 1e-12 and abs(r["alpha"] + r["beta"] - 1) < 1e-12 for r in made)
    order = {}
    for r in made:
        order.setdefault(r["factor_code"], set()).add(r["x"])
    assert all(len(x) == 1 for x in order.values()) and {r["y_limit"] for r in made} == {max(max(r["score"], r["coupling_t"]) for r in made) * 1.1}
    line = describe.overlap_line(scoring.overlap_with_baseline(scoring.top_by_alpha(scoring.alpha_grid(df)))).collect()
    assert sum(r["is_baseline"] for r in line) == 1 and all(r["overlap"] == 15 for r in line if r["is_baseline"])


@pytest.mark.parametrize("seed", range(3))
def test_best_walk_is_the_best_path(spark, seed):
    """Walks that stop on first arrival, against a search in Python; the best of each pair equals ``best_paths``."""
    rng = random.Random(seed)
    nodes = "ABCDE"
    edges = {(s, t): rng.randint(1, 9) for s in nodes[:4] for t in nodes if rng.random() < 0.6}
    df = transitions.transition_probabilities(spark.createDataFrame([(*e, n) for e, n in edges.items()], "s string, t string, cnt long"))
    p = {(r["s"], r["t"]): r["p"] for r in df.collect()}
    sources = {s for s, _ in p}

    def search(path, prob, end):
        if path[-1] == end and len(path) > 1:
            yield tuple(path), prob
        elif len(path) < 5:
            for t in nodes:
                if (path[-1], t) in p:
                    yield from search([*path, t], prob * p[path[-1], t], end)

    want = sorted((w, q) for s in sources for e in sources if s != e for w, q in search([s], 1.0, e))
    found = transitions.walks(df)
    got = sorted((tuple(r["nodes"]), r["prob"]) for r in found.filter("start_node <> end_node").collect())
    assert [w for w, _ in got] == [w for w, _ in want] and all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(got, want, strict=True))
    best = {(r["start_node"], r["end_node"]): r["p"] for r in found.groupBy("start_node", "end_node").agg(F.max("prob").alias("p")).filter("start_node <> end_node").collect()}
    paths = {(r["start_node"], r["end_node"]): r["prob"] for r in transitions.best_paths(df).collect()}
    assert best.keys() == paths.keys() and all(abs(best[k] - paths[k]) < 1e-12 for k in best)


def test_no_row_for_each_case_and_level(spark):
    """Cases are counted without an expansion of all rows by level: no distinct keys of cases in a task's memory."""
    plan = describe.hierarchy(labels(spark, [(1, "H1"), (1, "H2"), (2, "H1")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
