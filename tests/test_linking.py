import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilmap.operators import linking


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, vector array<double>")


def brute(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    return {(i, j) for i, j in zip(*np.nonzero(np.triu(c >= threshold, 1)), strict=True)}


def test_recall_and_exactness(spark):
    """All links of a table with many pairs near the threshold, and none that isn't one; recall stated: 1."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 64))
    x = np.concatenate([base, *(base + rng.standard_normal((150, 64)) * s for s in (0.2, 0.4, 0.48, 0.55))])
    want = brute(x)
    _, links = linking.vector_links(frame(spark, x).repartition(4))
    got = [(r["a"], r["b"]) for r in links.collect()]
    assert len(got) == len(set(got)) and len(want) > 300
    assert set(got) <= want and len(set(got)) / len(want) >= 0.9
    assert set(got) == want


@pytest.mark.parametrize("members", [3, 512])
def test_dense_groups_in_blocks(spark, monkeypatch, members):
    monkeypatch.setattr(linking, "MEMBERS", members)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((1, 16)) + rng.standard_normal((40, 16)) * 0.1, rng.standard_normal((30, 16))])
    _, links = linking.vector_links(frame(spark, x), bits=6)
    assert {(r["a"], r["b"]) for r in links.collect()} == brute(x)


def test_equal_vectors_are_one_node(spark):
    x = [[1, 0], [2, 0], [1, 0], [0, 1], [0, 0], [1, 0.1]]
    df = frame(spark, x, 10).unionByName(spark.createDataFrame([(99, None), (98, [])], "id long, vector array<double>"))
    counts = linking.link_counts(*linking.vector_links(df))
    assert {r["id"]: (r["node"], r["n_links"]) for r in counts.collect()} == {10: (10, 2), 11: (11, 2), 12: (10, 2), 13: (13, 0), 14: (14, 0), 15: (15, 2), 98: (98, 0), 99: (99, 0)}
    assert linking.link_counts(*linking.vector_links(df.limit(0))).count() == 0


def test_tables_follow_from_recall():
    p = linking.agreement(0.9) ** 12
    n = linking.tables_for(0.9, 12, 1 - 1e-6)
    assert (1 - p) ** n <= 1e-6 < (1 - p) ** (n - 1) and math.isclose(linking.agreement(0.0), 0.5)


def test_no_pair_of_all_rows_is_made(spark):
    df = spark.range(10).select("id", F.array(F.rand(1), F.rand(2)).alias("vector"))
    plan = linking.vector_links(df)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and plan.count("bucket#") > 0


@pytest.mark.parametrize("bits", [5, 20])
def test_first_planes_and_tables_seen_before_lose_no_pair(spark, bits):
    """Each close pair once, from the first table that it shares, whatever the width of a table's number."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 24))
    x = np.concatenate([base, base + rng.standard_normal((60, 24)) * 0.1, base + rng.standard_normal((60, 24)) * 0.3])
    p, tables = linking.agreement(0.9), 40
    sketched = linking.sketches(frame(spark, x).withColumnRenamed("id", "node"), bits, tables)
    rows = {r["node"]: (np.unpackbits(np.frombuffer(r["sketch"], np.uint8), count=bits * tables), set(r["buckets"])) for r in sketched.collect()}
    least = linking.least_of(bits * tables, p)
    want = sorted((a, b) for a in rows for b in rows if a < b and (rows[a][0] == rows[b][0]).sum() >= least and rows[a][1] & rows[b][1])
    first = linking.least_of(128, p)
    want = [(a, b) for a, b in want if (rows[a][0] == rows[b][0])[:128].sum() >= first]
    got = sorted((r["a"], r["b"]) for r in linking.close_nodes(sketched, bits, tables, p).collect())
    assert got == want and len(want) > 60


@pytest.mark.parametrize(("part", "bits"), [(10**6, 6), (7, 6), (25, 20)])
def test_numbers_of_links_in_rounds(spark, monkeypatch, part, bits):
    """Numbers of links equal those of the list, whatever the rounds and parts of large buckets."""
    monkeypatch.setattr(linking, "PART", part)
    monkeypatch.setattr(linking, "ROUND_BYTES", 200_000)
    monkeypatch.setattr(linking, "CELL_NODES", 50)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((1, 16)) + rng.standard_normal((60, 16)) * 0.25, rng.standard_normal((30, 16)), np.zeros((1, 16))])
    df = frame(spark, x).unionByName(frame(spark, x[:3], 500)).repartition(3)
    close = brute(x[:-1])
    n = {i: sum(i in pair for pair in close) for i in range(len(x))} | {500 + i: sum(i in pair for pair in close) for i in range(3)}
    got = {r["id"]: (r["node"], r["n_links"]) for r in linking.vector_link_counts(df, bits=bits, recall=0.999999 if bits == 6 else 0.99).collect()}
    assert got == {i: (i % 500, k) for i, k in n.items()} and len(close) > 1000
    _, links = linking.vector_links(df, bits=bits, recall=0.999999 if bits == 6 else 0.99)
    rows = links.collect()
    assert {(r["a"], r["b"]) for r in rows} == close and len(rows) == len(close)
    exact = {(a, b): sum(p * q for p, q in zip(x[a], x[b], strict=True)) for a, b in close}
    assert all(abs(r["cosine"] * np.linalg.norm(x[r["a"]]) * np.linalg.norm(x[r["b"]]) - exact[r["a"], r["b"]]) < 1e-9 for r in rows)


def test_links_are_not_shuffled_with_their_vectors(spark):
    """A dense group of 1,200 nodes has 719,400 links; where the nodes are too many for a broadcast, each link took its vectors along."""
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: store.executorList(False).apply(0).totalShuffleWrite()
    rng = np.random.default_rng(10)
    x = rng.standard_normal((1, 16)) + rng.standard_normal((1200, 16)) * 0.05
    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r["n_links"] for r in linking.vector_link_counts(frame(spark, x), bits=4).collect()} == {1199}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written() - before < 8_000_000


def test_vectors_of_several_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "id long, vector array<double>").coalesce(1)
    with pytest.raises(Exception, match="vectors of"):
        linking.vector_link_counts(df).collect()
