import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilmap.functions.taxonomy import MAIN_FACTORS, SUB_FACTORS, Taxonomy
from perilmap.operators import coupling, encode

THREE = Taxonomy(("A", "B", "C"), (("a", "A"), ("b", "B"), ("c", "C")))


def t_of(spark, masks, taxonomy=THREE, orders=(1, 2, 3)):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(masks)], "case_id long, mask long")
    rows = coupling.couplings(coupling.states(df), taxonomy, orders, 1e-12).collect()
    return {tuple(r["factors"]): r["t_value"] for r in rows}


def definition(masks, bits):
    n = len(masks)
    joint = Counter(tuple(m >> b & 1 for b in bits) for m in masks)
    ones = {b: sum(m >> b & 1 for m in masks) for b in bits}
    total = 0.0
    for state, c in joint.items():
        q = math.prod((ones[b] if s else n - ones[b]) / n for b, s in zip(bits, state, strict=True))
        total += c / n * math.log2(c / n / q)
    return total


@pytest.mark.parametrize(
    ("masks", "factors", "want"),
    [([0, 3], ("A", "B"), 1), ([0, 1, 2, 3], ("A", "B"), 0), ([0, 7], ("A", "B", "C"), 2), ([0, 6, 5, 3], ("A", "B", "C"), 1), ([0, 6, 5, 3], ("A", "C"), 0), ([1, 0, 1], ("A",), 0), ([0, 0], ("B", "C"), 0)],
)
def test_goldens(spark, masks, factors, want):
    assert t_of(spark, masks)[factors] == pytest.approx(want, abs=1e-12)


def test_against_definition(spark):
    rng = random.Random(5)
    masks = [rng.getrandbits(17) & rng.getrandbits(17) for _ in range(300)]
    got = t_of(spark, masks, SUB_FACTORS, (2, 3))
    assert len(got) == 816
    for bits in rng.sample(list(combinations(range(17), 3)), 40) + rng.sample(list(combinations(range(17), 2)), 40):
        assert got[tuple(SUB_FACTORS.codes[b] for b in bits)] == pytest.approx(definition(masks, bits), abs=1e-12)


def test_properties(spark):
    rng = random.Random(7)
    masks = [rng.getrandbits(6) for _ in range(200)]
    t = t_of(spark, masks, MAIN_FACTORS, tuple(range(1, 7)))
    assert len(t) == 63 and min(t.values()) > -1e-12
    for a in t:
        for b in t:
            if set(a) < set(b):
                assert t[a] <= t[b] + 1e-12
    shuffled = masks[:]
    rng.shuffle(shuffled)
    again = t_of(spark, shuffled, MAIN_FACTORS, tuple(range(1, 7)))
    assert all(abs(again[k] - v) < 1e-12 for k, v in t.items())


def test_empty_input(spark):
    df = spark.createDataFrame([], "case_id long, mask long")
    s = coupling.states(df)
    assert coupling.sub_couplings(s, SUB_FACTORS).count() == 0
    assert [r["p"] for r in coupling.joint_distribution(s, 2).collect()] == [0.0] * 4
    assert coupling.ranked(coupling.sub_couplings(s, SUB_FACTORS), 20).count() == 0


def test_joint_and_marginals(spark):
    s = coupling.states(spark.createDataFrame([(0, 1), (1, 1), (2, 4), (3, 0)], "case_id long, mask long"))
    joint = {r["code"]: r["p"] for r in coupling.joint_distribution(s, 3).collect()}
    assert len(joint) == 8 and joint["100"] == 0.5 and joint["001"] == 0.25 and joint["000"] == 0.25 and joint["111"] == 0
    m = {(r["factor"], r["state"]): r["p"] for r in coupling.marginals(s, THREE).collect()}
    assert m[("A", 1)] == 0.5 and m[("C", 0)] == 0.75 and m[("B", 1)] == 0


def test_encoding(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    labels = spark.createDataFrame([(1, "Human"), (1, "Human Factors"), (1, "Equipment"), (2, "unheard of"), (2, None)], "case_id long, label string")
    got = {r["case_id"]: r["mask"] for r in encode.case_masks(cases, labels, MAIN_FACTORS).collect()}
    assert got == {1: 5, 2: 0, 3: 0}
    wide = encode.multi_hot(encode.case_masks(cases, labels, MAIN_FACTORS), MAIN_FACTORS).filter("case_id = 1").first()
    assert (wide["HU"], wide["EN"], wide["EQ"]) == (1, 0, 1)
    row = spark.createDataFrame([(["Skill Level", "?", "Operating Procedures", "Skill Level", "Welding Material Management"],)], "v array<string>")
    r = row.select(encode.factor_codes(F.col("v"), SUB_FACTORS).alias("a"), encode.path_codes(F.col("v"), SUB_FACTORS).alias("b"), encode.bit_string(F.lit(5).cast("bigint"), 6).alias("c"), encode.mask_of_list(F.col("v"), SUB_FACTORS).alias("m")).first()
    assert (r["a"], r["b"], r["c"]) == ("H1 H3 H1 MA2", "H1 UNK H3 H1 MA2", "101000")
    assert r["m"] == 1 << 0 | 1 << 2 | 1 << SUB_FACTORS.bit("MA2")
    assert SUB_FACTORS.table(spark).filter("parent = 'MG'").count() == 3


def test_lattice_against_small_orders_and_definition(spark):
    """Orders two and three by both ways, four to six by the definition, on random masks of 17 factors."""
    rng = random.Random(8)
    masks = [rng.getrandbits(17) & rng.getrandbits(17) | (rng.random() < 0.3) * 0b1011 for _ in range(400)]
    small, lattice = t_of(spark, masks, SUB_FACTORS, (2, 3)), t_of(spark, masks, SUB_FACTORS, (2, 3, 4, 5, 6))
    assert len(lattice) == 21_760 and all(lattice[f] == pytest.approx(t, abs=1e-12) for f, t in small.items())
    for order in (4, 5, 6):
        for bits in rng.sample(list(combinations(range(17), order)), 25) + [tuple(range(order))]:
            assert lattice[tuple(SUB_FACTORS.codes[b] for b in bits)] == pytest.approx(definition(masks, bits), abs=1e-12)


def test_superset_counts():
    rng = random.Random(2)
    masks = [rng.getrandbits(6) for _ in range(90)]
    found = coupling.superset_counts(np.array(masks), np.ones(90, dtype=np.int64), 6)
    assert found.tolist() == [sum(m & s == s for m in masks) for s in range(64)]


def test_lattice_of_nothing(spark):
    assert t_of(spark, [], SUB_FACTORS, (4,)) == {} and set(t_of(spark, [0, 0], SUB_FACTORS, (4,)).values()) == {0.0}
    with pytest.raises(ValueError):
        coupling.couplings(None, Taxonomy(tuple(f"c{k}" for k in range(21)), ()), (4,), 0)
