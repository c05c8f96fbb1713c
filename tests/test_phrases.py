import random
import re

import pytest
from pyspark.sql import functions as F

from perilmap.operators import phrases
from perilmap.plans.reports import SCHEMES, SENTENCES

SUB = {"sub": SCHEMES["sub"], "main": SCHEMES["main"]}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def codes(spark, texts, schemes=SUB):
    out = {k: {} for k in range(len(texts))}
    for r in phrases.phrase_codes(phrases.find_phrases(frame(spark, texts), phrases.phrase_rules(spark, schemes))).collect():
        out[r["id"]][r["scheme"]] = r["codes"]
    return out


def test_real_phrases(spark):
    texts = [
        "Insufficient training was given", "Able to read blueprints", "unable to read the blueprints", "oven temperature", "Insufficient oven temperatures", "damp/rusty consumables", "Abnormal current", "They lacked responsibility",
        "no rain", "No inspection and poor training", "It never rained. Strong winds!", "no fault, rusty wires", "The raw materials did not meet", "raw materials not meeting requirements", "a design with defects", "Violates processes; violated blueprints", None, "", "RAIN/SNOW",
    ]
    got = codes(spark, texts)
    want = [
        {"sub": ["MG3"]}, {}, {"sub": ["H1"]}, {}, {"sub": ["MA3"]}, {"sub": ["MA3"]}, {"sub": ["EQ3"]}, {"sub": ["H2"], "main": ["HU"]},
        {}, {"sub": ["H1"], "main": ["MG", "HU"]}, {"sub": ["EN2"], "main": ["EN"]}, {"sub": ["MA2"], "main": ["MA"]}, {}, {"sub": ["MA1"]}, {}, {"sub": ["H3"]}, {}, {}, {"sub": ["EN1"], "main": ["EN"]},
    ]
    assert [got[k] for k in range(len(texts))] == want


def test_every_rule_finds_its_own_phrase(spark):
    for scheme, rules in SUB.items():
        wanted = [(a, c) for c, ps in rules.items() for p in ps for a in phrases.alternatives(p)]
        got = codes(spark, [a for a, _ in wanted], {scheme: rules})
        assert all(c in got[k][scheme] for k, (_, c) in enumerate(wanted))
        assert max(len(a.split()) for a, _ in wanted) <= phrases.LONGEST + 1


def test_longest_hit_wins_and_places_are_words(spark):
    rules = phrases.phrase_rules(spark, {"s": {"A": ("raw material",), "B": ("unqualified raw material", "of the raw material"), "C": ("material supply",), "D": ("raw material",)}, "t": {"E": ("material",)}})
    hits = phrases.find_phrases(frame(spark, ["Old, unqualified raw materials supply", "raw. material"]), rules)
    assert sorted((r["id"], r["code"], r["place"], r["words"], r["negated"]) for r in hits.collect()) == [(0, "B", 2, 3, False), (0, "C", 4, 2, False), (0, "E", 4, 1, False), (1, "E", 2, 1, False)]


def test_stems(spark):
    words = {"trained": "train", "training": "train", "rain": "rain", "rains": "rain", "processes": "process", "process": "process", "bodies": "body", "exceed": "exceed", "exceeding": "exceed", "wires": "wire", "status": "status", "violates": "violat", "used": "used", "being": "being", "boxes": "box", "this": "this", "basis": "basis"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["s"] for r in df.select("w", phrases.stem(F.col("w")).alias("s")).collect()} == words


def brute(text, rules):
    """Hits of one text by plain lists of words."""

    def stem(w):
        if len(w) < 5:
            return w
        for pattern, by in (("^(.{2,})ies$", r"\1y"), ("^(.*(?:ss|sh|ch|x))es$", r"\1"), ("^(.{3,}[^sui])s$", r"\1"), ("^(.{3,}[^e])ing$", r"\1"), ("^(.{3,}[^e])ed$", r"\1"), ("^(.{4,})e$", r"\1")):
            w = re.sub(pattern, by, w)
        return w

    def stems(t):
        t = re.sub(r"[.,;:!?\n()]+", " | ", t.lower().replace("n't", " not "))
        return [stem(w) for w in re.split(r"[^\w|]+|_", t) if w and w not in phrases.SKIPPED]

    words = stems(text or "")
    hits = []
    for scheme, code, phrase in rules:
        r = stems(phrase)
        hits += [(scheme, code, phrase, k, len(r)) for k in range(len(words) - len(r) + 1) if words[k : k + len(r)] == r]
    out = []
    for scheme, code, phrase, k, n in hits:
        spans = [(a, b) for s, _, _, a, b in hits if s == scheme]
        if any(b > n and a <= k and a + b >= k + n for a, b in spans):
            continue
        negated = False
        for j in range(k - 1, max(-1, k - 1 - phrases.WINDOW), -1):
            if words[j] == "|":
                break
            if words[j] in phrases.NEGATIONS:
                negated = not any(a <= j < a + b for _, _, _, a, b in hits)
                break
        out.append((scheme, code, phrase, k, n, negated))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(6)
    table = phrases.phrase_rules(spark, SCHEMES)
    rules = [tuple(r) for r in table.collect()]
    pool = [*SENTENCES, *(p for _, _, p in rules), "no", "not", "never", "and", "of the", ".", ",", "without any", "x y z"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(400)]
    found = {}
    for r in phrases.find_phrases(frame(spark, texts).repartition(3), table).collect():
        found.setdefault(r["id"], []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in found.items()} == {k: b for k, t in enumerate(texts) if (b := brute(t, rules))}


def test_ten_thousand_rules_are_one_join(spark):
    rules = spark.range(10_000).select(F.lit("s").alias("scheme"), F.concat(F.lit("c"), F.col("id")).alias("code"), F.concat(F.lit("insufficient part"), F.col("id")).alias("phrase"))
    texts = frame(spark, [f"insufficient part{k} and insufficient part{k + 1}" for k in range(0, 10_000, 50)])
    hits = phrases.find_phrases(texts, rules)
    assert hits.count() == 400
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and plan.count("Join LeftSemi") == 1


@pytest.mark.parametrize("text", ["not " * 100_000 + "poor training", "poor training " * 20_000, "." * 100_000 + "rusty wire", " " * 100_000, "x" * 500_000])
def test_long_texts(spark, text):
    hits = phrases.find_phrases(frame(spark, [text]), phrases.phrase_rules(spark, SUB))
    assert hits.filter("NOT negated").count() == {"poor training " * 20_000: 40_000, "." * 100_000 + "rusty wire": 2}.get(text, 0)


def test_empty_tables(spark):
    none = phrases.phrase_rules(spark, {"s": {"A": ("x",)}}).limit(0)
    assert phrases.find_phrases(frame(spark, ["poor training"]), none).count() == 0
    assert phrases.phrase_codes(phrases.find_phrases(frame(spark, ["a"]).limit(0), phrases.phrase_rules(spark, SUB))).count() == 0


def test_rules_have_a_known_size(spark):
    """Small rules are broadcast, so that the places of all texts aren't shuffled to meet them."""
    rules = phrases.phrase_rules(spark, SCHEMES)
    assert int(rules._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 100_000
    assert phrases.phrase_rules(spark, {}).count() == 0
