import json
import os
import random
import time

import pandas as pd

from perilmap.operators import answers, classify, graph


def test_clean_triplets(spark):
    rows = [
        (1, "Spatter and Crack", "QUALITY_DEFECT", "CAUSED_BY", "wind", "ENVIRONMENT_FACTOR"), (2, "pores", "QUALITY_DEFECT", "CAUSED_BY", "x", "HUMAN_FACTOR"),
        (3, "a", "HUMAN_FACTOR", "LEADS_TO", "a", "HUMAN_FACTOR"), (4, "", "HUMAN_FACTOR", "LEADS_TO", "b", "HUMAN_FACTOR"), (5, "a", "HUMAN_FACTOR", "OCCURS_IN", "Pitting", "QUALITY_DEFECT"),
        (6, "Crack x", "QUALITY_DEFECT", "CAUSED_BY", "Crack", "QUALITY_DEFECT"), (7, None, None, None, "b", None), (8, "m", None, "LEADS_TO", "n", None),
    ]
    df = spark.createDataFrame(rows, "case_id long, head string, head_type string, relation string, tail string, tail_type string")
    clean = graph.clean_triplets(df)
    got = {r["case_id"]: (r["head"], r["tail"]) for r in clean.collect()}
    assert got == {1: ("Spatter", "wind"), 5: ("a", "Pit"), 6: ("Crack", "Crack"), 8: ("m", "n")}
    assert {r["case_id"] for r in graph.enforce_schema(clean, graph.relation_schema(spark)).collect()} == {1, 6}
    assert graph.nodes(clean).filter("name = 'Crack'").count() == 1
    doubled = clean.unionByName(clean)
    assert graph.edges(doubled).count() == 8 and graph.edges(doubled, merge=True).count() == 4


def test_explode_triplets(spark):
    t = {"head": "a", "head_type": "HUMAN_FACTOR", "relation": "LEADS_TO", "tail": "b", "tail_type": "QUALITY_DEFECT"}
    df = spark.createDataFrame([(1, json.dumps([t] * 25)), (2, "broken"), (3, None)], "case_id long, answer string")
    rows = graph.explode_triplets(df).orderBy("pos").collect()
    assert len(rows) == 20 and rows[0]["tail"] == "b"


def test_keywords(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("The PERSON in the rain",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(classify.keyword_codes(F.col("t"), {"B": ("rain", "sun"), "A": ("person",), "C": ("x",)})).collect()]
    assert got == [["B", "A"], [], []]


def test_pluggable_classifier(spark):
    def model(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps({"Human": [t, t], "Equipment": ["x"], "Material": []}))

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, " ")], "id long, text string")
    out = answers.flatten_labels(classify.classify_texts(df, "text", model)).orderBy("id").collect()
    assert [r["status"] for r in out] == ["Success", "Success", "Skipped", "Skipped"]
    assert out[0]["factors"] == ["a", "x"] and out[0]["categories"] == ["Human", "Equipment"] and out[2]["factors"] == []


def test_retries_end_in_a_status():
    calls = []

    def broken(texts):
        calls.append(1)
        raise ConnectionError

    out = classify.with_retries(broken, tries=3)(pd.Series(["a", "b"]))
    assert len(calls) == 1 + 2 * 3 and set(out["status"]) == {"Failed"} and out["answer"].isna().all()

    def picky(texts):
        if "bad" in set(texts):
            raise ValueError
        return texts.str.upper()

    out = classify.with_retries(picky, tries=3)(pd.Series(["a", "bad", "c"]))
    assert list(out["status"]) == ["Success", "Failed", "Success"] and list(out["answer"])[::2] == ["A", "C"]


def test_calls_keep_a_rate_over_all_tasks(spark, tmp_path):
    """Eight partitions on four cores, a model that fails one call in five: all calls, repeated ones too, keep the rate."""
    folder, rate = str(tmp_path), 20.0

    def model(texts: pd.Series) -> pd.Series:
        assert len(texts) == 1
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write(f"{time.time()} {texts.iloc[0]}\n")
        if int(texts.iloc[0]) % 5 == 0 and random.random() < 0.5:
            raise ConnectionError
        return texts

    df = spark.range(100).selectExpr("id", "CAST(id AS STRING) AS t")
    assert classify.classify_texts(df, "t", model, tries=20, parallel=8, rate=rate).filter("status = 'Success' AND answer = t").count() == 100
    calls = sorted(float(line.split()[0]) for p in tmp_path.iterdir() for line in p.read_text().splitlines())
    assert len(calls) > 100
    # Any window of two seconds holds at most what the rate allows, but for one call that each task may start with.
    for k, at in enumerate(calls):
        assert sum(1 for c in calls[k:] if c < at + 2) <= 2 * rate * 1.1 + 4
    assert (len(calls) - 1) / (calls[-1] - calls[0]) <= rate * 1.1


def test_pace():
    pace, began = classify.Pace(50), time.monotonic()
    for _ in range(11):
        pace.wait()
    assert 0.2 <= time.monotonic() - began < 0.3


def test_drivers_over_rows(spark):
    def model(prompts: pd.Series) -> pd.Series:
        assert prompts.str.contains("\n\n").all()
        return prompts.map(lambda p: "```json\n" + json.dumps({"Human": [p[-1]], "Equipment": ["x"], "secondary_factors": ["Skill Level", "Unclassified", "Tool Usage"] if p.endswith("a") else ["Unclassified"]}) + "\n```")

    rows = spark.createDataFrame([(1, "a"), (2, "\t"), (3, "NaN"), (4, None), (5, "b")], "id long, `Root Cause Analysis` string")
    main = classify.main_labels(rows, "Root Cause Analysis", lambda p: model(p).map(lambda t: t.replace(', "secondary', ', "z')), ("Human", "Equipment")).orderBy("id").collect()
    assert [r["status"] for r in main] == ["Success", "Skipped", "Skipped", "Skipped", "Success"]
    assert (main[0]["Risk_Factors"].split("; ")[:2], main[0]["Factor_Categories"].split("; ")[:2], main[1]["Risk_Factors"]) == (["a", "x"], ["Human", "Equipment"], "")
    sub = {r["id"]: r["Secondary_Factors"] for r in classify.sub_labels(rows, "Root Cause Analysis", model, ("Skill Level", "Tool Usage")).collect()}
    assert sub == {1: "Skill Level; Tool Usage", 2: "", 3: "", 4: "", 5: ""}
    counts = spark.createDataFrame([("a", "b", 2)], "source string, target string, cnt long")
    assert {tuple(r) for r in classify.node_classes(counts, model, ("Skill Level",)).collect()} == {("a", "Skill Level"), ("b", None)}


def test_embeddings(spark):
    nodes = spark.createDataFrame([("a", "X"), ("bb", "Y")], "name string, type string")
    assert {r["name"]: r["embedding"] for r in graph.with_embeddings(nodes, lambda names: [(len(n), 1) for n in names]).collect()} == {"a": [1.0, 1.0], "bb": [2.0, 1.0]}


def test_log(spark):
    counts = spark.createDataFrame([("a", "b", 2), ("a", "c", 1)], "source string, target string, cnt long")
    classes = spark.createDataFrame([("a", "H1"), ("b", "H2"), ("c", None)], "name string, cls string")
    got = {r["target"]: r["status"] for r in classify.classification_log(counts, classes).collect()}
    assert got == {"b": "Success", "c": "Skipped"}
