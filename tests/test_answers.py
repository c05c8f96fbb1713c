import json

from pyspark.sql import functions as F

from perilmap.operators import answers

GOOD = {"Human": ["a", "b", "a"], "Equipment": ["x"], "Material": []}


def labels(spark, texts):
    rows = answers.flatten_labels(spark.createDataFrame(list(enumerate(texts)), "id long, answer string")).orderBy("id").collect()
    return [(r["categories"], r["factors"]) for r in rows]


def test_forms_of_an_answer(spark):
    body = json.dumps(GOOD)
    want = (["Human", "Equipment"], ["a", "b", "x"])
    forms = [body, f"```json\\n{body}\\n```", f"Sure!\\n```json\\n{body}\\n``` Done", f"```\\n{body}\\n```", f"  {body}\\n", f"x {body} y"]
    assert labels(spark, [f.replace("\\n", "\n") for f in forms]) == [want] * len(forms)
    assert labels(spark, [None, "", "no json", body[:-3], "[1, 2]", "7", '"x"', "{", "}{", '{"a": ["x"], "a": ["y"]}']) == [([], [])] * 10


def test_a_wrong_field_spoils_no_other(spark):
    mixed = json.dumps({"Z": ["last", 3, None, True, {"a": 1}, [1], 1.5, ""], "A": "alone", "M": 7, "N": None, "O": {"x": ["y"]}, "E": []})
    assert labels(spark, [mixed]) == [(["Z", "A", "M"], ["last", "3", "true", "1.5", "", "alone", "7"])]
    odd = json.dumps({"a.b": ["x"], "$": ["y"], "'q'": ["z"], "": ["e"], "ü\n": ["ß"]})
    assert labels(spark, [odd]) == [(["a.b", "$", "'q'", "", "ü\n"], ["x", "y", "z", "e", "ß"])]


def test_sub_factors(spark):
    texts = ['{"secondary_factors": ["X", "Unclassified", 4]}', '```json\n{"secondary_factor": ["Y"]}\n```', '{"secondary_factors": "Z", "secondary_factor": ["no"]}', '{"secondary_factors": null, "x": 1}', "[", None, '{"secondary_factors": {"a": 1}}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(answers.sub_factors(F.col("t"))).collect()] == [["X", "4"], ["Y"], ["Z"], [], [], [], []]


def test_triplets(spark):
    t = {"head": "a", "head_type": "H", "relation": "R", "tail": "b", "tail_type": "T"}
    texts = [json.dumps([t] * 25), f"Found: {json.dumps([7, t, 'x', None, {**t, 'tail': ['no']}, {'head': 1, 'more': 2}])}.", json.dumps(t), f"```json\n{json.dumps([])}\n```", "broken [", None, json.dumps([t])[:-1]]
    rows = answers.triplets(spark.createDataFrame(list(enumerate(texts)), "id long, answer string")).orderBy("id", "pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r["id"], []).append(tuple(r)[1:])
    whole = ("a", "H", "R", "b", "T")
    assert got == {0: [(k, *whole) for k in range(20)], 1: [(0, *whole), (1, "a", "H", "R", None, "T"), (2, "1", None, None, None, None)], 2: [(0, *whole)], 6: [(0, *whole)]}


def test_long_answers_and_empty_tables(spark):
    long = json.dumps({"Human": [f"f{k}" for k in range(100_000)], "Equipment": ["x" * 500_000]})
    [(categories, factors)] = labels(spark, [long])
    assert categories == ["Human", "Equipment"] and len(factors) == 100_001
    assert labels(spark, ["{" * 100_000]) == [([], [])]
    none = spark.createDataFrame([], "id long, answer string")
    assert answers.flatten_labels(none).count() == 0 and answers.triplets(none).count() == 0
