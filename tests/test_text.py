from pyspark.sql import functions as F

from perilmap.functions import text as tx


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_split_cases(spark):
    docs = spark.createDataFrame([(1, "preCase 1 aCase 2 bCase")], "doc_id long, text string")
    assert [r["segment"] for r in tx.split_cases(docs).orderBy("seg_no").collect()] == ["Case1 a", "Case2 b"]
    assert [r["segment"] for r in tx.split_cases(docs, numbered=False).orderBy("seg_no").collect()] == ["pre", "1 a", "2 b"]


def test_split_hashes(spark):
    docs = spark.createDataFrame([(1, "a" + "#" * 24 + "b"), (2, "x\r\n##########\r\n\r\ny"), (3, None), (4, "")], "doc_id long, text string")
    got = [(r["doc_id"], r["segment"]) for r in tx.split_hashes(docs).orderBy("doc_id", "seg_no").collect()]
    assert got == [(1, "a"), (1, "####b"), (2, "x"), (2, "y")]


def test_sections(spark):
    arabic = "1. Occurrence Time：April　2020\n2. Occurrence Stage: a  b\n3. Problem Phenomenon: p\n4. Root Cause Analysis: r\nV. Countermeasures x"
    roman = "Case 110\r\nI. Occurrence Time\r\nApril 2020\r\nII. Occurrence Stage\r\nSeg\r\nIII. Problem Phenomenon\r\nweld\r\nIV. Analysis of Problem Causes\r\ncareless.V. Countermeasures\r\n1. train"
    df = spark.createDataFrame([(arabic,), (roman,), (None,)], "segment string")
    a = tx.extract_sections(df).collect()
    assert a[0][1:] == ("April 2020", "a b", "p", "r V. Countermeasures x")
    assert a[1][1:] == ("", "", "", "") and a[2][1:] == ("", "", "", "")
    b = tx.extract_sections(df, tx.ROMAN).collect()
    assert b[1][1:] == ("April 2020", "Seg", "weld", "careless.")


def test_small_functions(spark):
    assert one(spark, tx.normalize_space, " a　 b\n\tc ") == "a b c"
    assert one(spark, tx.strip_code_fence, '```json\n{"a": 1}\n\t```') == '{"a": 1}'
    assert one(spark, tx.strip_code_fence, "plain") == "plain"
    assert one(spark, tx.split_labels, " a；b;; c ;") == ["a", "b", "c"]
    assert one(spark, tx.split_labels, None) == []
    assert one(spark, lambda c: tx.split_labels(c, full_width=False, drop_empty=False), "a；b;") == ["a；b", ""]
    assert one(spark, tx.first_label, ";x") is None and one(spark, tx.first_label, "a;b") == "a"
    assert one(spark, lambda c: tx.first_contained(c, ["Spatter", "Crack"]), "Crack and Spatter") == "Spatter"
    assert one(spark, lambda c: tx.first_contained(c, ["Spatter"]), "pores") is None


def test_render(spark):
    row = spark.createDataFrame([("a {b}", 3), (None, 4)], "t string, n int").select(tx.render("{{}} {text}: {n}!", text=F.col("t"), n=F.col("n")).alias("r")).collect()
    assert [r[0] for r in row] == ["{} a {b}: 3!", "{} : 4!"]


def test_long_runs_take_linear_time(spark):
    """100,000 spaces, hashes or labels inside a text, in every pattern that meets such runs."""
    import time

    n = 100_000
    texts = ["a" + " " * n + "b", "\u3000" * n + "x" + "\t" * n, "#" * n, " #" * n, "a ########## " * 10_000, "1. Occurrence Time" + " " * n, "1. Occurrence Time: x " * 20_000, "Case " * n, ";" * n]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.monotonic()
    assert docs.select(F.size(tx.split_labels(F.col("text"))).alias("n"), "doc_id").filter("doc_id < 2").agg(F.sum("n")).first()[0] == 2
    assert docs.select(F.max(F.length(tx.strip(F.col("text"))))).first()[0] > n
    assert {r[0]: r[1] for r in tx.split_hashes(docs).groupBy("doc_id").count().collect()}[4] == 10_000
    assert tx.split_cases(docs, numbered=False).count() > 0
    assert tx.extract_sections(docs.withColumnRenamed("text", "segment")).filter("occurrence_time <> ''").count() == 0
    assert time.monotonic() - began < 60


def test_hashes_after_hashes(spark):
    docs = spark.createDataFrame([(1, "a \n##########  ########## b"), (2, "##########" * 2), (3, "x  ##########")], "doc_id long, text string")
    got = [(r["doc_id"], r["seg_no"], r["segment"]) for r in tx.split_hashes(docs).orderBy("doc_id", "seg_no").collect()]
    assert got == [(1, 0, "a"), (1, 2, "b"), (3, 0, "x")]
