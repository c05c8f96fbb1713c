import hashlib
import random

import pytest
from pyspark.sql import functions as F

from perilmap.llm import fim
from perilmap.llm.catalog import ORACLE_SQL

ODD = ["", "a", "añ😀b\n\nß", "x<P>y", "<S", "<M>", "a < b > c", "<", "<<P", "  ", "\t\r\n", "日本語 テスト です", "é́", "\x00a\x00", "line one\nline two\n\nend"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def plain(doc_id, text, unit="char"):
    """The contract, step by step over a Python string."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:i], text[i:j], text[j:]
    if h4 % 100 < 20:
        return n, "spm", i, j - i, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", i, j - i, f"<P>{pre}<S>{suf}<M>{mid}"


def test_as_the_contract_says(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab <>PSM\n é😀") for _ in range(rng.randrange(60))) for _ in range(300)] + [None]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    made = fim.fill_in_middle(frame(spark, rows)).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    got = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in made)
    want = sorted((str(k), n, form, str(a), str(b), out) for k, t in rows for n, form, a, b, out in [plain(k, t)])
    assert got == want
    assert sorted((str(r.doc_id), r.back) for r in made) == sorted((str(k), t or "") for k, t in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["word", "line"])
def test_cuts_fall_between_units(spark, unit):
    text = "Some words, more words\nand  a line\n\nthe end"
    plan = fim.Plan(fim_percent=100, unit=unit)
    made = fim.fill_in_middle(frame(spark, [(k, text) for k in range(60)]), plan).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    kind = lambda c: 0 if c.isalnum() else 1 if c.isspace() else 2
    if unit == "line":
        allowed = {0, len(text)} | {k + 1 for k, c in enumerate(text) if c == "\n"}
    else:
        allowed = {0, len(text)} | {k for k in range(1, len(text)) if kind(text[k]) != kind(text[k - 1])}
    assert all(r.back == text and r.n == len(allowed) - 1 and {r.prefix_chars, r.prefix_chars + r.middle_chars} <= allowed for r in made)
    assert len({r.prefix_chars for r in made}) > 3


def test_shares_are_drawn_by_hash(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text of a few words").alias("text"))
    counts = {r.form: r["count"] for r in fim.fill_in_middle(rows).groupBy("form").count().collect()}
    assert 320 < counts["plain"] < 480 and 620 < counts["spm"] < 820


def test_sentinels_that_could_be_mistaken_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "bc", "d"), ("aba", "x", "y"), ("<PP>", "PP", "x")):
        with pytest.raises(ValueError):
            fim.Plan(prefix=marks[0], suffix=marks[1], middle=marks[2])
    with pytest.raises(ValueError):
        fim.Plan(unit="token")


def test_long_text_empty_table_and_clashing_columns(spark):
    long = "añ😀 <" * 400_000
    docs = frame(spark, [(1, long)]).withColumn("output", F.lit("x")).withColumn("form", F.lit(3)).withColumn("n", F.lit("y"))
    [r] = fim.fill_in_middle(docs, fim.Plan(fim_percent=100)).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert r.n == len(long) and r.back == long and len(r.output) == len(long) + 9
    assert fim.fill_in_middle(frame(spark, [])).count() == 0


def test_query_and_sql(spark, sf):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(map(str, duckdb.sql(ORACLE_SQL["op13_fill_in_middle"]).fetchall()))
    assert want == sorted(str(tuple(r)) for r in fim.op13_fill_in_middle(spark, sf).collect())
