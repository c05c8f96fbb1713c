import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perilmap.llm import resampling
from perilmap.llm.catalog import ORACLE_SQL
from perilmap.llm.common import shared_dir

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
ODD = ["", " ", "a", "A-b_c", "Ünïcode ß 日本語", "x" * 300, "no\x00end", "a  b\n\nc", "12ab34", "😀😀 ok", "end.", ".start", "É é"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def words(text):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return WORD.findall(lower)


def grams(text, most):
    w = words(text)
    return [b" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def buckets_of(text, most, size):
    return [zlib.crc32(g) % size for g in grams(text, most)]


def brute(docs, target, percent=10, min_words=20, most=1, size=10_000, seed="2024:"):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text, most, size))
    for text in target:
        t.update(buckets_of(text, most, size))
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        found = buckets_of(text, most, size)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + size) / ((s[b] + 1) * (big_t + size)))) for b in found)
        h = int(hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize("most", [1, 2, 3])
@pytest.mark.parametrize("block", [7, 64, 1 << 19])
def test_automaton_against_a_pattern(monkeypatch, most, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    rng = random.Random(most)
    texts = ODD + [None] + ["".join(rng.choice("abZ9 .é\n") for _ in range(rng.randrange(90))) for _ in range(80)] + ["y" * 5000 + " z"]
    for column in (pa.array(texts), pa.array([None, "zz", *texts, "last"])[2:-1]):
        found, sizes, n_words = [[] for _ in texts], Counter(), Counter()
        for which, bucket, single in resampling.features(column, most, 997):
            for k, b in zip(which.tolist(), bucket.tolist(), strict=True):
                found[k].append(b)
                n_words[k] += single
        assert [sorted(f) for f in found] == [sorted(buckets_of(t, most, 997)) for t in texts]
        assert [n_words[k] for k in range(len(texts))] == [len(words(t)) for t in texts]


def test_crc_table():
    data = np.frombuffer(b"abcabcdefg", dtype=np.uint8)
    state = resampling._advance(np.full(2, 0xFFFFFFFF, np.uint32), data, np.array([0, 3]), np.array([3, 7]))
    assert [int(x) ^ 0xFFFFFFFF for x in state] == [zlib.crc32(b"abc"), zlib.crc32(b"abcdefg")]


@pytest.mark.parametrize("most", [1, 2])
def test_against_brute_force(spark, most):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 6))) for _ in range(80)]
    draw = lambda: " ".join(rng.choice(vocabulary[: rng.choice((10, 80))]) for _ in range(rng.randrange(5, 60)))
    docs = [(k, draw()) for k in range(300)] + [(1000 + k, t) for k, t in enumerate(ODD)] + [(2000, None), (None, draw()), (7, docs_text := draw()), (7, docs_text)]
    target = [draw() for _ in range(20)] + [None, ""]
    got = resampling.resample(frame(spark, docs).repartition(5), frame(spark, [(0, t) for t in target]), shared_dir(spark, "t"), percent=15, most_words=most, buckets=500)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(docs, target, 15, 20, most, 500)


def test_ties_go_to_the_smaller_id_over_partitions(spark):
    rows = spark.range(1000).select((F.col("id") % 500).alias("doc_id"), F.lit(30).cast("long").alias("n_words"), F.lit(30).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), (F.col("id") % 3).alias("score"))
    got = resampling.drawn(rows, shared_dir(spark, "t"), percent=50).filter("rank IS NOT NULL").orderBy("rank").collect()
    want = sorted(((-(k % 3), k % 500) for k in range(1000)))[:500]
    assert [(-r.score, r.doc_id) for r in got] == want and [r["rank"] for r in got] == list(range(1, 501))


def test_empty_tables_and_clashing_columns(spark):
    none = frame(spark, [])
    assert resampling.resample(none, none, shared_dir(spark, "t")).count() == 0
    docs = frame(spark, [(1, "a b " * 20), (2, None)]).withColumn("rank", F.lit("x")).withColumn("part", F.lit(1)).withColumn("at", F.lit(2))
    got = resampling.resample(docs, none, shared_dir(spark, "t"), percent=100).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_features, r["rank"]) for r in got] == [(1, 40, 1), (2, 0, None)]


def test_too_many_buckets_are_refused(spark):
    with pytest.raises(ValueError):
        resampling.bucket_gains(frame(spark, []), frame(spark, []), buckets=resampling.MOST_BUCKETS + 1)


def test_long_text(spark):
    text = "Word " * 400_000 + "x" * 2_000_000
    [r] = resampling.resample(frame(spark, [(1, text)]), frame(spark, [(1, "word")]), shared_dir(spark, "t"), percent=100).collect()
    assert (r.n_words, r["rank"]) == (400_001, 1) and str(tuple(r)) in brute([(1, text)], ["word"], 100)


def test_query_and_sql(spark, sf):
    import duckdb

    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = sorted(map(str, duckdb.sql(ORACLE_SQL["op11_resampling"]).fetchall()))
    assert want == sorted(str(tuple(r)) for r in resampling.op11_resampling(spark, sf).collect())
