import collections
import random

import numpy as np
import pytest

from perilmap.llm import near_dedup
from perilmap.llm.common import shared_dir
from perilmap.llm.words import shingles, word_hashes


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edit(rng, text, n):
    w = text.split()
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [prose(rng, 1)], [w[k], prose(rng, 1)]])
    return " ".join(w)


def brute(rows, weights):
    """Class of each document from the weighted Jaccard similarity of all pairs."""
    first, sets = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = near_dedup.text_words(t)
        key = words.tobytes()
        if key not in first:
            first[key] = i
            s, w = weights.of(words)
            sets[i] = s.tobytes() + w.tobytes()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            if near_dedup.similarity(sets[ids[a]], sets[ids[b]]) >= near_dedup.SIMILARITY:
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: find(first[near_dedup.text_words(t).tobytes()]) for i, t in rows if i is not None}


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for g in range(25):
        base = prose(rng, rng.randint(3, 150))
        rows.append((1000 * g, base))
        rows += [(1000 * g + k + 1, edit(rng, base, rng.randint(0, 6))) for k in range(rng.randint(0, 8))]
    rows += [(90_000 + k, None) for k in range(2)] + [(90_002, ""), (90_003, "two words"), (90_004, " two\twords "), (90_005, "Two Words")]
    line = prose(rng, 12)
    rows += [(91_000 + k, line + "\n" + prose(rng, 40)) for k in range(60)]
    hot = prose(rng, 80)
    rows += [(95_000 + k, edit(rng, hot, 1)) for k in range(150)] + [(96_000 + k, edit(rng, hot, 7)) for k in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("members", [16])
def test_classes_against_all_pairs(spark, monkeypatch, members):
    monkeypatch.setattr(near_dedup, "MEMBERS", members)
    monkeypatch.setattr(near_dedup, "HEADS", 3)
    rows = corpus(11)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(df, shared_dir(spark, "n")).collect()}
    want = brute(rows, near_dedup.Weights(*near_dedup.common_shingles(df, shared_dir(spark, "n"))))
    assert got == want
    kept = near_dedup.drop_near(df, shared_dir(spark, "n"))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_null_and_repeated_ids(spark):
    rng = random.Random(1)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(None, a), (5, a), (5, b), (7, b), (None, "alone here"), (9, a)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, key int")
    got = near_dedup.near_classes(df, shared_dir(spark, "n")).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in got) == [(-1, -1), (-1, 5), (5, 5), (5, 5), (7, 5), (9, 5)]
    # One id with two texts: the row that is first of its class stays, and so does the row of the other text.
    kept = near_dedup.drop_near(df, shared_dir(spark, "n"))
    assert kept.columns == df.columns and sorted(r["key"] for r in kept.collect()) == [1, 2, 4]
    assert near_dedup.near_classes(df.limit(0), shared_dir(spark, "n")).count() == 0
    assert near_dedup.drop_near(df.limit(0), shared_dir(spark, "n")).count() == 0


def test_a_text_of_a_repeated_id_without_a_copy_stays(spark):
    rng = random.Random(2)
    a, b = prose(rng, 60), prose(rng, 60)
    df = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"] == b) for r in near_dedup.drop_near(df, shared_dir(spark, "n")).collect()) == [(3, False), (5, True)]


def test_very_long_texts(spark):
    rng = random.Random(4)
    words = [prose(rng, 1) for _ in range(3000)]
    one, two = (" ".join(rng.choice(words) for _ in range(100_000)) for _ in range(2))
    near = one[: len(one) // 2] + " changed here " + one[len(one) // 2 :]
    weights, drawn = near_dedup.Weights(np.empty(0, np.uint64), np.empty(0, np.int64), 3), near_dedup.draws()
    x, y, z = (near_dedup.sketch(*weights.of(near_dedup.text_words(t)), drawn) for t in (one, two, near))
    assert (x == y).sum() == 0 and (x == z).sum() >= 95
    df = spark.createDataFrame([(1, one), (2, two), (3, near)], "doc_id long, text string")
    assert sorted((r[0], r[1]) for r in near_dedup.near_classes(df, shared_dir(spark, "n")).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_links_that_only_later_rounds_find(spark):
    """A bucket of several groups of which none is close to the first head."""
    rng = random.Random(6)
    line = prose(rng, 60)
    rows = []
    for g in range(12):
        base = line + " " + prose(rng, 40)
        rows += [(100 * g + k, edit(rng, base, k % 3)) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in near_dedup.near_classes(df, shared_dir(spark, "n")).collect()}
    want = brute(rows, near_dedup.Weights(*near_dedup.common_shingles(df, shared_dir(spark, "n"))))
    assert {i: r["class_id"] for i, r in got.items()} == want and len(set(want.values())) < len(want)
    assert all(r["n_links"] > 0 for r in got.values() if sum(c == r["class_id"] for c in want.values()) > 1 and len({t for i, t in rows if want[i] == r["class_id"]}) > 1)


def test_exact_document_frequencies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "COUNTED", 24)
    monkeypatch.setattr(near_dedup, "CANDIDATES", 60)
    rows = corpus(12)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    h, n, total = near_dedup.common_shingles(df, shared_dir(spark, "n"), 1 / 8)
    df_of = collections.Counter(x for _, t in rows for x in set(shingles(near_dedup.text_words(t)).tolist()))
    assert total == len(rows) and dict(zip(h.tolist(), n.tolist(), strict=True)) == {k: v for k, v in df_of.items() if v >= len(rows) / 8}


def test_sketches_estimate_the_similarity():
    rng = random.Random(3)
    weights = near_dedup.Weights(np.empty(0, np.uint64), np.empty(0, np.int64), 100)
    errors, drawn = [], near_dedup.draws()
    for _ in range(40):
        base = prose(rng, 120)
        pair = [weights.of(near_dedup.text_words(t)) for t in (base + " " + base[:200], edit(rng, base, 4))]
        s = near_dedup.similarity(*(x.tobytes() + w.tobytes() for x, w in pair))
        errors.append(np.mean(near_dedup.sketch(*pair[0], drawn) == near_dedup.sketch(*pair[1], drawn)) - s)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    df = spark.createDataFrame([(a, b) for a, b in edges if a != b], "a long, b long")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r["node"]: r["label"] for r in near_dedup.components(df, shared_dir(spark, "c")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_words_in_chunks(monkeypatch):
    from perilmap.llm import words as w

    data = np.frombuffer(("Straße the THE " * 50).encode(), np.uint8)
    whole = word_hashes(data)
    monkeypatch.setattr(w, "_CHUNK", 37)
    assert all((a == b).all() for a, b in zip(whole, w.word_hashes(data), strict=True))
    assert whole[0][1] == whole[0][2] and len(shingles(whole[0][:3])) == 1 and len(shingles(whole[0][:0])) == 0


@pytest.mark.parametrize("shingles_of_a_part", [60, 10**6])
def test_every_shingle_has_its_document_frequency(spark, monkeypatch, shingles_of_a_part):
    """Also shingles of two documents among many, wherever their documents are at home."""
    monkeypatch.setattr(near_dedup, "CANDIDATES", shingles_of_a_part)
    monkeypatch.setattr(near_dedup, "COUNTED", 50)
    rows = corpus(13)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    h, n, total = near_dedup.common_shingles(df, shared_dir(spark, "n"))
    df_of = collections.Counter(x for _, t in rows for x in set(shingles(near_dedup.text_words(t)).tolist()))
    assert total == len(rows) and dict(zip(h.tolist(), n.tolist(), strict=True)) == {k: v for k, v in df_of.items() if v > 1}
    rare = [k for k, v in df_of.items() if 1 < v < len(rows) / 64]
    weights = near_dedup.Weights(h, n, total)
    assert rare and all(weights.idf[h.tolist().index(k)] == pytest.approx(1 + np.log(total / df_of[k]) / np.log(total)) for k in rare[:50])


def test_a_rare_passage_of_several_documents_weighs_less_than_their_own_words(spark):
    """Five of 400 documents share 89 of 99 shingles: 0.82 by count, 0.79 by frequencies. A shingle in fewer than 1/64 of the documents counts too."""
    rng = random.Random(14)
    passage = prose(rng, 93)
    rows = [(k, passage + " " + prose(rng, 10)) for k in range(5)] + [(100 + k, prose(rng, 20)) for k in range(395)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(df, shared_dir(spark, "n")).collect()}
    assert got == {i: i for i, _ in rows}


def test_the_pipeline_keeps_documents_that_share_a_rare_passage(spark, sf):
    """As above, in the pipeline's near stage: all of them stay."""
    import corpus_pipeline

    rng = random.Random(15)
    passage = prose(rng, 93)
    rows = [(k, passage + " " + prose(rng, 10)) for k in range(5)] + [(100 + k, prose(rng, 20)) for k in range(395)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, df, sf).collect()) == sorted(i for i, _ in rows)
