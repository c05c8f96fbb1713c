import random

import numpy as np
from test_learned import semi_global
from test_near import brute, edit, prose
from test_native import norm

import corpus_pipeline
from perilmap.llm import catalog, decontaminate, near_dedup, packing, quality, tokens
from perilmap.llm.common import held_out, shared_dir, table, written

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node int, _path string, _row int, digest int, bucket string, id long, gone_id long"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before, out = docs.columns, docs.count(), shared_dir(spark, "stages")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"{out}/{name}")
        if name != "pack":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "decontaminate", "pack"]


def rows_of(rng):
    """Good prose with copies, near copies, items of the benchmark, nulls and repeated rows; junk."""
    items = [prose(rng, 25) for _ in range(5)]
    texts = [prose(rng, rng.randint(30, 90)) for _ in range(40)]
    texts += [texts[k] for k in range(8)] + [texts[k].replace(" ", "  \n", 3) for k in range(4, 10)] + [edit(rng, texts[k], 1) for k in range(12)]
    texts += [f"{prose(rng, 30)} {edit(rng, items[k % 5], k % 2)} {prose(rng, 30)}" for k in range(7)] + ["$$$ ### " * rng.randint(10, 60) for _ in range(30)]
    texts += [None, None, "", " ", "one", " ".join(prose(rng, 1) for _ in range(3000))]
    ids = rng.sample(range(1000), len(texts))
    rows = [*zip(ids, texts, strict=True), (None, texts[0]), (None, prose(rng, 40)), (ids[1], texts[1]), (ids[1], texts[30]), (ids[2], prose(rng, 50))]
    rng.shuffle(rows)
    labels = [(i, int(t is not None and "$" not in t)) for i, t in rows if i is not None] * 3
    return rows, labels, items


def stored(spark, rows, labels, items):
    path = shared_dir(spark, "sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, None, 2, 3, "b", 4, 5) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_run_against_a_plain_version(spark):
    rng = random.Random(12)
    rows, labels, items = rows_of(rng)
    sf = stored(spark, rows, labels, items)
    docs, out = table(spark, sf, "documents"), shared_dir(spark, "stages")
    left, stages = list(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf), f"{out}/{name}")
        if name == "quality":
            held = {r["doc_id"] for r in before.filter(held_out()).collect()}
            known = [(t, y) for i, t in left for j, y in labels if i == j and i not in held]
            model = quality.fit(np.stack([quality.measures(t) for t, _ in known]), np.array([y for _, y in known], float))
            want = [(i, t) for i, t in left if model.score(quality.measures(t)[None])[0] >= quality.THRESHOLD]
            assert not any("$" in (t or "") for _, t in want) and len(want) > 40
        elif name == "exact":
            first = {}
            for i, t in ordered(left):
                first.setdefault(norm(t), i)
            want = [(i, next(t for j, t in left if j == i and norm(t) == key)) for key, i in first.items()]
        elif name == "near":
            # Ids may be null or stand for several texts: the plain version numbers the rows in the order of ids.
            numbered = list(enumerate(ordered(left)))
            classes = brute([(k, t) for k, (_, t) in numbered], near_dedup.Weights(*near_dedup.common_shingles(before, shared_dir(spark, "n"))))
            top = {c: numbered[c][1][0] for c in set(classes.values())}
            want = [r for k, r in numbered if classes[k] == k]
            assert len(top) == len(want) < len(left)
        elif name == "decontaminate":
            folds = [decontaminate.folded(x).decode() for x in items]
            hit = lambda t: any(semi_global(f, decontaminate.folded(t or "").decode()) <= decontaminate.budget(len(f)) for f in folds)
            want = [(i, t) for i, t in left if not hit(t)]
            assert len(want) < len(left)
        else:
            break
        got = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "exact":  # of texts that are equal but for white space any may be the one of the smallest id
            assert sorted((str(i), norm(t)) for i, t in got) == sorted((str(i), norm(t)) for i, t in want)
        else:
            assert ordered(got) == ordered(want)
        assert docs.columns == before.columns
        left, stages[name] = got, len(got)
    enc = tokens.Encoder(tokens.vocabulary_path("byte_bpe_50k.json"))
    lengths = {}
    for i, t in left:
        lengths.setdefault(i, []).append(len(enc.tok.encode(t or "", add_special_tokens=False).ids) + 1)
    packed = docs.collect()
    assert sum(r["length"] for r in packed) == sum(map(sum, lengths.values()))
    for i, sizes in lengths.items():
        assert sorted(n for s in sizes for _, n in packing.cut(s)) == sorted(r["length"] for r in packed if r["doc_id"] == i)
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 1024 and [o for o, _ in sorted(b)] == list(np.cumsum([0, *[n for _, n in sorted(b)]])[:-1]) for b in bins.values())
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in whole.collect()) == sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in packed)


def test_run_of_nothing(spark):
    rows, labels, items = rows_of(random.Random(1))
    assert corpus_pipeline.run(spark, stored(spark, [], labels, items)).count() == 0
    assert corpus_pipeline.run(spark, stored(spark, [(1, None), (None, "")], [], [])).count() in (0, 1)


def test_registered():
    assert [int(k[2:].split("_")[0]) for k in catalog.QUERIES] == list(range(1, 14))
