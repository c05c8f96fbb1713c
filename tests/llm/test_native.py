import datetime
import hashlib
import math
import random
import re
import time
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perilmap.llm import chat, exact_dedup, licenses, pii
from perilmap.llm.common import shared_dir

# --- exact dedup --------------------------------------------------------------------------

DOCS = [(4, "a  b"), (2, "a\t\nb"), (7, "a b"), (1, None), (3, ""), (5, " "), (6, "a b"), (8, "A b"), (2, "a b"), (9, "x" * 200_000), (10, "x" * 200_000)]


def docs(spark, rows, schema="doc_id long, text string, digest string"):
    return spark.createDataFrame([(*r, "clash") for r in rows], schema).repartition(3)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups(spark):
    rows = exact_dedup.exact_groups(docs(spark, DOCS), shared_dir(spark, "e")).collect()
    assert len(rows) == len(DOCS)
    groups = {}
    for i, t in DOCS:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in DOCS)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == want


def test_one_row_stays(spark):
    path = shared_dir(spark, "in")
    docs(spark, DOCS).write.parquet(path)
    df = spark.read.parquet(path)
    assert sum(r["kept"] for r in exact_dedup.exact_groups(df, shared_dir(spark, "e")).collect()) == len({norm(t) for _, t in DOCS})
    kept = exact_dedup.drop_copies(df, shared_dir(spark, "e"))
    assert kept.columns == ["doc_id", "text", "digest"] and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 6, 8, 9]


def test_one_row_stays_of_rows_from_no_file(spark):
    """In-memory rows, a union and a join that repeats rows have no places of their own."""
    path, kept = shared_dir(spark, "in"), [1, 2, 5, 6, 8, 9]
    df = docs(spark, DOCS)
    df.write.parquet(path)
    stored = spark.read.parquet(path)
    for several in (df, stored.union(stored), stored.join(spark.createDataFrame([("clash",)] * 3, "digest string"), "digest").select(*df.columns)):
        some = exact_dedup.drop_copies(several, shared_dir(spark, "e"))
        assert some.columns == df.columns and sorted(r["doc_id"] for r in some.collect()) == kept
        assert sum(r["kept"] for r in exact_dedup.exact_groups(several, shared_dir(spark, "e")).collect()) == len(kept)


def test_columns_of_any_name(spark):
    path = shared_dir(spark, "in")
    spark.createDataFrame([(1, "a", "p", 1, 2, 3, 4), (2, "a", "p", 1, 2, 3, 4), (2, "b", None, 1, 2, 3, 4)], "doc_id long, text string, _path string, _row int, path int, row int, digest int").write.parquet(path)
    df = spark.read.parquet(path)
    assert sorted((r["doc_id"], r["kept"]) for r in exact_dedup.exact_groups(df, shared_dir(spark, "e")).collect()) == [(1, True), (2, False), (2, True)]
    kept = exact_dedup.drop_copies(df, shared_dir(spark, "e"))
    assert kept.columns == df.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, "a"), (2, "b")]


def test_state_goes_on(spark):
    """A second run on the same checkpoint takes up what is new and keeps the smallest id."""
    out, src = shared_dir(spark, "s"), shared_dir(spark, "src")
    exact_dedup.digests(docs(spark, [(5, "a"), (6, "b")])).write.parquet(src)
    schema = spark.read.parquet(src).schema
    first = {r["digest"]: (r["first"]["id"], r["n"]) for r in exact_dedup.keyed_state(spark.readStream.schema(schema).parquet(src), out).collect()}
    exact_dedup.digests(docs(spark, [(2, "a"), (9, "b")])).write.mode("append").parquet(src)
    second = {r["digest"]: (r["first"]["id"], r["n"]) for r in exact_dedup.keyed_state(spark.readStream.schema(schema).parquet(src), out).collect()}
    assert sorted(first.values()) == [(5, 1), (6, 1)] and sorted(second.values()) == [(2, 2), (6, 2)]


def test_differing_texts_are_told(spark, monkeypatch):
    """Digests that collide (here: of the first letter) are grouped by the text."""
    state = spark.createDataFrame([("d", 2)], "digest string, n long")
    assert exact_dedup.differing(docs(spark, [(1, "a")]), state).count() == 0
    short = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(short(c, n), 1, 1))
    rows = [(i, f"text {i % 20}") for i in range(60)]
    got = exact_dedup.exact_groups(docs(spark, rows), shared_dir(spark, "e")).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == sorted((i, i % 20, 3) for i in range(60))


def test_empty_table(spark):
    assert exact_dedup.exact_groups(docs(spark, []), shared_dir(spark, "e")).count() == 0


# --- chat ---------------------------------------------------------------------------------

ALPHABET = st.text(alphabet="ab\\#</turn> :\n", max_size=18) | st.sampled_from(["</turn>", "<\\/turn>", "### ", "#\\## ", "\\", "a\\\\b", chat.FIXTURE, "</turn>\n### user: x"])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b", "### x", "y:", "z\n</turn>"]), ALPHABET), min_size=1, max_size=40))
def test_round_trip(spark, turns):
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.format_conversations(df)).first()
    loss = "".join(t for role, t in turns if role == "assistant")
    assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_nulls_ties_and_long_texts(spark):
    rows = [(1, 0, "user", None), (1, None, None, "first"), (1, 0, "user", "b"), (1, 0, "user", "b"), (None, 1, "assistant", "x" * 100_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, body string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1]["n_turns"] == 4 and got[None]["loss_chars"] == 100_000
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\nfirst\nuser\n\nuser\nb\nuser\nb\n").hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["op2", "op10"])
def test_native_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    run, sql = (exact_dedup.op2_exact_dedup, exact_dedup.ORACLE) if name == "op2" else (chat.op10_chat_format, chat.ORACLE)
    got, want = run(spark, sf).toPandas(), con.sql(sql).df()
    key = sorted(want.columns)
    assert sorted(map(tuple, got[key].astype(str).values)) == sorted(map(tuple, want[key].astype(str).values))


# --- personal data ------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


KEY = "a key of the tests"
TEXTS = [
    "card 4952935900253052, 4952-9359-0025-3052 not 9807915762804490 end", "mail und.34@mail7.example.com. token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\"###", "ip 97.51.17.173. no 999.1.1.1 v4.0. call +1 (017) 555-7713!",
    "born 1987-02-28 31.12.1999 28/02/2001 not 31/02/2001 2020-13-01 ssn 123-45-6789", "", None, "97.51.17.173", "password=5aaa9ac60bfe74b24b TOKEN = \"B44E15E09FD311C3CF3163B66D5A9875B883D8CE\"!!", "plain words 12 of 2 1,234.5",
]


def test_pseudonyms(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, _other string")
    out = pii.pseudonymised(df, KEY)
    assert out.columns == ["doc_id", "text", "_other", "n_values"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert [rows[i]["n_values"] for i in range(9)] == [2, 2, 2, 4, 0, 0, 1, 2, 0]
    for i in (4, 5, 8):
        assert rows[i]["text"] == TEXTS[i]
    a, b = re.findall(r"\d{16}|\d{4}(?:-\d{4}){3}", rows[0]["text"])[:2]
    assert a == b.replace("-", "") and luhn(a) and a != "4952935900253052" and "9807915762804490" in rows[0]["text"]
    assert re.fullmatch(r'mail [a-z]{3}\.\d\d@mail7\.example\.com\. token = "[0-9a-f]{40}"###', rows[1]["text"]) and "b44e15" not in rows[1]["text"]
    ip = re.search(r"ip ([\d.]+)\. no 999\.1\.1\.1 v4\.0\. call \+1 \(\d{3}\) \d{3}-\d{4}!", rows[2]["text"])[1]
    assert rows[6]["text"] == ip and all(0 <= int(x) <= 255 for x in ip.split("."))
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d \d\d\.\d\d\.\d{4} \d\d/\d\d/\d{4} not 31/02/2001 2020-13-01 ssn \d{3}-\d\d-\d{4}", rows[3]["text"])
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymised(out.drop("n_values"), KEY, undo=True).collect()}
    assert back == dict(enumerate(TEXTS))
    assert pii.pseudonymised(df, key="other").filter("doc_id = 6").first()["text"] != ip
    assert pii.pseudonymised(df.limit(0), KEY).count() == 0


MISSED = {
    "call 555-123-4567 or 555.123.4567, 1 555 123 4567": 3, "call +1 555 123 4567, +44 20 7946 0958": 2, "+442079460958; +44 (0)20 7946 0958; +33 1 23 45 67 89": 3, "020 7946 0958, 07911 123456 and 01 23 45 67 89": 3, "(020) 7946 0958": 1,
    "0044 20 7946 0958, 0045 12 34 56 78": 2, "on 12/25/2020, 02/29/2000": 2, "password: P@ss1! token=ab12 secret = 'two words' api_key=\"x\"": 4, "password = P@ssw0rd,with;more": 1,
}


def test_what_is_no_personal_data_stays(spark):
    texts = ["version 10.0.3.254, v1.2.3.4 Release: 1.22.33.44 build 7.7.7.7", "000-12-3456 666-12-3456 900-12-3456 123-00-6789 123-45-0000", "9807915762804499 1234567812345670", "31.02.1999 0000-00-00", "x" * 300_000]
    df = spark.createDataFrame([(i, t, "a", "b", 7) for i, t in enumerate(texts)] * 2 + [(None, "010.1.2.3", "a", "b", 7)], "doc_id long, text string, found string, new string, n_values int")
    out = pii.pseudonymised(df, KEY)
    assert out.columns == [*df.columns, "n_values_"]
    assert sorted(map(tuple, out.drop("n_values_").collect()), key=str) == sorted(map(tuple, df.collect()), key=str) and out.filter("n_values_ > 0").count() == 0
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymised(df, "")
    old = pii.pseudonymised(spark.createDataFrame([(1, "1066-10-14, 2525-01-01 and 123-45-6789")], "doc_id long, text string"), KEY).first()
    a, b, area, group, serial = re.match(r"(\d{4})-\d\d-\d\d, (\d{4})-\d\d-\d\d and (\d{3})-(\d\d)-(\d{4})$", old["text"]).groups()
    assert old["n_values"] == 3 and 1000 <= int(a) < 1400 and 2200 <= int(b) < 2600 and area not in ("000", "666") and int(area) < 900 and int(group) and int(serial)


def test_feistel_against_a_plain_one(spark):
    """Numbers, dates and cards as a few lines of Python permute them."""

    def word(kind, *parts):
        return int(hashlib.sha256("|".join([KEY, kind, *map(str, parts)]).encode()).hexdigest()[:15], 16)

    def number(x, y, mx, my, kind):
        for i in range(pii.ROUNDS):
            x, y, mx, my = y, (x + word(kind, i, mx, y) % mx) % mx, my, mx
        return x, y

    def digits(d, kind):
        h = len(d) // 2
        x, y = number(int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h), kind)
        return f"{x:0{h}}{y:0{len(d) - h}}"

    def check(payload):
        return next(c for c in "0123456789" if luhn(payload + c))

    def day(d):
        n = (d - datetime.date(1800, 1, 1)).days
        x, y = number(n // 773, n % 773, 189, 773, "date")
        return datetime.date(1800, 1, 1) + datetime.timedelta(x * 773 + y)

    rng = random.Random(9)
    want = {}
    for _ in range(40):
        a, b, c, e = (rng.randrange(256) for _ in range(4))
        x, y = number(a * 256 + b, c * 256 + e, 65536, 65536, "ip")
        want[f"{a}.{b}.{c}.{e}"] = f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"
        d = datetime.date(1800, 1, 1) + datetime.timedelta(rng.randrange(146_097))
        want[d.isoformat()] = day(d).isoformat()
        p = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        n = p[:4] + digits(p[4:], "card")
        want[p + check(p)] = n + check(n)
    df = spark.createDataFrame([(t,) for t in want], "text string")
    assert {r["text"]: r["new"] for r in df.select("text", pii.pseudonym(F.col("text"), KEY).alias("new")).collect()} == want


def test_usual_shapes_are_found(spark):
    """Telephone numbers without parentheses, dates with the month first and secrets of other characters."""
    df = spark.createDataFrame(list(enumerate(MISSED)), "doc_id long, text string")
    out = pii.pseudonymised(df, KEY)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert [rows[i]["n_values"] for i in range(len(MISSED))] == list(MISSED.values())
    for i, text in enumerate(MISSED):
        assert re.sub(r"\d", "0", re.sub("[A-Za-z]", "x", rows[i]["text"])) == re.sub(r"\d", "0", re.sub("[A-Za-z]", "x", text))
    assert rows[1]["text"].startswith("call +1 ") and ", +44 " in rows[1]["text"]
    assert all(int(m) <= 12 < int(d) for m, d in re.findall(r"(\d\d)/(\d\d)/\d{4}", rows[6]["text"]))
    assert {r["doc_id"]: r["text"] for r in pii.pseudonymised(out.drop("n_values"), KEY, undo=True).collect()} == dict(enumerate(MISSED))


def test_shapes_can_be_undone_whatever_their_digits(spark):
    rng = random.Random(8)
    shapes = ["000-000-0000", "1 000 000 0000", "+000000000000", "+00 000 0000 00", "000 0000 0000", "00000 000000", "0000 00 0000 0000", "(000) 0000 0000", "00/00/0000", "00.00.0000", "000-00-0000", "0000 000000 00000", "0000 0000 0000 0000", "00000 555-000-0000"]
    texts = [f"x {re.sub('0', lambda _: rng.choice('0012345678'), rng.choice(shapes))} y" for _ in range(1500)]
    out = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY)
    assert {r["doc_id"]: r["text"] for r in pii.pseudonymised(out.drop("n_values"), KEY, undo=True).collect()} == dict(enumerate(texts))


def test_permutation_is_one_to_one(spark):
    every = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d")).select(pii.permute_digits(F.col("d"), "k", "t").alias("e"))
    assert every.distinct().count() == 1000 and every.filter("length(e) <> 3").count() == 0


# --- licences -----------------------------------------------------------------------------


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (2, "a/b/c.py", "x"), (3, "a/d.py", "code\n# Licensed under the Apache License, Version 2.0\nmore"),
        (4, "z.txt", None), (5, None, "Released under the MIT License."), (6, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (7, "a/b/e/f/g.c", ""), (8, "ab/x.c", "the word license alone"), (9, "a/x.c", "LICENSED!! UNDER!! CC!! BY-NC!! 4.0.!!"), (2, "a/b/c.py", "x"),
    ]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "file long, path string, text string, score double")
    out = licenses.scan(df, shared_dir(spark, "l")).collect()
    assert len(out) == len(rows)
    got = {r["file"]: (r["licence"], r["origin"], r["source_dir"]) for r in out}
    assert got == {
        1: ("MIT", "own", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("Apache-2.0", "own", None), 4: (None, "none", None), 5: ("MIT", "own", None),
        6: ("GPL-3.0", "own", None), 7: ("GPL-3.0", "inherited", "a/b"), 8: (None, "none", None), 9: ("CC-BY-NC-4.0", "own", None),
    }
    assert licenses.scan(df.limit(0), shared_dir(spark, "l")).count() == 0


def test_texts_of_one_path_and_odd_texts(spark):
    rows = [(1, "a/x.py", "Licensed under the MIT License"), (1, "a/x.py", "nothing here"), (2, "a/y.py", "w " * 150_000 + "\nReleased under the MIT License.\n" + "license " * 50_000), (3, "c/z.py", "Licensed under the MIT License\nReleased under the MIT License"), (3, "c/z.py", "Licensed under the MIT License\nReleased under the MIT License")]
    out = sorted((r["file"], r["licence"], r["origin"]) for r in licenses.scan(spark.createDataFrame(rows, "file long, path string, text string"), shared_dir(spark, "l")).fillna("").collect())
    assert out == [(1, "", "none"), (1, "MIT", "own"), (2, "MIT", "own"), (3, "MIT", "own"), (3, "MIT", "own")]


def test_cosine_against_a_plain_one(spark):
    rng = random.Random(5)
    files = [f"{' '.join(rng.sample('license mit under the released licensed apache version of gnu general public copyright terms some'.split(), rng.randint(2, 9)))}" for _ in range(120)]
    df = spark.createDataFrame([(k, f"d/{k}", t) for k, t in enumerate(files)], "file long, path string, text string")
    known = licenses.templates(spark)
    out_dir = shared_dir(spark, "l")
    got = {r["file"]: (r["licence"], r["score"]) for r in licenses.scan(df, out_dir).filter("origin = 'own'").collect()}
    terms = lambda t: [w for w in re.split(r"[^a-z0-9.]+", re.sub(r"\.(?![0-9])|(?<![0-9])\.", " ", t.lower())) if w]
    df_of = lambda w: sum(w in terms(t) for t in files)
    idf = lambda w: math.log((len(files) + 1) / (df_of(w) + 1)) + 1
    vector = lambda ws: {w: (1 + math.log(ws.count(w))) * idf(w) for w in set(ws)}
    cosine = lambda a, b: sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    folded = {}
    for r in known.collect():
        folded.setdefault((r["template"], r["licence"]), {})[r["term"]] = r["tf"] * idf(r["term"])
    for k, t in enumerate(files):
        best = min((-round(cosine(vector(terms(t)), v), 6), name) for (_, name), v in folded.items())
        if re.search(licenses.ANCHOR, t) and -best[0] >= licenses.LEAST + 1e-6:
            assert got[k][0] == best[1] and abs(got[k][1] + best[0]) < 2e-6
        elif -best[0] < licenses.LEAST - 1e-6:
            assert k not in got
    assert len(got) > 10


def test_licences_among_common_words(spark):
    """Words outside the templates have their own frequency; full texts and headers of several lines are found."""
    rng = random.Random(4)
    common = "this file is see for details and the of in to a".split()
    rest = [f"w{k}" for k in range(400)]
    prose = [(k, f"p/{k}.txt", " ".join([*rng.sample(common, 9), *rng.sample(rest, 30)]) + ("\nthe license of w1 and w2 see w3 for w4" if k % 50 == 0 else "")) for k in range(2000)]
    text = lambda name: (Path(licenses.__file__).parent / "licence_texts" / f"{name}.txt").read_text()
    header = "/*\n * Permission is hereby granted, free of charge,\n * to any person obtaining a copy of this\n * software and associated documentation files\n */\n\nint main() {}"
    rows = [
        (9001, "s/a.c", "// This file is licensed under the MIT License; see LICENSE for details.\nint x;"), (9002, "s/b.c", "Copyright (c) 2021 Jane Doe. Licensed under the MIT License.\nint y;"), (9003, "s/h.c", header),
        (9004, "m/LICENSE", text("MIT").replace("(c)", "(c) 2021 Jane Doe")), (9005, "m/x.c", ""), (9006, "g/COPYING", text("GPL-3.0")), (9007, "b/LICENSE.txt", text("BSD-3-Clause")),
    ]
    out = licenses.scan(spark.createDataFrame(prose + rows, "file long, path string, text string"), shared_dir(spark, "l")).collect()
    got = {r["file"]: r["licence"] for r in out}
    assert [got[k] for k in range(9001, 9008)] == ["MIT", "MIT", "MIT", "MIT", "MIT", "GPL-3.0", "BSD-3-Clause"]
    assert not any(got[k] for k in range(2000))


def test_nearest_ancestor_against_brute_force(spark):
    rng = random.Random(3)
    dirs = sorted({"/".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(40)} | {""})
    speaking = {d: f"L{k}" for k, d in enumerate(rng.sample(dirs, 12))}

    def nearest(d):
        while d not in speaking and d:
            d = d.rpartition("/")[0]
        return speaking.get(d)

    got = licenses.inherited(spark.createDataFrame([(d,) for d in dirs], "dir string"), spark.createDataFrame([(d, x, 1.0) for d, x in speaking.items()], "source_dir string, licence string, score double"))
    assert {r["dir"]: r["licence"] for r in got.collect()} == {d: nearest(d) for d in dirs if nearest(d)}


def plain_scan(files):
    """{file: (licence, score)} of own licences, all in Python: units, document frequencies, cosines."""
    import regex

    words = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}.]+", regex.sub(r"\.(?![0-9])|(?<![0-9])\.", " ", t.lower())) if w]
    short = list(enumerate(licenses.TEMPLATES))
    full = [(p.stem, p.read_text()) for p in sorted((Path(licenses.__file__).parent / "licence_texts").glob("*.txt"))]
    known = [(name, Counter(words(text))) for _, (name, text) in [*short, *enumerate(full)]]
    seen = Counter(w for _, t in files for w in set(words(t or "")))
    vector = lambda counts: {w: (1 + math.log(n)) * (math.log((len(files) + 1) / (seen[w] + 1)) + 1) for w, n in counts.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(name, v, norm(v)) for name, v in ((name, vector(c)) for name, c in known)]
    anchor = re.compile(licenses.ANCHOR)
    out = {}
    for k, text in files:
        if not text or not anchor.search(text):
            continue
        paragraphs = [p for p in regex.split(r"\n(?:[^\p{L}\p{N}\n]*\n)+", text) if anchor.search(p)]
        units = {u.strip(" ") for p in paragraphs for u in (p, *re.split(r"[.;!?]+(?:\s+|$)", p), *p.split("\n")) if anchor.search(u)}
        found = []
        for u in units:
            v = vector(Counter(words(u)))
            found += [(-round(sum(x * v.get(w, 0.0) for w, x in t.items()) / (n * norm(v)), 6), name) for name, t, n in vectors if not t.keys().isdisjoint(v)]
        best = min(found, default=(0, None))
        if -best[0] >= licenses.LEAST:
            out[k] = (best[1], -best[0])
    return out


def test_whole_scan_against_brute_force(spark, sf):
    """The query's own licences on all documents of the table, and nothing inherited without licence files."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = licenses.op3_license_scan(spark, sf).collect()
    assert len(rows) == len(docs) and {r["origin"] for r in rows} == {"own", "none"}
    got = {r["doc_id"]: (r["licence"], r["score"]) for r in rows if r["origin"] == "own"}
    want = plain_scan(docs)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want) and len(want) > 3


def test_query_inherits_where_a_source_is_a_licence_file(spark, tmp_path):
    """The query's own paths: a source that names a licence file speaks for the directory that the source lies in, and for no other."""
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, mit, "en", "org/repo/LICENSE"), (2, "code", "en", "org/repo/src/x.py"), (3, None, "fr", "org/repo"), (4, f"text\n{apache}", "en", "org/repo/y.py"), (5, "code", "en", "org/repository"),
        (6, apache, None, "https://h.example/lib/COPYING.txt"), (7, "code", None, "https://h.example/lib/a/z"), (8, "code", "en", "https://h.example/z"), (9, "nothing of this kind", "en", "org/bare/LICENSE"), (10, "code", "en", "org/bare/x"),
        # none of these is a file in a directory: names of collections, a host, the top
        (11, mit, "en", "license"), (12, mit, "en", "https://license.example"), (13, mit, "en", "/LICENSE"), (14, mit, "en", "org/license-texts"), (15, mit, "en", "org/repo2"), (16, "code", "en", "org/repo2"), (17, "code", None, None), (18, "", "en", "/x/y"),
    ]
    spark.createDataFrame([(k, t, lang, src, len(t or "")) for k, t, lang, src in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = licenses.op3_license_scan(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    inherited = {r["doc_id"]: (r["licence"], r["source_dir"]) for r in out if r["origin"] == "inherited"}
    assert inherited == {2: ("MIT", "org/repo"), 3: ("MIT", "org/repo"), 7: ("Apache-2.0", "https://h.example/lib")}
    assert {r["doc_id"]: r["licence"] for r in out if r["origin"] == "own"} == {1: "MIT", 4: "Apache-2.0", 6: "Apache-2.0", **dict.fromkeys(range(11, 16), "MIT")}


# --- long texts ---------------------------------------------------------------------------

N = 100_000
LONG = {
    "labels": "a@b" + ".c" * N, "mails": "a@b.cc " * N, "dots": "." * N + "x", "digits": "7" * N, "groups": "12 " * N, "quotes": "\"'" * N, "secret": "token = " + "aB3" * (N // 3), "quoted": 'password="' + "x" * N + '"',
    "name": "n" * N + "@mail.example", "blank lines": "The License\n" + "\n" * N + "Released under the MIT License", "ruled lines": "license\n" + " -- \n" * N + "end", "spaces": "license" + " " * N + "x", "ends": "license " + ".;!? " * N, "lines": "license of\n" * N, "octets": "1." * N, "dates": "01/02/2003 " * (N // 10), "plus": "+1 " * N,
}


def test_long_texts_of_one_shape(spark):
    """No pattern overflows the stack or takes quadratic time on 100,000 of anything."""
    df = spark.createDataFrame([(k, f"d/{k}", t) for k, t in enumerate(LONG.values())], "file long, path string, text string")
    began = time.monotonic()
    hidden = pii.pseudonymised(df, KEY)
    assert {r["file"]: r["text"] for r in pii.pseudonymised(hidden.drop("n_values"), KEY, undo=True).collect()} == dict(enumerate(LONG.values()))
    out = {r["file"]: r["licence"] for r in licenses.scan(df, shared_dir(spark, "l")).collect()}
    assert out[list(LONG).index("blank lines")] == "MIT" and len(out) == len(LONG)
    assert time.monotonic() - began < 240


def test_whole_pii_query_against_plain_patterns(spark, sf):
    """All documents of the table: formats stay, words without personal data stay, plainly written values are gone, and the key brings all back."""
    before = {k: spark.conf.get(k, None) for k in (pii.KEY_SETTING,)}
    spark.conf.set(pii.KEY_SETTING, KEY)
    try:
        out = pii.op8_pii(spark, sf)
        new = {r["doc_id"]: (r["text"], r["n_values"]) for r in out.collect()}
        back = {r["doc_id"]: r["text"] for r in pii.pseudonymised(out.drop("n_values"), KEY, undo=True).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    old = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert back == old and new.keys() == old.keys()
    # An address keeps its four numbers, not how many digits they have.
    shape = lambda t: re.sub("[0-9]", "0", re.sub("[a-z]", "x", re.sub("[A-Z]", "X", re.sub(r"\d{1,3}(?:\.\d{1,3}){3}", "0.0.0.0", t))))
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    plainly = re.compile(rf"(?<![\w.+-])[\w.+-]+(?=@[\w-]+\.[\w.-]+)|(?<!\d)\+1 \(\d{{3}}\) \d{{3}}-\d{{4}}(?!\d)|(?<![\d.]){octet}(?:\.{octet}){{3}}(?![\d.])|(?<![\d-])(?!000|666|9)\d{{3}}-(?!00)\d\d-(?!0000)\d{{4}}(?![\d-])")
    values = 0
    for k, text in old.items():
        got, n = new[k]
        if text is None:
            assert got is None
            continue
        assert shape(got) == shape(text) and (n > 0) == (got != text)
        for a, b in zip(text.split(), got.split(), strict=True):
            if not re.search(r"[@0-9]", a) and not re.search(r"(?i)(token|passw|secret|api.?key)\W*$", text[: text.find(a)][-20:]) and "=" not in a and ":" not in a:
                assert a == b or re.search(r"(?i)(token|passw|secret|api.?key)\s{0,3}[=:]", text)
        for m in plainly.finditer(text):
            values += 1
            assert m[0] not in got or len(m[0]) < 6
    assert values > 10 and sum(n for _, n in new.values()) >= values
