import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from perilmap.llm import warc
from perilmap.llm.catalog import ORACLE_SQL
from perilmap.llm.common import shared_dir

BIG, BIGGER = "é" * 500, "<p>x</p>\r\n\r\nWARC/1.1\r\n" * 80
PAGES = [
    (1, "http://a/", BIG), (9, "http://b/", BIG), (5, "http://c/\r\nX-Page-ID: 77", BIG), (2, None, "é" * 499 + "x"), (3, "http://d/", "é" * 499 + "x"), (4, "http://e/", None), (6, "http://f/", ""),
    (None, "http://g/", BIG), (None, "http://h/", BIGGER), (7, "http://i/", BIGGER), (7, "http://i/", BIGGER), (None, None, "alone " * 400), (8, "http://j/%20\x00", "\x00\x1f\x8b"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def archive(spark, rows, **options):
    out = shared_dir(spark, "warc-test")
    kept = warc.store(frame(spark, rows).repartition(3), out)
    index = warc.export(kept, f"{out}/files", **options)
    return kept, index, warc.read_records(index.select("file").distinct())


def brute(rows):
    """(page_id, bytes, sha1, type, refers_to) by groups of payloads in plain Python."""
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = []
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        for k, page_id in enumerate(ids):
            back = k > 0 and len(payload) >= 1000
            out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if back else "response", ids[0] if back else None))
    return sorted(map(str, out))


def test_against_brute_force(spark):
    _, _, read = archive(spark, PAGES)
    assert sorted(str(tuple(r)) for r in warc.resolved(read).collect()) == brute(PAGES)


@pytest.mark.parametrize("share", [1, 3, 10**6])
def test_hot_and_cold_payloads(spark, monkeypatch, share):
    """The same rows whether a payload is broadcast or shuffled."""
    monkeypatch.setattr(warc, "HOT_SHARE", share)
    rows = PAGES + [(100 + k, "http://hot/", ("hot " * 300, "small")[k % 2]) for k in range(60)]
    _, _, read = archive(spark, rows)
    assert sorted(str(tuple(r)) for r in warc.resolved(read).collect()) == brute(rows)


def test_payloads_are_stored_once_and_originals_come_back(spark):
    kept, _, _ = archive(spark, PAGES)
    texts = {(html or "").encode() for _, _, html in PAGES}
    assert sorted(bytes(r.payload) for r in kept.payloads.collect()) == sorted(texts)
    got = sorted((str(r.page_id), bytes(r.message)) for r in warc.originals(kept).collect())
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
    assert got == sorted((str(k), head.format(len((h or "").encode())).encode() + (h or "").encode()) for k, _, h in PAGES)


def test_files_are_warc_and_the_index_finds_each_record(spark):
    _, index, _ = archive(spark, PAGES, file_bytes=1500)
    rows = index.collect()
    assert len(rows) == len({r.record_id for r in rows}) == len(PAGES) and len({r.file for r in rows}) > 1
    urls = []
    for r in rows:
        data = open(r.file.removeprefix("file:"), "rb").read()[r.offset : r.offset + r.length]
        whole = gzip.decompress(data)
        [(fields, block)] = warc.parse(io.BytesIO(whole))
        assert fields["warc-record-id"] == f"<{r.record_id}>" and len(block) == int(fields["content-length"]) and whole.endswith(block + b"\r\n\r\n")
        assert block.startswith(b"HTTP/1.1 200 OK\r\n") and fields["warc-date"] == warc.DATE
        assert ("warc-refers-to" in fields) == (fields["warc-type"] == "revisit") == (fields.get("warc-profile") == warc.PROFILE)
        urls.append(fields["warc-target-uri"])
    assert sorted(urls) == sorted((u or "").replace("\r", "%0D").replace("\n", "%0A").replace("\x00", "%00") for _, u, _ in PAGES)


def test_damage_is_found(spark):
    kept, _, read = archive(spark, PAGES)
    bad = warc.Archive(kept.headers, kept.payloads.withColumn("payload", F.concat("payload", F.lit(b"x"))), kept.least)
    with pytest.raises(Exception, match="damaged payload"):
        warc.records(bad).collect()
    with pytest.raises(Exception, match="damaged record"):
        warc.resolved(read.withColumn("payload_digest", F.lit("0"))).collect()
    for text in (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort", b"nonsense\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(text)))


def test_empty_table_long_payload_and_clashing_columns(spark):
    _, _, read = archive(spark, [])
    assert warc.resolved(read).count() == 0
    rows = [(1, "u", "long ü " * 600_000), (2, "u", "long ü " * 600_000)]
    pages = frame(spark, rows).withColumn("address", F.lit(1)).withColumn("payload", F.lit("p")).withColumn("row", F.lit("r")).withColumn("copies", F.lit(2))
    out = shared_dir(spark, "warc-test")
    read = warc.read_records(warc.export(warc.store(pages, out), f"{out}/files").select("file").distinct())
    assert sorted(str(tuple(r)) for r in warc.resolved(read).collect()) == brute(rows)


def test_query_and_sql(spark, sf):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(map(str, duckdb.sql(ORACLE_SQL["op12_warc"]).fetchall()))
    assert want == sorted(str(tuple(r)) for r in warc.op12_warc(spark, sf).collect())
