"""A content-addressed web archive: payloads once, record headers apart, WARC files from their join.

``store`` keeps three tables in a shared folder. ``payloads`` holds the bytes of each distinct
payload once, under their SHA-256. ``headers`` holds the exact head of each record (WARC
header and HTTP header, up to its empty line) with the address of its payload. The SHA-1 that
WARC asks for is a second digest: an address whose records differ in it or in length stops the
job. Of records with equal payloads of ``least`` bytes or more, that of the largest page id is
the ``response`` and the others are ``revisit`` records that name it.

``export`` joins heads and payloads to records, checks each payload against its address and
writes gzipped WARC 1.1 files, a member for each record, with an index (file, offset, length)
that lists files of committed tasks only. ``read_records`` parses WARC files back, a record at
a time; ``originals`` rebuilds the HTTP message of every page, of revisits too.

An address that many records share would put them into one task of a join. The addresses with
more than 1 in ``HOT_SHARE`` of all records, so fewer than ``HOT_SHARE``, are broadcast with their narrow row (or
payload under ``least`` bytes); all others are joined by shuffle.

Cases: a null payload counts as empty; a null url is empty, and control characters in one are
written as %XX; a null page id has no such field and is smaller than any other; of rows with equal ids and
payloads one is the response and the others revisit it; an empty table gives an empty archive;
other columns are ignored. The table has no dates, so all records have the date given. A
record is held whole while it is written or read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back_memory, shared_dir, small_batches, table, without_encoders, written
from .token_output import filesystem

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
HOT_SHARE = 1000
#: Compressed bytes after which a task begins another file.
FILE_BYTES = 1 << 30
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, file string, offset long, length long"
RECORD = "record_id string, record_type string, page_id long, url string, declared string, refers_to_id string, payload_bytes long, payload_digest string, payload_sha256 string"

ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN strlen(p.h) >= {LEAST} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN strlen(p.h) >= {LEAST} AND page_id <> top THEN top END AS refers_to FROM p JOIN g ON p.h = g.h
"""


class Archive(NamedTuple):
    """The tables of an archive and the smallest size of a payload that is stored once for several records.

    ``payloads`` is bucketed by address, so a join by address shuffles heads alone.
    """

    headers: DataFrame
    payloads: DataFrame
    least: int
    table: str | None = None

    def forget(self) -> None:
        """Take the payloads' name out of the catalog; their files stay."""
        self.headers.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")


def join_hot(rows: DataFrame, side: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` with the row of ``side`` (unique by ``key``, with ``copies``) of their key.

    Keys of more than ``most`` copies are broadcast, so ``most`` bounds how many these are.
    """
    side = side.withColumn("_hot", F.col("copies") > most)
    hot, cold = (side.filter(c).drop("copies", "_hot") for c in ("_hot", "NOT _hot"))
    few = F.broadcast(hot)
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def record_uuid(address: Column, page_id: Column, row: Column) -> Column:
    """A record's name, made of its payload's address and its place."""
    h = F.sha2(F.concat_ws("/", address, page_id.cast("string"), row.cast("string")).cast("binary"), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def http_head(n: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", n.cast("string")), F.lit("\r\n"))


def warc_head(revisit: Column, date: str) -> Column:
    """The head of a record, from its columns; for a revisit the block is the HTTP header alone."""
    uri = F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))
    http = http_head(F.col("n"))
    block = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    of_revisit = F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_id"), F.lit(">"))))
    return F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), _line("WARC-Record-ID", uri), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), F.when(revisit, of_revisit).otherwise(F.lit("")),
        F.coalesce(_line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")), F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("Content-Length", block.cast("string")), F.lit("\r\n"), http,
    )


def safe_url(url: Column) -> Column:
    """A url in one line: control characters would end or split a header."""
    plain = F.coalesce(url, F.lit(""))
    encoded = plain
    for c in (*range(32), 127):
        encoded = F.replace(encoded, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(plain.rlike(r"[\x00-\x1F\x7F]"), encoded).otherwise(plain)


def store(pages: DataFrame, out_dir: str, payload: str = "html", least: int = LEAST, date: str = DATE) -> Archive:
    """Write the payloads and the headers of ``pages`` (page_id, url and the payload's column) to ``out_dir``."""
    bytes_of = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), safe_url(F.col("url")).alias("url"), bytes_of.alias("payload"))
    narrow = rows.select("page_id", "url", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("address"))
    records = written(narrow.withColumn("row", F.monotonically_increasing_id()), f"{out_dir}/records")
    stored = rows.select("payload", F.sha2("payload", 256).alias("address")).groupBy("address").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("copies")).withColumn("size", F.octet_length("payload"))
    spark, name = pages.sparkSession, f"warc_payloads_{uuid.uuid4().hex}"
    stored.write.option("path", f"{out_dir}/payloads").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "address").sortBy("address").saveAsTable(name)
    payloads = spark.table(name)

    firsts = records.groupBy("address").agg(F.max(F.struct("page_id", "row")).alias("top"), F.count(F.lit(1)).alias("copies"), F.min("sha1").alias("lo"), F.max("sha1").alias("hi"), F.min("n").alias("short"), F.max("n").alias("long"))
    same = (F.col("lo") == F.col("hi")) & (F.col("short") == F.col("long"))
    firsts = firsts.withColumn("top", F.when(same, F.col("top")).otherwise(F.raise_error(F.concat(F.lit("two payloads share the address "), F.col("address"))).cast(firsts.schema["top"].dataType)))
    top = F.col("top")
    firsts = written(firsts.select("address", top["row"].alias("top_row"), record_uuid(F.col("address"), top["page_id"], top["row"]).alias("top_id"), "copies"), f"{out_dir}/firsts")

    decided = join_hot(records, firsts, "address", records.count() // HOT_SHARE)
    revisit = (F.col("n") >= least) & (F.col("row") != F.col("top_row"))
    named = decided.withColumn("record_id", record_uuid(F.col("address"), F.col("page_id"), F.col("row"))).withColumn("refers_to_id", F.when(revisit, F.col("top_id")))
    heads = named.select("record_id", "page_id", "refers_to_id", "address", "n", warc_head(F.col("refers_to_id").isNotNull(), date).alias("head"))
    return Archive(written(heads, f"{out_dir}/headers"), payloads, least, name)


def checked(payloads: DataFrame) -> DataFrame:
    """The payloads, each proved to have the digest it is stored under."""
    fine = F.sha2("payload", 256) == F.col("address")
    return payloads.withColumn("payload", F.when(fine, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))).cast("binary")))


def records(archive: Archive) -> DataFrame:
    """(record_id, head, payload) as archived: joined from headers and payloads, empty payloads for revisits."""
    heads, kept = archive.headers, archive.payloads
    revisits = heads.filter("refers_to_id IS NOT NULL").select("record_id", "head", F.lit(b"").alias("payload"))
    # A large payload has one response; small ones may have any number, and are small.
    large = heads.filter("refers_to_id IS NULL").filter(F.col("n") >= archive.least).join(checked(kept.filter(F.col("size") >= archive.least)), "address")
    small = join_hot(heads.filter(F.col("n") < archive.least), checked(kept.filter(F.col("size") < archive.least)), "address", heads.count() // HOT_SHARE)
    return revisits.unionByName(large.select("record_id", "head", "payload")).unionByName(small.select("record_id", "head", "payload"))


def originals(archive: Archive) -> DataFrame:
    """(record_id, page_id, message): the HTTP message of every page, with its whole payload."""
    whole = archive.headers.join(checked(archive.payloads), "address")
    return whole.select("record_id", "page_id", F.concat(http_head(F.col("n")).cast("binary"), "payload").alias("message"))


def export(archive: Archive, out_dir: str, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write the archive's records as WARC files under ``out_dir``; returns their index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_encoders()
        sink = path = None
        at = 0
        for batch in batches:
            rows = []
            for record_id, head, payload in zip(*(batch.column(c) for c in range(3)), strict=True):
                if sink is None or at >= file_bytes:
                    if sink is not None:
                        sink.close()
                    path, at = f"{out_dir}/{uuid.uuid4().hex}.warc.gz", 0
                    fs, local = filesystem(path)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(local, compression=None)
                squeeze = zlib.compressobj(level, wbits=31)
                member = b"".join((squeeze.compress(head.as_py().encode()), squeeze.compress(memoryview(payload.as_buffer())), squeeze.compress(b"\r\n\r\n"), squeeze.flush()))
                sink.write(member)
                rows.append((record_id.as_py(), path, at, len(member)))
                at += len(member)
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["record_id", "file", "offset", "length"])
        if sink is not None:
            sink.close()
        give_back_memory()

    small_batches(archive.headers.sparkSession)
    return written(records(archive).mapInArrow(write, INDEX), f"{out_dir}/index")


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed WARC stream; field names in lower case."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a WARC record ends before its length")
        yield fields, block


def read_records(files: DataFrame) -> DataFrame:
    """A row for each record of the WARC files in column ``file``: fields, and length and digests of its payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_encoders()
        names = ["record_id", "record_type", "page_id", "url", "declared", "refers_to_id", "payload_bytes", "payload_digest", "payload_sha256"]
        types = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.string()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = filesystem(uri)
                rows = []
                with fs.open_input_file(path) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for fields, block in parse(stream):
                        payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
                        page = fields.get("x-page-id")
                        declared = fields.get("warc-payload-digest", "").partition(":")[2] or None
                        bare = [fields[k].strip("<>") if k in fields else None for k in ("warc-record-id", "warc-refers-to")]
                        rows.append((bare[0], fields["warc-type"], None if page is None else int(page), fields.get("warc-target-uri"), declared, bare[1], len(payload), hashlib.sha1(payload).hexdigest(), hashlib.sha256(payload).hexdigest()))
                        if len(rows) == 1000:
                            yield packed(rows)
                            rows = []
                if rows:
                    yield packed(rows)
        give_back_memory()

    return files.select("file").mapInArrow(read, RECORD)


def resolved(read: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records read back, revisits with their response's payload.

    A payload without the digest that its record declares stops the job.
    """
    fine = F.col("payload_digest") == F.col("declared")
    true = F.when(fine, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id"))).cast("string"))
    responses, revisits = read.filter("record_type = 'response'"), read.filter("record_type = 'revisit'").select("page_id", "declared", F.col("refers_to_id").alias("id"))
    counts = revisits.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    named = responses.select(F.col("record_id").alias("id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").join(counts, "id")
    back = join_hot(revisits, named, "id", read.count() // HOT_SHARE).withColumn("record_id", F.col("id"))
    own = responses.select("page_id", "payload_bytes", true.alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(back.select("page_id", "payload_bytes", true.alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "warc")
    archive = store(table(spark, sf_dir, "pages"), out)
    index = export(archive, f"{out}/files")
    archive.forget()
    files = index.select("file").distinct()
    return resolved(written(read_records(files.repartition(max(1, files.count()))), f"{out}/read"))
