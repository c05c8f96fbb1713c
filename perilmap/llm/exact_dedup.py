"""Exact deduplication with streaming keyed state; DataFrame operations only.

A structured stream reads the documents' digests and keeps, in RocksDB and without expiry,
one entry for each digest: the smallest identifier, its content locator (file and row) and
the number of documents seen. Groups with more than one document, the hits, are checked on
their full bytes: equal digests must have equal smallest and largest normalised text.
Digests that fail it are grouped again by their text, so the result never rests on SHA-256.

Copies are combined before each shuffle, so a text that a third of all rows repeat costs
one row for each task. Only texts of hits are shuffled while their digests are few enough
to broadcast (``BROADCAST_DIGESTS``); beyond it the join shuffles.

Cases: a null text counts as empty, and all empty texts are equal; a null id is larger than
any other; of rows with the same id and text one stays (the first by file and row); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, shared_dir, table, written

#: Digests of hits (about 100 bytes each) that may be broadcast.
BROADCAST_DIGESTS = 100_000
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Without it every store reserves megabytes of disk for files of a few kilobytes.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    # Stores of a stream that has ended are let go soon.
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
}

ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def placed(docs: DataFrame, out_dir: str) -> DataFrame:
    """``docs``, stored as Parquet first unless each row is a row of one file, so that rows can be told apart."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.children().isEmpty() and not located(docs).schema["_row"].metadata.get("absent"):
        return docs
    return written(docs, f"{out_dir}/placed")


def located(docs: DataFrame, *columns, path: str = "_path", row: str = "_row") -> DataFrame:
    """``columns`` of ``docs`` with its rows' places, as far as they come from files."""
    try:
        return docs.select(*columns, F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return docs.select(*columns, F.lit(None).cast("string").alias(path), F.lit(None).cast("long").alias(row, metadata={"absent": True}))


def digests(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text") if "_metadata" in docs.columns else docs
    return located(docs, F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("digest"))


def identity() -> F.Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_path").alias("path"), F.col("_row").alias("row"))


def keyed_state(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Run the stateful stream over what there is now and return its state.

    ``stream``: rows (doc_id, digest, _path, _row). Run again with the same checkpoint, it
    takes up only what is new.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    try:
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)
        entries = stream.groupBy("digest").agg(F.min(identity()).alias("first"), F.count(F.lit(1)).alias("n"))
        entries.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    state = spark.read.format("statestore").load(checkpoint)
    fields = state.schema["value"].dataType.fields
    # The state names its aggregates by numbers; their types tell whether they are the two that are meant.
    if [f.dataType.typeName() for f in fields] != ["struct", "long"]:
        raise TypeError(f"the state of the stream has other fields than expected: {fields}")
    first, n = (f.name for f in fields)
    return state.select(F.col("key.digest").alias("digest"), F.col("value").getField(first).alias("first"), F.col("value").getField(n).alias("n"))


def differing(docs: DataFrame, state: DataFrame, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """Digests of hits whose texts are not all equal, byte by byte."""
    hits = state.filter("n > 1").select("digest")
    if hits.count() <= broadcast_digests:
        hits = F.broadcast(hits)
    texts = docs.select(normalised(F.col("text")).alias("t")).withColumn("digest", F.sha2(F.col("t").cast("binary"), 256))
    ends = texts.join(hits, "digest", "left_semi").groupBy("digest").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return ends.filter("lo <> hi").select("digest")


def exact_groups(docs: DataFrame, out_dir: str) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256, and its place."""
    spark, docs = docs.sparkSession, placed(docs, out_dir)
    rows = written(digests(docs), f"{out_dir}/digests")
    state = written(keyed_state(spark.readStream.schema(rows.schema).parquet(f"{out_dir}/digests"), f"{out_dir}/state"), f"{out_dir}/entries")
    shape = lambda joined: joined.select(
        "doc_id", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), identity().eqNullSafe(F.col("first")).alias("kept"), F.col("digest").alias("text_sha256"), "_path", "_row"
    )
    bad = written(differing(docs, state), f"{out_dir}/differing")
    if bad.isEmpty():
        return shape(rows.join(state, "digest"))
    # Texts that share a digest without being equal: group those digests by the text itself.
    texts = located(docs, F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("t")).withColumn("digest", F.sha2(F.col("t").cast("binary"), 256)).join(bad, "digest", "left_semi")
    own = texts.groupBy("digest", "t").agg(F.min(identity()).alias("first"), F.count(F.lit(1)).alias("n"))
    return shape(rows.join(bad, "digest", "left_anti").join(state, "digest")).unionByName(shape(texts.join(own, ["digest", "t"])))


def drop_copies(docs: DataFrame, out_dir: str) -> DataFrame:
    """The rows of ``docs`` that stay, in their own columns."""
    if "_metadata" in docs.columns:
        raise ValueError("a column named _metadata hides the places of rows")
    docs = placed(docs, out_dir)
    gone = written(exact_groups(docs, out_dir).filter(~F.col("kept")).select("_path", "_row"), f"{out_dir}/gone")
    if gone.count() <= BROADCAST_DIGESTS:
        gone = F.broadcast(gone)
    path, row = fresh("path", docs.columns), fresh("row", docs.columns)
    here = located(docs, "*", path=path, row=row)
    return here.join(gone, (here[path] == gone["_path"]) & (here[row] == gone["_row"]), "left_anti").select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), shared_dir(spark, "exact")).drop("_path", "_row")
