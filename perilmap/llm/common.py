"""Helpers shared by the training-data operators: tables, shared files, text blocks."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder's name under ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and all runs on one machine is a local folder chosen.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="perilmap-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Whether Spark deletes a statement's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` stored as Parquet and read again: its lineage ends in files all machines see.

    What was shuffled for it is of no use once it is stored, so its shuffle files go at once.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name like ``name`` that is none of those ``taken``."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8_000_000) -> None:
    """Let texts travel to Python at most ``rows`` and about ``size`` bytes at a time, as a task's memory grows with a batch.

    A row may be a block of many texts, so the number of rows alone bounds nothing. A session
    that already asks for less keeps its settings.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key))
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def give_back_memory() -> None:
    """Return freed memory to the system, as a worker lives on after its task."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to do
        pass


def without_encoders() -> None:
    """At the start of a task that encodes nothing: free what tasks before have left in this worker."""
    tokens = sys.modules.get("perilmap.llm.tokens")
    if tokens is not None:
        tokens.forget()
    give_back_memory()


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that no later read needs."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def pieces_of(sizes: Iterable[int], limit: int, overlap: int) -> Iterator[list[tuple[int, int, int]]]:
    """Group texts into blocks of about ``limit`` bytes: lists of (index, start, end).

    A text beyond the limit is cut into pieces that overlap by ``overlap`` bytes, so
    the memory of a block is bounded however long a text is.
    """
    block: list[tuple[int, int, int]] = []
    held = 0
    for i, size in enumerate(sizes):
        at = 0
        while True:
            end = min(size, at + limit)
            if held and held + end - at > limit:
                yield block
                block, held = [], 0
            block.append((i, at, end))
            held += end - at
            if end == size:
                break
            at = end - overlap
    if block:
        yield block
