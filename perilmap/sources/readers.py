"""Readers: Word and Excel files, plain text, CSV in any charset, graphs of nodes and edges."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import batched
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .excel import Book, shown
from .staged import filesystem
from .writers import SEPARATOR

#: Bytes of a file in another charset that one task decodes at a time.
RANGE_BYTES = 16 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs of a Word file's body, trimmed, joined by line breaks."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in body.findall(f"{_W}p"))
    return "\n".join(x for x in lines if x)


def read_docx(spark: SparkSession, path: str, failfast: bool = False) -> DataFrame:
    """(path, text) of Word files; an unreadable file raises, or gives '' unless ``failfast``."""

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = []
            for content in pdf["content"]:
                try:
                    texts.append(docx_text(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
                    if failfast:
                        raise
                    texts.append("")
            yield pd.DataFrame({"path": pdf["path"], "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, text string")


def read_text_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(path, segment) of files that ``write_cases`` wrote; large files are read by several tasks."""
    rows = spark.read.option("lineSep", SEPARATOR[1:]).text(path)
    # What ends at a separator, or at the file's end, is the line break before it.
    return rows.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\n\z", "").alias("segment"))


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", schema: str | None = None, rows_at_once: int = 10_000, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """CSV with a header. Files in charsets that Spark's parser refuses (GBK) are decoded by ranges of bytes.

    A byte order mark before the first name is dropped. ``schema`` is a DDL string, names with
    blanks in backticks, null where a cell does not fit; columns that it doesn't name are left out of a decoded file.
    """
    if encoding.upper() in ("UTF-8", "UTF-8-SIG", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16LE", "UTF-16BE", "UTF-32"):
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8" if encoding.upper() == "UTF-8-SIG" else encoding)
        df = (reader.schema(schema) if schema else reader).csv(path)
        first = df.columns[0] if df.columns else ""
        return df.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else df
    if schema is None:
        raise ValueError(f"a schema is needed to read {encoding}")
    quoted = re.sub(r"`[^`]*`|[^\W\d]\w*", lambda m: m[0] if m[0].isascii() or m[0][0] == "`" else f"`{m[0]}`", schema)
    fields = StructType.fromDDL(quoted).fields
    names = [f.name for f in fields]

    def decode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples(index=False):
                header, records = range_records(r.path, r.start, r.end, bool(r.inside))
                columns = pd.read_csv(io.BytesIO(header), encoding=encoding, dtype=str).columns
                if records:
                    for rows in pd.read_csv(io.BytesIO(records), encoding=encoding, dtype=str, keep_default_na=False, chunksize=rows_at_once, header=None, names=columns):
                        yield rows[names]

    raw = byte_ranges(spark, path, range_bytes).mapInPandas(decode, StructType([StructField(n, StringType()) for n in names]))
    of = lambda f: F.col("`" + f.name.replace("`", "``") + "`")
    return raw.select(*[F.nullif(of(f), F.lit("")).try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, StringType) else of(f) for f in fields])


def byte_ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, start, end, inside) of files cut into ranges; ``inside``: whether a range starts within quotes.

    The quotes of each range are counted by the tasks; a window over a file's ranges adds up how many come before.
    Quotes and line breaks are single bytes below 0x30, which no longer character of GBK, GB18030, Big5,
    Shift-JIS or EUC holds.
    """
    found = spark.read.format("binaryFile").load(path).select("path", "length")
    cuts = found.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("start"))
    ranges = cuts.select("path", "start", F.least(F.col("start") + size, F.col("length")).alias("end"))
    # Dealt out anew, as all ranges of a file come from one row.
    ranges = ranges.repartition(spark.sparkContext.defaultParallelism, "path", "start")

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf["quotes"] = [_bytes(p, a, b).count(b'"') for p, a, b in pdf.itertuples(index=False)]
            yield pdf

    counted = ranges.mapInPandas(count, "path string, start long, end long, quotes long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.select("path", "start", "end", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("inside"))
    return placed.repartition(spark.sparkContext.defaultParallelism, "path", "start")


def _bytes(uri: str, start: int, end: int) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        return f.read_at(max(0, end - start), start)


def _breaks(data: bytes, inside: bool) -> np.ndarray:
    """The places after line breaks outside quotes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    open_ = (np.cumsum(raw == 34) + inside) % 2 == 1
    return np.flatnonzero((raw == 10) & ~open_) + 1


def range_records(uri: str, start: int, end: int, inside: bool, step: int = 1 << 16) -> tuple[bytes, bytes]:
    """(the header record, the records that begin within the range) of a CSV file; the last may end beyond it."""
    header, held, at, within = None, b"", 0, False
    while header is None:  # the first record, from the file's start
        more = _bytes(uri, at, at + step)
        held += more
        at += len(more)
        ends = _breaks(held, within)
        if len(ends) or not more:
            header = held[: ends[0]] if len(ends) else held
    data = _bytes(uri, max(start - 1, 0), end)
    if start:
        inside = inside != (data[:1] == b'"')  # as of the byte before the range
    begins = _breaks(data, inside) + max(start - 1, 0)
    begins = begins[(begins >= max(start, len(header))) & (begins < end)]
    if not len(begins):
        return header, b""
    first = int(begins[0])
    # The last record may go on behind the range.
    tail, at = data[int(begins[-1]) - max(start - 1, 0) :], end
    while not len(ends := _breaks(tail, False)):
        more = _bytes(uri, at, at + step)
        if not more:
            break
        tail += more
        at += len(more)
    return header, data[first - max(start - 1, 0) : int(begins[-1]) - max(start - 1, 0)] + (tail[: ends[0]] if len(ends) else tail)


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(path, sheet, row_pos, cells map<header,string>) of all sheets, or of one, of files with any columns.

    Where the columns are known, the ``workbook`` format reads them with their types.
    """

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for file in pdf["path"]:
                with Book(filesystem(file)[1], file) as book:
                    for name in book.sheets if sheet is None else [sheet] if sheet in book.sheets else []:
                        rows = enumerate(book.rows(name))
                        header = {k: shown(v) for k, v in next(rows, (0, {}))[1].items()}
                        for some in batched(rows, 10_000):
                            yield pd.DataFrame([(file, name, k, {header[c]: shown(v) for c, v in cells.items() if c in header}) for k, cells in some], columns=["path", "sheet", "row_pos", "cells"])

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(read, "path string, sheet string, row_pos long, cells map<string,string>")


def read_sheets(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A table partitioned by ``sheet``, all of it or one sheet (only its folder is read)."""
    df = spark.read.parquet(path)
    return df if sheet is None else df.filter(F.col("sheet") == sheet)


def read_graph_edges(spark: SparkSession, path: str, relation: str | None = "LEADS_TO") -> DataFrame:
    """Edges that ``write_graph`` stored, of one relation or all."""
    df = spark.read.parquet(f"{path.rstrip('/')}/edges")
    return df if relation is None else df.filter(F.col("relation") == relation)
