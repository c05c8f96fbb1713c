"""Writers: delimited text, CSV, JSON, sheets, Excel files, graph files (a graph database: ``graph_store``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .excel import MOST_ROWS, register
from .staged import files_of

SEPARATOR = "\n##########\n\n"


def write_cases(segments: DataFrame, path: str, files: int = 1) -> None:
    """At most ``files`` text files that hold all segments (doc_id, seg_no, segment) in order, file after file.

    The separator stands between the segments of a file only; a file ends with a line break.
    The rows are parted by range, so no document, however long, must fit into a task's memory.
    """
    order = ("doc_id", "seg_no")
    sorted_ = segments.repartitionByRange(files, *order).sortWithinPartitions(*order)
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    segment = F.coalesce("segment", F.lit(""))
    sorted_.select(F.when(first, segment).otherwise(F.concat(F.lit(SEPARATOR[1:]), segment)).alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str, names: dict[str, str] | None = None, byte_order_mark: bool = False) -> None:
    """CSV with a header; ``names`` are the columns' titles; the mark precedes the first title."""
    out = df.select(*[F.col(c).alias((names or {}).get(c, c)) for c in df.columns])
    if byte_order_mark:
        out = out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0])
    out.write.option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_sheets(df: DataFrame, path: str, sheet: str | None = None) -> None:
    """A table partitioned by ``sheet``; a frame without that column becomes the sheet named."""
    out = df if sheet is None else df.withColumn("sheet", F.lit(sheet))
    out.write.partitionBy("sheet").parquet(path)


def add_sheet_column(df: DataFrame, path: str, name: str, value, sheet: str = "Sheet1") -> None:
    """Store all sheets in a new place with a column added that only ``sheet`` fills."""
    if df.filter(F.col("sheet") == sheet).isEmpty():
        raise ValueError(f"there is no sheet {sheet}")
    write_sheets(df.withColumn(name, F.when(F.col("sheet") == sheet, value)), path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.parquet(f"{path.rstrip('/')}/nodes")
    edges.write.parquet(f"{path.rstrip('/')}/edges")


def write_workbooks(df: DataFrame, path: str, sheet: str = "Sheet1", most_rows: int = MOST_ROWS) -> int:
    """Excel files of one sheet of at most ``most_rows`` rows in the folder ``path``, all of them or none; how many the folder holds."""
    register(df.sparkSession)
    df.write.format("workbook").mode("append").option("sheet", sheet).option("maxrows", most_rows).save(path)
    return len(files_of(path, ".xlsx"))
