"""Best-fit packing of token pieces into sequences, hierarchically.

Round 0 packs each partition's pieces by best fit, longest first, in blocks of bounded
size, and emits bins that are nearly full. The rest, the underfull bins, become items of
their own (a bin's fill is its length). In each following round a group takes the
underfull bins of several groups before it and packs them by best fit again; the tree
ends when one group is left or when a round no longer lowers their number. Groups are
dealt by hash and their number is set by the number of items, so that a group stays
within ``GROUP_ITEMS`` items whatever the size of the input.

Cases: a null or empty text is a piece of one token (the end id); a document longer than
a sequence is cut into full pieces, of which only the first may be shorter; rows with
equal ids are separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import give_back_memory, shared_dir, small_batches, table, written

CAPACITY = 1024
END_ID = 2
#: Bins at least this full are final; the rest is packed again.
NEARLY_FULL = 1020
#: Words a worker of the query remembers, about 200 MB; the pipeline, whose workers do more, keeps to the default.
REMEMBERED = 1_200_000
#: Pieces, or underfull bins, that one best-fit pass holds.
GROUP_ITEMS = 65_536
#: How many groups' underfull bins meet in the next round.
FAN_IN = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long, bin_fill long, ids binary"


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: for each item its bin and offset, and each bin's fill."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fills: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is free in them
    have = 0  # bit f: some bin has f free
    for i in order.tolist():
        n = int(lengths[i])
        fit = have >> n
        if n and fit:
            free = n + (fit & -fit).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                have &= ~(1 << free)
        else:
            free, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        free -= n
        if free:
            room[free].append(b)
            have |= 1 << free
    return bins, offsets, np.asarray(fills, np.int64)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pack_locally(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL, with_ids: bool = False, cached_words: int = tokens.CACHED_WORDS) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with the bins of round 0."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer, cached_words)
        base = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        made = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            columns = list(zip(*rows, strict=True))
            bins, offsets, fills = best_fit(np.asarray(columns[3]), capacity)
            ids = pa.array(columns[5], pa.binary()) if with_ids else pa.nulls(len(rows), pa.binary())
            out = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(columns[k], pa.int64()) for k in (2, 3, 4)), pa.array(base + made + bins), pa.array(offsets), pa.array(fills[bins]), ids]
            made += len(fills)
            rows.clear()
            return pa.record_batch(out, ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "bin_offset", "bin_fill", "ids"])

        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), tokens.encode_blocks(b.column(1).to_pylist(), enc), strict=True):
                ids = np.append(np.frombuffer(raw, dtype=enc.dtype).astype("<u4"), np.uint32(end_id))
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + n].tobytes()
                    rows.append((doc_id, k, start, n, zlib.crc32(part), part if with_ids else None))
                if len(rows) >= GROUP_ITEMS:
                    yield flush()
        if rows:
            yield flush()
        give_back_memory()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).mapInArrow(pack, PIECES)


def _merge(capacity: int):
    def merge(rows: pa.Table) -> pa.Table:
        bins, fills = rows.column("bin").to_numpy(), rows.column("fill").to_numpy()
        order = np.argsort(bins)  # the same result in whatever order the rows come
        bins, fills = bins[order], fills[order]
        into, offsets, totals = best_fit(fills, capacity)
        lead = np.full(len(totals), np.iinfo(np.int64).max)
        np.minimum.at(lead, into, bins)
        return pa.table({"bin": bins, "root": lead[into], "shift": offsets, "fill": totals[into]})

    return merge


def merge_underfull(bins: DataFrame, out_dir: str, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Tree-merge of underfull ``bins`` (bin, fill): for each, the bin it ends in and its offset there."""
    placed = written(bins.select("bin", F.col("bin").alias("root"), F.lit(0).cast("long").alias("shift"), "fill"), f"{out_dir}/round0")
    n = placed.count()
    groups, k = max(1, -(-n * FAN_IN // group_items)), 0
    while n > 1:
        k += 1
        still = placed.filter((F.col("bin") == F.col("root")) & (F.col("fill") < nearly_full)).select("bin", "fill")
        moved = still.groupBy(F.pmod(F.xxhash64("bin", F.lit(k)), F.lit(groups)).alias("g")).applyInArrow(_merge(capacity), "bin long, root long, shift long, fill long")
        moved = written(moved, f"{out_dir}/moved{k}")
        step = moved.select(F.col("bin").alias("r"), F.col("root").alias("to"), F.col("shift").alias("more"), F.col("fill").alias("filled"))
        placed = written(
            placed.join(step, placed["root"] == step["r"], "left").select("bin", F.coalesce("to", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"), F.coalesce("filled", "fill").alias("fill")),
            f"{out_dir}/round{k}",
        )
        left = placed.filter((F.col("bin") == F.col("root")) & (F.col("fill") < nearly_full)).count()
        if groups == 1 or left == n:
            break
        n, groups = left, max(1, groups // FAN_IN, -(-left // group_items))
    return placed


def pack(docs: DataFrame, tokenizer: str, out_dir: str, end_id: int = END_ID, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL, with_ids: bool = False, cached_words: int = tokens.CACHED_WORDS) -> DataFrame:
    """Every piece with its sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    small_batches(docs.sparkSession)
    pieces = written(pack_locally(docs, tokenizer, end_id, capacity, nearly_full, with_ids, cached_words), f"{out_dir}/pieces")
    under = pieces.filter((F.col("bin_fill") < nearly_full) & (F.col("bin_offset") == 0)).select("bin", F.col("bin_fill").alias("fill"))
    roots = merge_underfull(under, out_dir, capacity, nearly_full).select(F.col("bin").alias("b"), "root", "shift")
    out = pieces.join(roots, pieces["bin"] == roots["b"], "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("root", "bin").alias("sequence_id"),
        (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        *(["ids"] if with_ids else []),
    )
    return out


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokens.vocabulary_path("byte_bpe_50k.json"), shared_dir(spark, "packing"), cached_words=REMEMBERED)
