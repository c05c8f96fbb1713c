"""Token-ID output: Arrow files of fixed-size-list batches, and reading them back.

Documents are put in ascending ``doc_id`` order by a range partitioning, each partition
is encoded as a stream and written as one *shard*: an Arrow IPC file whose batches hold
``ids: fixed_size_list<uint>[L]`` and ``mask: dictionary of fixed_size_list<uint8>[L]`` (a byte
each, as Arrow packs Booleans into bits, which no array can view). A mask is ones, then zeros,
so a shard's dictionary holds the L + 1 masks there are, and a sequence the number of its ones:
four bytes in place of L. All batches but
the last hold the same number of sequences, so sequence ``i`` is row ``i % B`` of batch
``i // B`` and can be mapped without a copy. Only a shard's last sequence is padded (mask
0). Beside it lies an index file (doc_id, start, n_tokens). A manifest in Parquet
names the files of committed tasks only; what a lost executor wrote is never listed.

Cases: a null text counts as empty (just the end id); null ids come first; rows with equal
ids keep one entry each, ordered by text; an empty table gives an empty manifest; columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import shared_dir, small_batches, table

SEQUENCE = 1024
BATCH = 256
END_ID = 2
MANIFEST = "shard string, first_id long, n_docs long, n_tokens long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string"


def filesystem(uri: str):
    """(file system, path) of a folder's address as Spark writes it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


class ShardWriter:
    """Appends documents' ids to one shard, a batch of sequences at a time."""

    def __init__(self, uri: str, dtype: np.dtype, sequence: int = SEQUENCE, batch: int = BATCH):
        self.fs, self.path = filesystem(uri)
        self.dtype, self.sequence, self.batch = dtype, sequence, batch
        value = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(value, sequence)), ("mask", pa.dictionary(pa.int32(), pa.list_(pa.uint8(), sequence)))])
        self.masks = pa.FixedSizeListArray.from_arrays(pa.array(np.tri(sequence + 1, sequence, -1, dtype=np.uint8).ravel()), sequence)
        self.sink = self.fs.open_output_stream(self.path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.held_bytes = [], 0
        self.index: list[tuple] = []
        self.n_tokens = 0

    def add(self, doc_id, raw: bytes) -> None:
        n = len(raw) // self.dtype.itemsize
        self.index.append((doc_id, self.n_tokens, n))
        self.n_tokens += n
        self.held.append(raw)
        self.held_bytes += len(raw)
        if self.held_bytes >= self.batch * self.sequence * self.dtype.itemsize:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), dtype=self.dtype)
        full = self.batch * self.sequence
        at = 0
        while len(ids) - at >= full:
            self._write(ids[at : at + full], full)
            at += full
        rest = ids[at:]
        if last and len(rest):
            n = -(-len(rest) // self.sequence) * self.sequence
            self._write(np.concatenate([rest, np.zeros(n - len(rest), dtype=self.dtype)]), len(rest))
            rest = rest[:0]
        self.held, self.held_bytes = [rest.tobytes()], rest.nbytes

    def _write(self, ids: np.ndarray, real: int) -> None:
        ones = np.clip(real - np.arange(0, len(ids), self.sequence), 0, self.sequence).astype(np.int32)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.sequence), pa.DictionaryArray.from_arrays(pa.array(ones), self.masks)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(last=True)
        self.file.close()
        self.sink.close()
        ids, starts, sizes = zip(*self.index, strict=True)
        with self.fs.open_output_stream(self.path + ".index") as sink:
            batch = pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "start", "n_tokens"])
            with pa.ipc.new_file(sink, batch.schema) as f:
                f.write_batch(batch)


class Shard:
    """Random access to a shard's sequences; views of mapped memory on a local or mounted path."""

    def __init__(self, uri: str):
        self.fs, path = filesystem(uri)
        local = self.fs.type_name == "local"
        self.source = pa.memory_map(path) if local else self.fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.path = path
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.rows + self.file.get_batch(n - 1).num_rows if n else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence ``i``; neither is copied, on a local path both are views of the mapped file."""
        batch = self.file.get_batch(i // self.rows)
        ids, masks = batch.column(0)[i % self.rows].values, batch.column(1)
        mask = masks.dictionary[masks.indices[i % self.rows].as_py()].values
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=True)

    def batches(self) -> Iterator[np.ndarray]:
        """The ids of each batch in one flat array, padding left out."""
        for k in range(self.file.num_record_batches):
            batch = self.file.get_batch(k)
            yield batch.column(0).flatten().to_numpy(zero_copy_only=True)[: batch.column(1).indices.to_numpy().sum()]

    def documents(self) -> Iterator[tuple]:
        """(doc_id, start, ids in one or more arrays) in order, holding a batch at a time."""
        with self.fs.open_input_file(self.path + ".index") as f:
            index = pa.ipc.open_file(f).read_all()
        flat = self.batches()
        now = next(flat, np.empty(0, np.uint16))
        for doc_id, start, n in zip(*(index.column(c).to_pylist() for c in range(3)), strict=True):
            parts = []
            while n > len(now):
                parts.append(now)
                n -= len(now)
                now = next(flat)
            parts.append(now[:n])
            now = now[n:]
            yield doc_id, start, parts


def write_shards(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = END_ID, sequence: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """Encode ``docs`` (doc_id, text) to shards in ``out_dir``; returns the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        end = np.asarray([end_id], dtype=enc.dtype).tobytes()
        out, uri = None, f"{out_dir}/shards/{uuid.uuid4().hex}.arrow"
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            if ids and out is None:
                fs, path = filesystem(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = ShardWriter(uri, enc.dtype, sequence, batch)
            for doc_id, raw in zip(ids, tokens.encode_blocks(texts, enc), strict=True):
                out.add(doc_id, raw + end)
        if out is not None:
            out.close()
            first, n = out.index[0][0], len(out.index)
            yield pa.record_batch([pa.array([uri]), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([out.n_tokens], pa.int64())], ["shard", "first_id", "n_docs", "n_tokens"])

    small_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{out_dir}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row for each document, from the shards: place in the whole stream, length, checksum."""
    # The window sees one row for each shard, not for each document.
    before = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")).repartition(max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, starts, sizes, sums = [], [], [], []
                for doc_id, start, parts in Shard(uri).documents():
                    crc = 0
                    for p in parts:
                        crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                    ids.append(doc_id)
                    starts.append(base + start)
                    sizes.append(sum(map(len, parts)))
                    sums.append(crc)
                yield pa.record_batch([*(pa.array(x, pa.int64()) for x in (ids, starts, sizes, sums)), pa.array([uri] * len(ids))], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return shards.mapInArrow(read, RESULT)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "tokens")
    manifest = write_shards(table(spark, sf_dir, "documents"), out, tokens.vocabulary_path("word_bpe_49k.json"))
    return read_documents(manifest)
