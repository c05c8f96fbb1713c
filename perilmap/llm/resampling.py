"""Importance resampling: draw the documents whose words look like those of a target corpus.

A vectorised automaton reads the bytes of an Arrow text column as they lie in its buffer. A
table of 256 entries classifies each byte and lowers ASCII capitals; a word is a run of digits,
letters and bytes of other scripts, and its ends are where neighbouring classes differ. The
CRC-32 of all words of a block advances by one byte at a time for all starts together, through
the CRC's table of 256 entries; words of more than ``TABLE_BYTES`` bytes, which are few, go
through the library's CRC. A feature of several words goes on from the state of the words before.

Each feature falls into a bucket. Counts by bucket over all documents and over the target are
summed in each task, then shuffled; the gains of the buckets, at most ``MOST_BUCKETS`` numbers
however much text there is, travel with the task. A document's weight is the sum of the gains
of its features. Weight plus Gumbel noise, drawn from the hash of its id, is its score, and the
highest scores are a sample without replacement by weight. Ranks come from a range partitioning
by score: a partition's rows are numbered within it and its rows are counted for those behind.

Cases: a null text has no words; a null id is drawn as an empty one and follows other ids; ties
of score go to the smaller id, then to fewer features; repeated rows keep a row each; empty
documents give no rows, an empty target gives gains of its smoothing alone; columns other than
``doc_id`` and ``text`` are ignored. Long texts are read in blocks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back_memory, shared_dir, small_batches, table, without_encoders, written

BUCKETS = 10_000
MOST_BUCKETS = 1 << 20
SEED = "2024:"
MIN_WORDS = 20
PERCENT = 10
#: Bytes that are classified in one go; a block ends between words.
BLOCK = 1 << 19
#: Bytes of a word that the table advances.
TABLE_BYTES = 48

_IS_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def _crc_table() -> np.ndarray:
    """The reflected table of CRC-32, from its polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_CRC = _crc_table()

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS x FROM d), bw AS (SELECT unnest(w) AS x FROM b),
u AS (SELECT x FROM dw UNION SELECT x FROM bw),
h AS (SELECT x, hex(encode(x)) AS y, tab FROM u, crc),
k AS (SELECT x, xor(list_reduce([4294967295] || list_transform(range(1, length(y), 2), lambda i: CAST('0x' || substr(y, i, 2) AS BIGINT)), lambda c, v: xor(c >> 8, tab[(xor(c, v) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM h),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN k USING (x) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN k USING (x) GROUP BY bucket),
tot AS (SELECT CAST((SELECT count(*) FROM dw) AS DOUBLE) AS big_s, CAST((SELECT count(*) FROM bw) AS DOUBLE) AS big_t),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (big_s + {BUCKETS}) / ((s + 1) * (big_t + {BUCKETS})))) AS BIGINT) AS gain FROM tot, s LEFT JOIN t ON s.bucket = t.bucket),
f AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM dw JOIN k USING (x) JOIN g USING (bucket) GROUP BY doc_id),
a AS (SELECT d.doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('{SEED}' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN f ON d.doc_id = f.doc_id),
e AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM a),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM e WHERE n_features >= {MIN_WORDS})
SELECT e.doc_id, n_features, weight, score, CAST(CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS BIGINT) AS rank FROM e LEFT JOIN r ON e.doc_id = r.doc_id
"""


def _advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC states after the words at ``starts`` of ``data``, from the states before them."""
    out = state.copy()
    for i in np.flatnonzero(sizes > TABLE_BYTES).tolist():
        word = data[starts[i] : starts[i] + sizes[i]].tobytes()
        out[i] = zlib.crc32(word, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    short = np.flatnonzero(sizes <= TABLE_BYTES)
    short = short[np.argsort(-sizes[short], kind="stable")]
    lengths, at, now = sizes[short], starts[short], out[short]
    left = np.searchsorted(-lengths, -np.arange(TABLE_BYTES), side="left")  # words of more than k bytes
    for k in range(int(lengths[0]) if len(lengths) else 0):
        n = left[k]
        now[:n] = _CRC[(now[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (now[:n] >> np.uint32(8))
    out[short] = now
    return out


def word_blocks(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, size, text number) of the words of texts that lie end to end, block by block."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + BLOCK)
        while stop < len(data):  # go on to the next byte that is in no word
            gap = np.flatnonzero(~_IS_WORD[data[stop - 1 : stop + BLOCK]])
            if len(gap):
                stop = stop - 1 + int(gap[0]) + 1
                break
            stop = min(len(data), stop + BLOCK)
        inside = _IS_WORD[data[at:stop]]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        # A text's last byte ends a word, and the next byte begins one.
        cuts = ends[np.searchsorted(ends, at, side="right") : np.searchsorted(ends, stop, side="right")] - at
        last[cuts - 1] = inside[cuts - 1]
        cuts = cuts[cuts < stop - at]
        first[cuts] = inside[cuts]
        starts = np.flatnonzero(first)
        yield starts + at, np.flatnonzero(last) + 1 - starts, np.searchsorted(ends, starts + at, side="right")
        at = stop


def features(column: pa.Array, most_words: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text number, bucket) of the features of a text column, and the words among them, block by block."""
    column = column.cast(pa.large_string())
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if values is None or bounds[-1] == bounds[0]:
        return
    data = _LOWER[np.frombuffer(values, dtype=np.uint8)[bounds[0] : bounds[-1]]]
    kept = None  # the last words of the block before, for features that reach over its end
    for starts, sizes, texts in word_blocks(data, bounds[1:] - bounds[0]):
        new = 0
        if kept is not None:
            new = len(kept[0])
            starts, sizes, texts = (np.concatenate([a, b]) for a, b in zip(kept, (starts, sizes, texts), strict=True))
        state = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
        for k in range(most_words):
            n = len(starts) - k
            if n <= 0:
                break
            if k:  # the space between two words
                state = _CRC[(state[:n] ^ np.uint32(32)) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
            state = _advance(state, data, starts[k:], sizes[k:])
            whole = texts[:n] == texts[k:]
            whole[: max(0, new - k)] = False  # its last word belongs to the block before
            yield texts[:n][whole], (state[whole] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets), int(k == 0)
        if most_words > 1:
            kept = starts[1 - most_words :], sizes[1 - most_words :], texts[1 - most_words :]


def bucket_counts(texts: DataFrame, most_words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_encoders()
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, found, _ in features(batch.column(0), most_words, buckets):
                held += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(held)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(held[used], pa.int64())], ["bucket", "n"])
        give_back_memory()

    small_batches(texts.sparkSession)
    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, most_words: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket adds to a weight: thousands of the logarithm of its smoothed ratio."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}, as their gains travel with each task")
    raw, wanted = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    for texts, counts in ((docs, raw), (target, wanted)):
        found = bucket_counts(texts, most_words, buckets).toArrow()  # a row for each bucket at most
        counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return gains_of(raw, wanted)


def gains_of(raw: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    size = len(raw)
    big_s, big_t = float(raw.sum() + size), float(wanted.sum() + size)
    return np.array([math.floor(1000 * math.log((t + 1.0) * big_s / ((s + 1.0) * big_t))) for s, t in zip(raw.tolist(), wanted.tolist(), strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, most_words: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_encoders()
        for batch in batches:
            rows = batch.num_rows
            words, sizes, weights = (np.zeros(rows, dtype=np.int64) for _ in range(3))
            for texts, found, single in features(batch.column(1), most_words, buckets):
                here = np.bincount(texts, minlength=rows)
                sizes += here
                words += here * single
                # Sums of whole numbers far below 2 ** 53 are exact in doubles.
                weights += np.bincount(texts, weights=gains[found], minlength=rows).astype(np.int64)
            yield pa.record_batch([batch.column(0), *(pa.array(x) for x in (words, sizes, weights))], ["doc_id", "n_words", "n_features", "weight"])
        give_back_memory()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(weighed: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds ``score``: the weight and noise from the hash of the id."""
    key = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise.cast("long"))


def drawn(scores: DataFrame, out_dir: str, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds ``rank`` to (doc_id, n_words, n_features, weight, score): 1, 2, 3... for the rows drawn, null for others.

    ``percent`` of the rows with ``min_words`` words are drawn, rounded down.
    """
    fit = F.col("n_words") >= min_words
    order = (F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc())
    by_score = scores.withColumn("fit", fit).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(by_score.withColumn("at", F.monotonically_increasing_id()), f"{out_dir}/placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    # The window sees one row for each partition, not for each document.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("fit").cast("long")).alias("fits"))
    bases = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), F.floor(F.sum("fits").over(Window.partitionBy()) * percent / 100).alias("cut"))
    place = F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    # One row for each partition: what is broadcast doesn't grow with the rows.
    ranked = placed.join(F.broadcast(bases), "part")
    return ranked.select(*scores.columns, F.when(F.col("fit") & (place <= F.col("cut")), place).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, out_dir: str, percent: int = PERCENT, min_words: int = MIN_WORDS, most_words: int = 1, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Every document with n_words, n_features, weight, score and rank (null if it isn't drawn)."""
    gains = bucket_gains(docs, target, most_words, buckets)
    scores = written(scored(weigh(docs, gains, most_words), seed), f"{out_dir}/scores")
    return drawn(scores, out_dir, percent, min_words)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "resampling")
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), out).select("doc_id", "n_features", "weight", "score", "rank")
