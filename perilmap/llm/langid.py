"""Language identification with bit-sliced Bloom filters over character n-grams.

The filters of all languages share one array: slot ``s`` holds a bitmask with the bit of
each language that has set it. And-ing the slots of an n-gram's hashes gives every language
that has the n-gram at once. A text's n-grams are counted for each language bit, each count
is corrected for that filter's false positive rate, and the largest wins. Its score is the
share of its odds, which double with each n-gram that it has beyond another language.

Training reads a bounded sample of each language's labelled, not held-out documents: those
whose hash falls under a share chosen from the language's count, so that ``SAMPLE_DOCS`` are
expected. Documents of more than ``SAMPLE_CHARS`` characters are read only for languages that
have no other. N-grams are counted in the tasks and set as bits there; what reaches the driver
is the filters, at most ``SLOTS`` numbers for each 64 languages. N-grams seen fewer than
``MIN_COUNT`` times are left out where the language has ``FEW_DOCS`` documents or more.

Cases: a null text or one without a letter is ``und`` with score 0; without training rows all
are ``und``; ties go to the language with more training documents, then by name; texts are
read whole, in blocks; null or repeated ids keep their rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, pieces_of, small_batches, table

GRAM = 4
SLOTS = 1 << 20
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 20_000
MIN_COUNT, FEW_DOCS = 2, 20
BLOCK = 1 << 19
UNKNOWN = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"

#: Bytes that are no ASCII letter and no part of a longer character become spaces.
_KEEP = np.array([b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)], dtype=np.uint8)


def folded(text: str) -> np.ndarray:
    return _KEEP[np.frombuffer(f"  {text.lower()}  ".encode(), dtype=np.uint8)]


def grams(data: np.ndarray) -> np.ndarray:
    """Each GRAM-byte window as an integer."""
    n = len(data) - GRAM + 1
    out = data[:n].astype(np.uint32)
    for k in range(1, GRAM):
        out |= data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    return out


def slots(codes: np.ndarray) -> Iterator[np.ndarray]:
    wide = codes.astype(np.uint64)
    for h in HASHES:
        yield ((wide * np.uint64(h)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]  # by number of training documents, then name
    words: list[np.ndarray]  # for each 64 languages, every slot's mask
    false_rate: np.ndarray

    @classmethod
    def of(cls, languages: list[str], slot: np.ndarray, word: np.ndarray, mask: np.ndarray) -> Model:
        """From the slots that are set: slot, which 64 languages, and their bits."""
        width = next((w for w in (8, 16, 32) if len(languages) <= w), 64)
        words = [np.zeros(SLOTS, dtype=f"u{width // 8}") for _ in range(max(1, -(-len(languages) // 64)))]
        for k, w in enumerate(words):
            w[slot[word == k]] = mask[word == k].view(np.uint64).astype(w.dtype)
        rates = [np.mean(words[bit // 64] >> np.asarray(bit % 64, words[0].dtype) & 1) ** len(HASHES) for bit in range(len(languages))]
        return cls(languages, words, np.array(rates))

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, corrected number that each language has)."""
        data = [folded(t) for t in texts]
        total = np.zeros(len(texts))
        found = np.zeros((len(texts), len(self.languages)))
        for block in pieces_of(map(len, data), BLOCK, GRAM - 1):
            joined = np.concatenate([data[i][a:b] for i, a, b in block])
            ends = np.cumsum([b - a for _, a, b in block])
            starts = np.concatenate([[0], ends[:-1]])
            codes = grams(joined)
            at = list(slots(codes))
            real = codes != 0x20202020
            for k in range(1, GRAM):  # windows that reach into the next text
                real[ends[:-1] - k] = False
            which = np.array([i for i, _, _ in block])
            np.add.at(total, which, np.add.reduceat(real, starts, dtype=np.int64))
            for k, word in enumerate(self.words):
                masks = word[at[0]]
                for s in at[1:]:
                    masks &= word[s]
                masks[~real] = 0
                for bit in range(64 * k, min(64 * k + 64, len(self.languages))):
                    np.add.at(found[:, bit], which, np.add.reduceat((masks >> masks.dtype.type(bit % 64)) & 1, starts, dtype=np.int64))
        return total, np.clip((found - total[:, None] * self.false_rate) / (1 - self.false_rate), 0, None)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known:
            _, found = self.counts([texts[i] for i in known])
            best = found.argmax(1)
            # Each n-gram that one language has beyond another doubles the odds between the two.
            odds = np.exp2(np.maximum(found - found.max(1)[:, None], -1000)).sum(1)
            for i, b, o in zip(known, best, odds, strict=True):
                names[i], scores[i] = self.languages[b], 1 / o
        return names, scores


def set_slots(codes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, word, mask), each slot once for each word, of n-grams and their languages' bits."""
    slot = np.concatenate(list(slots(codes)))
    bits = np.tile(bits.astype(np.int64), len(HASHES))
    key, where = np.unique(slot * (1 << 20) + bits // 64, return_inverse=True)
    mask = np.zeros(len(key), dtype=np.uint64)
    np.bitwise_or.at(mask, where, np.uint64(1) << (bits % 64).astype(np.uint64))
    return key >> 20, key & ((1 << 20) - 1), mask.view(np.int64)


def learn(docs: DataFrame, per_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """Set the filters from a sample of each language."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", F.length("text").alias("length"))
    short = F.count_if(F.col("length") <= chars)
    known = sorted(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), short.alias("short")).collect(), key=lambda r: (-r["n"], r["lang"]))
    if not known:
        return Model([], [np.zeros(SLOTS, np.uint8)], np.empty(0))
    place = {r["lang"]: k for k, r in enumerate(known)}
    shares = spark.createDataFrame([(r["lang"], per_language / (r["short"] or r["n"]), not r["short"]) for r in known], "language string, share double, long_too boolean")
    drawn = F.pmod(F.xxhash64("doc_id", "length"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.join(F.broadcast(shares), F.col("lang") == F.col("language")).filter((drawn < F.col("share")) & (F.col("long_too") | (F.col("length") <= chars))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name in set(names):
                mine = [folded(t) for n, t in zip(names, texts, strict=True) if n == name]
                codes, n = np.unique(np.concatenate([grams(d) for d in mine]), return_counts=True)
                real = codes != 0x20202020
                yield pa.record_batch([pa.array(np.full(real.sum(), place[name], np.int32)), pa.array(codes[real].astype(np.int64)), pa.array(n[real])], ["bit", "code", "n"])

    def place_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([pa.array(x) for x in set_slots(b.column(0).to_numpy().astype(np.uint32), b.column(1).to_numpy())], ["slot", "word", "mask"])

    counted = sample.mapInArrow(count, "bit int, code long, n long").groupBy("bit", "code").agg(F.sum("n").alias("n"))
    few = [k for k, r in enumerate(known) if r["n"] < FEW_DOCS]
    enough = counted.filter((F.col("n") >= MIN_COUNT) | F.col("bit").isin(few)).select("code", "bit")
    bits = enough.mapInArrow(place_bits, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    return Model.of(list(place), *(bits.column(c).to_numpy() for c in ("slot", "word", "mask")))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.predict(b.column(2).to_pylist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(predict, RESULT)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
