"""Quality classifier: a generalised additive model with pairwise interactions.

A document is described by a few shape measures of its whole text. Each measure is cut into
bins at quantiles of the training sample. Cyclic boosting visits the measures in turn and
adds, a small step at a time, a shallow regression tree over the bins of one measure to that
measure's lookup table; then it does the same for the pairs of measures whose joint bins
explain most of what is left. A score is the sigmoid of a sum of looked-up values.

Training uses at most ``SAMPLE_ROWS`` labelled documents, those with the smallest hash of
their id among the ones not held out. Neither labels, language, source nor id is an input.

Cases: a null text counts as empty and is scored like any text; null labels are left out; a
document labelled twice counts twice; with labels of one class only, or none, all scores are
the share of label 1 (1 without any label); null ids get scores; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back_memory, held_out, shared_dir, small_batches, table, without_encoders, written
from .words import word_hashes

SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 120, 60, 0.15, 4
MIN_LEAF = 5
MEASURES = (
    "log_bytes", "log_words", "word_bytes", "capitals", "digits", "symbols", "points", "line_share", "distinct_words",
    "same_as_before", "top_word", "distinct_lines", "words_a_stop", "symbol_ends", "short_words", "all_capitals", "single_marks",
)
FEATURES = "doc_id long, held_out boolean, measures array<float>"
RESULT = "doc_id long, held_out boolean, score double, predicted int"

# Kinds of bytes: 0 other letters, 1 capital, 2 small, 3 digit, 4 point, 5 symbol, 6 space, 7 line break.
_KIND = np.array([0 if b >= 128 else 7 if b == 10 else 6 if b <= 32 else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if chr(b) in ".,;:!?'\"-()" else 5 for b in range(256)], dtype=np.uint8)


def measures(text: str | None) -> np.ndarray:
    """The MEASURES of a whole text."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    kind = _KIND[data]
    n = np.bincount(kind, minlength=8).astype(float)
    words, starts, ends = word_hashes(data)
    w, visible = len(words), max(1.0, n[:6].sum())
    letters = max(1.0, n[:3].sum())
    out = np.zeros(len(MEASURES), dtype=np.float32)
    if not w:
        return out
    _, counts = np.unique(words, return_counts=True)
    lines = np.unique(np.searchsorted(starts, np.flatnonzero(data == 10)))
    firsts = np.concatenate([[0], lines[(lines > 0) & (lines < w)]])
    with np.errstate(over="ignore"):
        line_hash = np.add.reduceat(words * (np.arange(w).astype(np.uint64) - np.repeat(firsts, np.diff(np.append(firsts, w))).astype(np.uint64) + np.uint64(1)), firsts)
    sizes = ends - starts
    last = kind[ends - 1]
    capital_words = np.add.reduceat((kind == 2).astype(np.int64), starts) if w else np.zeros(1)
    out[:] = (
        np.log1p(len(data)), np.log1p(w), sizes.mean(), n[1] / letters, n[3] / visible, n[5] / visible, n[4] / visible, len(firsts) / w, len(counts) / w,
        (words[1:] == words[:-1]).mean() if w > 1 else 0, counts.max() / w, len(np.unique(line_hash)) / len(firsts), w / (1 + (data == 46).sum()), (last == 5).mean(), (sizes <= 3).mean(),
        ((capital_words == 0) & (sizes > 1)).mean(), ((sizes == 1) & (kind[starts] == 5)).mean(),
    )
    return out


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, measures), from one pass over the texts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_encoders()
        for b in batches:
            rows = [measures(t) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "held_out", "measures"])
        give_back_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(measure, FEATURES)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Values of a shallow tree over ordered bins: greedy splits, Newton steps at the leaves."""
    n = len(gradient)
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    score = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    parts = [(0, n)]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = score(a, at) + score(at, b) - score(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (a, b), int(at[k]))
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove((a, b))
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(n)
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A tree that cuts one side of a table of bins, then each part on the other side."""
    best, out = -1.0, None
    for flip in (False, True):
        g, h = (gradient.T, weight.T) if flip else (gradient, weight)
        for cut in range(1, g.shape[0]):
            made = np.zeros_like(g, dtype=float)
            total = 0.0
            for part in (slice(0, cut), slice(cut, None)):
                line_g, line_h = g[part].sum(0), h[part].sum(0)
                made[part] = _tree(line_g, line_h, 2)
                total += (made[part][0] * line_g).sum()
            if total > best:
                best, out = total, made.T if flip else made
    return out


@dataclass
class Model:
    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    start: float
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        bins = self.binned(x, self.edges)
        for k, t in enumerate(self.tables):
            total += t[bins[:, k]]
        if self.pairs:
            wide = self.binned(x, self.pair_edges)
            for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
                total += t[wide[:, a], wide[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins)) for k in range(x.shape[1])]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Model:
    x = np.asarray(x, dtype=np.float32).reshape(len(y), len(MEASURES))
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return Model([np.empty(0)] * len(MEASURES), [np.empty(0)] * len(MEASURES), 30.0 if share else -30.0)
    model = Model(_edges(x, BINS), _edges(x, PAIR_BINS), float(np.log(y.mean() / (1 - y.mean()))))
    bins = model.binned(x, model.edges)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.start)
    for _ in range(rounds):
        for k, t in enumerate(model.tables):
            p = 1 / (1 + np.exp(-total))
            size = len(t)
            step = RATE * _tree(np.bincount(bins[:, k], y - p, size), np.bincount(bins[:, k], p * (1 - p), size))
            t += step
            total += step[bins[:, k]]
    wide = model.binned(x, model.pair_edges)
    shape = [len(e) + 1 for e in model.pair_edges]
    cell = lambda a, b: wide[:, a] * shape[b] + wide[:, b]

    def gathered(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        c, n = cell(a, b), shape[a] * shape[b]
        return np.bincount(c, y - p, n).reshape(shape[a], shape[b]), np.bincount(c, p * (1 - p), n).reshape(shape[a], shape[b])

    gains = []
    for a in range(len(MEASURES)):
        for b in range(a):
            g, h = gathered(a, b)
            gains.append((float((g**2 / (h + 1)).sum()), a, b))
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((shape[a], shape[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            step = _pair_tree(*gathered(a, b))
            if step is not None:
                t += RATE * step
                total += RATE * step[wide[:, a], wide[:, b]]
    return model


def trained(features: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out."""
    known = labels.filter("quality IN (0, 1)").select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("quality"))
    sample = features.filter(~F.col("held_out")).join(known, F.col("doc_id") == F.col("labelled")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    data = sample.select("measures", "quality").toArrow()
    x = np.asarray(data.column("measures").combine_chunks().flatten(), dtype=np.float32)
    return fit(x, np.asarray(data.column("quality"), dtype=float))


def scored(features: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    shared = features.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(2).flatten(), dtype=np.float32).reshape(b.num_rows, -1)
            s = shared.value.score(x) if b.num_rows else np.empty(0)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return features.mapInArrow(add, RESULT)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, in their own columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_encoders()
        for b in batches:
            if b.num_rows:
                x = np.stack([measures(t) for t in b.column(at).to_pylist()])
                yield b.filter(pa.array(shared.value.score(x) >= threshold))
        give_back_memory()

    return docs.mapInArrow(keep, docs.schema)


def learn(docs: DataFrame, labels: DataFrame, out_dir: str) -> tuple[DataFrame, Model]:
    small_batches(docs.sparkSession)
    features = written(measured(docs), f"{out_dir}/measures")
    return features, trained(features, labels)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, model = learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), shared_dir(spark, "quality"))
    return scored(features, model)
