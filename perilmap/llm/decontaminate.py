"""Benchmark decontamination by the q-gram lemma.

Documents and benchmark items are folded (lower case; letters and digits kept, all else one
space), so that changed case, marks or line breaks hide nothing. An item of ``m`` bytes may
differ by ``e = m * ERROR_RATE`` edits; by the q-gram lemma a region within that budget
shares at least ``m + 1 - q - q * e`` q-grams with it, all on at most ``e + 1`` neighbouring
diagonals. Shared q-grams are therefore counted in bands of ``2 (e + 1)`` diagonals that
overlap by half, bands that reach the bound are kept and verified by a banded alignment.

The benchmark is taken in blocks of at most ``BLOCK_CHARS`` characters, each of which is
sent to the executors and held against all documents, so documents are read once for each
block, never shuffled, and long ones are taken in overlapping pieces. Shared q-grams are
expanded ``HITS`` at a time, however often a text repeats one, and marked in a table of a piece's
bands and the item's places, about ten bytes for each byte of the piece.

Cases: null or empty texts match nothing; items of fewer than ``Q`` bytes after folding share no
q-gram and are found where they stand as whole words without an edit; items that fold to
nothing match nothing; equal items each report their matches; repeated rows are each
judged; an empty benchmark or table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, table, without_encoders, written

Q = 8
ERROR_RATE = 0.1
BLOCK_CHARS = 2_000_000
PIECE = 1 << 19
HITS, RUN = 1 << 20, 1024
_FILTER_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
_GAPS = re.compile(r"[\W_]+")
RESULT = "doc_id long, item_id long, edits int, start long, length int"


def folded(text: str) -> bytes:
    return _GAPS.sub(" ", text.lower()).strip().encode()


def codes(data: np.ndarray) -> np.ndarray:
    """Each window of eight bytes as an integer."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    four = data[: n + 4].astype(np.uint32)
    for k in (1, 2, 3):
        four |= data[k : k + n + 4].astype(np.uint32) << np.uint32(8 * k)
    return four[:n].astype(np.uint64) | (four[4 : 4 + n].astype(np.uint64) << np.uint64(32))


def _slot(c: np.ndarray) -> np.ndarray:
    return ((c * _MIX) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def budget(m: int) -> int:
    """Edits an item of ``m`` bytes may have, so that its bound is at least one q-gram."""
    return min(int(m * ERROR_RATE), (m - Q) // Q)


def banded_distance(item: bytes, text: bytes, first: int, last: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of ``item`` in ``text`` among paths that begin on
    diagonals ``first`` to ``last``; None if it takes more than ``most`` edits."""
    low, width = first - most, last - first + 2 * most + 1
    t = np.full(len(item) + width + 1, 256, dtype=np.int16)  # text from position low on
    a, b = max(low, 0), min(len(text), low + len(t))
    if b > a:
        t[a - low : b - low] = np.frombuffer(text[a:b], dtype=np.uint8)
    ramp, far = np.arange(width), most + 1
    row = np.zeros(width, dtype=np.int64)  # cell k: column low + k, free start
    start = low + ramp
    row[start < 0] = far
    for i, byte in enumerate(item):
        # Cell k of row i + 1 stands at column low + k + i + 1.
        new = row + (t[i : i + width] != byte)
        origin = start.copy()
        up = np.append(row[1:] + 1, far + 1)
        better = up < new
        new[better] = up[better]
        origin[better] = np.append(start[1:], 0)[better]
        left = np.minimum.accumulate(new - ramp)
        source = np.maximum.accumulate(np.where(new - ramp == left, ramp, 0))
        shifted = left + ramp < new
        new[shifted] = (left + ramp)[shifted]
        start = np.where(shifted, origin[source], origin)
        row = new
        if row.min() > most:
            return None
    k = int(row.argmin())
    return int(row[k]), int(start[k]), low + k + len(item)


@dataclass
class Index:
    """The q-grams of one block of benchmark items."""

    ids: list
    items: list[bytes]
    grams: np.ndarray  # distinct, sorted; the owners of gram g are owner[first[g] : first[g + 1]]
    first: np.ndarray
    owner: np.ndarray
    seen: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    widest: int
    overlap: int
    short: list[tuple]
    #: Of each item its distinct grams (by number), where the places of each begin, and the places.
    per_item: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple]) -> Index:
        every = [(i, folded(t or "")) for i, t in rows]
        short = [(i, f) for i, f in every if 0 < len(f) < Q]
        rows = [(i, f) for i, f in every if len(f) >= Q]
        items = [f for _, f in rows]
        per = [codes(np.frombuffer(f, dtype=np.uint8)) for f in items]
        grams, which = np.unique(np.concatenate(per) if per else np.empty(0, np.uint64), return_inverse=True)
        owner = np.repeat(np.arange(len(items)), [len(p) for p in per]).astype(np.int64)
        owner = owner[np.argsort(which, kind="stable")]
        per_item, at = [], 0
        for p in per:
            own, n = np.unique(which[at : at + len(p)], return_counts=True)
            per_item.append((own, np.concatenate([[0], np.cumsum(n)]), np.argsort(which[at : at + len(p)], kind="stable")))
            at += len(p)
        seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        seen[_slot(grams)] = True
        sizes = np.array([len(f) for f in items], dtype=np.int64)
        edits = np.array([budget(len(f)) for f in items], dtype=np.int64)
        widest = int(sizes.max(initial=0))
        first = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(grams)))])
        return cls([i for i, _ in [*rows, *short]], items, grams, first, owner, seen, edits, sizes + 1 - Q - Q * edits, widest, 2 * (widest + 3 * budget(widest) + 3), short, per_item)

    def candidates(self, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first band, last band) of neighbouring bands whose shared q-grams reach the bound.

        A q-gram of the item counts once in a band; at most ``RUN`` bands are given together.
        """
        c = codes(data)
        at = np.flatnonzero(self.seen[_slot(c)])
        if not len(at):
            return
        gram = np.minimum(np.searchsorted(self.grams, c[at]), len(self.grams) - 1)
        mine = self.grams[gram] == c[at]
        at, gram = at[mine], gram[mine]
        if not len(at):
            return
        some = np.unique(gram)
        first, n = self.first[some], self.first[some + 1] - self.first[some]
        k = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        items, counts = np.unique(self.owner[k], return_counts=True)
        for j in items[counts >= self.bound[items]].tolist():
            own, starts, place, e = *self.per_item[j], int(self.edits[j])
            i = np.minimum(np.searchsorted(own, gram), len(own) - 1)
            mine = own[i] == gram
            here, i = at[mine], i[mine]
            first, n = starts[i], starts[i + 1] - starts[i]
            # What a band shares lies within the item's length and the band's width of the text.
            held = np.concatenate([[0], np.cumsum(n)])
            before = np.searchsorted(here, here - (len(self.items[j]) - Q + 2 * (e + 1)))
            if (held[1:] - held[before]).max() < self.bound[j]:
                continue
            low = (int(here[0]) - int(place.max()) + self.widest) // (e + 1) - 1
            high = (int(here[-1]) - int(place.min()) + self.widest) // (e + 1)
            met = np.zeros((high - low + 1, int(place.max()) + 1), dtype=bool)
            cuts = np.flatnonzero(np.diff(np.cumsum(n) // HITS)) + 1
            for here_, first_, n_ in zip(np.split(here, cuts), np.split(first, cuts), np.split(n, cuts), strict=True):
                mine = place[np.repeat(first_ - np.concatenate([[0], np.cumsum(n_)[:-1]]), n_) + np.arange(n_.sum())]
                band = (np.repeat(here_, n_) - mine + self.widest) // (e + 1) - low
                met[band, mine] = True
                met[band - 1, mine] = True
            full = np.flatnonzero(met.sum(1) >= self.bound[j])
            for run in np.split(full, np.flatnonzero((np.diff(full) > 1) | (np.diff(full // RUN) > 0)) + 1):
                if len(run):
                    yield j, int(run[0]) + low, int(run[-1]) + low

    def matches(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """Of a text, the best match of each item: (edits, start, length) in the folded text."""
        found: dict[int, tuple[int, int, int]] = {}
        if not text or not self.ids:
            return found
        whole, overlap, widest = folded(text), self.overlap, self.widest
        if self.short:
            spaced = b" " + whole + b" "
            for j, (_, item) in enumerate(self.short, len(self.items)):
                if (at := spaced.find(b" " + item + b" ")) >= 0:
                    found[j] = (0, at, len(item))
        if not self.items:
            return found
        at = 0
        while True:
            part = whole[at : at + PIECE + overlap]
            for j, band, last in self.candidates(np.frombuffer(part, dtype=np.uint8)):
                item, e = self.items[j], int(self.edits[j])
                if found.get(j, (1,))[0] == 0:
                    continue
                low = band * (e + 1) - widest
                high = (last - band + 2) * (e + 1) + low - 1
                a = max(0, low - e)
                exact = part.find(item, a, high + e + len(item) + 1)
                hit = (0, exact, exact + len(item)) if exact >= 0 else banded_distance(item, part, low, high, e)
                if hit and hit[0] <= e and hit[0] < found.get(j, (e + 1,))[0]:
                    found[j] = (hit[0], at + max(hit[1], 0), hit[2] - max(hit[1], 0))
            if at + PIECE + overlap >= len(whole):
                return found
            at += PIECE


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """The benchmark's items in blocks of bounded size; the driver holds one at a time."""
    held, n = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        if held and n + len(r[1] or "") > block_chars:
            yield Index.of(held)
            held, n = [], 0
        held.append((r[0], r[1]))
        n += len(r[1] or "")
    if held:
        yield Index.of(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, out_dir: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, length): each document's best match of each item that it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    out = None
    for k, index in enumerate(benchmark_blocks(benchmark, block_chars)):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                rows = [(i, index.ids[j], *hit) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for j, hit in index.matches(t).items()]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "item_id", "edits", "start", "length"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, RESULT)
        found = written(found, f"{out_dir}/block{k}")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], RESULT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without any match; each block filters what the block before has left.

    What the blocks before the last have left is stored, so that one block is broadcast at a time.
    """
    spark, out_dir, shared = docs.sparkSession, None, None
    small_batches(spark)
    schema = docs.schema
    at = docs.columns.index("text")
    for k, index in enumerate(benchmark_blocks(benchmark, block_chars)):
        if k:
            out_dir = out_dir or shared_dir(spark, "clean")
            docs = written(docs, f"{out_dir}/block{k}")
            shared.destroy()
        shared = spark.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            without_encoders()
            index = shared.value
            for b in batches:
                yield b.filter(pa.array([not index.matches(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shared_dir(spark, "leaks"))
