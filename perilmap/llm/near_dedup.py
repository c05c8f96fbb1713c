"""Near-duplicate classes by improved consistent weighted sampling.

A document is the weighted set of its shingles of five words. A shingle's weight is its
count in the text times ``1 + ln(N / df) / ln N``: one of a single document weighs 2, one of all
documents 1, so a common line alone makes no duplicate. Document frequencies are exact, of every
shingle, and over all documents: packets of hashes go to the part of the hashes that they lie in, where they are
counted, and the frequencies from two on go back to the homes (groups by hash) of the documents that hold
them. All other shingles are in one document. Nothing of this is broadcast or held by the driver.

Each of ``SAMPLES`` samples picks a shingle and a level; the draws of a shingle and a sample
lie in a fixed table at a place given by the shingle's hash, and a sample is named by the
full hash, so that long texts without a common shingle never agree. Sketches are banded. In
each bucket every member is held against one head, links are verified by the exact weighted
Jaccard similarity and joined to classes. Buckets whose members are still of several classes
take more of their members as heads, first about ``HEADS`` and then the others, and hold each
against all members of other classes, block against block: pairs that share no earlier bucket
and whose sketches agree in ``LEAST_MATCHES`` samples are verified there and then, and only links
leave the task. Members of a bucket's main class need not be heads, as every other member is
in the end. So a group of thousands of copies costs a few rows for each copy, never all its
pairs, and no link between documents that share a bucket is lost but those whose sketches
agree less (for a similarity of 0.8 one in a million; 0 as the parameter verifies all).

Cases: equal word sequences are one class at once; a text of fewer than five words is one
shingle of all of them; null and empty texts have no words and are one class; a class is named
by its smallest id (null ids last); rows with equal id and word sequence are one document, and
stay or go together; rows of one id with different texts are different documents, each in its
own class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import fresh, give_back_memory, remove, shared_dir, small_batches, table, without_encoders, written
from .words import mix, shingles, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
SAMPLES, BANDS = 100, 20
BAND_BITS = BANDS.bit_length()
#: Documents, and shingles of theirs, that are counted together before they travel.
COUNTED, COUNTED_SHINGLES = 8192, 1_000_000
#: Shingles of a part of the hashes, about; homes for each part; bytes of a word and a space, at a guess.
CANDIDATES, HOMES, WORD_BYTES = 1_000_000, 2, 6
#: Weights whose draws are made ahead by a task; ids broadcast at once, members of a block.
AHEAD, BROADCAST_IDS, MEMBERS = 8, 200_000, 256
#: Bytes of a block's sets; places in the table of draws; heads of a bucket in the first round.
BLOCK_BYTES, CELLS, HEADS = 8_000_000, 1 << 20, 16
SEED = 20_240_229
LEAST_MATCHES = math.ceil(SAMPLES * (SIMILARITY - 5 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / SAMPLES)))


def text_words(text: str | None) -> np.ndarray:
    return word_hashes(np.frombuffer((text or "").encode(), dtype=np.uint8))[0]


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[str | None]:
    for b in batches:
        yield from b.column(column).to_pylist()


# --- document frequencies -----------------------------------------------------------------


def planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on: what is mostly zero lies together and is packed well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed(h: np.ndarray) -> bytes:
    """Sorted hashes as their differences."""
    return planes(np.diff(h, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


class Frequencies(NamedTuple):
    """Rows (home, hashes, df) of the shingles in two documents or more, the number of documents and of homes."""

    rows: DataFrame
    n_docs: int
    homes: int

    def home(self):
        """The home of a document (doc_id, text), as a column."""
        return home_of(self.homes)


def home_of(homes: int):
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")), F.lit(homes))


def frequencies(docs: DataFrame, out_dir: str) -> Frequencies:
    """The document frequency of every shingle, where its documents are at home."""
    n_docs, size = docs.select(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = max(1, math.ceil((size or 0) / WORD_BYTES / CANDIDATES))
    homes = HOMES * parts
    edges = np.array([(p << 64) // parts for p in range(1, parts)], dtype=np.uint64)
    most, most_shingles = COUNTED, COUNTED_SHINGLES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_encoders()
        held: list[tuple[int, np.ndarray]] = []

        def packets() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            h = np.concatenate([x for _, x in held])
            home = np.repeat(np.array([k for k, _ in held], np.uint32), [len(x) for _, x in held])
            held.clear()
            order = np.argsort(h, kind="stable")
            h, home = h[order], home[order]
            # A shingle once for each home, with the number of its documents there.
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (home[1:] != home[:-1])])[: len(h)])
            n = np.diff(np.append(first, len(h))).astype(np.uint32)
            h, home = h[first], home[first]
            at = [0, *np.searchsorted(h, edges).tolist(), len(h)]
            some = [(p, i, j) for p, (i, j) in enumerate(zip(at, at[1:])) if i < j]
            columns = [pa.array([p for p, _, _ in some], pa.int64()), *(pa.array([f(x[i:j]) for _, i, j in some], pa.binary()) for f, x in ((packed, h), (planes, home), (planes, n)))]
            return pa.record_batch(columns, ["part", "hashes", "homes", "n"])

        total = 0
        for b in batches:
            for home, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((home, np.unique(shingles(text_words(text), SHINGLE))))
                total += len(held[-1][1])
                if len(held) >= most or total >= most_shingles:
                    yield packets()
                    total = 0
        if held:
            yield packets()
        give_back_memory()

    def count(packets: pa.Table) -> pa.Table:
        read = [[f(x) for x in packets.column(name).to_pylist()] for name, f in (("hashes", unpacked), ("homes", lambda x: from_planes(x, np.uint32)), ("n", lambda x: from_planes(x, np.uint32)))]
        h, home, n = (np.concatenate(x) for x in read)
        order = np.argsort(h, kind="stable")
        h, home, n = h[order], home[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        df = np.add.reduceat(n, first, dtype=np.int64)
        df = np.repeat(df, np.diff(np.append(first, len(h))))
        several = np.flatnonzero(df > 1)
        several = several[np.argsort(home[several], kind="stable")]
        h, home, df = h[several], home[several], df[several].astype(np.uint64)
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (home[1:] != home[:-1])])[: len(h)]
        h, home, df = h[new], home[new], df[new]
        at = np.append(np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])[: len(h)]), len(h)).tolist()
        some = list(zip(at, at[1:]))
        give_back_memory()
        return pa.table([pa.array([int(home[i]) for i, _ in some], pa.int64()), *(pa.array([f(x[i:j]) for i, j in some], pa.binary()) for f, x in ((packed, h), (planes, df)))], ["home", "hashes", "df"])

    texts = docs.select(home_of(homes).alias("home"), "text")
    packets = texts.mapInArrow(deal, "part long, hashes binary, homes binary, n binary")
    # As many tasks as parts, so a task's share doesn't grow with the input.
    spread = packets.repartition(max(parts, 4 * docs.sparkSession.sparkContext.defaultParallelism), "part")
    rows = spread.groupBy("part").applyInArrow(count, "home long, hashes binary, df binary")
    return Frequencies(written(rows, f"{out_dir}/frequencies"), n_docs, homes)


def common_shingles(docs: DataFrame, out_dir: str, common: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of the shingles in at least ``common`` of all documents, and in two, their
    document frequencies, and the number of documents. All is held by the caller."""
    known = frequencies(docs, out_dir)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, df in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.record_batch([pa.array(unpacked(h).view(np.int64)), pa.array(from_planes(df, np.uint64).view(np.int64))], ["h", "n"])

    rows = known.rows.select("hashes", "df").mapInArrow(opened, "h long, n long").filter(F.col("n") >= common * known.n_docs).distinct().toArrow()
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order], known.n_docs


def at_home(texts: DataFrame, known: Frequencies, make: Callable, schema: str) -> DataFrame:
    """``make`` (batch, weights) of ``texts`` (home, text and others), with the weights of the batch's home."""
    names = [c for c in texts.columns if c != "home"]
    kinds = {f.name: f.dataType for f in texts.schema.fields}
    n_docs = known.n_docs
    lines = texts.select("home", F.lit(1).alias("turn"), *names, F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("df"))
    counts = known.rows.select("home", F.lit(0).alias("turn"), *(F.lit(None).cast(kinds[c]).alias(c) for c in names), "hashes", "df")
    n = min(known.homes, max(known.homes // 8, 4 * texts.sparkSession.sparkContext.defaultParallelism))

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_encoders()
        home, weights, h, df = None, None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            homes, turns = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = [0, *(np.flatnonzero((homes[1:] != homes[:-1]) | (turns[1:] != turns[:-1])) + 1).tolist(), b.num_rows]
            for i, j in zip(at, at[1:]):
                some = b.slice(i, j - i)
                if home != homes[i]:
                    home, weights, h, df = homes[i], None, [], []
                if turns[i] == 0:
                    h += map(unpacked, some.column("hashes").to_pylist())
                    df += (from_planes(x, np.uint64) for x in some.column("df").to_pylist())
                else:
                    if weights is None:
                        order = np.argsort(all_h := np.concatenate([np.empty(0, np.uint64), *h]))
                        weights = Weights(all_h[order], np.concatenate([np.empty(0, np.uint64), *df])[order], n_docs)
                        h, df = [], []
                    yield make(some.select(names), weights)
        give_back_memory()

    return lines.unionByName(counts).repartition(n, "home").sortWithinPartitions("home", "turn").mapInArrow(fed, schema)


# --- weighted sets and sketches -----------------------------------------------------------


class Weights:
    """TF-IDF weights of shingles, from the frequencies of those in two documents or more, sorted by hash."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n_docs: int):
        self.hashes = hashes
        self.idf = 2 - np.log(np.maximum(df, 1)) / math.log(max(n_docs, 2))

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles and their weights."""
        s, tf = np.unique(shingles(words, SHINGLE), return_counts=True)
        w = 2.0 * tf
        if len(self.hashes) and len(s):
            at = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
            mine = self.hashes[at] == s
            w[mine] = tf[mine] * self.idf[at[mine]]
        return s, w.astype(np.float32)


def draws() -> tuple[np.ndarray, ...]:
    """1 / r, beta, r and ln c - r + r beta for each place, and ln a at weight 2; 21 MB, made in a moment; the first four plain; ln a at other weights.

    Row ``i`` of each array is the window of ``SAMPLES`` numbers from place ``i`` on.
    """
    g = np.random.Generator(np.random.PCG64(SEED))
    n = CELLS + SAMPLES
    r = np.maximum(g.standard_gamma(2, n, dtype=np.float32), 1e-3)
    log_c = np.log(np.maximum(g.standard_gamma(2, n, dtype=np.float32), 1e-6))
    beta = g.random(n, dtype=np.float32)
    rest = log_c - r + r * beta
    usual = rest - r * np.floor(np.float32(math.log(2)) / r + beta)
    return tuple(map(windows, (1 / r, beta, r, rest, usual))) + ((1 / r, beta, r, rest), {})


def windows(x: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, SAMPLES)


def made_ahead(w: np.ndarray, drawn: tuple) -> dict[float, np.ndarray]:
    """ln a at each place for the commonest of the weights ``w``; what a task has made before is kept."""
    (inverse, beta, r, rest), ahead = drawn[5:]
    if len(ahead) < AHEAD:
        values, n = np.unique(w, return_counts=True)
        for k in np.argsort(-n)[: AHEAD - len(ahead)].tolist():
            if n[k] >= 64 and float(values[k]) not in ahead:
                a = inverse * np.log(values[k], dtype=np.float32)
                a += beta
                np.floor(a, out=a)
                a *= r
                ahead[float(values[k])] = windows(rest - a)
    return ahead


def sketch(hashes: np.ndarray, weights: np.ndarray, drawn: tuple[np.ndarray, ...]) -> np.ndarray:
    """The shingle and level with the smallest ln a of each sample, folded to 16 bits.

    ln a = ln c - r (t - beta + 1) with the level t = floor(ln w / r + beta).
    """
    inverse, beta, r, rest, usual = drawn[:5]
    place = (mix(hashes) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)
    log_w = np.log(weights, dtype=np.float32)
    best, pick = np.full(SAMPLES, np.inf, dtype=np.float32), np.zeros(SAMPLES, dtype=np.int64)
    every = np.arange(SAMPLES)
    other = weights != 2
    groups = [(np.flatnonzero(~other), usual)]
    for w, table in made_ahead(weights[other], drawn).items():
        mine = weights == np.float32(w)
        groups.append((np.flatnonzero(mine), table))
        other &= ~mine
    for some, table in (*groups, (np.flatnonzero(other), None)):
        for at in range(0, len(some), 1024):
            mine = some[at : at + 1024]
            k = place[mine]
            if table is None:
                a = inverse[k] * log_w[mine, None]
                a += beta[k]
                np.floor(a, out=a)
                a *= r[k]
                np.subtract(rest[k], a, out=a)
            else:
                a = table[k]
            least = a.argmin(0)
            value = a[least, every]
            less = value < best
            best[less], pick[less] = value[less], mine[least[less]]
    level = np.floor(inverse[place[pick], every] * log_w[pick] + beta[place[pick], every]).astype(np.int64).view(np.uint64)
    return (mix(hashes[pick] ^ mix(level)) >> np.uint64(48)).astype("<u2")


def key_of(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def sketched(docs: DataFrame, known: Frequencies) -> DataFrame:
    """(doc_id, key of the word sequence, sketch or null, number of its shingles)."""
    drawn: list[tuple] = []

    def make(b: pa.RecordBatch, weights: Weights) -> pa.RecordBatch:
        if not drawn:
            drawn.append(draws())
        keys, made, sizes = [], [], []
        for text in b.column(1).to_pylist():
            words = text_words(text)
            s, w = weights.of(words)
            keys.append(key_of(words))
            made.append(sketch(s, w, drawn[0]).tobytes() if len(s) else None)
            sizes.append(len(s))
        return pa.record_batch([b.column(0), pa.array(keys, pa.binary()), pa.array(made, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "key", "sketch", "size"])

    texts = docs.select(known.home().alias("home"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return at_home(texts, known, make, "doc_id long, key binary, sketch binary, size long")


def weighted_sets(docs: DataFrame, active: DataFrame, known: Frequencies) -> DataFrame:
    """(node, set): distinct shingles and weights, as bytes, of the nodes in ``active`` (first_id, key, node)."""

    def make(b: pa.RecordBatch, weights: Weights) -> pa.RecordBatch:
        nodes, made = [], []
        for text, key, node in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            words = text_words(text)
            if key_of(words) == key:
                s, w = weights.of(words)
                nodes.append(node)
                made.append(s.tobytes() + w.tobytes())
        return pa.record_batch([pa.array(nodes, pa.int64()), pa.array(made, pa.binary())], ["node", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text", known.home().alias("home"))
    return at_home(texts.join(active, texts["id"].eqNullSafe(active["first_id"])).select("home", "text", "key", "node"), known, make, "node long, set binary")


def opened(sets: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shingles, weights) of sets made by ``weighted_sets``."""
    return [(np.frombuffer(x, np.uint64, len(x) // 12), np.frombuffer(x, np.float32, len(x) // 12, len(x) // 12 * 8)) for x in sets]


def similarities(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Exact weighted Jaccard similarity of one set to each of the others."""
    x, v = one
    sizes = np.array([len(y) for y, _ in others])
    if not len(x) or not len(others):
        return np.zeros(len(others))
    y, w = np.concatenate([y for y, _ in others]), np.concatenate([w for _, w in others]).astype(float)
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = np.where(x[at] == y, np.minimum(v[at], w), 0.0)
    owner = np.repeat(np.arange(len(others)), sizes)
    shared, total = (np.bincount(owner, z, len(others)) for z in (both, w))
    return shared / (v.sum(dtype=float) + total - shared)


def similarity(a: bytes, b: bytes) -> float:
    return float(similarities(*opened([a]), opened([b]))[0])


# --- candidates, links, classes -----------------------------------------------------------


def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, size) for each band of each node's sketch; the last bits of a bucket are its band."""
    wide = 2 * SAMPLES // BANDS
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.shiftleft(F.xxhash64(b, F.substr(F.col("sketch"), b * wide + 1, F.lit(wide))), BAND_BITS).bitwiseOR(b.cast("bigint")))
    return nodes.filter("sketch IS NOT NULL AND node IS NOT NULL").select(F.explode(band).alias("bucket"), "node", "size")


def close_pairs(pairs: DataFrame, nodes: DataFrame, least: int = LEAST_MATCHES) -> DataFrame:
    """Pairs (a, b) whose sketches agree in enough samples."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(b.num_rows, -1) for k in (2, 3))
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))
        give_back_memory()

    of = lambda side: nodes.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(close, "a long, b long")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fine = [similarity(x, y) >= SIMILARITY for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))
    give_back_memory()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    of = lambda side: sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_verify, "a long, b long")


def placed_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` (bucket, node, n, parts, turn, rep) with whether each is outside its bucket's main class, that of ``rep``."""
    of = lambda side, name: labels.select(F.col("node").alias(side), F.col("label").alias(name))
    main = members.select("bucket", "rep").distinct().join(of("rep", "main"), "rep", "left").select("bucket", F.coalesce("main", "rep").alias("main"))
    known = members.join(of("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    return known.join(main, "bucket").withColumn("other", F.col("label") != F.col("main")).drop("main")


def round_links(placed: DataFrame, nodes: DataFrame, low: float, high: float, least: int = LEAST_MATCHES) -> DataFrame:
    """Links (a, b) of the heads whose turn is from ``low`` to ``high`` and the members of other classes.

    ``nodes``: (node, sketch, set). A bucket's heads and its members are cut into ``parts``.
    """
    heads = placed.filter(F.col("other") & (F.col("turn") >= low) & (F.col("turn") < high))
    here = placed.join(heads.select("bucket").distinct(), "bucket", "left_semi")
    block = lambda df, name: (
        df.withColumn("p", F.pmod(F.xxhash64("node", F.lit(3)), "parts")).join(nodes, "node").groupBy("bucket", "p").agg(F.collect_list(F.struct("node", "label", "sketch", "set")).alias(name)).drop("p")
    )
    wide = SAMPLES // BANDS

    def parsed(rows) -> tuple:
        rows = rows.as_py()
        sketches = np.frombuffer(b"".join(m["sketch"] for m in rows), "<u2").reshape(len(rows), BANDS, wide)
        return np.array([m["node"] for m in rows]), np.array([m["label"] for m in rows]), sketches, opened([m["set"] for m in rows])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                (n1, l1, s1, w1), (n2, l2, s2, w2) = parsed(x), parsed(y)
                for i in range(len(n1)):
                    same = s2 == s1[i]
                    near = np.flatnonzero((same.sum((1, 2)) >= least) & (l2 != l1[i]))
                    if len(near):
                        # Of the buckets that a pair shares only the one of its first band takes it.
                        near = near[same[near].all(2).argmax(1) == bucket & ((1 << BAND_BITS) - 1)]
                    close = near[similarities(w1[i], [w2[j] for j in near]) >= SIMILARITY]
                    left.append(np.minimum(n1[i], n2[close]))
                    right.append(np.maximum(n1[i], n2[close]))
                yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])
        give_back_memory()

    return block(heads, "heads").join(block(here, "members"), "bucket").select("bucket", "heads", "members").mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame, out_dir: str) -> DataFrame:
    """(node, label) of all linked nodes, label the smallest of their component.

    Alternating stars: each node's larger neighbours, then its smaller ones, are tied to the
    smallest, until only stars are left; the rounds grow with the logarithm of a component's size.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, k = written(edges, f"{out_dir}/edges0"), 0
    while True:
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("leaf")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("leaf")))
        seen = ends.groupBy("x").agg(F.sum("leaf").alias("leaves"), F.min("leaf").alias("least"))
        if seen.filter("leaves > 1 OR (leaves > 0 AND least = 0)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        k += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        edges = written(small, f"{out_dir}/edges{k}")
        remove(edges.sparkSession, f"{out_dir}/edges{k - 1}")


def linked(members: DataFrame, nodes: DataFrame, sets: DataFrame, out_dir: str, least: int = LEAST_MATCHES) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), labels (node, label)) of the ``members`` (bucket, node, head, n, parts) of all buckets."""
    near = written(close_pairs(members.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), nodes, least), f"{out_dir}/near")
    links = written(verified(near, sets), f"{out_dir}/links0")
    labels = written(components(links, f"{out_dir}/parts0"), f"{out_dir}/labels0")
    # A bucket's main class is that of one of its members, chosen now: classes grow, and it stays in its own.
    known = members.join(labels, "node", "left").select("bucket", "node", "n", "parts", F.coalesce("label", "node").alias("label"))
    per = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("rep"), F.max("n").alias("n"), F.max("parts").alias("parts"))
    mixed = per.groupBy("bucket").agg(F.max(F.struct("m", "rep")).alias("top"), F.max("n").alias("n"), F.max("parts").alias("parts"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    mixed = mixed.select("bucket", "n", "parts", F.col("top.rep").alias("rep"))
    # The same members come first in every bucket that they are in.
    turn = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 31)) / F.lit(float(1 << 31)) * F.col("n")
    left = written(members.select("bucket", "node").join(mixed, "bucket").withColumn("turn", turn), f"{out_dir}/mixed")
    whole = nodes.join(sets, "node")
    for k, (low, high) in enumerate(((0.0, float(HEADS)), (float(HEADS), math.inf)), 1):
        placed = written(placed_members(left, labels), f"{out_dir}/placed{k}")
        more = written(round_links(placed, whole, low, high, least), f"{out_dir}/links{k}")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = written(components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))), f"{out_dir}/parts{k}"), f"{out_dir}/labels{k}")
        to_come = placed.filter(F.col("other") & (F.col("turn") >= high)).select("bucket").distinct()
        left = placed.join(to_come, "bucket", "left_semi").select("bucket", "node", "n", "parts", "rep", "turn")
    return links, labels


def near_rows(docs: DataFrame, out_dir: str, least: int = LEAST_MATCHES) -> DataFrame:
    """(doc_id, key, class_id, n_links, kept) of every row; of each class the first document is kept.

    ``n_links`` is the number of other texts that the row's text has been verified to be close to.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    known = frequencies(docs, out_dir)
    rows = written(sketched(docs, known), f"{out_dir}/sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("first")
    nodes = written(rows.groupBy("key").agg(first, F.first("sketch").alias("sketch"), F.first("size").alias("size")).withColumn("node", F.monotonically_increasing_id()), f"{out_dir}/nodes")
    banded = buckets(nodes)
    heads = banded.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).filter("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / F.lit(float(MEMBERS)), F.col("bytes") * 12 / F.lit(float(BLOCK_BYTES))))
    members = written(banded.drop("size").join(heads, "bucket").withColumn("parts", parts).drop("bytes"), f"{out_dir}/members")
    ids = members.select("node").distinct()
    sketches = nodes.filter("sketch IS NOT NULL").join(ids, "node", "left_semi")
    active = written(sketches.select(F.col("first.id").alias("first_id"), "key", "node"), f"{out_dir}/active")
    sets = written(weighted_sets(docs, F.broadcast(active) if active.count() <= BROADCAST_IDS else active, known), f"{out_dir}/sets")
    remove(spark, f"{out_dir}/frequencies")
    links, labels = linked(members, sketches.select("node", "sketch"), sets, out_dir, least)

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
    several = labels.join(nodes.select("node", "key", "first"), "node").withColumn("own", F.struct("first.none", "first.id", "key"))
    tops = several.groupBy("label").agg(F.min("own").alias("top"))
    tops = written(labels.join(tops, "label").join(degree, "node", "left").select("node", "top", "n_links"), f"{out_dir}/tops")
    for name in ("members", "active", "sets", "near", "mixed", *(f"{x}{k}" for k in range(3) for x in ("links", "parts", "labels", "placed"))):
        remove(spark, f"{out_dir}/{name}")  # what follows reads the sketches, the nodes and their tops alone
    named = nodes.select("node", "key", F.struct("first.none", "first.id", "key").alias("own")).join(tops, "node", "left")
    named = named.select("key", F.coalesce("top", "own").alias("top"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    joined = rows.select("doc_id", "key").join(named, "key")
    return joined.select("doc_id", "key", F.col("top.id").alias("class_id"), "n_links", (F.col("doc_id").eqNullSafe(F.col("top.id")) & (F.col("key") == F.col("top.key"))).alias("kept"))


def near_classes(docs: DataFrame, out_dir: str, least: int = LEAST_MATCHES) -> DataFrame:
    """(doc_id, class_id, n_links) of every row; a class is named by its smallest id."""
    return near_rows(docs, out_dir, least).select("doc_id", "class_id", "n_links")


def drop_near(docs: DataFrame, out_dir: str, least: int = LEAST_MATCHES) -> DataFrame:
    """The document that stays of each class, in the columns of ``docs``."""
    rows = written(near_rows(docs, out_dir, least).select(F.col("doc_id").alias("id"), "key", "kept").distinct(), f"{out_dir}/kept")
    gone, kept = rows.filter("NOT kept"), rows.filter("kept").select(F.col("id").alias("kept_id")).distinct()
    ids = written(gone.select("id").distinct(), f"{out_dir}/gone")
    # An id may stand for texts of which one goes and one stays; those rows are told apart by their words.
    torn = written(ids.join(kept, ids["id"].eqNullSafe(kept["kept_id"]), "left_semi"), f"{out_dir}/torn")
    narrow = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df
    ids = narrow(ids)
    out = docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_anti")
    if torn.isEmpty():
        return out
    column, at = fresh("key", docs.columns), docs.columns.index("text")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array([key_of(text_words(t)) for t in b.column(at).to_pylist()], pa.binary())], [*b.schema.names, column])

    torn = narrow(torn)
    some = docs.join(torn, docs["doc_id"].eqNullSafe(torn["id"]), "left_semi").mapInArrow(keyed, StructType([*docs.schema.fields, StructField(column, BinaryType())]))
    stay = rows.filter("kept").select("id", F.col("key").alias("kept_key"))
    stay = some.join(stay, some["doc_id"].eqNullSafe(stay["id"]) & (some[column] == stay["kept_key"]), "left_semi")
    return out.unionByName(stay.select(*docs.columns))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), shared_dir(spark, "near"))
