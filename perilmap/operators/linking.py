"""Links between names by their vectors: pairs whose cosine reaches a threshold.

Equal vectors are one node, whose name is the smallest id. A node's sketch is the sign of its
projection on random planes; ``bits`` planes make a table, and nodes that agree in all bits of
a table share a bucket. Nodes travel in packets, each for a cell: one of ``CELL_NODES`` nodes' worth of a
table's buckets, or two parts of a bucket that has more than ``PART`` nodes. So no task holds a
bucket of any size. A cell compares the pairs of each bucket, ``ROWS`` nodes against the others
at once, and verifies them there and then by the exact cosine of the vectors, which travel with their nodes;
each pair is taken in the first table that it shares, and only links, or their numbers, leave the
task. The number of tables follows from the share of pairs at the threshold that must be found;
pairs above it are found more surely.

Each node travels once for each table. ``vector_link_counts`` takes the buckets in rounds of ``ROUND_BYTES``
of packets or twice the nodes' bytes, whose files go with the round, and keeps numbers of links only: what is on the
disk grows with the nodes, whatever the number of links.

Cases: null and zero vectors have no links and stand for themselves; ids are taken as unique;
vectors of several lengths are an error; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import passing

THRESHOLD, BITS, RECALL = 0.9, 12, 1 - 1e-5
MEMBERS = 512
#: Nodes of a cell, nodes of a bucket that are not divided, nodes held against the others at once.
CELL_NODES, PART, ROWS = 32 * MEMBERS, 16 * MEMBERS, MEMBERS
#: Bytes of the packets of a round, if twice the nodes' bytes are not more; 64-bit numbers of a sketch that are compared first; pairs whose whole sketches or tables are compared at once.
ROUND_BYTES, FIRST_WORDS, WHOLE = 1_000_000_000, 2, 4096
#: How far single precision may be off the exact cosine.
SLACK = 1e-4
SEED = 20_240_229


def agreement(threshold: float) -> float:
    """The probability that a random plane has both vectors of a pair at the threshold on one side."""
    return 1 - math.acos(threshold) / math.pi


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """How many tables of ``bits`` planes find a pair at the threshold with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement(threshold) ** bits))


def least_of(planes: int, p: float) -> int:
    """In how many of ``planes`` a pair agrees at least, if it agrees in each with probability ``p``: six standard deviations below the mean."""
    return max(0, math.floor(planes * p - 6 * math.sqrt(planes * p * (1 - p))))


def sketches(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(node, sketch, buckets) of nodes (node, vector); a bucket's last number is its table."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = keys_of(bytes_of(b.column(1)), bits, tables).astype(np.int64) * tables + np.arange(tables)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["node", "sketch", "buckets"])

    return with_sketches(nodes, bits, tables).select("node", "sketch").mapInArrow(make, "node long, sketch binary, buckets array<long>")


def with_sketches(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(node, sketch, keys, vector) of nodes (node, vector), the vector and its keys of all tables as bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, size = None, None
        for b in batches:
            if not b.num_rows:
                continue
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            size = size or int(sizes[0])
            if (sizes != size).any():
                raise ValueError(f"vectors of {size} and {sizes[sizes != size][0]} numbers")
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            if planes is None:
                planes = np.random.default_rng(SEED).standard_normal((size, bits * tables))
            packed = np.packbits(x @ planes > 0, axis=1)
            yield pa.record_batch([b.column(0), *(binaries(v) for v in (packed, keys_of(packed, bits, tables), x))], ["node", "sketch", "keys", "vector"])

    return nodes.select("node", "vector").mapInArrow(make, "node long, sketch binary, keys binary, vector binary")


def binaries(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    return pa.array([r.tobytes() for r in rows], pa.binary())


def bytes_of(column: pa.Array, kind: type = np.uint8) -> np.ndarray:
    """Rows of numbers of a column of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def key_kind(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.uint64


def keys_of(sketches: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bits of each table as one number, a column for each table."""
    wide = 8 * key_kind(bits)().itemsize
    padded = np.zeros((len(sketches), tables, wide), np.uint8)
    padded[:, :, :bits] = np.unpackbits(sketches, axis=1, count=bits * tables).reshape(-1, tables, bits)
    return np.packbits(padded.reshape(len(sketches), -1), axis=1).view(key_kind(bits))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of integers over 64."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def divided(sketched: DataFrame, bits: int, tables: int) -> list[dict[int, int]]:
    """For each table the buckets of more than ``PART`` nodes, with the number of their parts."""
    part = PART

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = bytes_of(b.column(0), key_kind(bits)) if b.num_rows else ()
            for t in range(tables if len(keys) else 0):
                k, n = np.unique(keys[:, t], return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(k), t)), pa.array(k.astype(np.int64)), pa.array(n)], ["t", "k", "n"])

    rows = sketched.select("keys").mapInArrow(count, "t long, k long, n long").groupBy("t", "k").agg(F.sum("n").alias("n")).filter(F.col("n") > part)
    out: list[dict[int, int]] = [{} for _ in range(tables)]
    for t, k, n in rows.toLocalIterator():
        out[t][k] = math.ceil(n / part)
    return out


def dealt(sketched: DataFrame, bits: int, tables: int, cells: int, large: list[dict[int, int]], now: int = 0, rounds: int = 1) -> DataFrame:
    """Packets (bucket, t, x, y, side, node, keys, payload) of the buckets whose turn is ``now``; ``sketched``: (node, keys, payload).

    A cell is (bucket, t, x, y): table ``t``, and either a number for all its small buckets (x, y: 0) or a bucket
    with two of its parts, whose nodes have the sides 0 and 1.
    """
    tables_with = [(np.array(sorted(d), np.int64), np.array([d[k] for k in sorted(d)], np.int64)) for d in large]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            nodes, keys, payload = b.column(0).to_numpy(), bytes_of(b.column(1), key_kind(bits)), bytes_of(b.column(2))
            for t in range(tables):
                spread = mix(keys[:, t].astype(np.uint64) * np.uint64(tables) + np.uint64(t))
                here = np.flatnonzero(spread % np.uint64(rounds) == now)
                key = keys[here, t].astype(np.int64)
                cell = (spread[here] // np.uint64(rounds) % np.uint64(cells)).astype(np.int64)
                x, y, side = (np.zeros(len(here), np.int64) for _ in range(3))
                most, parts = tables_with[t]
                if len(most):
                    at = np.minimum(np.searchsorted(most, key), len(most) - 1)
                    many = most[at] == key
                    own, parts = here[many], parts[at[many]]
                    mine = (mix(nodes[own]) % parts.astype(np.uint64)).astype(np.int64)
                    # A node of part p meets all parts: (p, q) for q from p on as side 0, (q, p) for q before p as side 1.
                    again = np.repeat(np.arange(len(own)), parts)
                    q = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
                    p = mine[again]
                    few = ~many
                    here = np.concatenate([here[few], own[again]])
                    cell = np.concatenate([cell[few], cells + key[many][again]])
                    x, y, side = (np.concatenate([v[few], w]) for v, w in ((x, np.minimum(p, q)), (y, np.maximum(p, q)), (side, (q < p).astype(np.int64))))
                if not len(here):
                    continue
                order = np.lexsort((side, y, x, cell))
                heads = np.stack([cell, x, y, side])[:, order]
                starts = np.flatnonzero(np.concatenate([[True], (heads[:, 1:] != heads[:, :-1]).any(0)]))
                ends = np.append(starts[1:], len(order))
                here = here[order]
                packets = [[values[here[i:j]].tobytes() for i, j in zip(starts, ends, strict=True)] for values in (nodes, keys, payload)]
                first = heads[:, starts]
                yield pa.record_batch(
                    [pa.array(first[0]), pa.array(np.full(len(starts), t)), *(pa.array(v) for v in first[1:]), *(pa.array(v, pa.binary()) for v in packets)],
                    ["bucket", "t", "x", "y", "side", "node", "keys", "payload"],
                )

    return sketched.mapInArrow(deal, "bucket long, t long, x long, y long, side long, node binary, keys binary, payload binary")


def by_tiles(keys: np.ndarray, rows: int) -> Iterator[tuple[int, int, int]]:
    """(low, high, end): nodes sorted by their keys, ``rows`` at most against those up to ``end``, so that all pairs of a key meet once.

    Small buckets share a tile.
    """
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    at = 0
    while at < len(keys):
        # As many whole buckets as fit, or one.
        k = np.searchsorted(ends, at + 64, "right") - 1
        end = int(ends[k]) if k >= 0 and ends[k] > at else int(ends[np.searchsorted(ends, at, "right")])
        for low in range(at, end, rows):
            yield low, min(low + rows, end), end
        at = end


def compared(packets: DataFrame, bits: int, tables: int, p: float, threshold: float | None, counts: bool = False) -> DataFrame:
    """The close pairs of all cells: (a, b, cosine), or as numbers of a node's pairs (node, n).

    Without a ``threshold`` the payload is a sketch, and pairs (a, b) are close if their sketches agree in as many planes as a pair
    that agrees in each with probability ``p``. The first planes are compared as a few 64-bit numbers; that drops nearly all others.
    """
    n_first = min(64 * FIRST_WORDS, bits * tables)
    most, first_most = (n - least_of(n, p) for n in (bits * tables, n_first))
    rows = ROWS

    def first_words(sketches: np.ndarray) -> np.ndarray:
        """The first ``n_first`` bits of each sketch as 64-bit numbers, a row for each number."""
        kept = np.zeros((len(sketches), 8 * FIRST_WORDS), np.uint8)
        kept[:, : n_first // 8] = sketches[:, : n_first // 8]
        return np.ascontiguousarray(kept.view(np.uint64).T)

    def close(side: dict, other: dict, i: slice, j: slice) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that may be close."""
        if threshold is not None:
            return np.nonzero(side["unit"][i] @ other["unit"][j].T >= threshold - SLACK)
        differ = np.zeros((i.stop - i.start, j.stop - j.start), np.uint8)
        for v, w in zip(side["words"], other["words"], strict=True):
            differ += np.bitwise_count(v[i, None] ^ w[None, j])
        return np.nonzero(differ <= first_most)

    def opened(packets: pa.Table, t: int) -> dict:
        """The members of a side, sorted by their keys in table ``t``."""
        nodes, keys, payload = (np.frombuffer(b"".join(packets.column(name).to_pylist()), kind) for name, kind in (("node", np.int64), ("keys", key_kind(bits)), ("payload", np.uint8 if threshold is None else np.float64)))
        keys = keys.reshape(len(nodes), -1)
        order = np.argsort(keys[:, t], kind="stable")
        out = {"node": nodes[order], "keys": keys[order]}
        x = payload.reshape(len(nodes), -1)[order]
        if threshold is None:
            return out | {"sketch": x, "words": first_words(x)}
        # The sums in the order of the vector's numbers, as SQL adds them up.
        size = np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1])
        return out | {"vector": x, "size": size, "unit": (x / size[:, None]).astype(np.float32)}

    def links(one: dict, two: dict, same: bool, t: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(places in ``one``, places in ``two``, cosines) of the links."""
        tiles = by_tiles(one["keys"][:, t], rows) if same else ((k, min(k + rows, len(one["node"])), len(two["node"])) for k in range(0, len(one["node"]), rows))
        for low, high, end in tiles:
            first = low if same else 0
            i, j = close(one, two, slice(low, high), slice(first, end))
            i, j = i + low, j + first
            some = (one["keys"][i, t] == two["keys"][j, t]) & (j > i if same else True)
            i, j = i[some], j[some]
            for at in range(0, len(i), WHOLE):
                i_, j_ = i[at : at + WHOLE], j[at : at + WHOLE]
                # A close pair shares many tables: where it has shared one before, it is left at once.
                for k in range(0, t, 8):
                    new = ~(one["keys"][i_, k : min(k + 8, t)] == two["keys"][j_, k : min(k + 8, t)]).any(1)
                    i_, j_ = i_[new], j_[new]
                if threshold is None:
                    near = np.bitwise_count(one["sketch"][i_] ^ two["sketch"][j_]).sum(1) <= most
                    yield i_[near], j_[near], np.empty(0)
                elif len(i_):
                    cosine = np.add.accumulate(one["vector"][i_] * two["vector"][j_], axis=1)[:, -1] / (one["size"][i_] * two["size"][j_])
                    near = cosine >= threshold
                    yield i_[near], j_[near], cosine[near]

    def compare(key: tuple, cell: pa.Table) -> pa.Table:
        t, same = key[1].as_py(), key[2].as_py() == key[3].as_py()
        side = cell.column("side").to_numpy()
        one = opened(cell if same else cell.filter(pa.array(side == 0)), t)
        two = one if same else opened(cell.filter(pa.array(side == 1)), t)
        if counts:
            n1 = np.zeros(len(one["node"]), np.int64)
            n2 = n1 if same else np.zeros(len(two["node"]), np.int64)
            for i, j, _ in links(one, two, same, t):
                n1 += np.bincount(i, minlength=len(n1))
                n2 += np.bincount(j, minlength=len(n2))
            sides = ((one, n1),) if same else ((one, n1), (two, n2))
            return pa.table([np.concatenate([s["node"][n > 0] for s, n in sides]), np.concatenate([n[n > 0] for _, n in sides])], ["node", "n"])
        found = [(one["node"][i], two["node"][j], c) for i, j, c in links(one, two, same, t)]
        a, b, c = (np.concatenate([f[k] for f in found] + [np.empty(0, np.int64 if k < 2 else np.float64)]) for k in range(3))
        columns = {"a": np.minimum(a, b), "b": np.maximum(a, b)} | ({} if threshold is None else {"cosine": c})
        return pa.table(columns)

    kinds = "node long, n long" if counts else "a long, b long" + (", cosine double" if threshold is not None else "")
    return packets.groupBy("bucket", "t", "x", "y").applyInArrow(compare, kinds)


def cells_for(n_nodes: int, rounds: int = 1) -> int:
    """Into how many cells the buckets of a table and a round are dealt."""
    return max(1, math.ceil(n_nodes / CELL_NODES / rounds))


def close_nodes(sketched: DataFrame, bits: int, tables: int, p: float) -> DataFrame:
    """Pairs (a, b) that share a bucket and agree in as many planes as a pair that agrees in each with probability ``p``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column(0), binaries(keys_of(bytes_of(b.column(1)), bits, tables)), b.column(1)], ["node", "keys", "payload"])

    keyed = sketched.select("node", "sketch").mapInArrow(make, "node long, keys binary, payload binary")
    return compared(dealt(keyed, bits, tables, cells_for(sketched.count()), divided(keyed, bits, tables)), bits, tables, p, None)


def node_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, vector), members (id, node)) of vectors (id, vector)."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    fine = F.coalesce(F.exists("vector", lambda e: e != 0), F.lit(False))
    nodes = rows.filter(fine).groupBy("vector").agg(F.min("id").alias("node"))
    return nodes, rows.filter(fine).join(nodes, "vector").select("id", "node").unionByName(rows.filter(~fine).select("id", F.col("id").alias("node")))


def vector_links(vectors: DataFrame, threshold: float = THRESHOLD, bits: int = BITS, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(members (id, node), links (a, b, cosine)): the node of each id, and each link of two nodes once, a < b."""
    nodes, members = node_vectors(vectors)
    tables = tables_for(threshold, bits, recall)
    sketched = passing(with_sketches(nodes, bits, tables).select("node", "keys", F.col("vector").alias("payload")))
    packets = dealt(sketched, bits, tables, cells_for(sketched.count()), divided(sketched, bits, tables))
    return members, compared(packets, bits, tables, agreement(threshold), threshold)


def vector_link_counts(vectors: DataFrame, threshold: float = THRESHOLD, bits: int = BITS, recall: float = RECALL) -> DataFrame:
    """``link_counts`` of ``vector_links``, in rounds, without a list of the links."""
    nodes, members = node_vectors(vectors)
    tables = tables_for(threshold, bits, recall)
    sketched = passing(with_sketches(nodes, bits, tables).select("node", "keys", F.col("vector").alias("payload")))
    n_nodes, size = sketched.agg(F.count(F.lit(1)), F.sum(F.octet_length("keys") + F.octet_length("payload") + 8)).first()
    large = divided(sketched, bits, tables)
    size = size or 0
    rounds = max(1, math.ceil(size * tables / max(ROUND_BYTES, 2 * size)))
    counts = []
    for now in range(rounds):
        packets = dealt(sketched, bits, tables, cells_for(n_nodes, rounds), large, now, rounds)
        found = compared(packets, bits, tables, agreement(threshold), threshold, counts=True)
        counts.append(passing(found.groupBy("node").agg(F.sum("n").alias("n"))))
    ends = functools.reduce(DataFrame.unionByName, counts).groupBy("node").agg(F.sum("n").alias("n_links"))
    return members.join(ends, "node", "left").select("id", "node", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, node, n_links): for each id its node and how many other nodes that is linked to."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(ends, "node", "left").select("id", "node", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
