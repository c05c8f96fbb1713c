"""A graph database as a sink and a scan: each node and edge is there once, however often tasks run.

``df.write.format("property_graph")`` stages: every attempt of a task hands its rows to the
client under the job's and its own name, ``batch`` at a time. When all tasks have succeeded
the driver publishes the attempts whose messages arrived, in one transaction that merges by
key; rows of lost attempts are thrown away with the job's stage. The driver sends names of
attempts, never rows. Writing the same rows again changes nothing.

``spark.read.format("property_graph")`` reads edges or nodes in ``parts`` partitions; a filter
on ``relation`` (edges) or ``type`` (nodes) becomes part of the database's own query.

Options: ``client`` (``module:factory``; the factory gets the options as a dict and returns a
``GraphClient``), ``kind`` (``edges`` or ``nodes``), ``batch``, ``parts``. Keys: a node's name
and type; an edge's case, ends and relation. Rows with a null in their key are refused.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import batched
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMAS = {"edges": "case_id long, head string, head_type string, relation string, tail string, tail_type string", "nodes": "name string, type string, embedding array<float>"}
KEYS = {"edges": ("case_id", "head", "relation", "tail"), "nodes": ("name", "type")}
FILTERED = {"edges": "relation", "nodes": "type"}


class GraphClient(Protocol):
    """What a database must offer. ``rows`` are dicts with the columns of ``SCHEMAS[kind]``."""

    def stage(self, kind: str, job: str, attempt: str, rows: list[dict]) -> None: ...

    def publish(self, kind: str, job: str, attempts: list[str]) -> None:
        """Merge the rows of these attempts by key and drop the job's stage, all or nothing."""

    def discard(self, kind: str, job: str) -> None: ...

    def scan(self, kind: str, values: list[str] | None, part: int, parts: int) -> Iterable[tuple]:
        """The rows of one of ``parts`` parts, of these relations or types only if any are given."""


def connect(options: dict[str, str]) -> GraphClient:
    module, _, factory = options["client"].partition(":")
    return getattr(importlib.import_module(module), factory)(dict(options))


@dataclass
class Staged(WriterCommitMessage):
    attempt: str


class Part(InputPartition):
    def __init__(self, k: int):
        self.k = k


class PropertyGraph(DataSource):
    @classmethod
    def name(cls) -> str:
        return "property_graph"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "edges")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return GraphReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a graph is merged into, never overwritten: use mode append")
        return GraphWriter(dict(self.options), schema)


class GraphReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.kind, self.parts = options, options.get("kind", "edges"), int(options.get("parts", 1))
        self.columns = [c.split()[0] for c in SCHEMAS[self.kind].split(", ")]
        self.wanted, self.values = schema.fieldNames(), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (FILTERED[self.kind],):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.values = values if self.values is None else [v for v in self.values if v in values]
            else:
                yield f

    def partitions(self) -> list[Part]:
        return [Part(k) for k in range(self.parts)]

    def read(self, partition: Part) -> Iterator[tuple]:
        at = [self.columns.index(c) for c in self.wanted]
        for row in connect(self.options).scan(self.kind, self.values, partition.k, self.parts):
            yield tuple(row[k] for k in at)


class GraphWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.kind, self.batch = options, options.get("kind", "edges"), int(options.get("batch", 1000))
        missing = set(KEYS[self.kind]) - set(schema.fieldNames())
        if missing:
            raise ValueError(f"{self.kind} need the columns {sorted(missing)}")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Staged:
        client, attempt = connect(self.options), uuid.uuid4().hex
        for some in batched(iterator, self.batch):
            rows = [r.asDict() for r in some]
            bad = next((r for r in rows if any(r[k] is None for k in KEYS[self.kind])), None)
            if bad is not None:
                raise ValueError(f"a key of {self.kind} is null: {bad}")
            client.stage(self.kind, self.job, attempt, rows)
        return Staged(attempt)

    def commit(self, messages: list[Staged | None]) -> None:
        connect(self.options).publish(self.kind, self.job, [m.attempt for m in messages if m is not None])

    def abort(self, messages: list[Staged | None]) -> None:
        connect(self.options).discard(self.kind, self.job)


class SqlGraph:
    """A graph in the tables of a database with a DB-API connection (``?`` as its mark for parameters)."""

    columns = {k: tuple(c.split()[0] for c in s.split(", ")) for k, s in SCHEMAS.items()}

    def __init__(self, open_connection: Callable):
        self.open = open_connection

    def create(self) -> None:
        with self.open() as db:
            for kind, names in self.columns.items():
                fields = ", ".join(f"{n} {'BIGINT' if n == 'case_id' else 'TEXT'}" for n in names)
                db.execute(f"CREATE TABLE IF NOT EXISTS {kind} ({fields}, PRIMARY KEY ({', '.join(KEYS[kind])}))")
                db.execute(f"CREATE TABLE IF NOT EXISTS staged_{kind} (job TEXT, attempt TEXT, {fields})")
                db.execute(f"CREATE TABLE IF NOT EXISTS committed_{kind} (job TEXT, attempt TEXT)")

    def stage(self, kind: str, job: str, attempt: str, rows: list[dict]) -> None:
        names = self.columns[kind]
        value = lambda v: json.dumps(v) if isinstance(v, list) else v
        with self.open() as db:
            db.executemany(f"INSERT INTO staged_{kind} VALUES (?, ?, {', '.join('?' * len(names))})", [(job, attempt, *(value(r.get(n)) for n in names)) for r in rows])

    def publish(self, kind: str, job: str, attempts: list[str]) -> None:
        names, keys = self.columns[kind], KEYS[kind]
        rest = ", ".join(f"s.{n}" if n in keys else f"MIN(s.{n})" for n in names)
        same = " AND ".join(f"t.{k} = s.{k}" for k in keys)
        with self.open() as db:
            db.executemany(f"INSERT INTO committed_{kind} VALUES (?, ?)", [(job, a) for a in attempts])
            db.execute(
                f"INSERT INTO {kind} SELECT {rest} FROM staged_{kind} s JOIN committed_{kind} c ON c.job = s.job AND c.attempt = s.attempt WHERE s.job = ? "
                f"AND NOT EXISTS (SELECT 1 FROM {kind} t WHERE {same}) GROUP BY {', '.join(f's.{k}' for k in keys)}",
                (job,),
            )
            self._clear(db, kind, job)

    def _clear(self, db, kind: str, job: str) -> None:
        for table in (f"staged_{kind}", f"committed_{kind}"):
            db.execute(f"DELETE FROM {table} WHERE job = ?", (job,))

    def discard(self, kind: str, job: str) -> None:
        with self.open() as db:
            self._clear(db, kind, job)

    def scan(self, kind: str, values: list[str] | None, part: int, parts: int) -> Iterator[tuple]:
        names = self.columns[kind]
        split = "case_id" if kind == "edges" else "length(name)"
        query, given = f"SELECT {', '.join(names)} FROM {kind} WHERE ABS({split}) % ? = ?", [parts, part]
        if values is not None:
            query += f" AND {FILTERED[kind]} IN ({', '.join('?' * len(values))})"
            given += values
        with self.open() as db:
            for row in db.execute(query, given):
                yield tuple(json.loads(v) if n == "embedding" and v is not None else v for n, v in zip(names, row, strict=True))


class CypherGraph:
    """The same over Cypher: ``run(statement, parameters)`` executes one statement as a transaction and returns rows."""

    def __init__(self, run: Callable[[str, dict], Iterable], most: int = 10_000):
        self.run, self.most = run, most

    def stage(self, kind: str, job: str, attempt: str, rows: list[dict]) -> None:
        self.run(f"UNWIND $rows AS row CREATE (s:Staged_{kind} {{job: $job, attempt: $attempt}}) SET s += row", {"job": job, "attempt": attempt, "rows": rows})

    def publish(self, kind: str, job: str, attempts: list[str]) -> None:
        if kind == "nodes":
            merge = "MERGE (n:Entity {name: s.name, type: s.type}) SET n.embedding = coalesce(n.embedding, s.embedding)"
        else:
            merge = "MERGE (a:Entity {name: s.head, type: coalesce(s.head_type, '')}) MERGE (b:Entity {name: s.tail, type: coalesce(s.tail_type, '')}) MERGE (a)-[:RELATION {case_id: s.case_id, relation: s.relation}]->(b)"
        # One statement, so one transaction: all of the job's rows or none.
        self.run(f"MATCH (s:Staged_{kind} {{job: $job}}) FOREACH (_ IN CASE WHEN s.attempt IN $attempts THEN [1] ELSE [] END | {merge}) DELETE s", {"job": job, "attempts": attempts})

    def discard(self, kind: str, job: str) -> None:
        self.run(f"MATCH (s:Staged_{kind} {{job: $job}}) DELETE s", {"job": job})

    def scan(self, kind: str, values: list[str] | None, part: int, parts: int) -> Iterator[tuple]:
        if kind == "nodes":
            found, split, out = "(n:Entity)", "size(n.name)", "n.name, n.type, n.embedding"
            only = "n.type IN $values"
        else:
            found, split, out = "(a:Entity)-[r:RELATION]->(b:Entity)", "r.case_id", "r.case_id, a.name, a.type, r.relation, b.name, b.type"
            only = "r.relation IN $values"
        where = f"abs({split}) % $parts = $part" + (f" AND {only}" if values is not None else "")
        for row in self.run(f"MATCH {found} WHERE {where} RETURN {out}", {"values": values, "parts": parts, "part": part}):
            yield tuple(row)


def register(spark) -> None:
    """Make the format known; filters reach a source in Python only where the session allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(PropertyGraph)
