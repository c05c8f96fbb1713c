"""A stand-in for a graph database: one SQLite file, and a note of each scan."""

import sqlite3
from contextlib import contextmanager

from perilmap.sources.graph_store import SqlGraph


class Noted(SqlGraph):
    def __init__(self, path: str):
        self.path = path
        super().__init__(self.connection)

    @contextmanager
    def connection(self):
        db = sqlite3.connect(self.path, timeout=60)
        try:
            with db:
                yield db
        finally:
            db.close()

    def scan(self, kind, values, part, parts):
        with open(self.path + ".scans", "a") as f:
            f.write(f"{kind} {values} {part}/{parts}\n")
        yield from super().scan(kind, values, part, parts)


def client(options):
    return Noted(options["db"])
