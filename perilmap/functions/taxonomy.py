"""The two-level factor taxonomy: 6 main categories, 17 sub-factors, and their aliases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes and names, in bit order.
MAIN = (
    ("HU", "Human Factors"),
    ("EN", "Environmental Factors"),
    ("EQ", "Equipment Factors"),
    ("MA", "Material Factors"),
    ("TE", "Technical Factors"),
    ("MG", "Management Factors"),
)
SUB = (
    ("H1", "Skill Level"),
    ("H2", "Responsibility & Attitude"),
    ("H3", "Operational Compliance"),
    ("MG1", "Supervision & Inspection"),
    ("MG2", "Systems & Procedures"),
    ("MG3", "Training & Briefing"),
    ("MA1", "Material Quality"),
    ("MA2", "Consumable Management"),
    ("MA3", "Storage Conditions"),
    ("TE1", "Process Design"),
    ("TE2", "Process Execution"),
    ("TE3", "Technical Standards"),
    ("EN1", "Weather Conditions"),
    ("EN2", "Construction Environment"),
    ("EQ1", "Equipment Status"),
    ("EQ2", "Tool Usage"),
    ("EQ3", "Performance Indicators"),
)
# Other names that mean the same.
ALIASES = {
    "Human": "HU",
    "Environment": "EN",
    "Equipment": "EQ",
    "Material": "MA",
    "Technology": "TE",
    "Management": "MG",
    "Operating Procedures": "H3",
    "Welding Material Management": "MA2",
}


@dataclass(frozen=True)
class Taxonomy:
    """Codes in bit order (bit i is factor i) and the names that lead to them."""

    codes: tuple[str, ...]
    names: tuple[tuple[str, str], ...]  # (name, code)

    @classmethod
    def of(cls, entries, aliases=None) -> Taxonomy:
        codes = tuple(c for c, _ in entries)
        names = [(n, c) for c, n in entries] + [(n, c) for n, c in (aliases or {}).items() if c in codes]
        return cls(codes, tuple(names))

    def bit(self, code: str) -> int:
        return self.codes.index(code)

    def code_map(self) -> Column:
        """name -> code, as a map literal."""
        return F.create_map(*[F.lit(x) for pair in self.names for x in pair])

    def bit_map(self) -> Column:
        """name -> 2 ** bit, as a map literal."""
        return F.create_map(*[x for name, code in self.names for x in (F.lit(name), F.lit(1 << self.bit(code)).cast("bigint"))])

    def table(self, spark: SparkSession) -> DataFrame:
        """(code, name, ord, parent): the dimension, one row for each code."""
        first = {c: n for n, c in reversed(self.names)}
        rows = [(c, first[c], i, c.rstrip("0123456789")) for i, c in enumerate(self.codes)]
        return spark.createDataFrame(rows, "code string, name string, ord int, parent string")


MAIN_FACTORS = Taxonomy.of(MAIN, ALIASES)
SUB_FACTORS = Taxonomy.of(SUB, ALIASES)


def parent_code(code: Column) -> Column:
    """The category of a sub-factor's code: the code without its digits."""
    return F.regexp_replace(code, "[0-9]", "")
