"""Fill-in-middle: two cuts turn a text into prefix, middle and suffix, written in another order.

A text becomes an array of code points (UTF-32 in numpy). Each code point has a class; where
neighbours differ in class, one unit ends and the next begins (``flatnonzero`` gives all these
places at once). The hash of a document's id draws two ranks among the places; the array is
sliced there and the pieces are encoded again. Units are code points (``char``), runs of
letters and digits, of white space or of other signs (``word``), or lines with their breaks
(``line``).

The form is ``psm`` (prefix, suffix, middle), ``spm`` (suffix first) or ``plain``, which leaves
the text as it is. A text that holds a sentinel is always plain, so each sentinel stands once
in the output of the other forms and ``restore`` finds the pieces again.

Cases: a null text counts as empty, and an empty text is plain; a null id is drawn as an empty
one; rows with equal ids and texts give equal rows; an empty table gives no rows; columns other
than ``doc_id`` and ``text`` are ignored. A text's memory is a few times its UTF-32 form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back_memory, small_batches, table, without_encoders

RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Bytes of output after which a batch goes back to Spark.
BATCH_BYTES = 4 << 20

ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
g AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


@dataclass(frozen=True)
class Plan:
    """What is drawn for a document: shares in percent, the sentinels, the seed and the unit."""

    fim_percent: int = 90
    spm_percent: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "1:"
    unit: str = "char"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        # A mark that holds a part of another could be found where none was written.
        if not all(marks) or len(set(marks)) < 3 or any(a[k:].startswith(b[: len(a) - k]) for a in marks for b in marks for k in range(len(a)) if (a, k) != (b, 0)):
            raise ValueError("sentinels must not be empty, equal or overlap")
        if self.unit not in ("char", "word", "line"):
            raise ValueError(f"unknown unit: {self.unit}")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def classes(points: np.ndarray, unit: str, text: str) -> np.ndarray:
    """The class of each code point; a unit is a run of one class."""
    if unit == "char":
        return np.arange(len(points), dtype=np.int64)
    if unit == "line":
        breaks = points == 10
        return np.cumsum(breaks) - breaks  # a break belongs to the line before it
    seen, which = np.unique(points, return_inverse=True)
    kinds = [0 if c.isalnum() else 1 if c.isspace() else 2 for c in map(chr, seen.tolist())]
    return np.asarray(kinds, dtype=np.int8)[which]


def boundaries(points: np.ndarray, unit: str, text: str) -> np.ndarray:
    """The places where a text may be cut, from 0 to its end."""
    kinds = classes(points, unit, text)
    inner = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def transformed(text: str, draws: tuple[int, int, int, int], plan: Plan) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    points = code_points(text)
    places = boundaries(points, plan.unit, text)
    n = len(places) - 1
    if not n or any(mark in text for mark in (plan.prefix, plan.suffix, plan.middle)) or draws[2] % 100 >= plan.fim_percent:
        return n, "plain", None, None, text
    a, b = (int(x) for x in np.sort(places[[draws[0] % (n + 1), draws[1] % (n + 1)]]))
    before, between, after = (piece.tobytes().decode("utf-32-le") for piece in (points[:a], points[a:b], points[b:]))
    if draws[3] % 100 < plan.spm_percent:
        return n, "spm", a, b - a, "".join((plan.suffix, after, plan.prefix, before, plan.middle, between))
    return n, "psm", a, b - a, "".join((plan.prefix, before, plan.suffix, after, plan.middle, between))


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row for each document: doc_id, n (units), form, prefix_chars, middle_chars, output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_encoders()
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows, held = [], 0
            for doc_id, digest, text in zip(*(batch.column(c) for c in range(3)), strict=True):
                digest, text = digest.as_py(), text.as_py()
                draws = tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))
                rows.append((doc_id.as_py(), *transformed(text, draws, plan)))
                held += len(text)
                if held > BATCH_BYTES:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        give_back_memory()

    small_batches(docs.sparkSession)
    key = F.concat(F.lit(plan.seed), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(key.cast("binary"), 256).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, RESULT)


def restore(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The source text, rebuilt from an output and its form alone."""
    part = lambda text, mark, k: F.split_part(text, F.lit(mark), F.lit(k))
    middle = part(output, plan.middle, 2)
    psm = F.concat(part(part(output, plan.prefix, 2), plan.suffix, 1), middle, part(part(output, plan.suffix, 2), plan.middle, 1))
    spm = F.concat(part(part(output, plan.prefix, 2), plan.middle, 1), middle, part(part(output, plan.suffix, 2), plan.prefix, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
