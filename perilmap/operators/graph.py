"""Cleaning of extracted cause-and-effect triples, nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..functions.text import first_contained
from .answers import triplets

DEFECT = "QUALITY_DEFECT"
MOST_TRIPLETS = 20
# Allowed defects, and the relations each kind of head may have.
ALLOWED_DEFECTS = ["Spatter", "Edge Burning", "Air Hole", "Overlap", "Crack", "Pit"]
ALLOWED_RELATIONS = {
    "QUALITY_DEFECT": ("CAUSED_BY", "OCCURS_IN"),
    "HUMAN_FACTOR": ("LEADS_TO", "BELONGS_TO"),
    "EQUIPMENT_FACTOR": ("LEADS_TO", "BELONGS_TO"),
    "MATERIAL_FACTOR": ("LEADS_TO", "BELONGS_TO"),
    "ENVIRONMENT_FACTOR": ("LEADS_TO", "BELONGS_TO"),
    "MANAGEMENT_FACTOR": ("LEADS_TO", "BELONGS_TO"),
    "PROCESS_FACTOR": ("LEADS_TO", "BELONGS_TO"),
    "CONSTRUCTION_STAGE": (),
}


def relation_schema(spark: SparkSession, allowed=None) -> DataFrame:
    """(head_type, relation): a fixed dimension of a few rows."""
    rows = [(h, r) for h, rs in (allowed or ALLOWED_RELATIONS).items() for r in rs]
    return spark.createDataFrame(rows, "head_type string, relation string")


def explode_triplets(answers: DataFrame, column: str = "answer", most: int = MOST_TRIPLETS) -> DataFrame:
    """Rows of the first ``most`` triples in each JSON answer, with their place ``pos``; none where it doesn't parse."""
    return triplets(answers, column, most)


def clean_triplets(found: DataFrame, defects: list[str] | None = None) -> DataFrame:
    """Drop incomplete and self edges, then replace defects by the first allowed name they contain.

    Self edges are told before the names are normalized; a defect without an allowed name
    drops its triple.
    """
    allowed = ALLOWED_DEFECTS if defects is None else defects
    out = found.filter("head <> '' AND tail <> '' AND head <> tail")
    for end in ("head", "tail"):
        found = first_contained(F.col(end), allowed)
        is_defect = F.coalesce(F.col(f"{end}_type") == DEFECT, F.lit(False))
        out = out.withColumn(end, F.when(is_defect, found).otherwise(F.col(end))).filter(F.col(end).isNotNull())
    return out


def enforce_schema(found: DataFrame, schema: DataFrame) -> DataFrame:
    """Only triples whose relation the head's kind may have."""
    return found.join(F.broadcast(schema), ["head_type", "relation"], "left_semi")


def nodes(found: DataFrame) -> DataFrame:
    """(name, type), each once."""
    one = found.select(F.col("head").alias("name"), F.col("head_type").alias("type"))
    return one.unionByName(found.select(F.col("tail").alias("name"), F.col("tail_type").alias("type"))).distinct()


def with_embeddings(nodes_: DataFrame, embed, column: str = "embedding") -> DataFrame:
    """``nodes_`` (name, type) with a vector of each name from ``embed``, a function of a Series of names."""

    def add(it):
        for pdf in it:
            pdf[column] = [list(map(float, v)) for v in embed(pdf["name"])]
            yield pdf

    return nodes_.mapInPandas(add, StructType([*nodes_.schema.fields, StructField(column, ArrayType(FloatType()))]))


def edges(found: DataFrame, merge: bool = False) -> DataFrame:
    """One edge for each case; ``merge`` keeps one for each pair of ends and relation."""
    keep = [c for c in ("case_id", "head", "head_type", "relation", "tail", "tail_type") if c in found.columns]
    out = found.select(*keep)
    return out.dropDuplicates(["head", "relation", "tail"]).drop("case_id") if merge else out
