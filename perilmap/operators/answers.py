"""Answers of language models, read as VARIANT values: one field of a wrong type spoils no other.

An answer is JSON, alone, in a fence, or with talk around it. Its outermost object or list is
parsed once; each field is then read on its own by path and type, so the good fields of a
mixed answer stay. In a list of labels, strings stay, numbers and Booleans are taken as their
JSON text, and nulls, objects and lists are left out; a label alone is a list of one.

Cases: null, empty and broken answers give empty lists; an object of another shape gives what
fits; of an object with one key twice nothing is read, as its value is not defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ordered_distinct, strip_code_fence

TRIPLET_FIELDS = ("head", "head_type", "relation", "tail", "tail_type")
_NONE = "array<string>"


def json_text(answer: Column, opening: str = "{", closing: str = "}") -> Column:
    """The JSON in an answer: all of it (without a fence), or what lies between the outermost brackets; null without either."""
    bare = F.trim(strip_code_fence(answer), F.lit(" \t\r\n"))
    start = F.locate(opening, bare)
    until = F.length(bare) - F.locate(closing, F.reverse(bare)) + 1
    inner = F.when((start > 0) & F.contains(bare, F.lit(closing)) & (until > start), F.substr(bare, start, until - start + 1))
    return F.when(F.startswith(bare, F.lit(opening)) & F.endswith(bare, F.lit(closing)), bare).otherwise(inner)


def _get(value: Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(value, path, kind)


def label_list(value: Column) -> Column:
    """The labels in a VARIANT: a list's strings, numbers and Booleans, or one of these alone."""
    scalar = lambda v: ~F.schema_of_variant(v).rlike("^(?:OBJECT|ARRAY|VOID)")
    listed = F.transform(F.filter(_get(value, "array<variant>"), scalar), lambda v: _get(v, "string"))
    alone = F.when(scalar(value), F.array(_get(value, "string")))
    return F.coalesce(listed, alone, F.array().cast(_NONE))


def labels_by_category(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Adds ``fields``, a list of (category, labels) in the answer's order, without those that hold nothing."""
    text, fields = F.col("_json"), F.col("_map")
    parsed = answers.withColumn("_json", json_text(F.col(column))).withColumn("_map", _get(F.try_parse_json(text), "map<string,variant>"))
    # The value keeps its fields by name; their order is that of the text.
    keys = F.when(fields.isNotNull(), F.json_object_keys(text))
    made = F.filter(F.transform(keys, lambda k: F.struct(k.alias("category"), label_list(fields[k]).alias("labels"))), lambda f: F.size(f["labels"]) > 0)
    empty = F.array().cast("array<struct<category:string,labels:array<string>>>")
    return parsed.withColumn("fields", F.coalesce(made, empty)).drop("_json", "_map")


def flatten_labels(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Adds ``categories`` and ``factors`` of an answer, each freed of repeats on its own."""
    made = labels_by_category(answers, column)
    categories = ordered_distinct(F.transform("fields", lambda f: f["category"]))
    factors = ordered_distinct(F.flatten(F.transform("fields", lambda f: f["labels"])))
    return made.withColumn("categories", categories).withColumn("factors", factors).drop("fields")


def sub_factors(answer: Column, drop: str = "Unclassified") -> Column:
    """The labels under ``secondary_factors``, or else ``secondary_factor``, without ``drop``."""
    parsed = F.array(F.try_parse_json(json_text(answer)))
    pick = lambda v: F.coalesce(_get(v, "variant", "$.secondary_factors"), _get(v, "variant", "$.secondary_factor"))
    labels = F.transform(parsed, lambda v: F.filter(label_list(pick(v)), lambda x: x != drop))[0]
    return F.coalesce(labels, F.array().cast(_NONE))


def triplets(answers: DataFrame, column: str = "answer", most: int = 20) -> DataFrame:
    """(the other columns, pos, head, head_type, relation, tail, tail_type): the first ``most`` objects of each answer's list.

    A field that is no string, number or Boolean is null; entries that are no objects take no
    place; an object alone is a list of one.
    """
    keep = [c for c in answers.columns if c != column]
    body = F.coalesce(json_text(F.col(column), "[", "]"), json_text(F.col(column)))
    whole = F.try_parse_json(F.when(F.startswith(F.trim(strip_code_fence(F.col(column)), F.lit(" \t\r\n")), F.lit("{")), json_text(F.col(column))).otherwise(body))
    parsed = answers.withColumn("_v", whole)
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    entries = F.coalesce(_get(F.col("_v"), "array<variant>"), F.when(F.col("_v").isNotNull(), F.array("_v")))
    plain = lambda v: F.when(~F.schema_of_variant(v).rlike("^(?:OBJECT|ARRAY|VOID)"), _get(v, "string"))
    listed = parsed.select(*keep, F.posexplode(F.slice(F.filter(entries, is_object), 1, most)).alias("pos", "_v"))
    return listed.select(*keep, "pos", *[plain(_get(F.col("_v"), "variant", f"$.{f}")).alias(f) for f in TRIPLET_FIELDS])
