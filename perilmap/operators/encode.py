"""Multi-hot encoding of cases as bit masks, and codes of factor lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import Taxonomy


def case_masks(cases: DataFrame, labels: DataFrame, taxonomy: Taxonomy, case: str = "case_id", label: str = "label") -> DataFrame:
    """(case, mask): bit i is set where the case has factor i.

    ``labels`` holds (case, label) rows. Unknown labels are ignored and repeats collapse; a
    case without any known label keeps mask 0. Bits are or-ed within each task before the
    shuffle, so a case with very many labels costs one row for each task.
    """
    bit = F.coalesce(taxonomy.bit_map()[F.col(label)], F.lit(0).cast("bigint"))
    masks = labels.groupBy(case).agg(F.bit_or(bit).alias("mask"))
    return cases.select(case).distinct().join(masks, case, "left").select(case, F.coalesce("mask", F.lit(0).cast("bigint")).alias("mask"))


def masks_of_labelled(labels: DataFrame, taxonomy: Taxonomy, case: str = "case_id", label: str = "label") -> DataFrame:
    """As ``case_masks`` where every case has at least one row: one shuffle, no join."""
    bit = F.coalesce(taxonomy.bit_map()[F.col(label)], F.lit(0).cast("bigint"))
    return labels.groupBy(case).agg(F.bit_or(bit).alias("mask"))


def mask_of_list(labels: Column, taxonomy: Taxonomy) -> Column:
    """The mask of an array of labels."""
    bits = F.transform(labels, lambda x: F.coalesce(taxonomy.bit_map()[x], F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def multi_hot(masks: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """The mask as one 0/1 column for each code."""
    flags = [F.shiftright("mask", k).bitwiseAND(F.lit(1).cast("bigint")).alias(code) for k, code in enumerate(taxonomy.codes)]
    return masks.select(*[c for c in masks.columns if c != "mask"], *flags)


def bit_string(mask: Column, size: int) -> Column:
    """The mask with factor 0 first: mask 5 of six factors is 101000."""
    return F.reverse(F.lpad(F.bin(mask), size, "0"))


def factor_codes(names: Column, taxonomy: Taxonomy) -> Column:
    """Codes of the names, space-joined; unknown names are left out, repeats stay."""
    codes = F.transform(names, lambda x: taxonomy.code_map()[x])
    return F.array_join(F.filter(codes, lambda x: x.isNotNull()), " ")


def path_codes(path: Column, taxonomy: Taxonomy, unknown: str = "UNK") -> Column:
    """Codes of the names along a path (array), space-joined; unknown names become ``unknown``."""
    return F.array_join(F.transform(path, lambda x: F.coalesce(taxonomy.code_map()[F.trim(x)], F.lit(unknown))), " ")
