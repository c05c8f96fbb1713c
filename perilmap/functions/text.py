"""Text operators as column expressions; all run inside the JVM."""

from __future__ import annotations

from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = "##########"
#: White space of every kind, with full-width spaces.
SPACE = r"(?U)\s+"
#: White space at either end. A run inside is passed once: only its first place may match, and nothing is given back.
ENDS = r"(?U)^\s++|(?<!\s)\s++$"


def normalize_space(text: Column) -> Column:
    """Runs of white space become one space; none at either end."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, ENDS, "")


def split_cases(docs: DataFrame, delimiter: str = "Case", numbered: bool = True) -> DataFrame:
    """(doc_id, seg_no, segment): the text between delimiters, blank segments left out.

    ``numbered`` keeps only segments that begin with an ASCII digit and puts the delimiter
    back before them; the delimiter counts wherever it stands, even inside a sentence.
    """
    parts = docs.select("doc_id", F.posexplode(F.split("text", _quoted(delimiter), -1)).alias("seg_no", "segment"))
    parts = parts.withColumn("segment", strip(F.col("segment"))).filter("segment <> ''")
    if numbered:
        parts = parts.filter(F.col("segment").rlike("^[0-9]")).withColumn("segment", F.concat(F.lit(delimiter), "segment"))
    return parts


def split_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, seg_no, segment): the text between lines of ten hashes, empty segments left out."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"(?:\G|(?<!\s))\s*+#{10}\s*+", -1)).alias("seg_no", "segment"))
    return parts.withColumn("segment", strip(F.col("segment"))).filter("segment <> ''")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


@dataclass(frozen=True)
class Profile:
    """Labels of the four sections of a case, and what ends the last of them (nothing: the end)."""

    time: str
    stage: str
    phenomenon: str
    cause: str
    end: str | None = None

    @property
    def labels(self) -> tuple[tuple[str, str], ...]:
        return (("occurrence_time", self.time), ("occurrence_stage", self.stage), ("problem_phenomenon", self.phenomenon), ("root_cause", self.cause))


ARABIC = Profile("1. Occurrence Time", "2. Occurrence Stage", "3. Problem Phenomenon", "4. Root Cause Analysis")
ROMAN = Profile("I. Occurrence Time", "II. Occurrence Stage", "III. Problem Phenomenon", "IV. Analysis of Problem Causes", "V. Countermeasures")


def section(text: Column, label: str, until: str | None) -> Column:
    """The text after a label (half- or full-width colon) up to the next; '' where there is none."""
    stop = f"(?={_quoted(until)})" if until else r"\z"
    found = F.regexp_extract(text, rf"(?s){_quoted(label)}[\s:：]++(.*?){stop}", 1)
    return F.when(F.contains(text, F.lit(until)), found).otherwise("") if until else found


def extract_sections(segments: DataFrame, profile: Profile = ARABIC, column: str = "segment") -> DataFrame:
    """Adds the four sections of a case as columns, white space normalized, '' when missing."""
    text = F.coalesce(F.col(column), F.lit(""))
    labels = profile.labels
    for k, (name, label) in enumerate(labels):
        if k + 1 < len(labels):
            found = section(text, label, labels[k + 1][1])
        elif profile.end:
            found = section(text, label, profile.end)
            found = F.when(F.contains(text, F.lit(profile.end)), found).otherwise(section(text, label, None))
        else:
            found = section(text, label, None)
        segments = segments.withColumn(name, normalize_space(found))
    return segments


def strip_code_fence(text: Column) -> Column:
    """The inside of a ```json fence without white space around it; any other text as it is."""
    inner = strip(F.substr(text, F.lit(8), F.length(text) - 10))
    return F.when(text.startswith("```json") & text.endswith("```"), inner).otherwise(text)


def render(template: str, **values: Column) -> Column:
    """A prompt or report: ``{name}`` in the template stands for the column of that name ('' for null).

    Doubled braces are braces; a name without a column raises KeyError.
    """
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def split_labels(text: Column, full_width: bool = True, drop_empty: bool = True) -> Column:
    """Labels between semicolons, trimmed; an empty list for null."""
    source = F.translate(text, "；", ";") if full_width else text
    parts = F.transform(F.split(source, ";", -1), strip)
    if drop_empty:
        parts = F.filter(parts, lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def ordered_distinct(labels: Column) -> Column:
    """Without repeats, in the order of first appearance."""
    return F.array_distinct(labels)


def first_label(text: Column) -> Column:
    """The part before the first semicolon, untrimmed; null when it is empty."""
    return F.nullif(F.split_part(text, F.lit(";"), F.lit(1)), F.lit(""))


def first_contained(text: Column, allowed: list[str]) -> Column:
    """The first of ``allowed``, in their order, that the text contains; null without one."""
    return F.get(F.filter(F.array(*[F.lit(a) for a in allowed]), lambda a: F.contains(text, a)), F.lit(0))
