"""Classification of texts into factors: pluggable, with rules as the offline default.

The rules of the two levels are phrases (``phrases.py``); ``keyword_codes`` is for word parts.

A classifier is a function of a pandas Series of texts that returns a Series of JSON answers.
Calls to a model server run on the executors, in Arrow batches, with retries and a pause; a
text is sent once however many rows hold it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_label, render, strip
from .answers import flatten_labels, sub_factors

Classifier = Callable[[pd.Series], pd.Series]

MAIN_PROMPT = """Sort the causes that the text names into these categories: {categories}.
Answer with one JSON object from category to a list of causes, and nothing else.

{text}"""
SUB_PROMPT = """Name the sub-factors, of these only, that the factor belongs to: {names}.
Answer with a JSON object that lists them under "secondary_factors"; "Unclassified" if none fits.

Factor: {text}"""


def keyword_codes(text, rules: dict) -> F.Column:
    """The codes whose keywords a text contains (in lower case), in the order of the rules."""

    def codes(low: F.Column) -> F.Column:
        hits = [F.when(reduce(or_, [F.contains(low, F.lit(w)) for w in words]), F.lit(code)) for code, words in rules.items()]
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    # As a variable of a function the text in lower case is made once, not once for each word.
    return F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), codes)[0]


class Pace:
    """Lets calls of one task pass at an even rate: a token bucket that holds one token."""

    def __init__(self, per_second: float):
        self.gap, self.next = 1 / per_second, 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if now < self.next:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def with_retries(classify: Classifier, tries: int = 3, pause: float = 0.0, pace: Pace | None = None) -> Callable[[pd.Series], pd.DataFrame]:
    """Answers and a status for each text of a batch.

    If the call for a whole batch fails, each text is sent alone, so that one bad text spoils no
    other. Failures of transport (``OSError``, as lost connections and time-outs are) are tried
    ``tries`` times in all; what fails then, or in any other way, is ``Failed``. With a ``pace``
    or a ``pause`` every text is a call of its own, which waits for the pace and is followed by
    the pause; a call that is tried again does both again.
    """

    def alone(text: str) -> tuple[str | None, str]:
        for _ in range(tries):
            if pace:
                pace.wait()
            try:
                return classify(pd.Series([text])).iloc[0], "Success"
            except OSError:
                continue
            except Exception:  # an answer that can't be read: the same text would fail again
                break
            finally:
                time.sleep(pause)
        return None, "Failed"

    def run(texts: pd.Series) -> pd.DataFrame:
        if not (pace or pause):
            try:
                return pd.DataFrame({"answer": classify(texts).to_numpy(), "status": "Success"})
            except Exception:  # one of the texts: each is tried alone
                pass
        return pd.DataFrame([alone(t) for t in texts], columns=["answer", "status"])

    return run


def classify_texts(rows: DataFrame, column: str, classify: Classifier, tries: int = 3, pause: float = 0.0, parallel: int | None = None, template: str | None = None, rate: float | None = None) -> DataFrame:
    """``rows`` with ``answer`` and ``status``: each distinct text is classified once.

    Null and blank texts and ``nan`` are ``Skipped``. ``parallel`` bounds the number of calls at
    a time; ``template`` is the prompt, with ``{text}`` for the text. ``rate`` is the number of calls a
    second over the whole cluster: each task has the share of the tasks that can run at a time,
    ``parallel`` of them or as many as there are cores.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if rate and not parallel:
        parallel = cores
    share = rate / min(parallel, cores) if rate else None
    fine = ~F.lower(strip(F.col(column))).isin("", "nan")
    texts = rows.filter(fine).select(F.col(column).alias("_text")).distinct()
    texts = texts.withColumn("_prompt", render(template, text=F.col("_text")) if template else F.col("_text"))
    if parallel:
        texts = texts.repartition(parallel)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = with_retries(classify, tries, pause, Pace(share) if share else None)
        for pdf in it:
            out = run(pdf["_prompt"])
            out.insert(0, "_text", pdf["_text"].to_numpy())
            yield out

    answers = texts.mapInPandas(batches, "_text string, answer string, status string")
    joined = rows.join(answers, F.col(column) == F.col("_text"), "left").drop("_text")
    return joined.withColumn("status", F.coalesce("status", F.lit("Skipped")))


def main_labels(rows: DataFrame, column: str, classify: Classifier, categories: tuple[str, ...], **calls) -> DataFrame:
    """``rows`` with ``Risk_Factors`` and ``Factor_Categories``, each joined by ``; `` ('' where nothing was found)."""
    prompt = MAIN_PROMPT.replace("{categories}", ", ".join(categories))
    flat = flatten_labels(classify_texts(rows, column, classify, template=prompt, **calls))
    return flat.withColumn("Risk_Factors", F.array_join("factors", "; ")).withColumn("Factor_Categories", F.array_join("categories", "; ")).drop("answer", "factors", "categories")


def sub_labels(rows: DataFrame, column: str, classify: Classifier, names: tuple[str, ...], **calls) -> DataFrame:
    """``rows`` with ``Secondary_Factors``, joined by ``; ``, of the text (a path, say) in ``column``."""
    answered = classify_texts(rows, column, classify, template=SUB_PROMPT.replace("{names}", ", ".join(names)), **calls)
    return answered.withColumn("Secondary_Factors", F.array_join(sub_factors(F.col("answer")), "; ")).drop("answer")


def node_classes(counts: DataFrame, classify: Classifier, names: tuple[str, ...], **calls) -> DataFrame:
    """(name, cls) of every node name in (source, target, cnt): the first sub-factor of its answer, or null."""
    ends = counts.select(F.col("source").alias("name")).union(counts.select("target")).distinct()
    return sub_labels(ends, "name", classify, names, **calls).select("name", first_label(F.col("Secondary_Factors")).alias("cls"))


def classification_log(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """(source, target, cnt, source_class, target_class, status) of every edge."""
    one, two = classes.select(F.col("name").alias("source"), F.col("cls").alias("source_class")), classes.select(F.col("name").alias("target"), F.col("cls").alias("target_class"))
    out = counts.join(one, "source", "left").join(two, "target", "left")
    fine = F.col("source_class").isNotNull() & F.col("target_class").isNotNull()
    return out.select("source", "target", "cnt", "source_class", "target_class", F.when(fine, "Success").otherwise("Skipped").alias("status"))
