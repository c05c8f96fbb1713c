"""Rules that find phrases in texts: word n-grams joined with a table of rules.

Text and rules go through the same steps. Words are runs of letters and digits in lower case,
``of``, ``the``, ``a`` and ``an`` are left out, and endings of English inflection are cut, so
``lacked responsibility`` meets ``lack of responsibility`` and ``training`` never meets
``rain``. A slash in a rule parts its word into alternatives. Marks that end a clause stay as
words of their own, which no rule holds, so no phrase reaches over one.

Each place of a text whose word begins a rule gives its n-grams, as pairs of 64-bit hashes;
an equi-join with the rules finds the hits, so ten thousand rules cost the same join as ten. A
window over the hits of one text then drops those inside a longer hit of the same scheme and
marks those within ``WINDOW`` words after a negation in the same clause. A negation that is a
part of a phrase of any scheme (``no inspection``) negates nothing else.

Cases: null and empty texts have no hits; equal phrases of several codes all hit; texts that
share an id are taken as one; an empty rule table gives no hits.
"""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LONGEST = 5
WINDOW = 3
BARRIER = "|"
# Words that are left out, and words that turn what follows into its opposite.
SKIPPED = ("of", "the", "a", "an")
NEGATIONS = ("no", "not", "never", "without", "cannot", "neither", "nor")

# What points to each main category.
MAIN_PHRASES = {
    "HU": ("Lack of responsibility", "insufficient skill", "uncertified", "illegal operation", "new employee", "poor training"),
    "EQ": ("Damaged equipment", "abnormal function", "poor maintenance", "broken cables", "faulty indicators", "missing parts"),
    "MA": ("Wrong material", "unqualified raw materials", "rusty wire", "damp electrodes", "impurities", "wrong wire type"),
    "TE": ("Violated process requirements", "blueprint deviation", "design defect", "improper groove", "wrong welding sequence", "no preheating"),
    "EN": ("Rain/snow", "high humidity", "low temperature", "strong wind", "narrow space", "high construction difficulty"),
    "MG": ("No inspection", "lack of supervision", "poor duty performance", "failed briefing", "insufficient manpower", "skipped procedures"),
}
# What points to each sub-factor.
SUB_PHRASES = {
    "H1": ("Insufficient skill", "poor training", "new employees", "unable to read blueprints", "uncertified"),
    "H2": ("Lack of responsibility", "weak quality awareness", "careless work", "blind construction"),
    "H3": ("Illegal operations", "violating blueprints/processes", "improper handling", "wrong welding sequence"),
    "EQ1": ("Abnormal equipment", "damaged functions", "missing parts", "poor maintenance", "broken cables"),
    "EQ2": ("Improper tool use", "unqualified tools", "insufficient protection", "welder failure"),
    "EQ3": ("Abnormal voltage/current", "excessive speed", "insufficient heating temperature"),
    "MA1": ("Unqualified materials", "raw materials not meeting requirements", "excess hardness", "unauthorized substitution"),
    "MA2": ("Rusty wire", "damp electrodes", "wrong wire type used"),
    "MA3": ("Improper temporary storage", "insufficient oven temperature", "damp/rusty consumables"),
    "TE1": ("Design defects", "incomplete processes", "groove issues", "lack of targeted process plans"),
    "TE2": ("Improper parameters", "wrong methods", "chaotic sequence", "insufficient pretreatment", "fast welding"),
    "TE3": ("Unclear standards", "mismatched specs", "insufficient weld leg", "excessive gap"),
    "EN1": ("Impact of rain", "snow", "low temperature", "high humidity", "monsoon season"),
    "EN2": ("Narrow space", "high difficulty", "poor conditions", "strong wind", "poor lighting"),
    "MG1": ("Inadequate inspection", "missing mutual checks", "lack of oversight", "failure to detect issues"),
    "MG2": ("Imperfect systems", "failure to implement requirements", "non-standard workflows", "poor dispatching"),
    "MG3": ("Insufficient training", "unclear briefing", "requirements not communicated", "lack of pre-job training"),
}
#: Wordings of our own beside these: other forms of the same sign that inflection doesn't reach.
MORE_SUB_PHRASES = {"H2": ("lacked responsibility",), "H3": ("violation of blueprints/processes",), "EN1": ("rain", "monsoon"), "EN2": ("insufficient light",), "MG1": ("failed to inspect", "failed to detect"), "TE2": ("welding too fast",)}


def alternatives(phrase: str) -> list[str]:
    """The phrases that a phrase with slashes stands for: ``damp/rusty wire`` for two."""
    return [" ".join(words) for words in product(*(w.split("/") for w in phrase.split()))]


def phrase_rules(spark: SparkSession, schemes: dict[str, dict[str, tuple[str, ...]]]) -> DataFrame:
    """(scheme, code, phrase) of tables from code to phrases, slashes resolved.

    An Arrow table becomes a local relation, whose size Catalyst knows; rows of Python objects
    would count as endless, and every word of every text would be shuffled to meet them.
    """
    rows = [(s, c, a) for s, rules in schemes.items() for c, phrases in rules.items() for p in phrases for a in alternatives(p)]
    columns = zip(*rows, strict=True) if rows else [(), (), ()]
    return spark.createDataFrame(pa.table([pa.array(c, pa.string()) for c in columns], ["scheme", "code", "phrase"]), "scheme string, code string, phrase string")


def stem(word: Column) -> Column:
    """A word without the endings -s, -es, -ing, -ed and -e; short words stay."""
    n = F.length(word)
    cut = lambda w, k: F.substr(w, F.lit(1), F.length(w) - k)
    ends = lambda w, *xs: F.rlike(w, F.lit(f"(?:{'|'.join(xs)})$")) if len(xs) > 1 else F.endswith(w, F.lit(xs[0]))
    singular = (
        F.when((n >= 5) & ends(word, "ies"), F.concat(cut(word, 3), F.lit("y")))
        .when(ends(word, "sses", "shes", "ches", "xes"), cut(word, 2))
        .when((n >= 5) & ends(word, "s") & ~ends(word, "ss", "us", "is"), cut(word, 1))
        .otherwise(word)
    )
    once = lambda value, f: F.transform(F.array(value), f)[0]
    base = once(singular, lambda w: F.when((F.length(w) >= 7) & ends(w, "ing") & ~ends(w, "eing"), cut(w, 3)).when((F.length(w) >= 6) & ends(w, "ed") & ~ends(w, "eed"), cut(w, 2)).otherwise(w))
    return once(base, lambda w: F.when((F.length(w) >= 5) & ends(w, "e"), cut(w, 1)).otherwise(w))


def stems(text: Column) -> Column:
    """The words of a text as rules see them, with a barrier where a clause ends."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "n['’]t", " not ")
    parts = F.split(F.regexp_replace(low, r"[.,;:!?\n()]+", f" {BARRIER} "), r"[^\p{L}\p{N}|]+")
    kept = F.filter(parts, lambda w: (w != "") & ~w.isin(*SKIPPED))
    return F.transform(kept, lambda w: F.when(F.length(w) < 5, w).otherwise(stem(w)))


def _keys(hashes: Column) -> list[Column]:
    """Two hashes of a list of word hashes; both must agree for a hit."""
    return [F.xxhash64(hashes).alias("key"), F.xxhash64(F.lit(1), hashes).alias("check")]


def find_phrases(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, scheme, code, phrase, place, words, negated) of ``texts`` (id, text): the longest hits.

    ``place`` counts words from 0, clause ends included; ``words`` is how many the hit covers.
    """
    hashed = lambda ws: F.transform(ws, lambda w: F.xxhash64(w))
    table = rules.select("scheme", "code", "phrase", hashed(stems(F.col("phrase"))).alias("h")).filter(F.size("h").between(1, LONGEST))
    table = table.select("scheme", "code", "phrase", F.col("h")[0].alias("first"), F.size("h").alias("words"), *_keys(F.col("h")))
    prepared = texts.filter(F.length("text") > 0).select("id", stems(F.col("text")).alias("w")).withColumn("h", hashed(F.col("w")))
    # What a place needs later on is cut out here, so that the text isn't carried along.
    at = lambda k: F.struct(k.alias("place"), F.slice("h", k + 1, F.lit(LONGEST)).alias("ahead"), F.slice("w", F.greatest(k - WINDOW + 1, F.lit(1)), F.least(k, F.lit(WINDOW))).alias("before"))
    # Without words the list is null. A filter on its size would be pushed below and make the words a second time.
    places = prepared.select("id", F.explode(F.transform(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)), at)).alias("p"))
    begun = places.withColumn("first", F.col("p.ahead")[0]).join(table.select("first").distinct(), "first", "left_semi")
    grams = begun.select("id", "p.*", F.explode(F.sequence(F.lit(1), F.size("p.ahead"))).alias("n"))
    grams = grams.select("id", "place", "before", "n", *_keys(F.slice("ahead", F.lit(1), F.col("n"))))
    found = grams.join(table.drop("first"), ["key", "check"]).filter("n = words")

    # How many words back the last negation of the same clause is; null without one.
    back = F.reverse("before")
    clause = F.when(F.array_position(back, BARRIER) > 0, F.slice(back, F.lit(1), F.array_position(back, BARRIER).cast("int") - 1)).otherwise(back)
    marks = F.transform(clause, lambda w: w.isin(*NEGATIONS))
    found = found.select("id", "scheme", "code", "phrase", "place", "words", F.nullif(F.array_position(marks, F.lit(True)), F.lit(0)).alias("back"))

    near = Window.partitionBy("id").orderBy("place").rangeBetween(-(LONGEST + WINDOW), 0)
    spans = F.collect_set(F.struct("scheme", "place", "words")).over(near)
    inside = F.exists("spans", lambda s: (s["scheme"] == F.col("scheme")) & (s["words"] > F.col("words")) & (s["place"] <= F.col("place")) & (s["place"] + s["words"] >= F.col("place") + F.col("words")))
    mark = F.col("place") - F.col("back")
    own = F.exists("spans", lambda s: (s["place"] <= mark) & (s["place"] + s["words"] > mark))
    out = found.withColumn("spans", spans).filter(~inside)
    return out.select("id", "scheme", "code", "phrase", "place", "words", (F.col("back").isNotNull() & ~own).alias("negated"))


def phrase_codes(hits: DataFrame) -> DataFrame:
    """(id, scheme, codes): the codes of each text's hits that aren't negated, by first appearance, then code."""
    firsts = hits.filter("NOT negated").groupBy("id", "scheme", "code").agg(F.min("place").alias("place"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "code"))), lambda x: x["code"])
    return firsts.groupBy("id", "scheme").agg(ordered.alias("codes"))
