r"""Chat formatting with a grammar round trip; DataFrame operations only.

A turn is ``### role: text</turn>`` and a line break. The parser is deterministic: a
conversation is cut at each ``</turn>`` with its line break, a turn's role ends at the
first ``: ``, and escapes are undone. Every turn is rendered with its text as it is and
parsed again; where the result is not what went in, or the text holds one of the
template's control strings, it is escaped and checked once more (a difference that stays
raises an error). An escape doubles backslashes and puts one into control strings, which is
reversible for every text. The output keeps the segments of each conversation with their
loss mask: only assistant texts are under it.

Cases: null texts and roles count as empty; null turns come first; equal turn numbers are
ordered by role and text and all stay; a null conversation id is one conversation; an empty
table gives no rows; other columns are ignored. A conversation is one row of the output,
so it has to fit a string (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, written

HEAD, END = "### ", "</turn>"
LEARNED = "assistant"
FIXTURE = r"\### Assistant: </turn> ok"
#: (control string, the same with a backslash inside)
CONTROLS = ((END, "<\\/turn>"), (HEAD, "#\\## "))

ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') AS esc,
  replace(replace(replace(text, '<\/turn>', '</turn>'), '#\## ', '### '), '\\', '\') AS une FROM c),
b AS (SELECT *, CASE WHEN une <> text OR contains(text, '</turn>') OR contains(text, '### ') THEN esc ELSE text END AS body FROM e)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM b GROUP BY conv_id
"""


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, marked in CONTROLS:
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column) -> Column:
    for plain, marked in CONTROLS:
        text = F.replace(text, F.lit(marked), F.lit(plain))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def header(role: Column) -> Column:
    return F.concat(F.lit(HEAD), F.replace(escape(role), F.lit(": "), F.lit(":\\ ")), F.lit(": "))


def parse(turn: Column) -> Column:
    """(role, text) of a rendered turn that has lost its end mark."""
    inner = F.substr(turn, F.lit(len(HEAD) + 1))
    name = F.substring_index(inner, ": ", 1)
    return F.struct(unescape(F.replace(name, F.lit(":\\ "), F.lit(": "))).alias("role"), unescape(F.substr(inner, F.length(name) + 3)).alias("text"))


def parse_all(formatted: Column) -> Column:
    """The turns of a rendered conversation."""
    cut = F.split(formatted, END + "\n", -1)
    return F.transform(F.slice(cut, 1, F.size(cut) - 1), parse)


def format_turns(turns: DataFrame) -> DataFrame:
    """Rendered turns (conv_id, turn, role, text, head, body), each proved to parse back."""
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("head", header(F.col("role")))
    source = F.struct("role", "text")
    as_is = parse_all(F.concat("head", "text", F.lit(END + "\n")))
    fine = (F.size(as_is) == 1) & (as_is[0] == source)
    for control, _ in CONTROLS:
        fine = fine & ~F.contains("text", F.lit(control))
    chosen = plain.withColumn("body", F.when(fine, F.col("text")).otherwise(escape(F.col("text"))))
    again = parse_all(F.concat("head", "body", F.lit(END + "\n")))
    same = (F.size(again) == 1) & (again[0] == source)
    return chosen.withColumn("body", F.when(same, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("a turn does not parse back: "), F.col("body"))).cast("string")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id and its segments (text, loss) in order."""
    made = format_turns(turns)
    # Turns are combined within each task before they are shuffled.
    sorted_turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body")))
    pieces = lambda t: F.array(
        F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
        F.struct(t["body"].alias("text"), (t["role"] == LEARNED).alias("loss")),
        F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
    )
    return made.groupBy("conv_id").agg(sorted_turns.alias("turns")).select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what parser and loss mask make of the output."""
    whole = formatted.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("f"), F.filter("segments", lambda s: s["loss"]).alias("under"))
    parsed = whole.select(
        "conv_id", "f", parse_all(F.col("f")).alias("turns"),
        F.array_join(F.transform("under", lambda s: unescape(s["text"])), "").alias("loss"),
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("f").cast("long").alias("formatted_chars"),
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    fixture = spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(id AS BIGINT) AS turn, IF(id = 0, 'user', 'assistant') AS role FROM range(0, 2, 1, 1)").withColumn("text", F.lit(FIXTURE))
    out = written(format_conversations(turns.unionByName(fixture)), shared_dir(spark, "chat"))
    return read_back(out)
