"""Queries over texts rendered from the test tables: phrase rules, JSON answers, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers, graph, phrases
from .catalog import _BRANDED, LINE_ORDER, TYPES, _branded, query, read

# --- phrase rules -------------------------------------------------------------------------

MERGED_SUB = {c: (*ps, *phrases.MORE_SUB_PHRASES.get(c, ())) for c, ps in phrases.SUB_PHRASES.items()}
# The test texts are invented prose, so a third table names phrases that do stand in them.
NOTICES = {"LICENCE": ("licensed/released under", "MIT License", "all rights reserved", "public license version", "copyright"), "SECRET": ("token", "password", "api key", "secret"), "CONTACT": ("call", "mail", "phone", "born")}
SCHEMES = {"main": phrases.MAIN_PHRASES, "sub": MERGED_SUB, "notice": NOTICES}
# Sentences that reports of the test tables are made of: plain, inflected, negated, with slashes, and near misses.
SENTENCES = (
    "Insufficient training was given.", "The crew lacked responsibility", "unable to read the blueprints!", "They were able to read blueprints.", "It didn't rain, but a strong wind blew.", "No inspection and poor training were noted;", "There was no rain or snow.",
    "Damp/rusty consumables were found", "Abnormal voltage/current readings.", "Violating blueprints, and the violated processes.", "Raw materials not meeting the requirements.", "Without skipped procedures; narrow spaces", "Welding too fast in the narrow space.", "Requirements were not communicated.",
    "the train ran on", "Low temperatures: high humidity (monsoon season)", "never a design defect", "Incomplete process. Groove issue", "wrong wire types used", "new employees, uncertified", "Failed to inspect the parts", "lack of supervision of the work",
)


def _stem_sql(w: str) -> str:
    for pattern, by in (("^(.{2,})ies$", r"\1y"), ("^(.*(?:ss|sh|ch|x))es$", r"\1"), ("^(.{3,}[^sui])s$", r"\1"), ("^(.{3,}[^e])ing$", r"\1"), ("^(.{3,}[^e])ed$", r"\1"), ("^(.{4,})e$", r"\1")):
        w = f"regexp_replace({w}, '{pattern}', '{by}')"
    return w


def _stems_sql(text: str) -> str:
    skipped = ", ".join(repr(w) for w in ("", *phrases.SKIPPED))
    parts = rf"string_split_regex(regexp_replace(regexp_replace(lower(coalesce({text}, '')), 'n[''’]t', ' not ', 'g'), '[.,;:!?\n()]+', ' | ', 'g'), '[^\p{{L}}\p{{N}}|]+')"
    return f"list_transform(list_filter({parts}, lambda w: w NOT IN ({skipped})), lambda w: CASE WHEN length(w) < 5 THEN w ELSE {_stem_sql('w')} END)"


_RULE_ROWS = ", ".join("('{}', '{}', '{}')".format(s, c, a) for s, rules in SCHEMES.items() for c, ps in rules.items() for p in ps for a in phrases.alternatives(p))
_NEGATION_LIST = ", ".join(repr(w) for w in phrases.NEGATIONS)


def _phrases_sql(texts: str) -> str:
    """Hits by comparing lists of words; ``texts`` gives (id, text)."""
    return f"""
WITH texts AS ({texts}), rules AS (SELECT scheme, code, phrase, {_stems_sql('phrase')} AS r FROM (VALUES {_RULE_ROWS}) AS v(scheme, code, phrase)), t AS (SELECT id, {_stems_sql('text')} AS w FROM texts),
firsts AS (SELECT DISTINCT r[1] AS first FROM rules), p AS (SELECT id, unnest(w) AS first, unnest(range(len(w))) AS place, w FROM t WHERE len(w) > 0), q AS (SELECT id, place, w, p.first FROM p JOIN firsts ON p.first = firsts.first),
h AS (SELECT id, scheme, code, phrase, place, len(r) AS words, w FROM q JOIN rules ON q.first = r[1] AND w[place + 1:place + len(r)] = r),
n AS (SELECT *, CASE WHEN w[place] IN ({_NEGATION_LIST}) THEN 1 WHEN w[place] = '|' THEN NULL WHEN w[place - 1] IN ({_NEGATION_LIST}) AND place > 1 THEN 2 WHEN w[place - 1] = '|' AND place > 1 THEN NULL WHEN place > 2 AND w[place - 2] IN ({_NEGATION_LIST}) THEN 3 END AS back FROM (SELECT * FROM h) WHERE place > 0 UNION ALL SELECT *, NULL FROM h WHERE place = 0),
spans AS (SELECT DISTINCT id, scheme, place, words FROM h)
SELECT id, scheme, code, phrase, CAST(place AS INT) AS place, CAST(words AS INT) AS words, back IS NOT NULL AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.id = n.id AND s.place <= n.place - back AND s.place + s.words > n.place - back) AS negated FROM n
WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.id = n.id AND s.scheme = n.scheme AND s.words > n.words AND s.place <= n.place AND s.place + s.words >= n.place + n.words)"""


@query(_phrases_sql("SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations"))
def phrase_rules(spark, sf):
    """The rules of all tables over every document and turn."""
    d = read(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    c = read(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("id"), "text")
    return phrases.find_phrases(d.unionByName(c), phrases.phrase_rules(spark, SCHEMES))


def _reports(spark, sf) -> DataFrame:
    """(id, text): for each order a report of one sentence a line item."""
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey")
    said = F.array(*[F.lit(s) for s in SENTENCES])[((F.col("l_partkey") * 7 + F.col("l_suppkey")) % len(SENTENCES)).cast("int")]
    parts = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", said.alias("s"))))
    return lines.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), " ").alias("text"))


_SAID = ", ".join("'" + s.replace("'", "''") + "'" for s in SENTENCES)
_REPORTS = f"SELECT l_orderkey AS id, string_agg([{_SAID}][(l_partkey * 7 + l_suppkey) % {len(SENTENCES)} + 1], ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS text FROM lineitem GROUP BY l_orderkey"


@query(f"""WITH hits AS ({_phrases_sql(_REPORTS)}), f AS (SELECT id, scheme, code, min(place) AS place FROM hits WHERE NOT negated GROUP BY 1, 2, 3)
SELECT id, scheme, string_agg(code, '; ' ORDER BY place, code) AS codes FROM f GROUP BY 1, 2""")
def phrase_reports(spark, sf):
    """The codes of both levels in reports rendered from line items."""
    codes = phrases.phrase_codes(phrases.find_phrases(_reports(spark, sf), phrases.phrase_rules(spark, SCHEMES)))
    return codes.select("id", "scheme", F.array_join("codes", "; ").alias("codes"))


# --- answers ------------------------------------------------------------------------------

CATEGORIES = ("Human", "Environment", "Equipment", "Material", "Technology", "Management")
TALK, AFTER = "Here is the answer:\n```json\n", "\n```\nAnything else?"
MIXED = '{"Human": 7, "Equipment": "Brand#9", "Material": ["x", 3, null, true, {"a": [1]}, ["b"], "x"], "Technology": {"b": []}, '


def _rows(spark, sf, key: str, *columns: str) -> DataFrame:
    """One row for each ``key`` with its line items in order, as ``rows``."""
    return _branded(spark, sf).groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_orderkey", *LINE_ORDER, *columns))).alias("rows"))


def _answers(spark, sf) -> DataFrame:
    """(id, answer): for each order an object from category to brands; whole, fenced, in talk, cut, mixed or missing by the order's number."""
    lists = _rows(spark, sf, "l_orderkey", "p_brand", "p_type")
    of = lambda t: F.array_join(F.transform(F.filter("rows", lambda r: r["p_type"] == t), lambda r: F.concat(F.lit('"'), r["p_brand"], F.lit('"'))), ", ")
    fields = [F.concat(F.lit(f'"{c}": ['), of(t), F.lit("]")) for c, t in zip(CATEGORIES, TYPES, strict=True)]
    body = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    kind = F.col("id") % 6
    answer = (
        F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit(TALK), body, F.lit(AFTER)))
        .when(kind == 3, F.substr(body, F.lit(1), F.length(body) - 8)).when(kind == 4, F.concat(F.lit(MIXED), fields[1], F.lit(', "Management": []}')))
    )
    return lists.select("id", answer.alias("answer"))


_FIELDS = [f"'\"{c}\": [' || array_to_string(list_transform(list_filter(rows, lambda r: r.p_type = '{t}'), lambda r: '\"' || r.p_brand || '\"'), ', ') || ']'" for c, t in zip(CATEGORIES, TYPES, strict=True)]
_ROWS = "list({" + ", ".join(f"'{c}': {c}" for c in ("l_orderkey", *LINE_ORDER, "p_brand", "p_type", "p_name")) + "} ORDER BY " + ", ".join(("l_orderkey", *LINE_ORDER)) + ")"


def _chars(text: str) -> str:
    """A text as an SQL literal."""
    return "('" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "')"


_BODY = f"""SELECT id, rows, '{{' || {" || ', ' || ".join(_FIELDS)} || '}}' AS body FROM (SELECT l_orderkey AS id, {_ROWS} AS rows FROM ({_BRANDED}) GROUP BY 1)"""
_ANSWERS = f"""SELECT id, CASE id % 6 WHEN 0 THEN body WHEN 1 THEN {_chars("```json" + chr(10))} || body || {_chars(chr(10) + "```")} WHEN 2 THEN {_chars(TALK)} || body || {_chars(AFTER)} WHEN 3 THEN substr(body, 1, length(body) - 8)
WHEN 4 THEN {_chars(MIXED)} || {_FIELDS[1]} || ', "Management": []}}' END AS answer FROM ({_BODY})"""
_LABELS = f"""
WITH a AS ({_ANSWERS}), j AS (SELECT id, CASE WHEN json_valid(b) THEN b END AS j FROM (SELECT id, regexp_extract(answer, '[{{].*[}}]', 0, 's') AS b FROM a)),
k AS (SELECT id, j, unnest(json_keys(j)) AS c, unnest(range(len(json_keys(j)))) AS pos FROM j WHERE j IS NOT NULL), v AS (SELECT id, c, pos, json_extract(j, '$.' || c) AS v FROM k),
e AS (SELECT id, c, pos, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN CAST(v AS JSON[]) ELSE [v] END) AS x, unnest(range(CASE WHEN json_type(v) = 'ARRAY' THEN CAST(json_array_length(v) AS BIGINT) ELSE 1 END)) AS at_ FROM v),
l AS (SELECT id, c, pos, at_, json_extract_string(x, '$') AS label FROM e WHERE json_type(x) NOT IN ('OBJECT', 'ARRAY', 'NULL')),
f AS (SELECT id, label, min(pos * 1000 + at_) AS o FROM l GROUP BY 1, 2), fs AS (SELECT id, string_agg(label, '; ' ORDER BY o) AS factors FROM f GROUP BY 1), cs AS (SELECT id, string_agg(c, '; ' ORDER BY pos) AS categories FROM (SELECT DISTINCT id, c, pos FROM l) GROUP BY 1)
SELECT a.id, coalesce(factors, '') AS factors, coalesce(categories, '') AS categories FROM a LEFT JOIN fs ON a.id = fs.id LEFT JOIN cs ON a.id = cs.id"""


@query(_LABELS)
def answer_labels(spark, sf):
    """Factors and categories of whole, fenced, mixed and broken answers."""
    flat = answers.flatten_labels(_answers(spark, sf))
    return flat.select("id", F.array_join("factors", "; ").alias("factors"), F.array_join("categories", "; ").alias("categories"))


WHITELIST = ["bolt", "gear", "gizmo"]


def _extractions(spark, sf) -> DataFrame:
    """(id, answer): for each supplier a list of triples, some of them of a wrong type, fenced or cut by the supplier's number."""
    lists = _rows(spark, sf, "l_suppkey", "p_brand", "p_type", "p_name")
    even = lambda r: r["l_linenumber"] % 2 == 0
    one = lambda r: F.concat(
        F.lit('{"head": "'), r["p_name"], F.when(even(r), F.lit('", "head_type": "QUALITY_DEFECT", "relation": "CAUSED_BY", "tail": ')).otherwise(F.lit('", "head_type": "MATERIAL_FACTOR", "relation": "LEADS_TO", "tail": ')),
        F.when(r["l_partkey"] % 11 == 0, F.lit("null")).when(r["l_partkey"] % 7 == 0, F.lit('["list"]')).when(r["l_partkey"] % 5 == 0, r["l_partkey"].cast("string")).otherwise(F.concat(F.lit('"'), r["p_type"], F.lit('"'))), F.lit(', "tail_type": "PROCESS_FACTOR"}'),
    )
    entry = lambda r: F.when(r["l_partkey"] % 13 == 0, F.lit('"no object"')).otherwise(one(r))
    body = F.concat(F.lit("["), F.array_join(F.transform("rows", entry), ", "), F.lit("]"))
    kind = F.col("id") % 4
    answer = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("The triples are: "), body, F.lit(" as asked."))).otherwise(F.substr(body, F.lit(1), F.length(body) - 2))
    return lists.select("id", answer.alias("answer"))


_ENTRY = """CASE WHEN r.l_partkey % 13 = 0 THEN '"no object"' ELSE '{"head": "' || r.p_name || CASE WHEN r.l_linenumber % 2 = 0 THEN '", "head_type": "QUALITY_DEFECT", "relation": "CAUSED_BY", "tail": ' ELSE '", "head_type": "MATERIAL_FACTOR", "relation": "LEADS_TO", "tail": ' END
|| CASE WHEN r.l_partkey % 11 = 0 THEN 'null' WHEN r.l_partkey % 7 = 0 THEN '["list"]' WHEN r.l_partkey % 5 = 0 THEN CAST(r.l_partkey AS VARCHAR) ELSE '"' || r.p_type || '"' END || ', "tail_type": "PROCESS_FACTOR"}' END"""
_TRIPLES = f"""
WITH b AS (SELECT l_suppkey AS id, {_ROWS} AS rows FROM ({_BRANDED}) GROUP BY 1), t AS (SELECT id, '[' || array_to_string(list_transform(rows, lambda r: {_ENTRY}), ', ') || ']' AS body FROM b),
a AS (SELECT id, CASE id % 4 WHEN 0 THEN body WHEN 1 THEN {_chars("```json" + chr(10))} || body || {_chars(chr(10) + "```")} WHEN 2 THEN 'The triples are: ' || body || ' as asked.' ELSE substr(body, 1, length(body) - 2) END AS answer FROM t),
j AS (SELECT id, CASE WHEN json_valid(c) THEN c END AS j FROM (SELECT id, regexp_extract(answer, '[[].*[]]', 0, 's') AS c FROM a)), o AS (SELECT id, list_filter(CAST(j AS JSON[]), lambda x: json_type(x) = 'OBJECT')[:20] AS xs FROM j WHERE j IS NOT NULL),
x AS (SELECT id, unnest(xs) AS x, unnest(range(len(xs))) AS pos FROM o),
p AS (SELECT id, pos, x->>'$.head' AS head, x->>'$.head_type' AS head_type, x->>'$.relation' AS relation, CASE WHEN json_type(x, '$.tail') NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN x->>'$.tail' END AS tail, x->>'$.tail_type' AS tail_type FROM x),
c AS (SELECT id, pos, CASE WHEN head_type <> 'QUALITY_DEFECT' THEN head WHEN contains(head, 'bolt') THEN 'bolt' WHEN contains(head, 'gear') THEN 'gear' WHEN contains(head, 'gizmo') THEN 'gizmo' END AS head, head_type, relation, tail, tail_type FROM p WHERE head <> '' AND tail <> '' AND head <> tail)
SELECT id, CAST(pos AS INT) AS pos, head, head_type, relation, tail, tail_type FROM c WHERE head IS NOT NULL"""


@query(_TRIPLES)
def answer_triples(spark, sf):
    """Clean triples of whole, fenced, mixed and broken answers, twenty of each at most."""
    return graph.clean_triplets(answers.triplets(_extractions(spark, sf)), WHITELIST)
