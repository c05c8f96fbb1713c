"""The engine's queries over the test tables, and the same in DuckDB's SQL.

Cases are orders; a part's type (six, in alphabetical order) stands for a main factor and its
brand number for a sub-factor (1 to 17; the others are unknown labels). Events of a user in
time order are the edges of a cause graph; paths are searched over all its edges. Only
``edge_prune_topk`` cuts a graph to the ``SUCCESSORS`` strongest targets of each node, as that
is the operator it shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.taxonomy import MAIN, SUB, Taxonomy
from ..operators import classify, coupling, describe, encode, graph, scoring, transitions
from ..operators.stored import stored

# The six part types in alphabetical order.
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
MAIN_BY_TYPE = Taxonomy(tuple(c for c, _ in MAIN), tuple(zip(TYPES, (c for c, _ in MAIN), strict=True)))
SUB_BY_BRAND = Taxonomy(tuple(c for c, _ in SUB), tuple((f"Brand#{i + 1}", c) for i, (c, _) in enumerate(SUB)))
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
SUCCESSORS = 3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- text ---------------------------------------------------------------------------------

_BLOBS = "SELECT o_custkey AS doc_id, 'preamble' || string_agg('Case ' || o_orderkey || ' status ' || o_orderstatus || chr(10), '' ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey"


def _blobs(spark: SparkSession, sf: str, lead: str, mid, tail: str) -> DataFrame:
    """One text for each customer, rendered of their orders."""
    parts = F.sort_array(F.collect_list(F.struct("o_orderkey", mid.alias("x"))))
    return read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit(lead), F.array_join(F.transform(parts, lambda p: p["x"]), tail)).alias("text"))


@query(f"""
WITH b AS ({_BLOBS}), s AS (SELECT doc_id, string_split(text, 'Case') AS parts FROM b),
e AS (SELECT doc_id, unnest(range(len(parts))) AS seg_no, parts FROM s), t AS (SELECT doc_id, seg_no, trim(parts[seg_no + 1], ' ' || chr(10)) AS segment FROM e)
SELECT doc_id, CAST(seg_no AS INT) AS seg_no, 'Case' || segment AS segment FROM t WHERE regexp_matches(segment, '^[0-9]')
""")
def case_segments(spark, sf):
    line = F.concat(F.lit("Case "), F.col("o_orderkey").cast("string"), F.lit(" status "), F.col("o_orderstatus"), F.lit("\n"))
    return tx.split_cases(_blobs(spark, sf, "preamble", line, ""))


@query("""
WITH b AS (SELECT o_custkey AS doc_id, string_agg('order ' || o_orderkey || ' of ' || o_orderpriority, chr(10) || '##########' || chr(10) || chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey),
s AS (SELECT doc_id, regexp_split_to_array(text, '\\s*#{10}\\s*') AS parts FROM b), e AS (SELECT doc_id, unnest(range(len(parts))) AS seg_no, parts FROM s)
SELECT doc_id, CAST(seg_no AS INT) AS seg_no, trim(parts[seg_no + 1]) AS segment FROM e WHERE trim(parts[seg_no + 1]) <> ''
""".replace("\\\\", "\\"))
def hash_split(spark, sf):
    line = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.col("o_orderpriority"))
    return tx.split_hashes(_blobs(spark, sf, "", line, "\n##########\n\n"))


@query(r"""
WITH b AS (SELECT o_orderkey, '1. Occurrence Time: ' || CAST(year(o_orderdate) AS VARCHAR) || '  ' || CAST(month(o_orderdate) AS VARCHAR) || chr(10) || '2. Occurrence Stage：' || o_orderstatus || chr(10) || '3. Problem Phenomenon:' || chr(9) || o_orderpriority || ' ' || chr(10) || '4. Root Cause Analysis : by ' || o_custkey || chr(10) || ' end' AS t FROM orders),
x AS (SELECT o_orderkey, regexp_extract(t, '1\. Occurrence Time[\s:：]+(.*?)2\. Occurrence Stage', 1, 's') AS a, regexp_extract(t, '2\. Occurrence Stage[\s:：]+(.*?)3\. Problem Phenomenon', 1, 's') AS b, regexp_extract(t, '3\. Problem Phenomenon[\s:：]+(.*?)4\. Root Cause Analysis', 1, 's') AS c, regexp_extract(t, '4\. Root Cause Analysis[\s:：]+(.*)', 1, 's') AS d FROM b)
SELECT o_orderkey, trim(regexp_replace(a, '\s+', ' ', 'g')) AS occurrence_time, trim(regexp_replace(b, '\s+', ' ', 'g')) AS occurrence_stage, trim(regexp_replace(c, '\s+', ' ', 'g')) AS problem_phenomenon, trim(regexp_replace(d, '\s+', ' ', 'g')) AS root_cause FROM x
""")
def section_extract(spark, sf):
    o = read(spark, sf, "orders")
    text = F.concat(
        F.lit("1. Occurrence Time: "), F.year("o_orderdate").cast("string"), F.lit("  "), F.month("o_orderdate").cast("string"), F.lit("\n2. Occurrence Stage："), F.col("o_orderstatus"),
        F.lit("\n3. Problem Phenomenon:\t"), F.col("o_orderpriority"), F.lit(" \n4. Root Cause Analysis : by "), F.col("o_custkey").cast("string"), F.lit("\n end"),
    )
    return tx.extract_sections(o.select("o_orderkey", text.alias("segment"))).drop("segment")


@query(r"SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title FROM pages")
def html_section(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


@query(r"SELECT doc_id, CAST(length(c) AS BIGINT) AS chars, md5(c) AS digest FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS c FROM documents)")
def clean_text(spark, sf):
    c = read(spark, sf, "documents").select("doc_id", tx.normalize_space(F.col("text")).alias("c"))
    return c.select("doc_id", F.length("c").cast("bigint").alias("chars"), F.md5(F.col("c").cast("binary")).alias("digest"))


_BRANDED = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, p_brand, p_type, p_name FROM lineitem JOIN part ON l_partkey = p_partkey"


def _branded(spark, sf) -> DataFrame:
    """Line items with the part's columns; Catalyst broadcasts parts while they are small."""
    part = read(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    lines = read(spark, sf, "lineitem").select("l_orderkey", *LINE_ORDER)
    return lines.join(part, lines["l_partkey"] == part["p_partkey"]).drop("p_partkey")


def _order_lists(spark, sf) -> DataFrame:
    """(l_orderkey, brands): each order's brands in line order."""
    rows = F.sort_array(F.collect_list(F.struct(*LINE_ORDER, "p_brand")))
    return _branded(spark, sf).groupBy("l_orderkey").agg(F.transform(rows, lambda r: r["p_brand"]).alias("brands"))


_LISTS = f"SELECT l_orderkey, list(p_brand ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS brands FROM ({_BRANDED}) GROUP BY l_orderkey"


@query(f"""
WITH b AS (SELECT l_orderkey, array_to_string(brands, ' ； ') || ';;' AS t FROM ({_LISTS}))
SELECT l_orderkey, array_to_string(list_filter(list_transform(string_split(replace(t, '；', ';'), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS labels FROM b
""")
def delim_split(spark, sf):
    rendered = F.concat(F.array_join("brands", " ； "), F.lit(";;"))
    return _order_lists(spark, sf).select("l_orderkey", F.array_join(tx.split_labels(rendered), "|").alias("labels"))


@query(f"""
WITH b AS ({_LISTS}), u AS (SELECT l_orderkey, unnest(range(len(brands))) AS k, brands FROM b), f AS (SELECT l_orderkey, brands[k + 1] AS x, min(k) AS k FROM u GROUP BY 1, 2)
SELECT l_orderkey, string_agg(x, '; ' ORDER BY k) AS labels, CAST(count(*) AS INT) AS n FROM f GROUP BY l_orderkey
""")
def ordered_distinct(spark, sf):
    d = _order_lists(spark, sf).select("l_orderkey", tx.ordered_distinct(F.col("brands")).alias("d"))
    return d.select("l_orderkey", F.array_join("d", "; ").alias("labels"), F.size("d").alias("n"))


@query(f"SELECT l_orderkey, nullif(string_split(CASE WHEN brands[1] = 'Brand#1' THEN ';x' ELSE array_to_string(brands, ';') END, ';')[1], '') AS label FROM ({_LISTS})")
def first_label(spark, sf):
    text = F.when(F.col("brands")[0] == "Brand#1", F.lit(";x")).otherwise(F.array_join("brands", ";"))
    return _order_lists(spark, sf).select("l_orderkey", tx.first_label(text).alias("label"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 10 = 0 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS INT) AS k FROM events")
def json_field(spark, sf):
    e = read(spark, sf, "events")
    cut = F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))  # broken on purpose
    return e.select("event_id", F.coalesce(F.from_json(cut, "k int")["k"], F.lit(-1)).alias("k"))


# --- classification -----------------------------------------------------------------------

# Words of the test texts stand in for the domain's keywords.
RULES = {"HU": ("the", "person"), "EN": ("rain", "ñ"), "EQ": ("ß", "tool"), "MA": ("é",), "TE": ("tion",), "MG": ("idiot", "token")}
_HITS = ", ".join(f"CASE WHEN {' OR '.join(f'contains(low, {w!r})' for w in ws)} THEN {c!r} END" for c, ws in RULES.items())


@query(f"""
WITH t AS (SELECT 'd' || doc_id AS id, lower(text) AS low FROM documents UNION ALL SELECT 'c' || conv_id || '.' || turn, lower(text) FROM conversations)
SELECT id, array_to_string(list_filter([{_HITS}], lambda x: x IS NOT NULL), '; ') AS codes FROM t
""")
def keyword_classify(spark, sf):
    d = read(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    c = read(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("id"), "text")
    return d.unionByName(c).select("id", F.array_join(classify.keyword_codes(F.col("text"), RULES), "; ").alias("codes"))


CLASSES = {"click": "H1", "error": "EQ1", "purchase": "MG1", "signup": None, "view": "H1"}
_CLASSES = "(VALUES " + ", ".join(f"('{n}', {'NULL' if c is None else repr(c)})" for n, c in CLASSES.items()) + ") AS k(name, cls)"
_STEPS = "SELECT user_id, event_type AS head, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS tail FROM events"
_EDGES = f"SELECT head AS source, tail AS target, count(*) AS cnt FROM ({_STEPS}) WHERE tail IS NOT NULL GROUP BY 1, 2"


def _classes(spark) -> DataFrame:
    return spark.createDataFrame(list(CLASSES.items()), "name string, cls string")


def _event_edges(spark, sf) -> DataFrame:
    """(head, tail) of each user's consecutive events."""
    w = Window.partitionBy("user_id").orderBy("ts")
    return read(spark, sf, "events").select(F.col("event_type").alias("head"), F.lead("event_type").over(w).alias("tail")).filter("tail IS NOT NULL")


@query(f"""
SELECT source, target, CAST(cnt AS BIGINT) AS cnt, a.cls AS source_class, b.cls AS target_class, CASE WHEN a.cls IS NOT NULL AND b.cls IS NOT NULL THEN 'Success' ELSE 'Skipped' END AS status
FROM ({_EDGES}) e LEFT JOIN {_CLASSES.replace('AS k', 'AS a')} ON a.name = source LEFT JOIN {_CLASSES.replace('AS k', 'AS b')} ON b.name = target
""")
def classification_log(spark, sf):
    return classify.classification_log(transitions.edge_counts(_event_edges(spark, sf), None), _classes(spark))


# --- graph cleaning -----------------------------------------------------------------------

NOUNS = ["bolt", "gear", "gizmo"]


def _triplets(spark, sf) -> DataFrame:
    b = _branded(spark, sf)
    even = F.col("l_linenumber") % 2 == 0
    return b.select(
        F.col("l_orderkey").alias("case_id"), F.col("p_name").alias("head"), F.when(even, graph.DEFECT).otherwise("MATERIAL_FACTOR").alias("head_type"),
        F.when(F.col("l_linenumber") % 3 == 0, "CAUSED_BY").otherwise("LEADS_TO").alias("relation"), F.when(F.col("l_suppkey") % 5 == 0, F.col("p_name")).when(F.col("l_suppkey") % 7 == 0, "").otherwise(F.col("p_type")).alias("tail"), F.lit("PROCESS_FACTOR").alias("tail_type"),
    )


_TRIPLETS = f"""
SELECT l_orderkey AS case_id, p_name AS head, CASE WHEN l_linenumber % 2 = 0 THEN 'QUALITY_DEFECT' ELSE 'MATERIAL_FACTOR' END AS head_type, CASE WHEN l_linenumber % 3 = 0 THEN 'CAUSED_BY' ELSE 'LEADS_TO' END AS relation,
CASE WHEN l_suppkey % 5 = 0 THEN p_name WHEN l_suppkey % 7 = 0 THEN '' ELSE p_type END AS tail, 'PROCESS_FACTOR' AS tail_type FROM ({_BRANDED})"""
_CLEAN = f"""
SELECT case_id, CASE WHEN head_type <> 'QUALITY_DEFECT' THEN head WHEN contains(head, 'bolt') THEN 'bolt' WHEN contains(head, 'gear') THEN 'gear' WHEN contains(head, 'gizmo') THEN 'gizmo' END AS h, head_type, relation, tail, tail_type
FROM ({_TRIPLETS}) WHERE head <> '' AND tail <> '' AND head <> tail"""


@query(f"SELECT h AS head, head_type, relation, tail, CAST(count(*) AS BIGINT) AS n FROM ({_CLEAN}) WHERE h IS NOT NULL GROUP BY 1, 2, 3, 4")
def triplet_clean(spark, sf):
    return graph.clean_triplets(_triplets(spark, sf), NOUNS).groupBy("head", "head_type", "relation", "tail").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT head_type, relation, CAST(count(*) AS BIGINT) AS n FROM ({_TRIPLETS}) WHERE (head_type = 'QUALITY_DEFECT' AND relation IN ('CAUSED_BY', 'OCCURS_IN')) OR (head_type = 'MATERIAL_FACTOR' AND relation IN ('LEADS_TO', 'BELONGS_TO')) GROUP BY 1, 2")
def schema_check(spark, sf):
    return graph.enforce_schema(_triplets(spark, sf), graph.relation_schema(spark)).groupBy("head_type", "relation").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT h AS name, head_type AS type FROM ({_CLEAN}) WHERE h IS NOT NULL UNION SELECT DISTINCT tail, tail_type FROM ({_CLEAN}) WHERE h IS NOT NULL")
def graph_nodes(spark, sf):
    return graph.nodes(graph.clean_triplets(_triplets(spark, sf), NOUNS))


# --- encoding -----------------------------------------------------------------------------


def _labels(spark, sf, column: str) -> DataFrame:
    return _branded(spark, sf).select(F.col("l_orderkey").alias("case_id"), F.col(column).alias("label"))


def _masks(spark, sf, taxonomy: Taxonomy) -> DataFrame:
    return encode.masks_of_labelled(_labels(spark, sf, "p_type" if taxonomy is MAIN_BY_TYPE else "p_brand"), taxonomy)


_MAIN_FLAGS = ", ".join(f"CAST(max(CASE WHEN p_type = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{c}\"" for t, c in MAIN_BY_TYPE.names)
_SUB_FLAGS = ", ".join(f"CAST(max(CASE WHEN p_brand = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{c}\"" for t, c in SUB_BY_BRAND.names)
_MAIN_WIDE = f"SELECT l_orderkey AS case_id, {_MAIN_FLAGS} FROM ({_BRANDED}) GROUP BY 1"
_SUB_WIDE = f"SELECT l_orderkey AS case_id, {_SUB_FLAGS} FROM ({_BRANDED}) GROUP BY 1"


@query(_MAIN_WIDE)
def multi_hot_main(spark, sf):
    return encode.multi_hot(_masks(spark, sf, MAIN_BY_TYPE), MAIN_BY_TYPE)


@query(_SUB_WIDE)
def multi_hot_sub(spark, sf):
    return encode.multi_hot(_masks(spark, sf, SUB_BY_BRAND), SUB_BY_BRAND)


_CODE = "CASE " + " ".join(f"WHEN x = '{n}' THEN '{c}'" for n, c in SUB_BY_BRAND.names) + " END"


@query(f"SELECT l_orderkey, array_to_string(list_filter(list_transform(brands, lambda x: {_CODE}), lambda x: x IS NOT NULL), ' ') AS codes FROM ({_LISTS})")
def factor_codes(spark, sf):
    return _order_lists(spark, sf).select("l_orderkey", encode.factor_codes(F.col("brands"), SUB_BY_BRAND).alias("codes"))


@query(f"SELECT l_orderkey, array_to_string(list_transform(brands, lambda x: coalesce({_CODE}, 'UNK')), ' ') AS codes FROM ({_LISTS})")
def path_codes(spark, sf):
    return _order_lists(spark, sf).select("l_orderkey", encode.path_codes(F.col("brands"), SUB_BY_BRAND).alias("codes"))


# --- coupling -----------------------------------------------------------------------------

_MAIN_MASK = "SELECT case_id, " + " + ".join(f'"{c}" * {1 << k}' for k, c in enumerate(MAIN_BY_TYPE.codes)) + f" AS mask FROM ({_MAIN_WIDE})"
_SUB_MASK = "SELECT case_id, " + " + ".join(f'"{c}" * {1 << k}' for k, c in enumerate(SUB_BY_BRAND.codes)) + f" AS mask FROM ({_SUB_WIDE})"


def _coupling_sql(mask: str, size: int, where: str) -> str:
    codes = (MAIN_BY_TYPE if size == 6 else SUB_BY_BRAND).codes
    names = ", ".join(f"CASE WHEN subset & {1 << k} <> 0 THEN '{c}' END" for k, c in enumerate(codes))
    eps = coupling.MAIN_EPS if size == 6 else coupling.SUB_EPS
    return f"""
WITH m AS ({mask}), st AS (SELECT mask, count(*) AS n FROM m GROUP BY mask), tot AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM st),
b AS (SELECT range AS k FROM range({size})), m1 AS (SELECT k, sum(CASE WHEN mask & (1 << k) <> 0 THEN n ELSE 0 END) AS n1 FROM st, b GROUP BY k),
ss AS (SELECT range AS subset FROM range(1, {1 << size}) WHERE {where}),
j AS (SELECT subset, mask & subset AS state, CAST(sum(n) AS DOUBLE) AS n FROM st, ss GROUP BY 1, 2),
q AS (SELECT subset, state, n, product(CASE WHEN state & (1 << k) <> 0 THEN n1 / total ELSE (total - n1) / total END) AS q FROM j, m1, tot WHERE subset & (1 << k) <> 0 GROUP BY 1, 2, 3),
t AS (SELECT subset, sum(CASE WHEN n / total > {eps} AND q > {eps} THEN n / total * log2(n / total / q) ELSE 0 END) AS t FROM q, tot GROUP BY subset)
SELECT CAST(bit_count(subset) AS INT) AS "order", array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS factors, round(t, 9) + 0.0 AS t_value FROM t"""


def _shown(couplings: DataFrame) -> DataFrame:
    return couplings.select("order", F.array_join("factors", ",").alias("factors"), (F.round("t_value", 9) + 0.0).alias("t_value"))


@query(f"""
WITH m AS ({_MAIN_MASK}), s AS (SELECT mask, count(*) AS n FROM m GROUP BY mask), a AS (SELECT range AS mask FROM range(64))
SELECT reverse(lpad(bin(a.mask), 6, '0')) AS code, a.mask, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) / CAST((SELECT count(*) FROM m) AS DOUBLE), 9) AS p FROM a LEFT JOIN s ON a.mask = s.mask
""")
def joint_distribution(spark, sf):
    return rounded(coupling.joint_distribution(coupling.states(_masks(spark, sf, MAIN_BY_TYPE)), 6), "p")


_MARGINALS = " UNION ALL ".join(f"SELECT '{c}' AS factor, CAST({s} AS BIGINT) AS state, round(avg(CASE WHEN \"{c}\" = {s} THEN 1.0 ELSE 0.0 END), 9) AS p FROM w" for c in MAIN_BY_TYPE.codes for s in (0, 1))


@query(f"WITH w AS ({_MAIN_WIDE}) {_MARGINALS}")
def marginals(spark, sf):
    return rounded(coupling.marginals(coupling.states(_masks(spark, sf, MAIN_BY_TYPE)), MAIN_BY_TYPE), "p")


@query(_coupling_sql(_MAIN_MASK, 6, "true"))
def coupling_main(spark, sf):
    return _shown(coupling.main_couplings(coupling.states(_masks(spark, sf, MAIN_BY_TYPE)), MAIN_BY_TYPE))


_SUB_SQL = _coupling_sql(_SUB_MASK, 17, "bit_count(range) IN (2, 3)")


def _sub(spark, sf) -> DataFrame:
    return coupling.sub_couplings(coupling.states(_masks(spark, sf, SUB_BY_BRAND)), SUB_BY_BRAND)


@query(f"SELECT * FROM ({_SUB_SQL}) WHERE t_value > 0.000001")
def coupling_sub(spark, sf):
    return _shown(_sub(spark, sf))


@query(f'SELECT * FROM ({_SUB_SQL}) WHERE t_value > 0.000001 ORDER BY t_value DESC, "order", factors LIMIT 20')
def coupling_top20(spark, sf):
    return coupling.ranked(_shown(_sub(spark, sf)), 20)


@query(_coupling_sql(_SUB_MASK, 17, "bit_count(range) BETWEEN 2 AND 6"))
def coupling_orders(spark, sf):
    """All 21,760 subsets of two to six of the 17 sub-factors."""
    return _shown(coupling.couplings(coupling.states(_masks(spark, sf, SUB_BY_BRAND)), SUB_BY_BRAND, (2, 3, 4, 5, 6), coupling.SUB_EPS))


# --- transitions and paths ----------------------------------------------------------------


@query(f"SELECT source, target, CAST(cnt AS BIGINT) AS cnt FROM ({_EDGES})")
def edge_counts(spark, sf):
    return transitions.edge_counts(_event_edges(spark, sf), None)


_FREQUENCY = f"SELECT a.cls AS s, b.cls AS t, sum(cnt) AS cnt FROM ({_EDGES}) JOIN {_CLASSES.replace('AS k', 'AS a')} ON a.name = source JOIN {_CLASSES.replace('AS k', 'AS b')} ON b.name = target WHERE a.cls IS NOT NULL AND b.cls IS NOT NULL GROUP BY 1, 2"


@query(f"SELECT s, t, CAST(cnt AS BIGINT) AS cnt FROM ({_FREQUENCY})")
def edge_freq_classified(spark, sf):
    return transitions.classified_frequency(transitions.edge_counts(_event_edges(spark, sf), None), _classes(spark))


def _event_frequency(spark, sf) -> DataFrame:
    return transitions.edge_counts(_event_edges(spark, sf), None).toDF("s", "t", "cnt")


@query(f"SELECT source AS s, target AS t, CAST(cnt AS BIGINT) AS cnt, round(cnt / CAST(sum(cnt) OVER (PARTITION BY source) AS DOUBLE), 9) AS p FROM ({_EDGES})")
def transition_prob(spark, sf):
    return rounded(transitions.transition_probabilities(_event_frequency(spark, sf)), "p")


_BRAND_STEPS = f"SELECT p_brand AS s, lead(p_brand) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS t FROM ({_BRANDED})"
_BRAND_EDGES = f"SELECT s, t, count(*) AS cnt FROM ({_BRAND_STEPS}) WHERE t IS NOT NULL GROUP BY 1, 2"


def _brand_frequency(spark, sf) -> DataFrame:
    """(s, t, cnt) of consecutive brands of an order; of the same shuffle by order as ``_listed_masks``."""
    after = F.slice("brands", F.lit(2), F.size("brands"))
    pairs = F.zip_with(F.slice("brands", F.lit(1), F.size("brands") - 1), after, lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    steps = _order_lists(spark, sf).select(F.explode(pairs).alias("p")).select("p.s", "p.t")
    return steps.groupBy("s", "t").agg(F.count(F.lit(1)).alias("cnt"))


def _listed_masks(spark, sf) -> DataFrame:
    return _order_lists(spark, sf).select(F.col("l_orderkey").alias("case_id"), encode.mask_of_list(F.col("brands"), SUB_BY_BRAND).alias("mask"))


def _top(edges: str) -> str:
    return f"SELECT s, t, cnt FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY cnt DESC, t) AS r FROM ({edges})) WHERE r <= {SUCCESSORS}"


_EVENT_EDGES = f"SELECT source AS s, target AS t, cnt FROM ({_EDGES})"
_EVENT_TOP, _BRAND_TOP = _top(_EVENT_EDGES), _top(_BRAND_EDGES)


@query(f"SELECT 'event' AS graph, s, t, CAST(cnt AS BIGINT) AS cnt FROM ({_EVENT_TOP}) UNION ALL SELECT 'brand', s, t, CAST(cnt AS BIGINT) FROM ({_BRAND_TOP})")
def edge_prune_topk(spark, sf):
    one = transitions.strongest_successors(_event_frequency(spark, sf), SUCCESSORS).select(F.lit("event").alias("graph"), "s", "t", "cnt")
    return one.unionByName(transitions.strongest_successors(_brand_frequency(spark, sf), SUCCESSORS).select(F.lit("brand").alias("graph"), "s", "t", "cnt"))


def _paths_sql(edges: str) -> str:
    """All simple paths of up to four edges, by recursion."""
    return f"""
WITH RECURSIVE e AS (SELECT s, t, cnt / CAST(sum(cnt) OVER (PARTITION BY s) AS DOUBLE) AS p FROM ({edges})),
w(nodes, last, prob) AS (SELECT [s, t], t, p FROM e WHERE s <> t UNION ALL SELECT list_append(nodes, e.t), e.t, prob * e.p FROM w JOIN e ON w.last = e.s WHERE NOT list_contains(nodes, e.t) AND len(nodes) < 5)"""


_BEST = "best AS (SELECT nodes[1] AS start_node, last, min({'minus': -prob, 'n': len(nodes), 'path': array_to_string(nodes, ' -> '), 'nodes': nodes}) AS b FROM w WHERE last IN (SELECT s FROM e) GROUP BY 1, 2)"
_BEST_ROWS = "SELECT start_node, last AS end_node, b.path AS max_path, round(-b.minus, 9) AS prob FROM best"


@query(f"{_paths_sql(_EVENT_EDGES)} SELECT array_to_string(nodes, ' -> ') AS path, round(prob, 9) AS prob FROM w")
def path_enumerate(spark, sf):
    paths = transitions.simple_paths(transitions.transition_probabilities(_event_frequency(spark, sf)))
    return paths.select(F.array_join("nodes", " -> ").alias("path"), F.round("prob", 9).alias("prob"))


def _best(spark, sf) -> DataFrame:
    return transitions.best_paths(transitions.transition_probabilities(_brand_frequency(spark, sf)))


@query(f"{_paths_sql(_EVENT_EDGES)}, {_BEST} {_BEST_ROWS}")
def best_paths(spark, sf):
    best = transitions.best_paths(transitions.transition_probabilities(_event_frequency(spark, sf)))
    return rounded(best.drop("nodes"), "prob")


@query(f"{_paths_sql(_BRAND_EDGES)}, {_BEST} {_BEST_ROWS}")
def best_paths_brand(spark, sf):
    return rounded(_best(spark, sf).drop("nodes"), "prob")


@query(f"{_paths_sql(_BRAND_EDGES)}, {_BEST} SELECT b.path AS max_path, round(-b.minus, 9) AS prob FROM best ORDER BY round(-b.minus, 12) DESC, b.n, b.path LIMIT 5")
def top5_paths(spark, sf):
    best = _best(spark, sf).withColumn("prob", F.round("prob", 12))
    return transitions.top_paths(best).select("max_path", F.round("prob", 9).alias("prob"))


# --- scores -------------------------------------------------------------------------------


def _risks(spark, sf) -> DataFrame:
    paths = _best(spark, sf).select(F.transform("nodes", lambda x: F.coalesce(SUB_BY_BRAND.code_map()[x], F.lit("UNK"))).alias("codes"), "prob")
    couplings = coupling.sub_couplings(coupling.states(_listed_masks(spark, sf)), SUB_BY_BRAND)
    return scoring.join_risks(couplings.withColumn("t_value", F.round("t_value", 12)), paths.withColumn("prob", F.round("prob", 12)))


_RISKS = f"""{_paths_sql(_BRAND_EDGES)}, {_BEST},
pc AS (SELECT list_transform(b.nodes, lambda x: coalesce({_CODE}, 'UNK')) AS codes, round(-b.minus, 12) AS prob FROM best WHERE b.n IN (2, 3)),
cp AS ({_SUB_SQL.replace("round(t, 9) + 0.0", "round(t, 12)")}),
risks AS (SELECT CAST(len(codes) AS INT) AS "order", array_to_string(codes, ' ') AS factor_code, t_value AS coupling_t, prob AS transition_prob FROM pc JOIN cp ON list_sort(codes) = list_sort(string_split(factors, ',')) WHERE NOT list_contains(codes, 'UNK') AND t_value > 0.000001),
sweep AS (SELECT risks.*, range / 10.0 AS alpha, range / CAST(10 AS DOUBLE) * coupling_t + (10 - range) / CAST(10 AS DOUBLE) * transition_prob AS score FROM risks, range(11)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alpha ORDER BY score DESC, factor_code) AS rank FROM sweep) WHERE rank <= 15)"""


@query(f'{_RISKS} SELECT "order", factor_code, round(coupling_t, 9) AS coupling_t, round(transition_prob, 9) AS transition_prob, round(0.5 * coupling_t + 0.5 * transition_prob, 9) AS score FROM risks')
def risk_score(spark, sf):
    score = scoring.weighted(F.col("coupling_t"), F.col("transition_prob"), F.lit(0.5), F.lit(0.5))
    return rounded(_risks(spark, sf).withColumn("score", score), "coupling_t", "transition_prob", "score")


@query(f"{_RISKS} SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(rank AS INT) AS rank, factor_code, round(score, 9) AS score FROM top")
def alpha_sweep(spark, sf):
    return rounded(scoring.top_by_alpha(scoring.alpha_grid(_risks(spark, sf))).select("alpha", "rank", "factor_code", "score"), "score")


@query(f"{_RISKS} SELECT CAST(a.alpha AS DOUBLE) AS alpha, CAST(count(b.factor_code) AS BIGINT) AS overlap FROM top a LEFT JOIN (SELECT factor_code FROM top WHERE alpha = 0.5) b ON a.factor_code = b.factor_code GROUP BY 1")
def topn_overlap(spark, sf):
    return scoring.overlap_with_baseline(scoring.top_by_alpha(scoring.alpha_grid(stored(_risks(spark, sf)))))


@query(f"{_RISKS} SELECT CAST(s.alpha AS DOUBLE) AS alpha, s.factor_code, round(s.score, 9) AS score FROM sweep s JOIN top b ON b.alpha = 0.5 AND b.factor_code = s.factor_code")
def baseline_rescore(spark, sf):
    return rounded(scoring.alpha_grid(scoring.baseline_rows(_risks(spark, sf))).select("alpha", "factor_code", "score"), "score")


@query(f"{_RISKS} SELECT round(max(greatest(s.score, s.coupling_t)) * 1.1, 9) AS ceiling FROM sweep s JOIN top b ON b.alpha = 0.5 AND b.factor_code = s.factor_code")
def score_ceiling(spark, sf):
    return rounded(scoring.ceiling(scoring.alpha_grid(scoring.baseline_rows(_risks(spark, sf)))), "ceiling")


@query(f"""{_RISKS} SELECT * FROM (SELECT "order", CAST(row_number() OVER (PARTITION BY "order" ORDER BY factor_code) AS INT) AS row_pos, factor_code, round(coupling_t, 9) AS coupling_t, round(0.5 * coupling_t + 0.5 * transition_prob, 9) AS score FROM risks) WHERE row_pos <= 15""")
def model_compare(spark, sf):
    score = scoring.weighted(F.col("coupling_t"), F.col("transition_prob"), F.lit(0.5), F.lit(0.5))
    placed = _risks(spark, sf).withColumn("score", score).withColumn("row_pos", F.row_number().over(Window.partitionBy("order").orderBy("factor_code")))
    return rounded(scoring.model_compare(placed), "coupling_t", "score")


# --- descriptive --------------------------------------------------------------------------

_CODED = f"SELECT l_orderkey AS case_id, {_CODE.replace('x =', 'p_brand =')} AS code FROM ({_BRANDED})"


def _coded(spark, sf) -> DataFrame:
    return _labels(spark, sf, "p_brand").select("case_id", SUB_BY_BRAND.code_map()[F.col("label")].alias("code")).filter("code IS NOT NULL")


@query(f"SELECT code, CAST(count(*) AS BIGINT) AS mentions, CAST(count(DISTINCT case_id) AS BIGINT) AS cases FROM ({_CODED}) WHERE code IS NOT NULL GROUP BY code")
def factor_frequency(spark, sf):
    return describe.factor_frequency(_coded(spark, sf))


@query(f"""WITH c AS (SELECT code, regexp_replace(code, '[0-9]', '', 'g') AS parent, count(*) AS mentions FROM ({_CODED}) WHERE code IS NOT NULL GROUP BY code)
SELECT code, parent, CAST(mentions AS BIGINT) AS mentions, round(mentions * 100.0 / CAST(sum(mentions) OVER (PARTITION BY parent) AS DOUBLE), 1) AS share FROM c""")
def parent_share(spark, sf):
    return describe.parent_share(describe.factor_frequency(_coded(spark, sf)))


@query("SELECT 'orders' AS name, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'events', CAST(count(*) AS BIGINT) FROM events")
def row_counts(spark, sf):
    return describe.row_counts(orders=read(spark, sf, "orders"), events=read(spark, sf, "events"))


@query("SELECT user_id FROM events WHERE event_type = 'error' UNION SELECT user_id FROM events WHERE event_type = 'signup'")
def distinct_union(spark, sf):
    e = read(spark, sf, "events")
    return e.filter("event_type = 'error'").select("user_id").unionByName(e.filter("event_type = 'signup'").select("user_id")).distinct()


@query("SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup'")
def set_intersect(spark, sf):
    e = read(spark, sf, "events")
    return e.filter("event_type = 'error'").select("user_id").intersect(e.filter("event_type = 'signup'").select("user_id"))
