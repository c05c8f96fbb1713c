"""Queries behind the charts, walks, and text operators that no other query shows, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import classify, describe, graph, linking, scoring, transitions
from .catalog import _BLOBS, _CODED, _EVENT_EDGES, _LISTS, _RISKS, _TRIPLETS, _blobs, _coded, _event_frequency, _order_lists, _risks, _triplets, query, read, rounded
from .reports import _ANSWERS, _answers

# --- levels and charts --------------------------------------------------------------------

_LEVELS = f"""WITH c AS (SELECT case_id, code, regexp_replace(code, '[0-9]', '', 'g') AS parent FROM ({_CODED}) WHERE code IS NOT NULL),
r AS (SELECT CAST(grouping_id(parent, code) AS INT) AS level, parent, code, CAST(count(*) AS BIGINT) AS mentions, CAST(count(DISTINCT case_id) AS BIGINT) AS cases FROM c GROUP BY ROLLUP (parent, code)),
h AS (SELECT r.*, CASE level WHEN 0 THEN p.mentions WHEN 1 THEN (SELECT mentions FROM r WHERE level = 3) END AS above FROM r LEFT JOIN (SELECT parent, mentions FROM r WHERE level = 1) p ON r.parent = p.parent),
levels AS (SELECT level, parent, code, mentions, cases, round(mentions * 100.0 / CAST(above AS DOUBLE), 1) AS share FROM h)"""


@query(f"{_LEVELS} SELECT * FROM levels")
def factor_rollup(spark, sf):
    return describe.hierarchy(_coded(spark, sf))


@query(f"""{_LEVELS} SELECT CASE level WHEN 0 THEN 'outer' ELSE 'inner' END AS ring, coalesce(code, parent) AS name, parent, mentions AS value, CASE level WHEN 0 THEN printf('%.1f', share) || '%' ELSE '' END AS label FROM levels WHERE level < 3""")
def pie_chart(spark, sf):
    return describe.nested_pie(describe.hierarchy(_coded(spark, sf)))


@query(f"{_RISKS} SELECT round(CAST(a.alpha AS DOUBLE), 1) AS alpha, round(1 - CAST(a.alpha AS DOUBLE), 1) AS beta, CAST(count(b.factor_code) AS BIGINT) AS overlap, a.alpha = 0.5 AS is_baseline FROM top a LEFT JOIN (SELECT factor_code FROM top WHERE alpha = 0.5) b ON a.factor_code = b.factor_code GROUP BY a.alpha")
def overlap_chart(spark, sf):
    return describe.overlap_line(scoring.overlap_with_baseline(scoring.top_by_alpha(scoring.alpha_grid(_risks(spark, sf)))))


@query(f"""{_RISKS}, s15 AS (SELECT s.* FROM sweep s JOIN top b ON b.alpha = 0.5 AND b.factor_code = s.factor_code),
p AS (SELECT *, CAST(alpha * 10 AS INT) AS panel, row_number() OVER (PARTITION BY alpha ORDER BY 0.5 * coupling_t + 0.5 * transition_prob DESC, factor_code) AS x, max(greatest(score, coupling_t)) OVER () * 1.1 AS y_limit FROM s15)
SELECT panel, panel // 3 AS grid_row, panel % 3 AS grid_column, round(CAST(alpha AS DOUBLE), 1) AS alpha, round(1 - CAST(alpha AS DOUBLE), 1) AS beta, CAST(x AS INT) AS x, factor_code, round(coupling_t, 9) AS coupling_t, round(score, 9) AS score, round(y_limit, 9) AS y_limit FROM p""")
def score_panels(spark, sf):
    return rounded(describe.score_panels(scoring.alpha_grid(scoring.baseline_rows(_risks(spark, sf)))), "coupling_t", "score", "y_limit")


# --- walks --------------------------------------------------------------------------------


@query(f"""
WITH RECURSIVE e AS (SELECT s, t, cnt / CAST(sum(cnt) OVER (PARTITION BY s) AS DOUBLE) AS p FROM ({_EVENT_EDGES})),
w(nodes, last, prob) AS (SELECT [s, t], t, p FROM e UNION ALL SELECT list_append(nodes, e.t), e.t, prob * e.p FROM w JOIN e ON w.last = e.s WHERE len(nodes) < 5)
SELECT array_to_string(nodes, ' -> ') AS walk, round(prob, 9) AS prob FROM w WHERE list_position(nodes, last) = len(nodes) AND last IN (SELECT s FROM e)""")
def walk_enumerate(spark, sf):
    found = transitions.walks(transitions.transition_probabilities(_event_frequency(spark, sf)))
    return found.select(F.array_join("nodes", " -> ").alias("walk"), F.round("prob", 9).alias("prob"))


# --- text ---------------------------------------------------------------------------------


@query(f"""
WITH b AS ({_BLOBS}), s AS (SELECT doc_id, string_split(text, 'Case') AS parts FROM b), e AS (SELECT doc_id, unnest(range(len(parts))) AS seg_no, parts FROM s), t AS (SELECT doc_id, seg_no, trim(parts[seg_no + 1], ' ' || chr(10)) AS segment FROM e)
SELECT doc_id, CAST(seg_no AS INT) AS seg_no, segment FROM t WHERE segment <> ''""")
def all_segments(spark, sf):
    """Segments with and without a number, so the preamble too."""
    line = F.concat(F.lit("Case "), F.col("o_orderkey").cast("string"), F.lit(" status "), F.col("o_orderstatus"), F.lit("\n"))
    return tx.split_cases(_blobs(spark, sf, "preamble", line, ""), numbered=False)


@query(f"WITH b AS (SELECT l_orderkey, array_to_string(brands, ' ；;') || ';' AS t FROM ({_LISTS})) SELECT l_orderkey, array_to_string(list_transform(string_split(t, ';'), lambda x: trim(x)), '|') AS labels FROM b")
def plain_split(spark, sf):
    """Half-width delimiters alone, empty labels kept."""
    rendered = F.concat(F.array_join("brands", " ；;"), F.lit(";"))
    return _order_lists(spark, sf).select("l_orderkey", F.array_join(tx.split_labels(rendered, full_width=False, drop_empty=False), "|").alias("labels"))


@query(f"WITH a AS ({_ANSWERS}) SELECT id, md5(CASE WHEN starts_with(answer, '```json') AND ends_with(answer, '```') THEN trim(substr(answer, 8, length(answer) - 10), chr(10) || ' ') ELSE answer END) AS digest FROM a")
def code_fence(spark, sf):
    return _answers(spark, sf).select("id", F.md5(tx.strip_code_fence(F.col("answer")).cast("binary")).alias("digest"))


_PROMPT = classify.SUB_PROMPT.replace("'", "''").replace("{names}", "' || p_brand || ', ' || p_type || '").replace("{text}", "' || p_name || '").replace("\n", "' || chr(10) || '")


@query(f"SELECT p_partkey, md5(p) AS digest, CAST(length(p) AS INT) AS chars FROM (SELECT p_partkey, '{_PROMPT}' AS p FROM part)")
def prompt_render(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", tx.render(classify.SUB_PROMPT, names=F.concat_ws(", ", "p_brand", "p_type"), text=F.col("p_name")).alias("p"))
    return part.select("p_partkey", F.md5(F.col("p").cast("binary")).alias("digest"), F.length("p").alias("chars"))


@query(f"SELECT head AS source, tail AS target, CAST(count(*) AS BIGINT) AS cnt FROM ({_TRIPLETS}) WHERE relation = 'LEADS_TO' GROUP BY 1, 2")
def relation_counts(spark, sf):
    """Edges of one relation out of several, counted by their ends."""
    return transitions.edge_counts(graph.edges(_triplets(spark, sf)), "LEADS_TO")


# --- vectors ------------------------------------------------------------------------------

#: How much of a vector's successor is mixed into the vectors that stand for other spellings of a name.
MIXES = (0.0, 0.08, 0.16, 0.24, 0.4)


def _name_vectors(spark, sf):
    """(id, vector): each embedding, mixtures with its successor's, and an exact copy of every third."""
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("next"))
    joined = e.join(after, "vec_id")
    mixed = lambda m: F.zip_with("v", "next", lambda x, y: F.lit(1.0 - m) * x + F.lit(m) * y)
    kinds = [F.struct(F.lit(k).alias("k"), mixed(m).alias("vector")) for k, m in enumerate(MIXES)]
    every = joined.select("vec_id", F.explode(F.concat(F.array(*kinds), F.when(F.col("vec_id") % 3 == 0, F.array(F.struct(F.lit(9).alias("k"), mixed(0.0).alias("vector")))).otherwise(F.array().cast("array<struct<k:int,vector:array<double>>>")))).alias("x"))
    return every.select((F.col("vec_id") * 10 + F.col("x.k")).alias("id"), "x.vector")


_MIXED = " UNION ALL ".join(f"SELECT vec_id * 10 + {k} AS id, list_transform(list_zip(v, next), lambda z: CAST({1.0 - m!r} AS DOUBLE) * z[1] + CAST({m!r} AS DOUBLE) * z[2]) AS v FROM j" + (" WHERE vec_id % 3 = 0" if k == 9 else "") for k, m in (*enumerate(MIXES), (9, 0.0)))


@query(f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), j AS (SELECT a.vec_id, a.v, b.v AS next FROM e a JOIN e b ON b.vec_id = a.vec_id + 1), x AS ({_MIXED}),
n AS (SELECT v, min(id) AS node FROM x GROUP BY v), l AS (SELECT a.node, count(*) AS n_links FROM n a JOIN n b ON a.node <> b.node AND list_cosine_similarity(a.v, b.v) >= {linking.THRESHOLD} GROUP BY 1)
SELECT x.id, n.node, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM x JOIN n ON x.v = n.v LEFT JOIN l ON l.node = n.node""")
def name_links(spark, sf):
    """Names linked by their vectors: each one's node, and how many other nodes are close."""
    return linking.vector_link_counts(_name_vectors(spark, sf))
