"""Pieces of DuckDB SQL shared by the query twins."""

from __future__ import annotations

from lexicube.functions.text import PUNCTUATION

_PUNCT = PUNCTUATION.replace("'", "''")


def tok(text: str) -> str:
    """Normalised words of a text."""
    return f"list_filter(list_transform(string_split_regex(lower({text}), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: replace(trim(w, '{_PUNCT}'), '''s', '')), lambda w: w <> '')"


CANON = "trim(regexp_replace(lower(nfc_normalize({})), '[\\s\\p{{Z}}_\\x1c-\\x1f\\x85\\x0b]+', ' ', 'g'))"

TF = f"tf AS (SELECT doc_id, phrase, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS phrase FROM documents WHERE text IS NOT NULL) GROUP BY ALL)"
IDF = "idf AS (SELECT phrase, count(*) AS df, ln((SELECT count(DISTINCT doc_id) FROM tf) / count(*)::DOUBLE) AS idf FROM tf GROUP BY phrase)"
# current, countable lines of doc_phrase, as phrase counts of a document
DP = f"""dp AS (SELECT doc_id, phrase, sum(c)::BIGINT AS tf FROM (SELECT doc_id, {CANON.format('p')} AS phrase, c FROM (SELECT doc_id, x.p AS p, x.c AS c FROM (
SELECT doc_id, line_no, arg_max(struct_pack(p := phrase, c := document_phrase_cnt), ingested_at) AS x FROM doc_phrase GROUP BY doc_id, line_no)) WHERE c > 0 AND p IS NOT NULL) WHERE phrase <> '' GROUP BY doc_id, phrase)"""
# the cube over dp with the sources of the documents as cells
CUBE = f"""{DP}, cells AS (SELECT DISTINCT source AS cell, doc_id FROM documents WHERE source IS NOT NULL),
cc AS (SELECT cell, phrase, sum(tf) AS tf, count(*) AS df FROM dp JOIN cells USING (doc_id) GROUP BY ALL),
st AS (SELECT cell, sum(tf) AS dl, max(df) AS max_df FROM cc GROUP BY cell), av AS (SELECT sum(dl) / count(*) AS avgdl, count(*) AS n_cells FROM st),
rel AS (SELECT cell, phrase, tf, df, 3 * tf * 2.2 / (tf + 1.2 * (0.5 + 0.5 * dl / avgdl)) * log2(1 + df) / log2(1 + max_df) AS rel FROM cc JOIN st USING (cell), av),
ds AS (SELECT *, exp(rel) / (1 + (SELECT n_cells FROM av) - count(*) OVER (PARTITION BY phrase) + sum(exp(rel)) OVER (PARTITION BY phrase)) AS d FROM rel)"""
CENT = """pos AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL),
cent AS (SELECT label, list(m ORDER BY i) AS c FROM pos GROUP BY label)"""
ASSIGN = f"""{CENT}, sc AS (SELECT vec_id AS doc_id, c.label, list_dot_product(e.embedding::DOUBLE[], c.c) AS score FROM embeddings e, cent c),
rk AS (SELECT *, row_number() OVER w AS r, score - lead(score) OVER w AS margin FROM sc WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, label)),
best AS (SELECT doc_id, label, score, margin FROM rk WHERE r = 1)"""
# sentences of the current texts of doc_sets by the plain splitter
SENTS = f"""cur AS (SELECT set_id, doc_no, arg_max(coalesce(docs, ''), ingested_at) AS docs FROM doc_sets GROUP BY ALL),
one AS (SELECT set_id, doc_no, trim(s, ' ') AS sentence, i FROM (SELECT set_id, doc_no, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT set_id, doc_no, string_split(regexp_replace(docs, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM cur)) WHERE trim(s, ' ') <> ''),
sents AS (SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY doc_no, i) - 1 AS sent_no, sentence, {tok('sentence')} AS tokens FROM one)"""
SHARED = f"""{SENTS}, t AS (SELECT DISTINCT set_id, sent_no, len(tokens) AS n, len(list_distinct(tokens)) AS el, unnest(tokens) AS token FROM sents),
sh AS (SELECT a.set_id, a.sent_no AS i, b.sent_no AS j, count(*) AS common, any_value(a.n) AS ni, any_value(b.n) AS nj, any_value(a.el) AS ei, any_value(b.el) AS ej FROM t a JOIN t b ON a.set_id = b.set_id AND a.token = b.token AND a.sent_no <> b.sent_no GROUP BY ALL)"""
EDGE = f"{SHARED}, e AS (SELECT set_id, i AS src, j AS dst, common / (2 * ln(nj)) AS w FROM sh WHERE nj > 1)"
PAIRS = f"""w AS (SELECT doc_id, {tok('text')} AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id AS key, t[i] AS a, unnest(t[i + 1 : i + 4]) AS b FROM (SELECT doc_id, t, generate_subscripts(t, 1) AS i FROM w))"""
HIER = """l AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent, 'in_region' AS relation, 2 AS level FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'in_nation', 1 FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'in_nation', 1 FROM supplier),
cnt AS (SELECT 'c' || o_custkey AS node, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 's' || l_suppkey, count(*) FROM lineitem GROUP BY ALL)"""
HIN = """he AS (SELECT 'customer' AS src_type, o_custkey::VARCHAR AS src, 'order' AS dst_type, o_orderkey::VARCHAR AS dst, o_totalprice AS weight, 'places' AS edge_type FROM orders
UNION ALL SELECT 'part', l_partkey::VARCHAR, 'supplier', l_suppkey::VARCHAR, sum(l_quantity), 'from' FROM lineitem GROUP BY ALL),
hn AS (SELECT DISTINCT type, key FROM (SELECT src_type AS type, src AS key FROM he UNION ALL SELECT dst_type, dst FROM he)),
ids AS (SELECT type, key, row_number() OVER (PARTITION BY type ORDER BY key) - 1 AS local_id, row_number() OVER (ORDER BY type, key) - 1 AS node_id FROM hn)"""
