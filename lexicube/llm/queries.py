"""Queries of the problems in this subpackage and the SQL that checks them."""

from __future__ import annotations

from lexicube.llm import knn, mcl, mixing, packing, relevance, repeats, sentences, termcounts

QUERIES = {f.__name__: f for f in (relevance.p1_found, relevance.p1_weights, termcounts.p3_found, termcounts.p3_counts, packing.p7_bins, packing.p7_fill, mixing.p8_mix, mixing.p8_shares, repeats.p9_found, repeats.p9_shares, knn.p4_found, knn.p4_nearest, mcl.p5_found, mcl.p5_groups, sentences.p6_found, sentences.p6_by_language)}

# Canonical form of a phrase; current rows; both as DuckDB expressions.
_CANON = "trim(regexp_replace(lower(nfc_normalize({})), '[\\s\\p{{Z}}_\\x1c-\\x1f\\x85\\x0b]+', ' ', 'g'))"
_NEWS = f"""news_cur AS (SELECT doc_id, arg_max(phrases, ingested_at) AS phrases_x, max(ingested_at) FROM (SELECT doc_id, coalesce(phrases, []) AS phrases, ingested_at FROM news) GROUP BY doc_id),
news_occ AS (SELECT doc_id AS rec_id, {_CANON.format('p')} AS phrase FROM (SELECT doc_id, unnest(string_split(e, ';')) AS p FROM (SELECT doc_id, unnest(phrases_x) AS e FROM news_cur)) WHERE p IS NOT NULL)"""
_SETS = f"""set_cur AS (SELECT set_id, arg_max(ps, scored_at) AS ps FROM (SELECT set_id, coalesce(phrase_scores, []) AS ps, scored_at FROM set_scores) GROUP BY set_id),
set_occ AS (SELECT set_id AS rec_id, {_CANON.format('s.phrase')} AS phrase FROM (SELECT set_id, unnest(ps) AS s FROM set_cur) WHERE s.phrase IS NOT NULL)"""
_TF = """occ AS (SELECT 'news' AS origin, * FROM news_occ UNION ALL SELECT 'set_scores', * FROM set_occ),
tf AS (SELECT origin, rec_id, phrase, count(*) AS tf FROM occ WHERE phrase <> '' GROUP BY ALL),
n AS (SELECT origin, count(DISTINCT rec_id) AS n, sum(tf) / count(DISTINCT rec_id) AS avgdl FROM tf GROUP BY origin),
dl AS (SELECT origin, rec_id, sum(tf) AS dl FROM tf GROUP BY ALL),
d AS (SELECT origin, phrase, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT origin, rec_id, phrase, tf, df, tf * ln(n / df::DOUBLE) AS raw,
  ln(n / df::DOUBLE) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS weight
  FROM tf JOIN n USING (origin) JOIN dl USING (origin, rec_id) JOIN d USING (origin, phrase))"""
_COUNTS = f"""WITH {_NEWS},
dp AS (SELECT doc_id, {_CANON.format('p')} AS phrase, c FROM (SELECT doc_id, x.p AS p, x.c AS c FROM (SELECT doc_id, line_no, arg_max(struct_pack(p := phrase, c := document_phrase_cnt), ingested_at) AS x FROM doc_phrase GROUP BY doc_id, line_no)) WHERE c > 0 AND p IS NOT NULL),
tf AS (SELECT 'news' AS origin, rec_id, phrase, count(*) AS n FROM news_occ WHERE phrase <> '' GROUP BY ALL
  UNION ALL SELECT 'doc_phrase', doc_id, phrase, sum(c) FROM dp WHERE phrase <> '' GROUP BY ALL),
t AS (SELECT origin, count(DISTINCT rec_id) AS total FROM tf GROUP BY origin),
c AS (SELECT origin, phrase, sum(n)::BIGINT AS occurrences, count(*) AS records, any_value(total) AS total FROM tf JOIN t USING (origin) GROUP BY origin, phrase)"""

ORACLE = {
    "p1_weights": f"WITH {_NEWS}, {_SETS}, {_TF} SELECT origin, rec_id, phrase, tf, df, round(weight, 9) AS weight FROM w",
    "p1_found": f"""WITH {_NEWS}, {_SETS}, {_TF},
r AS (SELECT *, row_number() OVER (PARTITION BY origin, rec_id ORDER BY raw DESC) AS i, lead(raw) OVER (PARTITION BY origin, rec_id ORDER BY raw DESC) AS next, count(*) OVER (PARTITION BY origin, rec_id) AS m FROM w)
SELECT origin, rec_id, phrase FROM r WHERE i = 1 AND m >= 4 AND raw > 2.3 * next""",
    "p3_counts": f"{_COUNTS} SELECT origin, phrase, occurrences, records, concat_ws(',', CASE WHEN records < 3 THEN 'rare' END, CASE WHEN records > 0.15 * total THEN 'common' END) AS marks FROM c",
    "p3_found": f"{_COUNTS} SELECT origin, phrase, 'rare' AS mark FROM c WHERE records < 3 UNION ALL SELECT origin, phrase, 'common' FROM c WHERE records > 0.15 * total",
}
