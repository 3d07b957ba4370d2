"""All queries of the engine by name, and the SQL that checks them.

Every query reads its whole tables. Sets are ``set_id`` of ``doc_sets`` or
``documents``; cells of the cube are the sources of ``documents``; label vectors are
the centroids of ``embeddings``; the concept hierarchy is region, nation, customer and
supplier; the typed network is customer, order, part and supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexicube.functions import text as T, vector as V
from lexicube.operators import assign, cooc, cube, distinct, evalm, hier, hin, index, rank, select, sentence
from lexicube.operators.common import current_rows, sample_k, top_k
from lexicube.plans import load, sql as S
from lexicube.session import cut, table
from lexicube.sources import readers
from lexicube.streaming import counts

QUERIES: dict = {**load.QUERIES}
ORACLE: dict[str, str] = {**load.ORACLE}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def r6(c, name: str | None = None):
    """A float rounded to six places."""
    return F.round(c, 6).alias(name or c)


# index ---------------------------------------------------------------------


def word_tf(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(table(spark, d, "documents"), "doc_id", T.tokens(F.col("text")))


def mined_tf(spark: SparkSession, d: str) -> DataFrame:
    """Phrase counts of the current, countable lines of ``doc_phrase``."""
    cur = current_rows(table(spark, d, "doc_phrase").select("doc_id", "line_no", "phrase", "document_phrase_cnt", "ingested_at"), ["doc_id", "line_no"], "ingested_at")
    good = cur.where("document_phrase_cnt > 0 and phrase is not null").select("doc_id", T.canonical_phrase(F.col("phrase")).alias("phrase"), F.col("document_phrase_cnt").cast("long").alias("n"))
    return good.where("phrase <> ''").groupBy("doc_id", "phrase").agg(F.sum("n").alias("tf"))


@query(f"WITH {S.TF} SELECT * FROM tf")
def tf_postings(spark, d):
    return word_tf(spark, d)


@query(f"WITH {S.TF}, {S.IDF} SELECT phrase, df, round(idf, 6) AS idf FROM idf")
def idf(spark, d):
    return index.idf(cut(word_tf(spark, d), "tf")).select("phrase", "df", r6("idf"))


@query(f"WITH {S.TF}, {S.IDF}, s AS (SELECT doc_id, phrase, tf * idf AS score, row_number() OVER (PARTITION BY doc_id ORDER BY tf * idf DESC, phrase) AS rank FROM tf JOIN idf USING (phrase)) SELECT doc_id, phrase, round(score, 6) AS score, rank FROM s WHERE rank <= 10")
def tfidf_topk(spark, d):
    return index.tfidf_top(cut(word_tf(spark, d), "tf")).select("doc_id", "phrase", r6("score"), "rank")


@query(f"WITH {S.TF}, {S.IDF}, s AS (SELECT set_id, doc_id, phrase, tf * idf AS score, row_number() OVER (PARTITION BY set_id ORDER BY tf * idf DESC, phrase, doc_id) AS rank FROM tf JOIN idf USING (phrase) JOIN (SELECT doc_id, set_id FROM documents WHERE set_id IS NOT NULL) USING (doc_id)) SELECT set_id, doc_id, phrase, round(score, 6) AS score, rank FROM s WHERE rank <= 10")
def tfidf_set_topk(spark, d):
    return index.tfidf_set_top(cut(word_tf(spark, d), "tf"), table(spark, d, "documents")).select("set_id", "doc_id", "phrase", r6("score"), "rank")


@query(f"WITH {S.TF} SELECT phrase, sum(tf)::BIGINT AS total, row_number() OVER (ORDER BY sum(tf) DESC, phrase) AS id FROM tf GROUP BY phrase HAVING sum(tf) >= 10")
def vocab_dict(spark, d):
    return index.dictionary(word_tf(spark, d))


@query(f"""WITH {S.TF}, v AS (SELECT phrase, row_number() OVER (ORDER BY sum(tf) DESC, phrase) AS id FROM tf GROUP BY phrase HAVING sum(tf) >= 10),
u AS (SELECT doc_id, unnest(t) AS phrase, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {S.tok('text')} AS t FROM documents WHERE text IS NOT NULL)),
g AS (SELECT doc_id, string_agg(id::VARCHAR, ' ' ORDER BY i) AS ids, count(*) - count(id) AS n_oov FROM u LEFT JOIN v USING (phrase) GROUP BY doc_id)
SELECT d.doc_id, coalesce(ids, '') AS ids, coalesce(n_oov, 0) AS n_oov FROM documents d LEFT JOIN g USING (doc_id)""")
def encode_docs(spark, d):
    docs = table(spark, d, "documents")
    out = index.encode(docs, "doc_id", T.tokens(F.col("text")), index.dictionary(word_tf(spark, d)))
    return out.select("doc_id", F.array_join("ids", " ").alias("ids"), F.coalesce("n_oov", F.lit(0)).alias("n_oov"))


@query(f"WITH {S.TF} SELECT p.phrase, sum(tf)::BIGINT AS total FROM tf p WHERE phrase NOT IN (SELECT DISTINCT phrase FROM (SELECT unnest({S.tok('content')}) AS phrase FROM (SELECT array_to_string(content_sents, ' ') AS content FROM news WHERE content_sents IS NOT NULL))) GROUP BY 1")
def outside_words(spark, d):
    news = table(spark, d, "news").select(F.explode(T.tokens(F.array_join("content_sents", " "))).alias("phrase")).distinct()
    return index.outside_words(word_tf(spark, d), news)


# scalar functions and filters ------------------------------------------------


@query("SELECT doc_id, lower(replace(coalesce(source, ''), ' ', '_')) AS concept, replace(coalesce(source, ''), '_', ' ') AS shown, left(replace(coalesce(text, ''), ' ', ''), 100) AS head FROM documents")
def text_keys(spark, d):
    s = F.coalesce("source", F.lit(""))
    return table(spark, d, "documents").select("doc_id", T.concept_name(s).alias("concept"), T.display_phrase(s).alias("shown"), T.head_key(F.coalesce("text", F.lit(""))).alias("head"))


@query("WITH w AS (SELECT DISTINCT emb_key AS a, label AS b FROM emb WHERE kind = 'word' AND emb_key <> '' AND label <> '') SELECT a, b, levenshtein(substr(a, 2), substr(b, 2)) AS distance FROM w")
def tail_levenshtein(spark, d):
    w = table(spark, d, "emb").where("kind = 'word' and emb_key <> '' and label <> ''").select(F.col("emb_key").alias("a"), F.col("label").alias("b")).distinct()
    return w.select("a", "b", T.tail_levenshtein(F.col("a"), F.col("b")).alias("distance"))


@query(f"WITH {S.TF} SELECT phrase, count(*) AS df FROM tf WHERE regexp_matches(phrase, '^[B-Yb-y]') GROUP BY phrase")
def is_eng_filter(spark, d):
    return index.document_frequency(word_tf(spark, d).where(T.is_eng(F.col("phrase"))))


@query(f"""WITH d AS (SELECT doc_id, source, {S.tok('text')} AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_distinct(t)) AS distinct_words, len(t) AS words, len(list_intersect(t, {S.tok("coalesce(source, '')")})) AS common FROM d""")
def word_sets(spark, d):
    t, s = T.tokens(F.col("text")), T.tokens(F.coalesce("source", F.lit("")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.array_distinct(t)).alias("distinct_words"), F.size(t).alias("words"), F.size(F.array_intersect(t, s)).alias("common"))


@query("""WITH a AS (SELECT doc_id AS id, left(replace(text, ' ', ''), 100) AS k FROM documents),
b AS (SELECT k, min(id) AS new_id FROM a WHERE k IS NOT NULL GROUP BY k) SELECT id AS old_id, coalesce(new_id, -1) AS new_id FROM a LEFT JOIN b USING (k)""")
def prefix_match(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return readers.prefix_match(docs, docs)


# cube ------------------------------------------------------------------------


def _cells(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("cell"), "doc_id").where("cell is not null")


def _scores(spark, d, option):
    return cube.cell_scores(cut(mined_tf(spark, d), "tf"), _cells(spark, d), option)


@query(f"WITH {S.CUBE} SELECT cell, dl::BIGINT AS dl, max_df FROM st")
def cell_stats(spark, d):
    return cube.cell_stats(cube.cell_counts(mined_tf(spark, d), _cells(spark, d)))


@query(f"WITH {S.CUBE} SELECT cell, phrase, round(log2(1 + tf) * d, 6) AS score FROM ds")
def cube_score_a(spark, d):
    return _scores(spark, d, "A").select("cell", "phrase", r6("score"))


@query(f"WITH {S.CUBE} SELECT cell, phrase, round(d, 6) AS score FROM ds")
def cube_score_b(spark, d):
    return _scores(spark, d, "B").select("cell", "phrase", r6("score"))


@query(f"WITH {S.CUBE}, {S.DP.replace('dp AS', 'dp2 AS')}, x AS (SELECT cell, phrase, tf::DOUBLE / dl AS relevance FROM cc JOIN st USING (cell)) SELECT cell, phrase, round(d * relevance, 6) AS score FROM ds JOIN x USING (cell, phrase)")
def cube_score_c(spark, d):
    tf, cells = cut(mined_tf(spark, d), "tf"), _cells(spark, d)
    c = cube.cell_counts(tf, cells)
    extra = c.withColumn("relevance", F.col("tf") / F.sum("tf").over(Window.partitionBy("cell")))
    return cube.cell_scores(tf, cells, "C", extra).select("cell", "phrase", r6("score"))


@query(f"WITH {S.CUBE} SELECT cell, phrase, round(log2(1 + tf), 6) AS score FROM ds")
def cube_score_e(spark, d):
    return _scores(spark, d, "E").select("cell", "phrase", r6("score"))


@query(f"""WITH {S.CUBE}, n AS (SELECT cell, count(*) AS n FROM cells GROUP BY cell), s AS (SELECT cell, phrase, log2(1 + tf) * d AS score FROM ds)
SELECT a.phrase, round(a.score * (SELECT n FROM n WHERE cell = 'metro_daily') / nullif(b.score * (SELECT n FROM n WHERE cell = 'wire'), 0), 6) AS ratio FROM s a LEFT JOIN (SELECT * FROM s WHERE cell = 'metro_daily') b USING (phrase) WHERE a.cell = 'wire'""")
def contrast_ratio(spark, d):
    cells = _cells(spark, d).distinct()
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return cube.contrast_ratio(cut(_scores(spark, d, "A"), "scores"), "wire", "metro_daily", sizes).select("phrase", r6("ratio"))


# vectors -----------------------------------------------------------------------


def _vecs(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


def _assigned(spark, d):
    v = _vecs(spark, d)
    return assign.soft_assign(v, cut(assign.centroids(v, "label", "vec", 64), "labels"))


@query(f"WITH {S.ASSIGN} SELECT doc_id, label, round(score, 6) AS score, round(margin, 6) AS margin FROM best")
def soft_assign(spark, d):
    return _assigned(spark, d).select("doc_id", "label", r6("score"), r6("margin"))


@query(f"WITH {S.ASSIGN} SELECT s.doc_id, s.label, round(b.score, 6) AS score FROM sc s JOIN best b USING (doc_id)")
def soft_assign_every(spark, d):
    v = _vecs(spark, d)
    return assign.assign_under_every(v, cut(assign.centroids(v, "label", "vec", 64), "labels")).select("doc_id", "label", r6("score"))


@query(f"WITH {S.CENT} SELECT vec_id AS doc_id, c.label, round(list_cosine_similarity(e.embedding::DOUBLE[], c.c), 6) AS score FROM embeddings e, (SELECT label, c FROM cent) c")
def label_cosines(spark, d):
    v = _vecs(spark, d)
    return assign.label_scores(v.drop("label"), cut(assign.centroids(v, "label", "vec", 64), "labels"), "cosine").select("doc_id", "label", r6("score"))


@query(f"WITH {S.ASSIGN}, q AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY margin DESC, doc_id) AS rank FROM best) SELECT label, doc_id, round(margin, 6) AS margin, rank FROM q WHERE rank <= 20")
def label_rank_topk(spark, d):
    return assign.rank_in_label(_assigned(spark, d), "margin", 20).select("label", "doc_id", r6("margin"), "rank")


@query(f"WITH {S.ASSIGN}, q AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY margin DESC, doc_id) AS rank FROM best) SELECT q.label, round(sum((e.label = q.label)::INT) / 300.0, 6) AS precision FROM q JOIN embeddings e ON e.vec_id = q.doc_id WHERE rank <= 300 GROUP BY q.label")
def assign_precision(spark, d):
    return assign.precision_at_k(assign.rank_in_label(_assigned(spark, d)), _vecs(spark, d)).select("label", r6("precision"))


@query(f"""WITH {S.ASSIGN}, j AS (SELECT b.label, e.label AS gold FROM best b JOIN embeddings e ON e.vec_id = b.doc_id),
p AS (SELECT label, count(*) AS pred, sum((label = gold)::INT) AS hit FROM j GROUP BY label), g AS (SELECT gold AS label, count(*) AS real FROM j GROUP BY gold),
a AS (SELECT coalesce(pred, 0) AS pred, coalesce(hit, 0) AS hit, coalesce(real, 0) AS real FROM p FULL JOIN g USING (label))
SELECT round(2 * sum(hit) / (sum(pred) + sum(real)), 6) AS micro_f1, round(avg(CASE WHEN hit > 0 THEN 2 * hit / (pred + real) END), 6) AS macro_f1 FROM a""")
def assign_f1(spark, d):
    return assign.f1(_assigned(spark, d), _vecs(spark, d)).select(r6("micro_f1"), r6("macro_f1"))


@query(f"WITH {S.ASSIGN}, v AS (SELECT set_id, b.label, count(*) AS votes FROM best b JOIN documents d ON d.doc_id = b.doc_id WHERE set_id IS NOT NULL GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY votes DESC, label) AS r FROM v) SELECT set_id, label, votes FROM q WHERE r = 1")
def majority_label(spark, d):
    return assign.majority_label(_assigned(spark, d), table(spark, d, "documents").where("set_id is not null"))


@query(f"""WITH {S.ASSIGN}, u AS (SELECT vec_id AS doc_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
m AS (SELECT d.set_id, u.label, u.u FROM u JOIN documents d USING (doc_id) WHERE d.set_id IS NOT NULL),
q AS (SELECT set_id, label, list(s ORDER BY i) AS q FROM (SELECT set_id, label, i, sum(x) AS s FROM (SELECT set_id, label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM m) GROUP BY ALL) GROUP BY ALL),
n AS (SELECT set_id, label, count(*) AS n FROM m GROUP BY ALL),
r AS (SELECT q.set_id, q.label, u.doc_id, n, n - list_dot_product(u.u, q.q) AS distance FROM q JOIN n USING (set_id, label) JOIN u USING (label)),
k AS (SELECT *, row_number() OVER (PARTITION BY set_id, label ORDER BY round(distance, 9), doc_id) AS rank FROM r)
SELECT set_id, label, doc_id, round(distance, 6) AS distance, rank FROM k WHERE rank <= 2 * n""")
def knn_emb(spark, d):
    v = _vecs(spark, d)
    m = v.join(table(spark, d, "documents").select("doc_id", "set_id").where("set_id is not null"), "doc_id")
    key = F.concat_ws("|", "set_id", "label")
    out = assign.neighbours(m.select(key.alias("set_id"), "label", "vec"), v)
    w = Window.partitionBy("set_id").orderBy(F.round("distance", 9), "doc_id")
    part = F.split("set_id", "[|]")
    return out.withColumn("rank", F.row_number().over(w)).select(part[0].cast("long").alias("set_id"), part[1].cast("int").alias("label"), "doc_id", r6("distance"), "rank")


@query(f"""WITH {S.TF}, {S.IDF}, x AS (SELECT doc_id, phrase, tf * idf AS w FROM tf JOIN idf USING (phrase)), s AS (SELECT set_id, phrase, sum(w) AS w FROM x JOIN documents USING (doc_id) WHERE set_id IS NOT NULL GROUP BY ALL),
q AS (SELECT s.set_id, x.doc_id, sum(s.w * x.w) AS score FROM s JOIN x USING (phrase) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM q)
SELECT set_id, doc_id, round(score, 4) AS score, rank FROM r WHERE rank <= 50""")
def knn_tfidf(spark, d):
    x = cut(index.tfidf(cut(word_tf(spark, d), "tf")).select("doc_id", "phrase", F.col("score").alias("w")), "weights")
    s = x.join(table(spark, d, "documents").select("doc_id", "set_id").where("set_id is not null"), "doc_id").groupBy("set_id", "phrase").agg(F.sum("w").alias("v"))
    return index.sparse_nearest(s, x, 50).select("set_id", "doc_id", F.round("score", 4).alias("score"), "rank")


# co-occurrence -----------------------------------------------------------------


def _pairs(spark, d, window=4):
    return cooc.window_pairs(table(spark, d, "documents"), "doc_id", T.tokens(F.col("text")), window)


@query(f"WITH {S.PAIRS} SELECT a, b, count(*) AS n FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) GROUP BY ALL")
def cooc_window(spark, d):
    return cooc.window_counts(_pairs(spark, d))


@query(f"WITH {S.PAIRS}, o AS (SELECT DISTINCT key, least(a, b) AS a, greatest(a, b) AS b FROM p) SELECT a, b, count(*) AS n FROM (SELECT a, b FROM o UNION ALL SELECT b, a FROM o) GROUP BY ALL")
def cooc_doc_distinct(spark, d):
    return cooc.document_counts(_pairs(spark, d))


@query(f"WITH {S.PAIRS}, c AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) WHERE a <> b GROUP BY ALL) SELECT a, b, round(n / sum(n) OVER (PARTITION BY a), 6) AS p FROM c")
def cooc_row_norm(spark, d):
    return cooc.row_normalised(cooc.window_counts(_pairs(spark, d))).select("a", "b", r6("p"))


@query(f"WITH {S.PAIRS.replace('i + 4', 'i + 2')} SELECT centre, context, count(*) AS n FROM (SELECT a AS centre, b AS context FROM p UNION ALL SELECT b, a FROM p) GROUP BY ALL")
def skipgram_pairs(spark, d):
    return cooc.skipgrams(table(spark, d, "documents"), "doc_id", T.tokens(F.col("text")), 2).groupBy("centre", "context").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH w AS (SELECT doc_id, {S.tok('text')} AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id AS key, array_to_string(t[i - 2 : i - 1], ' ') || ' | ' || array_to_string(t[i + 1 : i + 2], ' ') AS context, t[i] AS word FROM (SELECT doc_id, t, generate_subscripts(t, 1) AS i FROM w) WHERE i > 2 AND i <= len(t) - 2")
def cbow_windows(spark, d):
    c = cooc.cbow_windows(table(spark, d, "documents"), "doc_id", T.tokens(F.col("text")), 2)
    side = lambda a: F.array_join(F.slice("context", a, 2), " ")
    return c.select("key", F.concat(side(1), F.lit(" | "), side(3)).alias("context"), "word")


# sentences ---------------------------------------------------------------------


def _sents(spark, d):
    cur = current_rows(table(spark, d, "doc_sets").select("set_id", "doc_no", "docs", "ingested_at"), ["set_id", "doc_no"], "ingested_at")
    return cut(sentence.sentence_tokens(cur, "docs", T.sentences, T.tokens), "sentences")


@query(f"WITH {S.EDGE} SELECT set_id, src, dst, round(w, 6) AS w FROM e")
def sentence_overlap(spark, d):
    return sentence.overlap_edges(_sents(spark, d)).select("set_id", "src", "dst", r6("w"))


@query(f"""WITH {S.SHARED}, z AS (SELECT set_id, sent_no, len(list_distinct(tokens)) AS el, len(tokens) AS rl FROM sents WHERE len(tokens) > 0),
m AS (SELECT *, count(*) OVER (PARTITION BY set_id) AS n, max(el) OVER (PARTITION BY set_id) AS mel, max(rl) OVER (PARTITION BY set_id) AS mrl FROM z),
c AS (SELECT set_id, i, j, common / sqrt(ei * ej) AS cos FROM sh), dn AS (SELECT set_id, i AS sent_no, sum((cos > 0.22)::INT) AS d FROM c GROUP BY ALL),
b AS (SELECT m.*, coalesce(d, 0) / n AS repr FROM m LEFT JOIN dn USING (set_id, sent_no)),
full_c AS (SELECT a.set_id, a.sent_no AS i, a.repr AS ri, o.repr AS rj, coalesce(cos, 0) AS cos FROM b a JOIN b o ON a.set_id = o.set_id AND a.sent_no <> o.sent_no LEFT JOIN c ON c.set_id = a.set_id AND c.i = a.sent_no AND c.j = o.sent_no),
dv AS (SELECT set_id, i AS sent_no, CASE WHEN count(*) FILTER (WHERE rj > ri) > 0 THEN 1 - max(cos) FILTER (WHERE rj > ri) ELSE 1 - min(cos) END AS dv FROM full_c GROUP BY ALL),
o AS (SELECT b.set_id, b.sent_no, repr, coalesce(dv, 1) AS div, el / mel * ln(mrl / rl) AS len FROM b LEFT JOIN dv USING (set_id, sent_no))
SELECT set_id, sent_no, round(repr, 6) AS repr, round(div, 6) AS div, round(len, 6) AS len, round(ln(repr + 0.001) + ln(div + 0.001) + ln(len + 0.001), 5) AS score FROM o""")
def density_peak(spark, d):
    return sentence.density_peak(_sents(spark, d)).select("set_id", "sent_no", r6("repr"), r6("div"), r6("len"), F.round("score", 5).alias("score"))


_WALK = """nd AS (SELECT DISTINCT set_id, src AS node FROM {e} UNION SELECT DISTINCT set_id, dst FROM {e}), n AS (SELECT set_id, count(*) AS n FROM nd GROUP BY set_id),
pr AS (SELECT set_id, src, dst, w / sum(w) OVER (PARTITION BY set_id, src) AS p FROM {e} WHERE src <> dst),
it AS (SELECT 0 AS r, nd.set_id, node, 1.0::DOUBLE / n AS s FROM nd JOIN n USING (set_id)
UNION ALL SELECT any_value(r) + 1, t.set_id, t.node, 0.85 * coalesce(sum(t.x), 0) + 0.15 FROM (
SELECT it.r, it.set_id, pr.dst AS node, pr.p * it.s AS x FROM it JOIN pr ON pr.set_id = it.set_id AND pr.src = it.node WHERE it.r < 20
UNION ALL SELECT it.r, it.set_id, it.node, 0 FROM it WHERE it.r < 20) t GROUP BY t.set_id, t.node)"""


@query(f"WITH RECURSIVE {S.EDGE}, {_WALK.format(e='e')} SELECT set_id, node::VARCHAR AS node, round(s, 6) AS score FROM it WHERE r = 20")
def sentence_textrank(spark, d):
    return rank.textrank_sets(sentence.overlap_edges(_sents(spark, d)), rounds=20).select("set_id", "node", r6("score"))


def _phrase_edges(spark, d):
    """Window counts of the words of each set's current texts (sets are ``doc_sets``)."""
    s = _sents(spark, d).where(F.size("tokens") > 1)
    p = cooc.window_pairs(s.withColumn("key", F.col("set_id")), "key", F.col("tokens"), 4)
    both = p.unionByName(p.select("key", F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("key").alias("set_id"), F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))


_PE = "pp AS (SELECT set_id, tokens[i] AS a, unnest(tokens[i + 1 : i + 4]) AS b FROM (SELECT set_id, tokens, generate_subscripts(tokens, 1) AS i FROM sents WHERE len(tokens) > 1)), pe AS (SELECT set_id, a AS src, b AS dst, count(*)::DOUBLE AS w FROM (SELECT set_id, a, b FROM pp UNION ALL SELECT set_id, b, a FROM pp) GROUP BY ALL)"


@query(f"WITH RECURSIVE {S.SENTS}, {_PE}, {_WALK.format(e='pe')} SELECT set_id, node, round(s, 6) AS score FROM it WHERE r = 20")
def phrase_textrank(spark, d):
    return rank.textrank_sets(_phrase_edges(spark, d), rounds=20).select("set_id", "node", r6("score"))


@query("""WITH RECURSIVE ed AS (SELECT o_custkey AS src, l_suppkey AS dst, count(*)::DOUBLE AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
al AS (SELECT 'c' || src AS src, 's' || dst AS dst, w FROM ed UNION ALL SELECT 's' || dst, 'c' || src, w FROM ed),
pr AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM al), nd AS (SELECT DISTINCT src AS node FROM al), n AS (SELECT count(*) AS n FROM nd),
it AS (SELECT 0 AS r, node, 1.0::DOUBLE / n AS s, 1.0::DOUBLE / n AS b FROM nd, n
UNION ALL SELECT any_value(r) + 1, node, 0.5 * max(b) + 0.5 * sum(x), max(b) FROM (SELECT it.r, pr.dst AS node, pr.p * it.s AS x, it.b FROM it JOIN pr ON pr.src = it.node WHERE it.r < 5) GROUP BY node)
SELECT node, round(s, 9) AS score FROM it WHERE r = 5""")
def pagerank_global(spark, d):
    """One graph of customers and suppliers, in joins and sums."""
    e = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("w"))
    a, b = F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("s"), "l_suppkey")
    both = e.select(a.alias("src"), b.alias("dst"), "w").unionByName(e.select(b.alias("src"), a.alias("dst"), "w"))
    return rank.pagerank_large(both, 0.5, 5).select("node", F.round("score", 9).alias("score"))



# distinctness, fusion -------------------------------------------------------------


@query(f"""WITH {S.DP}, {S.CENT}, sc AS (SELECT vec_id AS doc_id, c.label, list_dot_product(e.embedding::DOUBLE[], c.c) AS score FROM embeddings e, cent c),
sm AS (SELECT doc_id, label, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM sc), sp AS (SELECT doc_id, label, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM sm),
ms AS (SELECT phrase, label, sum(tf * p) AS m FROM dp JOIN sp USING (doc_id) GROUP BY ALL), q AS (SELECT phrase, m / sum(m) OVER (PARTITION BY phrase) AS p FROM ms),
k AS (SELECT phrase, sum(p * ln(p * (SELECT count(DISTINCT label) FROM sc))) AS kl FROM q WHERE p > 0 GROUP BY phrase)
SELECT phrase, round(coalesce(kl, 0), 6) AS kl FROM (SELECT DISTINCT phrase FROM dp) LEFT JOIN k USING (phrase)""")
def distinct_map(spark, d):
    v = _vecs(spark, d)
    sc = assign.label_scores(v.drop("label"), cut(assign.centroids(v, "label", "vec", 64), "labels"))
    return distinct.distinct_map(cut(mined_tf(spark, d), "tf"), sc).select("phrase", r6("kl"))


@query(f"WITH {S.CUBE}, a AS (SELECT phrase, row_number() OVER (PARTITION BY cell ORDER BY round(log2(1 + tf) * d, 9) DESC, phrase) AS rank FROM ds) SELECT phrase AS item, round(sum(1 / rank), 6) AS score FROM a GROUP BY phrase")
def rrf_fusion(spark, d):
    s = _scores(spark, d, "A").withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(F.round("score", 9).desc(), "phrase")))
    return distinct.rank_fusion(s.select(F.col("phrase").alias("item"), "rank")).select("item", r6("score"))


# hierarchy and network --------------------------------------------------------------


def _links(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit("in_region").alias("relation"), F.lit(2).alias("level"))
    leaf = lambda t, k, nk, x: table(spark, d, t).select(F.concat(F.lit(x), k).alias("child"), F.concat(F.lit("n"), nk).alias("parent"), F.lit("in_nation").alias("relation"), F.lit(1).alias("level"))
    return n.unionByName(leaf("customer", "c_custkey", "c_nationkey", "c")).unionByName(leaf("supplier", "s_suppkey", "s_nationkey", "s"))


def _counts(spark, d):
    c = table(spark, d, "orders").groupBy(F.concat(F.lit("c"), "o_custkey").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return c.unionByName(table(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("node")).agg(F.count(F.lit(1)).alias("n")))


@query(f"""WITH {S.HIER}, l1 AS (SELECT parent AS node, sum(n) AS total FROM l JOIN cnt ON node = child WHERE level = 1 GROUP BY parent), l2 AS (SELECT parent AS node, sum(total) AS total FROM l JOIN l1 ON node = child WHERE level = 2 GROUP BY parent)
SELECT 0 AS level, node, n AS total FROM cnt UNION ALL SELECT 1, node, total::BIGINT FROM l1 UNION ALL SELECT 2, node, total::BIGINT FROM l2""")
def hier_rollup(spark, d):
    return hier.roll_up(_links(spark, d), _counts(spark, d), 2)


_RANK = f"WITH {S.HIER}, g AS (SELECT parent, count(*) AS k, sum(n) AS s, avg(n) AS m, max(n) AS x, var_pop(n) AS vn FROM l JOIN cnt ON node = child GROUP BY parent HAVING count(*) > 3), v AS (SELECT *, vn / (s * s) AS v FROM g) SELECT parent, round(%s, 6) AS score FROM v"
for _o, _e in {"a": "m", "b": "ln(s) / (v + 0.1)", "c": "1 / (v + 0.1)", "d": "m / (v + 0.1)", "e": "CASE WHEN x / s > 0.5 THEN 0 ELSE s END"}.items():

    def _rank_query(spark, d, option=_o.upper()):
        return hier.rank_groups(_links(spark, d), _counts(spark, d), option).select("parent", r6("score"))

    QUERIES[f"hier_rank_{_o}"], ORACLE[f"hier_rank_{_o}"] = _rank_query, _RANK % _e


@query(f"WITH RECURSIVE {S.HIER}, p AS (SELECT DISTINCT parent AS root, child AS node, 1 AS length, relation AS path FROM l WHERE parent NOT IN (SELECT child FROM l) UNION ALL SELECT root, l.child, length + 1, path || '/' || relation FROM p JOIN l ON l.parent = p.node) SELECT * FROM p")
def hier_paths(spark, d):
    return hier.paths(_links(spark, d))


@query(f"WITH {S.HIER} SELECT DISTINCT child AS node, 'leaf' AS kind FROM l WHERE child NOT IN (SELECT parent FROM l) UNION ALL SELECT DISTINCT parent, 'root' FROM l WHERE parent NOT IN (SELECT child FROM l)")
def hier_ends(spark, d):
    l = _links(spark, d)
    return hier.leaves(l).select(F.col("child").alias("node"), F.lit("leaf").alias("kind")).unionByName(hier.roots(l).select(F.col("parent").alias("node"), F.lit("root").alias("kind")))


@query("""WITH f AS (SELECT 'c' || o_custkey AS subj, 'o' || o_orderkey AS obj, 'places' AS prop FROM orders UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'contains' FROM lineitem),
a AS (SELECT 'c' || c_custkey AS e FROM customer WHERE c_nationkey = 1), h1 AS (SELECT subj, obj, prop, 1 AS hop FROM f WHERE subj IN (SELECT e FROM a)), h2 AS (SELECT subj, obj, prop, 2 AS hop FROM f WHERE subj IN (SELECT obj FROM h1))
SELECT * FROM h1 UNION ALL SELECT * FROM h2""")
def kb_expand(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("subj"), F.concat(F.lit("o"), "o_orderkey").alias("obj"), F.lit("places").alias("prop"))
    li = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("subj"), F.concat(F.lit("p"), "l_partkey").alias("obj"), F.lit("contains").alias("prop")).distinct()
    start = table(spark, d, "customer").where("c_nationkey = 1").select(F.concat(F.lit("c"), "c_custkey").alias("entity"))
    return hier.expand(o.unionByName(li), start, 2)


def _hin(spark, d):
    o = table(spark, d, "orders").select(F.lit("customer").alias("src_type"), F.col("o_custkey").cast("string").alias("src"), F.lit("order").alias("dst_type"), F.col("o_orderkey").cast("string").alias("dst"), F.col("o_totalprice").alias("weight"), F.lit("places").alias("edge_type"))
    p = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"))
    return o.unionByName(p.select(F.lit("part").alias("src_type"), F.col("l_partkey").cast("string").alias("src"), F.lit("supplier").alias("dst_type"), F.col("l_suppkey").cast("string").alias("dst"), "weight", F.lit("from").alias("edge_type")))


@query(f"WITH {S.HIN} SELECT type, key, local_id, node_id FROM ids")
def hin_nodes(spark, d):
    return hin.node_ids(_hin(spark, d))


@query(f"WITH {S.HIN} SELECT edge_type, a.node_id AS src_id, b.node_id AS dst_id, round(weight, 4) AS weight FROM he JOIN ids a ON a.type = src_type AND a.key = src JOIN ids b ON b.type = dst_type AND b.key = dst")
def hin_encode(spark, d):
    e = cut(_hin(spark, d), "edges")
    return hin.encode_edges(e, cut(hin.node_ids(e), "nodes")).select("edge_type", "src_id", "dst_id", F.round("weight", 4).alias("weight"))


@query(f"WITH {S.HIN} SELECT edge_type, count(*) AS n, round(sum(weight), 2) AS weight FROM he GROUP BY edge_type")
def hin_stats(spark, d):
    return hin.edge_stats(_hin(spark, d)).select("edge_type", "n", F.round("weight", 2).alias("weight"))


@query(f"WITH {S.HIN} SELECT type, min(node_id) AS first_id, count(*) AS n FROM ids GROUP BY type")
def hin_offsets(spark, d):
    return hin.offsets(hin.node_ids(_hin(spark, d)))


def _vec_pairs(spark, d):
    v = _vecs(spark, d).where("vec is not null")
    a = v.select("doc_id", "vec", (F.col("doc_id") + 1).alias("other"))
    return a.join(v.select(F.col("doc_id").alias("other"), F.col("vec").alias("vec_b")), "other").select("doc_id", F.col("vec").alias("a"), F.col("vec_b").alias("b"))


@query("SELECT a.vec_id AS doc_id, round(1 / (1 + exp(-list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, 5) AS gap FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def edge_score(spark, d):
    p = _vec_pairs(spark, d)
    gap = F.aggregate(V.edge_rep(F.col("a"), F.col("b"), "diff"), F.lit(0.0), lambda s, x: s + x)
    return p.select("doc_id", r6(hin.link_score(F.col("a"), F.col("b")), "score"), F.round(gap, 5).alias("gap"))


_LOSS = f"{S.CENT}, s AS (SELECT e.vec_id, e.label = c.label AS own, list_dot_product(e.embedding::DOUBLE[], c.c) AS score FROM embeddings e, cent c), g AS (SELECT vec_id, max(score) FILTER (WHERE own) AS pos, list(score) FILTER (WHERE NOT own) AS neg FROM s GROUP BY vec_id)"


def _loss_rows(spark, d):
    v = _vecs(spark, d)
    s = assign.label_scores(v.drop("label"), cut(assign.centroids(v, "label", "vec", 64), "labels")).join(v.select("doc_id", F.col("label").alias("own")), "doc_id")
    return s.groupBy("doc_id").agg(F.max(F.when(F.col("label") == F.col("own"), F.col("score"))).alias("pos"), F.collect_list(F.when(F.col("label") != F.col("own"), F.col("score"))).alias("neg"))


@query(f"WITH {_LOSS} SELECT round(-avg(ln(1 / (1 + exp(-pos))) + list_sum(list_transform(neg, lambda x: ln(1 / (1 + exp(x))))) / 5), 6) AS loss FROM g")
def nce_loss(spark, d):
    return hin.nce_loss(_loss_rows(spark, d), 5).select(r6("loss"))


@query(f"WITH {_LOSS} SELECT round(avg(list_sum(list_transform(neg, lambda x: greatest(x - pos + 1, 0)))), 6) AS loss FROM g")
def hinge_loss(spark, d):
    return hin.hinge_loss(_loss_rows(spark, d)).select(r6("loss"))


# evaluation ---------------------------------------------------------------------------


def _news(spark, d):
    return current_rows(table(spark, d, "news"), ["doc_id"], "ingested_at")


_GOLD = f"{S.ASSIGN}, rel AS (SELECT sc.label, sc.doc_id, round(score, 9) AS score, (e.label = sc.label)::INT AS relevant FROM sc JOIN embeddings e ON e.vec_id = sc.doc_id)"


def _gold(spark, d):
    v = _vecs(spark, d)
    s = assign.label_scores(v.drop("label"), cut(assign.centroids(v, "label", "vec", 64), "labels"))
    return s.join(v.select("doc_id", F.col("label").alias("own")), "doc_id").select("label", "doc_id", F.round("score", 9).alias("score"), (F.col("label") == F.col("own")).cast("int").alias("relevant"))


@query(f"WITH {_GOLD}, g AS (SELECT label, score, count(*) AS n, sum(relevant) AS r FROM rel GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS cn, sum(r) OVER w AS cr FROM g WINDOW w AS (PARTITION BY label ORDER BY score DESC)) SELECT label, round(sum(r * cr / cn) / sum(r), 6) AS ap, round(sum(r) / sum(n), 6) AS positive_rate FROM c GROUP BY label")
def avg_precision(spark, d):
    return evalm.average_precision(_gold(spark, d), "label").select("label", r6("ap"), r6("positive_rate"))


@query(f"WITH {_GOLD}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, doc_id) - 1 AS position FROM rel) SELECT label, round(sum(relevant / ln(2 + position)), 6) AS dcg FROM k GROUP BY label")
def dcg(spark, d):
    r = evalm.positions(_gold(spark, d), "label", F.col("score").desc(), F.col("doc_id"))
    return evalm.dcg(r.withColumn("gain", F.col("relevant").cast("double")), "label").select("label", r6("dcg"))


@query(f"WITH {_GOLD}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, doc_id) AS rank FROM rel) SELECT label, k, round(sum(relevant) / k, 6) AS precision FROM k, (SELECT unnest([10, 15, 20, 25, 30]) AS k) x WHERE rank <= k GROUP BY label, k")
def precision_at_k(spark, d):
    first = top_k(_gold(spark, d), ["label"], [F.col("score").desc(), F.col("doc_id")], 30)
    return evalm.top_precision(first, "label", [10, 15, 20, 25, 30]).select("label", "k", r6("precision"))


@query("SELECT doc_id, list_filter(list_transform(x.t, lambda p: CASE string_split(p, '/')[-1] WHEN 'Courts' THEN 'law' WHEN 'Golf' THEN 'sport' END), lambda v: v IS NOT NULL)[-1] AS label FROM (SELECT doc_id, arg_max(struct_pack(t := type_path), ingested_at) AS x FROM news GROUP BY doc_id)")
def path_labels(spark, d):
    return readers.path_labels(_news(spark, d), "doc_id", "type_path", {"Courts": "law", "Golf": "sport"})


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_counts(spark, d):
    return counts.windowed_counts(table(spark, d, "events")).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))
