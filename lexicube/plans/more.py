"""Further queries: weighted vectors and similarities, votes over trees, hierarchies, networks, evaluation.

Each reaches one or two operators that the catalog's queries don't, with its SQL twin.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from lexicube.functions import text as T, vector as V
from lexicube.operators import assign, cooc, distinct, evalm, hier, hin, index, rank, sentence
from lexicube.operators.common import sample_k
from lexicube.plans import catalog as C, sql as S
from lexicube.plans.catalog import r6
from lexicube.session import cut, table
from lexicube.sources import readers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# text ---------------------------------------------------------------------------------


@query(f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(lower(text), '[0-9]', '', 'g'), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: trim(w, '{S._PUNCT}')), lambda w: w <> ''), ' ') AS words,
len(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '' AND NOT list_contains(['the', 'of', 'in', 'de', 'la', 'die'], w) AND replace(trim(w, '{S._PUNCT}'), '''s', '') <> '')) AS without_stopwords FROM documents WHERE text IS NOT NULL""")
def token_variants(spark, d):
    """Words without digits, and the number of words without stopwords."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(T.tokens_no_digits(F.col("text")), " ").alias("words"), F.size(T.tokens(F.col("text"), ["the", "of", "in", "de", "la", "die"])).alias("without_stopwords"))


@query(f"""WITH {S.TF}, v AS (SELECT phrase, row_number() OVER (ORDER BY sum(tf) DESC, phrase) AS id FROM tf GROUP BY phrase HAVING sum(tf) >= 10),
u AS (SELECT doc_id, unnest(t) AS phrase, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {S.tok('text')} AS t FROM documents WHERE text IS NOT NULL)),
g AS (SELECT doc_id, list(id ORDER BY i) FILTER (WHERE id IS NOT NULL) AS ids FROM u LEFT JOIN v USING (phrase) GROUP BY doc_id),
p AS (SELECT d.doc_id, list_resize(coalesce(ids, []), 40, 0) AS ids FROM documents d LEFT JOIN g USING (doc_id))
SELECT doc_id, array_to_string(ids, ' ') AS ids, list_sum(list_transform(ids, lambda x: (x = 0)::INT))::INT AS padded FROM p""")
def padded_docs(spark, d):
    """Every document as 40 word ids, with the number of filled places."""
    docs = table(spark, d, "documents")
    ids = index.encode(docs, "doc_id", T.tokens(F.col("text")), index.dictionary(C.word_tf(spark, d)))
    mask = F.aggregate(T.pad_mask(F.col("ids"), 40), F.lit(0), lambda a, x: a + x)
    return ids.select("doc_id", F.array_join(T.pad(F.col("ids"), 40), " ").alias("ids"), mask.alias("padded"))


_TAGGED = "regexp_replace({c}, '([a-z]+) ([a-z]+)', '<phrase>\\1 \\2</phrase>', 'g')"


@query(f"""WITH t AS (SELECT doc_id, {_TAGGED.format(c='text')} AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(x, '<phrase>(.*?)</phrase>', 1), lambda p: replace(lower(p), ' ', '_')), ' ') AS phrases,
array_to_string(list_filter(string_split_regex(lower(regexp_replace(x, '<phrase>([a-z]+) ([a-z]+)</phrase>', '\\1_\\2', 'g')), '[ \\t\\n\\r]+'), lambda w: w <> ''), ' ') AS tokens,
regexp_replace(x, '</?phrase>', '', 'g') = (SELECT any_value(text) FROM documents o WHERE o.doc_id = t.doc_id) AS plain FROM t""")
def segmented_text(spark, d):
    """Texts with tagged phrases: the phrases, the tokens with phrases joined, and the text without tags."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.regexp_replace("text", "([a-z]+) ([a-z]+)", "<phrase>$1 $2</phrase>").alias("x"))
    seg = readers.segmented(docs, "doc_id", "x")
    same = docs.select("doc_id", (T.strip_markup(F.col("x")) == F.col("text")).alias("plain"))
    return seg.join(same, "doc_id").select("doc_id", F.array_join("phrases", " ").alias("phrases"), F.array_join("tokens", " ").alias("tokens"), "plain")


@query(f"WITH {S.TF} SELECT DISTINCT doc_id, phrase FROM tf WHERE phrase IN (SELECT DISTINCT desk FROM news) OR length(phrase) > 12")
def phrase_tuples(spark, d):
    """Distinct (document, word) rows of linkable words: names of desks, or over twelve characters."""
    tf = C.word_tf(spark, d)
    linked = table(spark, d, "news").select(F.col("desk").alias("phrase")).where("phrase is not null").distinct()
    return tf.join(linked, "phrase", "left_semi").select("doc_id", "phrase").union(tf.where(F.length("phrase") > 12).select("doc_id", "phrase")).distinct()


@query(f"WITH {S.TF}, {S.IDF}, s AS (SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY tf * idf DESC, phrase) AS r FROM tf JOIN idf USING (phrase)) SELECT doc_id, phrase FROM s WHERE r <= 20")
def annotation_candidates(spark, d):
    """The 20 best words of every document in a seeded random order, as an annotator gets them."""
    top = index.tfidf_top(cut(C.word_tf(spark, d), "tf"), 20).select("doc_id", "phrase")
    return top.withColumn("h", F.xxhash64("phrase", F.lit(3))).sortWithinPartitions("doc_id", "h").select("doc_id", "phrase")


@query()
def sample_siblings(spark, d):
    """Ten documents of every source by a seeded hash."""
    return sample_k(table(spark, d, "documents").where("source is not null"), ["source"], "doc_id", 10, 7).select("source", "doc_id")


# distinctness -------------------------------------------------------------------------------


@query(f"WITH {S.PAIRS}, w2 AS (SELECT a, b, count(*) AS w FROM p GROUP BY ALL), n AS (SELECT phrase, count(*) AS n FROM (SELECT unnest(t) AS phrase FROM w) GROUP BY phrase) SELECT x.a, x.b, round(x.w / na.n - coalesce(y.w, 0) / nb.n, 6) AS lead FROM w2 x LEFT JOIN w2 y ON y.a = x.b AND y.b = x.a JOIN n na ON na.phrase = x.a JOIN n nb ON nb.phrase = x.b")
def directed_lead(spark, d):
    """How much more often a word stands before another than behind it."""
    pairs = C._pairs(spark, d).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    n = C.word_tf(spark, d).groupBy(F.col("phrase").alias("term")).agg(F.sum("tf").alias("n"))
    return distinct.directed_lead(cut(pairs, "pairs"), n).select("a", "b", r6("lead"))


@query(f"WITH {S.CUBE}, s AS (SELECT cell, phrase, log2(1 + tf) * d AS score FROM ds) SELECT cell, phrase, round(score, 6) AS score FROM (SELECT *, avg(score) OVER (PARTITION BY cell) AS m FROM s) WHERE score > m")
def above_average(spark, d):
    """Phrases that score above the mean of their cell."""
    return distinct.above_average(cut(C._scores(spark, d, "A").select("cell", "phrase", "score"), "scores"), "cell").select("cell", "phrase", r6("score"))


@query(f"WITH {S.CUBE}, sh AS (SELECT cell, tf / sum(tf) OVER (PARTITION BY cell) AS p, count(*) OVER (PARTITION BY cell) AS n FROM cc) SELECT cell, round(-sum(p * ln(p + 0.0001)), 6) AS plain, round(-sum(p * ln(p + 0.0001)) / ln(any_value(n)), 6) AS normal FROM sh GROUP BY cell")
def cell_entropy(spark, d):
    """Entropy of the phrases of every cell, plain and over ln(n)."""
    c = cut(C.cube.cell_counts(C.mined_tf(spark, d), C._cells(spark, d)), "cells")
    sums = c.groupBy("cell").agg(F.sum("tf").alias("t"), F.count(F.lit(1)).alias("n"))
    s = c.join(sums, "cell").withColumn("p", F.col("tf") / F.col("t"))
    return s.groupBy("cell").agg(F.round(distinct.entropy(F.col("p")), 6).alias("plain"), F.round(distinct.entropy(F.col("p"), F.max("n")), 6).alias("normal"))


# the vectors of the documents, by a phrase vector: that of the document whose number it has
_PV = "pv AS (SELECT phrase, embedding::DOUBLE[] AS vec FROM (SELECT phrase, row_number() OVER (ORDER BY phrase) - 1 AS vec_id FROM (SELECT DISTINCT phrase FROM dp)) JOIN embeddings USING (vec_id))"
_WVEC = """wv AS (SELECT doc_id, list(s ORDER BY i) AS vec FROM (SELECT doc_id, i, sum(w * x) / sum(w) AS s FROM (SELECT doc_id, {w} AS w, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM {rows}) GROUP BY ALL HAVING sum(w) <> 0) GROUP BY doc_id)"""
_KL1 = """hard AS (SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r FROM {s}) WHERE r = 1),
{n}m AS (SELECT phrase, label, sum(tf) AS m FROM dp JOIN hard USING (doc_id) GROUP BY ALL), {n}q AS (SELECT phrase, m / sum(m) OVER (PARTITION BY phrase) AS p FROM {n}m), {n} AS (SELECT phrase, coalesce(kl, 0) AS kl FROM (SELECT DISTINCT phrase FROM dp) LEFT JOIN (SELECT phrase, sum(p * ln(p * (SELECT count(DISTINCT label) FROM {s}))) AS kl FROM {n}q WHERE p > 0 GROUP BY phrase) USING (phrase))"""


def _phrase_vectors(spark, d, tf):
    names = tf.select("phrase").distinct().withColumn("vec_id", F.row_number().over(Window.orderBy("phrase")) - 1)  # a test's way to give phrases vectors
    return cut(names.join(table(spark, d, "embeddings"), "vec_id").select("phrase", F.col("embedding").alias("vec")), "phrase_vectors")


@query(f"WITH {S.DP}, {_PV}, {S.CENT}, sc AS (SELECT vec_id AS doc_id, c.label, list_dot_product(e.embedding::DOUBLE[], c.c) AS score FROM embeddings e, cent c), {_KL1.format(n='k', s='sc')}, r AS (SELECT doc_id, tf * kl AS w, vec FROM dp JOIN k USING (phrase) JOIN pv USING (phrase)), {_WVEC.format(w='w', rows='r')} SELECT doc_id, round(vec[1], 6) AS first, round(vec[64], 6) AS last FROM wv")
def weighted_vectors(spark, d):
    """Document vectors as means of phrase vectors, weighted by counts and distinctness."""
    v, tf = C._vecs(spark, d), cut(C.mined_tf(spark, d), "tf")
    kl = cut(distinct.distinct_map(tf, assign.label_scores(v.drop("label"), cut(assign.centroids(v, "label", "vec", 64), "labels")), soft=False), "map")
    out = distinct.weighted_vectors(tf, kl, _phrase_vectors(spark, d, tf), 64).where("vec is not null")
    return out.select("doc_id", F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(F.get("vec", F.lit(63)), 6).alias("last"))


_SEED = "seed AS (SELECT phrase, (row_number() OVER (ORDER BY sum(tf) DESC, phrase) - 1) % 5 AS label FROM dp GROUP BY phrase QUALIFY row_number() OVER (ORDER BY sum(tf) DESC, phrase) <= 20)"


@query(f"""WITH {S.DP}, {_PV}, {_SEED}, {S.CENT}, s1 AS (SELECT doc_id, label, sum(tf)::DOUBLE AS score FROM dp JOIN seed USING (phrase) GROUP BY ALL), {_KL1.format(n='k', s='s1')},
r AS (SELECT doc_id, tf * kl AS w, vec FROM dp JOIN k USING (phrase) JOIN pv USING (phrase)), {_WVEC.format(w='w', rows='r')}, s2 AS (SELECT doc_id, label, list_dot_product(vec, c) AS score FROM wv, cent), {_KL1.format(n='k2', s='s2').replace('hard', 'hard2')}
SELECT phrase, round(kl, 6) AS kl FROM k2""")
def distinct_map_twice(spark, d):
    """Distinctness in two rounds from twenty seed phrases."""
    v, tf = C._vecs(spark, d), cut(C.mined_tf(spark, d), "tf")
    total = tf.groupBy("phrase").agg(F.sum("tf").alias("n")).orderBy(F.col("n").desc(), "phrase").limit(20)
    seeds = cut(total.select("phrase", ((F.row_number().over(Window.orderBy(F.col("n").desc(), "phrase")) - 1) % 5).alias("label")), "seeds")
    return distinct.distinct_map_twice(tf, seeds, _phrase_vectors(spark, d, tf), cut(assign.centroids(v, "label", "vec", 64), "labels")).select("phrase", r6("kl"))


# similarities ---------------------------------------------------------------------------------


@query(f"WITH {S.CENT} SELECT * FROM (SELECT vec_id AS doc_id, c.label, round(list_cosine_similarity(e.embedding::DOUBLE[], c.c), 6) AS score FROM embeddings e, (SELECT label, c FROM cent) c) WHERE score > 0.2 AND score < 0.5")
def similarity_band(spark, d):
    """Documents neither too like nor too unlike a label."""
    v = C._vecs(spark, d)
    s = assign.label_scores(v.drop("label"), cut(assign.centroids(v, "label", "vec", 64), "labels"), "cosine").withColumn("score", F.round("score", 6))
    return assign.within_band(s, 0.2, 0.5)


_MM = "mm AS (SELECT a.label AS g, b.label AS o, avg(m) AS similarity FROM (SELECT a.vec_id, a.label, b.label AS l2, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS m FROM embeddings a, embeddings b WHERE b.vec_id % 10 = 3 AND b.vec_id < 200 GROUP BY ALL) a JOIN (SELECT DISTINCT label FROM embeddings) b ON b.label = l2 GROUP BY ALL)"


def _mean_max(spark, d):
    v = C._vecs(spark, d).select(F.col("label").alias("group"), "vec", "doc_id")
    return assign.mean_max_similarity(v, v.where("doc_id % 10 = 3 and doc_id < 200"))


@query(f"WITH {_MM} SELECT g AS label, o AS other, round(similarity, 6) AS similarity FROM mm")
def mean_max_similarity(spark, d):
    """How like a label's vectors are to twenty key vectors, by the labels of those."""
    return _mean_max(spark, d).select(F.col("group").alias("label"), "other", r6("similarity"))


@query(f"WITH {_MM}, {S.ASSIGN}, w AS (SELECT label, avg(score) AS w FROM (SELECT label, score FROM best QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC) <= 10) GROUP BY label), s AS (SELECT g AS label, avg(similarity) AS s FROM (SELECT * FROM mm QUALIFY row_number() OVER (PARTITION BY g ORDER BY similarity DESC) <= 5) GROUP BY g) SELECT label AS cluster, round(w * s, 6) AS score FROM w JOIN s USING (label)")
def cluster_scores(spark, d):
    """Labels by their ten best assignments and their five best similarities."""
    s = _mean_max(spark, d).select(F.col("group").alias("cluster"), F.col("similarity").alias("score"))
    return assign.cluster_scores(s, C._assigned(spark, d).select(F.col("label").alias("cluster"), "score")).select("cluster", r6("score"))


@query(f"""WITH {S.DP}, {_PV}, m AS (SELECT doc_id, set_id, embedding::DOUBLE[] AS vec FROM documents JOIN embeddings ON vec_id = doc_id WHERE set_id IS NOT NULL),
mean AS (SELECT set_id, list(s ORDER BY i) AS mean FROM (SELECT set_id, i, avg(x) AS s FROM (SELECT set_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM m) GROUP BY ALL) GROUP BY set_id),
ph AS (SELECT DISTINCT set_id, phrase FROM dp JOIN documents USING (doc_id) WHERE set_id IS NOT NULL)
SELECT set_id, phrase, round(coalesce(list_cosine_similarity(vec, mean), 0), 6) AS score FROM ph JOIN mean USING (set_id) LEFT JOIN pv USING (phrase)""")
def phrase_to_mean(spark, d):
    """Phrases of a set by their cosine with the mean vector of its documents."""
    tf = cut(C.mined_tf(spark, d), "tf")
    sets = table(spark, d, "documents").where("set_id is not null").select("doc_id", "set_id")
    mean = sets.join(C._vecs(spark, d), "doc_id").select("set_id", "vec")
    return assign.similarity_to_mean(tf.join(sets, "doc_id").select("set_id", "phrase").distinct(), _phrase_vectors(spark, d, tf), mean, 64).select("set_id", "phrase", r6("score"))


@query(f"""WITH {S.DP}, {_PV}, f AS (SELECT vec AS fv FROM pv ORDER BY phrase LIMIT 1), t AS (SELECT phrase, sum(tf) AS n FROM dp GROUP BY phrase)
SELECT phrase, round(list_cosine_similarity(coalesce(vec, fv), fv), 6) AS score FROM t LEFT JOIN pv USING (phrase), f""")
def fallback_cosine(spark, d):
    """Cosine of every phrase with the first one; phrases without a vector take that of the first."""
    tf = cut(C.mined_tf(spark, d), "tf")
    pv = _phrase_vectors(spark, d, tf)
    first = F.broadcast(pv.orderBy("phrase").limit(1).select(F.col("vec").alias("fv")))  # one row
    j = tf.select("phrase").distinct().join(pv, "phrase", "left").join(first)
    return j.select("phrase", F.round(V.cosine(F.coalesce("vec", "fv"), F.col("fv")), 6).alias("score"))


@query("WITH c AS (SELECT a.vec_id AS a, b.vec_id AS b, b.vec_id - a.vec_id AS n, a.embedding::DOUBLE[] AS va, b.embedding::DOUBLE[] AS vb FROM embeddings a JOIN embeddings b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 3) SELECT a, b, round(n * abs(coalesce(CASE WHEN a % 7 > 0 AND b % 7 > 0 THEN list_cosine_similarity(va, vb) END, 0)), 6) AS w FROM c")
def similarity_weighted(spark, d):
    """Counts weighted by the absolute cosine of the terms' vectors; a seventh of the terms has none."""
    v = C._vecs(spark, d).select(F.col("doc_id").alias("term"), "vec")
    pairs = v.select(F.col("term").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).select("a", (F.col("a") + F.col("n")).alias("b"), F.col("n"))
    pairs = pairs.join(v.select(F.col("term").alias("b")), "b", "left_semi")
    return cooc.similarity_weighted(pairs, v.where("term % 7 > 0")).select("a", "b", r6("w"))


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
m AS (SELECT label, list(s ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS s FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u WHERE vec_id % 10 = 0) GROUP BY ALL) GROUP BY label)
SELECT label, vec_id AS doc_id, round(list_dot_product(u, m), 6) AS similarity, row_number() OVER (PARTITION BY label ORDER BY list_dot_product(u, m) DESC, vec_id) AS rank FROM u JOIN m USING (label) WHERE vec_id % 10 <> 0""")
def members_by_similarity(spark, d):
    """Members of a label by their mean cosine to its targets (a tenth of its vectors)."""
    return assign.members_by_similarity(C._vecs(spark, d), "label", F.col("doc_id") % 10 == 0).select("label", "doc_id", r6("similarity"), "rank")


@query()
def kmeans_sizes(spark, d):
    """Clusters of the vectors by direction, with the most frequent label of each."""
    v = C._vecs(spark, d)
    c = assign.spherical_kmeans(v.select("doc_id", "vec"), 10)
    per = c.join(v.select("doc_id", "label"), "doc_id").groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("cluster").agg(F.sum("n").alias("size"), F.max_by("label", F.struct("n", -F.col("label"))).alias("label"), F.max("n").alias("with_label"))


@query("SELECT doc_id, coalesce(label, -1) AS cluster FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def cluster_membership(spark, d):
    """The cluster (here: label) of every document, -1 without one."""
    return assign.membership(C._vecs(spark, d).select("doc_id", F.col("label").alias("cluster")), table(spark, d, "documents"))


_DIV = """r AS (SELECT label AS set_id, vec_id::VARCHAR AS phrase, (vec_id % 17 + 1) / 17.0::DOUBLE AS score, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
sm AS MATERIALIZED (SELECT a.set_id, a.phrase AS i, b.phrase AS j, a.score * b.score * list_dot_product(a.u, b.u) AS x FROM r a JOIN r b USING (set_id)), base AS MATERIALIZED (SELECT set_id, i, sum(x) AS g FROM sm GROUP BY ALL),
p1 AS (SELECT set_id, arg_max(i, struct_pack(v := round(g, 9), k := -i::INT)) AS p FROM base GROUP BY set_id),
b2 AS (SELECT b.set_id, b.i, g - s.x AS g FROM base b JOIN p1 USING (set_id) JOIN sm s ON s.set_id = b.set_id AND s.i = b.i AND s.j = p WHERE b.i <> p), p2 AS (SELECT set_id, arg_max(i, struct_pack(v := round(g, 9), k := -i::INT)) AS p FROM b2 GROUP BY set_id),
b3 AS (SELECT b.set_id, b.i, g - s.x AS g FROM b2 b JOIN p2 USING (set_id) JOIN sm s ON s.set_id = b.set_id AND s.i = b.i AND s.j = p WHERE b.i <> p), p3 AS (SELECT set_id, arg_max(i, struct_pack(v := round(g, 9), k := -i::INT)) AS p FROM b3 GROUP BY set_id)"""


@query(f"WITH {_DIV} SELECT set_id, p AS phrase, 1 AS pick FROM p1 UNION ALL SELECT set_id, p, 2 FROM p2 UNION ALL SELECT set_id, p, 3 FROM p3")
def diverse_vectors(spark, d):
    """Three vectors of every label by diversified ranking."""
    rows = C._vecs(spark, d).select(F.col("label").alias("set_id"), F.col("doc_id").cast("string").alias("phrase"), ((F.col("doc_id") % 17 + 1) / 17.0).alias("score"), "vec")
    return C.select.select_phrases(rows, 3)


# votes over a tree ----------------------------------------------------------------------------

_VOTES = f"{S.ASSIGN}, votes AS (SELECT set_id, 'l' || b.label AS label, count(*) AS votes FROM best b JOIN documents d ON d.doc_id = b.doc_id WHERE set_id IS NOT NULL GROUP BY ALL), tree AS (SELECT 'l' || i AS child, CASE WHEN i < 3 THEN 'low' ELSE 'high' END AS parent FROM range(10) t(i)), mass AS (SELECT set_id, parent AS top, sum(votes) AS v FROM votes JOIN tree ON child = label GROUP BY ALL)"


def _votes(spark, d):
    sets = table(spark, d, "documents").where("set_id is not null").select("doc_id", "set_id")
    v = C._assigned(spark, d).join(sets, "doc_id").groupBy("set_id", F.concat(F.lit("l"), "label").alias("label")).agg(F.count(F.lit(1)).alias("votes"))
    rows = [("low" if i < 3 else "high", f"l{i}") for i in range(10)] + [("root", "low"), ("root", "high")]
    return cut(v, "votes"), spark.createDataFrame(rows, "parent string, child string")


@query(f"WITH {_VOTES}, t AS (SELECT set_id, top, v / sum(v) OVER (PARTITION BY set_id) AS s FROM mass), f AS (SELECT set_id, arg_max(top, s) AS top, max(s) AS s FROM t GROUP BY set_id), g AS (SELECT v.set_id, label, parent, votes / sum(votes) OVER (PARTITION BY v.set_id, parent) AS s FROM votes v JOIN tree ON child = label), h AS (SELECT set_id, parent, arg_max(label, struct_pack(s := s, k := -substr(label, 2)::INT)) AS label, max(s) AS s FROM g GROUP BY ALL) SELECT f.set_id, CASE WHEN f.s <= 0.6 THEN 'root' WHEN h.s > 0.6 THEN h.label ELSE f.top END AS node FROM f JOIN h ON h.set_id = f.set_id AND h.parent = f.top")
def descend_votes(spark, d):
    """From the root of a tree of labels down while one child has over 60 % of a set's votes."""
    v, tree = _votes(spark, d)
    return assign.descend(v, tree, "root")


@query(f"WITH {_VOTES}, e AS (SELECT set_id, -sum(p * ln(p + 0.0001)) AS entropy FROM (SELECT set_id, v / sum(v) OVER (PARTITION BY set_id) AS p FROM mass) GROUP BY set_id), t AS (SELECT set_id, arg_max(top, struct_pack(v := v, k := CASE top WHEN 'high' THEN 1 ELSE 0 END)) AS top FROM mass GROUP BY set_id), l AS (SELECT v.set_id, t.top, arg_max(label, struct_pack(v := votes, k := -substr(label, 2)::INT)) AS label FROM votes v JOIN tree ON child = label JOIN t ON t.set_id = v.set_id AND t.top = parent GROUP BY ALL) SELECT l.set_id, top, label, round(entropy, 6) AS entropy FROM l JOIN e USING (set_id)")
def two_level_vote(spark, d):
    """The group of labels with most votes of a set, then its label with most."""
    v, tree = _votes(spark, d)
    return assign.two_level_vote(v, tree, "root").select("set_id", "top", "label", r6("entropy"))


@query(f"WITH {_VOTES}, b AS (SELECT set_id, arg_max(label, struct_pack(v := votes, k := -substr(label, 2)::INT)) AS label FROM votes GROUP BY set_id), s AS (SELECT b.set_id, b.label, o.child AS other, coalesce(votes, 0) + 0.001 AS v FROM b JOIN tree t ON t.child = b.label JOIN tree o ON o.parent = t.parent LEFT JOIN votes ON votes.set_id = b.set_id AND votes.label = o.child) SELECT set_id, label, round(sum(v) FILTER (WHERE other = label) / sum(v), 6) AS share, array_to_string(list(other ORDER BY other) FILTER (WHERE other <> label), ' ') AS siblings FROM s GROUP BY ALL")
def bottom_up_vote(spark, d):
    """The label with most votes of a set, its share among its siblings, and those."""
    v, tree = _votes(spark, d)
    return assign.bottom_up(v, tree).select("set_id", "label", r6("share"), F.array_join("siblings", " ").alias("siblings"))


# hierarchies and facts ------------------------------------------------------------------------


@query(f"WITH {S.HIER} SELECT DISTINCT 'in_region' AS path FROM l UNION ALL SELECT 'in_region/in_nation'")
def concept_paths(spark, d):
    return hier.concept_paths(C._links(spark, d))


@query(f"WITH {S.HIER} SELECT a.child AS node FROM l a JOIN l b ON a.parent = b.child WHERE b.parent = 'r1'")
def follow_relations(spark, d):
    """What lies below one region along region and nation links."""
    return hier.follow(C._links(spark, d), "r1", ["in_region", "in_nation"])


@query(f"WITH {S.HIER} SELECT a.child AS node, b.parent AS top, b.relation || '/' || a.relation AS path FROM l a JOIN l b ON a.parent = b.child WHERE a.level = 1 AND a.child LIKE 's%'")
def upward_paths(spark, d):
    """Ways from the suppliers up to their regions."""
    links = C._links(spark, d)
    return hier.upward_paths(links, links.where("level = 1 and child like 's%'").select(F.col("child").alias("node")))


_FACTS = "f AS (SELECT 'c' || o_custkey AS subj, 'o' || o_orderkey AS obj, 'places' AS prop, 1 AS hop FROM orders UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'contains', 2 FROM lineitem)"


def _facts(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("subj"), F.concat(F.lit("o"), "o_orderkey").alias("obj"), F.lit("places").alias("prop"), F.lit(1).alias("hop"))
    li = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("subj"), F.concat(F.lit("p"), "l_partkey").alias("obj"), F.lit("contains").alias("prop"), F.lit(2).alias("hop")).distinct()
    return o.unionByName(li)


@query(f"WITH {_FACTS} SELECT DISTINCT subj AS child, 'buying' AS parent, prop AS relation, hop AS level FROM f WHERE prop = 'places' UNION ALL SELECT 'buying', 'trade', 'is_a', 3")
def hierarchy_from_facts(spark, d):
    """A hierarchy in which an entity's parent is the category of its property."""
    cats, upper = spark.createDataFrame([("places", "buying")], "prop string, category string"), spark.createDataFrame([("buying", "trade")], "child string, parent string")
    return hier.build(_facts(spark, d), cats, upper)


@query(f"WITH {_FACTS} SELECT DISTINCT subj AS child, obj AS parent, prop AS relation, hop AS level FROM f UNION ALL SELECT 'buying', 'trade', 'is_a', 3")
def hierarchy_of_entities(spark, d):
    """A hierarchy in which an entity's parent is the object of its fact."""
    none = spark.createDataFrame([], "prop string, category string")
    return hier.build(_facts(spark, d), none, spark.createDataFrame([("buying", "trade")], "child string, parent string"), "E")


@query(f"WITH {_FACTS}, e AS (SELECT 'o' || o_orderkey AS x FROM orders WHERE o_totalprice > 200000 UNION SELECT 'c' || c_custkey FROM customer WHERE c_nationkey < 5) SELECT f.* FROM f WHERE subj IN (SELECT x FROM e) AND obj IN (SELECT x FROM e)")
def facts_between(spark, d):
    """Facts between customers of five nations and dear orders."""
    e = table(spark, d, "orders").where("o_totalprice > 200000").select(F.concat(F.lit("o"), "o_orderkey").alias("entity")).union(table(spark, d, "customer").where("c_nationkey < 5").select(F.concat(F.lit("c"), "c_custkey")))
    return hier.facts_between(_facts(spark, d), e)


@query("SELECT 'p' || l_partkey AS dst FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 4")
def supported_nodes(spark, d):
    """Parts that four suppliers or more deliver."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return hier.supported(e, 4)


@query(f"WITH {S.HIER}, k AS (SELECT parent, relation FROM l WHERE parent NOT IN ('n3', 'n7') GROUP BY ALL HAVING count(*) >= 60) SELECT l.child, l.parent, l.relation, l.level FROM l JOIN k USING (parent, relation)")
def pruned_links(spark, d):
    """Links of groups of 60 children or more, without two parents."""
    return hier.prune_groups(C._links(spark, d), 60, ["n3", "n7"]).select("child", "parent", "relation", "level")


@query(f"WITH {S.HIER} SELECT node, n FROM cnt WHERE n >= 15")
def dense_nodes(spark, d):
    return hier.dense_nodes(C._counts(spark, d), 15)


_LINKS2 = "lk AS (SELECT phrase AS child, source AS parent FROM dp JOIN documents USING (doc_id) WHERE source IN ('wire', 'metro_daily', 'preprint') GROUP BY ALL)"


@query(f"WITH {S.DP}, {_LINKS2}, one AS (SELECT child, min(parent) AS parent FROM lk GROUP BY child HAVING count(*) = 1), s AS (SELECT parent, child AS phrase, count(*) AS df FROM one JOIN dp ON phrase = child GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY df DESC, phrase) AS rank FROM s) SELECT * FROM r WHERE rank <= 3")
def seed_phrases(spark, d):
    """The three most held phrases that belong to just one of three sources."""
    tf = cut(C.mined_tf(spark, d), "tf")
    docs = table(spark, d, "documents").where("source in ('wire', 'metro_daily', 'preprint')").select("doc_id", F.col("source").alias("parent"))
    links = tf.join(docs, "doc_id").select(F.col("phrase").alias("child"), "parent").distinct()
    return index.seeds(tf, links).select("parent", "phrase", "df", "rank")


# networks ---------------------------------------------------------------------------------------


@query("""WITH RECURSIVE ed AS (SELECT o_custkey AS src, l_suppkey AS dst, count(*)::DOUBLE AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
al AS (SELECT 'c' || src AS src, 's' || dst AS dst, w FROM ed UNION ALL SELECT 's' || dst, 'c' || src, w FROM ed), pr AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM al), nd AS (SELECT DISTINCT src AS node FROM al),
bi AS (SELECT node, coalesce(c_acctbal, 0) AS b FROM nd LEFT JOIN (SELECT 'c' || c_custkey AS node, greatest(c_acctbal, 0) AS c_acctbal FROM customer) USING (node)), tot AS (SELECT sum(greatest(c_acctbal, 0)) AS t FROM customer),
it AS (SELECT 0 AS r, node, b / t AS s, b / t AS b FROM bi, tot UNION ALL SELECT any_value(r) + 1, node, 0.5 * max(b) + 0.5 * sum(x), max(b) FROM (SELECT it.r, pr.dst AS node, pr.p * it.s AS x, 0 AS b FROM it JOIN pr ON pr.src = it.node WHERE it.r < 4 UNION ALL SELECT it.r, it.node, 0, it.b FROM it WHERE it.r < 4) GROUP BY node)
SELECT node, round(s, 9) AS score FROM it WHERE r = 4""")
def biased_pagerank(spark, d):
    """Walk on customers and suppliers that returns to customers by their balance."""
    e = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("w"))
    a, b = F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("s"), "l_suppkey")
    both = e.select(a.alias("src"), b.alias("dst"), "w").unionByName(e.select(b.alias("src"), a.alias("dst"), "w"))
    bias = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.greatest("c_acctbal", F.lit(0.0)).cast("double").alias("weight"))
    return rank.pagerank_large(both, 0.5, 4, bias).select("node", F.round("score", 9).alias("score"))


@query(f"WITH {S.HIN} SELECT node_id, type || ':' || key AS name FROM ids WHERE node_id % 3 = 0")
def decoded_nodes(spark, d):
    """Global ids back to typed names, for a third of the ids."""
    n = cut(hin.node_ids(C._hin(spark, d)), "nodes")
    return hin.decode(n.where("node_id % 3 = 0").select("node_id"), n)


@query(f"WITH {S.HIN}, lb AS (SELECT i::VARCHAR AS label FROM range(0, 400) t(i)) SELECT label, local_id, true AS found FROM lb JOIN ids ON key = label AND type = 'supplier' UNION ALL SELECT label, -1, false FROM lb WHERE label NOT IN (SELECT key FROM ids WHERE type = 'supplier')")
def linked_labels(spark, d):
    """Labels that are supplier nodes, with ids, and those that are not."""
    labels = spark.range(400).select(F.col("id").cast("string").alias("label"))
    found, missed = hin.link_labels(labels, cut(hin.node_ids(C._hin(spark, d)), "nodes"), "supplier")
    return found.select("label", "local_id", F.lit(True).alias("found")).unionByName(missed.select("label", F.lit(-1).cast("long").alias("local_id"), F.lit(False).alias("found")))


@query("SELECT o_orderkey AS i, n_name FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) JOIN nation ON n_nationkey = i % 25")
def cyclic_pairs(spark, d):
    """Orders zipped with the nations, which are repeated."""
    orders = C.evalm.running(table(spark, d, "orders").select("o_orderkey"), [], [F.col("o_orderkey")], {"i": F.lit(1)}).withColumn("i", F.col("i") - 1)
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), "n_name")
    return hin.cyclic_zip(orders, nations).select(F.col("o_orderkey").alias("i"), "n_name")


@query("""WITH p AS (SELECT a.vec_id AS doc_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT doc_id, round(list_sum(list_transform(list_zip(a, b), lambda x: (x[1] + x[2]) ** 2)), 5) AS total, round(list_sum(a) * list_sum(b), 5) AS outer_sum, round(list_sum(list_transform(list_zip(a, b), lambda x: x[1] * x[2] * 0.5)), 5) AS scaled, round(1 / (1 + exp(-2 * list_dot_product(a, b))), 6) AS scored, round(sqrt(list_dot_product(a, a)) * least(1, 0.5 / sqrt(list_dot_product(a, a))), 5) AS clipped FROM p""")
def edge_forms(spark, d):
    """Edge representations, weighted products, scaled scores and clipped vectors."""
    p, a, b = C._vec_pairs(spark, d), F.col("a"), F.col("b")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    half = F.transform(a.cast("array<double>"), lambda x: F.lit(0.5))
    return p.select("doc_id", F.round(add(V.edge_rep(a, b, "sum")), 5).alias("total"), F.round(add(V.edge_rep(a, b, "outer")), 5).alias("outer_sum"), F.round(hin.distmult(a, half, b), 5).alias("scaled"), r6(hin.link_score(a, b, "mul", [2.0] * 64), "scored"), F.round(V.norm(hin.clip_norm(a, 0.5)), 5).alias("clipped"))


@query(f"WITH {S.HIN} SELECT edge_type, src_type, src, dst_type, dst, round(weight, 4) AS weight FROM he WHERE edge_type = 'from'")
def bad_edges(spark, d):
    """Edges whose end types differ from a schema that gives one type wrongly."""
    schema = spark.createDataFrame([("places", "customer", "order"), ("from", "supplier", "part")], "edge_type string, src_type string, dst_type string")
    return hin.bad_edges(C._hin(spark, d), schema).select("edge_type", "src_type", "src", "dst_type", "dst", F.round("weight", 4).alias("weight"))


# windows ----------------------------------------------------------------------------------------


@query(f"WITH w AS (SELECT doc_id, {S.tok('text')} AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id AS key, array_to_string(t[i - 3 : i - 1], ' ') AS context, t[i] AS word FROM (SELECT doc_id, t, generate_subscripts(t, 1) AS i FROM w) WHERE i > 3")
def left_windows(spark, d):
    c = cooc.left_windows(table(spark, d, "documents"), "doc_id", T.tokens(F.col("text")), 3)
    return c.select("key", F.array_join("context", " ").alias("context"), "word")


# evaluation -------------------------------------------------------------------------------------

_NEWS = f"""nw AS (SELECT doc_id AS id, coalesce({S.tok("array_to_string(x.a, ' ')")}, []) AS abstract, coalesce({S.tok("array_to_string(x.c, ' ')")}, []) AS content, x.p AS phrases FROM (SELECT doc_id, arg_max(struct_pack(a := abstract_sents, c := content_sents, p := phrases), ingested_at) AS x FROM news GROUP BY doc_id))"""
_FRAG = """an AS (SELECT id, unnest(abstract) AS t, generate_subscripts(abstract, 1) AS i FROM nw), co AS (SELECT id, unnest(content) AS t, generate_subscripts(content, 1) AS j FROM nw),
mt AS (SELECT id, i, j, i - row_number() OVER (PARTITION BY id, j - i ORDER BY i) AS isle FROM an JOIN co USING (id, t)),
ru AS MATERIALIZED (SELECT id, i, max(stop) - i + 1 AS n FROM (SELECT id, i, max(i) OVER (PARTITION BY id, j - i, isle) AS stop FROM mt) {skip} GROUP BY id, i),
go AS (SELECT id, 1 AS i, 0::BIGINT AS n FROM nw UNION ALL SELECT id, i + greatest(coalesce(k, 0), 1), coalesce(k, 0) FROM (SELECT go.id, go.i, r.n AS k FROM go JOIN nw ON nw.id = go.id AND go.i <= len(nw.abstract) LEFT JOIN ru r ON r.id = go.id AND r.i = go.i)),
fr AS (SELECT go.id, go.i - go.n AS i, go.n, array_to_string(abstract[go.i - go.n : go.i - 1], ' ') AS text FROM go JOIN nw ON nw.id = go.id WHERE go.n > 1)"""
_PLAIN = _FRAG.format(skip="")


def _texts(spark, d):
    words = lambda c: F.coalesce(T.tokens(F.array_join(c, " ")), F.array().cast("array<string>"))
    return cut(C._news(spark, d).select(F.col("doc_id").alias("id"), words("abstract_sents").alias("abstract"), words("content_sents").alias("content"), "phrases"), "news")


@query(f"WITH RECURSIVE {_NEWS}, {_PLAIN}, s AS (SELECT id, sum(n) AS s, sum(n * n) AS q FROM fr GROUP BY id) SELECT id, round(coalesce(s, 0) / (len(abstract) + 0.01), 6) AS coverage, round(coalesce(q, 0) / (len(abstract) + 0.01), 6) AS density, round(CASE WHEN len(abstract) > 0 THEN len(content) / len(abstract) ELSE 0 END, 6) AS compression FROM nw LEFT JOIN s USING (id)")
def extractive_fragments(spark, d):
    """Coverage, density and compression of the abstracts of the current news."""
    p = _texts(spark, d)
    return evalm.fragment_measures(evalm.extractive_fragments(p), p).select("id", r6("coverage"), r6("density"), r6("compression"))


_FUNCTION = ("in", "of", "on", "at", "by", "for")


@query(f"WITH RECURSIVE {_NEWS}, {_FRAG.format(skip=f'WHERE (id, i) NOT IN (SELECT id, i FROM an WHERE t IN {_FUNCTION})')} SELECT id, i::INT - 1 AS first, n::INT AS n, text FROM fr")
def skipped_fragments(spark, d):
    """The fragments when none may start at a function word."""
    p = _texts(spark, d)
    skip = F.filter(F.transform("abstract", lambda t, i: F.when(t.isin(*_FUNCTION), i)), lambda i: i.isNotNull())
    f = evalm.extractive_fragments(p.withColumn("skip", skip)).join(p.select("id", "abstract"), "id")
    return _placed(f)


def _placed(f: DataFrame) -> DataFrame:
    """Fragments with their first position; a record's fragments are in order."""
    w = Window.partitionBy("id", F.array_join("fragment", " ")).orderBy(F.monotonically_increasing_id())
    starts = F.filter(F.transform("abstract", lambda t, i: F.when(F.slice("abstract", i + 1, F.size("fragment")) == F.col("fragment"), i)), lambda i: i.isNotNull())
    return f.withColumn("k", F.row_number().over(w)).select("id", F.element_at(starts, F.col("k")).alias("first"), "n", F.array_join("fragment", " ").alias("text"))


@query(f"""WITH RECURSIVE {_NEWS}, {_PLAIN}, ph AS (SELECT DISTINCT id, {S.CANON.format('p')} AS phrase FROM (SELECT id, unnest(phrases) AS p FROM nw) WHERE p IS NOT NULL),
n AS (SELECT id, count(*) AS n FROM fr GROUP BY id), h AS (SELECT ph.id, count(DISTINCT phrase) AS hit FROM ph JOIN fr ON fr.id = ph.id WHERE phrase <> '' AND contains(text, phrase) GROUP BY ph.id)
SELECT id, round(coalesce(hit, 0) / n, 6) AS precision FROM n LEFT JOIN h USING (id)""")
def fragment_match(spark, d):
    """Phrases found in the extractive fragments of their record over the number of fragments."""
    p = _texts(spark, d)
    frags = evalm.extractive_fragments(p).select("id", F.array_join("fragment", " ").alias("text"))
    phrases = p.select("id", F.explode("phrases").alias("p")).select("id", T.canonical_phrase(F.col("p")).alias("phrase")).where("phrase <> ''").distinct()
    return evalm.phrase_precision(phrases, cut(frags, "fragments")).select("id", r6("precision"))


def _lead(spark, d):
    """Lead-1 summaries: the first content sentence against the abstract."""
    return cut(C._news(spark, d).select(F.col("doc_id").alias("id"), T.tokens(F.get("content_sents", F.lit(0))).alias("cand"), T.tokens(F.array_join("abstract_sents", " ")).alias("ref")), "pairs")


_LEAD = f"""ld AS (SELECT doc_id AS id, {S.tok('x.c[1]')} AS cand, {S.tok("array_to_string(x.a, ' ')")} AS ref FROM (SELECT doc_id, arg_max(struct_pack(a := abstract_sents, c := content_sents), ingested_at) AS x FROM news GROUP BY doc_id))"""


def _grams(n: int) -> str:
    g = lambda c: f"(SELECT id, g, count(*) AS n FROM (SELECT id, array_to_string({c}[i : i + {n - 1}], ' ') AS g FROM (SELECT id, {c}, generate_subscripts({c}, 1) AS i FROM ld) WHERE i <= len({c}) - {n - 1}) GROUP BY ALL)"
    return f"r{n} AS (SELECT id, hit, greatest(len(cand) - {n - 1}, 0) AS nc, greatest(len(ref) - {n - 1}, 0) AS nr FROM ld LEFT JOIN (SELECT a.id, sum(least(a.n, b.n)) AS hit FROM {g('cand')} a JOIN {g('ref')} b ON a.id = b.id AND a.g = b.g GROUP BY a.id) USING (id))"


_F1 = "round(CASE WHEN coalesce(hit, 0) = 0 THEN 0 ELSE 2 * (hit / nr) * (hit / nc) / (hit / nr + hit / nc) END, 6)"


@query(f"WITH {_LEAD}, {_grams(1)}, {_grams(2)} SELECT id, {_F1.replace('hit', 'r1.hit').replace('nr', 'r1.nr').replace('nc', 'r1.nc')} AS rouge_1, {_F1.replace('hit', 'r2.hit').replace('nr', 'r2.nr').replace('nc', 'r2.nc')} AS rouge_2 FROM r1 JOIN r2 USING (id)")
def rouge_abstracts(spark, d):
    """ROUGE-1 and -2 of the lead-1 summaries (the first content sentence) against the abstract."""
    p = _lead(spark, d)
    return sentence.rouge_n(p, 1).select("id", r6("f1", "rouge_1")).join(sentence.rouge_n(p, 2).select("id", r6("f1", "rouge_2")), "id")


@query()
def rouge_l_abstracts(spark, d):
    """ROUGE-L of the lead-1 summaries."""
    return evalm.rouge_l(_lead(spark, d)).select("id", r6("recall"), r6("precision"), r6("f1"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def not_contained(spark, d):
    """Documents without a vector: rows of one table whose key another lacks."""
    return evalm.contained(table(spark, d, "documents").where("doc_id is not null"), C._vecs(spark, d), ["doc_id"])


_TWO = f"tg AS (SELECT DISTINCT phrase FROM dp JOIN documents USING (doc_id) WHERE source = 'wire'), tw AS (SELECT DISTINCT phrase FROM dp JOIN documents USING (doc_id) WHERE source = 'metro_daily')"


@query(f"WITH {S.DP}, {_TWO} SELECT phrase, CASE WHEN tw.phrase IS NULL THEN 'target' WHEN tg.phrase IS NULL THEN 'twin' ELSE 'both' END AS held FROM tg FULL JOIN tw USING (phrase)")
def twin_phrases(spark, d):
    """Phrases of a cell, of its twin, and of both."""
    tf = cut(C.mined_tf(spark, d), "tf")
    of = lambda s: tf.join(table(spark, d, "documents").where(F.col("source") == s).select("doc_id"), "doc_id", "left_semi").select("phrase").distinct()
    a, b = cut(of("wire"), "target"), cut(of("metro_daily"), "twin")
    return a.subtract(b).withColumn("held", F.lit("target")).union(b.subtract(a).withColumn("held", F.lit("twin"))).union(a.intersect(b).withColumn("held", F.lit("both")))


# layers -------------------------------------------------------------------------------------------


def _weights(rows: int, cols: int) -> np.ndarray:
    """Small fixed weights for tests."""
    return ((np.arange(rows)[:, None] * 7 + np.arange(cols)[None] * 3) % 11 - 5) / 10


def _layer(vec: str, rows: int, cols: int) -> str:
    return f"list_transform(range({cols}), lambda j: list_sum(list_transform(range({rows}), lambda i: {vec}[i + 1] * (((i * 7 + j * 3) % 11 - 5) / 10.0))))"


@query(f"WITH h AS (SELECT vec_id AS doc_id, list_transform({_layer('embedding', 64, 5)}, lambda x: greatest(x, 0)::DOUBLE) AS h FROM embeddings), o AS (SELECT doc_id, {_layer('h', 5, 2)} AS o FROM h) SELECT doc_id, round(o[1], 6) AS first, round(o[2], 6) AS second FROM o")
def mapped_vectors(spark, d):
    """Vectors through two dense layers with relu between."""
    out = hin.dense_layers(C._vecs(spark, d), "vec", [(_weights(64, 5), None), (_weights(5, 2), None)], ("doc_id",))
    return out.select("doc_id", F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(F.get("vec", F.lit(1)), 6).alias("second"))


_GCN = f"x AS (SELECT vec_id AS node, {_layer('embedding', 64, 3)} AS x FROM embeddings), e AS (SELECT a.vec_id AS src, b.vec_id AS dst, 1.0 / (b.vec_id - a.vec_id) AS w FROM embeddings a JOIN embeddings b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 3), s AS (SELECT dst AS node, sum(x[1] * w) + 0.1 AS a, sum(x[2] * w) + 0.2 AS b, sum(x[3] * w) + 0.3 AS c FROM e JOIN x ON node = src GROUP BY dst)"


@query(f"WITH {_GCN} SELECT node, round(a - ln(exp(a) + exp(b) + exp(c)), 6) AS first, round(greatest(b, 0), 6) AS second FROM s")
def graph_convolution(spark, d):
    """One graph convolution over neighbouring numbers, with log-softmax and with relu."""
    v = C._vecs(spark, d).select(F.col("doc_id").alias("node"), "vec")
    e = v.select(F.col("node").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).select("src", (F.col("src") + F.col("n")).alias("dst"), (1.0 / F.col("n")).alias("w"))
    e = e.join(v.select(F.col("node").alias("dst")), "dst", "left_semi")
    soft, plain = (hin.graph_convolution(e, v, _weights(64, 3), np.array([0.1, 0.2, 0.3]), last) for last in ("log_softmax", "relu"))
    return soft.join(plain.withColumnRenamed("vec", "r"), "node").select("node", F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(F.get("r", F.lit(1)), 6).alias("second"))


@query()
def document_vectors(spark, d):
    """Trained document vectors: their length, which no SQL gives."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    return assign.document_vectors(docs, 20).select("doc_id", F.round(V.norm(F.col("vec")), 4).alias("length"))
