"""Whole summarisation queries: score phrases, then choose sentences per set.

Target sets are groups of texts; the background is a collection of its own. A set's
documents are compared with those the background gives back for it, and with sibling
cells of labelled background documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lexicube.operators import assign, cooc, cube, index, rank, select
from lexicube.operators.common import top_k
from lexicube.session import cut

METHODS = ("caseOLAP", "caseOLAP-twin", "sumdocs", "sumdocs_wo_twins", "sumdocs_textrank", "graph_degen")


@dataclass
class Collection:
    """What the methods read.

    ``docs`` (set_id, doc_no, tokens) the sets' documents, ``background`` (doc_id, tokens),
    ``assigned`` (doc_id, label, margin) labels of background documents. For the search by
    vectors also ``set_vectors`` (set_id, doc_id, vec) and ``vectors`` (doc_id, vec).
    """

    docs: DataFrame
    background: DataFrame
    assigned: DataFrame
    set_vectors: DataFrame | None = None
    vectors: DataFrame | None = None


def from_scores(sents: DataFrame, scores: DataFrame, budget: int = 200) -> DataFrame:
    """(set_id, sent_no, pick, sentence) by the coverage objective within ``budget`` tokens."""
    picks = select.select_sets(sents, scores, "coverage", budget)
    return picks.join(sents.select("set_id", "sent_no", "sentence"), ["set_id", "sent_no"])


def set_tfidf(sents: DataFrame) -> DataFrame:
    """(set_id, phrase, score): tf-idf of a set's words, a set being one document of the collection of sets."""
    tf = cut(sents.select(F.col("set_id").alias("doc_id"), F.explode("tokens").alias("phrase")).groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("tf")), "tf")
    return index.tfidf(tf).select(F.col("doc_id").alias("set_id"), "phrase", "score")


def coverage(sents: DataFrame, budget: int = 200) -> DataFrame:
    """Summaries by :func:`set_tfidf`."""
    return from_scores(sents, set_tfidf(sents), budget)


def retrieve(c: Collection, k: int = 50) -> DataFrame:
    """(set_id, doc_id, score, rank): the background documents a set is compared with.

    The ``k`` documents with the largest sum of tf-idf cosines to the set's documents, of
    the whole background. idf is that of the background; words it lacks don't count.
    """
    tf = cut(index.postings(c.background, "doc_id", F.col("tokens")), "tf")
    idf = cut(index.idf(tf).select("phrase", "df", "idf"), "idf")
    rows = index.unit_rows(index.join_stats(tf, idf, ["phrase"], "df", tf.count()).select("doc_id", "phrase", (F.col("tf") * F.col("idf")).alias("w")), "doc_id", "w")
    own = c.docs.where("set_id is not null").select("set_id", "doc_no", F.explode("tokens").alias("phrase")).groupBy("set_id", "doc_no", "phrase").agg(F.count(F.lit(1)).alias("tf"))
    one = cut(own.join(idf, "phrase").select(F.struct("set_id", "doc_no").alias("key"), "phrase", (F.col("tf") * F.col("idf")).alias("v")), "own")
    sums = index.unit_rows(one, "key", "v").groupBy(F.col("key.set_id").alias("set_id"), "phrase").agg(F.sum("v").alias("v"))
    return index.sparse_nearest(sums, rows, k)


def retrieve_by_vectors(c: Collection, factor: int = 2) -> DataFrame:
    """(set_id, doc_id, distance, rank): the ``factor`` * n documents nearest to a set of n with vectors, within its category."""
    category = assign.majority_label(c.assigned, c.set_vectors.select("set_id", "doc_id")).select("set_id", "label")
    members = c.set_vectors.join(category, "set_id").select("set_id", "label", "vec")
    return assign.neighbours(members, c.vectors.join(c.assigned.select("doc_id", "label"), "doc_id"), factor)


SEARCHES = {"tfidf": retrieve, "vectors": retrieve_by_vectors}


def search(c: Collection, kind: str = "tfidf") -> DataFrame:
    """The documents a set is compared with, by one of ``SEARCHES``."""
    if kind not in SEARCHES:
        raise ValueError(f"kind must be one of {tuple(SEARCHES)}")
    return SEARCHES[kind](c)


def siblings(c: Collection, per_label: int = 100) -> DataFrame:
    """(cell, phrase, tf, df): words of the ``per_label`` surest background documents of every label."""
    top = assign.rank_in_label(c.assigned, "margin", per_label).select(F.col("label").cast("string").alias("cell"), "doc_id")
    docs = c.background.select("doc_id", "tokens").join(F.broadcast(top), "doc_id")  # labels are a fixed list, so top is bounded
    return cube.cell_counts(index.postings(docs, "doc_id", F.col("tokens")), top)


def categories(c: Collection, found: DataFrame) -> DataFrame:
    """(set_id, cell): the label most of a set's retrieved documents have; sets without a labelled one are left out."""
    vote = assign.majority_label(c.assigned, found.select("set_id", "doc_id"))
    return vote.select("set_id", F.col("label").cast("string").alias("cell"))


def phrase_scores(c: Collection, method: str = "sumdocs", topk: int = 100, rounds: int = 10, terms: int = 200, kind: str = "tfidf") -> DataFrame:
    """(set_id, phrase, score) of every set by one of ``METHODS``.

    * ``caseOLAP``: the 30 best words of the set as a cell against sibling cells;
      ``caseOLAP-twin`` times its distinctness against the cell of its own category;
    * ``sumdocs``: seeds are the ten best cell scores; what the walk on the set's own
      graph prefers to that on the graph of its retrieved documents;
    * ``sumdocs_wo_twins``: the seed walk on the own graph alone;
    * ``sumdocs_textrank``: the plain walk on window counts; ``graph_degen``: core numbers.

    ``kind`` is the search for the documents a set is compared with (:func:`search`).
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    best = lambda df, k: top_k(df, ["set_id"], [F.round("score", 9).desc(), F.col("phrase")], k).select("set_id", "phrase", "score")
    if method in ("sumdocs_textrank", "graph_degen"):
        first = 1 if method == "sumdocs_textrank" else 0
        p = cooc.window_pairs(c.docs.where("set_id is not null"), "set_id", F.col("tokens"), 4, first)
        once = p.groupBy(F.col("key").alias("set_id"), F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))
        if first:
            both = once.unionByName(once.select("set_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
            got = rank.textrank_sets(both.groupBy("set_id", "src", "dst").agg(F.sum("w").alias("w")))
            return best(got.withColumnRenamed("node", "phrase"), topk)
        return rank.cores_sets(once.where("src <> dst")).withColumnRenamed("node", "phrase")
    found = cut(search(c, kind).select("set_id", "doc_id"), "retrieved")
    sib, cat = cut(siblings(c), "siblings"), cut(categories(c, found), "categories")
    scored = cut(cube.set_scores(c.docs, sib, cat), "scores")
    if method == "caseOLAP":
        return best(scored, 30)
    if method == "caseOLAP-twin":
        twin = cut(cube.set_scores(c.docs, sib, cat, twin=True), "twins")
        both = scored.join(twin.select("set_id", "phrase", F.col("distinct").alias("d")), ["set_id", "phrase"])
        return best(both.select("set_id", "phrase", (F.col("score") * F.col("d")).alias("score")), 30)
    seeds = best(scored.where("trim(phrase) <> ''"), 10).select("set_id", F.col("phrase").alias("node"))
    if method == "sumdocs_wo_twins":
        e = cooc.window_pairs(c.docs.where("set_id is not null").withColumn("key", F.struct("set_id", "doc_no")), "key", F.col("tokens"), 4)
        once = e.select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().groupBy(F.col("key.set_id").alias("set_id"), "a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))
        both = once.select("set_id", F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(once.where("a <> b").select("set_id", F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
        return best(rank.seed_rank_sets(both, seeds.withColumn("weight", F.lit(1.0)), terms=terms).withColumnRenamed("node", "phrase"), topk)
    back = found.join(c.background.select("doc_id", "tokens"), "doc_id").select("set_id", "tokens")
    return rank.contrast(c.docs, back, seeds, topk, rounds, terms=terms).withColumnRenamed("node", "phrase")


def summarise(c: Collection, sents: DataFrame, method: str = "sumdocs", budget: int = 200, kind: str = "tfidf") -> DataFrame:
    """Summaries of every set: phrases by ``method``, sentences by coverage within ``budget`` tokens."""
    return from_scores(sents, phrase_scores(c, method, kind=kind), budget)
