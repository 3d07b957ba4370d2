"""Labels for documents by vectors: assignment, margins, votes, neighbours, quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexicube.functions.vector import cosine, dot, mean_vector
from lexicube.operators.common import top_k
from lexicube.operators.hier import closure
from lexicube.session import cut

#: Labels of a block: their matrix is sent to all tasks (at 100 numbers 8 MB); more labels are more blocks.
LABEL_BLOCK = 10_000
#: Rows of a tile of sets and documents.
TILE = 4096


def centroids(df: DataFrame, label: str, vec: str, dim: int) -> DataFrame:
    """(label, label_vec): mean vector per label; null labels and vectors are ignored."""
    good = df.where(F.col(label).isNotNull() & (F.size(vec) == dim))
    return mean_vector(good, [label], vec, dim, out="label_vec").select(F.col(label).alias("label"), "label_vec")


def label_scores(docs: DataFrame, labels: DataFrame, measure: str = "dot") -> DataFrame:
    """(doc_id, label, score) of every document with every label (dot product or cosine).

    The result holds all pairs, as its definition says; for the best labels only use
    :func:`best_labels`. Labels are a fixed list that is sent to all tasks, in blocks.
    Documents whose vector is null, has a null part or the wrong length have no score;
    with ``cosine`` a zero vector has a null score.
    """
    return _with_labels(docs, labels, measure, None).select("doc_id", F.explode("best").alias("x")).select("doc_id", "x.label", "x.score")


def best_labels(docs: DataFrame, labels: DataFrame, k: int = 2, measure: str = "dot") -> DataFrame:
    """(doc_id, best array<struct<score, label>>): the ``k`` best labels, best first, ties to the smaller label.

    One product of matrices per Arrow batch and block of labels; nothing is shuffled
    unless there is more than one block.
    """
    return _with_labels(docs, labels, measure, k)


def _with_labels(docs: DataFrame, labels: DataFrame, measure: str, k: int | None) -> DataFrame:
    kind = labels.schema["label"].dataType.simpleString()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, best array<struct<score:double,label:{kind}>>"
    good = labels.select("label", F.col("label_vec").cast("array<double>").alias("label_vec")).where("label is not null and label_vec is not null")
    blocks = max(1, -(-good.count() // LABEL_BLOCK))

    def block(at: int) -> DataFrame:
        few = good.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == at).orderBy("label").toPandas()
        if not len(few):
            return docs.sparkSession.createDataFrame([], schema)
        names, m = few["label"].tolist(), np.stack(few["label_vec"].to_numpy())
        size = np.linalg.norm(m, axis=1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for first in range(0, len(pdf), 1024):
                    part = pdf.iloc[first : first + 1024]
                    x = np.stack(part["vec"].to_numpy())
                    s = x @ m.T
                    if measure != "dot":
                        with np.errstate(divide="ignore", invalid="ignore"):
                            s = s / (np.linalg.norm(x, axis=1)[:, None] * size[None])
                    top = np.argsort(-s, axis=1, kind="stable")[:, : k or len(names)]
                    rows = [[{"score": None if s[i, j] != s[i, j] else float(s[i, j]), "label": names[j]} for j in js if k is None or s[i, j] == s[i, j]] for i, js in enumerate(top)]
                    yield pd.DataFrame({"doc_id": part["doc_id"], "best": rows})

        usable = docs.select("doc_id", F.col("vec").cast("array<double>").alias("vec")).where((F.size("vec") == m.shape[1]) & F.forall("vec", lambda v: v.isNotNull()))
        return usable.mapInPandas(run, schema)

    out = block(0)
    for at in range(1, blocks):
        out = out.unionByName(block(at))
    if blocks > 1 and k is not None:
        order = F.array_sort(F.transform(F.flatten(F.collect_list("best")), lambda x: F.struct((-x["score"]).alias("neg"), x["label"].alias("label"))))
        out = out.groupBy("doc_id").agg(F.transform(F.slice(order, 1, k), lambda x: F.struct((-x["neg"]).alias("score"), x["label"].alias("label"))).alias("best"))
    return out


def soft_assign(docs: DataFrame, labels: DataFrame, measure: str = "dot") -> DataFrame:
    """(doc_id, label, score, margin): best label and its lead over the second.

    A document without a usable vector doesn't come out; with one label the margin is null.
    """
    first, second = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    two = best_labels(docs, labels, 2, measure).where(F.size("best") > 0)
    return two.select("doc_id", first["label"].alias("label"), first["score"].alias("score"), (first["score"] - second["score"]).alias("margin"))


def assign_under_every(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document under every label, with the score of its best one."""
    every = F.broadcast(labels.select("label").where("label is not null").agg(F.sort_array(F.collect_set("label")).alias("labels")))  # a fixed list, one row
    best = best_labels(docs, labels, 1).where(F.size("best") > 0).select("doc_id", F.get("best", F.lit(0))["score"].alias("score"))
    return best.join(every).select("doc_id", F.explode("labels").alias("label"), "score")


def rank_in_label(assigned: DataFrame, by: str = "margin", k: int | None = None) -> DataFrame:
    """Documents of every label by falling ``by``; ties by id. ``k`` keeps the first."""
    order = [F.col(by).desc_nulls_last(), F.col("doc_id")]
    return top_k(assigned, ["label"], order, k if k is not None else 2**31 - 1)


def majority_label(assigned: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_id, label, votes): most frequent label of a set's documents; ties to the smaller label."""
    votes = assigned.join(sets.select("set_id", "doc_id"), "doc_id").groupBy("set_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    return top_k(votes, ["set_id"], [F.col("votes").desc(), F.col("label")], 1).drop("rank")


def descend(votes: DataFrame, tree: DataFrame, root: str, share: float = 0.6) -> DataFrame:
    """(set_id, node): from ``root`` down while one child has more than ``share`` of the votes.

    ``votes`` (set_id, label, votes) are for leaves; ``tree`` (parent, child). Stops at a
    node without such a child. A cycle in the tree is an error.
    """
    at = votes.select("set_id").distinct().withColumn("node", F.lit(root))
    below = cut(tree.select(F.col("parent").alias("node"), F.col("child").alias("next")), "tree")
    mass = _mass(votes, tree)
    while True:
        step = at.join(below, "node").join(mass, ["set_id", "next"]).withColumn("part", F.col("v") / F.sum("v").over(Window.partitionBy("set_id")))
        best = cut(top_k(step, ["set_id"], [F.col("part").desc(), F.col("next")], 1).where(F.col("part") > share).select("set_id", "next"), "best")
        if best.isEmpty():
            return at
        at = cut(at.join(best, "set_id", "left").select("set_id", F.coalesce("next", "node").alias("node")), "at")


def _mass(votes: DataFrame, tree: DataFrame) -> DataFrame:
    """(set_id, next, v): the votes of all labels below or at every node."""
    under = closure(tree.select("parent", "child")).select(F.col("parent").alias("top"), F.col("child").alias("label"))
    under = under.unionByName(tree.select(F.col("child").alias("top"), F.col("child").alias("label"))).distinct()
    return cut(votes.join(under, "label").groupBy("set_id", F.col("top").alias("next")).agg(F.sum("votes").alias("v")), "mass")


def two_level_vote(votes: DataFrame, tree: DataFrame, root: str) -> DataFrame:
    """(set_id, top, label, entropy): the child of ``root`` with most votes, then its child with most.

    Ties go to the smaller name. ``label`` is the top itself if it has no voted child;
    ``entropy`` is that of the votes over the children of the root, un-normalised.
    """
    mass = _mass(votes, tree)
    first = mass.join(tree.where(F.col("parent") == root).select(F.col("child").alias("next")), "next")
    p = first.withColumn("p", F.col("v") / F.sum("v").over(Window.partitionBy("set_id")))
    spread = p.groupBy("set_id").agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-4))).alias("entropy"))
    top = top_k(first, ["set_id"], [F.col("v").desc(), F.col("next")], 1).select("set_id", F.col("next").alias("top"))
    second = top.join(tree.select(F.col("parent").alias("top"), F.col("child").alias("next")), "top").join(mass, ["set_id", "next"])
    sub = top_k(second, ["set_id"], [F.col("v").desc(), F.col("next")], 1).select("set_id", F.col("next").alias("sub"))
    return top.join(sub, "set_id", "left").join(spread, "set_id").select("set_id", "top", F.coalesce("sub", "top").alias("label"), "entropy")


def bottom_up(votes: DataFrame, tree: DataFrame, smooth: float = 0.001) -> DataFrame:
    """(set_id, label, share, siblings): the leaf with the largest smoothed share among its siblings' votes.

    Each leaf of ``tree`` gets ``smooth`` votes more; the best leaf by votes is taken
    (ties to the smaller name), with its share of the votes of all leaves below the same
    parent and the other leaves there. Votes for labels that are no leaf don't count.
    """
    inner = tree.select(F.col("parent").alias("child")).distinct()
    leaf = tree.join(inner, "child", "left_anti").select("parent", F.col("child").alias("label")).distinct()
    got = votes.join(leaf.select("label").distinct(), "label")
    best = top_k(got, ["set_id"], [F.col("votes").desc(), F.col("label")], 1).select("set_id", "label")
    home = best.join(leaf.groupBy("label").agg(F.min("parent").alias("parent")), "label")
    near = home.join(leaf.withColumnRenamed("label", "other"), "parent").join(got.select("set_id", F.col("label").alias("other"), "votes"), ["set_id", "other"], "left")
    v = F.coalesce("votes", F.lit(0)) + smooth
    out = near.groupBy("set_id", "label").agg(F.sum(F.when(F.col("other") == F.col("label"), v)).alias("own"), F.sum(v).alias("all"), F.array_sort(F.collect_set(F.when(F.col("other") != F.col("label"), F.col("other")))).alias("siblings"))
    return out.select("set_id", "label", (F.col("own") / F.col("all")).alias("share"), "siblings")


def neighbours(members: DataFrame, pool: DataFrame, factor: int = 2, tile: int = TILE) -> DataFrame:
    """(set_id, doc_id, distance, rank): the factor * n background documents nearest to a set of n.

    Distance is the sum of cosine distances to the members, which is n minus the dot
    product of the unit vector with the sum of the members' unit vectors: so a set is one
    vector, not n. ``members`` (set_id, label, vec), ``pool`` (doc_id, vec, label), both
    only compared within the set's ``label``; members without a vector don't count, sets
    without any don't come out. Ties (to nine places) go to the smaller id.

    Sets and documents of a label meet in tiles of about ``tile`` rows a side, so a label
    with a third of all rows is many tasks; a tile gives the best of each of its sets.
    """
    from lexicube.functions.vector import unit

    m = members.select("set_id", "label", unit(F.col("vec")).alias("u")).where("u is not null and label is not null")
    head = m.select(F.size("u").alias("n")).first()
    dim = head[0] if head else 1
    sums = [F.sum(F.get("u", F.lit(i))).alias(f"d{i}") for i in range(dim)]
    q = cut(m.groupBy("set_id", "label").agg(F.count(F.lit(1)).alias("n"), *sums).select("set_id", "label", "n", F.array(*[f"d{i}" for i in range(dim)]).alias("q")), "sets")
    p = cut(pool.select("doc_id", "label", unit(F.col("vec")).alias("u")).where("u is not null"), "pool")
    sizes = q.groupBy("label").agg(F.count(F.lit(1)).alias("nq")).join(p.groupBy("label").agg(F.count(F.lit(1)).alias("np")), "label")
    parts = sizes.select("label", F.ceil(F.col("nq") / tile).cast("int").alias("q_parts"), F.ceil(F.col("np") / tile).cast("int").alias("p_parts"))
    salt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(parts, "label").select("label", "set_id", "n", "q", salt("set_id", "q_parts").alias("qp"), every("p_parts").alias("pp"))
    right = p.join(parts, "label").select(F.col("label").alias("p_label"), "doc_id", "u", salt("doc_id", "p_parts").alias("p_pp"), every("q_parts").alias("p_qp"))
    kind = {c: d.schema[c].dataType.simpleString() for d, c in ((q, "set_id"), (p, "doc_id"))}

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            u, ids = np.stack(b["u"].to_numpy()), b["doc_id"].to_numpy()
            for s, n, v in zip(a["set_id"], a["n"], a["q"]):
                d = n - u @ np.asarray(v)
                order = np.lexsort((ids, np.round(d, 9)))[: factor * n]
                out.append(pd.DataFrame({"set_id": s, "n": n, "doc_id": ids[order], "distance": d[order]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"set_id": [], "n": [], "doc_id": [], "distance": []})

    schema = f"set_id {kind['set_id']}, n long, doc_id {kind['doc_id']}, distance double"
    scored = left.groupBy("label", "qp", "pp").cogroup(right.groupBy("p_label", "p_qp", "p_pp")).applyInPandas(best, schema)
    w = Window.partitionBy("set_id").orderBy(F.round("distance", 9), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= factor * F.col("n")).drop("n")


def members_by_similarity(docs: DataFrame, group: str, targets: Column) -> DataFrame:
    """(group, doc_id, similarity, rank): non-target members by mean cosine to the targets."""
    from lexicube.functions.vector import unit

    u = docs.select(F.col(group).alias("g"), "doc_id", unit(F.col("vec")).alias("u"), targets.alias("t")).where("u is not null")
    head = u.select(F.size("u").alias("n")).first()
    dim = head[0] if head else 1
    t = mean_vector(u.where("t"), ["g"], "u", dim, out="m")
    out = u.where("not t").join(t, "g").select(F.col("g").alias(group), "doc_id", dot(F.col("u"), F.col("m")).alias("similarity"))
    return top_k(out, [group], [F.col("similarity").desc(), F.col("doc_id")], 2**31 - 1)


def precision_at_k(ranked: DataFrame, gold: DataFrame, k: int = 300) -> DataFrame:
    """(label, precision): hits among the first k over **k**, even if there are fewer rows."""
    hit = ranked.where(F.col("rank") <= k).join(gold.select("doc_id", F.col("label").alias("gold")), "doc_id", "left")
    return hit.groupBy("label").agg((F.sum(F.coalesce((F.col("gold") == F.col("label")).cast("int"), F.lit(0))) / F.lit(float(k))).alias("precision"))


def f1(assigned: DataFrame, gold: DataFrame) -> DataFrame:
    """(micro_f1, macro_f1); labels without a hit don't count in the macro mean."""
    both = assigned.select("doc_id", "label").join(gold.select("doc_id", F.col("label").alias("gold")), "doc_id")
    n_pred = both.groupBy("label").agg(F.count(F.lit(1)).alias("pred"), F.sum((F.col("label") == F.col("gold")).cast("int")).alias("hit"))
    n_gold = both.groupBy(F.col("gold").alias("label")).agg(F.count(F.lit(1)).alias("real"))
    per = n_pred.join(n_gold, "label", "full").na.fill(0)
    one = F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("pred") + F.col("real")))
    return per.agg((2 * F.sum("hit") / (F.sum("pred") + F.sum("real"))).alias("micro_f1"), F.avg(one).alias("macro_f1"))


def within_band(scores: DataFrame, low: float = 0.6, high: float = 0.85) -> DataFrame:
    """Rows whose score lies strictly between two bounds."""
    return scores.where((F.col("score") > low) & (F.col("score") < high))


def mean_max_similarity(targets: DataFrame, others: DataFrame) -> DataFrame:
    """(group, other, similarity): mean over a group's vectors of the largest cosine to a vector of the other group.

    ``targets`` (group, vec), ``others`` (group, vec), the latter a fixed list of few groups
    (their vectors are sent to all tasks, as labels are).
    """
    o = others.select(F.struct(F.col("group").alias("g"), F.monotonically_increasing_id().alias("i")).alias("label"), F.col("vec").alias("label_vec"))
    t = targets.select(F.struct(F.col("group").alias("g"), F.monotonically_increasing_id().alias("i")).alias("doc_id"), "vec")
    names = cut(o.withColumn("no", F.col("label.i")), "others")
    rows = cut(t.withColumn("no", F.col("doc_id.i")), "targets")
    s = label_scores(rows.select(F.col("no").alias("doc_id"), "vec"), names.select(F.col("no").alias("label"), "label_vec"), "cosine").where("score is not null")
    s = s.join(F.broadcast(names.select(F.col("no").alias("label"), F.col("label.g").alias("other"))), "label")
    best = s.groupBy("doc_id", "other").agg(F.max("score").alias("m"))
    return best.join(rows.select(F.col("no").alias("doc_id"), F.col("doc_id.g").alias("group")), "doc_id").groupBy("group", "other").agg(F.avg("m").alias("similarity"))


def cluster_scores(similarities: DataFrame, weights: DataFrame, first: int = 10, second: int = 5) -> DataFrame:
    """(cluster, score): mean of the ``first`` largest weights times the mean of the ``second`` largest similarities.

    ``similarities`` (cluster, score), ``weights`` (cluster, score); fewer rows count as they are.
    """

    def mean(df: DataFrame, k: int, name: str) -> DataFrame:
        rows = df.select("cluster", "score").where("cluster is not null and score is not null")
        return top_k(rows, ["cluster"], [F.col("score").desc()], k).groupBy("cluster").agg(F.avg("score").alias(name))

    return mean(weights, first, "w").join(mean(similarities, second, "s"), "cluster").select("cluster", (F.col("w") * F.col("s")).alias("score"))


def similarity_to_mean(phrases: DataFrame, vectors: DataFrame, mean: DataFrame, dim: int) -> DataFrame:
    """(set_id, phrase, score): cosine of a phrase's vector with the mean vector of its set's documents; 0 without a vector.

    ``phrases`` (set_id, phrase), ``vectors`` (phrase, vec), ``mean`` (set_id, vec) of the documents.
    """
    m = mean_vector(mean, ["set_id"], "vec", dim, out="mean")
    j = phrases.join(m, "set_id").join(vectors.select("phrase", "vec"), "phrase", "left")
    return j.select("set_id", "phrase", F.coalesce(cosine(F.col("vec"), F.col("mean")), F.lit(0.0)).alias("score"))


def spherical_kmeans(docs: DataFrame, k: int = 50, rounds: int = 20, seed: int = 7) -> DataFrame:
    """(doc_id, cluster): clusters by direction, by Spark's own k-means with cosine distance.

    Documents without a usable (non-zero, complete) vector get -1; an empty table gives an
    empty one.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    good = cut(docs.where(F.forall("vec", lambda v: v.isNotNull()) & F.exists("vec", lambda v: v != 0)).select("doc_id", array_to_vector(F.col("vec").cast("array<double>")).alias("features")), "vectors")
    none = docs.select("doc_id").join(good.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(-1).alias("cluster"))
    n = good.count()
    if n < 2:
        return none.unionByName(good.select("doc_id", F.lit(0).alias("cluster")))
    model = KMeans(k=min(k, n), distanceMeasure="cosine", maxIter=rounds, seed=seed, predictionCol="cluster").fit(good)
    return model.transform(good).select("doc_id", "cluster").unionByName(none)


def membership(clusters: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, cluster): the cluster of every document asked for, -1 if it is in none."""
    return docs.select("doc_id").join(clusters.select("doc_id", "cluster"), "doc_id", "left").select("doc_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def document_vectors(docs: DataFrame, dim: int = 100, least: int = 5, window: int = 5, seed: int = 7) -> DataFrame:
    """(doc_id, vec): means of word vectors that Spark's own skip-gram training gives.

    ``docs`` (doc_id, tokens). Words below ``least`` occurrences have no vector; documents
    without a known word get zeros. The trainer keeps one vector a known word on the
    driver, so ``least`` bounds its memory. An empty table gives an empty one.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    rows = docs.where("doc_id is not null and tokens is not null").select("doc_id", "tokens")
    words = rows.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    if words.isEmpty():
        return rows.select("doc_id", F.array_repeat(F.lit(0.0), dim).alias("vec"))
    model = Word2Vec(vectorSize=dim, minCount=least, windowSize=window, seed=seed, inputCol="tokens", outputCol="v").fit(rows)
    return model.transform(rows).select("doc_id", vector_to_array("v").alias("vec"))
