"""How distinct phrases are over labels, and vectors weighted by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexicube.functions.vector import mean_vector


def l1(x: Column, *by: str) -> Column:
    """Share of the total of a group; null if the total is 0."""
    return F.try_divide(x, F.sum(x).over(Window.partitionBy(*by)))


def kl(p: Column, q: Column) -> Column:
    """Aggregate: sum of p ln(p / q) over p > 0."""
    return F.sum(F.when(p > 0, p * F.log(p / q)).otherwise(0.0))


def entropy(p: Column, normalise_by: Column | None = None) -> Column:
    """Aggregate: -sum p ln(p + 1e-4), over ln(n) if ``normalise_by`` n is given."""
    e = -F.sum(p * F.log(p + 1e-4))
    return e if normalise_by is None else F.try_divide(e, F.log(normalise_by))


def distinct_map(tf: DataFrame, scores: DataFrame, soft: bool = True) -> DataFrame:
    """(phrase, kl): divergence of a phrase's labels from the uniform distribution.

    ``scores`` (doc_id, label, score): documents are spread over labels by softmax, or
    given to the best label (ties to the smaller) with ``soft=False``; a phrase gets its
    documents' labels by tf. Phrases without a scored document get 0.
    """
    w = Window.partitionBy("doc_id")
    s = scores.where("score is not null")
    if soft:
        e = s.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
        share = e.select("doc_id", "label", (F.col("e") / F.sum("e").over(w)).alias("p"))
    else:
        share = s.withColumn("r", F.row_number().over(w.orderBy(F.col("score").desc(), "label"))).where("r = 1").select("doc_id", "label", F.lit(1.0).alias("p"))
    n = s.agg(F.count_distinct("label").alias("n_labels"))
    mass = tf.join(share, "doc_id").groupBy("phrase", "label").agg(F.sum(F.col("tf") * F.col("p")).alias("m"))
    p = mass.withColumn("p", l1(F.col("m"), "phrase")).join(F.broadcast(n))
    got = p.groupBy("phrase").agg(kl(F.col("p"), 1 / F.col("n_labels")).alias("kl"))
    return tf.select("phrase").distinct().join(got, "phrase", "left").na.fill(0.0, ["kl"])


def distinct_map_twice(tf: DataFrame, seeds: DataFrame, vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(phrase, kl) in two rounds: documents labelled by seed phrases weigh the words of
    their vectors; the vectors give the labels of the second round, whose map is returned.

    ``seeds`` (phrase, label), ``vectors`` (phrase, vec), ``labels`` (label, label_vec).
    """
    from lexicube.operators.assign import label_scores

    first = tf.join(seeds, "phrase").groupBy("doc_id", "label").agg(F.sum("tf").cast("double").alias("score"))
    weight = distinct_map(tf, first, soft=False)
    dim = len(vectors.select("vec").first()[0])
    docs = weighted_vectors(tf, weight, vectors, dim)
    return distinct_map(tf, label_scores(docs, labels), soft=False)


def weighted_vectors(tf: DataFrame, weights: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(doc_id, vec): mean of the phrases' vectors by tf and weight (kl), per document."""
    j = tf.join(weights.select("phrase", "kl"), "phrase").join(vectors.select("phrase", "vec"), "phrase")
    return mean_vector(j, ["doc_id"], "vec", dim, F.col("tf") * F.col("kl"))


def rank_fusion(lists: DataFrame) -> DataFrame:
    """(item, score): sum of 1 / rank over the lists, ranks from 1."""
    return lists.groupBy("item").agg(F.sum(1 / F.col("rank")).alias("score"))


def directed_lead(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(a, b, lead): w(a, b) / n(a) - w(b, a) / n(b) of ordered pair counts (a, b, w) and term counts (term, n).

    A missing direction counts 0; a pair with a term without a count is left out.
    """
    p = pairs.groupBy("a", "b").agg(F.sum("w").alias("w"))
    n = counts.select("term", "n").where("n > 0")
    back = p.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("w").alias("back"))
    both = p.join(back, ["a", "b"], "left").join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    return both.select("a", "b", (F.col("w") / F.col("na") - F.coalesce("back", F.lit(0)) / F.col("nb")).alias("lead"))


def above_average(scores: DataFrame, by: str, score: str = "score") -> DataFrame:
    """Rows whose score exceeds the mean of their group."""
    mean = scores.groupBy(by).agg(F.avg(score).alias("__mean"))
    return scores.join(mean, by).where(F.col(score) > F.col("__mean")).drop("__mean")
