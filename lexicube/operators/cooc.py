"""Co-occurrence of terms within a window or a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexicube.operators.common import join_stats
from lexicube.session import cut


def window_pairs(df: DataFrame, key: str, terms: Column, window: int = 4, first: int = 1) -> DataFrame:
    """(key, a, b): each term with those ``first`` to ``window`` places behind it, in order.

    Slices of the array itself: no shuffle, and rows only where a partner is.
    """
    arr = df.select(F.col(key).alias("key"), terms.alias("t"))
    spread = arr.select("key", "t", F.posexplode("t").alias("p", "a"))
    return spread.select("key", "a", F.explode(F.slice("t", F.col("p") + 1 + first, window - first + 1)).alias("b"))


def window_counts(pairs: DataFrame, symmetric: bool = True) -> DataFrame:
    """(a, b, n): counted pairs, both directions (a pair of equal terms adds 2)."""
    if symmetric:
        pairs = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def document_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, n): each unordered pair once a document, both directions."""
    once = pairs.select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return window_counts(once)


def row_normalised(counts: DataFrame, weight: str = "n") -> DataFrame:
    """(a, b, p): counts over their row sums, pairs of equal terms left out.

    Rows without a partner don't come out; read them as uniform. Sums are aggregated and
    joined back, frequent words apart, so no word is held by one task.
    """
    c = cut(counts.where("a <> b").select("a", "b", weight), "counts")
    sums = c.groupBy("a").agg(F.sum(weight).alias("total"), F.count(F.lit(1)).alias("rows"))
    return join_stats(c, sums, ["a"], "rows", c.count()).select("a", "b", (F.col(weight) / F.col("total")).alias("p"))


def similarity_weighted(counts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, w): counts times the absolute cosine of the terms' vectors (0 without one)."""
    from lexicube.functions.vector import cosine

    v = vectors.select("term", "vec")
    c = counts.where("a <> b").join(v.toDF("a", "va"), "a", "left").join(v.toDF("b", "vb"), "b", "left")
    return c.select("a", "b", (F.col("n") * F.abs(F.coalesce(cosine(F.col("va"), F.col("vb")), F.lit(0.0)))).alias("w"))


def skipgrams(df: DataFrame, key: str, terms: Column, window: int = 2) -> DataFrame:
    """(key, centre, context): every term with its neighbours on both sides."""
    p = window_pairs(df, key, terms, window)
    return p.select("key", F.col("a").alias("centre"), F.col("b").alias("context")).unionByName(p.select("key", F.col("b"), F.col("a")).toDF("key", "centre", "context"))


def left_windows(df: DataFrame, key: str, terms: Column, window: int = 3) -> DataFrame:
    """(key, context array, word): each word behind a full left window (document vectors)."""
    arr = df.select(F.col(key).alias("key"), terms.alias("t")).select("key", "t", F.posexplode("t").alias("p", "word"))
    return arr.where(F.col("p") >= window).select("key", F.slice("t", F.col("p") - window + 1, window).alias("context"), "word")


def cbow_windows(df: DataFrame, key: str, terms: Column, window: int = 2) -> DataFrame:
    """(key, context array, word): words with a full window on both sides."""
    arr = df.select(F.col(key).alias("key"), terms.alias("t")).select("key", "t", F.posexplode("t").alias("p", "word"))
    full = (F.col("p") >= window) & (F.col("p") < F.size("t") - window)
    return arr.where(full).select("key", F.concat(F.slice("t", F.col("p") - window + 1, window), F.slice("t", F.col("p") + 2, window)).alias("context"), "word")
