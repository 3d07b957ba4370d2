"""Sentence graphs and scores from token overlap, without sentence cross products.

Pairs of sentences are found through the tokens they share, within their set only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lexicube.operators import rank
from lexicube.session import cut

#: Sentences of a set in one side of a tile.
BLOCK = 2000


def sentence_tokens(docs: DataFrame, text: str, sentences, tokens) -> DataFrame:
    """(set_id, sent_no, sentence, tokens): sentences of a set numbered over its documents.

    ``sentences`` and ``tokens`` turn a column into an array. Texts that are null give none.
    """
    each = docs.select("set_id", "doc_no", F.posexplode(sentences(F.col(text))).alias("p", "sentence"))
    no = F.row_number().over(Window.partitionBy("set_id").orderBy("doc_no", "p")) - 1
    return each.select("set_id", no.alias("sent_no"), "sentence").withColumn("tokens", tokens(F.col("sentence")))


def pair_products(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(set_id, i, j, dot): for sentences i <> j of a set that share a token, the sum of products of their weights.

    ``rows`` (set_id, sent_no, tokens, weights): distinct tokens of a sentence and their
    weights. Sentences of a set meet in tiles of ``block`` rows a side, so a set with a
    third of all sentences is many tasks and a common token makes no rows of its own:
    what is shuffled are the sentences, once a block of their set.
    """
    good = rows.where("set_id is not null and size(tokens) > 0").select(F.col("set_id").cast("long").alias("set_id"), F.col("sent_no").cast("int").alias("no"), "tokens", F.col("weights").cast("array<double>").alias("weights"))
    good = cut(good.withColumn("at", F.floor(F.col("no") / block).cast("int")), "sentences")
    last = good.groupBy("set_id").agg(F.max("at").alias("last"), F.min("at").alias("first"))
    each = good.join(last, "set_id").withColumn("other", F.explode(F.sequence("first", "last")))
    left = each.select("set_id", F.col("at").alias("bi"), F.col("other").alias("bj"), "no", "tokens", "weights")
    right = each.select(F.col("set_id").alias("sid"), F.col("other").alias("ci"), F.col("at").alias("cj"), F.col("no").alias("no_b"), F.col("tokens").alias("tokens_b"), F.col("weights").alias("weights_b"))

    def products(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"set_id": [], "i": [], "j": [], "dot": []})
        size_a, size_b = a["tokens"].map(len).to_numpy(), b["tokens_b"].map(len).to_numpy()
        words, code = np.unique(np.concatenate([*a["tokens"], *b["tokens_b"]]).astype(str), return_inverse=True)
        ca, cb = code[: size_a.sum()], code[size_a.sum() :]
        order = np.argsort(cb, kind="stable")
        rb, wb = np.repeat(np.arange(len(b)), size_b)[order], np.concatenate(list(b["weights_b"]))[order]
        start = np.searchsorted(cb[order], np.arange(len(words) + 1))
        count = np.diff(start)[ca]
        at = np.repeat(start[ca] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        ra = np.repeat(np.repeat(np.arange(len(a)), size_a), count)
        w = np.repeat(np.concatenate(list(a["weights"])), count) * wb[at]
        key, pos = np.unique(ra * len(b) + rb[at], return_inverse=True)
        i, j = a["no"].to_numpy()[key // len(b)], b["no_b"].to_numpy()[key % len(b)]
        out = pd.DataFrame({"set_id": a["set_id"].iloc[0], "i": i, "j": j, "dot": np.bincount(pos, w, minlength=len(key))})
        return out[i != j]

    return left.groupBy("set_id", "bi", "bj").cogroup(right.groupBy("sid", "ci", "cj")).applyInPandas(products, "set_id long, i int, j int, dot double")


def shared_tokens(sents: DataFrame) -> DataFrame:
    """(set_id, i, j, common, ni, nj): ordered pairs i <> j with common distinct tokens.

    ni and nj are the token counts (with repeats).
    """
    n = cut(sents.select("set_id", "sent_no", F.size("tokens").alias("n"), F.array_distinct("tokens").alias("tokens")), "tokens")
    both = pair_products(n.withColumn("weights", F.transform("tokens", lambda t: F.lit(1.0))))
    size = n.select("set_id", "sent_no", "n")
    out = both.join(size.toDF("set_id", "i", "ni"), ["set_id", "i"]).join(size.toDF("set_id", "j", "nj"), ["set_id", "j"])
    return out.select("set_id", "i", "j", F.round("dot").cast("long").alias("common"), "ni", "nj")


def lexrank(sents: DataFrame, least: float = 0.1, damping: float = 0.85, rounds: int | None = None) -> DataFrame:
    """(set_id, sent_no, score): walk over the graph of sentences whose tf-idf cosine is ``least`` or more.

    idf = ln(n / df) + 1 over the sentences of the set. A reimplementation of the published
    method: every edge counts 1, and an edge is followed in proportion to the degree.
    Sentences without an edge get 1 - ``damping``; empty sentences don't come out.
    """
    s = cut(sents.where("set_id is not null and size(tokens) > 0").select("set_id", "sent_no", "tokens"), "sentences")
    n = s.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    tf = s.select("set_id", "sent_no", F.explode("tokens").alias("token")).groupBy("set_id", "sent_no", "token").agg(F.count(F.lit(1)).alias("tf"))
    tf = cut(tf, "tf")
    df = tf.groupBy("set_id", "token").agg(F.count(F.lit(1)).alias("df")).join(n, "set_id")
    w = tf.join(df, ["set_id", "token"]).withColumn("w", F.col("tf") * (F.log(F.col("n") / F.col("df")) + 1))
    per = w.groupBy("set_id", "sent_no").agg(F.sort_array(F.collect_list(F.struct("token", "w"))).alias("x"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    rows = per.select("set_id", "sent_no", F.col("x.token").alias("tokens"), F.transform("x", lambda x: x["w"] / F.col("len")).alias("weights"))
    edges = pair_products(rows).where(F.round("dot", 9) >= least).select("set_id", F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1.0).alias("w"))
    got = rank.textrank_sets(edges, rounds, damping).select("set_id", F.col("node").cast("int").alias("sent_no"), "score")
    return s.select("set_id", "sent_no").join(got, ["set_id", "sent_no"], "left").select("set_id", "sent_no", F.coalesce("score", F.lit(1 - damping)).alias("score"))


def overlap_edges(sents: DataFrame, symmetric: bool = False) -> DataFrame:
    """(set_id, src, dst, w): common tokens over the log lengths (the second twice by default).

    Pairs whose denominator is 0 (one-word sentences) have no edge.
    """
    p = shared_tokens(sents)
    low = F.log(F.col("ni" if symmetric else "nj").cast("double")) + F.log(F.col("nj").cast("double"))
    return p.withColumn("w", F.try_divide(F.col("common"), low)).where("w is not null").select("set_id", F.col("i").alias("src"), F.col("j").alias("dst"), "w")


def density_peak(sents: DataFrame, near: float = 0.22) -> DataFrame:
    """(set_id, sent_no, repr, div, len, score): density-peak scores of all sentences.

    cos is the cosine of binary bags of words. repr: share of the set's sentences with
    cos > ``near``; div: 1 - the largest cos to a denser sentence, or 1 - the smallest
    cos to any other if none is denser; len: distinct words over the set's most, times
    ln(most raw words / own raw words); score: the sum of ln(x + 0.001). Empty
    sentences are ignored; a set of one sentence has div 1.
    """
    s = sents.where(F.size("tokens") > 0)
    size = s.select("set_id", "sent_no", F.size(F.array_distinct("tokens")).alias("el"), F.size("tokens").alias("rl"))
    w = Window.partitionBy("set_id")
    size = size.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("mel", F.max("el").over(w)).withColumn("mrl", F.max("rl").over(w))
    el = size.select("set_id", "sent_no", "el")
    cos = shared_tokens(s).join(el.toDF("set_id", "i", "ei"), ["set_id", "i"]).join(el.toDF("set_id", "j", "ej"), ["set_id", "j"])
    cos = cos.select("set_id", "i", "j", (F.col("common") / F.sqrt(F.col("ei") * F.col("ej").cast("double"))).alias("cos"))
    dense = cos.groupBy("set_id", "i").agg(F.sum((F.col("cos") > near).cast("int")).alias("d"))
    base = size.join(dense.withColumnRenamed("i", "sent_no"), ["set_id", "sent_no"], "left").na.fill(0, ["d"]).withColumn("repr", F.col("d") / F.col("n"))
    r = base.select("set_id", "sent_no", "repr")
    both = cos.join(r.toDF("set_id", "i", "ri"), ["set_id", "i"]).join(r.toDF("set_id", "j", "rj"), ["set_id", "j"])
    # pairs without a common word have cosine 0 and need no row
    top = both.groupBy("set_id", "i").agg(F.max(F.when(F.col("rj") > F.col("ri"), F.col("cos"))).alias("up"), F.min("cos").alias("low"), F.count(F.lit(1)).alias("m"))
    most = base.withColumn("top", F.max("repr").over(w))
    out = most.join(top.withColumnRenamed("i", "sent_no"), ["set_id", "sent_no"], "left")
    low = F.when(F.coalesce("m", F.lit(0)) < F.col("n") - 1, 0.0).otherwise(F.coalesce("low", F.lit(0.0)))
    div = F.when(F.col("repr") < F.col("top"), 1 - F.coalesce("up", F.lit(0.0))).otherwise(1 - low)
    length = F.col("el") / F.col("mel") * F.log(F.col("mrl") / F.col("rl"))
    return out.select("set_id", "sent_no", "repr", div.alias("div"), length.alias("len")).withColumn("score", F.log(F.col("repr") + 0.001) + F.log(F.col("div") + 0.001) + F.log(F.col("len") + 0.001))


def rouge_n(pairs: DataFrame, n: int = 1) -> DataFrame:
    """(id, recall, precision, f1) of n-gram overlap between ``cand`` and ``ref`` token arrays.

    Clipped counts, as published: grams are counted per side and joined. Null where a
    side has no n-gram.
    """
    grams = lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.array_join(F.slice(c, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
    g = cut(pairs.select("id", grams(F.col("cand")).alias("c"), grams(F.col("ref")).alias("r")), "grams")
    count = lambda c: g.select("id", F.explode(c).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias(f"n_{c}"))
    hit = count("c").join(count("r"), ["id", "gram"]).groupBy("id").agg(F.sum(F.least("n_c", "n_r")).alias("hit"))
    got = g.select("id", F.size("c").alias("nc"), F.size("r").alias("nr")).join(hit, "id", "left").na.fill(0, ["hit"])
    rec, pre = F.try_divide(F.col("hit"), F.col("nr")), F.try_divide(F.col("hit"), F.col("nc"))
    return got.select("id", rec.alias("recall"), pre.alias("precision"), F.coalesce(F.try_divide(2 * rec * pre, rec + pre), F.lit(0.0)).alias("f1"))
