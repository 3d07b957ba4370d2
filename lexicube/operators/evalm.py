"""Evaluation: fragments, precision, average precision, gain, ROUGE-L."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lexicube.operators.common import running


# The tokens that end a fragment.
BREAKS = (",", ".", "?", "!", ":")


def fragments(abstract: list[str], content: list[str], skip: set[int] = frozenset(), punctuation: tuple[str, ...] = BREAKS) -> list[list[str]]:
    """Greedy longest runs of the abstract that stand in the content, of two tokens or more.

    Positions in ``skip`` (function words) start no run; a token of ``punctuation`` ends one.
    """
    places: dict[str, list[int]] = {}
    for j, t in enumerate(content):
        places.setdefault(t, []).append(j)
    out, i = [], 0
    while i < len(abstract):
        best = 0
        if i not in skip and abstract[i] not in punctuation:
            for j in places.get(abstract[i], ()):
                k = 0
                while i + k < len(abstract) and j + k < len(content) and abstract[i + k] == content[j + k] and abstract[i + k] not in punctuation:
                    k += 1
                best = max(best, k)
        if best > 1:
            out.append(abstract[i : i + best])
        i += max(best, 1)
    return out


def extractive_fragments(pairs: DataFrame) -> DataFrame:
    """(id, fragment array, n) of every pair (id, abstract array, content array).

    With a column ``skip`` (array of positions from 0) no run starts there.
    """
    skip = F.col("skip") if "skip" in pairs.columns else F.lit(None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [fragments(list(a), list(c), frozenset(x if x is not None else ())) if a is not None and c is not None else [] for a, c, x in zip(pdf["abstract"], pdf["content"], pdf["skip"])]
            out = pd.DataFrame({"id": pdf["id"], "fragment": got}).explode("fragment").dropna(subset=["fragment"])
            yield out.assign(n=out["fragment"].map(len))

    return pairs.select("id", "abstract", "content", skip.cast("array<int>").alias("skip")).mapInPandas(run, "id long, fragment array<string>, n int")


def fragment_measures(frags: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, coverage, density, compression): fragment lengths, and their squares, over the length + 0.01.

    compression is the content's length over the abstract's, 0 for an empty abstract.
    """
    f = frags.groupBy("id").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    size = F.coalesce(F.size("abstract"), F.lit(0))
    out = pairs.select("id", size.alias("na"), F.coalesce(F.size("content"), F.lit(0)).alias("nc")).join(f, "id", "left").na.fill(0, ["s", "q"])
    return out.select("id", (F.col("s") / (F.col("na") + 0.01)).alias("coverage"), (F.col("q") / (F.col("na") + 0.01)).alias("density"), F.when(F.col("na") > 0, F.col("nc") / F.col("na")).otherwise(0.0).alias("compression"))


def phrase_precision(phrases: DataFrame, frags: DataFrame) -> DataFrame:
    """(id, precision): distinct phrases found in a fragment of their record over its **fragments**."""
    n = frags.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    hit = phrases.join(frags.select("id", "text"), "id").where(F.expr("instr(text, phrase) > 0")).groupBy("id").agg(F.count_distinct("phrase").alias("hit"))
    return n.join(hit, "id", "left").select("id", (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("precision"))


def average_precision(ranked: DataFrame, group: str) -> DataFrame:
    """(group, ap, positive_rate): sum of recall steps times precision; equal scores step together.

    ``ranked`` has the group, ``score`` and ``relevant`` (0 or 1). Null without a hit.
    """
    per = ranked.groupBy(group, "score").agg(F.count(F.lit(1)).alias("n"), F.sum("relevant").alias("r"))
    run = running(per, [group], [F.col("score").desc()], {"cn": F.col("n"), "cr": F.col("r")})
    agg = run.groupBy(group).agg(F.sum(F.col("r") * F.col("cr") / F.col("cn")).alias("s"), F.sum("r").alias("r"), F.sum("n").alias("n"))
    return agg.select(group, F.try_divide(F.col("s"), F.col("r")).alias("ap"), (F.col("r") / F.col("n")).alias("positive_rate"))


def positions(ranked: DataFrame, group: str, *order: Column) -> DataFrame:
    """``ranked`` with its ``position`` from 0 in each group; ``order`` must be total. No group is sorted by one task."""
    return running(ranked, [group], order, {"position": F.lit(1)}).withColumn("position", F.col("position") - 1)


def dcg(ranked: DataFrame, group: str, k: int | None = None) -> DataFrame:
    """(group, dcg): sum of gain / ln(2 + position), positions from 0 (natural logarithm)."""
    rows = ranked if k is None else ranked.where(F.col("position") < k)
    return rows.groupBy(group).agg(F.sum(F.coalesce("gain", F.lit(0.0)) / F.log(F.col("position") + 2.0)).alias("dcg"))


def top_precision(ranked: DataFrame, group: str, ks: list[int]) -> DataFrame:
    """(group, k, precision): share of relevant ones among the first k."""
    each = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k")
    return each.groupBy(group, "k").agg((F.sum("relevant") / F.col("k")).alias("precision"))


def contained(rows: DataFrame, within: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the first table whose keys the second lacks (null keys are equal)."""
    a, b = rows.select(*keys).distinct(), within.select(*keys).distinct()
    cond = [a[k].eqNullSafe(b[k]) for k in keys]
    return a.join(b, cond, "left_anti")


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one rolling row."""
    code = {t: i for i, t in enumerate(dict.fromkeys(b))}
    y = np.array([code[t] for t in b])
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for t in a:
        if t in code:
            row[1:] = np.maximum(row[1:], row[:-1] + (y == code[t]))
            np.maximum.accumulate(row, out=row)
    return int(row[-1])


def rouge_l(pairs: DataFrame) -> DataFrame:
    """(id, recall, precision, f1) of the longest common subsequence of ``cand`` and ``ref`` token arrays.

    Null where a side is null or empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, a, b in zip(pdf["id"], pdf["cand"], pdf["ref"]):
                if a is None or b is None or not len(a) or not len(b):
                    rows.append((i, None, None, None))
                    continue
                n = longest_common(list(a), list(b))
                p, r = n / len(a), n / len(b)
                rows.append((i, r, p, 2 * p * r / (p + r) if n else 0.0))
            yield pd.DataFrame(rows, columns=["id", "recall", "precision", "f1"])

    return pairs.select("id", "cand", "ref").mapInPandas(run, "id long, recall double, precision double, f1 double")
