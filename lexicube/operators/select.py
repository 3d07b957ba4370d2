"""Budgeted greedy choice of sentences, one set a task.

A set is a bounded unit (the sentences of a few documents). Values compare at nine
places and ties go to the earlier sentence, so results don't depend on the engine. Sentences with a null set are ignored, empty ones are never picked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexicube.operators.evalm import longest_common

_PICKS = "set_id long, sent_no int, pick int"


def _greedy(n: int, value: Callable[[int, list[int]], float], fits: Callable[[int, list[int]], bool], stop_below: float | None = None, most: int | None = None) -> list[int]:
    """Take the best of the rest again and again; the best is consumed even if it doesn't fit."""
    left, picked = list(range(n)), []
    while left and (most is None or len(picked) < most):
        values = [round(value(i, picked), 9) for i in left]
        j = int(np.argmax(values))
        if stop_below is not None and values[j] < stop_below:
            break
        i = left.pop(j)
        if fits(i, picked):
            picked.append(i)
    return picked


def coverage_summary(tokens: list[list[str]], scores: dict[str, float], budget: int = 200) -> list[int]:
    """Score per token plus twice the covered share of the scored phrases."""
    scored = [{t for t in s if t in scores} for s in tokens]
    every = set().union(*scored) if scored else set()
    quality = [sum(scores[t] for t in sorted(own)) / len(s) if s else -1.0 for own, s in zip(scored, tokens)]
    held: set[str] = set()
    seen: list[int] = []

    def value(i: int, picked: list[int]) -> float:
        if not tokens[i]:
            return -1.0
        if not picked or not every:
            return quality[i]
        if len(seen) < len(picked):  # what was picked since
            held.update(*(scored[j] for j in picked[len(seen) :]))
            seen[:] = picked
        return quality[i] + 2 * (len(held) + len(scored[i] - held)) / len(every)

    return _greedy(len(tokens), value, lambda i, p: sum(len(tokens[j]) for j in p) + len(tokens[i]) <= budget, stop_below=0.0)


def spread_summary(tokens: list[list[str]], score: np.ndarray, similarity: np.ndarray, budget: int, beta: float = 0.4, penalty: float = 0.5) -> list[int]:
    """(s_i - penalty * max similarity * s_j) / length**beta, characters strictly below ``budget``."""
    size = [len(" ".join(t)) for t in tokens]

    def value(i: int, picked: list[int]) -> float:
        less = max((similarity[i, j] * score[j] for j in picked), default=0.0)
        return float(score[i] - penalty * less) / max(1, size[i]) ** beta

    return _greedy(len(tokens), value, lambda i, p: sum(size[j] for j in p) + size[i] < budget)


def novelty_summary(tokens: list[list[str]], scores: dict[str, float], weight: float = 0.5, power: float = 0.5, budget: int | None = None, count: int | None = None) -> list[int]:
    """(sum of scores + weight * number of new phrases) / length**power, by characters or sentences."""
    scored = [{t for t in s if t in scores} for s in tokens]
    size = [len(" ".join(t)) for t in tokens]

    def value(i: int, picked: list[int]) -> float:
        old = set().union(*(scored[j] for j in picked)) if picked else set()
        return (sum(scores[t] for t in sorted(scored[i])) + weight * len(scored[i] - old)) / max(1, size[i]) ** power

    return _greedy(len(tokens), value, lambda i, p: budget is None or sum(size[j] for j in p) + size[i] <= budget, most=count)


def share_summary(tokens: list[list[str]], score: np.ndarray, phrases: set[str], count: int, weight: float = 100.0) -> list[int]:
    """score + weight * covered share of the phrases, ``count`` sentences."""
    own = [phrases & set(t) for t in tokens]
    return _greedy(len(tokens), lambda i, p: float(score[i]) + weight * len(set().union(own[i], *(own[j] for j in p))) / max(1, len(phrases)), lambda i, p: True, most=count)


def first_fit(sizes: list[int], score: np.ndarray, budget: int, stop: bool = False) -> list[int]:
    """By falling score, whatever fits; ``stop`` ends at the first that doesn't."""
    picked, used = [], 0
    for i in np.argsort(-np.asarray(score, dtype=float), kind="stable"):
        if used + sizes[i] <= budget:
            picked.append(int(i))
            used += sizes[i]
        elif stop:
            break
    return picked


def common_run_share(a: list[str], b: list[str]) -> float:
    """Longest common subsequence over the length of ``a``; 0 for an empty one."""
    return longest_common(a, b) / len(a) if a and b else 0.0


def varied_summary(tokens: list[list[str]], scores: dict[str, float], budget: int = 200) -> list[int]:
    """Score per token less the largest longest-common-subsequence share with a pick, within ``budget`` tokens."""
    quality = [sum(scores[t] for t in sorted({t for t in s if t in scores})) / len(s) if s else -1.0 for s in tokens]
    known: dict[tuple[int, int], float] = {}

    def like(i: int, j: int) -> float:
        if (i, j) not in known:
            known[i, j] = common_run_share(tokens[i], tokens[j])
        return known[i, j]

    return _greedy(len(tokens), lambda i, p: quality[i] - max((like(i, j) for j in p), default=0.0), lambda i, p: bool(tokens[i]) and sum(len(tokens[j]) for j in p) + len(tokens[i]) <= budget)


def diverse_phrases(relevance: np.ndarray, similarity: np.ndarray, weight: float, k: int) -> list[int]:
    """Quadratic diversified ranking: relevance less the weighted similarity to the picks."""
    picked: list[int] = []
    base = weight * similarity @ relevance * relevance
    less = np.zeros(len(relevance))
    for _ in range(min(k, len(relevance))):
        gain = np.round(base - less, 9)
        gain[picked] = -np.inf
        picked.append(int(np.argmax(gain)))
        less = less + relevance[picked[-1]] * similarity[:, picked[-1]] * relevance
    return picked


def select_phrases(phrases: DataFrame, k: int = 10, weight: float = 1.0) -> DataFrame:
    """(set_id, phrase, pick): diversified choice among the phrases of a set.

    ``phrases`` (set_id, phrase, score, vec): relevance and vector; the similarity of two
    phrases is the cosine of their vectors, 0 without one. Ties go to the smaller phrase.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("phrase")
        dim = max([len(v) for v in pdf["vec"] if v is not None], default=1)
        x = np.stack([np.asarray(v, dtype=float) if v is not None and len(v) == dim else np.zeros(dim) for v in pdf["vec"]])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        got = diverse_phrases(pdf["score"].to_numpy(float), x @ x.T, weight, k)
        return pd.DataFrame({"set_id": pdf["set_id"].iloc[0], "phrase": pdf["phrase"].to_numpy()[got], "pick": np.arange(1, len(got) + 1)})

    rows = phrases.where("set_id is not null and phrase is not null and score is not null").select(F.col("set_id").cast("long").alias("set_id"), "phrase", F.col("score").cast("double").alias("score"), F.col("vec").cast("array<double>").alias("vec"))
    return rows.groupBy("set_id").applyInPandas(run, "set_id long, phrase string, pick int")


def overlap_matrix(tokens: list[list[str]], symmetric: bool = True) -> np.ndarray:
    """Common words over the sum of log lengths, for all pairs of a set; 0 where that is not positive."""
    own = [set(t) for t in tokens]
    size = np.log(np.maximum([len(t) for t in tokens], 1))
    common = np.array([[len(a & b) for b in own] for a in own], dtype=float).reshape(len(own), len(own))
    low = (size[:, None] if symmetric else size[None]) + size[None]
    out = np.divide(common, low, out=np.zeros_like(common), where=low > 0)
    np.fill_diagonal(out, 0)
    return out


def select_sets(sentences: DataFrame, scores: DataFrame, method: str = "coverage", budget: int = 200, normalise: bool = True) -> DataFrame:
    """(set_id, sent_no, pick): chosen sentences in the order of choice, from 1.

    ``sentences`` (set_id, sent_no, tokens), ``scores`` (set_id, phrase, score).
    Methods: ``coverage`` and ``varied`` (tokens), ``novelty`` (characters), ``novelty_count``.
    """

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame(columns=["set_id", "sent_no", "pick"])
        a = a.sort_values("sent_no", kind="stable")
        words = [[t.lower() if normalise else t for t in x] if x is not None else [] for x in a["tokens"]]
        known = dict(zip(b["phrase"], b["score"]))
        if method == "coverage":
            got = coverage_summary(words, known, budget)
        elif method == "varied":
            got = varied_summary(words, known, budget)
        elif method == "novelty":
            got = novelty_summary(words, known, budget=budget)
        else:
            got = novelty_summary(words, known, weight=40, power=0.1, count=budget)
        return pd.DataFrame({"set_id": a["set_id"].iloc[0], "sent_no": a["sent_no"].to_numpy()[got], "pick": np.arange(1, len(got) + 1)})

    left = sentences.select(F.col("set_id").cast("long").alias("set_id"), F.col("sent_no").cast("int").alias("sent_no"), "tokens").where("set_id is not null")
    right = scores.select(F.col("set_id").cast("long").alias("sid"), "phrase", F.col("score").cast("double").alias("score")).where("phrase is not null and score is not null")
    return left.groupBy("set_id").cogroup(right.groupBy("sid")).applyInPandas(run, _PICKS)


def select_scored(sentences: DataFrame, scores: DataFrame, method: str = "first_fit", budget: int = 200, phrases: DataFrame | None = None) -> DataFrame:
    """(set_id, sent_no, pick): as :func:`select_sets`, for scores (set_id, sent_no, score) of sentences.

    Methods: ``first_fit`` (tokens; what doesn't fit is passed by), ``first_stop`` (the
    first that doesn't fit ends it), ``spread`` (characters, less what is like a pick),
    ``spread_count`` (so many sentences, length counts nothing), ``share`` (so many
    sentences, covering the ``phrases`` (set_id, phrase) of the set). Sentences without a
    score count 0.
    """
    joined = sentences.select(F.col("set_id").cast("long").alias("set_id"), F.col("sent_no").cast("int").alias("sent_no"), "tokens").where("set_id is not null")
    joined = joined.join(scores.select(F.col("set_id").cast("long").alias("set_id"), F.col("sent_no").cast("int").alias("sent_no"), F.col("score").cast("double").alias("score")), ["set_id", "sent_no"], "left").na.fill(0.0, ["score"])
    wanted = (sentences.sparkSession.createDataFrame([], "set_id long, phrase string") if phrases is None else phrases).groupBy(F.col("set_id").cast("long").alias("sid")).agg(F.collect_set("phrase").alias("phrases"))
    joined = joined.join(wanted, F.col("set_id") == F.col("sid"), "left").drop("sid")

    def run(a: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("sent_no", kind="stable")
        words, score = [list(x) if x is not None else [] for x in a["tokens"]], np.round(a["score"].to_numpy(float), 9)
        sizes = [len(w) for w in words]
        if method in ("first_fit", "first_stop"):
            got = first_fit(sizes, score, budget, method == "first_stop")
        elif method == "spread":
            got = spread_summary(words, score, overlap_matrix(words), budget)
        elif method == "spread_count":
            like = overlap_matrix(words)
            got = _greedy(len(words), lambda i, p: float(score[i]) - 0.5 * max((like[i, j] * score[j] for j in p), default=0.0), lambda i, p: True, most=budget)
        else:
            first = a["phrases"].iloc[0]
            got = share_summary(words, score, set(first if first is not None else ()), budget)
        return pd.DataFrame({"set_id": a["set_id"].iloc[0], "sent_no": a["sent_no"].to_numpy()[got], "pick": np.arange(1, len(got) + 1)})

    return joined.groupBy("set_id").applyInPandas(run, _PICKS)
