"""Problem 4: the most similar vectors of every vector, by a block matrix join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexicube.llm.vectors import all_vectors, matrix
from lexicube.session import cut, slots

#: Rows of a block side: a task holds two blocks of float32 vectors and one strip of products.
BLOCK = 8192
#: The index is fitted on at most so many vectors, taken in a hash order of the ids; with more
#: than a quarter as many lists (16 billion vectors) lists grow instead of their number.
SAMPLE = 20_000
#: A table searched by another is sent to all tasks up to this many vectors (1.6 MB at 100 numbers).
SMALL = 4096


def fit_lists(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means; empty lists take the vectors that fit worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        aff = x @ c.T
        own = aff.argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        size = np.linalg.norm(new, axis=1)
        empty = np.flatnonzero(size < 1e-9)
        if len(empty):
            worst = np.argsort(aff.max(axis=1), kind="stable")[: len(empty)]
            new[empty[: len(worst)]] = x[worst]
            size = np.linalg.norm(new, axis=1)
        c = new / np.maximum(size, 1e-9)[:, None]
    return c.astype(np.float32)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales and the lengths of what is lost."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale.astype(np.float32), np.linalg.norm(x - q * scale[:, None], axis=1).astype(np.float32)


def nearest_in_block(qid: np.ndarray, q: np.ndarray, mid: np.ndarray, m: np.ndarray, k: int, strip: int = 512, alone: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k nearest of ``m`` for each of ``q``, strip by strip: (rows of q, rows of m, cosines), best first.

    int8 products give every cosine to within the sum of what the two vectors lost
    in quantisation. Of each row, the k-th best of the maxima of column groups is a
    floor for the k-th best; pairs that even with their error bound stay below it
    are out, the others are computed again in double precision. Ties go to the
    smaller id. With ``alone`` the vector itself (the same id) is left out.
    """
    q8, qs, ql = quantise(q)
    m8, ms, ml = quantise(m)
    ends = m8.astype(np.float32) * ms[:, None]  # int8 values at their scale: products stay exact to 1e-5
    want = k + 1
    groups = max(1, min(len(m), 16 * want))
    width = -(-len(m) // groups)
    pad = (-len(m)) % width
    for at in range(0, len(q), strip):
        rows = slice(at, min(len(q), at + strip))
        est = (q8[rows].astype(np.float32) @ ends.T) * qs[rows, None]
        slack = ql[rows] + ml.max() * (1 + ql[rows]) + 1e-5
        if len(m) > want:
            full = np.pad(est, ((0, 0), (0, pad)), constant_values=-2.0) if pad else est
            tops = full.reshape(len(est), -1, width).max(axis=2)
            floor = np.partition(tops, -want, axis=1)[:, -want] if tops.shape[1] > want else np.full(len(est), -2.0, dtype=np.float32)
            i, j = np.nonzero(est >= (floor - 2 * slack)[:, None])
        else:
            i, j = np.divmod(np.arange(len(est) * len(m)), len(m))
        if alone:
            other = qid[rows][i] != mid[j]
            i, j = i[other], j[other]
        sim = np.einsum("ij,ij->i", q[rows][i], m[j], dtype=np.float64)
        order = np.lexsort((mid[j], -sim, i))
        i, j, sim = i[order], j[order], sim[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield i[best] + at, j[best], sim[best]


def _rows(table: pa.Table, id: str, v: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of an Arrow table, without a copy per row."""
    col = table.column(v).combine_chunks()
    col = col if isinstance(col, pa.Array) else pa.concat_arrays(col.chunks)
    size = len(col[0].as_py())
    flat = np.frombuffer(col.buffers()[2], dtype=np.uint8)
    first = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset]
    return table.column(id).to_numpy(), flat[first : first + size * len(col)].view("<f4").reshape(len(col), -1)


def _nearest_few(vectors: DataFrame, held: DataFrame, k: int, near_type: str, alone: bool) -> DataFrame:
    """The neighbours among at most ``SMALL`` vectors: those are sent to every task, nothing is shuffled."""
    few = held.toPandas()
    mid, m = few["id"].to_numpy(), matrix(few["v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            qid, q = _rows(pa.Table.from_batches([batch]), "id", "v")
            for i, j, sim in nearest_in_block(qid, q, mid, m, k, alone=alone):
                rows, count = np.unique(i, return_counts=True)
                offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(sim), pa.array(mid[j])], names=["sim", "id"])
                yield pa.RecordBatch.from_arrays([pa.array(qid[rows]), pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=["id", "near"])

    return vectors.select("id", "v").mapInArrow(run, near_type)


def nearest(vectors: DataFrame, k: int = 10, margin: float = 0.25, among: DataFrame | None = None, block: int = BLOCK, sample: int = SAMPLE, whole: float = 1.0) -> DataFrame:
    """(id, near array<struct<sim double, id long>>): the k nearest of every vector.

    ``vectors`` has ``id`` (unique) and ``v`` (unit float32 vectors as bytes); the
    neighbours are searched ``among`` another such table, by default the same one.

    Coarse lists, sqrt(n) / 2 of them, are fitted on a bounded sample; every vector
    belongs to the list of its nearest centre and is compared with the lists near
    it: those whose border with its own list is at most ``margin`` away. By the
    geometry of the border a pair of a cosine above 1 - margin**2 / 2 (0.969) is never
    missed. Of others, the component of their difference along the normal of a border
    decides: in 100 dimensions a pair of a cosine of 0.9 is 0.45 apart, of which a random
    direction holds 0.045, so the margin is over five of these. Recall of the ten nearest and
    the share of pairs compared are in the README, as measured. ``margin`` 2 compares
    with all lists and is exact.

    Lists that are near each other form a group of about ``block`` vectors, and a vector is
    sent once to each group in which it asks a list: mostly one to three, as the lists near
    it are near each other. Both sides of a group are split by a hash of the id into parts of
    about ``block`` rows, so a list with a third of all vectors becomes many tasks. A task
    gives at most k neighbours a vector; those of its groups are merged by a sort. A task of
    which more than a share ``whole`` of the pairs are asked compares all its pairs in one
    product: vectors without groups ask most lists, and a product a list is slower then.

    An empty table gives an empty one; fewer than k others give as many as there are;
    equal vectors are ordinary neighbours with cosine 1. Only with ``among`` may a
    vector's own id be among its neighbours.
    """
    spark = vectors.sparkSession
    near_type = "id long, near array<struct<sim:double,id:bigint>>"
    base = vectors if among is None else among
    held = cut(base.select("id", "v"), "vectors")
    n = held.count()
    if n == 0:
        return spark.createDataFrame([], near_type)
    if n <= SMALL:
        return _nearest_few(held if among is None else vectors, held, k, near_type, among is None)
    lists = max(1, min(sample // 4, math.ceil(math.sqrt(n) / 2)))
    drawn = held.select(F.xxhash64("id").alias("h"), "v").orderBy("h").limit(sample).toPandas()
    centres = fit_lists(matrix(drawn["v"]), lists)
    groups = max(1, min(lists, max(-(-n // block), 2 * slots(spark))))
    home = (centres @ fit_lists(centres, groups).T).argmax(axis=1).astype(np.int32)
    sent = spark.sparkContext.broadcast((centres, np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)).astype(np.float32), home))

    def lists_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own list of each row; rows and lists of all that is asked, by row and group."""
        centres, gap, home = sent.value
        aff = matrix(pdf["v"]) @ centres.T
        own = aff.argmax(axis=1)
        row, at = np.nonzero(aff.max(axis=1)[:, None] - aff <= margin * gap[own])
        order = np.lexsort((at, home[at], row))
        return own, row[order], at[order]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        home = sent.value[2]
        for pdf in batches:
            if len(pdf):
                own, row, at = lists_of(pdf)
                once = np.unique(row * (home.max() + 1) + home[at]) % (home.max() + 1)
                yield pd.DataFrame({"grp": np.arange(groups, dtype=np.int32), "members": np.bincount(home[own], minlength=groups), "asking": np.bincount(once, minlength=groups)})

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, _, home = sent.value
        for pdf in batches:
            if len(pdf):
                own = (matrix(pdf["v"]) @ centres.T).argmax(axis=1)
                yield pd.DataFrame({"m_id": pdf["id"], "m_v": pdf["v"], "m_list": own.astype(np.int32), "m_grp": home[own]})

    def askers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        home = sent.value[2]
        for pdf in batches:
            if len(pdf):
                _, row, at = lists_of(pdf)
                first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (home[at[1:]] != home[at[:-1]]))))
                ends, at = np.append(first[1:], len(at)), at.astype(np.int32)
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[row[first]], "v": pdf["v"].to_numpy()[row[first]], "asks": [at[i:j] for i, j in zip(first, ends)], "grp": home[at[first]]})

    asker = held if among is None else cut(vectors.select("id", "v"), "asking")
    size = "grp int, members long, asking long"
    per = {r.grp: r for r in held.mapInPandas(count, size).groupBy("grp").agg(F.sum("members").alias("members"), F.sum("asking").alias("asking")).collect()}
    asking = {g: r.asking for g, r in per.items()} if among is None else {r.grp: r.asking for r in asker.mapInPandas(count, size).groupBy("grp").agg(F.sum("asking").alias("asking")).collect()}
    plan = [(g, max(1, -(-per[g].members // block)), max(1, -(-asking[g] // block))) for g in asking if g in per and asking[g] and per[g].members]
    if not plan:
        return spark.createDataFrame([], near_type)
    parts = F.broadcast(spark.createDataFrame(plan, "grp int, m_parts int, q_parts int"))  # one row a group
    salt = lambda id, c: F.pmod(F.xxhash64(id, F.lit(1)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asker.select("id", "v").mapInPandas(askers, "id long, v binary, asks array<int>, grp int").join(parts, "grp").select("id", "v", "asks", "grp", salt("id", "q_parts").alias("q_part"), every("m_parts").alias("m_part"))
    right = held.mapInPandas(members, "m_id long, m_v binary, m_list int, m_grp int").join(parts.withColumnRenamed("grp", "m_grp"), "m_grp").select("m_id", "m_v", "m_list", "m_grp", salt("m_id", "m_parts").alias("m_m_part"), every("q_parts").alias("m_q_part"))
    alone = among is None
    near_arrow = pa.list_(pa.struct([("sim", pa.float64()), ("id", pa.int64())]))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if a.num_rows and b.num_rows:
            qid, q = _rows(a, "id", "v")
            mid, m = _rows(b, "m_id", "m_v")
            asks = a.column("asks").combine_chunks()
            asks = asks if isinstance(asks, pa.Array) else pa.concat_arrays(asks.chunks)
            who, which = np.repeat(np.arange(len(asks)), asks.value_lengths().to_numpy()), asks.flatten().to_numpy()
            who, which = who[order := np.argsort(which, kind="stable")], which[order]
            own = b.column("m_list").to_numpy()
            at = np.argsort(own, kind="stable")
            asked = (np.searchsorted(own[at], which, "right") - np.searchsorted(own[at], which)).sum()
            if asked > whole * a.num_rows * b.num_rows:
                got += [(i, mid[j], sim) for i, j, sim in nearest_in_block(qid, q, mid, m, k, alone=alone)]
                which = which[:0]
            for x in np.unique(own) if len(which) else ():
                rows = who[slice(*np.searchsorted(which, (x, x + 1)))]
                held_ = at[slice(*np.searchsorted(own[at], (x, x + 1)))]
                if len(rows):
                    got += [(rows[i], mid[held_[j]], sim) for i, j, sim in nearest_in_block(qid[rows], q[rows], mid[held_], m[held_], k, alone=alone)]
        if not got:
            return pa.table({"id": pa.array([], pa.int64()), "near": pa.array([], near_arrow)})
        i, other, sim = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((other, -sim, i))
        i, other, sim = i[order], other[order], sim[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, other, sim = i[best], other[best], sim[best]
        rows, n = np.unique(i, return_counts=True)
        offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(sim), pa.array(other)], names=["sim", "id"])
        return pa.table({"id": pa.array(qid[rows]), "near": pa.ListArray.from_arrays(pa.array(offsets), pairs)})

    tiles = left.groupBy("grp", "m_part", "q_part").cogroup(right.groupBy("m_grp", "m_m_part", "m_q_part")).applyInArrow(tile, near_type)
    order = lambda x: F.struct((-x["sim"]).alias("d"), x["id"].alias("id"))
    merged = tiles.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))
    best = F.slice(F.array_sort(F.transform("near", order)), 1, k)
    return merged.select("id", F.transform(best, lambda x: F.struct((-x["d"]).alias("sim"), x["id"].alias("id"))).alias("near"))


def p4_nearest(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    """The ten most similar vectors of every usable vector."""
    out = nearest(all_vectors(spark, folder), k)
    return out.select(F.col("id").alias("emb_id"), F.posexplode("near").alias("pos", "x")).select("emb_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("other_id"), F.round("x.sim", 5).alias("cosine"))


def p4_found(spark: SparkSession, folder: str, k: int = 10, least: float = 0.9) -> DataFrame:
    """Pairs with a cosine of ``least`` or more of which one is among the other's k nearest."""
    out = nearest(all_vectors(spark, folder), k).select("id", F.explode("near").alias("x")).where(F.col("x.sim") >= least)
    return out.select(F.least("id", "x.id").alias("emb_id_a"), F.greatest("id", "x.id").alias("emb_id_b")).distinct()
