"""Inverted index: term counts, document frequencies, tf-idf, dictionaries.

All operators take long tables and ignore rows with a null key or term; an empty
table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexicube.operators.common import join_stats, top_k
from lexicube.session import cut, slots

#: Phrases that more than this share of the pairs of queries and rows have in common are multiplied as matrices
#: (a product through lists takes about 500 times as long as one of those); at most MOST_DENSE, 4 kB a query or row.
DENSE, MOST_DENSE = 0.002, 1000


def postings(df: DataFrame, doc: str, terms: Column) -> DataFrame:
    """(doc_id, phrase, tf) from an array of terms per record; repeated rows add up."""
    each = df.select(F.col(doc).alias("doc_id"), F.explode(terms).alias("phrase")).where("doc_id is not null and phrase is not null")
    return each.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(phrase, df); ``tf`` has one row a document and phrase."""
    return tf.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))


def idf(tf: DataFrame) -> DataFrame:
    """(phrase, df, idf) with idf = ln(N / df), N the documents that hold any term."""
    n = tf.agg(F.count_distinct("doc_id").alias("n"))  # one row
    return document_frequency(tf).join(F.broadcast(n)).select("phrase", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def tfidf(tf: DataFrame) -> DataFrame:
    """(doc_id, phrase, tf, df, score). Words that many documents hold are joined apart (``join_stats``)."""
    return join_stats(tf, idf(tf), ["phrase"], "df", tf.count()).select("doc_id", "phrase", "tf", "df", (F.col("tf") * F.col("idf")).alias("score"))


def tfidf_top(tf: DataFrame, k: int = 10) -> DataFrame:
    """The k best phrases of every document; ties by phrase."""
    return top_k(tfidf(tf), ["doc_id"], [F.col("score").desc(), F.col("phrase")], k)


def tfidf_set_top(tf: DataFrame, sets: DataFrame, k: int = 10) -> DataFrame:
    """The k best (document, phrase) entries of every set; a phrase counts once a document."""
    scored = tfidf(tf).join(sets.select("set_id", "doc_id").where("set_id is not null"), "doc_id")
    return top_k(scored, ["set_id"], [F.col("score").desc(), F.col("phrase"), F.col("doc_id")], k)


def dictionary(tf: DataFrame, least: int = 10, most: int = 200_000) -> DataFrame:
    """(phrase, total, id): phrases by count, ids from 1 (0 is the padding), at most ``most`` with it.

    Ranking needs one order over the kept phrases; those are at most ``most`` rows,
    as a top-k is taken per partition before.
    """
    counts = tf.groupBy("phrase").agg(F.sum("tf").alias("total")).where(F.col("total") >= least)
    kept = counts.orderBy(F.col("total").desc(), "phrase").limit(most - 1)
    return kept.withColumn("id", F.row_number().over(Window.orderBy(F.col("total").desc(), "phrase")).cast("long"))


def encode(df: DataFrame, doc: str, terms: Column, words: DataFrame) -> DataFrame:
    """(doc_id, ids, n_oov): terms as ids in order; unknown ones are dropped and counted."""
    each = df.select(F.col(doc).alias("doc_id"), F.posexplode_outer(terms).alias("pos", "phrase"))
    joined = each.join(words.select("phrase", "id"), "phrase", "left")
    known = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id"))))
    return joined.groupBy("doc_id").agg(F.transform(known, lambda x: x["id"]).alias("ids"), F.sum((F.col("phrase").isNotNull() & F.col("id").isNull()).cast("int")).alias("n_oov"))


def unambiguous(links: DataFrame) -> DataFrame:
    """Links (child, parent) of children with exactly one parent."""
    one = links.groupBy("child").agg(F.count_distinct("parent").alias("n"), F.min("parent").alias("parent")).where("n = 1")
    return one.select("child", "parent")


def seeds(tf: DataFrame, links: DataFrame, k: int = 3) -> DataFrame:
    """(parent, phrase, df, rank): per parent the k unambiguous children most documents hold."""
    held = document_frequency(tf).join(unambiguous(links).withColumnRenamed("child", "phrase"), "phrase")
    return top_k(held, ["parent"], [F.col("df").desc(), F.col("phrase")], k)


def outside_words(tf: DataFrame, known: DataFrame) -> DataFrame:
    """(phrase, total) of phrases that are not in ``known``, most frequent first by total."""
    return tf.join(known.select("phrase"), "phrase", "left_anti").groupBy("phrase").agg(F.sum("tf").alias("total"))


def unit_rows(weights: DataFrame, key: str, value: str) -> DataFrame:
    """Weights of every key at length 1 (the sum of squares is 1)."""
    size = weights.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("__len")).where("__len > 0")
    return weights.join(size, key).withColumn(value, F.col(value) / F.col("__len")).drop("__len")


def sparse_nearest(queries: DataFrame, rows: DataFrame, k: int = 50, query_terms: int = 3_000_000, row_terms: int = 4_000_000, dense: float = DENSE) -> DataFrame:
    """(set_id, doc_id, score, rank): for every query the ``k`` rows with the largest dot product, exactly.

    ``queries`` (set_id, phrase, v) and ``rows`` (doc_id, phrase, w) are sparse vectors.
    Both sides are split by a hash of their key into blocks of about ``query_terms`` and
    ``row_terms`` entries, and each pair of blocks is one task, in strips. Phrases that more
    than ``dense`` of all pairs share are a product of matrices, all others a product
    through inverted lists; so words that all rows hold make no rows, and what is shuffled
    are the vectors, once a block of the other side. Those products are in single
    precision: what their bound of error leaves possible is summed again in double.
    Scores compare at six places, ties go to the smaller id; pairs without a common phrase
    don't come out.
    """
    q = cut(queries.select("set_id", "phrase", F.col("v").cast("double").alias("v")).where("set_id is not null and phrase is not null and v is not null"), "queries")
    r = cut(rows.select("doc_id", "phrase", F.col("w").cast("double").alias("w")).where("doc_id is not null and phrase is not null and w is not null"), "rows")
    q_rows, r_rows = q.count(), r.count()
    q_parts, r_parts = max(1, -(-q_rows // query_terms)), max(1, -(-r_rows // row_terms), slots(q.sparkSession))
    nq, nr = (d.agg(F.approx_count_distinct(c)).first()[0] for d, c in ((q, "set_id"), (r, "doc_id")))  # decides the way of the product only
    both = q.groupBy("phrase").agg(F.count(F.lit(1)).alias("nq")).join(r.groupBy("phrase").agg(F.count(F.lit(1)).alias("nr")), "phrase")
    words = cut(both.withColumn("word", F.monotonically_increasing_id()), "words")
    often = words.where(F.col("nq") * F.col("nr") > dense * nq * nr).orderBy((F.col("nq") * F.col("nr")).desc(), "word").limit(MOST_DENSE)
    frequent = np.array([x.word for x in often.select("word").collect()], dtype=np.int64)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # one row a key and block, phrases as arrays of their numbers
    named = lambda df, n, total: join_stats(df, words.select("phrase", n, "word"), ["phrase"], n, total)
    left = named(q, "nq", q_rows).groupBy("set_id").agg(F.collect_list("word").alias("t"), F.collect_list("v").alias("x")).select("set_id", "t", "x", part("set_id", q_parts).alias("qp"), every(r_parts).alias("rp"))
    right = named(r, "nr", r_rows).groupBy("doc_id").agg(F.collect_list("word").alias("t"), F.collect_list("w").alias("x")).select("doc_id", "t", "x", part("doc_id", r_parts).alias("r_rp"), every(q_parts).alias("r_qp"))
    kind = {c: d.schema[c].dataType.simpleString() for d, c in ((q, "set_id"), (r, "doc_id"))}

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        none = pa.table({"set_id": a["set_id"].slice(0, 0), "doc_id": b["doc_id"].slice(0, 0), "score": pa.array([], pa.float64())})
        if not len(a) or not len(b):
            return none
        (sets, qn, qt, qv), (docs, dn, dt, dw) = _unpack(a, "set_id"), _unpack(b, "doc_id")
        s, j, x = _best_products(len(sets), qn, qt, qv, len(docs), dn, dt, dw, frequent, k)
        return pa.table({"set_id": sets.take(pa.array(s)), "doc_id": docs.take(pa.array(j)), "score": pa.array(x)})

    found = left.groupBy("qp", "rp").cogroup(right.groupBy("r_qp", "r_rp")).applyInArrow(tile, f"set_id {kind['set_id']}, doc_id {kind['doc_id']}, score double")
    return top_k(found, ["set_id"], [F.round("score", 6).desc(), F.col("doc_id")], k)


def _unpack(t: pa.Table, key: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order; row number, phrase number and weight of every entry, by row."""
    t = t.sort_by(key).combine_chunks()
    flat = lambda c: pc.list_flatten(t[c]).combine_chunks().to_numpy(zero_copy_only=False)
    return t[key].combine_chunks(), np.repeat(np.arange(len(t)), pc.list_value_length(t["t"]).to_numpy()), flat("t"), flat("x")


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of every range, one range after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def _by_first(n: int, row: np.ndarray, word: np.ndarray, x: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by the first of the frequent phrases they hold, which parts languages: the order, then the entries by it."""
    key = np.full(n, column.max(initial=0) + 1)
    c = column[word]
    np.minimum.at(key, row[c >= 0], c[c >= 0])
    order = np.argsort(key, kind="stable")
    at = np.empty(n, dtype=np.int64)
    at[order] = np.arange(n)
    by = np.argsort(at[row], kind="stable")
    return order, at[row][by], word[by], x[by]


def _best_products(nq: int, qn, qt, qv, nd: int, dn, dt, dw, frequent: np.ndarray, k: int, side: int = 1024, strip: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, product) of the ``k`` largest products of every query, at six places, ties to the smaller row.

    Queries and rows are numbers from 0, their entries are given by query and by row.
    """
    words, code = np.unique(qt, return_inverse=True)
    at = np.minimum(np.searchsorted(words, dt), len(words) - 1)
    held = words[at] == dt
    dn, dw, at = dn[held], dw[held], at[held]
    column = np.full(len(words), -1)
    often = frequent[np.isin(frequent, words)]  # most frequent first
    column[np.searchsorted(words, often)] = np.arange(len(often))
    wide = max(1, len(often))
    # |x . y - float32 product| <= terms * 2**-24 * |x| |y| and a little for the second order and the inputs
    most = np.bincount(dn, minlength=nd).max(initial=0)
    size = lambda n, x, m: np.sqrt(np.bincount(n, x * x, minlength=m))
    error = 1.01 * 2.0**-24 * (wide + most + 8) * size(qn, qv, nq) * size(dn, dw, nd).max(initial=0)
    slack = 2 * error + 2e-6
    signed = bool((qv < 0).any() or (dw < 0).any())
    # the least product that may still count, from the best found so far
    q_order, pn, pc_, pv = _by_first(nq, qn, code, qv, column)
    d_order, en, eat, ew = _by_first(nd, dn, at, dw, column)
    slack, slack_of = slack[q_order], slack
    top = np.full((nq, k), -np.inf if signed else 1e-30, dtype=np.float32)
    least = top[:, 0].copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    blocks = []
    for lo in range(0, nq, side):
        n = min(side, nq - lo)
        i, e = np.searchsorted(pn, (lo, lo + n))
        c, row, v = column[pc_[i:e]], pn[i:e] - lo, pv[i:e]
        m = np.zeros((n, wide), dtype=np.float32)
        np.add.at(m, (row[c >= 0], c[c >= 0]), v[c >= 0].astype(np.float32))
        rare = np.flatnonzero(c < 0)
        rare = rare[np.argsort(pc_[i:e][rare], kind="stable")]
        start = np.searchsorted(pc_[i:e][rare], np.arange(len(words) + 1)).astype(np.int32)
        blocks.append((lo, n, m, m.any(axis=0), row[rare], v[rare].astype(np.float32), start))
    room = np.empty(min(side, nq) * min(strip, nd), dtype=np.float32)
    for first in range(0, nd, strip):
        width = min(strip, nd - first)
        i, e = np.searchsorted(en, (first, first + width))
        word, row, w = eat[i:e], en[i:e] - first, ew[i:e].astype(np.float32)
        c = column[word]
        m = np.zeros((width, wide), dtype=np.float32)
        np.add.at(m, (row[c >= 0], c[c >= 0]), w[c >= 0])
        word, row, w = word[c < 0], row[c < 0], w[c < 0]
        here = m.any(axis=0)
        for lo, n, mine, there, holders, values, start in blocks:
            both = np.flatnonzero(here & there)
            s = np.matmul(mine[:, both], m[:, both].T, out=room[: n * width].reshape(n, width))
            count = start[word + 1] - start[word]
            some = np.flatnonzero(count)
            # so many products at a time that they fit in memory
            for part in np.array_split(some, max(1, int(count[some].sum()) // 4_000_000 + 1)):
                if len(part):
                    to = _ranges(start[word[part]].astype(np.int64), count[part])
                    np.add.at(s.reshape(-1), holders[to] * width + np.repeat(row[part], count[part]), values[to] * np.repeat(w[part], count[part]))
            if signed:  # without a common phrase a pair isn't one
                s[s == 0] = -np.inf
            # the k best of the maxima of groups of rows are of k rows
            own = top[lo : lo + n]
            group = max(1, width // (8 * k))
            if width >= 2 * k:
                seen = s[:, : width // group * group].reshape(n, -1, group).max(axis=2)
                seen = np.partition(seen, seen.shape[1] - k, axis=1)[:, -k:]
                seen = np.concatenate((own, seen), axis=1)
                own[:] = np.partition(seen, k, axis=1)[:, k:]
                low = own.min(axis=1) - slack[lo : lo + n]
                least[lo : lo + n] = np.maximum(least[lo : lo + n], low)
            cell = np.flatnonzero((s >= least[lo : lo + n, None]) & (s > -np.inf) if signed else s >= least[lo : lo + n, None])
            found.append((cell // width + lo, cell % width + first, s.reshape(-1)[cell]))
        if sum(len(x) for x, _, _ in found) > 6_000_000:
            found = [_keep(found, least)]
    i, j, x = _keep(found, least)
    i, j, slack = q_order[i], d_order[j], slack_of
    order = np.argsort(i, kind="stable")
    i, j, x = i[order], j[order], x[order]
    # again in double
    out = np.zeros(len(i))
    table = np.zeros(len(words))
    d_start, q_start, at_q = np.searchsorted(dn, np.arange(nd + 1)), np.searchsorted(qn, np.arange(nq + 1)), np.searchsorted(i, np.arange(nq + 1))
    length = np.diff(d_start)
    for one in np.flatnonzero(np.diff(at_q)):
        lo, hi = at_q[one], at_q[one + 1]
        if hi - lo > k:  # what the bound leaves
            keep = np.flatnonzero(x[lo:hi] >= np.partition(x[lo:hi], hi - lo - k)[hi - lo - k] - slack[one]) + lo
        else:
            keep = np.arange(lo, hi)
        q = slice(q_start[one], q_start[one + 1])
        np.add.at(table, code[q], qv[q])
        d = j[keep]
        to = _ranges(d_start[d], length[d])
        out[keep] = np.bincount(np.repeat(np.arange(len(d)), length[d]), table[at[to]] * dw[to], minlength=len(d))
        table[code[q]] = 0
    good = np.round(out, 6) != 0
    i, j, out = i[good], j[good], out[good]
    order = np.lexsort((j, -np.round(out, 6), i))
    i, j, out = i[order], j[order], out[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], out[keep]


def _keep(found, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j, x = (np.concatenate(c) for c in zip(*found))
    keep = x >= least[i]
    return i[keep], j[keep], x[keep]
