"""Relational building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexicube.session import cut

#: A key counts as hot when it holds more than one in HOT_PARTS of all rows, so
#: there can never be more than HOT_PARTS hot keys: broadcasting them is bounded.
HOT_PARTS = 1000


def current_rows(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Of the rows with one key, the one with the latest ``at``.

    Rows with a null key are dropped; a null ``at`` is older than any other.
    Exact repeats give one row; two states with the same ``at`` are told apart
    by a hash of the row, so the choice is stable. An empty table gives an empty
    one. Spark prunes each partition to one row a key before the shuffle
    (WindowGroupLimit), so a key with a third of all rows does no harm.
    """
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1. ``order`` must be total."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def join_stats(rows: DataFrame, stats: DataFrame, keys: Sequence[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """Join per-key statistics back to the rows they came from, hot keys apart.

    ``stats`` has one row a key and in ``n`` the number of rows with that key;
    ``total`` is the number of all rows. Keys with over total/HOT_PARTS rows are
    at most HOT_PARTS by counting, and are broadcast; all other keys are shuffled,
    none of which can hold more than a thousandth of the rows. ``how`` may be
    ``inner`` or ``left_semi``.
    """
    limit = max(1, total // HOT_PARTS)
    hot = stats.where(F.col(n) > limit)
    cold = stats.where(F.col(n) <= limit)
    few = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), list(keys), how).unionByName(rows.join(few, list(keys), "left_anti").join(cold, list(keys), how))


def sample_k(df: DataFrame, by: Sequence[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows of each group by a seeded hash order: the same rows on any cluster."""
    return top_k(df, by, [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)], k, "__s").drop("__s")


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], values: dict[str, Column], how: str = "sum") -> DataFrame:
    """Running sums (inclusive) of ``values`` along ``order`` in every group of ``by``; with ``how`` max, the largest so far.

    No group is sorted by one task: rows are split by ranges of (group, order), summed
    within a range, and the totals of the ranges before (one row a range and group) are
    added. The ranges are cut, as their bounds are sampled and must not be drawn twice.
    ``order`` must be total. With no ``by`` the whole table is one group.
    """
    each = df.withColumns({f"__v_{k}": v for k, v in values.items()})
    split = cut(each.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum if how == "sum" else F.max
    zero = F.lit(0) if how == "sum" else F.lit(None)
    plus = (lambda a, b: a + b) if how == "sum" else F.greatest  # greatest passes nulls by
    part = split.groupBy("__part", *by).agg(*[total(f"__v_{k}").alias(f"__t_{k}") for k in values])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    keys = ["__part", *by]
    base = part.select(*[F.col(c).alias(f"__k_{c}") for c in keys], *[F.coalesce(total(f"__t_{k}").over(before), zero).alias(f"__b_{k}") for k in values])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    out = split.join(base, same)
    sums = {k: plus(total(f"__v_{k}").over(inside), F.col(f"__b_{k}")) for k in values}
    return out.select(*df.columns, *[c.alias(k) for k, c in sums.items()])
