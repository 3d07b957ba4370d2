"""Vectors (array columns) as Spark expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _d(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if the lengths differ or a part is null."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null (not NaN) for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def scale(a: Column, by: Column) -> Column:
    return F.transform(_d(a), lambda x: x * by)


def unit(a: Column) -> Column:
    """The vector at length 1; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(_d(a), lambda x: x / n))


def usable(a: Column, dim: int) -> Column:
    """``dim`` numbers, none null or NaN, not all zero."""
    good = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(a, lambda x: x != 0)
    return F.coalesce((F.size(a) == dim) & good, F.lit(False))


def set_cosine(a: Column, b: Column) -> Column:
    """Cosine of two binary bags of words, from set sizes alone; null if one is empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.sqrt(F.size(F.array_distinct(a)) * F.size(F.array_distinct(b)).cast("double")), F.lit(0.0))


def overlap(a: Column, b: Column, symmetric: bool = False) -> Column:
    """Common words over the log lengths; the plain form counts the second twice.

    Null where the denominator is 0 (one-word or empty sentences).
    """
    left = F.size(b) if not symmetric else F.size(a)
    return F.try_divide(F.size(F.array_intersect(a, b)), F.log(left.cast("double")) + F.log(F.size(b).cast("double")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def edge_rep(a: Column, b: Column, mode: str) -> Column:
    """Edge vector: ``mul`` product, ``diff`` squared difference, ``sum`` squared sum, ``outer`` symmetrised outer product (flattened)."""
    a, b = _d(a), _d(b)
    if mode == "outer":
        n = F.size(a)
        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: (F.get(a, i) * F.get(b, j) + F.get(a, j) * F.get(b, i)) / 2)))
    f = {"mul": lambda x, y: x * y, "diff": lambda x, y: (x - y) * (x - y), "sum": lambda x, y: (x + y) * (x + y)}[mode]
    return F.zip_with(a, b, f)


def vector_sum(c: Column, dim: int) -> list[Column]:
    """Aggregates that add vectors up per dimension (partial sums on the map side)."""
    return [F.sum(F.get(c, i).cast("double")).alias(f"d{i}") for i in range(dim)]


def mean_vector(df, by: list[str], vec: str, dim: int, weight: Column | None = None, out: str = "vec"):
    """Mean (or weighted mean) vector per group; a group of zero weight gives null."""
    w = F.lit(1.0) if weight is None else weight
    sums = [F.sum(F.get(F.col(vec), F.lit(i)).cast("double") * w).alias(f"__d{i}") for i in range(dim)]
    g = df.groupBy(*by).agg(F.sum(w).alias("__w"), *sums)
    return g.select(*by, F.when(F.col("__w") != 0, F.array(*[F.col(f"__d{i}") / F.col("__w") for i in range(dim)])).alias(out))
