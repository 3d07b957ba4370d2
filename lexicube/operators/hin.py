"""Typed networks: node ids, encoded edges, edge scores and losses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexicube.functions.vector import dot, edge_rep, sigmoid
from lexicube.operators.common import running
from lexicube.session import cut


def node_ids(edges: DataFrame) -> DataFrame:
    """(type, key, local_id, node_id): dense ids per type by key, shifted by the type's offset.

    The running number is made per range of keys, so no type is sorted by one task;
    the types' offsets are one row a type.
    """
    ends = edges.select(F.col("src_type").alias("type"), F.col("src").cast("string").alias("key")).unionByName(edges.select(F.col("dst_type").alias("type"), F.col("dst").cast("string").alias("key")))
    keys = ends.where("type is not null and key is not null").distinct()
    local = cut(running(keys, ["type"], [F.col("key")], {"no": F.lit(1)}), "numbered")
    size = local.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    first = size.select("type", F.coalesce(F.sum("n").over(Window.orderBy("type").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return local.join(F.broadcast(first), "type").select("type", "key", (F.col("no") - 1).cast("long").alias("local_id"), (F.col("no") - 1 + F.col("first")).cast("long").alias("node_id"))


def encode_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_type, src_id, dst_id, weight) with global node ids."""
    n = nodes.select("type", "key", "node_id")
    a = n.toDF("src_type", "src", "src_id")
    b = n.toDF("dst_type", "dst", "dst_id")
    e = edges.withColumn("src", F.col("src").cast("string")).withColumn("dst", F.col("dst").cast("string"))
    return e.join(a, ["src_type", "src"]).join(b, ["dst_type", "dst"]).select("edge_type", "src_id", "dst_id", "weight")


def offsets(nodes: DataFrame) -> DataFrame:
    """(type, first_id, n): where the ids of each type begin."""
    return nodes.groupBy("type").agg(F.min("node_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def decode(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, name): ``type:key`` of global ids."""
    return ids.join(nodes, "node_id").select("node_id", F.concat_ws(":", "type", "key").alias("name"))


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


def bad_edges(edges: DataFrame, schema: DataFrame) -> DataFrame:
    """Edges whose end types differ from the schema (edge_type, src_type, dst_type) of their type."""
    return edges.join(F.broadcast(schema), ["edge_type", "src_type", "dst_type"], "left_anti")


def link_score(a: Column, b: Column, mode: str = "mul", scales: list[float] | None = None) -> Column:
    """sigmoid of the (scaled) sum of the edge representation."""
    rep = edge_rep(a, b, mode)
    if scales:
        rep = F.zip_with(rep, F.array(*[F.lit(float(s)) for s in scales]), lambda x, s: x * s)
    return sigmoid(F.aggregate(rep, F.lit(0.0), lambda s, x: s + x))


def nce_loss(df: DataFrame, k: int) -> DataFrame:
    """(loss): minus the mean of ln s(pos) + sum of ln s(-neg) / k; ``pos`` and ``neg`` array."""
    neg = F.aggregate(F.transform("neg", lambda x: F.log(sigmoid(-x))), F.lit(0.0), lambda s, x: s + x)
    return df.agg((-F.avg(F.log(sigmoid(F.col("pos"))) + neg / k)).alias("loss"))


def hinge_loss(df: DataFrame) -> DataFrame:
    """(loss): mean of the sum of max(0, neg - pos + 1)."""
    one = F.aggregate(F.transform("neg", lambda x: F.greatest(x - F.col("pos") + 1, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return df.agg(F.avg(one).alias("loss"))


def distmult(a: Column, r: Column, b: Column) -> Column:
    """Sum of a * r * b per dimension."""
    return dot(F.zip_with(a.cast("array<double>"), r.cast("array<double>"), lambda x, y: x * y), b)


def link_labels(labels: DataFrame, nodes: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """``(found, missed)``: labels that are nodes of a type, with their ids, and those that are not."""
    n = nodes.where(F.col("type") == kind).select(F.col("key").alias("label"), "local_id", "node_id")
    return labels.join(n, "label"), labels.join(n, "label", "left_anti")


def cyclic_zip(a: DataFrame, b: DataFrame, key: str = "i") -> DataFrame:
    """Row i of ``a`` with row i mod |b| of ``b``; both have dense numbers ``key`` from 0."""
    n = b.count()
    right = b.withColumnRenamed(key, "__j")
    return a.join(right, F.pmod(F.col(key), F.lit(n)) == F.col("__j")).drop("__j") if n else a.limit(0).join(right)


def clip_norm(vec: Column, most: float) -> Column:
    """A gradient scaled down so that its length is at most ``most``."""
    n = F.sqrt(dot(vec, vec))
    return F.when(n > most, F.transform(vec.cast("array<double>"), lambda x: x * most / n)).otherwise(vec.cast("array<double>"))


def dense_layers(df: DataFrame, vec: str, layers: list[tuple[np.ndarray, np.ndarray | None]], keep: tuple[str, ...], last: str = "none") -> DataFrame:
    """(keep…, vec): vectors through dense layers (weights, bias) with relu between them, in Arrow batches.

    ``last`` is what follows the last layer: ``none``, ``relu`` or ``log_softmax``. Weights
    are a model's fixed small matrices. Rows whose vector is null, incomplete or of another
    length don't come out.
    """
    dim = layers[0][0].shape[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["__v"].to_numpy()).astype(float)
            for i, (w, b) in enumerate(layers):
                x = x @ w + (0.0 if b is None else b)
                if i + 1 < len(layers) or last == "relu":
                    x = np.maximum(x, 0)
            if last == "log_softmax":
                x = x - x.max(axis=1, keepdims=True)
                x = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
            yield pdf[list(keep)].assign(vec=list(x))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", vec array<double>"
    good = df.select(*keep, F.col(vec).cast("array<double>").alias("__v")).where((F.size("__v") == dim) & F.forall("__v", lambda x: x.isNotNull()))
    return good.mapInPandas(run, schema)


def graph_convolution(edges: DataFrame, features: DataFrame, weight: np.ndarray, bias: np.ndarray | None = None, last: str = "relu") -> DataFrame:
    """(node, vec): A (X W) + b of one layer; ``edges`` (src, dst, w) sum the sources' vectors into their ends.

    ``features`` (node, vec). Sums are added up per dimension on the map side first, so a
    node with a third of all edges is no single task. Nodes without an edge into them don't
    come out.
    """
    x = dense_layers(features, "vec", [(weight, None)], ("node",))
    out = weight.shape[1]
    joined = edges.join(x.withColumnRenamed("node", "src"), "src")
    sums = [F.sum(F.get("vec", F.lit(i)) * F.col("w")).alias(f"d{i}") for i in range(out)]
    b = np.zeros(out) if bias is None else bias
    agg = joined.groupBy(F.col("dst").alias("node")).agg(*sums).select("node", *[(F.col(f"d{i}") + float(b[i])).alias(f"d{i}") for i in range(out)])
    vec = F.array(*[F.col(f"d{i}") for i in range(out)])
    if last == "log_softmax":
        top = F.array_max(vec)
        whole = F.aggregate(F.transform(vec, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
        return agg.select("node", F.transform(vec, lambda v: v - top - F.log(whole)).alias("vec"))
    return agg.select("node", (F.transform(vec, lambda v: F.greatest(v, F.lit(0.0))) if last == "relu" else vec).alias("vec"))
