"""Problem 7: filling containers of one capacity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexicube.llm.tokenize import VOCABULARY, token_count
from lexicube.session import cut, partitions_for, table

_BIN = "bin long, fill int, closed boolean, members array<struct<item:bigint,piece:int,size:int>>"


def _fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing: the bins as lists of positions.

    Open bins are stacked by their room; bit r of ``rooms`` says that a bin with
    room r exists, so the tightest bin that fits is found in one step.
    """
    stacks: dict[int, list[int]] = {}
    rooms, bins = 0, []
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= size
        if room:
            stacks.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins


def _round(df: DataFrame, capacity: int, full: float, no: int) -> DataFrame:
    """One best-fit round within each partition. Rows are bins; so are the results."""
    least = int(np.ceil(full * capacity))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        pdfs = [p for p in batches if len(p)]
        if not pdfs:
            return
        pdf = pd.concat(pdfs, ignore_index=True)
        fill, members = pdf["fill"].to_numpy(), pdf["members"].to_numpy()
        first = (no << 56) | (task.partitionId() << 32)
        bins = _fit(fill, capacity)
        for at in range(0, len(bins), 2000):
            rows = []
            for b, own in enumerate(bins[at : at + 2000], at):
                total = int(fill[own].sum())
                rows.append((first | b, total, total >= least, [m for i in own for m in members[i]]))
            yield pd.DataFrame(rows, columns=["bin", "fill", "closed", "members"])

    return df.select("fill", "members").mapInPandas(run, _BIN)


def pack(items: DataFrame, item: str, size: str, capacity: int = 2048, full: float = 0.98, rows_per_task: int = 100_000) -> DataFrame:
    """Pack items into bins: (bin, item, piece, size, fill), one row per piece.

    An item larger than ``capacity`` is cut into full pieces and a rest; nothing
    else is cut. Hierarchical residual packing: every partition packs its own
    items by best fit; bins filled to ``full`` are emitted, underfull ones go on as
    items of the next round, which runs over a quarter of the partitions.

    Two bins can only be joined if one of them is at most half full, and best fit leaves a
    partition at most one such bin. So of a round only those go on, and as many of the
    others as there are of them, the roomiest first: no choice of hosts can take in more.
    All others are final. Hence a round moves at most two bins a partition of the round
    before, and it ends when one bin at most half full is left or one partition.

    Items with a null or non-positive size come out with a null bin and piece 0;
    repeated items are packed as often as they come; an empty table gives an empty
    one. A task never holds more than ``rows_per_task`` rows on average, and a bin
    never more than ``capacity`` pieces. All rounds but the first move residues only.
    """
    spark = items.sparkSession
    n = F.col(size).cast("long")
    src = items.select(F.col(item).cast("long").alias("item"), n.alias("n"))
    pieces = src.where("n > 0").select("item", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {capacity}"))).alias("piece", "k"))
    pieces = pieces.select("item", "piece", F.least(F.col("n") - F.col("k") * capacity, F.lit(capacity)).cast("int").alias("size"))
    first = cut(pieces.unionByName(src.where("n is null or n <= 0").select("item", F.lit(0).alias("piece"), F.coalesce("n", F.lit(0)).cast("int").alias("size"))), "pieces")
    live = first.where("size > 0")
    count = live.count()
    rows = live.select(F.col("size").alias("fill"), F.array(F.struct("item", "piece", "size")).alias("members"))
    done: DataFrame | None = None
    no, parts = 0, partitions_for(spark, count, rows_per_task)
    while count:
        made = cut(_round(rows.repartition(parts), capacity, full, no), "bins")
        half = made.where((~F.col("closed")) & (F.col("fill") * 2 <= capacity))
        small = half.count()
        if parts == 1 or small <= 1:
            done = made if done is None else done.unionByName(made)
            break
        hosts = made.where((~F.col("closed")) & (F.col("fill") * 2 > capacity)).orderBy("fill", "bin").limit(small)
        rows = cut(half.unionByName(hosts), "residues")
        emit = made.join(rows.select("bin"), "bin", "left_anti")
        done = emit if done is None else done.unionByName(emit)
        no, parts = no + 1, max(1, parts // 4)
    none = first.where("size <= 0").select(F.lit(None).cast("long").alias("bin"), "item", "piece", "size", F.lit(None).cast("int").alias("fill"))
    if done is None:
        return none
    each = done.select("bin", "fill", F.explode("members").alias("m")).select("bin", "m.item", "m.piece", "m.size", "fill")
    return each.unionByName(none)


def sized_documents(spark: SparkSession, folder: str, path: str = VOCABULARY) -> DataFrame:
    """``documents`` with ``n_tokens`` of their whole text."""
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", "source", token_count(F.col("text"), path).alias("n_tokens"))


def p7_bins(spark: SparkSession, folder: str, capacity: int = 2048, path: str = VOCABULARY) -> DataFrame:
    """Every document, or its pieces, with the container it lies in."""
    out = pack(sized_documents(spark, folder, path), "doc_id", "n_tokens", capacity)
    return out.select(F.col("bin").alias("bin_id"), F.col("item").alias("doc_id"), F.col("piece").alias("piece_no"), F.col("size").alias("n_tokens"))


def p7_fill(spark: SparkSession, folder: str, capacity: int = 2048, path: str = VOCABULARY) -> DataFrame:
    """One row: containers, the least number possible, pieces, tokens, and the share of room left."""
    bins = p7_bins(spark, folder, capacity, path).where("bin_id is not null").groupBy("bin_id").agg(F.sum("n_tokens").alias("fill"), F.count(F.lit(1)).alias("n_pieces"))
    out = bins.agg(F.count(F.lit(1)).alias("n_bins"), F.coalesce(F.sum("n_pieces"), F.lit(0)).alias("n_pieces"), F.coalesce(F.sum("fill"), F.lit(0)).alias("n_tokens"), F.coalesce(F.max("fill"), F.lit(0)).alias("fullest"))
    return out.select("n_bins", F.ceil(F.col("n_tokens") / capacity).alias("least_bins"), "n_pieces", "n_tokens", "fullest", F.coalesce(F.round(1 - F.col("n_tokens") / (F.col("n_bins") * capacity), 6), F.lit(0.0)).alias("room_left"))
