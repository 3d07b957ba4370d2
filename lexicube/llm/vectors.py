"""Usable vectors of a table as unit vectors in binary form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexicube.functions.vector import usable
from lexicube.operators.common import current_rows
from lexicube.session import table

DIM = 100


def matrix(col: pd.Series) -> np.ndarray:
    """Rows of bytes as a float32 matrix."""
    return np.frombuffer(b"".join(col), dtype="<f4").reshape(len(col), -1)


def unit_vectors(df: DataFrame, id: str, vec: str, dim: int = DIM) -> DataFrame:
    """(id long, v binary): usable vectors at length 1, float32.

    Usable: ``dim`` numbers, none null, NaN or infinite, not all zero. Others, and
    rows with a null id, don't come out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            big = np.abs(x).max(axis=1, keepdims=True)
            good = np.isfinite(big[:, 0])
            x, big = x[good], big[good]
            x = x / big  # so that the squares of very long or short vectors stay in range
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[good], "v": [r.tobytes() for r in x.astype("<f4")]})

    good = df.select(F.col(id).cast("long").alias("id"), F.col(vec).alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec"), dim))
    return good.mapInPandas(run, "id long, v binary")


def emb_vectors(spark: SparkSession, folder: str) -> DataFrame:
    cur = current_rows(table(spark, folder, "emb").select("emb_id", "embedding", "ingested_at"), ["emb_id"], "ingested_at")
    return unit_vectors(cur, "emb_id", "embedding")


def all_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Usable vectors of the current ``emb`` rows and of ``topics``."""
    return emb_vectors(spark, folder).unionByName(unit_vectors(table(spark, folder, "topics"), "emb_id", "label2emb"))
