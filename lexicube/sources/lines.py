"""Loading record lines with the rows that fail to parse set apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexicube.operators.common import running
from lexicube.session import cut
from lexicube.sources.grammar import RecordGrammar

_OUT = "kind string, doc_id long, embedding array<float>, reason string, error_pos int, error_field int"


def parse_lines(df: DataFrame, line: str = "raw_line", keep: tuple[str, ...] = ("line_id",), dim: int = 100) -> DataFrame:
    """Every row with its outcome: ``kind`` is ``record``, ``header`` or ``error``.

    Records carry ``doc_id`` and ``embedding``; errors carry ``reason`` (see
    :data:`~lexicube.sources.grammar.REASONS`, the first that holds), the position
    in the line (code points from 0) and the field number. Only the ``keep``
    columns and the line are read; columns of the input that are called like an
    outcome don't clash, as they aren't taken along. A null or empty line is an
    error ``field_count``; repeated rows come out repeated; an empty table gives
    an empty one. One pass, no shuffle: any line can be parsed anywhere.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", " + _OUT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = RecordGrammar(dim)
        for pdf in batches:
            outs = [grammar.line(x) for x in pdf["__line"]]
            res = pdf[list(keep)].copy()
            res["kind"] = [o.kind for o in outs]
            res["doc_id"] = pd.array([o.key if o.kind == "record" else None for o in outs], dtype="Int64")
            res["embedding"] = [o.vector for o in outs]
            res["reason"] = [o.reason for o in outs]
            res["error_pos"] = pd.array([o.position for o in outs], dtype="Int32")
            res["error_field"] = pd.array([o.field_no for o in outs], dtype="Int32")
            yield res

    return df.select(*keep, F.col(line).alias("__line")).mapInPandas(run, schema)


def split_lines(df: DataFrame, line: str = "raw_line", keep: tuple[str, ...] = ("line_id",), dim: int = 100) -> tuple[DataFrame, DataFrame]:
    """``(records, errors)`` of :func:`parse_lines`; headers are in neither."""
    out = parse_lines(df, line, keep, dim)
    return (
        out.where("kind = 'record'").select(*keep, "doc_id", "embedding"),
        out.where("kind = 'error'").select(*keep, "reason", "error_pos", "error_field"),
    )


def recover(df: DataFrame, file: str = "file_name", no: str = "line_id", line: str = "raw_line", dim: int = 100) -> DataFrame:
    """The file rule over the lines of many files: (file, no, kind, doc_id, embedding, reason, error_pos, error_field).

    A line with an odd number of quotes leaves one open, which swallows line ends. The
    parse resumes at the next *validated record start*, a line on which a key and a first
    value really parse; the lines between are ``skipped``, with the reason ``quoting``.

    Lines are parsed anywhere. What is open in front of a line is the last event before
    it (an open quote or a record start), carried over ranges of lines, so a file with a
    third of all lines is split over many tasks. ``no`` orders the lines of a file; rows
    without a file or number are files and lines of their own kind of null.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (file, no)}
    schema = f"file {kinds[file]}, no {kinds[no]}, event int, " + _OUT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = RecordGrammar(dim)
        for pdf in batches:
            outs = [grammar.line(x) for x in pdf["line"]]
            yield pd.DataFrame({
                "file": pdf["file"], "no": pdf["no"], "event": pd.array([grammar.event(x) for x in pdf["line"]], dtype="Int32"), "kind": [o.kind for o in outs],
                "doc_id": pd.array([o.key if o.kind == "record" else None for o in outs], dtype="Int64"), "embedding": [o.vector for o in outs], "reason": [o.reason for o in outs],
                "error_pos": pd.array([o.position for o in outs], dtype="Int32"), "error_field": pd.array([o.field_no for o in outs], dtype="Int32"),
            })

    parsed = df.select(F.col(file).alias("file"), F.col(no).alias("no"), F.col(line).alias("line")).mapInPandas(run, schema)
    last = F.when(F.col("event").isNotNull(), F.struct("no", "event"))
    seen = running(parsed, ["file"], [F.col("no")], {"last": last}, "max")
    skipped = F.col("event").isNull() & F.coalesce(F.col("last.event") == 1, F.lit(False))
    unless = lambda c: F.when(~skipped, F.col(c)).alias(c)
    return seen.select(F.col("file").alias(file), F.col("no").alias(no), F.when(skipped, "skipped").otherwise(F.col("kind")).alias("kind"), unless("doc_id"), unless("embedding"), F.when(skipped, "quoting").otherwise(F.col("reason")).alias("reason"), unless("error_pos"), unless("error_field"))


def numbered_lines(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """(file_name, line_no, value): lines of text files of any size with dense numbers from 0.

    Numbers run within a file (``by`` file_name) or over all files in the order of their
    names (no ``by``). Files are read in blocks by many tasks; a line's place is its block
    and its order there, so numbers don't depend on how files are cut into tasks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    order = [F.col(c) for c in ("file_name", "block", "at") if c not in by]
    numbered = running(cut(lines, "lines"), by, order, {"line_no": F.lit(1).cast("long")})
    return numbered.select("file_name", (F.col("line_no") - 1).alias("line_no"), "value")


def parse_files(spark: SparkSession, path: str, dim: int = 100) -> DataFrame:
    """Text files of any size through the file rule (:func:`recover`): one row a line, ``line_no`` from 0."""
    return recover(numbered_lines(spark, path, ["file_name"]), "file_name", "line_no", "value", dim)
