"""Problem 9: long exact spans shared between records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexicube.llm import recompress
from lexicube.operators.common import join_stats
from lexicube.session import cut, drop_cut, table

#: Characters parsed at a time in a Python worker (bounds its memory).
CHUNK = 400_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _pieces(codes: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """A very long text in overlapping pieces; every window lies in one of them."""
    most = (1 << recompress.PLACE) - CHUNK - 2
    at = 0
    while True:
        yield at, codes[at : at + most]
        at += most - 2 * width
        if at + 2 * width >= len(codes):
            return


def _keys(docs: DataFrame, width: int, least: int, rounds: int, freeze: int) -> DataFrame:
    """(key, doc, first, last): designated keys of every text and the windows they stand for."""

    def flush(ids: list[int], shifts: list[int], parts: list[np.ndarray]) -> pd.DataFrame:
        sizes = np.array([len(p) for p in parts])
        at = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        key, first, last = recompress.designated(np.concatenate([np.append(p, 0) for p in parts]), at + sizes, width, least, rounds, freeze)
        own = np.searchsorted(at, first, side="right") - 1
        move = np.array(shifts)[own] - at[own]
        return pd.DataFrame({"key": key.view(np.int64), "doc": np.array(ids)[own], "first": (first + move).astype(np.int32), "last": (last + move).astype(np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, shifts, parts, size = [], [], [], 0
        for pdf in batches:
            for i, text in zip(pdf["doc"], pdf["text"]):
                for shift, codes in _pieces(_codes(text), width):
                    ids.append(i)
                    shifts.append(shift)
                    parts.append(codes)
                    size += len(codes)
                    if size >= CHUNK:
                        yield flush(ids, shifts, parts)
                        ids, shifts, parts, size = [], [], [], 0
        if ids:
            yield flush(ids, shifts, parts)

    return docs.mapInPandas(run, "key long, doc long, first int, last int")


def _windows(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """(h, doc, pos): the hashes of the windows of the given stretches of a document.

    ``docs`` has the text and the windows' stretches (``firsts``, ``lasts``).
    """

    def flush(ids: list[int], firsts: list[int], parts: list[np.ndarray]) -> pd.DataFrame:
        sizes = np.array([len(p) for p in parts])
        at, n = np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes - width + 1
        h = recompress.window_hashes(np.concatenate(parts), width)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return pd.DataFrame({"h": (h[np.repeat(at, n) + step] >> np.uint64(64 - bits)).view(np.int64), "doc": np.repeat(np.array(ids), n), "pos": (np.repeat(np.array(firsts), n) + step).astype(np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, begins, parts, size = [], [], [], 0
        for pdf in batches:
            for i, text, firsts, lasts in zip(pdf["doc"], pdf["text"], pdf["firsts"], pdf["lasts"]):
                codes, first, last = _codes(text), np.sort(firsts), np.sort(lasts)
                # stretches that follow each other, or overlap in pieces of very long texts, are one
                head = np.concatenate(([True], first[1:] > np.maximum.accumulate(last)[:-1] + 1))
                tail = np.append(np.flatnonzero(head)[1:], len(first)) - 1
                for a, b in zip(first[head].tolist(), last[tail].tolist()):
                    ids.append(i)
                    begins.append(a)
                    parts.append(codes[a : b + width])
                    size += b + width - a
                if size >= CHUNK:
                    yield flush(ids, begins, parts)
                    ids, begins, parts, size = [], [], [], 0
        if ids:
            yield flush(ids, begins, parts)

    return docs.mapInPandas(run, "h long, doc long, pos int")


def _same(rows: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """``rows`` (doc, p1, p2, wdoc, wpos) with ``same``: whether the stretch and its witness agree, character for character."""
    size = F.col("p2") - F.col("p1") + width
    own = rows.join(reps, "doc").select("doc", "p1", "p2", "wdoc", "wpos", F.substring("text", F.col("p1") + 1, size).alias("own"))
    other = own.join(reps.toDF("wdoc", "text"), "wdoc")
    return other.select("doc", "p1", "p2", (F.col("own") == F.substring("text", F.col("wpos") + 1, size)).alias("same"))


def shared_spans(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 200, least: int = 64, rounds: int = 6, freeze: int = 8, bits: int = 64) -> DataFrame:
    """Maximal stretches made of substrings of ``width`` that another document holds too.

    (doc, start_pos, end_pos) in code points. A character is in a stretch if it lies
    in a substring of at least ``width`` characters that stands, character for
    character, in the text of another document.

    1. Exact copies are grouped by the SHA-256 of their text. A text held twice is one
       stretch; one document of each group goes on, so a hot text is parsed once.
    2. Recompression parses every text into symbols that equal substrings share. Each
       window of ``width`` has one designated key, a sequence of symbols inside it; equal
       windows have equal ones (shown in :mod:`lexicube.llm.recompress`). There is a row a
       key, about one for 40 characters of natural text.
    3. Windows whose designated key another document holds too are hashed and grouped by
       that hash (of ``bits`` bits), each group with a witness: its first place, or its last
       one for the document of the first.
    4. Stretches of windows with neighbouring witnesses are compared with them, character
       for character. Windows of hashes for which that fails anywhere are grouped again by
       their text itself, so the result is exact whatever the hashes do.

    Documents with a null id or a text that is null or shorter than ``width`` have no
    stretch. Repeated rows of one id are one document. No pairs are ever formed, so a
    passage in a third of all documents costs as much as one in two; joins back to the
    rows treat hot keys apart (``join_stats``). An empty table gives an empty one.
    """
    src = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where((F.col("doc").isNotNull()) & (F.char_length("text") >= width))
    ids = cut(src.select("doc", F.sha2("text", 256).alias("sha"), F.char_length("text").alias("n")).distinct(), "ids")
    groups = cut(ids.groupBy("sha").agg(F.min("doc").alias("rep"), F.count_distinct("doc").alias("copies"), F.count(F.lit(1)).alias("m")), "groups")
    reps = cut(src.join(groups.select(F.col("rep").alias("doc")), "doc", "left_semi").dropDuplicates(["doc"]).select("doc", "text"), "reps")
    keys = cut(_keys(reps, width, least, rounds, freeze), "keys")
    held = keys.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("key", "n")
    marks = join_stats(keys, cut(held, "held"), ["key"], "n", keys.count(), "left_semi").groupBy("doc").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    wins = cut(_windows(reps.join(marks, "doc"), width, bits), "windows")
    drop_cut(keys)
    twice = wins.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.min_by("pos", "doc").alias("ap"), F.max_by("pos", "doc").alias("bp"), F.count(F.lit(1)).alias("n")).where("a < b")
    hits = join_stats(wins, cut(twice, "twice"), ["h"], "n", wins.count())
    first = F.col("doc") == F.col("a")
    hits = hits.select("doc", "pos", F.when(first, F.col("b")).otherwise(F.col("a")).alias("wdoc"), F.when(first, F.col("bp")).otherwise(F.col("ap")).alias("wpos"))
    w = Window.partitionBy("doc").orderBy("pos")
    follows = (F.lag("pos").over(w) == F.col("pos") - 1) & (F.lag("wdoc").over(w) == F.col("wdoc")) & (F.lag("wpos").over(w) == F.col("wpos") - 1)
    cuts = hits.withColumn("new", F.coalesce((~follows).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = cut(cuts.groupBy("doc", "run").agg(F.min("pos").alias("p1"), F.max("pos").alias("p2"), F.first("wdoc").alias("wdoc"), F.min("wpos").alias("wpos")).drop("run"), "runs")
    checked = cut(_same(runs, reps, width), "checked")
    good = checked.select("doc", "p1", "p2")
    wrong = checked.where("not same")
    if not wrong.isEmpty():
        # the hashes of windows whose witness differs say nothing: group those by their text
        where = wrong.select("doc", F.explode(F.sequence("p1", "p2")).alias("pos"))
        doubt = cut(wins.join(wins.join(where, ["doc", "pos"], "left_semi").select("h").distinct(), "h", "left_semi").select("doc", "pos"), "doubt")
        exact = doubt.join(reps, "doc").select("doc", "pos", F.substring("text", F.col("pos") + 1, F.lit(width)).alias("s"))
        exact = cut(exact.withColumn("s2", F.sha2("s", 256)), "exact")
        real = exact.groupBy("s2", "s").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("s2", "s")
        sure = checked.select("doc", F.explode(F.sequence("p1", "p2")).alias("pos")).join(doubt, ["doc", "pos"], "left_anti")
        good = sure.unionByName(exact.join(real, ["s2", "s"], "left_semi").select("doc", "pos")).select("doc", F.col("pos").alias("p1"), F.col("pos").alias("p2"))
    w = Window.partitionBy("doc").orderBy("p1")
    cuts = good.withColumn("new", F.coalesce((F.col("p1") - F.lag("p2").over(w) > width).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = cuts.groupBy("doc", "run").agg(F.min("p1").alias("start_pos"), (F.max("p2") + width).alias("end_pos"))
    # one row a document: copies of a group are whole stretches, the rest are representatives
    whole = join_stats(ids, groups.where("copies > 1"), ["sha"], "m", ids.count()).select("doc", F.lit(0).alias("start_pos"), F.col("n").alias("end_pos"))
    single = spans.join(groups.where("copies > 1").select(F.col("rep").alias("doc")), "doc", "left_anti").select("doc", "start_pos", "end_pos")
    return whole.unionByName(single).select(F.col("doc").alias(doc), F.col("start_pos").cast("int").alias("start_pos"), F.col("end_pos").cast("int").alias("end_pos"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of ``documents.text`` of 200 characters or more held elsewhere too."""
    return shared_spans(table(spark, folder, "documents"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """For every document the characters and the part of its text that stand elsewhere."""
    docs = table(spark, folder, "documents")
    spans = shared_spans(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared"))
    size = F.coalesce(F.char_length("text"), F.lit(0))
    out = docs.select("doc_id", size.alias("n_chars")).join(spans, "doc_id", "left")
    shared = F.coalesce("shared", F.lit(0))
    return out.select("doc_id", "n_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), shared.alias("shared_chars"), F.coalesce(F.try_divide(shared, F.col("n_chars")), F.lit(0.0)).alias("shared_part"))
