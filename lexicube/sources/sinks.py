"""Writers. All are distributed writes; none collects a result to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def summaries(picks: DataFrame, path: str) -> None:
    """One line a set, sentences in the order of choice, underscores as spaces.

    ``picks`` (set_id, pick, sentence); files are partitioned by a hash of the set.
    """
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pick", "sentence"))), lambda x: F.translate(x["sentence"], "_", " ")), " ")
    picks.groupBy("set_id").agg(line.alias("summary")).write.mode("overwrite").json(path)


def mapping(df: DataFrame, path: str) -> None:
    """Two columns as TSV."""
    df.write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def embeddings(df: DataFrame, path: str, key: str = "key", vec: str = "vec", names: DataFrame | None = None) -> None:
    """``key f1 … fn`` with six digits; with ``names`` (id, name) keys are translated (type prefix dropped)."""
    if names is not None:
        df = df.withColumn("__k", F.element_at(F.split(F.col(key), ":"), -1)).join(names.toDF("__k", "__name"), "__k").withColumn(key, F.col("__name"))
    body = F.array_join(F.transform(vec, lambda x: F.format_string("%.6f", x.cast("double"))), " ")
    df.select(F.concat_ws(" ", F.col(key), body).alias("value")).write.mode("overwrite").text(path)


def hierarchy(links: DataFrame, path: str) -> None:
    links.write.mode("overwrite").parquet(path)


def network(edges: DataFrame, path: str) -> None:
    """Node files per type and one edge file (``t:a``, ``t:b``, weight, type)."""
    ends = edges.select(F.col("src_type").alias("type"), F.col("src").alias("key")).unionByName(edges.select(F.col("dst_type").alias("type"), F.col("dst").alias("key")))
    ends.distinct().write.mode("overwrite").partitionBy("type").csv(f"{path}/nodes")
    line = edges.select(F.concat_ws(":", "src_type", "src"), F.concat_ws(":", "dst_type", "dst"), "weight", "edge_type")
    line.write.mode("overwrite").option("sep", "\t").csv(f"{path}/edges")


def edge_scores(df: DataFrame, path: str) -> None:
    """Scores, one folder per edge type."""
    df.write.mode("overwrite").partitionBy("edge_type").parquet(path)


def snapshot(df: DataFrame, path: str, step: int) -> None:
    """A model table of one training step."""
    df.write.mode("overwrite").parquet(f"{path}/step={step}")


def sentence_flags(sents: DataFrame, picks: DataFrame, path: str) -> None:
    """(set_id, sent_no, flag): place of choice counted from the end, -1 if not picked."""
    n = picks.groupBy("set_id").agg(F.max("pick").alias("__most"))
    p = picks.select("set_id", "sent_no", "pick").join(n, "set_id").select("set_id", "sent_no", (F.col("__most") - F.col("pick") + 1).alias("flag"))
    sents.select("set_id", "sent_no").join(p, ["set_id", "sent_no"], "left").na.fill(-1, ["flag"]).write.mode("overwrite").parquet(path)


def similar_edges(df: DataFrame, path: str, above: float = 15.0) -> None:
    """Edges heavier than a threshold, for drawing elsewhere."""
    df.where(F.col("w") > above).write.mode("overwrite").option("sep", "\t").csv(path)


def sentence_lines(sents: DataFrame, path: str) -> None:
    """One sentence a line behind its set and a tab; files hold whole ranges of sets, not one set each."""
    sents.select(F.concat_ws("\t", F.col("set_id").cast("string"), "sentence").alias("value")).write.mode("overwrite").text(path)


def annotations(rows: DataFrame, path: str) -> None:
    """Chosen phrases of every document, one document a line: id, tab, phrases joined by ``;``."""
    line = F.array_join(F.sort_array(F.collect_list("phrase")), ";")
    rows.groupBy("doc_id").agg(line.alias("p")).select(F.concat_ws("\t", F.col("doc_id").cast("string"), "p").alias("value")).write.mode("overwrite").text(path)
