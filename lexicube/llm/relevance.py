"""Problem 1: how distinctive a term is for its record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexicube.functions.text import canonical_phrase
from lexicube.operators.common import current_rows, join_stats
from lexicube.session import cut, table


def distinctive_terms(terms: DataFrame, rec: str = "rec_id", term: str = "phrase", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Probabilistic relevance weight of every term in every record.

    ``terms`` has one row per occurrence. With tf the occurrences of the term in
    its record, dl the occurrences of all terms there, avgdl their mean over the
    records, df the records that hold the term and N the records with any term::

        weight = ln(N / df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))

    tf saturates with ``k1``, long records are damped by ``b``, and the idf is 0
    for a term that all records hold (never negative). The statistics the weight is
    made of come out with it: (rec, term, tf, dl, df, n_records, idf, weight).

    Rows with a null record or a null or empty term are ignored; a record without
    terms doesn't count in N; ties and repeated rows are plain occurrences; an
    empty table gives an empty one. Other columns of the input are not read.

    Plan: tf is counted on the map side first; where the input comes partitioned by
    record no shuffle is needed for tf and dl. The table is cut, because df and the
    join back both read it. The join treats hot terms apart (``join_stats``).
    """
    spark = terms.sparkSession
    tf = terms.select(F.col(rec).alias("rec"), F.col(term).alias("term")).where("rec is not null and term is not null and term <> ''").groupBy("rec", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = cut(tf.withColumn("dl", F.sum("tf").over(Window.partitionBy("rec"))), "tf")
    total = tf.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("tf") / F.col("dl")).alias("recs"), F.sum("tf").alias("occ")).first()
    if not total.rows:
        n, avgdl = 0, 1.0
    else:
        n = round(total.recs)  # within a record tf / dl adds up to 1
        avgdl = total.occ / n
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf: Column = F.log(F.lit(float(n)) / F.col("df"))
    sat = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    out = join_stats(tf, df, ["term"], "df", total.rows or 0)
    return out.select(F.col("rec").alias(rec), F.col("term").alias(term), "tf", "dl", "df", F.lit(n).cast("long").alias("n_records"), idf.alias("idf"), (idf * sat).alias("weight"))


def news_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases of the current ``news`` rows, one row per occurrence, canonical."""
    cur = current_rows(table(spark, folder, "news").select("doc_id", "phrases", "ingested_at"), ["doc_id"], "ingested_at")
    each = cur.select(F.col("doc_id").alias("rec_id"), F.explode("phrases").alias("p")).select("rec_id", F.explode(F.split("p", ";")).alias("p"))
    return each.select("rec_id", canonical_phrase(F.col("p")).alias("phrase")).where("phrase <> ''")


def set_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases of the current ``set_scores`` rows, whatever their score."""
    cur = current_rows(table(spark, folder, "set_scores").select("set_id", "phrase_scores", "scored_at"), ["set_id"], "scored_at")
    each = cur.select(F.col("set_id").alias("rec_id"), F.explode("phrase_scores.phrase").alias("p"))
    return each.select("rec_id", canonical_phrase(F.col("p")).alias("phrase")).where("phrase <> ''")


def weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of the phrases of both tables, each against its own records."""
    parts = [distinctive_terms(f(spark, folder)).withColumn("origin", F.lit(o)) for o, f in (("news", news_terms), ("set_scores", set_terms))]
    return parts[0].unionByName(parts[1])


def p1_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Every phrase of every record with its relevance weight."""
    return weights(spark, folder).select("origin", "rec_id", "phrase", "tf", "df", F.round("weight", 9).alias("weight"))


def p1_found(spark: SparkSession, folder: str, least: int = 4, ratio: float = 2.3) -> DataFrame:
    """The outstanding phrase of a record: over ``ratio`` times the second one.

    The case is defined by tf * ln(N / df), so that product of the operator's own columns
    is compared: neither the saturation of tf nor the length normalisation of ``weight``
    plays a part here (``p1_weights`` has it). One aggregate per record: the two largest weights.
    """
    w = F.col("tf") * F.col("idf")
    out = weights(spark, folder).select("origin", "rec_id", "phrase", w.alias("w"))
    top = out.groupBy("origin", "rec_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("phrase", "w").alias("phrase"), F.max("w").alias("first"), F.slice(F.sort_array(F.collect_list("w"), False), 2, 1).alias("rest"))
    return top.where((F.col("n") >= least) & (F.col("first") > ratio * F.get("rest", F.lit(0)))).select("origin", "rec_id", "phrase")
