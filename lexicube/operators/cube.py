"""Text cube: how well a phrase stands for a cell against its siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexicube.operators.common import join_stats
from lexicube.session import cut

# Fixed values of the relevance formula.
K1, B, MULTIPLIER = 1.2, 0.5, 3


def cell_counts(tf: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, phrase, tf, df) from (doc_id, phrase, tf) and (cell, doc_id)."""
    joined = tf.join(cells.select("cell", "doc_id").where("cell is not null").distinct(), "doc_id")
    return joined.groupBy("cell", "phrase").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def cell_stats(counts: DataFrame) -> DataFrame:
    """(cell, dl, max_df): length and largest document frequency of every cell."""
    return counts.groupBy("cell").agg(F.sum("tf").alias("dl"), F.max("df").alias("max_df"))


def relevance(counts: DataFrame) -> DataFrame:
    """(cell, phrase, tf, df, rel): damped tf times relative log document frequency.

    One pass over (cell, phrase): the length and maximum of a cell are aggregated
    once and sent back; there is one row a cell.
    """
    stats = cell_stats(counts)
    avg = stats.agg((F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))
    both = counts.join(stats, "cell").join(F.broadcast(avg))
    damped = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    spread = F.log2(1 + F.col("df").cast("double")) / F.log2(1 + F.col("max_df").cast("double"))
    rel = F.when((F.col("tf") > 0) & (F.col("df") > 0), damped * spread * MULTIPLIER).otherwise(0.0)
    return both.select("cell", "phrase", "tf", "df", rel.alias("rel"))


def cell_scores(tf: DataFrame, cells: DataFrame, option: str = "A", extra: DataFrame | None = None) -> DataFrame:
    """(cell, phrase, tf, df, distinct, score) for **every** cell against all others.

    distinct = e^rel / (1 + the sum of e^rel over all cells), where a cell without
    the phrase counts 1. Options: A popularity * distinct, B distinct, C distinct *
    given relevance, D the given relevance, E popularity = log2(1 + tf). C and D need
    ``extra`` (cell, phrase, relevance); phrases without one count 0.
    """
    rel = relevance(cell_counts(tf, cells))
    n = cell_counts(tf, cells).select("cell").distinct().agg(F.count(F.lit(1)).alias("n_cells"))
    w = Window.partitionBy("phrase")
    power = rel.withColumn("e", F.exp("rel")).withColumn("sum_e", F.sum("e").over(w)).withColumn("held", F.count(F.lit(1)).over(w)).join(F.broadcast(n))
    out = power.withColumn("distinct", F.col("e") / (1 + F.col("n_cells") - F.col("held") + F.col("sum_e")))
    if option in "CD":
        out = out.join(extra.select("cell", "phrase", "relevance"), ["cell", "phrase"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
    pop = F.log2(1 + F.col("tf").cast("double"))
    score = {"A": lambda: pop * F.col("distinct"), "B": lambda: F.col("distinct"), "C": lambda: F.col("relevance") * F.col("distinct"), "D": lambda: F.col("relevance"), "E": lambda: pop}[option]()
    return out.select("cell", "phrase", "tf", "df", "distinct", score.alias("score"))


def contrast_ratio(scores: DataFrame, target: str, twin: str, sizes: DataFrame) -> DataFrame:
    """(phrase, ratio): score in the target over that in its twin, weighed by their documents.

    Null where the twin lacks the phrase or scores 0 (no division by zero).
    """
    a = scores.where(F.col("cell") == target).select("phrase", F.col("score").alias("a"))
    b = scores.where(F.col("cell") == twin).select("phrase", F.col("score").alias("b"))
    n = sizes.agg(F.max(F.when(F.col("cell") == target, F.col("n"))).alias("na"), F.max(F.when(F.col("cell") == twin, F.col("n"))).alias("nb"))
    return a.join(b, "phrase", "left").join(F.broadcast(n)).select("phrase", F.try_divide(F.col("a") * F.col("nb"), F.col("b") * F.col("na")).alias("ratio"))


def set_scores(docs: DataFrame, siblings: DataFrame, category: DataFrame | None = None, twin: bool = False) -> DataFrame:
    """(set_id, phrase, tf, distinct, score): terms of a set scored as a cell against sibling cells.

    ``docs`` (set_id, doc_no, tokens) are the sets' documents as token lists; ``siblings``
    (cell, phrase, tf, df) the cells all sets share, a fixed list of few; the cell named
    by ``category`` (set_id, cell) is left out for that set, or with ``twin`` is its only
    sibling (sets without one don't come out). A set is a cell of its own
    beside its siblings, so the average length, and with it every relevance, is taken per
    set. ``distinct`` is option B of :func:`cell_scores`, ``score`` option A.

    The siblings of a phrase are one row with an array, joined to the sets' phrases with
    frequent ones apart; everything else is an expression over that array.
    """
    each = docs.where("set_id is not null").select("set_id", "doc_no", F.explode("tokens").alias("phrase")).groupBy("set_id", "doc_no", "phrase").agg(F.count(F.lit(1)).alias("n"))
    own = cut(each.groupBy("set_id", "phrase").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df")), "own")
    sib = cut(siblings.select(F.col("cell").cast("string").alias("cell"), "phrase", F.col("tf").cast("long").alias("tf"), F.col("df").cast("long").alias("df")).where("cell is not null and phrase is not null"), "siblings")
    stats = cut(cell_stats(sib), "stats")
    every = stats.agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("dl", "max_df").alias("s")))).alias("stats"), F.coalesce(F.sum("dl"), F.lit(0)).alias("all_dl"), F.count(F.lit(1)).alias("cells"))
    mine = cell_stats(own.withColumnRenamed("set_id", "cell")).withColumnRenamed("cell", "set_id")
    cat = mine.withColumn("cat", F.lit(None).cast("string")) if category is None else mine.join(category.select("set_id", F.col("cell").cast("string").alias("cat")), "set_id", "left")
    sets = cat.join(F.broadcast(every))  # one row
    named = F.col("stats")[F.col("cat")]["dl"]
    if twin:
        sets = sets.where(named.isNotNull())
        n, around = F.lit(2), named
    else:
        n, around = F.col("cells") - named.isNotNull().cast("int") + 1, F.col("all_dl") - F.coalesce(named, F.lit(0))
    sets = sets.select("set_id", "dl", "max_df", "cat", "stats", n.alias("n_cells"), ((around + F.col("dl")) / n).alias("avgdl"))
    lists = sib.groupBy("phrase").agg(F.collect_list(F.struct("cell", "tf", "df")).alias("held"))
    held = own.groupBy("phrase").agg(F.count(F.lit(1)).alias("sets")).join(lists, "phrase", "left")
    all_ = join_stats(own, held, ["phrase"], "sets", own.count()).join(sets, "set_id")

    def rel(tf: Column, df: Column, dl: Column, max_df: Column) -> Column:
        damped = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
        return F.when((tf > 0) & (df > 0), damped * F.log2(1 + df.cast("double")) / F.log2(1 + max_df.cast("double")) * MULTIPLIER).otherwise(0.0)

    others = F.filter(F.coalesce("held", F.array().cast(lists.schema["held"].dataType)), lambda h: h["cell"].eqNullSafe(F.col("cat")) == F.lit(twin))
    powers = F.transform(others, lambda h: F.exp(rel(h["tf"], h["df"], F.col("stats")[h["cell"]]["dl"], F.col("stats")[h["cell"]]["max_df"])))
    e = F.exp(rel(F.col("tf"), F.col("df"), F.col("dl"), F.col("max_df")))
    # a cell without the phrase counts 1
    distinct = e / (1 + e + F.aggregate(powers, F.lit(0.0), lambda a, x: a + x) + (F.col("n_cells") - 1 - F.size(others)))
    return all_.select("set_id", "phrase", "tf", distinct.alias("distinct")).select("*", (F.log2(1 + F.col("tf").cast("double")) * F.col("distinct")).alias("score"))

