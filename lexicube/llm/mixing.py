"""Problem 8: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexicube.llm.packing import sized_documents
from lexicube.llm.tokenize import VOCABULARY
from lexicube.session import cut, table

#: Hash buckets of a source for the fractional repetition; a source is cut in one of them.
BUCKETS = 4096
#: The plan of a mix is made on the driver, from one row a target.
MOST_TARGETS = 100_000


def source_name(c: Column) -> Column:
    """Sources compare trimmed, in lower case, with ``_`` for runs of space, ``-`` and ``_``."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, "(?U)\\s+", " "))), "[ _-]+", "_")


def water_fill(total: float, shares: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """Size of every source: its share of ``total``, but no more than its cap.

    Sources above their cap are clamped; what they leave is dealt to the others in
    proportion to their shares, until no cap is exceeded. If all caps together are
    less than ``total``, every source gets its cap.
    """
    out: dict[str, float] = {}
    active = {s for s, w in shares.items() if w > 0}
    out.update({s: 0.0 for s in shares if s not in active})
    left = total
    while active:
        weight = sum(shares[s] for s in active)
        over = {s for s in active if left * shares[s] / weight >= caps.get(s, 0.0)}
        if not over:
            out.update({s: left * shares[s] / weight for s in active})
            break
        for s in over:
            out[s] = caps.get(s, 0.0)
        left -= sum(out[s] for s in over)
        active -= over
    return out


def mix(docs: DataFrame, targets: DataFrame, doc: str = "doc_id", size: str = "n_tokens", total: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(rows, report)``: how often each record is taken, and the shares reached.

    ``docs`` has ``source``, the key and the size; ``targets`` has ``source``,
    ``target_share``, ``max_repeats`` (of several rows with one source the first by
    share counts). ``total`` is the size of the mix, by default that of all records
    whose source has a target. A source taken r times gives floor(r) copies of each
    record and, in a seeded hash order, one more of as many records as make up the
    fraction. Sources without a target (null ones too) aren't taken; targets without
    records get nothing and are reported. Records of no size are taken with their
    whole repetitions. Null or negative shares and repeats count as 0.

    The hash order of a source is never sorted as a whole: sizes are summed per hash
    bucket (at most 4 096 rows a source), a running sum over those finds the bucket
    in which the fraction ends, and only that one is ordered. So a source with a third
    of all rows is spread over all tasks.
    """
    spark = docs.sparkSession
    goal = targets.select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    goal = goal.where("source is not null").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("x")).select("source", "x.*")
    wanted = goal.limit(MOST_TARGETS + 1).collect()
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    have = docs.select(F.col(doc).alias("doc"), source_name(F.col("source")).alias("source"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("size"))
    have = cut(have.withColumn("h", F.xxhash64("doc", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")), "sized")
    sums = cut(have.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "sums")
    by_source = sums.groupBy("source").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    aimed = F.broadcast(spark.createDataFrame([(r.source,) for r in wanted], "source string"))
    held = {r.source: r.size for r in by_source.join(aimed, "source", "left_semi").collect()}
    shares = {r.source: r.target_share for r in wanted}
    caps = {r.source: float(r.max_repeats * held.get(r.source, 0)) for r in wanted}
    size_of = water_fill(float(sum(held.values())) if total is None else total, shares, caps)
    rate = {s: (x / held[s] if held.get(s) else 0.0) for s, x in size_of.items()}
    plan = [(r.source, r.target_share, r.max_repeats, size_of[r.source], rate[r.source], int(rate[r.source]), (rate[r.source] - int(rate[r.source])) * held.get(r.source, 0)) for r in wanted]
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, target_share double, max_repeats int, planned double, rate double, whole int, part double"))
    run = Window.partitionBy("source").orderBy("bucket")
    ends = sums.join(plan_df.select("source", "whole", "part"), "source").withColumn("upto", F.sum("size").over(run))
    ends = ends.select("source", "bucket", "whole", (F.col("part") - (F.col("upto") - F.col("size"))).alias("room"), F.col("size").alias("bucket_size"))
    rows = have.join(ends, ["source", "bucket"])
    inside = rows.where("room >= bucket_size or room <= 0").withColumn("extra", (F.col("room") > 0).cast("int"))
    edge = rows.where("room < bucket_size and room > 0")
    upto = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "doc").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("extra", (upto - F.col("size") / 2 <= F.col("room")).cast("int"))
    taken = inside.unionByName(edge).withColumn("repeats", F.col("whole") + F.col("extra")).where("repeats > 0")
    taken = cut(taken.select(F.col("doc").alias(doc), "source", F.col("size").alias(size), "repeats"), "taken")
    got = taken.groupBy("source").agg(F.sum(F.col(size) * F.col("repeats")).alias("mixed"), F.max("repeats").alias("most_repeats"))
    everything = taken.agg(F.sum(F.col(size) * F.col("repeats"))).first()[0] or 0
    report = by_source.join(plan_df, "source", "full").join(got, "source", "left")
    report = report.select(
        "source", F.coalesce("n", F.lit(0)).alias("n_records"), F.coalesce("size", F.lit(0)).alias("available"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
        F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce("mixed", F.lit(0)).alias("mixed"), (F.coalesce("mixed", F.lit(0)) / F.lit(float(everything or 1))).alias("actual_share"),
    )
    return taken, report


def p8_mix(spark: SparkSession, folder: str, path: str = VOCABULARY) -> DataFrame:
    """The documents of the mix with their repetitions."""
    return mix(sized_documents(spark, folder, path), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str, path: str = VOCABULARY) -> DataFrame:
    """Target and real share of every source."""
    return mix(sized_documents(spark, folder, path), table(spark, folder, "mix_targets"))[1]
