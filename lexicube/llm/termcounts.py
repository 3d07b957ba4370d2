"""Problem 3: how often every distinct term occurs, kept up by signed deltas.

The state lies in a folder of its own, in two tables cut into buckets: ``parts``, the
terms of every current part of a record, by a hash of the record, and ``counts``,
occurrences and records of each term, by a hash of the term. A batch of new, changed or
deleted parts touches only its own records: their old and new term counts are netted per
record and term, what remains is summed per term into signed deltas, and those are merged
into the counts. Only buckets that a batch touches are read and written again; a manifest
says in which generation of files every bucket stands, and a batch takes effect when its
manifest is written. So the state outlives the session, and a batch that fails leaves the
state before it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexicube.functions.text import canonical_phrase
from lexicube.operators.common import current_rows
from lexicube.session import cut, delete, drop_cut, new_path, slots, subfolders, table

PART = "rec long, part long, at timestamp, terms array<struct<term:string,n:bigint>>"
COUNT = "term string, occurrences long, records long"


@dataclass
class TermCounts:
    """State after some batches: ``parts`` (rec, part, at, terms) and ``counts`` (term, occurrences, records)."""

    spark: SparkSession
    home: str
    buckets: int = 8
    no: int = 0
    n_records: int = 0
    where: dict[str, dict[int, int]] = field(default_factory=lambda: {"parts": {}, "counts": {}})

    @classmethod
    def open(cls, spark: SparkSession, home: str) -> TermCounts:
        """The state that the last manifest of a folder describes."""
        last = max((json.loads(r.value) for r in spark.read.text(f"{home}/manifest/*").collect()), key=lambda m: m["no"])
        where = {t: {int(b): g for b, g in x.items()} for t, x in last["where"].items()}
        return cls(spark, home, last["buckets"], last["no"], last["n_records"], where)

    def path(self, name: str, bucket: int) -> str:
        return f"{self.home}/{name}/{self.where[name][bucket]}/bucket={bucket}"

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, of some buckets only."""
        schema = PART if name == "parts" else COUNT
        paths = [self.path(name, b) for b in sorted(self.where[name]) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def parts(self) -> DataFrame:
        return self.read("parts")

    @property
    def counts(self) -> DataFrame:
        return self.read("counts")

    def of(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def put(self, name: str, rows: DataFrame, key: str, no: int, touched: list[int]) -> dict[int, int]:
        """Write the touched buckets of a table as generation ``no``; where they stand now.

        One task writes a bucket, so the number of buckets bounds what it holds.
        """
        rows.withColumn("bucket", self.of(key)).repartition(min(len(touched), slots(self.spark)), "bucket").write.partitionBy("bucket").parquet(f"{self.home}/{name}/{no}")
        made = [int(x.removeprefix("bucket=")) for x in subfolders(self.spark, f"{self.home}/{name}/{no}") if x.startswith("bucket=")]
        return {b: g for b, g in self.where[name].items() if b not in touched} | {b: no for b in made}


def apply_batch(state: TermCounts, batch: DataFrame) -> TermCounts:
    """Merge a batch of parts (columns of ``PART``) into the state; the state after it.

    A part replaces the stored one of the same (rec, part) if its ``at`` is later;
    older or equal ones are late repeats and ignored. A part whose terms are null or
    empty deletes what the part held. Rows with a null rec or part are ignored.
    Terms that are null or empty, and counts that are null or not positive, don't
    count. An empty batch leaves the state and its files as they were.
    """
    spark, no = state.spark, state.no + 1
    new = current_rows(batch.select("rec", "part", "at", "terms"), ["rec", "part"], "at").withColumn("bucket", state.of("rec"))
    changed = cut(new, "batch")
    which = lambda df: sorted(r.bucket for r in df.select("bucket").distinct().collect())  # at most one row a bucket
    touched = which(changed)
    if not touched:
        return state
    stored = state.read("parts", touched)
    if state.where["parts"]:
        old = stored.select("rec", "part", F.col("at").alias("old_at"), F.lit(True).alias("known"))
        newer = F.col("known").isNull() | (F.col("at") > F.col("old_at")) | (F.col("at").isNotNull() & F.col("old_at").isNull())
        changed = cut(changed.join(old, ["rec", "part"], "left").where(newer).drop("old_at", "known"), "changed")
        touched = which(changed)
        stored = state.read("parts", touched)
        before = stored.join(changed.select("rec").distinct(), "rec", "left_semi")
        after = before.join(changed.select("rec", "part"), ["rec", "part"], "left_anti").unionByName(changed.drop("bucket"))
        both = before.select("rec", F.lit(False).alias("new"), "terms").unionByName(after.select("rec", F.lit(True).alias("new"), "terms"))
    else:
        both = changed.select("rec", F.lit(True).alias("new"), "terms")
    if not touched:
        return state
    each = both.select("rec", "new", F.explode("terms").alias("t")).select("rec", "new", F.col("t.term").alias("term"), F.col("t.n").alias("n")).where("term <> '' and n > 0")
    # Netted per record and term: what a record held before and holds now cancels.
    net = each.groupBy("rec", "term").agg(F.sum(F.when(F.col("new"), F.col("n")).otherwise(0)).alias("now"), F.sum(F.when(~F.col("new"), F.col("n")).otherwise(0)).alias("was"))
    net = cut(net, "net")
    sign = lambda c: (F.col(c) > 0).cast("long")
    delta = net.where("now <> was").groupBy("term").agg(F.sum(F.col("now") - F.col("was")).alias("occurrences"), F.sum(sign("now") - sign("was")).alias("records"))
    delta = cut(delta.withColumn("bucket", state.of("term")), "delta")
    per_rec = net.groupBy("rec").agg(F.max(sign("now")).alias("now"), F.max(sign("was")).alias("was"))
    n = state.n_records + (per_rec.agg(F.sum(F.col("now") - F.col("was"))).first()[0] or 0)
    mine = which(delta)
    merged = delta.drop("bucket")
    if state.where["counts"]:
        merged = state.read("counts", mine).unionByName(merged).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("occurrences <> 0")
    kept = stored.join(changed.select("rec", "part"), ["rec", "part"], "left_anti").unionByName(changed.drop("bucket")) if state.where["parts"] else changed.drop("bucket")
    where = {"parts": state.put("parts", kept, "rec", no, touched), "counts": state.put("counts", merged, "term", no, mine) if mine else state.where["counts"]}
    after_ = TermCounts(spark, state.home, state.buckets, no, n, where)
    spark.createDataFrame([(json.dumps({"no": no, "buckets": state.buckets, "n_records": n, "where": where}),)], "value string").coalesce(1).write.text(f"{state.home}/manifest/{no}")
    for t, x in state.where.items():
        for b in x.keys() - {b for b, g in where[t].items() if g == x.get(b)}:
            delete(spark, state.path(t, b))
    for df in (net, delta, changed):
        drop_cut(df)
    return after_


def marked(state: TermCounts, rare_below: int = 3, common_above: float = 0.15) -> DataFrame:
    """Every term with its counts and marks.

    ``marks`` holds ``rare`` if fewer than ``rare_below`` records have the term,
    ``common`` if more than the share ``common_above`` of the records have it (in a
    tiny collection both can hold).
    """
    rare = F.when(F.col("records") < rare_below, F.lit("rare"))
    common = F.when(F.col("records") > common_above * state.n_records, F.lit("common"))
    return state.counts.select("term", "occurrences", "records", F.array_compact(F.array(rare, common)).alias("marks"))


def replay(parts: DataFrame, first_share: float = 0.8, home: str | None = None, bucket_rows: int = 2_000_000) -> TermCounts:
    """Counts of a whole log: its older part as the first batch, the rest as changes.

    The split point is the ``first_share`` quantile of the arrival times. The result
    does not depend on it, as batches merge exactly. Rows without a time go first. The
    state is kept in ``home``, by default a folder that goes with the session, in a bucket
    for about ``bucket_rows`` parts.
    """
    spark = parts.sparkSession
    at, n = parts.agg(F.percentile_approx("at", first_share, 1000), F.count(F.lit(1))).first()
    state = TermCounts(spark, home or new_path(spark, "counts"), max(8, -(-n // bucket_rows)))
    if at is None:
        return apply_batch(state, parts)
    early = F.col("at").isNull() | (F.col("at") <= F.lit(at))
    return apply_batch(apply_batch(state, parts.where(early)), parts.where(~early))


def news_parts(spark: SparkSession, folder: str) -> DataFrame:
    """All states of the ``news`` rows; a record has one part."""
    log = table(spark, folder, "news").select(F.col("doc_id").alias("rec"), F.lit(0).cast("long").alias("part"), F.col("ingested_at").alias("at"), "phrases")
    one = lambda p: F.struct(canonical_phrase(p).alias("term"), F.lit(1).cast("long").alias("n"))
    return log.select("rec", "part", "at", F.transform(F.flatten(F.transform("phrases", lambda p: F.split(F.coalesce(p, F.lit("")), ";"))), one).alias("terms"))


def doc_phrase_parts(spark: SparkSession, folder: str) -> DataFrame:
    """All states of the ``doc_phrase`` lines; a document has many parts."""
    log = table(spark, folder, "doc_phrase")
    term = F.struct(canonical_phrase(F.col("phrase")).alias("term"), F.col("document_phrase_cnt").cast("long").alias("n"))
    return log.select(F.col("doc_id").alias("rec"), F.col("line_no").cast("long").alias("part"), F.col("ingested_at").alias("at"), F.array(term).alias("terms"))


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and marks of the phrases of ``news`` and of ``doc_phrase``, each by itself."""
    both = [marked(replay(f(spark, folder))).select(F.lit(o).alias("origin"), F.col("term").alias("phrase"), "occurrences", "records", "marks") for o, f in (("news", news_parts), ("doc_phrase", doc_phrase_parts))]
    return both[0].unionByName(both[1])


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and records of every distinct phrase, with its mark or null."""
    return counts(spark, folder).select("origin", "phrase", "occurrences", "records", F.array_join("marks", ",").alias("marks"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The phrases that too few or too many records hold."""
    return counts(spark, folder).select("origin", "phrase", F.explode("marks").alias("mark"))
