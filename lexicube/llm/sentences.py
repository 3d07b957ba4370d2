"""Problem 6: sentence boundaries across languages and scripts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexicube.llm import hidden_events as he
from lexicube.operators.common import current_rows, join_stats
from lexicube.session import cut, table

_GAP = "array<struct<at:int,nxt:int,l:string,r:string,words:int,sure:boolean>>"
# Prior chance of a boundary behind a word of some shape and a period, before anything is counted.
SHAPES = {"W:one": 0.1, "W:dotted": 0.3, "#": 0.5, "W:U": 0.8, "W:l": 0.9, "W:o": 0.9, "W:Us": 0.4, "W:ls": 0.5, "W:os": 0.7}
#: Share of contexts that never end a sentence, before anything is counted.
NEVER = 0.1


@dataclass
class Scan:
    """One pass over all texts: their segments with gaps, and what they show in sum.

    ``segments`` (key, start, stop, gaps), key being a struct of the kept columns;
    ``seen`` (kind, l, r, n, lc, rc) with the classes of the contexts; ``plain`` (key, start,
    words, at, ends) of texts without marks.
    """

    segments: DataFrame
    seen: DataFrame
    plain: DataFrame


def scan(docs: DataFrame, text: str = "docs", keep: tuple[str, ...] = ("set_id", "doc_no")) -> Scan:
    """Read every text once. Null, empty and blank texts have no segment."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    schema = f"{kept}, kind string, start int, stop int, gaps {_GAP}, l string, r string, n long, words array<string>, at array<int>, ends array<int>"
    names = ["kind", "start", "stop", "gaps", "l", "r", "n", "words", "at", "ends"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = (None,) * len(keep)
        for pdf in batches:
            count: Counter = Counter()
            rows = []
            for t, *key in zip(pdf["__t"], *(pdf[k].astype(object).where(pdf[k].notna(), None) for k in keep)):
                plain = he.is_plain(t)
                for a, b in he.segments(t):
                    s = t[a:b]
                    if plain:
                        w = he.plain_tokens(s)
                        rows.append((*key, "plain", a, b, None, None, None, None, [x[0] for x in w], [a + x[1] for x in w], [a + x[2] for x in w]))
                        continue
                    found = he.gaps(s)
                    he.observe(s, found, count)
                    rows.append((*key, "seg", a, b, [(a + g.at, a + g.next, g.left, g.right, g.words, g.sure) for g in found], None, None, None, None, None, None))
            rows += [(*none, kind, None, None, None, l, r, n, None, None, None) for (kind, l, r), n in count.items()]
            yield pd.DataFrame(rows, columns=[*keep, *names])

    read = cut(docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t")).mapInPandas(run, schema), "scan")
    key = F.struct(*keep).alias("key")
    sums = read.where("kind in ('gap', 'end', 'start', 'mid')").groupBy("kind", "l", "r").agg(F.sum("n").alias("n"))

    def classed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(lc=pdf["l"].map(he.left_class), rc=pdf["r"].map(he.right_class))

    seen = cut(sums.mapInPandas(classed, "kind string, l string, r string, n long, lc string, rc string"), "seen")
    segments = read.where("kind = 'seg'").select(key, "start", "stop", "gaps")
    return Scan(segments, seen, read.where("kind = 'plain'").select(key, "start", "stop", "words", "at", "ends"))


@dataclass
class Model:
    """``prior`` (l, p) with P(boundary | left) and ``ratio`` (r, v) with ln P(right | boundary) - ln P(right | none)."""

    prior: DataFrame
    ratio: DataFrame


def train(seen: DataFrame, rounds: int = 3, strength: float = 3.0, alone: int = 3) -> Model:
    """Fit the boundary model to the counts of a whole collection, without labels.

    P(boundary | left) starts from how often the context stands at certain ends against
    how often in gaps, drawn to the same of its class (shape of the word), and is
    re-estimated with P(right | event) in ``rounds`` of expectation maximisation. A context
    seen fewer than ``alone`` times backs off to its class; all others are known by name:
    the model is two tables of any size, and only sums over the fixed list of classes come
    to the driver. Contexts that a text has are in the model by construction. An empty
    collection gives an empty model.
    """
    clip = lambda c: F.least(F.lit(0.995), F.greatest(F.lit(0.005), c))
    name = lambda c, k: F.when(F.col("n") >= alone, F.col(c)).otherwise(F.col(k)).alias("name")
    raw = seen
    left_names = cut(raw.where("kind in ('gap', 'end')").groupBy("l", "lc").agg(F.sum("n").alias("n")).select("l", name("l", "lc"), F.col("n").alias("rows")), "left_names")
    right_names = cut(raw.where("r not in ('', 'end')").groupBy("r", "rc").agg(F.sum("n").alias("n")).select("r", name("r", "rc"), F.col("n").alias("rows")), "right_names")
    seen = raw.join(left_names.select("l", F.col("name").alias("ln")), "l", "left").join(right_names.select("r", F.col("name").alias("rn")), "r", "left")
    seen = cut(seen.groupBy("kind", F.coalesce("ln", "l").alias("l"), F.coalesce("rn", "r").alias("r"), "lc").agg(F.sum("n").alias("n")), "folded")
    by_left = seen.where("kind in ('gap', 'end')").groupBy("l", "lc").agg(F.sum(F.when(F.col("kind") == "end", F.col("n")).otherwise(0)).alias("ends"), F.sum(F.when(F.col("kind") == "gap", F.col("n")).otherwise(0)).alias("mids"))
    by_left = cut(by_left, "left")
    per = by_left.groupBy("lc").agg(F.sum("ends").alias("ends"), F.sum("mids").alias("mids")).collect()  # classes are few
    total_end, total_mid = sum(r.ends for r in per if r.lc != "none"), sum(r.mids for r in per)
    share = min(0.9, max(0.02, total_end / max(1.0, total_end + 0.75 * total_mid)))  # of the sentences, those at a segment's end

    def of(end, mid, prior, least):
        return (least(mid, end * (1 - share) / share) + strength * prior) / (mid + strength)

    first = {r.lc: SHAPES.get(r.lc, 0.1 if r.lc.startswith("qstart") else 0.8) for r in per}
    base = {r.lc: min(0.995, max(0.005, of(r.ends, r.mids, first[r.lc], min))) for r in per}
    spark = seen.sparkSession
    bases = F.broadcast(spark.createDataFrame(list(base.items()) or [("none", 0.5)], "lc string, base double"))  # one row a class
    lefts = by_left.join(bases, "lc")
    # a context that never stands at a certain end is either no boundary (an abbreviation) or
    # one whose ends all fell inside segments: the more it is seen, the less likely
    inside = F.pow(F.lit(1 - share), F.col("mids"))
    one = (1 - NEVER) * inside / ((1 - NEVER) * inside + NEVER)
    start_p = clip(F.when(F.col("ends") > 0, of(F.col("ends"), F.col("mids"), F.col("base"), F.least)).otherwise(one * F.col("base") + (1 - one) * 0.05))
    lefts = cut(lefts.select("l", "ends", "mids", start_p.alias("p0")).withColumn("p", F.col("p0")), "left")
    counts = seen.groupBy("r").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).cast("double").alias(k) for k in ("start", "mid", "gap")]).where("r <> '' and r <> 'end'")
    rights = cut(counts.select("r", "start", "mid", F.lit(0.0).alias("b"), F.lit(0.0).alias("none")), "right")
    pairs = seen.where("kind = 'gap'").groupBy("l", "r").agg(F.sum("n").alias("n"))
    pairs = cut(pairs, "pairs")
    n_pairs = pairs.count()
    for i in range(rounds + 1):
        ratio = _ratios(rights)
        if i == rounds or not n_pairs:
            break
        odds = F.log(F.col("p") / (1 - F.col("p"))) + F.col("v")
        soft = _named(_named(pairs, lefts.select("l", "p", "mids"), "l", "mids"), ratio, "r", "rows").select("l", "r", "n", (F.col("n") / (1 + F.exp(-odds))).alias("b"))
        soft = cut(soft, "soft")
        per_l = soft.groupBy("l").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        per_r = soft.groupBy("r").agg(F.sum("b").alias("gb"), F.sum(F.col("n") - F.col("b")).alias("gn"))
        # a context that never stands at a certain end keeps the prior of that fact
        again = clip((F.col("b") + 2 * strength * F.col("p0")) / (F.col("n") + 2 * strength))
        lefts = cut(lefts.join(per_l, "l", "left").select("l", "ends", "mids", "p0", F.when(F.col("n").isNotNull() & ((F.col("ends") > 0) | (F.col("n") < 20)), again).otherwise(F.col("p0")).alias("p")), "left")
        rights = cut(rights.join(per_r, "r", "left").select("r", "start", "mid", F.coalesce("gb", F.lit(0.0)).alias("b"), F.coalesce("gn", F.lit(0.0)).alias("none")), "right")
    prior = left_names.join(lefts.select(F.col("l").alias("name"), "p"), "name").select("l", "p", F.col("rows").alias("mids"))
    ratio = right_names.join(ratio.select(F.col("r").alias("name"), "v"), "name").select("r", "v", "rows")
    return Model(cut(prior, "prior"), cut(ratio, "ratio"))


def _named(rows: DataFrame, stats: DataFrame, key: str, n: str) -> DataFrame:
    """Join the model to rows by a context, frequent contexts apart."""
    return join_stats(rows, stats, [key], n, stats.agg(F.sum(n)).first()[0] or 0).drop(n)


def _ratios(rights: DataFrame) -> DataFrame:
    """(r, v, rows): log P(right | boundary) - log P(right | none), smoothed by half a count."""
    t = rights.agg(F.sum("start").alias("start"), F.sum("mid").alias("mid"), F.sum("b").alias("b"), F.sum("none").alias("none"), F.count(F.lit(1)).alias("k")).first()
    scale = max(1.0, t["none"] or 0.0) / max(1.0, t["mid"] or 0.0)
    tb, tn = (t["start"] or 0) + (t["b"] or 0) + 0.5 * t["k"] + 1, (t["none"] or 0) + scale * (t["mid"] or 0) + 0.5 * t["k"] + 1
    v = F.log((F.col("start") + F.col("b") + 0.5) / tb) - F.log((F.col("none") + scale * F.col("mid") + 0.5) / tn)
    return rights.select("r", F.least(F.lit(he.RATIO[1]), F.greatest(F.lit(he.RATIO[0]), v)).alias("v"), (F.col("start") + F.col("b") + F.col("none") + 1).cast("long").alias("rows"))


def marked_spans(segments: DataFrame, model: Model) -> DataFrame:
    """(key, spans): sentences of every segment of marked texts, as (start, stop) in code points.

    Gaps are rows that meet the model by their contexts; each segment's chain is then
    decided in Arrow batches. The gaps of a segment are bounded by its text.
    """
    flat = segments.select("key", "start", F.posexplode("gaps").alias("i", "g")).select("key", "start", "i", "g.at", "g.nxt", "g.l", "g.r", "g.words", "g.sure")
    open_ = flat.where("not sure")
    known = _named(_named(open_, model.prior, "l", "mids"), model.ratio, "r", "rows").withColumn("odds", F.log(F.col("p") / (1 - F.col("p"))) + F.col("v"))
    every = known.select("key", "start", "i", "at", "nxt", "words", "sure", "odds").unionByName(flat.where("sure").select("key", "start", "i", "at", "nxt", "words", "sure", F.lit(30.0).alias("odds")))
    one = every.groupBy("key", "start").agg(F.sort_array(F.collect_list(F.struct("i", "at", "nxt", "words", "sure", "odds"))).alias("g"))
    rows = one.select("key", "start", F.col("g.at").alias("at"), F.col("g.nxt").alias("nxt"), F.col("g.words").alias("words"), F.col("g.sure").alias("sure"), F.col("g.odds").alias("odds"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = []
            for a, at, nxt, words, sure, odds in zip(pdf["start"], pdf["at"], pdf["nxt"], pdf["words"], pdf["sure"], pdf["odds"]):
                ok = he.decide(list(odds), [1.0 if s else he.CLOSE.get(w, 1.0) for s, w in zip(sure, words)])
                got, begin = [], a
                for e, n, o in zip(at, nxt, ok):
                    if o:
                        if begin < e:
                            got.append((begin, e))
                        begin = n
                spans.append(got)
            yield pd.DataFrame({"key": pdf["key"], "spans": spans})

    kind = segments.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, spans array<struct<start_pos:int,end_pos:int>>")


def ngrams(docs: DataFrame, spans: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """(x, y, n): neighbouring words of the sentences found, with ``<b>`` at either end and without marks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c: Counter = Counter()
            for t, own in zip(pdf["t"], pdf["spans"]):
                for s in own:
                    w = ["<b>", *(x[0] for x in he.plain_tokens(t[s["start_pos"] : s["end_pos"]])), "<b>"]
                    if len(w) > 2:
                        c.update(zip(w, w[1:]))
            yield pd.DataFrame([(x, y, n) for (x, y), n in c.items()], columns=["x", "y", "n"])

    per = spans.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    rows = docs.select(F.struct(*keep).alias("key"), F.col(text).alias("t")).join(per, "key").select("t", "spans")
    return rows.mapInPandas(run, "x string, y string, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))


def plain_spans(plain: DataFrame, grams: DataFrame, weight: float = 2.0) -> DataFrame:
    """(key, spans): sentences of texts without marks, an event between any two words.

    The odds of a boundary between x and y are P(<b> | x) P(y | <b>) / P(y | x), each
    estimate drawn to that of the single word with ``weight`` counts. The n-grams are
    joined to the gaps, so their table may have any size.
    """
    grams = cut(grams, "grams")
    total = grams.agg(F.sum("n")).first()[0] or 1
    words = grams.groupBy("y").agg(F.sum("n").alias("ny"))
    after = grams.groupBy("x").agg(F.sum("n").alias("nx"))
    ends = (grams.where("x = '<b>'").agg(F.sum("n")).first()[0] or 0) + 1
    flat = plain.select("key", "start", F.posexplode(F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))).alias("i", "g")).select("key", "start", "i", "g.x", "g.y")
    pairs = flat.select("x", "y").distinct()
    pairs = pairs.join(grams, ["x", "y"], "left").join(words, "y", "left").join(after, "x", "left")
    pairs = pairs.join(grams.where("y = '<b>'").select("x", F.col("n").alias("xb")), "x", "left").join(grams.where("x = '<b>'").select("y", F.col("n").alias("by")), "y", "left").na.fill(0)
    uni = (F.col("ny") + 0.5) / total
    p_end = (F.col("xb") + weight * ends / total) / (F.col("nx") + weight)
    p_start = (F.col("by") + weight * uni) / (ends + weight)
    p_next = (F.col("n") + weight * uni) / (F.col("nx") + weight)
    odds = cut(pairs.select("x", "y", F.log(p_end * p_start / p_next).alias("odds")), "odds")
    gaps = flat.join(odds, ["x", "y"]).groupBy("key", "start").agg(F.sort_array(F.collect_list(F.struct("i", "odds"))).alias("g"))
    rows = plain.join(gaps, ["key", "start"], "left").select("key", "start", "stop", "at", "ends", F.coalesce(F.col("g.odds"), F.array().cast("array<double>")).alias("odds"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = []
            for a, b, at, ends, odds in zip(pdf["start"], pdf["stop"], pdf["at"], pdf["ends"], pdf["odds"]):
                begin, got = a, []
                for i, ok in enumerate(he.decide_plain(list(odds))):
                    if ok:
                        got.append((begin, ends[i]))
                        begin = at[i + 1]
                spans.append([*got, (begin, b)])
            yield pd.DataFrame({"key": pdf["key"], "spans": spans})

    kind = plain.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, spans array<struct<start_pos:int,end_pos:int>>")


def sentence_spans(docs: DataFrame, text: str = "docs", keep: tuple[str, ...] = ("set_id", "doc_no")) -> DataFrame:
    """(keep…, start_pos, end_pos) of every sentence of a collection, in code points.

    The model is fitted to the collection itself. Null, empty and blank texts have no
    sentence; ``keep`` must name a key. Only these columns and the text are read; columns
    of the input with other names don't matter. An empty table gives an empty one.
    """
    read = scan(docs, text, keep)
    spans = marked_spans(read.segments, train(read.seen))
    plain = read.plain.where(F.size("words") > 1)
    if not plain.isEmpty():
        spans = cut(spans, "spans")
        spans = spans.unionByName(plain_spans(plain, ngrams(docs, spans, text, keep)))
    single = read.plain.where(F.size("words") <= 1).select("key", F.array(F.struct(F.col("start").alias("start_pos"), F.col("stop").alias("end_pos"))).alias("spans"))
    out = spans.unionByName(single).select("key", F.explode("spans").alias("s"))
    return out.select(*[F.col(f"key.{k}").alias(k) for k in keep], "s.start_pos", "s.end_pos")


def _current(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "doc_sets").select("set_id", "doc_no", "docs", "lang", "ingested_at")
    return cut(current_rows(docs, ["set_id", "doc_no"], "ingested_at"), "docs")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every current text of ``doc_sets``."""
    return sentence_spans(_current(spark, folder))


def p6_by_language(spark: SparkSession, folder: str) -> DataFrame:
    """Texts, sentences and their mean length per language."""
    spans = sentence_spans(_current(spark, folder), keep=("set_id", "doc_no", "lang"))
    per = spans.groupBy("lang", "set_id", "doc_no").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("chars"))
    return per.groupBy("lang").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_sentences"), F.round(F.sum("chars") / F.sum("n"), 2).alias("mean_chars"))
