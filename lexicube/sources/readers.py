"""Readers: every input shape of the pipeline as a DataFrame with explicit ids.

Nothing is positional: rows that don't parse never shift the ids of others. Lines that
fail are kept apart by :mod:`lexicube.sources.lines`, not dropped in silence.
"""

from __future__ import annotations

import configparser
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexicube.functions.text import join_phrases, phrase_spans, sentences, strip_markup
from lexicube.sources.lines import numbered_lines, parse_lines

ANNOTATED = "id long, token array<string>, pos array<string>, ner array<struct<text:string,start:int,end:int,type:string>>"
NEWS = "abstract array<string>, content array<string>, type array<string>"
EDGE = "src string, dst string, weight double, edge_type string"


@dataclass(frozen=True)
class Settings:
    """Values of a run's INI file, numbers as numbers."""

    values: dict

    def __getitem__(self, key: str):
        return self.values[key]


def read_settings(path: str) -> Settings:
    """The [DEFAULT] section; whole numbers become int, true/false and JSON literals their value."""
    p = configparser.ConfigParser(interpolation=None)
    with open(path, encoding="utf-8") as f:
        p.read_file(f)

    def value(x: str):
        try:
            return json.loads(x.strip().lower() if x.strip().lower() in ("true", "false") else x)
        except ValueError:
            return x

    return Settings({k: value(v) for k, v in p.defaults().items()})


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): lines of text files; ids are dense from 0 in the order of files and lines, however they are read."""
    lines = numbered_lines(spark, path, [])
    return lines.select(F.col("line_no").alias("doc_id"), F.col("value").alias("text"))


def document_sets(df: DataFrame, key: str, text: str, separator: str = "story_separator_special_tag") -> DataFrame:
    """(set_id, doc_no, text): one set per line, members parted by the separator.

    An outer ``b"…"`` or ``"…"`` is taken off as a whole (not letter by letter); empty members are dropped.
    """
    bare = F.regexp_replace(F.regexp_replace(F.col(text), '^b?"', ""), '"$', "")
    each = df.select(F.col(key).alias("set_id"), F.posexplode(F.split(bare, f" *{separator} *")).alias("doc_no", "text"))
    return each.select("set_id", "doc_no", F.trim("text").alias("text")).where("text <> ''")


def phrase_list(spark: SparkSession, path: str, dedupe: bool = False) -> DataFrame:
    """(doc_id, phrases): lines ``id<TAB>p1;p2;…``; an empty list gives an empty array."""
    cols = F.split("value", "\t", 2)
    phrases = F.filter(F.split(F.coalesce(F.get(cols, F.lit(1)), F.lit("")), ";"), lambda p: F.trim(p) != "")
    phrases = F.transform(phrases, lambda p: F.trim(p))
    return spark.read.text(path).select(F.get(cols, F.lit(0)).cast("long").alias("doc_id"), (F.array_distinct(phrases) if dedupe else phrases).alias("phrases"))


def document_embeddings(spark: SparkSession, path: str, dim: int = 100) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of an embedding file of documents; headers are skipped."""
    lines = numbered_lines(spark, path, []).select(F.col("line_no").alias("line_id"), F.col("value").alias("raw_line"))
    out = parse_lines(lines, dim=dim)
    return out.where("kind = 'record'").select("doc_id", "embedding"), out.where("kind = 'error'").select("line_id", "reason", "error_pos")


def keyed_embeddings(spark: SparkSession, path: str, dim: int, key_fields: int = 1, keys: DataFrame | None = None) -> DataFrame:
    """(key, vec) of word2vec-like text: ``key f1 … fdim``; other lines (headers) are skipped.

    A key may have several fields (multi-word labels). With ``keys`` only those are kept.
    """
    f = F.filter(F.split("value", "[ \t\r]+"), lambda x: x != "")
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") == dim + key_fields)
    vec = F.transform(F.slice("f", key_fields + 1, dim), lambda x: x.try_cast("float"))
    out = rows.select(F.array_join(F.slice("f", 1, key_fields), " ").alias("key"), vec.alias("vec")).where(F.forall("vec", lambda x: x.isNotNull()))
    return out if keys is None else out.join(keys.select("key").distinct(), "key", "left_semi")


def label_rows(spark: SparkSession, path: str, labels: DataFrame, dim: int) -> DataFrame:
    """(label, vec): vectors of topics, named by the seed words of their line."""
    return keyed_embeddings(spark, path, dim).join(labels.select("label"), F.col("key") == F.col("label")).select("label", "vec")


def label_misses(labels: DataFrame, found: DataFrame) -> DataFrame:
    """(label): labels for which :func:`label_rows` found no vector."""
    return labels.select("label").distinct().join(found.select("label"), "label", "left_anti")


def typed_embeddings(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(type, id, vec) of keys ``type:id``."""
    e = keyed_embeddings(spark, path, dim)
    k = F.split("key", ":", 2)
    return e.select(F.get(k, F.lit(0)).alias("type"), F.get(k, F.lit(1)).alias("id"), "vec")


def annotated_json(spark: SparkSession, path: str) -> DataFrame:
    """Annotated documents, one JSON object a line (see ``ANNOTATED``); bad lines become null rows and are dropped."""
    return spark.read.schema(ANNOTATED).option("mode", "PERMISSIVE").json(path).where("token is not null")


def annotated_terms(df: DataFrame, kinds: str = "NJV", lower: bool = True, stop: list[str] = ()) -> DataFrame:
    """(id, term): entity spans as one term each, and other words of the given kinds.

    A token inside a span [start, end) is replaced by the span's text. Spans of numbers
    (ordinals, cardinals) don't count. Stopwords and blank terms are dropped.
    """
    spans = F.filter("ner", lambda n: ~n["type"].isin("ORDINAL", "CARDINAL"))
    inside = lambda i: F.exists("spans", lambda n: (n["start"] <= i) & (i < n["end"]))
    d = df.withColumn("spans", F.coalesce(spans, F.array().cast("array<struct<text:string,start:int,end:int,type:string>>")))
    words = F.transform("token", lambda t, i: F.when(F.substring(F.get("pos", i), 1, 1).isin(*kinds) & ~inside(i), t))
    terms = F.concat(F.transform("spans", lambda n: F.replace(n["text"], F.lit(" "), F.lit("_"))), F.filter(words, lambda w: w.isNotNull()))
    out = d.select("id", F.explode(terms).alias("term"))
    out = out.withColumn("term", F.lower("term") if lower else F.col("term")).where(F.trim("term") != "")
    return out.where(~F.col("term").isin(list(stop))) if stop else out


def news_json(spark: SparkSession, path: str) -> DataFrame:
    """News: abstract, content and type paths, with both texts joined without a separator."""
    d = spark.read.schema(NEWS).json(path)
    return d.select("*", F.array_join("abstract", "").alias("abstract_text"), F.array_join("content", "").alias("content_text"))


def path_labels(df: DataFrame, key: str, paths: str, names: dict[str, str]) -> DataFrame:
    """(key, label): last segment of every type path through ``names``; the last match wins."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    found = F.filter(F.transform(F.col(paths), lambda p: F.element_at(pairs, F.element_at(F.split(p, "/"), -1))), lambda x: x.isNotNull())
    return df.select(F.col(key), F.when(F.size(found) > 0, F.element_at(found, -1)).alias("label"))


def news_xml(spark: SparkSession, path: str, least: int = 2000) -> DataFrame:
    """(file, abstract, title, text) of XML news, one document a file, longer than ``least``."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    one = lambda p: F.array_join(F.xpath("value", F.lit(p)), " ")
    out = raw.select("file", one("//abstract//text()").alias("abstract"), one("//title/text()").alias("title"), one("//block[@class='full_text']/p/text()").alias("text"))
    return out.where(F.length("text") > least)


def segmented(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, phrases, tokens): tagged phrases, and all tokens with phrases joined by ``_``."""
    tokens = F.filter(F.split(F.lower(join_phrases(F.col(text))), "[ \t\n\r]+"), lambda w: w != "")
    return df.select(F.col(key), phrase_spans(F.col(text)).alias("phrases"), tokens.alias("tokens"))


def event_sentences(df: DataFrame, key: str, text: str, rows: int = 10, least: int = 5) -> DataFrame:
    """(event, sent_no, sentence, phrases) of segmented text: events are ranges of ``rows`` ids.

    Sentences of ``least`` characters or more with one tagged phrase or more; tags are removed.
    """
    each = df.select(F.col(key).alias("id"), F.posexplode(sentences(F.col(text))).alias("sent_no", "s")).where(F.size(phrase_spans(F.col("s"))) > 0)
    plain = each.select(F.floor(F.col("id") / rows).alias("event"), "id", "sent_no", strip_markup(F.col("s")).alias("sentence"), phrase_spans(F.col("s")).alias("phrases"))
    return plain.where(F.length("sentence") >= least)


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """(name, id) of a two-column TSV."""
    return spark.read.schema("name string, id string").option("sep", "\t").option("quote", "").csv(path)


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(src_type, src, dst_type, dst, weight, edge_type) of lines ``t:a<TAB>t:b<TAB>w<TAB>type``."""
    e = spark.read.schema(EDGE).option("sep", "\t").option("quote", "").csv(path)
    part = lambda c, i: F.get(F.split(c, ":", 2), F.lit(i))
    return e.select(part("src", 0).alias("src_type"), part("src", 1).alias("src"), part("dst", 0).alias("dst_type"), part("dst", 1).alias("dst"), "weight", "edge_type")


def network_schema(path: str) -> dict:
    """Node types, edge types with their end types, and which are directed (JSON)."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def stopwords(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    """(word): one a line."""
    w = F.trim("value")
    return spark.read.text(path).select((F.lower(w) if lower else w).alias("word")).where("word <> ''").distinct()


def document_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, docs): distinct documents of every phrase of a ``doc<TAB>phrase`` file."""
    d = spark.read.schema("doc string, phrase string").option("sep", "\t").option("quote", "").csv(path)
    return d.groupBy("phrase").agg(F.sort_array(F.collect_set("doc")).alias("docs"))


def entity_counts(df: DataFrame, without: tuple[str, ...] = ("ORDINAL", "CARDINAL")) -> DataFrame:
    """(text, n) of the entities of annotated documents."""
    return df.select(F.explode("ner").alias("n")).where(~F.col("n.type").isin(*without)).groupBy(F.col("n.text").alias("text")).agg(F.count(F.lit(1)).alias("n"))


def typed_entities(df: DataFrame, kind: str, k: int = 10) -> DataFrame:
    """(text, n): the k rarest entities of a type."""
    n = df.select(F.explode("ner").alias("n")).where(F.col("n.type") == kind).groupBy(F.col("n.text").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy("n", "text").limit(k)


def prefix_match(old: DataFrame, new: DataFrame, text: str = "text", n: int = 100) -> DataFrame:
    """(old_id, new_id): the first new document with the same first characters, else -1."""
    from lexicube.functions.text import head_key

    a = old.select(F.col("id").alias("old_id"), head_key(F.col(text), n).alias("k"))
    b = new.select(F.col("id").alias("new_id"), head_key(F.col(text), n).alias("k")).groupBy("k").agg(F.min("new_id").alias("new_id"))
    return a.join(b, "k", "left").select("old_id", F.coalesce("new_id", F.lit(-1)).alias("new_id"))


def lexicon_words(df: DataFrame, key: str, tokens: Column, lexicon: DataFrame) -> DataFrame:
    """(key, word): words of a given lexicon, or joined phrases (``_``), non-word characters removed."""
    w = df.select(F.col(key), F.explode(tokens).alias("raw")).select(key, F.regexp_replace("raw", "[^A-Za-z0-9_]+", "").alias("word"))
    known = lexicon.select("word").distinct()
    return w.where(F.col("word").contains("_")).unionByName(w.where(~F.col("word").contains("_")).join(known, "word", "left_semi").select(key, "word"))


def term_edges(terms: DataFrame, src_type: str = "D", dst_type: str = "P") -> DataFrame:
    """Typed edges (src_type, src, dst_type, dst, weight, edge_type) of (id, term) rows, counted.

    Blank terms and line ends don't count.
    """
    good = terms.where("id is not null and trim(term) <> '' and trim(term) <> '\\n'")
    n = good.groupBy("id", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return n.select(F.lit(src_type).alias("src_type"), F.col("id").cast("string").alias("src"), F.lit(dst_type).alias("dst_type"), F.col("term").alias("dst"), "weight", F.lit(src_type + dst_type).alias("edge_type"))


def with_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among given ids, as one semi join instead of a scan per query."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def skip_first(df: DataFrame, order: Column, n: int) -> DataFrame:
    """All rows but the first ``n`` in a total order."""
    first = df.withColumn("__o", order).orderBy("__o").limit(n).agg(F.max("__o").alias("__last"))  # one row
    return df.withColumn("__o", order).join(F.broadcast(first)).where("__last is null or __o > __last").drop("__o", "__last")


def stems(words: DataFrame) -> DataFrame:
    """``words`` (word, …) with their ``stem`` by Porter's published algorithm (Arrow batches)."""
    from lexicube.functions.porter import stem

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda w: stem(w) if w is not None else None)

    return words.withColumn("stem", run("word"))
