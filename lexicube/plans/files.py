"""Queries through files: tables are written in every shape of the pipeline and read back.

Files lie in the shared folder. A query gives what the reader made of what the writer
wrote, so its SQL twin is over the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexicube.functions import text as T
from lexicube.operators import assign, index, select
from lexicube.plans import catalog as C, sql as S
from lexicube.plans.catalog import r6
from lexicube.session import cut, new_path, table
from lexicube.sources import readers, sinks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _lines(df: DataFrame, name: str) -> str:
    """Write one string column as text."""
    path = new_path(df.sparkSession, name)
    df.write.text(path)
    return path


@query("SELECT 'dim' AS key, '100' AS value UNION ALL SELECT 'preprocess', 'true' UNION ALL SELECT 'name', 'news set' UNION ALL SELECT 'rate', '0.5'")
def read_settings(spark, d):
    """A run's INI file with numbers, a truth value and text."""
    path = new_path(spark, "settings")
    spark.createDataFrame([("[DEFAULT]\ndim = 100\npreprocess = True\nname = news set\nrate = 0.5\n",)], "value string").coalesce(1).write.text(path)
    file = spark.sparkContext.wholeTextFiles(path + "/part-*").keys().first()
    values = readers.read_settings(file.removeprefix("file:")).values
    return spark.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in values.items()], "key string, value string")


@query("SELECT set_id, count(*) AS n_docs, sum(length(trim(x, ' ')))::BIGINT AS n_chars FROM (SELECT set_id, string_agg(regexp_replace(coalesce(docs, ''), '\\s+', ' ', 'g'), ' story_separator_special_tag ' ORDER BY doc_no) AS line FROM (SELECT set_id, doc_no, arg_max(coalesce(docs, ''), ingested_at) AS docs FROM doc_sets GROUP BY ALL) GROUP BY set_id), (SELECT 1), LATERAL (SELECT unnest(string_split_regex(line, ' *story_separator_special_tag *')) AS x) WHERE trim(x, ' ') <> '' GROUP BY set_id")
def read_sets(spark, d):
    """Document sets written as one line a set in a byte wrapper, and split again."""
    cur = C.current_rows(table(spark, d, "doc_sets").select("set_id", "doc_no", "docs", "ingested_at"), ["set_id", "doc_no"], "ingested_at")
    text = F.regexp_replace(F.coalesce("docs", F.lit("")), "[\\s]+", " ")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_no", text.alias("t")))), lambda x: x["t"]), " story_separator_special_tag ")
    path = _lines(cur.groupBy("set_id").agg(line.alias("line")).select(F.concat_ws("\t", F.col("set_id").cast("string"), F.concat(F.lit('b"'), "line", F.lit('"')))), "sets")
    part = F.split("value", "\t", 2)
    raw = spark.read.text(path).select(F.get(part, F.lit(0)).cast("long").alias("set_id"), F.get(part, F.lit(1)).alias("line"))
    return readers.document_sets(raw, "set_id", "line").groupBy("set_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, regexp_replace(text, '[\\n\\r\\t]+', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL")
def read_lines(spark, d):
    """Background documents, one a line, with ids of their own."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", "[\\n\\r\\t]+", " ").alias("value"))
    path = _lines(docs.orderBy("doc_id").select("value"), "lines")
    return readers.text_lines(spark, path)


_NPH = f"cur AS (SELECT doc_id, x.p AS phrases FROM (SELECT doc_id, arg_max(struct_pack(p := phrases), ingested_at) AS x FROM news GROUP BY doc_id)), ph AS (SELECT doc_id, trim({S.CANON.format('p')}) AS phrase FROM (SELECT doc_id, unnest(string_split(e, ';')) AS p FROM (SELECT doc_id, unnest(phrases) AS e FROM cur) WHERE e IS NOT NULL))"


def _phrase_file(spark, d) -> str:
    news = C._news(spark, d)
    each = F.filter(F.flatten(F.transform("phrases", lambda p: F.split(F.coalesce(p, F.lit("")), ";"))), lambda p: p.isNotNull())
    one = F.array_join(F.transform(F.coalesce(each, F.array().cast("array<string>")), lambda p: T.canonical_phrase(p)), ";")
    return _lines(news.select(F.concat_ws("\t", F.col("doc_id").cast("string"), one)), "phrases")


@query(f"WITH {_NPH} SELECT doc_id, phrase, count(*) AS tf FROM ph WHERE phrase <> '' GROUP BY ALL")
def read_phrase_list(spark, d):
    """Phrase lists ``id<TAB>p1;p2;…`` and their counts."""
    got = readers.phrase_list(spark, _phrase_file(spark, d))
    return index.postings(got, "doc_id", F.col("phrases"))


@query(f"WITH {_NPH} SELECT doc_id, count(DISTINCT phrase) FILTER (WHERE phrase <> '') AS n FROM cur LEFT JOIN ph USING (doc_id) GROUP BY doc_id")
def read_phrase_sets(spark, d):
    """Phrase lists with each phrase once, empty lists included."""
    return readers.phrase_list(spark, _phrase_file(spark, d), dedupe=True).select("doc_id", F.size("phrases").cast("long").alias("n"))


_EMB = "e AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)::FLOAT::DOUBLE) AS v, label FROM embeddings)"


def _vec_file(spark, d, key, header=True) -> str:
    path = new_path(spark, "vectors")
    v = table(spark, d, "embeddings").select(key.alias("key"), F.col("embedding").alias("vec"))
    sinks.embeddings(v, path)
    if header:
        spark.createDataFrame([("500 64",)], "value string").coalesce(1).write.mode("append").text(path)
    return path


def _sum(vec):
    return F.round(F.aggregate(F.col(vec).cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 4)


@query(f"WITH {_EMB} SELECT 'word_' || vec_id AS key, round(list_sum(v), 4) AS total, len(v)::INT AS dim FROM e")
def read_word_vectors(spark, d):
    """word2vec-like text with a header line."""
    got = readers.keyed_embeddings(spark, _vec_file(spark, d, F.concat(F.lit("word_"), "vec_id")), 64)
    return got.select("key", _sum("vec").alias("total"), F.size("vec").alias("dim"))


@query(f"WITH {_EMB} SELECT 'word_' || vec_id AS key, round(list_sum(v), 4) AS total FROM e WHERE label = 3")
def read_some_vectors(spark, d):
    """Only the vectors of given keys (those of one label)."""
    keys = table(spark, d, "embeddings").where("label = 3").select(F.concat(F.lit("word_"), "vec_id").alias("key"))
    return readers.keyed_embeddings(spark, _vec_file(spark, d, F.concat(F.lit("word_"), "vec_id")), 64, keys=keys).select("key", _sum("vec").alias("total"))


@query(f"WITH {_EMB} SELECT 'new york ' || vec_id AS key, round(list_sum(v), 4) AS total FROM e")
def read_phrase_vectors(spark, d):
    """Vectors whose keys have three words (labels of several words)."""
    return readers.keyed_embeddings(spark, _vec_file(spark, d, F.concat(F.lit("new york "), "vec_id")), 64, 3).select("key", _sum("vec").alias("total"))


@query(f"WITH {_EMB} SELECT CASE WHEN vec_id % 2 = 0 THEN 'd' ELSE 'p' END AS type, vec_id::VARCHAR AS id, round(list_sum(v), 4) AS total FROM e")
def read_typed_vectors(spark, d):
    """Vectors of typed keys ``type:id``."""
    key = F.concat(F.when(F.col("vec_id") % 2 == 0, "d").otherwise("p"), F.lit(":"), "vec_id")
    return readers.typed_embeddings(spark, _vec_file(spark, d, key), 64).select("type", "id", _sum("vec").alias("total"))


@query(f"WITH {_EMB} SELECT 't' || vec_id AS label, round(list_sum(v), 4) AS total FROM e WHERE vec_id < 20 UNION ALL SELECT 'none', NULL")
def read_topics(spark, d):
    """Vectors of topics by the names of a topic list; names without a vector are reported with none."""
    names = spark.range(20).select(F.concat(F.lit("t"), "id").alias("label")).union(spark.createDataFrame([("none",)], "label string"))
    found = cut(readers.label_rows(spark, _vec_file(spark, d, F.concat(F.lit("t"), "vec_id")), names, 64), "topics")
    return found.select("label", _sum("vec").alias("total")).unionByName(readers.label_misses(names, found).withColumn("total", F.lit(None).cast("double")))


@query(f"WITH {_EMB} SELECT vec_id AS doc_id, round(list_sum(v), 4) AS total, 0 AS failed FROM e")
def read_doc_vectors(spark, d):
    """A strict document embedding file: records by id, and no line that fails."""
    good, bad = readers.document_embeddings(spark, _vec_file(spark, d, F.col("vec_id").cast("string")), 64)
    n = F.broadcast(bad.agg(F.count(F.lit(1)).cast("int").alias("failed")))
    return good.join(n).select("doc_id", _sum("embedding").alias("total"), "failed")


@query(f"WITH {_EMB} SELECT n_name || vec_id // 25 AS key, round(list_sum(v), 4) AS total FROM e JOIN nation ON n_nationkey = vec_id % 25")
def translated_vectors(spark, d):
    """An embedding export whose typed ids are replaced by names."""
    names = table(spark, d, "embeddings").join(table(spark, d, "nation"), F.col("vec_id") % 25 == F.col("n_nationkey")).select(F.col("vec_id").cast("string").alias("id"), F.replace(F.concat("n_name", (F.col("vec_id") / 25).cast("int").cast("string")), F.lit(" "), F.lit(" ")).alias("name"))
    path = new_path(spark, "vectors")
    sinks.embeddings(table(spark, d, "embeddings").select(F.concat(F.lit("P:"), "vec_id").alias("key"), F.col("embedding").alias("vec")), path, names=names)
    return readers.keyed_embeddings(spark, path, 64).select(F.replace("key", F.lit(" "), F.lit(" ")).alias("key"), _sum("vec").alias("total"))


# annotated text: words of a document, kinds by their length, and one entity -----------------------


def _annotated(spark, d) -> str:
    t = F.slice(T.raw_tokens(F.col("text")), 1, 30)
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", t.alias("token")).where(F.size("token") >= 6)
    kind = F.transform("token", lambda w: F.element_at(F.array(*[F.lit(x) for x in ("NN", "JJ", "VB", "IN")]), (F.length(w) % 4 + 1).cast("int")))
    span = lambda a, b, k: F.struct(F.array_join(F.slice("token", a + 1, b - a), " ").alias("text"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(k).alias("type"))
    rows = docs.select(F.col("doc_id").alias("id"), "token", kind.alias("pos"), F.array(span(0, 2, "ORG"), span(4, 5, "CARDINAL")).alias("ner"))
    path = new_path(spark, "annotated")
    rows.write.json(path)
    return path


_ANN = """an AS (SELECT doc_id AS id, t FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')[1:30] AS t FROM documents WHERE text IS NOT NULL) WHERE len(t) >= 6),
tk AS (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS i FROM an)"""


def _terms(kinds: str) -> str:
    return f"terms AS (SELECT id, lower(replace(t[1] || ' ' || t[2], ' ', '_')) AS term FROM an UNION ALL SELECT id, lower(w) FROM tk WHERE i >= 2 AND length(w) % 4 IN ({kinds}))"


@query(f"WITH {_ANN}, {_terms('0, 1, 2')} SELECT id, term, count(*) AS n FROM terms WHERE trim(term) <> '' GROUP BY ALL")
def annotated_terms(spark, d):
    """Terms of annotated text: entities as one term, nouns, adjectives and verbs outside them."""
    return readers.annotated_terms(readers.annotated_json(spark, _annotated(spark, d))).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ANN}, {_terms('0, 1')} SELECT 'D' AS src_type, id::VARCHAR AS src, 'P' AS dst_type, term AS dst, count(*)::DOUBLE AS weight, 'DP' AS edge_type FROM terms WHERE trim(term) <> '' AND term NOT IN ('the', 'of') GROUP BY ALL")
def annotated_edges(spark, d):
    """Document-term edges of annotated text, nouns and adjectives, without stopwords."""
    path = new_path(spark, "stopwords")
    spark.createDataFrame([("The",), ("of",), ("",)], "value string").write.text(path)
    terms = readers.annotated_terms(readers.annotated_json(spark, _annotated(spark, d)), "NJ")
    return readers.term_edges(terms.join(F.broadcast(readers.stopwords(spark, path)), F.col("term") == F.col("word"), "left_anti"))


@query(f"WITH {_NPH} SELECT 'D' AS src_type, doc_id::VARCHAR AS src, 'P' AS dst_type, phrase AS dst, count(*)::DOUBLE AS weight, 'DP' AS edge_type FROM ph WHERE phrase <> '' GROUP BY ALL")
def phrase_edges(spark, d):
    """Document-phrase edges of phrase lists."""
    lists = readers.phrase_list(spark, _phrase_file(spark, d))
    return readers.term_edges(lists.select(F.col("doc_id").alias("id"), F.explode("phrases").alias("term")))


@query(f"WITH {_ANN} SELECT t[1] || ' ' || t[2] AS text, count(*) AS n FROM an GROUP BY 1")
def entity_counts(spark, d):
    """Entities of annotated text without numbers."""
    return readers.entity_counts(readers.annotated_json(spark, _annotated(spark, d)))


@query(f"WITH {_ANN} SELECT t[5] AS text, count(*) AS n FROM an GROUP BY 1 ORDER BY n, text LIMIT 10")
def rarest_entities(spark, d):
    """The ten rarest entities of one type."""
    return readers.typed_entities(readers.annotated_json(spark, _annotated(spark, d)), "CARDINAL")


@query(f"WITH {_ANN}, k AS (SELECT t[5] AS x FROM an GROUP BY 1 HAVING count(*) > 1) SELECT id, t[5] AS text FROM an WHERE t[5] IN (SELECT x FROM k)")
def linkable_entities(spark, d):
    """Entities that a list of known names holds (here: those that stand twice)."""
    ner = cut(readers.annotated_json(spark, _annotated(spark, d)).select("id", F.explode("ner").alias("n")).where("n.type = 'CARDINAL'").select("id", F.col("n.text").alias("text")), "entities")
    known = ner.groupBy("text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return ner.join(known, "text", "left_semi").select("id", "text")


# news, tables, networks -----------------------------------------------------------------------------


@query("SELECT array_to_string(x.a, '') AS abstract_text, length(array_to_string(x.c, ''))::INT AS n_content FROM (SELECT doc_id, arg_max(struct_pack(a := abstract_sents, c := content_sents), ingested_at) AS x FROM news GROUP BY doc_id) WHERE x.a IS NOT NULL AND x.c IS NOT NULL")
def read_news(spark, d):
    """News as JSON, sentences joined without a separator."""
    path = new_path(spark, "news")
    C._news(spark, d).where("abstract_sents is not null and content_sents is not null").select(F.col("abstract_sents").alias("abstract"), F.col("content_sents").alias("content"), F.col("type_path").alias("type")).write.json(path)
    return readers.news_json(spark, path).select("abstract_text", F.length("content_text").alias("n_content"))


@query("SELECT doc_id, length(trim(regexp_replace(text, '[<>&\\x00-\\x20]+', ' ', 'g')))::INT AS n FROM documents WHERE length(trim(regexp_replace(text, '[<>&\\x00-\\x20]+', ' ', 'g'))) > 2000")
def read_xml(spark, d):
    """XML news, one document a file, those longer than 2 000 characters (of every 40th document by length)."""
    docs = table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace("text", "[<>&\\x00-\\x20]+", " ")).alias("t")).where(F.length("t") > 1000)
    xml = F.concat(F.lit("<nitf><head><title>"), F.col("doc_id").cast("string"), F.lit("</title></head><body><abstract><p>a</p></abstract><block class=\"full_text\"><p>"), "t", F.lit("</p></block></body></nitf>"))
    path = new_path(spark, "xml")
    docs.select(xml.alias("value"), "doc_id").repartition(F.col("doc_id")).write.partitionBy("doc_id").text(path)
    got = readers.news_xml(spark, f"{path}/*/*.txt")
    return got.select(F.col("title").cast("long").alias("doc_id"), F.length("text").alias("n"))


@query("SELECT n_name AS name, n_nationkey::VARCHAR AS id FROM nation")
def read_mapping(spark, d):
    """Names and ids as TSV, written and read."""
    path = new_path(spark, "mapping")
    sinks.mapping(table(spark, d, "nation").select("n_name", "n_nationkey"), path)
    return readers.mapping(spark, path)


@query(f"WITH {_NPH} SELECT phrase, array_to_string(list_sort(list(DISTINCT doc_id::VARCHAR)), ' ') AS docs FROM ph WHERE phrase <> '' GROUP BY phrase")
def read_doc_phrases(spark, d):
    """Documents of every phrase from a file of pairs."""
    lists = readers.phrase_list(spark, _phrase_file(spark, d))
    path = new_path(spark, "pairs")
    sinks.mapping(lists.select(F.col("doc_id").cast("string"), F.explode("phrases")), path)
    return readers.document_phrases(spark, path).select("phrase", F.array_join("docs", " ").alias("docs"))


@query(f"WITH {S.HIN} SELECT edge_type, src_type, src, dst_type, dst, round(weight, 2) AS weight FROM he")
def read_network(spark, d):
    """A typed network as node and edge files, edges read back."""
    path = new_path(spark, "network")
    sinks.network(C._hin(spark, d), path)
    return readers.edge_list(spark, f"{path}/edges").select("edge_type", "src_type", "src", "dst_type", "dst", F.round("weight", 2).alias("weight"))


@query(f"WITH {S.HIN} SELECT type, count(*) AS n FROM hn GROUP BY type")
def read_node_files(spark, d):
    """The node files of a network, one folder a type."""
    path = new_path(spark, "network")
    sinks.network(C._hin(spark, d), path)
    return spark.read.schema("key string, type string").csv(f"{path}/nodes").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'customer' AS src_type, 'order' AS dst_type, 'places' AS edge_type, true AS directed UNION ALL SELECT 'part', 'supplier', 'from', false")
def read_network_schema(spark, d):
    """The schema of a network as JSON."""
    path = new_path(spark, "schema")
    text = '{"edges": [["customer", "order", "places", true], ["part", "supplier", "from", false]]}'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    file = spark.sparkContext.wholeTextFiles(path + "/part-*").keys().first()
    return spark.createDataFrame([tuple(e) for e in readers.network_schema(file.removeprefix("file:"))["edges"]], "src_type string, dst_type string, edge_type string, directed boolean")


@query(f"WITH {S.HIER} SELECT child, parent, relation, level FROM l")
def read_hierarchy(spark, d):
    """A hierarchy, saved and loaded."""
    path = new_path(spark, "hierarchy")
    sinks.hierarchy(C._links(spark, d), path)
    return spark.read.parquet(path).select("child", "parent", "relation", "level")


@query("SELECT a.vec_id AS doc_id, CASE WHEN a.vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS edge_type, round(1 / (1 + exp(-list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def saved_edge_scores(spark, d):
    """Edge scores, one folder an edge type."""
    path = new_path(spark, "scores")
    s = C.edge_score(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("edge_type"), "score")
    sinks.edge_scores(s, path)
    return spark.read.parquet(path).select("doc_id", "edge_type", "score")


@query(f"WITH {S.CENT} SELECT label, step, round(c[1] * step, 6) AS first FROM cent, (SELECT unnest([1, 2]) AS step)")
def saved_snapshots(spark, d):
    """Snapshots of a model table, one a training step, the right one read back."""
    path = new_path(spark, "model")
    c = cut(assign.centroids(C._vecs(spark, d), "label", "vec", 64), "centroids")
    for step in (1, 2):
        sinks.snapshot(c.select("label", (F.get("label_vec", F.lit(0)) * step).alias("first")), path, step)
    return spark.read.parquet(path).select("label", F.col("step").cast("int").alias("step"), r6("first"))


_FIRST = f"{S.SENTS}, pk AS (SELECT set_id, sent_no, row_number() OVER (PARTITION BY set_id ORDER BY len(tokens) DESC, sent_no) AS pick FROM sents QUALIFY pick <= 2), n AS (SELECT set_id, max(pick) AS n FROM pk GROUP BY set_id)"


def _longest(spark, d) -> tuple[DataFrame, DataFrame]:
    s = C._sents(spark, d)
    return s, C.top_k(s.select("set_id", "sent_no", "sentence", F.size("tokens").alias("n")), ["set_id"], [F.col("n").desc(), F.col("sent_no")], 2, "pick")


@query(f"WITH {_FIRST} SELECT s.set_id, s.sent_no::INT AS sent_no, coalesce(n - pick + 1, -1)::INT AS flag FROM sents s LEFT JOIN pk USING (set_id, sent_no) LEFT JOIN n ON n.set_id = s.set_id")
def saved_sentence_flags(spark, d):
    """Sentences with the place of choice counted from the end, -1 if not chosen."""
    s, picks = _longest(spark, d)
    path = new_path(spark, "flags")
    sinks.sentence_flags(s, picks, path)
    return spark.read.parquet(path)


@query(f"WITH {_FIRST} SELECT set_id, string_agg(replace(sentence, '_', ' '), ' ' ORDER BY pick) AS summary FROM pk JOIN sents USING (set_id, sent_no) GROUP BY set_id")
def saved_summaries(spark, d):
    """Summaries as lines, sentences in the order of choice."""
    path = new_path(spark, "summaries")
    sinks.summaries(_longest(spark, d)[1], path)
    return spark.read.schema("set_id long, summary string").json(path)


@query(f"WITH {S.SENTS} SELECT set_id, count(*) AS n FROM sents GROUP BY set_id")
def saved_sentence_lines(spark, d):
    """Sentences, one a line with its set."""
    path = new_path(spark, "lines")
    sinks.sentence_lines(C._sents(spark, d).select("set_id", F.regexp_replace("sentence", "[\\n\\r\\t]+", " ").alias("sentence")), path)
    return spark.read.schema("set_id long, sentence string").option("sep", "\t").option("quote", "").csv(path).groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S.PAIRS} SELECT a, b, n FROM (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) GROUP BY ALL) WHERE n > 15 AND NOT regexp_matches(a || b, '[\"\\t]')")
def saved_heavy_edges(spark, d):
    """Word pairs that stand together over 15 times, for drawing elsewhere."""
    path = new_path(spark, "edges")
    c = C.cooc.window_counts(C._pairs(spark, d)).where(~F.concat("a", "b").rlike('["\t]')).select("a", "b", F.col("n").alias("w"))
    sinks.similar_edges(c, path)
    return spark.read.schema("a string, b string, n long").option("sep", "\t").option("quote", "").csv(path)


@query("SELECT doc_id, n_rows FROM (SELECT doc_id, count(*) AS n_rows FROM doc_phrase WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'wire') GROUP BY doc_id)")
def scan_by_ids(spark, d):
    """A scan that keeps given ids only (a semi join the scan's own filters serve)."""
    return readers.with_ids(table(spark, d, "doc_phrase"), table(spark, d, "documents").where("source = 'wire'").select("doc_id"), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("WITH s AS (SELECT set_id, row_number() OVER (ORDER BY set_id) AS i FROM (SELECT DISTINCT set_id FROM doc_sets WHERE set_id IS NOT NULL)) SELECT set_id FROM s WHERE i > 10")
def skipped_head(spark, d):
    """Sets of a file without its first ten, in the order of their ids."""
    return readers.skip_first(table(spark, d, "doc_sets").where("set_id is not null").select("set_id").distinct(), F.col("set_id"), 10)


@query(f"""WITH w AS (SELECT doc_id, {S.tok('text')} AS t FROM documents WHERE text IS NOT NULL), lx AS (SELECT DISTINCT regexp_replace(desk, '[^A-Za-z0-9_]+', '', 'g') AS word FROM news WHERE desk IS NOT NULL), u AS (SELECT doc_id, regexp_replace(x, '[^A-Za-z0-9_]+', '', 'g') AS word FROM (SELECT doc_id, unnest(t) AS x FROM w)) SELECT doc_id, word, count(*) AS n FROM u WHERE contains(word, '_') OR word IN (SELECT word FROM lx) GROUP BY ALL""")
def lexicon_words(spark, d):
    """Words of a lexicon (names of desks), non-word characters removed."""
    lex = table(spark, d, "news").where("desk is not null").select(F.regexp_replace("desk", "[^A-Za-z0-9_]+", "").alias("word")).distinct()
    got = readers.lexicon_words(table(spark, d, "documents").where("text is not null"), "doc_id", T.tokens(F.col("text")), lex)
    return got.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(w, ' ') AS words, len(w)::INT AS n FROM t WHERE length(array_to_string(w, ' ')) >= 5")
def sentence_words(spark, d):
    """White-space tokens of texts of five characters or more."""
    t = T.raw_tokens(F.col("text"))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(t, " ").alias("words"), F.size(t).alias("n"))
    return docs.where(F.length("words") >= 5)


@query()
def stemmed_words(spark, d):
    """Stems of the words of the English documents, with their counts."""
    docs = table(spark, d, "documents").where("lang = 'en' and text is not null")
    words = docs.select(F.explode(T.tokens(F.col("text"))).alias("word")).where(T.is_eng(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return readers.stems(words).groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_words"))


@query("""WITH s AS (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) - 1 AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM documents WHERE text IS NOT NULL)), k AS (SELECT doc_id, trim(s, ' ') AS s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS no FROM s WHERE trim(s, ' ') <> '')
SELECT doc_id // 10 AS event, doc_id AS id, no::INT AS sent_no, s AS sentence, len(regexp_extract_all(s, '[a-z]+ [a-z]+'))::INT AS n_phrases FROM k WHERE len(regexp_extract_all(s, '[a-z]+ [a-z]+')) > 0 AND length(s) >= 5""")
def event_sentences(spark, d):
    """Sentences with a tagged phrase, by events of ten documents each."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", "([a-z]+ [a-z]+)", "<phrase>$1</phrase>").alias("x"))
    return readers.event_sentences(docs, "doc_id", "x").select("event", "id", "sent_no", "sentence", F.size("phrases").alias("n_phrases"))


@query(f"WITH {S.TF}, {S.IDF}, r AS (SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY tf * idf DESC, phrase) AS r FROM tf JOIN idf USING (phrase)) SELECT doc_id, string_agg(phrase, ';' ORDER BY phrase) AS phrases FROM r WHERE r <= 3 AND NOT contains(phrase, ';') GROUP BY doc_id")
def saved_annotations(spark, d):
    """Chosen phrases of every document as text, read back."""
    path = new_path(spark, "annotations")
    top = index.tfidf_top(cut(C.word_tf(spark, d), "tf"), 3).where(~F.col("phrase").contains(";")).select("doc_id", "phrase")
    sinks.annotations(top, path)
    part = F.split("value", "\t", 2)
    return spark.read.text(path).select(F.get(part, F.lit(0)).cast("long").alias("doc_id"), F.get(part, F.lit(1)).alias("phrases"))
