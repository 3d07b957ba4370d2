"""Queries over document sets: retrieval, cell scores, contrast, sentence choice, summaries.

The greedy choices have SQL twins too: a recursion that carries what is consumed and
picked, one best sentence a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexicube.functions import text as T
from lexicube.operators import cooc, cube, rank, select, sentence
from lexicube.operators.common import current_rows
from lexicube.plans import catalog as C, sql as S, summarize
from lexicube.plans.catalog import r6
from lexicube.session import cut, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# the collection: sets of doc_sets against documents, labelled by their vectors ---------


def _docs(spark, d) -> DataFrame:
    cur = current_rows(table(spark, d, "doc_sets").select("set_id", "doc_no", "docs", "ingested_at"), ["set_id", "doc_no"], "ingested_at")
    return cut(cur.select("set_id", "doc_no", F.coalesce(T.tokens(F.col("docs")), F.array().cast("array<string>")).alias("tokens")), "docs")


def _collection(spark, d) -> summarize.Collection:
    back = cut(table(spark, d, "documents").where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("tokens")), "background")
    return summarize.Collection(_docs(spark, d), back, cut(C._assigned(spark, d), "assigned"))


_SETS = f"""{S.TF}, {S.IDF},
own AS (SELECT set_id, doc_no, {S.tok("arg_max(coalesce(docs, ''), ingested_at)")} AS tokens FROM doc_sets GROUP BY set_id, doc_no),
otf AS (SELECT set_id, doc_no, phrase, count(*) AS tf FROM (SELECT set_id, doc_no, unnest(tokens) AS phrase FROM own) GROUP BY ALL)"""
_NEAR = f"""{_SETS},
ow AS (SELECT set_id, doc_no, phrase, tf * idf AS v FROM otf JOIN idf USING (phrase)),
on2 AS (SELECT set_id, doc_no, sqrt(sum(v * v)) AS n FROM ow GROUP BY ALL HAVING sum(v * v) > 0),
os AS (SELECT set_id, phrase, sum(v / n) AS v FROM ow JOIN on2 USING (set_id, doc_no) GROUP BY ALL),
bw AS (SELECT doc_id, phrase, tf * idf AS w FROM tf JOIN idf USING (phrase)), bn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM bw GROUP BY doc_id HAVING sum(w * w) > 0),
dots AS (SELECT set_id, doc_id, sum(v * w / n) AS score FROM os JOIN bw USING (phrase) JOIN bn USING (doc_id) GROUP BY ALL HAVING round(sum(v * w / n), 6) <> 0),
near AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM dots QUALIFY rank <= 50)"""
_SIBS = f"""{_NEAR}, {S.ASSIGN},
sibd AS (SELECT label, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY margin DESC, doc_id) AS r FROM best) WHERE r <= 100),
sib AS MATERIALIZED (SELECT label, phrase, sum(tf) AS tf, count(*) AS df FROM sibd JOIN tf USING (doc_id) GROUP BY ALL),
vote AS (SELECT set_id, label FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY n DESC, label) AS r FROM (SELECT set_id, label, count(*) AS n FROM near JOIN best USING (doc_id) GROUP BY set_id, label)) WHERE r = 1),
mine AS MATERIALIZED (SELECT set_id, phrase, sum(tf) AS tf, count(*) AS df FROM otf GROUP BY ALL),
sst AS (SELECT label, sum(tf) AS dl, max(df) AS max_df FROM sib GROUP BY label), mst AS (SELECT set_id, sum(tf) AS dl, max(df) AS max_df FROM mine GROUP BY set_id)"""
_REL = "CASE WHEN {tf} > 0 THEN 3 * {tf} * 2.2 / ({tf} + 1.2 * (0.5 + 0.5 * {dl} / avgdl)) * log2(1 + {df}) / log2(1 + {mdf}) ELSE 0 END"


def _cells(pairs: str, name: str) -> str:
    """Scores of the sets' phrases; ``pairs`` gives the sibling cells (set_id, label) of every set."""
    own, other = _REL.format(tf="m.tf", dl="s.dl", df="m.df", mdf="s.max_df"), _REL.format(tf="b.tf", dl="t.dl", df="b.df", mdf="t.max_df")
    return f"""{name}p AS ({pairs}), {name}a AS (SELECT mst.set_id, (any_value(mst.dl) + coalesce(sum(sst.dl), 0)) / (1 + count(sst.label)) AS avgdl, count(sst.label) AS cells FROM mst LEFT JOIN {name}p p USING (set_id) LEFT JOIN sst ON sst.label = p.label GROUP BY mst.set_id),
{name}o AS (SELECT m.set_id, m.phrase, sum(exp({other})) AS e, count(*) AS held FROM mine m JOIN {name}p p USING (set_id) JOIN sib b ON b.label = p.label AND b.phrase = m.phrase JOIN sst t ON t.label = p.label JOIN {name}a USING (set_id) GROUP BY ALL),
{name} AS (SELECT set_id, phrase, tf, d, log2(1 + tf) * d AS score FROM (SELECT m.set_id, m.phrase, m.tf, exp({own}) AS x, x / (1 + x + coalesce(o.e, 0) + cells - coalesce(held, 0)) AS d FROM mine m JOIN mst s USING (set_id) JOIN {name}a USING (set_id) LEFT JOIN {name}o o ON o.set_id = m.set_id AND o.phrase = m.phrase))"""


_ALL = _cells("SELECT mst.set_id, sst.label FROM mst JOIN sst ON true LEFT JOIN vote USING (set_id) WHERE vote.label IS NULL OR vote.label <> sst.label", "cell")
_TWIN = _cells("SELECT set_id, label FROM vote JOIN sst USING (label)", "twin")


@query(f"WITH {_NEAR} SELECT set_id, doc_id, round(score, 5) AS score, rank FROM near")
def retrieved_docs(spark, d):
    """The documents every set is compared with: 50 by summed tf-idf cosine."""
    return summarize.retrieve(_collection(spark, d)).select("set_id", "doc_id", F.round("score", 5).alias("score"), "rank")


def _scored(spark, d, twin=False):
    c = _collection(spark, d)
    return cube.set_scores(c.docs, summarize.siblings(c), summarize.categories(c, cut(summarize.retrieve(c), "retrieved")), twin)


@query(f"WITH {_SIBS}, {_ALL} SELECT set_id, phrase, round(d, 6) AS distinct_score, round(score, 6) AS score FROM cell")
def set_cell_scores(spark, d):
    """Words of every set as a cell against the labels' cells, its own category left out."""
    return _scored(spark, d).select("set_id", "phrase", r6("distinct", "distinct_score"), r6("score"))


@query(f"WITH {_SIBS}, {_ALL}, q AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY round(score, 9) DESC, phrase) AS r FROM cell) SELECT set_id, phrase, round(score, 6) AS score FROM q WHERE r <= 30")
def caseolap_phrases(spark, d):
    return summarize.phrase_scores(_collection(spark, d), "caseOLAP").select("set_id", "phrase", r6("score"))


@query(f"WITH {_SIBS}, {_ALL}, {_TWIN.replace('mst LEFT JOIN', '(SELECT * FROM mst SEMI JOIN twinp USING (set_id)) mst LEFT JOIN')}, q AS (SELECT set_id, phrase, c.score * t.d AS score, row_number() OVER (PARTITION BY set_id ORDER BY round(c.score * t.d, 9) DESC, phrase) AS r FROM cell c JOIN twin t USING (set_id, phrase)) SELECT set_id, phrase, round(score, 6) AS score FROM q WHERE r <= 30")
def caseolap_twin_phrases(spark, d):
    return summarize.phrase_scores(_collection(spark, d), "caseOLAP-twin").select("set_id", "phrase", r6("score"))


_SEEDS = "seeds AS MATERIALIZED (SELECT set_id, phrase AS node FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY round(score, 9) DESC, phrase) AS r FROM cell) WHERE r <= 10)"
_OWN_GRAPH = """otk AS (SELECT set_id, doc_no, tokens[i] AS a, unnest(tokens[i + 1 : i + 4]) AS b FROM (SELECT *, generate_subscripts(tokens, 1) AS i FROM own)),
oe1 AS (SELECT set_id, a, b, count(*)::DOUBLE AS w FROM (SELECT DISTINCT set_id, doc_no, least(a, b) AS a, greatest(a, b) AS b FROM otk WHERE a <> b) GROUP BY ALL),
oe AS MATERIALIZED (SELECT set_id, src, dst, w / sum(w) OVER (PARTITION BY set_id, src) AS p FROM (SELECT set_id, a AS src, b AS dst, w FROM oe1 UNION ALL SELECT set_id, b, a, w FROM oe1))"""


def _neumann(name: str, edges: str, start: str, terms: int) -> str:
    """The walk's series term by term; ``start`` (set_id, node, x)."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT set_id, node, x FROM {start})"]
    for r in range(terms):
        steps.append(f"{name}_{r + 1} AS MATERIALIZED (SELECT e.set_id, e.dst AS node, sum(0.85 * e.p * i.x) AS x FROM {name}_{r} i JOIN {edges} e ON e.set_id = i.set_id AND e.src = i.node GROUP BY e.set_id, e.dst)")
    every = " UNION ALL ".join(f"SELECT * FROM {name}_{r}" for r in range(terms + 1))
    return ", ".join(steps) + f", {name} AS MATERIALIZED (SELECT set_id, node, 0.15 * sum(x) AS s FROM ({every}) GROUP BY ALL)"


@query(f"WITH RECURSIVE {_SIBS}, {_ALL}, {_SEEDS}, {_OWN_GRAPH}, x0 AS (SELECT set_id, node, 1.0::DOUBLE AS x FROM seeds), {_neumann('sr', 'oe', 'x0', 6)}, nd AS (SELECT DISTINCT set_id, node FROM (SELECT set_id, a AS node FROM otk UNION ALL SELECT set_id, b FROM otk)), q AS (SELECT set_id, node AS phrase, coalesce(s, 0) AS score, row_number() OVER (PARTITION BY set_id ORDER BY round(coalesce(s, 0), 9) DESC, node) AS r FROM nd LEFT JOIN sr USING (set_id, node)) SELECT set_id, phrase, round(score, 6) AS score FROM q WHERE r <= 100")
def wo_twins_phrases(spark, d):
    """The seed walk on the sets' own graphs, six terms of the series."""
    return summarize.phrase_scores(_collection(spark, d), "sumdocs_wo_twins", terms=6).select("set_id", "phrase", r6("score"))


_BACK = f"""bdoc AS MATERIALIZED (SELECT near.set_id, doc_id, {S.tok('text')} AS t FROM near JOIN documents USING (doc_id)),
{S.PAIRS}, dpair AS MATERIALIZED (SELECT key AS doc_id, a, b, count(*)::DOUBLE AS n FROM p WHERE a <> b GROUP BY ALL),
be1 AS (SELECT set_id, a, b, sum(n) AS w FROM (SELECT set_id, a, b, n FROM near JOIN dpair USING (doc_id) UNION ALL SELECT set_id, b, a, n FROM near JOIN dpair USING (doc_id)) GROUP BY ALL),
be AS MATERIALIZED (SELECT set_id, a AS src, b AS dst, w / sum(w) OVER (PARTITION BY set_id, a) AS p FROM be1),
ownv AS MATERIALIZED (SELECT DISTINCT set_id, unnest(tokens) AS node FROM own), voc AS MATERIALIZED (SELECT set_id, node FROM ownv UNION SELECT DISTINCT set_id, unnest(t) FROM bdoc SEMI JOIN ownv USING (set_id))"""


def _contrast(rounds: int, terms: int, k: int) -> str:
    parts, start = [], "SELECT set_id, node, 1.0::DOUBLE AS x FROM seeds"
    for r in range(rounds):
        parts.append(f"""x{r} AS MATERIALIZED ({start}), {_neumann(f't{r}', 'oe', f'x{r}', terms)}, {_neumann(f'b{r}', 'be', f'x{r}', terms)},
l{r} AS MATERIALIZED (SELECT v.set_id, v.node, round(coalesce(t.s, 0) - coalesce(b.s, 0), 9) AS lead FROM voc v LEFT JOIN t{r} t ON t.set_id = v.set_id AND t.node = v.node LEFT JOIN b{r} b ON b.set_id = v.set_id AND b.node = v.node),
k{r} AS MATERIALIZED (SELECT * FROM (SELECT l.set_id, l.node, l.lead, row_number() OVER (PARTITION BY l.set_id ORDER BY l.lead DESC, l.node) AS r FROM (SELECT *, round(avg(lead) OVER (PARTITION BY set_id), 9) AS m FROM l{r}) l JOIN ownv USING (set_id, node) WHERE lead > m) WHERE r <= {k})""")
        start = f"SELECT set_id, node, sum(x)::DOUBLE AS x FROM (SELECT set_id, node, 1.0::DOUBLE AS x FROM seeds UNION ALL SELECT set_id, node, 0.85 FROM k{r}) GROUP BY ALL"
    return ", ".join(parts)


@query(f"WITH RECURSIVE {_SIBS}, {_ALL}, {_SEEDS}, {_OWN_GRAPH}, {_BACK}, {_contrast(2, 6, 20)} SELECT set_id, node AS phrase, round(lead, 6) AS score FROM k1")
def contrast_phrases(spark, d):
    """Two rounds of the contrast with six terms a walk and 20 picks."""
    return summarize.phrase_scores(_collection(spark, d), "sumdocs", 20, 2, 6).select("set_id", "phrase", r6("score"))


def _summary(method):
    def run(spark, d):
        return summarize.summarise(_collection(spark, d), C._sents(spark, d), method)

    run.__doc__ = f"Summaries of every set by the method {method}."
    return run


QUERIES |= {name: _summary(m) for name, m in {"sumdocs_contrast": "sumdocs", "sumdocs_wo_twins": "sumdocs_wo_twins", "sumdocs_textrank": "sumdocs_textrank", "sumdocs_graph_degen": "graph_degen", "sumdocs_caseolap": "caseOLAP", "sumdocs_caseolap_twin": "caseOLAP-twin"}.items()}


@query()
def sumdocs_contrast_knn(spark, d):
    """As ``sumdocs_contrast`` for the sets of ``documents`` with vectors: compared with the 2n nearest of their label."""
    v = cut(C._vecs(spark, d).select("doc_id", "vec"), "vectors")
    docs = table(spark, d, "documents").where("text is not null and set_id is not null").select("doc_id", "set_id", "text")
    own = cut(docs.join(v, "doc_id").withColumn("doc_no", F.col("doc_id")), "own")
    back = cut(table(spark, d, "documents").where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("tokens")), "background")
    words = cut(own.select("set_id", "doc_no", T.tokens(F.col("text")).alias("tokens")), "docs")
    c = summarize.Collection(words, back, cut(C._assigned(spark, d), "assigned"), own.select("set_id", "doc_id", "vec"), v)
    sents = cut(sentence.sentence_tokens(own, "text", T.sentences, T.tokens), "sentences")
    return summarize.summarise(c, sents, "sumdocs", kind="vectors")


@query(f"WITH {S.ASSIGN}, v AS (SELECT set_id, b.label, count(*) AS n FROM best b JOIN documents d ON d.doc_id = b.doc_id WHERE set_id IS NOT NULL GROUP BY ALL), m AS (SELECT set_id, arg_max(label, struct_pack(n := n, k := -label)) AS label FROM v GROUP BY set_id) SELECT set_id, b.doc_id FROM m JOIN best b USING (label) WHERE b.doc_id IN (SELECT doc_id FROM documents WHERE source = 'wire')")
def pool_candidates(spark, d):
    """For every set the documents of its voted label that a pool (one source) holds."""
    given = cut(C._assigned(spark, d), "assigned")
    docs = table(spark, d, "documents")
    voted = C.assign.majority_label(given, docs.where("set_id is not null")).select("set_id", "label")
    held = given.join(docs.where("source = 'wire'").select("doc_id"), "doc_id", "left_semi")
    return held.join(voted, "label").select("set_id", "doc_id")


# sentence choice -----------------------------------------------------------------------

_SCORES = f"""{S.SENTS}, stf AS (SELECT set_id, phrase, count(*) AS tf FROM (SELECT set_id, unnest(tokens) AS phrase FROM sents) GROUP BY ALL),
sdf AS (SELECT phrase, ln((SELECT count(DISTINCT set_id) FROM stf) / count(*)::DOUBLE) AS idf FROM stf GROUP BY phrase),
ssum AS (SELECT set_id, sent_no, sum(tf * idf) AS total FROM (SELECT DISTINCT set_id, sent_no, unnest(tokens) AS phrase FROM sents) JOIN stf USING (set_id, phrase) JOIN sdf USING (phrase) GROUP BY ALL),
cand AS MATERIALIZED (SELECT s.set_id, s.sent_no, s.sentence, len(tokens) AS n, greatest(1, length(array_to_string(tokens, ' '))) AS chars, list_distinct(tokens) AS own, total, total / len(tokens) AS q FROM sents s JOIN ssum USING (set_id, sent_no)),
every AS MATERIALIZED (SELECT set_id, count(*) AS m FROM stf GROUP BY set_id)"""


def _greedy(value: str, fits: str = "true", most: int | None = None, size: str = "n", less: bool = False) -> str:
    """A best sentence a step; ``value`` and ``fits`` see the candidate c and the state."""
    room = f"AND len(picked) < {most}" if most else ""
    extra = ", coalesce(max(s.sim), 0) AS less" if less else ""
    join = "LEFT JOIN sim s ON s.set_id = it.set_id AND s.i = c.sent_no AND list_contains(picked, s.j)" if less else ""
    return f"""it AS (SELECT set_id, 0 AS step, []::INTEGER[] AS gone, []::INTEGER[] AS picked, []::VARCHAR[] AS cov, 0::BIGINT AS used FROM every
UNION ALL SELECT set_id, step + 1, list_append(gone, b.sent_no), CASE WHEN fits THEN list_append(picked, b.sent_no) ELSE picked END, CASE WHEN fits THEN list_distinct(list_concat(cov, b.own)) ELSE cov END, CASE WHEN fits THEN used + b.size ELSE used END
FROM (SELECT *, {fits} AS fits FROM (SELECT set_id, step, gone, picked, cov, used, arg_max(struct_pack(sent_no := sent_no, own := own, size := {size}), struct_pack(v := round({value}, 9), k := -sent_no)) AS b
FROM (SELECT it.set_id, step, gone, picked, cov, used, c.sent_no::INTEGER AS sent_no, c.own, c.n, c.chars, c.total, c.q, m {extra} FROM it JOIN cand c ON c.set_id = it.set_id AND NOT list_contains(gone, c.sent_no::INTEGER) {room} JOIN every ON every.set_id = it.set_id {join} GROUP BY ALL) GROUP BY ALL))),
last AS (SELECT set_id, arg_max(picked, step) AS picked FROM it GROUP BY set_id), picks AS (SELECT set_id, unnest(picked) AS sent_no, generate_subscripts(picked, 1)::INTEGER AS pick FROM last)"""


_COVER = _greedy("q + CASE WHEN len(picked) = 0 THEN 0 ELSE 2.0 * len(list_distinct(list_concat(cov, own))) / m END", "used + b.size <= 200")
_NEW = "len(list_filter(own, lambda t: NOT list_contains(cov, t)))"


@query(f"WITH RECURSIVE {_SCORES}, {_COVER} SELECT set_id, sent_no, pick, sentence FROM picks JOIN cand USING (set_id, sent_no)")
def mmr_summary(spark, d):
    """Coverage summaries of every set, words scored by tf-idf within the collection of sets."""
    return summarize.coverage(C._sents(spark, d))


@query(f"WITH RECURSIVE {_SCORES}, {_greedy(f'(total + 0.5 * {_NEW}) / chars ** 0.5', 'used + b.size <= 600', size='chars')} SELECT set_id, sent_no, pick FROM picks")
def novelty_picks(spark, d):
    """Sentences by score and new words over the root of their length, within 600 characters."""
    s = C._sents(spark, d).where(F.size("tokens") > 0)
    return select.select_sets(s, summarize.set_tfidf(s), "novelty", 600)


@query(f"WITH RECURSIVE {_SCORES}, {_greedy(f'(total + 40 * {_NEW}) / chars ** 0.1', most=3)} SELECT set_id, sent_no, pick FROM picks")
def novelty_three(spark, d):
    """Three sentences a set, new words counting 40."""
    s = C._sents(spark, d).where(F.size("tokens") > 0)
    return select.select_sets(s, summarize.set_tfidf(s), "novelty_count", 3)


@query()
def varied_picks(spark, d):
    """Sentences by score less the longest-common-subsequence share with a pick, 100 tokens a set."""
    s = C._sents(spark, d).where(F.size("tokens") > 0)
    return select.select_sets(s, summarize.set_tfidf(s), "varied", 100)


def _sent_scores(spark, d):
    """Sentences with the sum of the scores of their distinct words."""
    s = C._sents(spark, d).where(F.size("tokens") > 0)
    words = s.select("set_id", "sent_no", F.explode(F.array_distinct("tokens")).alias("phrase"))
    return s, words.join(summarize.set_tfidf(s), ["set_id", "phrase"]).groupBy("set_id", "sent_no").agg(F.sum("score").alias("score"))


_SIM = """tw AS (SELECT set_id, sent_no, n, unnest(own) AS token FROM cand),
sim AS MATERIALIZED (SELECT set_id, i, j, common / (ln(ni) + ln(nj)) * sj AS sim FROM (SELECT a.set_id, a.sent_no AS i, b.sent_no AS j, count(*) AS common, any_value(a.n) AS ni, any_value(b.n) AS nj FROM tw a JOIN tw b ON a.set_id = b.set_id AND a.token = b.token AND a.sent_no <> b.sent_no GROUP BY ALL) JOIN (SELECT set_id, sent_no AS j, round(total, 9) AS sj FROM cand) USING (set_id, j) WHERE ni > 1 OR nj > 1)"""


@query(f"WITH RECURSIVE {_SCORES}, {_SIM}, {_greedy('(round(total, 9) - 0.5 * less) / chars ** 0.4', 'used + b.size < 600', size='chars', less=True)} SELECT set_id, sent_no, pick FROM picks")
def spread_picks(spark, d):
    """Marginal relevance: score less half of what a pick says alike, strictly below 600 characters."""
    s, scores = _sent_scores(spark, d)
    return select.select_scored(s, scores, "spread", 600)


@query(f"WITH RECURSIVE {_SCORES}, {_greedy('round(total, 9) + 100.0 * len(list_distinct(list_concat(cov, own))) / m', most=3)} SELECT set_id, sent_no, pick FROM picks")
def share_three(spark, d):
    """Three sentences a set by score and the share of the set's words they cover."""
    s, scores = _sent_scores(spark, d)
    return select.select_scored(s, scores, "share", 3, s.select("set_id", F.explode("tokens").alias("phrase")))


@query(f"WITH RECURSIVE {_SCORES}, {_greedy('total', 'used + b.size <= 60')} SELECT set_id, sent_no, pick FROM picks")
def first_fit_picks(spark, d):
    """Sentences by falling score, whatever fits into 60 tokens."""
    s, scores = _sent_scores(spark, d)
    return select.select_scored(s, scores, "first_fit", 60)


_TR = f"{S.EDGE}, {C._WALK.format(e='e')}, walked AS (SELECT set_id, node::INTEGER AS sent_no, round(s, 9) AS s FROM it WHERE r = 20)"
_TR_CAND = """cand AS MATERIALIZED (SELECT s.set_id, s.sent_no, len(tokens) AS n, 1 AS chars, list_distinct(tokens) AS own, coalesce(w.s, 0)::DOUBLE AS total, 0 AS q FROM sents s LEFT JOIN walked w ON w.set_id = s.set_id AND w.sent_no = s.sent_no WHERE len(tokens) > 0), every AS MATERIALIZED (SELECT DISTINCT set_id, 1 AS m FROM cand)"""


@query(f"WITH RECURSIVE {_TR}, {_TR_CAND}, {_SIM}, {_greedy('total - 0.5 * less', most=3, less=True).replace('it AS (', 'gr AS (', 1).replace('FROM it ', 'FROM gr it ').replace('FROM it)', 'FROM gr)')} SELECT set_id, sent_no, pick FROM picks")
def textrank_three(spark, d):
    """Sentence TextRank, then three sentences a set by marginal relevance."""
    s = C._sents(spark, d).where(F.size("tokens") > 0)
    scores = rank.textrank_sets(sentence.overlap_edges(s), rounds=20)
    return select.select_scored(s, scores.select("set_id", F.col("node").alias("sent_no"), "score"), "spread_count", 3)


_LEX = f"""{S.SENTS}, lx AS (SELECT set_id, sent_no, tokens FROM sents WHERE len(tokens) > 0), ln_ AS (SELECT set_id, count(*) AS n FROM lx GROUP BY set_id),
ltf AS (SELECT set_id, sent_no, token, count(*) AS tf FROM (SELECT set_id, sent_no, unnest(tokens) AS token FROM lx) GROUP BY ALL),
ldf AS (SELECT set_id, token, ln(any_value(n) / count(*)::DOUBLE) + 1 AS idf FROM ltf JOIN ln_ USING (set_id) GROUP BY ALL),
lw AS (SELECT set_id, sent_no, token, tf * idf AS w, sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY set_id, sent_no)) AS len FROM ltf JOIN ldf USING (set_id, token)),
le AS (SELECT a.set_id, a.sent_no AS src, b.sent_no AS dst, 1.0::DOUBLE AS w FROM lw a JOIN lw b ON a.set_id = b.set_id AND a.token = b.token AND a.sent_no <> b.sent_no GROUP BY ALL HAVING round(sum(a.w / a.len * b.w / b.len), 9) >= 0.1)"""


@query(f"WITH RECURSIVE {_LEX}, {C._WALK.format(e='le')} SELECT lx.set_id, lx.sent_no, round(coalesce(s, 0.15), 6) AS score FROM lx LEFT JOIN it ON it.set_id = lx.set_id AND it.node = lx.sent_no AND r = 20")
def lexrank_scores(spark, d):
    """Walk scores over the graph of sentences with a tf-idf cosine of a tenth or more."""
    return sentence.lexrank(C._sents(spark, d), rounds=20).select("set_id", "sent_no", r6("score"))


@query()
def lexrank_summary(spark, d):
    """Sentences by that score; the first that doesn't fit into 200 tokens ends the summary."""
    s = C._sents(spark, d).where(F.size("tokens") > 0)
    return select.select_scored(s, sentence.lexrank(s), "first_stop", 200)


# graphs of sets -------------------------------------------------------------------------


@query()
def phrase_cores(spark, d):
    """Weighted core numbers of every set's word graph."""
    return rank.cores_sets(C._phrase_edges(spark, d).where("src < dst")).select("set_id", "node", r6("score"))


@query()
def core_rank(spark, d):
    """Sum of the neighbours' core numbers."""
    e = cut(C._phrase_edges(spark, d).where("src < dst"), "edges")
    return rank.core_rank(e, cut(rank.cores_sets(e), "cores")).select("set_id", "node", r6("score"))


@query(f"WITH {_SETS}, g AS (SELECT set_id, tokens[i] AS a, unnest(tokens[i : i + 4]) AS b FROM (SELECT *, generate_subscripts(tokens, 1) AS i FROM own)) SELECT set_id, a, b, count(*) AS n, 1 AS held FROM g GROUP BY ALL")
def term_graph(spark, d):
    """Word pairs 0 to 4 places apart over whole texts, counted and as 1."""
    p = cooc.window_pairs(_docs(spark, d), "set_id", F.col("tokens"), 4, 0)
    return p.groupBy(F.col("key").alias("set_id"), "a", "b").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("held"))


_DEG = f"{S.SENTS}, {C._PE}, once AS (SELECT DISTINCT set_id, least(src, dst) AS a, greatest(src, dst) AS b FROM pe WHERE src <> dst), deg AS (SELECT set_id, node, count(*)::DOUBLE AS score FROM (SELECT set_id, a AS node FROM once UNION ALL SELECT set_id, b FROM once) GROUP BY ALL)"


@query(f"WITH {_DEG}, lv AS (SELECT DISTINCT set_id, score AS core FROM deg), v AS (SELECT set_id, core, count(*) AS nodes FROM lv JOIN deg USING (set_id) WHERE score >= core GROUP BY ALL), lo AS (SELECT o.set_id, least(x.score, y.score) AS c FROM once o JOIN deg x ON x.set_id = o.set_id AND x.node = a JOIN deg y ON y.set_id = o.set_id AND y.node = b), e AS (SELECT set_id, core, count(*) AS edges FROM lv JOIN lo USING (set_id) WHERE c >= core GROUP BY ALL) SELECT set_id, core, nodes, coalesce(edges, 0) AS edges, round(CASE WHEN nodes > 1 THEN coalesce(edges, 0) / (nodes * (nodes - 1)) END, 6) AS density FROM v LEFT JOIN e USING (set_id, core)")
def level_density(spark, d):
    """Density of the subgraph above every level, levels being numbers of neighbours."""
    e = cut(C._phrase_edges(spark, d).where("src < dst"), "edges")
    ends = e.select("set_id", F.col("src").alias("node")).unionByName(e.select("set_id", F.col("dst").alias("node")))
    deg = cut(ends.groupBy("set_id", "node").agg(F.count(F.lit(1)).cast("double").alias("score")), "degrees")
    return rank.density(e, deg).select("set_id", "core", "nodes", "edges", r6("density"))


_PN = f"{S.SENTS}, {C._PE}, pt AS (SELECT set_id, phrase, count(*) AS tf FROM (SELECT set_id, unnest(tokens) AS phrase FROM sents) GROUP BY ALL), np AS MATERIALIZED (SELECT set_id, src, dst, w / sum(w) OVER (PARTITION BY set_id, src) AS p FROM pe WHERE src <> dst), pn AS MATERIALIZED (SELECT DISTINCT set_id, src AS node FROM pe)"


def _own_tf(spark, d):
    return C._sents(spark, d).select("set_id", F.explode("tokens").alias("node")).groupBy("set_id", "node").agg(F.count(F.lit(1)).cast("double").alias("weight"))


@query(f"WITH RECURSIVE {_PN}, x0 AS (SELECT pn.set_id, node, tf::DOUBLE AS x FROM pn JOIN pt ON pt.set_id = pn.set_id AND phrase = node WHERE tf > 2), {_neumann('sr', 'np', 'x0', 8)} SELECT pn.set_id, pn.node, round(coalesce(s, 0), 6) AS score FROM pn LEFT JOIN sr ON sr.set_id = pn.set_id AND sr.node = pn.node")
def seed_walk(spark, d):
    """Seed walk from the words that stand three times or more, eight terms."""
    return rank.seed_rank_sets(C._phrase_edges(spark, d), _own_tf(spark, d).where("weight > 2"), terms=8).select("set_id", "node", r6("score"))


@query(f"""WITH RECURSIVE {_PN}, y AS MATERIALIZED (SELECT pn.set_id, node, tf / sum(tf) OVER (PARTITION BY pn.set_id) AS y FROM pn JOIN pt ON pt.set_id = pn.set_id AND phrase = node),
it AS (SELECT 0 AS r, set_id, node, y AS s, y FROM y UNION ALL SELECT any_value(r) + 1, set_id, node, 0.7 * sum(x) + 0.3 * max(y), max(y) FROM (SELECT it.r, it.set_id, np.dst AS node, np.p * it.s AS x, 0 AS y FROM it JOIN np ON np.set_id = it.set_id AND np.src = it.node WHERE it.r < 10 UNION ALL SELECT it.r, it.set_id, it.node, 0, it.y FROM it WHERE it.r < 10) GROUP BY set_id, node)
SELECT set_id, node, round(s, 6) AS score FROM it WHERE r = 10""")
def manifold_walk(spark, d):
    """Walk that returns to the words' own frequencies, ten rounds."""
    return rank.manifold_sets(C._phrase_edges(spark, d), _own_tf(spark, d), rounds=10).select("set_id", "node", r6("score"))
