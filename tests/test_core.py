"""Small cases with hand-computed values."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicube.functions import text as T, vector as V
from lexicube.functions.porter import stem
from lexicube.operators import assign, cooc, cube, distinct, evalm, hier, hin, index, rank, select, sentence
from lexicube.operators.common import current_rows, join_stats, running, sample_k
from lexicube.session import shared_folder
from lexicube.sources import readers
from lexicube.sources.grammar import RecordGrammar
from lexicube.sources.lines import parse_files, parse_lines, recover

DOCS = [(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "c", 1), (3, "a", 1), (3, "d", 2), (4, "b", 3), (5, "e", 1), (5, "a", 1)]
CELLS = [("t", 1), ("t", 2), ("s1", 3), ("s1", 4), ("s2", 5)]
X, Y, Z, W = "x", "y", "z", "w"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_current_rows_hot_key_ties_nulls(spark):
    t = lambda m: dt.datetime(2020, 1, 1, 0, m)
    data = [(1, "a", t(i)) for i in range(50)] + [(1, "b", t(55)), (1, "b", t(55)), (2, "x", None), (None, "y", t(1))]
    got = rows(current_rows(spark.createDataFrame(data, "k int, v string, at timestamp"), ["k"], "at"), "k", "v")
    assert got == [(1, "b"), (2, "x")]
    assert current_rows(spark.createDataFrame([], "k int, at timestamp"), ["k"], "at").count() == 0


def test_join_stats_hot_and_cold(spark):
    r = spark.createDataFrame([("h", i) for i in range(3000)] + [(f"k{i}", i) for i in range(2000)], "k string, i int")
    s = r.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert join_stats(r, s, ["k"], "n", 5000).count() == 5000
    assert join_stats(r, s.where("k <> 'k1'"), ["k"], "n", 5000, "left_semi").count() == 4999


def test_cell_score_fixture(spark):
    tf = spark.createDataFrame(DOCS, "doc_id long, phrase string, tf long")
    cells = spark.createDataFrame(CELLS, "cell string, doc_id long")
    got = {(r.cell, r.phrase): r for r in cube.cell_scores(tf, cells, "A").collect()}
    assert got["t", "a"].score == pytest.approx(1.338806, abs=1e-6) and got["t", "a"].distinct == pytest.approx(0.669403, abs=1e-6)
    assert got["t", "b"].score == pytest.approx(0.064474, abs=1e-6) and got["t", "c"].score == pytest.approx(0.672157, abs=1e-6)
    assert {r.phrase: r.score for r in cube.cell_scores(tf, cells, "E").where("cell = 't'").collect()}["a"] == pytest.approx(2)
    rel = {(r.cell, r.phrase): r.rel for r in cube.relevance(cube.cell_counts(tf, cells)).collect()}
    assert rel["s1", "b"] == pytest.approx(4.468750) and rel["s2", "a"] == pytest.approx(3.516393, abs=1e-6)


def test_cooccurrence_fixture(spark):
    d = spark.createDataFrame([(1, ["x", "y", "x", "z", "w"])], "id long, t array<string>")
    p = cooc.window_pairs(d, "id", F.col("t"))
    full = {(a, b): n for a, b, n in rows(cooc.window_counts(p), "a", "b", "n")}
    assert full[X, X] == 2 and full[X, Y] == 2 and full[Y, Z] == 1 and (Y, Y) not in full
    once = {(a, b): n for a, b, n in rows(cooc.document_counts(p), "a", "b", "n")}
    assert once[X, X] == 2 and once[X, Y] == once[Z, W] == 1
    norm = cooc.row_normalised(cooc.window_counts(p)).groupBy("a").agg(F.round(F.sum("p"), 9).alias("s"))
    assert {r.s for r in norm.collect()} == {1.0}


def test_walks_and_cores(spark):
    names = [X, Y, Z, W]
    m = [[2, 2, 2, 2], [2, 0, 1, 1], [2, 1, 0, 1], [2, 1, 1, 0]]
    e = [(1, names[i], names[j], float(m[i][j])) for i in range(4) for j in range(4) if m[i][j]]
    got = {r.node: r.score for r in rank.textrank_sets(spark.createDataFrame(e, "set_id long, src string, dst string, w double")).collect()}
    assert got[X] == pytest.approx(1.298246, abs=5e-4) and got[Z] == pytest.approx(0.900585, abs=5e-4)
    a, b, w = (np.array(v) for v in zip(*[(i, j, m[i][j]) for i in range(4) for j in range(4)]))
    s = rank.seed_rank(a, b, w.astype(float), np.array([0, 1.0, 0, 0]))
    assert s == pytest.approx([0.298246, 0.316392, 0.192681, 0.192681], abs=1e-6)
    seq = "p q p q r p".split()
    core = rank.cores_sets(spark.createDataFrame([(1, seq[i], seq[i + 1], 1.0) for i in range(5)], "set_id long, src string, dst string, w double"))
    assert {r.node: r.score for r in core.collect()} == {"p": 3, "q": 3, "r": 2}


def test_pagerank_large_sums_to_one(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "a", 2.0)], "src string, dst string, w double")
    assert rank.pagerank_large(e, rounds=7).agg(F.sum("score")).first()[0] == pytest.approx(1)


def test_coverage_selection_fixture(spark):
    toks = [s.split() for s in ("a b x", "a a b c", "c d", "e f g h i")]
    assert select.coverage_summary(toks, {"a": 3, "b": 2, "c": 1, "d": 0.5}, 6) == [0, 2]
    s = spark.createDataFrame([(1, i, t) for i, t in enumerate(toks)] + [(2, 0, [])], "set_id long, sent_no int, tokens array<string>")
    sc = spark.createDataFrame([(1, p, v) for p, v in (("a", 3.0), ("b", 2.0), ("c", 1.0), ("d", 0.5))] + [(1, None, 1.0)], "set_id long, phrase string, score double")
    assert rows(select.select_sets(s, sc, "coverage", 6), "set_id", "sent_no", "pick") == [(1, 0, 1), (1, 2, 2)]
    assert select.first_fit([3, 9, 2], np.array([1, 5, 2.0]), 6) == [2, 0] and select.first_fit([3, 9, 2], np.array([1, 5, 2.0]), 6, True) == []
    assert len(select.novelty_summary(toks, {"a": 1.0}, count=2)) == 2
    assert select.share_summary(toks, np.zeros(4), {"a", "c", "d"}, 2) == [1, 2]
    assert select.spread_summary(toks, np.array([1, 1, 1, 1.0]), np.eye(4), 9)[0] == 2
    assert select.diverse_phrases(np.array([1.0, 0.9, 0.1]), np.eye(3), 1.0, 2) == [0, 1]


def test_text_functions(spark):
    d = spark.createDataFrame([("Cat", "bat"), ("kitten", "sitting"), ("golf", "gulf"), ("", "x")], "a string, b string")
    assert [r[0] for r in d.select(T.tail_levenshtein(F.col("a"), F.col("b"))).collect()] == [0, 2, 1, None]
    w = spark.createDataFrame([(x,) for x in ("Apple", "Zoo", "apple", "zoo", "9x", "Bird", "yes")], "w string")
    assert [r.w for r in w.where(T.is_eng(F.col("w"))).collect()] == ["Bird", "yes"]
    c = spark.createDataFrame([(" Née__Un \n STUDY ;",), (None,), ("  ",)], "p string")
    assert [r[0] for r in c.select(T.canonical_phrase(F.col("p"))).collect()] == ["née un study ;", None, ""]
    assert spark.range(1).select(T.tokens(F.lit("The Cat's (big) hat -- "), ["the"])).first()[0] == ["cat", "big", "hat"]
    assert spark.range(1).select(T.phrase_spans(F.lit("a <phrase>New York</phrase> b"))).first()[0] == ["new_york"]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.5, 0.5]), (4, None)], "doc_id long, vec array<double>")
    labels = spark.createDataFrame([("A", [1.0, 0.1]), ("B", [0.2, 1.0])], "label string, label_vec array<double>")
    got = [(r.doc_id, r.label, round(r.margin, 6)) for r in assign.soft_assign(v, labels).orderBy("doc_id").collect()]
    assert got == [(1, "A", 0.8), (2, "B", 0.24), (3, "B", 0.05)]
    z = spark.createDataFrame([([0.0, 0.0], [float("nan"), 1.0])], "a array<double>, b array<double>")
    assert z.select(V.cosine(F.col("a"), F.col("a")), V.usable(F.col("a"), 2), V.usable(F.col("b"), 2)).first() == (None, False, False)
    tree = spark.createDataFrame([("root", "news"), ("root", "art"), ("news", "law"), ("news", "golf")], "parent string, child string")
    votes = spark.createDataFrame([(1, "law", 8), (1, "art", 2), (2, "law", 1), (2, "art", 1)], "set_id int, label string, votes int")
    assert rows(assign.descend(votes, tree, "root"), "set_id", "node") == [(1, "law"), (2, "root")]


def test_evaluation(spark):
    r = spark.createDataFrame([("g", 0.9, 1), ("g", 0.8, 0), ("g", 0.7, 1), ("g", 0.6, 0)], "g string, score double, relevant int")
    assert evalm.average_precision(r, "g").first().ap == pytest.approx(0.833333, abs=1e-6)
    d = spark.createDataFrame([("g", 0, None), ("g", 1, 2.0), ("g", 2, 1.0)], "g string, position int, gain double")
    assert evalm.dcg(d, "g").first().dcg == pytest.approx(2.541826, abs=1e-6)
    assert evalm.fragments("the cat sat . on mat".split(), "a cat sat on mat . on mat".split()) == [["cat", "sat"], ["on", "mat"]]
    p = spark.createDataFrame([(1, "a b c d".split(), "a x c d".split()), (2, [], ["a"])], "id long, cand array<string>, ref array<string>")
    assert rows(evalm.rouge_l(p), "id", "precision") == [(1, 0.75), (2, None)]
    pos = evalm.positions(r, "g", F.col("score").desc())
    assert rows(pos, "score", "position") == [(0.6, 3), (0.7, 2), (0.8, 1), (0.9, 0)] and evalm.average_precision(r.limit(0), "g").count() == 0
    assert sentence.rouge_n(p, 2).where("id = 1").first().f1 == pytest.approx(1 / 3)


def test_hierarchy_and_network(spark):
    links = spark.createDataFrame([("b", "a", "r1", 2), ("c", "a", "r2", 2), ("d", "b", "r3", 1), ("d", "c", "r3", 1)], "child string, parent string, relation string, level int")
    assert {r.path for r in hier.paths(links).collect()} == {"r1", "r2", "r1/r3", "r2/r3"}
    n = spark.createDataFrame([("d", 5)], "node string, n long")
    assert rows(hier.roll_up(links, n, 2).where("level = 2"), "node", "total") == [("a", 10)]
    assert rows(hier.follow(links, "a", ["r1", "r3"]), "node") == [("d",)]
    loop = links.unionByName(spark.createDataFrame([("b", "d", "r4", 1)], links.schema))
    with pytest.raises(ValueError, match="cycle"):
        hier.paths(loop)
    chain = spark.createDataFrame([(str(i + 1), str(i), "r") for i in range(9)], "child string, parent string, relation string")
    assert hier.paths(chain).agg(F.max("length")).first()[0] == 9 and hier.closure(chain).count() == 45 and hier.paths(chain.limit(0)).count() == 0
    e = spark.createDataFrame([("D", "1", "P", "x", 1.0, "dp"), ("D", "2", "P", "y", 2.0, "dp"), ("D", None, "P", "y", 2.0, "dp")], "src_type string, src string, dst_type string, dst string, weight double, edge_type string")
    assert rows(hin.node_ids(e), "type", "key", "local_id", "node_id") == [("D", "1", 0, 0), ("D", "2", 1, 1), ("P", "x", 0, 2), ("P", "y", 1, 3)]


def test_distinct_and_index(spark):
    tf = spark.createDataFrame([(1, "a", 2), (2, "b", 1)], "doc_id long, phrase string, tf long")
    sc = spark.createDataFrame([(1, "L", 1.0), (1, "M", 1.0)], "doc_id long, label string, score double")
    got = {r.phrase: r.kl for r in distinct.distinct_map(tf, sc).collect()}
    assert got["a"] == pytest.approx(0) and got["b"] == 0
    assert distinct.distinct_map(tf, sc, soft=False).where("phrase = 'a'").first().kl == pytest.approx(np.log(2))
    assert index.idf(tf.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "id long, text string")
    words = spark.createDataFrame([("a", 1)], "phrase string, id long")
    assert rows(index.encode(docs, "id", T.tokens(F.col("text")), words), "doc_id", "n_oov") == [(1, 1), (2, 0)]
    assert sample_k(spark.range(100).withColumn("g", F.lit(1)), ["g"], "id", 7).count() == 7


GOOD = "7 " + " ".join(["0.5"] * 100)


@pytest.mark.parametrize(
    "line,reason",
    [
        (GOOD, None), ("400 100", "header"), ("\t" + GOOD.replace(" 0.5", " \r .5e1", 1), None), (GOOD.replace("0.5", '"0.5"', 3), None), ('"7" ' + GOOD[2:], None),
        (GOOD.replace("0.5", "0.5\x00", 1), "encoding"), (GOOD + "�", "encoding"), (GOOD.replace("0.5", '"0.5', 1), "quoting"), (GOOD.replace("0.5", '0"5', 1), "quoting"),
        (GOOD + " 1", "field_count"), ("", "field_count"), (None, "field_count"), (GOOD.replace("7 ", "-7 ", 1), "doc_id"), (GOOD.replace("7 ", "9223372036854775808 ", 1), "doc_id"),
        (GOOD.replace("7 ", "9223372036854775807 ", 1), None), (GOOD.replace("0.5", "nan", 1), "value"), (GOOD.replace("0.5", "1e39", 1), "value"), (GOOD.replace("0.5", ".", 1), "value"), (GOOD.replace("0.5", "1_0", 1), "value"), (GOOD.replace("0.5", "5.", 1), None), (GOOD.replace("7 ", "７ ", 1), "doc_id"),
    ],
)
def test_line_grammar(line, reason):
    out = RecordGrammar().line(line)
    assert (out.reason or (None if out.kind == "record" else out.kind)) == reason


def test_grammar_recovers_after_open_quote(spark, tmp_path):
    g = RecordGrammar(2)
    text = '3 2\n1 0.5 0.5\n2 "0.5 0.25\nlost text\n3 0.1 0.2\n4 x 1\n'
    got = [(o.kind, o.key, o.reason) for o in g.file(text)]
    assert got == [("header", None, None), ("record", 1, None), ("error", None, "quoting"), ("error", None, "quoting"), ("record", 3, None), ("error", None, "value")]
    (tmp_path / "e.txt").write_text(text)
    assert parse_files(spark, str(tmp_path / "e.txt"), 2).where("kind = 'record'").count() == 2


def test_parse_lines_extra_columns_and_empty(spark):
    d = spark.createDataFrame([(1, GOOD, "x"), (2, None, "y")], "line_id long, raw_line string, reason string")
    assert rows(parse_lines(d), "line_id", "kind", "reason") == [(1, "record", None), (2, "error", "field_count")]
    assert parse_lines(d.limit(0)).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1\ta;b;a\n2\t\n")
    assert rows(readers.phrase_list(spark, str(tmp_path / "p.txt")), "doc_id", "phrases") == [(1, ["a", "b", "a"]), (2, [])]
    (tmp_path / "e.vec").write_text("2 2\nnew york 1 2\nx 1 2\n")
    assert rows(readers.keyed_embeddings(spark, str(tmp_path / "e.vec"), 2), "key") == [("x",)]
    sets = spark.createDataFrame([(1, 'b"bad story_separator_special_tag two"')], "i long, t string")
    assert rows(readers.document_sets(sets, "i", "t"), "doc_no", "text") == [(0, "bad"), (1, "two")]
    (tmp_path / "a.json").write_text('{"id":1,"token":["New","York","is","big"],"pos":["NNP","NNP","VBZ","JJ"],"ner":[["x"]]}\n{"id":2,"token":["New","York","is","big"],"pos":["NNP","NNP","VBZ","JJ"],"ner":[{"text":"New York","start":0,"end":2,"type":"GPE"}]}\n')
    got = rows(readers.annotated_terms(readers.annotated_json(spark, str(tmp_path / "a.json")).where("id = 2")), "term")
    assert got == [("big",), ("is",), ("new_york",)]
    (tmp_path / "n.xml").write_text("<d><title>T</title><abstract><p>A</p></abstract><block class='full_text'><p>one</p><p>two</p></block></d>")
    assert rows(readers.news_xml(spark, str(tmp_path / "n.xml"), 3), "title", "text") == [("T", "one two")]


def test_density_peak_against_plain_python(spark):
    toks = ["a b c".split(), "a b d".split(), "x y".split(), "c d e f".split()]
    s = spark.createDataFrame([(1, i, t) for i, t in enumerate(toks)], "set_id long, sent_no int, tokens array<string>")
    got = {r.sent_no: r for r in sentence.density_peak(s).collect()}
    cos = [[len(set(a) & set(b)) / np.sqrt(len(set(a)) * len(set(b))) for b in toks] for a in toks]
    rep = [sum(cos[i][j] > 0.22 for j in range(4) if j != i) / 4 for i in range(4)]
    for i in range(4):
        up = [cos[i][j] for j in range(4) if rep[j] > rep[i]]
        div = 1 - max(up) if up else 1 - min(cos[i][j] for j in range(4) if j != i)
        assert got[i].repr == pytest.approx(rep[i]) and got[i].div == pytest.approx(div)


def test_contrast_prefers_own_phrases(spark):
    sch = "set_id long, tokens array<string>"
    own = spark.createDataFrame([(1, ["own", "seed"]), (1, ["own", "both"]), (2, []), (None, ["x", "y"])], sch)
    back = spark.createDataFrame([(1, ["both", "seed"]), (1, ["both", "far"]), (9, ["q", "r"])], sch)
    got = rank.contrast(own, back, spark.createDataFrame([(1, "seed")], "set_id long, node string"), 2, 3)
    assert got.orderBy(F.desc("score")).first().node == "own" and {r.set_id for r in got.collect()} == {1}
    a, b, w = rank.window_graph([[0, 1, 0, 2, 3]], 4, True)
    assert {(i, j): n for i, j, n in zip(a.tolist(), b.tolist(), w.tolist())}[0, 1] == 1 and len(w) == 13
    assert rank.contrast(own.limit(0), back, spark.createDataFrame([], "set_id long, node string")).count() == 0


def test_prepared_walks_and_contrast_equal_the_series(spark):
    """Walks solved for equal the series; rounds that come back to a start aren't walked again."""
    rnd = np.random.default_rng(2)
    docs = [rnd.integers(0, 40, 30).tolist() for _ in range(8)] + [[41, 41, 42], [43]]
    for once in (True, False):
        g = rank.window_graph(docs, 4, once)
        for terms in (6, 200):
            walk = rank.prepared_walk(*g, 50, terms=terms)
            for _ in range(3):
                x = (rnd.random(50) < 0.3) * 1.85
                assert np.allclose(walk(x), rank.seed_rank(*g, x, terms=terms), rtol=0, atol=1e-12)
    none = np.zeros(0, np.int64)
    assert (rank.prepared_walk(none, none, np.zeros(0), 3)(np.ones(3)) == 1 - 0.85).all()
    words = [[f"w{i}" for i in d] for d in docs]
    own, back = spark.createDataFrame([(1, d) for d in words[:3]], "set_id long, tokens array<string>"), spark.createDataFrame([(1, d) for d in words[3:]], "set_id long, tokens array<string>")
    got = {r.node: r.score for r in rank.contrast(own, back, spark.createDataFrame([(1, "w1"), (1, "w2")], "set_id long, node string"), 5, 10).collect()}
    nodes = sorted({w for d in words for w in d})
    number = lambda ds: [[nodes.index(w) for w in d] for d in ds]
    t, b = rank.window_graph(number(words[:3]), 4, True), rank.window_graph(number(words[3:]), 4, False)
    seed, mine, picked = np.isin(nodes, ["w1", "w2"]).astype(float), np.isin(nodes, sum(words[:3], [])), []
    for _ in range(10):
        x = seed.copy()
        x[picked] += 0.85
        lead = np.round(rank.seed_rank(*t, x) - rank.seed_rank(*b, x), 9)
        picked = sorted(np.flatnonzero(mine & (lead > np.round(lead.mean(), 9))), key=lambda i: (-lead[i], i))[:5]
    assert got == {nodes[i]: pytest.approx(lead[i], abs=1e-9) for i in picked}


def test_set_scores_equal_cell_scores(spark):
    """The fixture of cell scores with the target as a set and the others as siblings."""
    docs = spark.createDataFrame([("t", 1, ["a", "a", "b"]), ("t", 2, ["a", "c"]), (None, 3, ["a"])], "set_id string, doc_no int, tokens array<string>")
    tf = spark.createDataFrame(DOCS, "doc_id long, phrase string, tf long")
    sib = cube.cell_counts(tf, spark.createDataFrame([c for c in CELLS if c[0] != "t"], "cell string, doc_id long"))
    got = {r.phrase: r.score for r in cube.set_scores(docs, sib).collect()}
    assert got == {"a": pytest.approx(1.338806, abs=1e-6), "b": pytest.approx(0.064474, abs=1e-6), "c": pytest.approx(0.672157, abs=1e-6)}
    cat = spark.createDataFrame([("t", "s1")], "set_id string, cell string")
    assert cube.set_scores(docs, sib, cat).count() == 3 and cube.set_scores(docs, sib, cat.limit(0), twin=True).count() == 0
    assert cube.set_scores(docs.limit(0), sib, cat).count() == 0 and cube.set_scores(docs, sib.limit(0)).count() == 3


def test_running_sums_hot_nulls_empty(spark):
    data = [("h", i, 1) for i in range(500)] + [(None, 5, 2), (None, 6, None), ("x", 1, 7)]
    d = spark.createDataFrame(data, "g string, i int, v int")
    got = {(r.g, r.i): r.s for r in running(d, ["g"], [F.col("i")], {"s": F.col("v")}).collect()}
    assert got["h", 0] == 1 and got["h", 499] == 500 and got[None, 6] == 2 and got["x", 1] == 7
    most = {(r.g, r.i): r.s for r in running(d, ["g"], [F.col("i")], {"s": F.when(F.col("i") % 100 == 7, F.col("i"))}, "max").collect()}
    assert most["h", 6] is None and most["h", 7] == 7 and most["h", 306] == 207 and most["h", 499] == 407
    assert running(d.limit(0), ["g"], [F.col("i")], {"s": F.col("v")}).count() == 0


def test_sparse_nearest_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    q = [(s, f"w{w}", float(rnd.random())) for s in range(7) for w in sorted(set(rnd.integers(0, 30, 8)))]
    r = [(d, f"w{w}", float(rnd.random())) for d in range(40) for w in sorted(set(rnd.integers(0, 30, 6)))] + [(99, "none", 1.0), (None, "w1", 1.0), (98, None, 1.0)]
    want = {}
    for s in range(7):
        dots = {}
        for a, p, v in q:
            for d, p2, w in r:
                if a == s and p == p2 and d is not None:
                    dots[d] = dots.get(d, 0) + v * w
        want[s] = [d for d, _ in sorted(dots.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5]]
    qd, rd = spark.createDataFrame(q, "set_id long, phrase string, v double"), spark.createDataFrame(r, "doc_id long, phrase string, w double")
    got = index.sparse_nearest(qd, rd, 5, 20, 30).toPandas().sort_values(["set_id", "rank"])
    assert {s: g["doc_id"].tolist() for s, g in got.groupby("set_id")} == want
    assert index.sparse_nearest(qd.limit(0), rd).count() == 0 and index.sparse_nearest(qd, rd.limit(0)).count() == 0


@pytest.mark.parametrize("frequent", [0, 20, 400])
def test_products_in_strips_and_matrices(frequent):
    """Phrases by matrices, through lists or both; blocks, strips and ties as brute force has them."""
    rnd = np.random.default_rng(5)

    def vectors(n, m):
        words = [np.unique((400 * rnd.random(m) ** 3).astype(int)) for _ in range(n)]
        v = np.round(rnd.random(sum(map(len, words))), 1) + 0.1  # many ties
        return np.repeat(np.arange(n), [len(w) for w in words]), np.concatenate(words) * 7, v

    (qn, qt, qv), (dn, dt, dw) = vectors(300, 12), vectors(3000, 9)
    a, b = np.zeros((300, 2800)), np.zeros((3000, 2800))
    a[qn, qt], b[dn, dt] = qv, dw
    dots = np.round(a @ b.T, 6)
    order = np.argsort(-dots, axis=1, kind="stable")[:, :10]
    want = [(i, j) for i in range(300) for j in order[i] if dots[i, j] != 0]
    i, j, x = index._best_products(300, qn, qt, qv, 3000, dn, dt, dw, np.arange(frequent) * 7, 10, 64, 256)
    assert list(zip(i, j)) == want and np.abs(x - dots[i, j]).max() < 1e-6


def test_tiles_give_the_same_as_one_block(spark):
    toks = [[f"t{(i * j) % 7}" for j in range(1, 4)] for i in range(9)] + [[]]
    s = spark.createDataFrame([(1, i, sorted(set(t)), [1.0] * len(set(t))) for i, t in enumerate(toks)], "set_id long, sent_no int, tokens array<string>, weights array<double>")
    one, many = (rows(sentence.pair_products(s, b), "i", "j", "dot") for b in (2000, 2))
    assert one == many == sorted((i, j, float(len(set(toks[i]) & set(toks[j])))) for i in range(9) for j in range(9) if i != j and set(toks[i]) & set(toks[j]))
    v = [(i, "L" if i % 3 else "M", [float(i % 5), 1.0, float(i % 2)]) for i in range(30)] + [(77, "L", None), (78, None, [1.0, 1.0, 1.0])]
    pool = spark.createDataFrame(v, "doc_id long, label string, vec array<double>")
    m = pool.where("doc_id < 8").select((F.col("doc_id") % 2).alias("set_id"), "label", "vec").where("label = 'L'")
    a, b = (rows(assign.neighbours(m, pool, 2, t), "set_id", "rank", "doc_id") for t in (4096, 3))
    assert a == b and len(a) > 0 and assign.neighbours(m.limit(0), pool).count() == 0


def test_label_blocks_and_large_sets(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 4), 1.0]) for i in range(20)] + [(50, None), (51, [1.0]), (52, [None, 1.0])], "doc_id long, vec array<double>")
    labels = spark.createDataFrame([(f"l{i}", [float(i), 2.0 - i]) for i in range(7)], "label string, label_vec array<double>")
    one = rows(assign.soft_assign(v, labels), "doc_id", "label", "margin")
    monkeypatch.setattr(assign, "LABEL_BLOCK", 2)
    assert rows(assign.soft_assign(v, labels), "doc_id", "label", "margin") == one and len(one) == 20
    assert assign.soft_assign(v, labels.limit(0)).count() == 0 and assign.label_scores(v, labels).count() == 140
    e = spark.createDataFrame([(s, f"n{i}", f"n{(i * k) % 6}", 1.0 + i) for s in (1, 2) for i in range(6) for k in (2, 5)], "set_id long, src string, dst string, w double")
    near = lambda df: {(r.set_id, r.node): pytest.approx(r.score, abs=1e-9) for r in df.collect()}
    assert {(r.set_id, r.node): r.score for r in rank.textrank_sets(e, 3, most_edges=0).collect()} == near(rank.textrank_sets(e, 3))
    until = {}
    for sid, g in e.toPandas().groupby("set_id"):
        nodes, pos = np.unique(np.concatenate((g["src"].to_numpy(str), g["dst"].to_numpy(str))), return_inverse=True)
        score = rank.textrank(pos[: len(g)], pos[len(g) :], g["w"].to_numpy(), len(nodes), tolerance=0.5)
        until |= {(sid, x): pytest.approx(y, abs=1e-9) for x, y in zip(nodes, score)}
    assert {(r.set_id, r.node): r.score for r in rank._walk_joined(e, 0.85, None, 0.5).collect()} == until


def test_recovery_equals_the_file_rule(spark):
    rnd = np.random.default_rng(5)
    good = lambda i: f"{i} 0.5 {i % 7}"
    kinds = [good, good, lambda i: f'{i} "0.5 1', lambda i: "lost text", lambda i: f"{i} x 1", lambda i: "3 2", lambda i: f'{i} "0.5" 1', lambda i: 'no "anchor\x00', lambda i: ""]
    lines = [kinds[rnd.integers(0, len(kinds))](i) for i in range(300)]
    g, at, starts = RecordGrammar(2), 0, {}
    for i, x in enumerate(lines):
        starts[at] = i
        at += len(x) + 1
    want = {}
    for o in g.file("\n".join(lines)):
        for k in range(o.start, max(o.end, o.start + 1)):
            if k in starts:
                want[starts[k]] = (o.kind if k == o.start and "\n" not in "\n".join(lines)[o.start : o.end] else "error", o.reason)
    d = spark.createDataFrame([("f", i, x, 1) for i, x in enumerate(lines)] + [(None, 0, good(1), 1), ("g", 0, None, 1)], "file_name string, line_id long, raw_line string, kind int")
    got = {r.line_id: (r.kind, r.reason) for r in recover(d, dim=2).where("file_name = 'f'").collect()}
    assert all(got[i][0] == w[0] or got[i][0] == "skipped" for i, w in want.items()) and len(got) == 300
    assert {i for i, x in got.items() if x[0] == "record"} == {i for i, w in want.items() if w[0] == "record"}
    assert recover(d.limit(0)).count() == 0


def test_choice_of_sentences_and_phrases(spark):
    s = spark.createDataFrame([(1, i, t.split()) for i, t in enumerate(("a b c", "a b d", "e f", "g"))] + [(2, 0, None), (None, 0, ["a"])], "set_id long, sent_no int, tokens array<string>")
    sc = spark.createDataFrame([(1, 0, 5.0), (1, 1, 4.9), (1, 2, 4.0)], "set_id long, sent_no int, score double")
    picks = lambda m, b, **k: [r.sent_no for r in select.select_scored(s, sc, m, b, **k).where("set_id = 1").orderBy("pick").collect()]
    assert picks("first_fit", 5) == [0, 2] and picks("first_stop", 5) == [0] and picks("spread_count", 2) == [0, 2]
    assert picks("share", 2, phrases=s.select("set_id", F.explode("tokens").alias("phrase"))) == [0, 2]
    assert select.select_scored(s.limit(0), sc, "first_fit", 5).count() == 0
    p = spark.createDataFrame([(1, "a", 1.0, [1.0, 0.0]), (1, "b", 0.9, [1.0, 0.1]), (1, "c", 0.5, [0.0, 1.0]), (1, "d", 0.1, None)], "set_id long, phrase string, score double, vec array<double>")
    assert [r.phrase for r in select.select_phrases(p, 2).orderBy("pick").collect()][0] == "a"


def test_stems():
    got = [stem(w) for w in ("caresses", "ponies", "cats", "agreed", "plastered", "motoring", "conflated", "hopping", "falling", "happy", "relational", "formalize", "electrical", "adjustment", "controlling", "roll", "is")]
    assert got == ["caress", "poni", "cat", "agre", "plaster", "motor", "conflat", "hop", "fall", "happi", "relat", "formal", "electr", "adjust", "control", "roll", "is"]


def test_cluster_without_a_shared_folder_is_an_error(spark):
    class Context:
        master = "spark://host"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())
