"""Operators against brute force on small inputs with nulls, ties, hot keys and empty tables."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicube import session
from lexicube.llm import hidden_events as he, knn, mcl, mixing, packing, recompress, relevance, repeats, sentences, termcounts, vectors


def at(m):
    return dt.datetime(2020, 1, 1, 0, m)


def test_distinctive_terms(spark):
    recs = {1: "a a b c", 2: "a b", 3: "a d d d", 4: ""}
    data = [(r, t) for r, s in recs.items() for t in s.split()] + [(None, "a"), (5, None), (5, "")]
    got = {(r.rec_id, r.phrase): r for r in relevance.distinctive_terms(spark.createDataFrame(data, "rec_id long, phrase string")).collect()}
    n, avg = 3, 10 / 3
    df = {"a": 3, "b": 2, "c": 1, "d": 1}
    for (r, t), x in got.items():
        tf, dl = recs[r].split().count(t), len(recs[r].split())
        assert x.weight == pytest.approx(math.log(n / df[t]) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))) and x.n_records == 3
    assert relevance.distinctive_terms(spark.createDataFrame([], "rec_id long, phrase string")).count() == 0


def test_term_counts_batches_equal_one_load(spark):
    rnd = random.Random(3)
    log = [(rnd.randint(1, 8), rnd.randint(0, 2), at(i), [(rnd.choice(["x", "y", "z", "", None]), rnd.choice([1, 2, 0, None])) for _ in range(rnd.randint(0, 3))]) for i in range(50)]
    log += log[:5] + [(None, 0, at(1), [("x", 1)]), (9, 0, None, None)]
    df = spark.createDataFrame(log, termcounts.PART)
    cur = {}
    for r, p, t, terms in log:
        if r is not None and t is not None and (cur.get((r, p), (at(0), None))[0] <= t):
            cur[r, p] = (t, terms)
    occ, recs = Counter(), {}
    for (r, _), (_, terms) in cur.items():
        for t, n in terms or []:
            if t and n and n > 0:
                occ[t] += n
                recs.setdefault(t, set()).add(r)
    want = {t: (occ[t], len(recs[t])) for t in occ}
    state = termcounts.replay(df, 0.5)
    assert {r.term: (r.occurrences, r.records) for r in state.counts.collect()} == want
    assert state.n_records == len({r for (r, _), (_, ts) in cur.items() if any(t and n and n > 0 for t, n in ts or [])})
    again = termcounts.TermCounts.open(spark, state.home)
    assert {r.term: (r.occurrences, r.records) for r in again.counts.collect()} == want and again.n_records == state.n_records
    assert termcounts.apply_batch(state, df) == state  # late repeats change nothing
    gone = spark.createDataFrame([(r, p, at(59), None) for r, p in cur], termcounts.PART)
    empty = termcounts.apply_batch(state, gone)
    assert empty.counts.count() == 0 and empty.n_records == 0


def test_term_counts_rewrite_only_touched_buckets(spark):
    log = [(r, 0, at(1), [(f"t{r % 40}", 1)]) for r in range(200)]
    state = termcounts.replay(spark.createDataFrame(log, termcounts.PART), 1.0)
    after = termcounts.apply_batch(state, spark.createDataFrame([(7, 0, at(5), [("t7", 3)])], termcounts.PART))
    for name in ("parts", "counts"):
        moved = [b for b in state.where[name] if state.where[name][b] != after.where[name][b]]
        assert len(moved) == 1 and len(state.where[name]) > 1
    assert {r.term: (r.occurrences, r.records) for r in after.counts.where("term = 't7'").collect()} == {"t7": (7, 5)}


def test_packing_keeps_all_and_fits(spark):
    rnd = random.Random(1)
    sizes = [(i, rnd.randint(1, 60)) for i in range(400)] + [(900, 250), (901, 0), (902, None), (5, 7)]
    got = packing.pack(spark.createDataFrame(sizes, "id long, n int"), "id", "n", 100, rows_per_task=150).selectExpr("cast(bin as string) as bin", "item", "size").toPandas()
    bins = got.dropna(subset=["bin"]).groupby("bin")["size"].sum()
    assert bins.max() <= 100 and bins.sum() == sum(n or 0 for _, n in sizes)
    assert len(bins) <= math.ceil(bins.sum() / 100) * 1.05 + 1
    assert sorted(got[got["item"] == 900]["size"]) == [50, 100, 100] and got[got["bin"].isna()]["item"].tolist() == [901, 902]
    assert packing.pack(spark.createDataFrame([], "id long, n int"), "id", "n").count() == 0


def test_water_fill_and_mix(spark):
    got = mixing.water_fill(100, {"a": 0.5, "b": 0.3, "c": 0.2, "x": 0}, {"a": 20, "b": 1000, "c": 1000})
    assert got == {"a": 20, "b": pytest.approx(48), "c": pytest.approx(32), "x": 0}
    assert sum(mixing.water_fill(100, {"a": 1.0}, {"a": 30}).values()) == 30
    docs = [(i, "Big-one" if i % 3 else " big_one", 10) for i in range(300)] + [(1000 + i, "small", 7) for i in range(20)] + [(5000, None, 5), (5001, "other", None)]
    goals = [("big_one", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2)]
    rows, report = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, n_tokens long"), spark.createDataFrame(goals, "source string, target_share double, max_repeats int"))
    rep = {r.source: r for r in report.collect()}
    assert rep["small"].mixed == 420 and rep["small"].most_repeats == 3 and rep["none"].mixed == 0
    assert abs(rep["big_one"].mixed - (3140 - 420)) <= 10 and set(rep) == {"big_one", "small", "none", "other", None}
    again, _ = mixing.mix(spark.createDataFrame(docs[::-1], "doc_id long, source string, n_tokens long"), spark.createDataFrame(goals, "source string, target_share double, max_repeats int"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))


def brute_spans(docs, width):
    held = {}
    for i, s in docs:
        for k in range(len(s or "") - width + 1):
            held.setdefault(s[k : k + width], set()).add(i)
    out = set()
    for i, s in docs:
        cover = np.zeros(len(s or ""), bool)
        for k in range(len(s or "") - width + 1):
            if len(held[s[k : k + width]]) > 1:
                cover[k : k + width] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], cover.astype(int), [0]))))
        out |= set(zip([i] * (len(edge) // 2), edge[::2].tolist(), edge[1::2].tolist()))
    return out


def test_shared_spans_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    notice, other = word(260), word(230)
    docs = [(i, word(rnd.randint(0, 300)) + (notice if i % 3 == 0 else "") + word(150)) for i in range(30)]
    docs += [(100, None), (101, ""), (102, word(80) + other), (103, other + word(90)), (104, docs[1][1] * 2), (105, docs[1][1] * 2), (106, "ab" * 400), (107, "x" + "ab" * 300 + "y"), (108, "-" * 900), (109, "=" + "-" * 400), (110, "日本語のテキスト😀" * 60), (111, "z" + "日本語のテキスト😀" * 30)]
    got = {tuple(r) for r in repeats.shared_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_spans(docs, 200)
    assert repeats.shared_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_windows_have_the_same_designated_key():
    rng = np.random.default_rng(2)
    for size in (2, 5, 13, 60):
        for _ in range(25):
            w = rng.integers(97, 97 + size, 200)
            found = []
            for before, after in ((150, 90), (61, 200), (0, 0)):
                text = np.concatenate((rng.integers(97, 97 + size, before), w, rng.integers(97, 97 + size, after))).astype(np.uint32)
                key, first, last = recompress.designated(np.append(text, 0).astype(np.uint32), np.array([len(text)]), 200, 64, 6, 8)
                own = [k for k, a, b in zip(key, first, last) if a <= before <= b]
                assert len(own) == 1 and last.max() == len(text) - 200 and (np.diff(np.sort(first)) > 0).all()
                found.append(own[0])
            assert len(set(found)) == 1


def test_shared_spans_with_colliding_hashes(spark):
    """With hashes of eight bits nearly all windows collide; the characters decide."""
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcd ") for _ in range(n))
    notice = word(240)
    docs = [(i, word(120) + (notice if i % 4 == 0 else "") + word(120)) for i in range(16)]
    docs += [(50, "x" + notice[:215] + "y" + notice[-210:]), (51, notice[5:230])]
    got = {tuple(r) for r in repeats.shared_spans(spark.createDataFrame(docs, "doc_id long, text string"), bits=8).collect()}
    assert got == brute_spans(docs, 200)


def planted(n=1500, dim=100, groups=6, seed=4):
    rng = np.random.default_rng(seed)
    c = np.linalg.qr(rng.normal(size=(dim, groups)))[0].T
    own = rng.integers(0, groups + 1, n)
    x = rng.normal(size=(n, dim)) / 10
    for i in range(n):
        if own[i] < groups:
            x[i] = c[own[i]] + rng.normal(size=dim) * 0.11
    return x.astype(np.float32), own


def test_nearest_recall_and_bounds(spark):
    x, _ = planted()
    x[7] = x[8]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(9000, [0.0] * 100), (9001, None), (9002, [float("nan")] * 100), (None, x[0].tolist())], "id long, e array<float>")
    v = vectors.unit_vectors(df, "id", "e")
    got = {r.id: r.near for r in knn.nearest(v, 10, block=400).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hit = sum(len({n.id for n in got[i]} & set(np.argsort(-s[i])[:10].tolist())) for i in range(len(x)))
    assert len(got) == len(x) and hit / (10 * len(x)) >= 0.9
    assert got[7][0].id == 8 and got[7][0].sim == pytest.approx(1)
    q8, scale, lost = knn.quantise(u)
    approx = (q8.astype(float) * scale[:, None]) @ (q8.astype(float) * scale[:, None]).T
    np.fill_diagonal(approx, -2)
    assert (np.abs(approx - s) <= lost[:, None] + lost[None] * (1 + lost[:, None]) + 1e-5).all()
    assert knn.nearest(v.limit(0)).count() == 0


def test_groups_are_the_planted_ones(spark):
    x, own = planted(700, groups=4)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, e array<float>")
    got = mcl.similarity_groups(vectors.unit_vectors(df, "id", "e")).toPandas()
    want = {frozenset(np.flatnonzero(own == g).tolist()) for g in range(4)}
    found = [frozenset(g["id"]) for _, g in got.groupby("leader") if len(g) >= 20]
    assert len(found) == 4 and all(max(len(w & f) / len(w | f) for f in found) >= 0.95 for w in want) and (got["leader"] <= got["id"]).all()
    assert mcl.similarity_groups(vectors.unit_vectors(df.limit(0), "id", "e")).count() == 0


def test_similarity_groups_of_large_tables(spark, monkeypatch):
    """Large groups are found in a sample, a small one that it doesn't show in the rest; no search among all pairs."""
    rng = np.random.default_rng(6)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    own = np.repeat([0, 1, 2, 3], [600, 500, 400, 7])
    x = unit(np.eye(100)[own] * 0.75 + math.sqrt(1 - 0.75**2) * unit(rng.normal(size=(len(own), 100))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<float>")
    searched = []
    nearest = mcl.nearest
    monkeypatch.setattr(mcl, "nearest", lambda v, *a, **b: searched.append(v.count()) or nearest(v, *a, **b))
    monkeypatch.setattr(mcl, "SHOWN", 300, raising=False)
    got = mcl.similarity_groups(vectors.unit_vectors(df, "id", "e")).toPandas()
    found = [set(g["id"]) for _, g in got.groupby("leader")]
    for k in range(4):
        w = set(np.flatnonzero(own == k).tolist())
        assert max(len(w & f) / len(w | f) for f in found) >= 0.95
    assert searched and max(searched) < 450


def test_sample_flow_over_the_whole_table(spark):
    """A sample that is the table gives the flow of the matrix."""
    rng = np.random.default_rng(7)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    own = np.repeat([0, 1, 2], [60, 40, 30])
    x = unit(np.eye(100)[own] * 0.7 + 0.7 * unit(rng.normal(size=(len(own), 100))))
    v = session.cut(vectors.unit_vectors(spark.createDataFrame([(3 * i, r.tolist()) for i, r in enumerate(x)], "id long, e array<float>"), "id", "e"))
    members, _, graph = mcl.markov_clusters(v)
    want = mcl.strongest_flow(graph, members, 0.4).toPandas().sort_values("id")
    got = mcl.sample_flow(v, v, graph, members, 0.4, margin=2.0).toPandas().sort_values("id")
    assert got["id"].tolist() == want["id"].tolist() and got["node"].tolist() == want["node"].tolist()
    assert np.allclose(got["inflow"], want["inflow"], atol=1e-4)


def test_similarity_groups_lost_clusters_remove_none(spark):
    """H > N > G: N clashes with H, G only with N; G stays."""
    rng = np.random.default_rng(4)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    h, n, g = np.eye(100)[:3]
    n = 0.35 * h + math.sqrt(1 - 0.35**2) * n
    g = 0.36 * n + math.sqrt(1 - 0.36**2) * unit(g - (g @ n) * n)
    g = unit(g - (g @ h - 0.02) * h)
    # cosines to a mean are spread so that some of one reach the other's mean
    noise = lambda k: unit(rng.normal(size=(k, 100)))
    x = np.vstack([0.75 * c + math.sqrt(1 - 0.75**2) * noise(k) for c, k in ((h, 300), (n, 100), (g, 40))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<float>")
    got = mcl.similarity_groups(vectors.unit_vectors(df, "id", "e")).toPandas()
    found = [set(f["id"]) for _, f in got.groupby("leader")]
    own = np.repeat([0, 1, 2], [300, 100, 40])
    share = lambda k: max(len(f & set(np.flatnonzero(own == k))) / (own == k).sum() for f in found)
    assert share(0) >= 0.8 and share(2) >= 0.9 and share(1) < 0.1


def test_smaller_of_clashes(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (2, 4), (7, 8), (7, 8)]
    got = mcl.smaller_of_clashes(spark.createDataFrame(pairs, "big long, small long"))
    assert sorted(r.node for r in got.collect()) == [2, 4, 8]
    assert mcl.smaller_of_clashes(spark.createDataFrame([], "big long, small long")).count() == 0


def test_all_clashing_means_are_seen(spark):
    """One vector within reach of more than four means; the parts are merged alike."""
    m = np.eye(100, dtype="f4")[:9]
    v = (m[:8].sum(axis=0) / math.sqrt(8)).astype("f4")
    df = lambda x, c: spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(x)], c)
    got = mcl._best(df(v[None], "id long, v binary"), df(m, "node long, s binary"), 0.353, 0.35).collect()
    assert len(got) == 1 and got[0].node == 0 and sorted(got[0].others) == list(range(1, 8))


def test_small_loose_groups_against_brute_force(spark):
    """Pairs of members have cosines around 0.2 to 0.3 only."""
    rng = np.random.default_rng(3)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    planted, x = [], []
    for m, c in ((5, 0.64), (6, 0.63), (8, 0.6), (12, 0.6)):
        p = (m * c * c - 1) / (m - 1)
        planted.append(set(range(len(x), len(x) + m)))
        x += list(unit(math.sqrt(p) * unit(rng.normal(size=100)) + math.sqrt(1 - p) * unit(rng.normal(size=(m, 100)))))
    x = np.array(x + list(unit(rng.normal(size=(4, 100)))))

    def holds(groups):
        """The definition, pair by pair."""
        means = [unit(x[sorted(g)].mean(axis=0)) for g in groups]
        return all(x[i] @ means[a] > 0.5 and all(x[i] @ m < 0.35 for b, m in enumerate(means) if b != a) for a, g in enumerate(groups) for i in g)

    assert holds(planted)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<float>")
    got = mcl.similarity_groups(vectors.unit_vectors(df, "id", "e")).toPandas()
    found = [set(g["id"]) for _, g in got.groupby("leader")]
    assert holds(found) and all(len(f) >= 5 for f in found)
    assert all(max((len(w & f) / len(w | f) for f in found), default=0) >= 0.8 for w in planted)


TEXTS = ["Dr. Ann went home. It rained! \"Will it hold?\" asked Bob. (It did.) Costs fell 3.5 percent.The end came.", "发言人说：“工厂关闭。”价格上涨了3.5。为什么？", "A title\n\nHe left home. Dr. Bob\nslept. story_separator_special_tag He left.", "ราคาเพิ่มขึ้น 41.49 เปอร์เซ็นต์ ใครจะรับผิดชอบ", "", None]


def test_sentences(spark):
    d = spark.createDataFrame([(i, 0, t) for i, t in enumerate(TEXTS)], "set_id long, doc_no int, docs string")
    # a collection shows which contexts stand at its certain ends
    more = ["It rained!", "Who left?", "(It did.)", "He left home.", "The end came.", "Costs fell 3.5 percent.", "为什么？", "工厂关闭。", "他说：“工厂关闭。”", '"Stop!" asked Bob.', "Dr. Bob left home."] * 20
    every = d.unionByName(spark.createDataFrame([(i, 1, t) for i, t in enumerate(more)], d.schema))
    spans = sentences.sentence_spans(every.withColumn("start", F.lit(1)).withColumn("kind", F.lit("x"))).where("doc_no = 0").toPandas().sort_values(["set_id", "start_pos"])
    got = {i: [TEXTS[i][a:b] for a, b in zip(g["start_pos"], g["end_pos"])] for i, g in spans.groupby("set_id")}
    assert got[0] == ["Dr. Ann went home.", "It rained!", '"Will it hold?" asked Bob.', "(It did.)", "Costs fell 3.5 percent.", "The end came."]
    assert got[1] == ["发言人说：“工厂关闭。”", "价格上涨了3.5。", "为什么？"]
    assert got[2] == ["A title", "He left home.", "Dr. Bob\nslept.", "He left."]
    assert got[3] == ["ราคาเพิ่มขึ้น 41.49 เปอร์เซ็นต์", "ใครจะรับผิดชอบ"] and set(got) == {0, 1, 2, 3}
    assert sentences.sentence_spans(d.limit(0)).count() == 0


def test_plain_texts_of_three_scripts(spark):
    """Texts without any mark: boundaries from word n-grams of the marked ones, in three scripts."""
    rnd = random.Random(9)
    kinds = {
        "latin": (" ", [["the", "a", "our"], ["mayor", "clinic", "harbour", "museum"], ["closed", "opened", "praised", "visited"], ["the", "a"], ["bridge", "budget", "canal", "survey"], ["today", "again", "in spring"]], "."),
        "han": ("", [["市长", "医院", "博物馆", "港口"], ["关闭了", "赞扬了", "参观了"], ["大桥", "预算", "运河", "调查"]], "。"),
        "cyrillic": (" ", [["мэр", "завод", "музей", "порт"], ["закрыл", "открыл", "похвалил"], ["мост", "бюджет", "канал", "отчет"], ["сегодня", "снова", "весной"]], "."),
    }
    rows, want = [], {}
    for no, (space, slots, mark) in enumerate(kinds.values()):
        sentence = lambda: space.join(rnd.choice(s) for s in slots)  # noqa: B023, E731
        rows += [(no * 10_000 + i, 0, space.join(sentence() + mark for _ in range(4))) for i in range(150)]
        for i in range(30):
            text, ends = "", set()
            for _ in range(5):
                text += (space if text else "") + sentence()
                ends.add(len(text))
            rows.append((no * 10_000 + 5_000 + i, 1, text))
            want[no * 10_000 + 5_000 + i] = ends - {len(text)}
    got = sentences.sentence_spans(spark.createDataFrame(rows, "set_id long, doc_no int, docs string")).where("doc_no = 1").toPandas()
    for no, name in enumerate(kinds):
        own = got[got["set_id"] // 10_000 == no]
        found = {(i, e) for i, e in zip(own["set_id"], own["end_pos"]) if e != own[own["set_id"] == i]["end_pos"].max()}
        real = {(i, e) for i, s in want.items() if i // 10_000 == no for e in s}
        recall, precision = len(found & real) / len(real), len(found & real) / max(1, len(found))
        print(f"{name}: recall {recall:.3f}, precision {precision:.3f}")
        assert recall >= 0.9 and precision >= 0.9


def test_left_contexts():
    assert he.gaps("He met St. John. Bye.")[0].left == "w:St"
    assert [g.left for g in he.gaps("Am 6. Oktober kam er.")] == ["#:Am", "w:er"]
    assert he.pairs("‘It’s late,’ he said") == {11: 0}
