"""Concept hierarchies (several parents allowed) and knowledge-base facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from lexicube.session import cut


def leaves(links: DataFrame) -> DataFrame:
    """Children that are no parent."""
    return links.select("child").distinct().join(links.select(F.col("parent").alias("child")), "child", "left_anti")


def roots(links: DataFrame) -> DataFrame:
    """Parents that are no child."""
    return links.select("parent").distinct().join(links.select(F.col("child").alias("parent")), "parent", "left_anti")


def _levels(now: DataFrame, links: DataFrame, forward: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All of ``now``, ``forward(now)``, and so on until nothing goes on.

    A way can't be longer than there are nodes; if one is, the hierarchy has a cycle,
    which is an error. Each level is cut, so it is computed once.
    """
    now = cut(now, "level")
    out, depth, nodes = now, 1, None
    while True:
        now = cut(forward(now), "level")
        if now.isEmpty():
            return out
        depth += 1
        if depth % 8 == 0:
            nodes = nodes or links.select("parent").union(links.select("child")).distinct().count()
            if depth > nodes:
                raise ValueError("the hierarchy has a cycle")
        out = out.unionByName(now)


def closure(links: DataFrame) -> DataFrame:
    """(parent, child): every node with all nodes below it."""
    step = links.select(F.col("parent").alias("p"), F.col("child").alias("c")).distinct()
    return _levels(links.select("parent", "child").distinct(), links, lambda now: now.join(step, F.col("child") == F.col("p")).select("parent", F.col("c").alias("child")).distinct()).distinct()


def paths(links: DataFrame) -> DataFrame:
    """(root, node, length, path): every way down from the roots; relations joined by ``/``.

    Level by level, one join each, until no way goes on. ``links`` (parent, child, relation).
    """
    step = links.select("parent", "child", "relation")
    now = roots(links).join(step, "parent").select(F.col("parent").alias("root"), F.col("child").alias("node"), F.lit(1).alias("length"), F.col("relation").alias("path"))
    return _levels(now, links, lambda now: now.join(step, now["node"] == step["parent"]).select("root", F.col("child").alias("node"), (F.col("length") + 1).alias("length"), F.concat_ws("/", "path", "relation").alias("path")))


def concept_paths(links: DataFrame) -> DataFrame:
    """Distinct relation paths from the roots."""
    return paths(links).select("path").distinct()


def follow(links: DataFrame, root: str, relations: list[str]) -> DataFrame:
    """(node): what is reached from ``root`` along exactly these relations."""
    at = links.sparkSession.createDataFrame([(root,)], "node string")
    for r in relations:
        at = at.join(links.where(F.col("relation") == r), F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
    return at


def upward_paths(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, top, path): ways up from the nodes to the roots, relations from the top down."""
    step = links.select(F.col("child").alias("c"), F.col("parent").alias("p"), F.col("relation").alias("rel"))
    now = nodes.select("node").join(step, F.col("node") == F.col("c")).select("node", F.col("p").alias("top"), F.col("rel").alias("path"))
    out = _levels(now, links, lambda now: now.join(step, F.col("top") == F.col("c")).select("node", F.col("p").alias("top"), F.concat_ws("/", "rel", "path").alias("path")))
    return out.join(roots(links).withColumnRenamed("parent", "top"), "top", "left_semi").select("node", "top", "path")


def build(facts: DataFrame, categories: DataFrame, upper: DataFrame, option: str = "R") -> DataFrame:
    """(child, parent, relation, level): a hierarchy from facts about entities.

    ``facts`` (subj, obj, prop, hop), ``categories`` (prop, category), ``upper`` (child,
    parent) the taxonomy above. Option ``R``: the parent of an entity is the category of
    the property; ``E``: the parent is the object of the fact. Levels are the hop, and
    one more than the largest hop for the upper taxonomy. Facts whose property has no
    category are left out with ``R``. Repeated links are one.
    """
    top = facts.agg((F.coalesce(F.max("hop"), F.lit(0)) + 1).cast("int").alias("level"))
    hop = F.col("hop").cast("int").alias("level")
    if option == "R":
        own = facts.join(categories.select("prop", "category"), "prop").select(F.col("subj").alias("child"), F.col("category").alias("parent"), F.col("prop").alias("relation"), hop)
    else:
        own = facts.select(F.col("subj").alias("child"), F.col("obj").alias("parent"), F.col("prop").alias("relation"), hop)
    above = upper.select("child", "parent", F.lit("is_a").alias("relation")).join(F.broadcast(top))  # one row
    return own.unionByName(above).distinct()


def roll_up(links: DataFrame, counts: DataFrame, levels: int) -> DataFrame:
    """(level, node, total): counts of level 0 summed up level by level.

    A child with two parents counts in both. ``links`` (child, parent, level), where
    level is that of the parent; ``counts`` (node, n).
    """
    out = counts.groupBy("node").agg(F.sum("n").alias("total")).select(F.lit(0).alias("level"), "node", "total")
    now = out
    for level in range(1, levels + 1):
        up = links.where(F.col("level") == level).join(now.select(F.col("node").alias("child"), "total"), "child")
        now = up.groupBy(F.col("parent").alias("node")).agg(F.sum("total").alias("total")).select(F.lit(level).alias("level"), "node", "total")
        out = out.unionByName(now)
    return out


def rank_groups(links: DataFrame, counts: DataFrame, option: str = "A", least: int = 3) -> DataFrame:
    """(parent, score) of groups of more than ``least`` children by their counts.

    A mean; B ln(sum) / (v + .1); C 1 / (v + .1); D mean / (v + .1), v the population
    variance of the children's shares; E the sum, or 0 if one child has over half.
    """
    c = links.join(counts.select(F.col("node").alias("child"), "n"), "child")
    g = c.groupBy("parent").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"), F.avg("n").alias("m"), F.max("n").alias("x"), F.var_pop(F.col("n").cast("double")).alias("vn")).where(F.col("k") > least)
    v = F.col("vn") / (F.col("s") * F.col("s").cast("double"))
    score = {"A": F.col("m"), "B": F.log(F.col("s").cast("double")) / (v + 0.1), "C": 1 / (v + 0.1), "D": F.col("m") / (v + 0.1), "E": F.when(F.col("x") / F.col("s") > 0.5, 0.0).otherwise(F.col("s").cast("double"))}[option]
    return g.select("parent", score.alias("score"))


def prune_groups(links: DataFrame, least: int, blacklist: list[str] | None = None) -> DataFrame:
    """Links whose (parent, relation) group has at least ``least`` children; no parents of the blacklist."""
    if blacklist:
        links = links.where(~F.col("parent").isin(blacklist))
    big = links.groupBy("parent", "relation").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).drop("k")
    return links.join(big, ["parent", "relation"], "left_semi")


def dense_nodes(counts: DataFrame, least: int) -> DataFrame:
    """Nodes counted ``least`` times or more."""
    return counts.where(F.col("n") >= least)


#: The object that marks a page as one of disambiguation; facts with it are dropped.
DISAMBIGUATION = "Wikimedia disambiguation page"


def expand(facts: DataFrame, start: DataFrame, hops: int, relations: list[list[str]] | None = None, without: str = DISAMBIGUATION) -> DataFrame:
    """(subj, obj, prop, hop): facts reached from the start entities within ``hops``.

    ``relations`` allows properties per hop; facts whose object is ``without`` don't
    count. A batch join per hop, not a lookup per id.
    """
    facts = facts.where(F.col("obj") != without)
    at = start.select("entity").distinct()
    seen, out = at, None
    for hop in range(1, hops + 1):
        f = facts if relations is None else facts.where(F.col("prop").isin(relations[hop - 1]))
        got = f.join(at.withColumnRenamed("entity", "subj"), "subj", "left_semi").select("subj", "obj", "prop", F.lit(hop).alias("hop"))
        out = got if out is None else out.unionByName(got)
        if hop == hops:
            break
        at = cut(got.select(F.col("obj").alias("entity")).distinct().join(seen, "entity", "left_anti"), "reached")
        seen = seen.unionByName(at)
    return out


def facts_between(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts whose two ends are different given entities."""
    e = entities.select("entity").distinct()
    return facts.join(e.withColumnRenamed("entity", "subj"), "subj", "left_semi").join(e.withColumnRenamed("entity", "obj"), "obj", "left_semi").where("subj <> obj")


def supported(edges: DataFrame, least: int = 2) -> DataFrame:
    """(dst): nodes that at least ``least`` different neighbours point to."""
    return edges.groupBy("dst").agg(F.count_distinct("src").alias("n")).where(F.col("n") >= least).select("dst")
