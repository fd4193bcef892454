"""Walks over edges: rounds of joins on a frontier, each round cut into the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut, small_or_plain


def transitive_closure(edges: DataFrame, starts: DataFrame, direction: str = "subject", max_depth: int = -1) -> DataFrame:
    """Distinct edges (s, p, o) reached from ``starts`` (node).

    Depth 0 is one hop, n is n + 1 hops, -1 has no limit.  ``direction`` "subject" follows s to o, "object" o to s.  A node
    enters the frontier once, so cycles end.  Only an emptiness test reaches the driver in each round.
    """
    src, dst = ("s", "o") if direction == "subject" else ("o", "s")
    edges = edges.select("s", "p", "o")
    seen = frontier = cut(starts.select("node").distinct())
    found, depth = None, 0
    while True:
        step = cut(edges.join(frontier.withColumnRenamed("node", src), src, "left_semi").select("s", "p", "o"))
        found = step if found is None else found.unionByName(step)
        if depth == max_depth:
            break
        new = cut(step.select(F.col(dst).alias("node")).distinct().join(seen, "node", "left_anti"))
        if new.isEmpty():
            break
        seen, frontier, depth = seen.unionByName(new), new, depth + 1
    return found.distinct()


def connected(triples: DataFrame, starts: DataFrame, predicates: list[str], direction: str = "subject", max_depth: int = -1) -> DataFrame:
    """Triples (s, p, o, triple_identity) of any of the predicates that a walk from ``starts`` (node) meets; depth as in the closure."""
    own = triples.where(F.col("p").isin(*predicates) & F.col("o").isNotNull())
    met = transitive_closure(own, starts, direction, max_depth)
    return own.select("s", "p", "o", "triple_identity").join(met, ["s", "p", "o"], "left_semi").distinct()


def all_pairs(edges: DataFrame) -> DataFrame:
    """(a, b) for every b reachable from a, by path doubling; nodes on a cycle reach themselves."""
    pairs = cut(edges.select(F.col("s").alias("a"), F.col("o").alias("b")).distinct())
    n = pairs.count()
    while True:
        longer = pairs.join(pairs.toDF("b", "c"), "b").select("a", F.col("c").alias("b"))
        pairs = cut(pairs.union(longer).distinct())
        if (m := pairs.count()) == n:
            return pairs
        n = m


def lift_restrictions(triples: DataFrame) -> DataFrame:
    """``s subClassOf [a Restriction; onProperty p; someValuesFrom o]`` as (s, p, o), for every p and o of the node."""
    nodes = triples.where("s_blank is not null").groupBy("s_blank").agg(
        F.max(F.when((F.col("p") == "rdf:type") & (F.col("o") == "owl:Restriction"), 1)).alias("is_r"),
        F.collect_set(F.when(F.col("p") == "owl:onProperty", F.col("o"))).alias("lps"),
        F.collect_set(F.when(F.col("p") == "owl:someValuesFrom", F.col("o"))).alias("los"),
    ).where("is_r = 1")
    conn = triples.where("s is not null and p = 'rdfs:subClassOf' and o_blank is not null").select("s", F.col("o_blank").alias("s_blank"))
    return conn.join(nodes, "s_blank").select("s", F.explode("lps").alias("p"), "los").select("s", "p", F.explode("los").alias("o")).distinct()


def with_labels_and_types(edges: DataFrame, triples: DataFrame) -> DataFrame:
    """The edges, and label and type rows of every node and predicate met."""
    met = edges.select(F.explode(F.array("s", "p", "o")).alias("s")).distinct()
    about = triples.where(F.col("p").isin("rdf:type", "rdfs:label")).join(met, "s", "left_semi").select("s", "p", "o", "o_lit")
    return edges.select("s", "p", "o", F.lit(None).cast("string").alias("o_lit")).unionByName(about).distinct()


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level): leaves are 0, others one more than their highest child; a cycle is an error."""
    edges = cut(edges.select("s", "o").distinct())
    left = cut(edges.select(F.col("s").alias("node")).union(edges.select("o")).distinct())
    out, level = None, 0
    while True:
        if left.isEmpty():
            return out if out is not None else left.withColumn("level", F.lit(0))
        open_ = edges.join(left.withColumnRenamed("node", "o"), "o", "left_semi")
        ready = cut(left.join(open_.select(F.col("s").alias("node")).distinct(), "node", "left_anti"))
        if ready.isEmpty():
            raise ValueError("the edges hold a cycle")
        part = ready.withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
        left = cut(left.join(ready, "node", "left_anti"))
        level += 1


def identity_walk(relations: DataFrame, types: DataFrame, starts: DataFrame, direction: str = "subject", of_type: str | None = None) -> DataFrame:
    """Edges between identities met on the way down or up, with both ends' types; filtered after the walk only."""
    found = transitive_closure(relations, starts, direction)
    ends = found.join(types.toDF("s", "s_type"), "s", "left").join(types.toDF("o", "o_type"), "o", "left")
    return ends.where(F.col("o_type") == of_type) if of_type else ends


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): every node that a walk over ``edges`` (a, b) from each of ``starts`` (start, node) meets, the first ones included.

    A pair enters the frontier once, so cycles end.  Only edges that leave the frontier's nodes take part in a round; where a few nodes
    hold most pairs, those edges are few and are sent to all tasks once a count proves it.
    """
    parts = [cut(starts.select("start", "node").distinct())]
    while not parts[-1].isEmpty():
        new = parts[-1]
        out = cut(edges.join(new.select(F.col("node").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("node"), F.col("b")).distinct())
        seen = parts[0]
        for x in parts[1:]:
            seen = seen.union(x)
        step = new.join(small_or_plain(out), "node").select("start", F.col("b").alias("node")).distinct()
        parts.append(cut(step.join(seen, ["start", "node"], "left_anti")))
    out = parts[0]
    for x in parts[1:-1]:
        out = out.union(x)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the lowest node of its component.

    Each round a node takes the lowest label around it and then that label's own label, until none moves; only that reaches the driver.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("node", "other"))
    at = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp")))
    while True:
        near = both.join(at.toDF("other", "c"), "other").groupBy("node").agg(F.min("c").alias("c"))
        low = at.join(near, "node").select("node", "comp", F.least("comp", "c").alias("low"))
        new = cut(low.join(at.toDF("low", "far"), "low").select("node", F.least("low", "far").alias("comp"), (F.least("low", "far") < F.col("comp")).alias("moved")))
        at = new.select("node", "comp")
        if new.where("moved").isEmpty():
            return at


def extend_closure(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (node, ancestor) that ``closure`` lacks once ``edges`` (a, b: a is part of b) are added, without walking what was known.

    New pairs join with the old ones on both sides until none is new; a round starts from the last round's pairs only.
    """
    known = closure.select("node", "ancestor")
    new = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("ancestor")).distinct().join(known, ["node", "ancestor"], "left_anti"))
    found = new
    while not new.isEmpty():
        every = known.unionByName(found)
        up = new.select("node", F.col("ancestor").alias("mid")).join(every.select(F.col("node").alias("mid"), "ancestor"), "mid").select("node", "ancestor")
        down = every.select("node", F.col("ancestor").alias("mid")).join(new.select(F.col("node").alias("mid"), "ancestor"), "mid").select("node", "ancestor")
        new = cut(up.unionByName(down).distinct().join(every, ["node", "ancestor"], "left_anti"))
        found = found.unionByName(new)
    return found
