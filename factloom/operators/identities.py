"""Identities of triples, records, subgraphs, graphs and releases."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import either, h, low, null_identity, object_identity, pair_identity, sequence_identity, triple_identity
from ..functions.shared import cut


def with_triple_identity(named: DataFrame) -> DataFrame:
    """Adds ``pair_identity`` and ``triple_identity`` to named triples."""
    pair = named.withColumn("pair_identity", pair_identity(object_identity()))
    return pair.withColumn("triple_identity", triple_identity(F.col("pair_identity")))


def named_records(named: DataFrame) -> DataFrame:
    """(s, condensed, embedded, n): one record for each subject, over its distinct triples."""
    rows = with_triple_identity(named).select("s", "pair_identity").distinct()
    return rows.groupBy("s").agg(
        sequence_identity(F.collect_list("pair_identity")).alias("condensed"), F.count(F.lit(1)).alias("n")
    ).withColumn("embedded", h(F.concat(h("s"), F.col("condensed"))))


#: Leading hex digits of a digest that name its bucket, level by level: with 10**12 digests a bucket of the first level holds some 60,000,
#: those above 4096 at most.
LEVELS = (6, 3, 0)


def bucketed_identity(rows: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, identity): identity of all digests of a column, duplicates kept, order left out.

    A bucket of digests with equal leading digits is hashed in order, then buckets of buckets, so no task ever holds all of a
    group's digests.  Nulls aren't counted; a group without digests has no row.
    """
    level = rows.where(F.col(column).isNotNull()).select(*by, low(column).alias("_x"), F.col(column).cast("binary").alias("_d"))
    for digits in LEVELS:
        one = F.sort_array(F.collect_list(F.struct("_x", "_d")))
        hexed = F.array_join(F.transform(one, lambda x: F.hex(x["_d"])), "")
        level = level.groupBy(*by, F.substring("_x", 1, digits).alias("_x")).agg(h(F.unhex(hexed)).alias("_d"))
    return level.select(*by, F.col("_d").alias("identity"))


def sequence_of(rows: DataFrame, column: str) -> bytes:
    """The bucketed identity of a column; one digest reaches the driver."""
    found = bucketed_identity(rows, column).first()
    return bytes(found.identity) if found else hashlib.sha256(b"").digest()


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def bnode_records(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identities of blank nodes, bottom up, and of the subjects that hold them.

    ``nodes``: (node, condensed, parents); ``embedded``: (s, embedded) over each named subject's links to blank nodes.  Rounds
    go by depth; a round without progress is a cycle and an error.  A blank object without rows has the null identity.
    """
    rows = triples.where("s_blank is not null").distinct()
    links = cut(rows.where("o_blank is not null").select("s_blank", "p", "o_blank"))
    own = rows.where("o_blank is null").withColumn("pair", pair_identity(object_identity())).select("s_blank", "pair")
    subjects = rows.select(F.col("s_blank").alias("node")).distinct()
    dangling = triples.where("o_blank is not null").select(F.col("o_blank").alias("node")).distinct().join(subjects, "node", "left_anti")
    parts = [cut(dangling.withColumn("condensed", null_identity()))]  # a table a round, none is written again
    left = cut(subjects)
    while not left.isEmpty():
        done = _all(parts)
        known = links.join(done.select(F.col("node").alias("o_blank"), "condensed"), "o_blank", "left")
        waiting = known.where("condensed is null").select(F.col("s_blank").alias("node")).distinct()
        ready = cut(left.join(waiting, "node", "left_anti"))
        if ready.isEmpty():
            raise ValueError("blank nodes hold a cycle")
        linked = known.where("condensed is not null").select("s_blank", h(F.concat(h("p"), F.col("condensed"))).alias("pair"))
        pairs = own.unionByName(linked).withColumnRenamed("s_blank", "node").join(ready, "node", "left_semi")
        new = pairs.groupBy("node").agg(sequence_identity(F.collect_list("pair")).alias("condensed"))
        parts.append(cut(new))
        links = cut(links.join(ready.withColumnRenamed("node", "s_blank"), "s_blank", "left_anti"))
        left = cut(left.join(ready, "node", "left_anti"))
    done = _all(parts)
    parents = triples.where("o_blank is not null").groupBy(F.col("o_blank").alias("node")).agg(F.count(F.lit(1)).alias("parents"))
    nodes = done.join(parents, "node", "left").fillna(0, ["parents"])
    conn = triples.where("s is not null and o_blank is not null").select("s", "p", F.col("o_blank").alias("node")).join(done, "node")
    embedded = conn.withColumn("pair", h(F.concat(h("p"), F.col("condensed")))).groupBy("s").agg(
        h(F.concat(h("s"), sequence_identity(F.collect_list("pair")))).alias("embedded"), F.count(F.lit(1)).alias("n")
    )
    return nodes, embedded


def conn_identities(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triple identities of rows that link a subject to a blank node, with the node's identity."""
    conn = triples.where("s is not null and o_blank is not null").join(nodes.select(F.col("node").alias("o_blank"), "condensed"), "o_blank")
    return conn.select("s", "p", "o_blank", F.col("condensed").alias("subgraph_identity"), h(F.concat(h("s"), h(F.concat(h("p"), F.col("condensed"))))).alias("triple_identity"))


def blank_half(nodes: DataFrame, embedded: DataFrame) -> DataFrame:
    """Digests of a graph's blank half: linked subjects, and nodes that are free or have several parents."""
    loose = nodes.where("parents = 0 or parents > 1").select(F.col("condensed").alias("identity"))
    return embedded.select(F.col("embedded").alias("identity")).unionByName(loose)


def record_combined(named: DataFrame, embedded: DataFrame) -> DataFrame:
    """(s, combined) of the two halves of each subject's record."""
    both = named.select("s", F.col("embedded").alias("a")).join(embedded.select("s", F.col("embedded").alias("b")), "s", "full")
    return both.select("s", either(F.col("a"), F.col("b")).alias("combined"))


def graph_identity(triples: DataFrame) -> dict[str, bytes]:
    """Identities of the named half, the blank half, and the graph."""
    named = named_records(triples.where("s is not null and o_blank is null"))
    nodes, embedded = bnode_records(triples)
    a, b = sequence_of(named, "embedded"), sequence_of(blank_half(nodes, embedded), "identity")
    return {"named": a, "blank": b, "graph": hashlib.sha256(a + b).digest()}


def curies_identity(curies: DataFrame, by: list[str]) -> DataFrame:
    """Identity of each set of (prefix, namespace)."""
    pair = h(F.concat(h("prefix"), h("namespace")))
    return curies.distinct().groupBy(*by).agg(sequence_identity(F.collect_list(pair)).alias("identity"), F.count(F.lit(1)).alias("n"))


def replicas(nodes: DataFrame) -> DataFrame:
    """Number of each copy of one subgraph, by node label; counts matter, not which copy is which."""
    return nodes.withColumn("replica", F.row_number().over(W.partitionBy("condensed").orderBy("node")) - 1)


def nested_integers(triples: DataFrame) -> DataFrame:
    """(root, node, local): all nodes below each linked root numbered from 0, the root, whatever their labels.

    A node's place is where it is first met among the subgraph's rows in the order of predicate, object (blank ones last) and subject.  Nodes
    met at one place are told apart by the identity of what is below them, then by the places of their parents, refined until no more of
    them differ; what then still ties is alike from all sides, so exchanging it changes no row.
    """
    from .closure import reach

    inner = cut(triples.where("s_blank is not null").select("s_blank", "p", "o", "o_lit", "datatype", "language", "o_blank").distinct())
    links = inner.where("o_blank is not null").select(F.col("s_blank").alias("a"), F.col("o_blank").alias("b")).distinct()
    root = triples.where("s is not null and o_blank is not null").select(F.col("o_blank").alias("start"), F.col("o_blank").alias("node"))
    members = cut(reach(links, root).withColumnRenamed("start", "root"))
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("datatype", "language")]
    place = lambda role: F.struct("p", F.col("o_blank").isNotNull().alias("blank"), F.coalesce("o", "o_lit", F.lit("")).alias("v"), *text, F.lit(role).alias("role")).alias("place")
    met = inner.select(F.col("s_blank").alias("node"), place(0))
    rows = members.join(met, "node").select("root", "node", "place")
    held = members.withColumnRenamed("node", "s_blank").join(inner.where("o_blank is not null"), "s_blank")
    rows = rows.unionByName(held.select("root", F.col("o_blank").alias("node"), place(1)))
    first = rows.groupBy("root", "node").agg(F.min("place").alias("place"))
    nodes, _ = bnode_records(triples)
    head = (F.col("node") != F.col("root")).alias("inner")
    known = members.join(first, ["root", "node"], "left").join(nodes.select("node", "condensed"), "node", "left")
    rank = lambda *by: F.dense_rank().over(W.partitionBy("root").orderBy(*by))
    now = cut(known.select("root", "node", rank(head, "place", "condensed").alias("colour")))
    above = cut(held.select("root", "s_blank", "p", F.col("o_blank").alias("node")).distinct())
    kinds = now.select("root", "colour").distinct().count()
    while True:
        parent = above.join(now.select("root", F.col("node").alias("s_blank"), "colour"), ["root", "s_blank"])
        sides = parent.groupBy("root", "node").agg(F.sum(F.pmod(F.xxhash64("p", "colour"), F.lit(1 << 31))).alias("sides"))
        new = cut(now.join(sides, ["root", "node"], "left").select("root", "node", rank("colour", "sides").alias("colour")))
        more = new.select("root", "colour").distinct().count()
        if more == kinds:
            break
        now, kinds = new, more
    return now.select("root", "node", (F.row_number().over(W.partitionBy("root").orderBy("colour", "node")) - 1).alias("local"))


def local_integers(triples: DataFrame) -> DataFrame:
    """(root, node, local): nodes of one level under each linked root, 0 for the root, numbered by the link that reaches them."""
    links = triples.where("s_blank is not null and o_blank is not null").groupBy(F.col("s_blank").alias("root"), F.col("o_blank").alias("node")).agg(F.min("p").alias("p"))
    first = triples.where("s is not null and o_blank is not null").select(F.col("o_blank").alias("root")).distinct()
    below = links.join(first, "root", "left_semi").withColumn("local", F.row_number().over(W.partitionBy("root").orderBy("p", "node")))
    return first.select("root", F.col("root").alias("node"), F.lit(0).alias("local")).unionByName(below.select("root", "node", "local"))
