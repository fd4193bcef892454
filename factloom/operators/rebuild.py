"""Graphs stored by content and rebuilt from what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import cut
from . import identities as I
from .closure import reach, transitive_closure

NAMED = ["s", "p", "o", "o_lit", "datatype", "language"]


def store(triples: DataFrame, graph: str) -> dict[str, DataFrame]:
    """Tables of one graph: distinct named triples by identity, subgraph rows by content, nodes and links of this graph.

    Equal subgraphs share their rows; ``nodes`` holds each copy's replica number, ``links`` who points at which copy.
    """
    named = I.with_triple_identity(triples.where("s is not null and o_blank is null").select(*NAMED)).dropDuplicates(["triple_identity"])
    ids, _ = I.bnode_records(triples)
    nodes = I.replicas(ids).select("node", F.col("condensed").alias("subgraph_identity"), "replica")
    at = nodes.withColumnRenamed("node", "s_blank")
    rows = triples.where("s_blank is not null and o_blank is null").join(at, "s_blank").select("subgraph_identity", *NAMED[1:]).distinct()
    to = nodes.select(F.col("node").alias("o_blank"), F.col("subgraph_identity").alias("o_subgraph"), F.col("replica").alias("o_replica"))
    links = triples.where("o_blank is not null").join(to, "o_blank").join(at, "s_blank", "left").select("s", "subgraph_identity", "replica", "p", "o_subgraph", "o_replica").distinct()
    tag = F.lit(graph).alias("graph")
    return {
        "triples": named.drop("pair_identity"), "members": named.select(tag, "triple_identity"), "subgraphs": rows,
        "nodes": nodes.select(tag, "subgraph_identity", "replica"), "links": links.select(tag, "*"),
    }


def label(identity: str, replica: str):
    return F.when(F.col(identity).isNotNull(), F.concat(F.lit("sg_"), F.substring(F.lower(F.hex(identity)), 1, 19), F.lit("_"), F.col(replica).cast("string")))


def rebuild(tables: dict[str, DataFrame], graph: str) -> DataFrame:
    """All triples of a graph; blank nodes are named by subgraph digest and replica."""
    own = F.col("graph") == graph
    none = F.lit(None).cast("string")
    named = tables["triples"].join(tables["members"].where(own).select("triple_identity"), "triple_identity", "left_semi").select(*NAMED, none.alias("s_blank"), none.alias("o_blank"))
    blank = tables["nodes"].where(own).join(tables["subgraphs"], "subgraph_identity").select(none.alias("s"), *NAMED[1:], label("subgraph_identity", "replica").alias("s_blank"), none.alias("o_blank"))
    links = tables["links"].where(own).select("s", "p", none.alias("o"), none.alias("o_lit"), none.alias("datatype"), none.alias("language"), label("subgraph_identity", "replica").alias("s_blank"), label("o_subgraph", "o_replica").alias("o_blank"))
    return named.unionByName(blank).unionByName(links)


def reingest_check(triples: DataFrame) -> bool:
    """Is the identity of the rebuilt graph that of the stored one?"""
    return I.graph_identity(triples) == I.graph_identity(rebuild(store(triples, "g"), "g"))


def metadata_subgraph(triples: DataFrame, subject: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a subject and of the blank nodes below it, and all other rows."""
    own = triples.where(F.col("s") == subject)
    links = triples.where("s_blank is not null and o_blank is not null").select(F.col("s_blank").alias("s"), "p", F.col("o_blank").alias("o"))
    first = own.where("o_blank is not null").select(F.col("o_blank").alias("node"))
    below = first.union(transitive_closure(links, first).select("o")).distinct().withColumnRenamed("node", "s_blank")
    meta = own.unionByName(triples.join(below, "s_blank", "left_semi").select(*triples.columns))
    rest = triples.where(~F.coalesce(F.col("s") == subject, F.lit(False))).join(below, "s_blank", "left_anti").select(*triples.columns)
    return meta, rest


def referenced_closure(triples: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows of the starts and of every iri that their rows name, until nothing new is named."""
    edges = triples.where("s is not null and o is not null").select("s", "p", "o")
    walk = cut(transitive_closure(edges, starts))
    met = cut(walk.select("s").union(walk.select("o")).union(starts.select("node")).distinct())
    return triples.join(met, "s", "left_semi")


def new_entities(requests: DataFrame, registry: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """Requests (request, label) -> (minted, conflicts): labels already registered or asked for before are conflicts.

    Ids go on from ``top`` in the order of requests, without gaps: requests are dealt to ranges, numbered inside each, and a range begins
    where the counts of those before it end.
    """
    first = requests.withColumn("k", F.row_number().over(W.partitionBy(F.lower("label")).orderBy("request")))
    known = registry.select(F.lower("label").alias("low")).distinct()
    keyed = first.withColumn("low", F.lower("label")).join(known.withColumn("known", F.lit(True)), "low", "left")
    bad = keyed.where("known or k > 1").select("request", "label", F.when(F.col("known"), "registered").otherwise("asked before").alias("reason"))
    good = keyed.where("known is null and k = 1")
    good = cut(good.repartitionByRange("request").withColumn("part", F.spark_partition_id()))
    sizes = good.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    good = good.join(F.broadcast(before), "part")
    number = F.row_number().over(W.partitionBy("part").orderBy("request")) + F.col("before") + top
    return good.select("request", "label", F.concat(F.lit("tx_"), F.lpad(number.cast("string"), 7, "0")).alias("id")), bad


INCLUDES_TERM, INCLUDES_SET = "ex:includesTerm", "ex:includesTermSet"  # fixed values


def termset_members(triples: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the term sets ``starts`` (start), and the sets below them: (start, member, in_set) and (start, set).

    A set that is included as a set is gone on with, one that is included as a term is a member and ends there.  Cycles of sets end.
    """
    own = triples.where(F.col("p").isin(INCLUDES_TERM, INCLUDES_SET) & F.col("o").isNotNull())
    sets = reach(own.where(F.col("p") == INCLUDES_SET).select(F.col("s").alias("a"), F.col("o").alias("b")), starts.select("start", F.col("start").alias("node")))
    members = sets.join(own.where(F.col("p") == INCLUDES_TERM).select(F.col("s").alias("node"), F.col("o").alias("member")), "node")
    return members.select("start", "member", F.col("node").alias("in_set")).distinct(), sets.select("start", F.col("node").alias("set"))
