"""Reports over triples and term tables: what stands several times, counts and dangling nodes, load headers, name bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the table that is exported, and the predicates of each: fixed values.
TABULAR = {
    "label": ["rdfs:label"], "synonyms": ["ex:synonym", "NIFRID:synonym", "oboInOwl:hasExactSynonym", "oboInOwl:hasBroadSynonym", "oboInOwl:hasNarrowSynonym", "oboInOwl:hasRelatedSynonym"],
    "definition": ["ex:definition"], "subClassOf": ["rdfs:subClassOf"], "preferred": ["ex:hasPreferredId"], "existing": ["ex:hasExistingId"], "type": ["rdf:type"],
}


def _several(rows: DataFrame, kind: str, key: Column, member: Column) -> DataFrame:
    """(kind, key, n, least) of keys with several distinct members."""
    got = rows.where(key.isNotNull()).select(key.cast("string").alias("key"), member.cast("string").alias("m")).distinct()
    return got.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("least")).where("n > 1").select(F.lit(kind).alias("kind"), "key", "n", "least")


def repeats(terms: DataFrame, existing: DataFrame, triples: DataFrame, subgraphs: DataFrame) -> DataFrame:
    """What stands several times: (kind, key, n, least member) of six groupings.

    Labels of several terms (without case), iris of several terms, iris with several curies, terms with several versions of an iri, subjects
    with several types, and subgraphs that several free nodes have.  ``terms``: (id, label), ``existing``: (tid, iri, curie, version),
    ``subgraphs``: (node, condensed, parents).
    """
    c = F.col
    return (
        _several(terms, "label", F.lower(F.trim("label")), c("id")).unionByName(_several(existing, "iri", c("iri"), c("tid"))).unionByName(_several(existing, "curies", c("iri"), c("curie")))
        .unionByName(_several(existing, "versions", c("tid"), c("version"))).unionByName(_several(triples.where("p = 'rdf:type'"), "types", c("s"), c("o")))
        .unionByName(_several(subgraphs.where("parents = 0"), "free subgraphs", F.lower(F.hex("condensed")), c("node")))
    )


def node_counts(triples: DataFrame) -> DataFrame:
    """(node, as_subject, as_object, dangling) of blank nodes: a dangling one is an object and has no rows of its own."""
    s = triples.where("s_blank is not null").groupBy(F.col("s_blank").alias("node")).agg(F.count(F.lit(1)).alias("as_subject"))
    o = triples.where("o_blank is not null").groupBy(F.col("o_blank").alias("node")).agg(F.count(F.lit(1)).alias("as_object"))
    return s.join(o, "node", "full").fillna(0, ["as_subject", "as_object"]).withColumn("dangling", F.col("as_subject") == 0)


def load_header(triples: DataFrame, ids: DataFrame, uri: str, title: str, source: str, started: Column, ended: Column) -> DataFrame:
    """Header facts (s, p, v) of a load: its type, title, source, times, epoch, version and version iri, counts, and the largest id of each prefix.

    ``ids``: (prefix, number).
    """
    one = triples.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects")).withColumns({"a": started, "b": ended})
    version = F.date_format("b", "yyyy-MM-dd'T'HH:mm:ss")
    facts = [
        ("rdf:type", F.lit("owl:Ontology")), ("dc:title", F.lit(title)), ("ex:source", F.lit(source)), ("ex:started", F.date_format("a", "yyyy-MM-dd'T'HH:mm:ss")), ("ex:ended", version), ("ex:epoch", F.unix_timestamp("b").cast("string")),
        ("owl:versionInfo", version), ("owl:versionIRI", F.concat(F.lit(f"{uri}/version/"), F.unix_timestamp("b").cast("string"))), ("ex:tripleCount", F.col("n").cast("string")), ("ex:subjectCount", F.col("subjects").cast("string")),
    ]
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(p).alias("p"), v.alias("v")) for p, v in facts])))
    tops = ids.groupBy("prefix").agg(F.max("number").alias("x")).select(F.concat(F.lit("ex:maxId/"), "prefix").alias("p"), F.col("x").cast("string").alias("v"))
    return rows.unionByName(tops).select(F.lit(uri).alias("s"), "p", "v")


def name_bindings(headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names (name) and edges (name, identity, type) of what was fetched.

    ``headers``: (names, bound, version, identity): every name on the way to the file points to it, the name in it is bound, and the name of
    its version is bound as one; missing names give no edge.
    """
    edges = headers.select(F.explode("names").alias("name"), "identity", F.lit("pointer").alias("type"))
    for c, kind in (("bound", "bound"), ("version", "bound_version")):
        edges = edges.unionByName(headers.where(F.col(c).isNotNull()).select(F.col(c).alias("name"), "identity", F.lit(kind).alias("type")))
    edges = edges.where("name is not null").distinct()
    return edges.select("name").distinct(), edges
