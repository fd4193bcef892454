"""Many releases of graphs at once: their identity relations, and what can be found in the relations alone.

Rows of releases are triples with ``graph``, ``s_blank`` and ``o_blank``; blank labels hold within their graph.  Each graph has one header
subject, whose rows and the blank nodes below it are the release's metadata; all else is its data.  Identities are computed for all graphs
in one pass: named records and records of links to blank nodes for each (graph, part, subject), then the halves of each graph, the graph,
and the release, which is the graph under its local conventions.  The relations between them are edges from a whole to its parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import either, h, low, null_identity, object_identity, pair_identity, sequence_identity, triple_identity
from ..functions.shared import cut, small_or_plain
from . import identities as I
from .closure import reach

VALUES = ["p", "o", "o_lit", "datatype", "language"]
GRAPH = ["graph", "part"]
RECORD = [*GRAPH, "s"]

#: Names of relations and of types of identities: fixed values.
NAMED_GRAPH, BLANK_GRAPH, NAMED_RECORD, BLANK_RECORD, CONDENSED = "hasNamedGraph", "hasBnodeGraph", "hasNamedRecord", "hasBnodeRecord", "hasCondensed"
METADATA, CONVENTIONS, WHOLE_GRAPH = "hasMetadataGraph", "hasLocalConventions", "hasGraph"
RELEASE = "graph_combined_local_conventions"


@dataclass
class Store:
    """What is kept of many releases, by content; ``sources`` alone knows graphs by name."""

    relations: DataFrame  # s, p, o: a whole's identity, the relation, a part's identity
    identities: DataFrame  # identity, type, n (rows), first_seen
    triples: DataFrame  # triple_identity, s, p, o, o_lit, datatype, language, o_subgraph
    record_triples: DataFrame  # record (named or blank embedded identity), triple_identity
    subgraphs: DataFrame  # subgraph, p, o, o_lit, datatype, language, o_subgraph: rows of blank nodes by content
    records: DataFrame  # graph, part, s, named, blank, combined and the condensed identities, n_named, n_blank
    sources: DataFrame  # graph, uri, first_seen, release, metadata


def _scoped(rows: DataFrame) -> DataFrame:
    """Blank labels made unique over all graphs: the length of the graph's name keeps (graph, label) apart from any other pair."""
    own = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.char_length("graph").cast("string"), F.lit(":"), F.col("graph"), F.lit(":"), F.col(c))).alias(c)
    return rows.select("graph", "s", *VALUES, own("s_blank"), own("o_blank")).distinct()


def parted(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Scoped rows with ``part``: "meta" for rows of a graph's header (graph, uri) and of the blank nodes below it, else "data"."""
    rows = _scoped(rows)
    own = headers.select("graph", F.col("uri").alias("s"), F.lit(True).alias("head"))
    rows = cut(rows.join(small_or_plain(own), ["graph", "s"], "left"))
    links = rows.where("s_blank is not null and o_blank is not null").select(F.col("s_blank").alias("a"), F.col("o_blank").alias("b"))
    first = rows.where("head and o_blank is not null").select(F.col("o_blank").alias("start"), F.col("o_blank").alias("node"))
    below = reach(links, first).select(F.col("node").alias("s_blank"), F.lit(True).alias("under")).distinct()
    return rows.join(below, "s_blank", "left").select("graph", F.when(F.col("head") | F.col("under"), "meta").otherwise("data").alias("part"), "s", *VALUES, "s_blank", "o_blank")


def _halves(rows: DataFrame) -> DataFrame:
    """(graph, part, identity) over digests (graph, part, x): a header's in order as one list, data through buckets, as it has no bound."""
    rows = rows.where("x is not null")
    meta = rows.where("part = 'meta'").groupBy(*GRAPH).agg(sequence_identity(F.collect_list("x")).alias("identity"))
    return meta.unionByName(I.bucketed_identity(rows.where("part = 'data'"), "x", tuple(GRAPH)))


def build(rows: DataFrame, headers: DataFrame, curies: DataFrame) -> Store:
    """Identities and relations of all graphs.

    ``headers``: (graph, uri, first_seen); ``curies``: (graph, prefix, namespace).  A half without rows has no identity and no relation.
    """
    rows = cut(parted(rows, headers))
    named = I.with_triple_identity(rows.where("s is not null and o_blank is null"))
    nodes, _ = I.bnode_records(rows)
    nodes = cut(nodes)
    own = nodes.select(F.col("node").alias("s_blank"), F.col("condensed").alias("subgraph"))
    to = nodes.select(F.col("node").alias("o_blank"), F.col("condensed").alias("o_subgraph"))
    conn = rows.where("s is not null and o_blank is not null").join(to, "o_blank").withColumn("pair_identity", h(F.concat(h("p"), F.col("o_subgraph"))))
    conn = conn.withColumn("triple_identity", triple_identity(F.col("pair_identity")))

    def half(df, name):
        """Condensed and embedded identities of each subject's rows of one kind."""
        got = df.groupBy(*RECORD).agg(sequence_identity(F.collect_list("pair_identity")).alias(f"{name}_condensed"), F.count(F.lit(1)).alias(f"n_{name}"))
        return got.withColumn(name, h(F.concat(h("s"), F.col(f"{name}_condensed"))))

    both = half(named.select(*RECORD, "pair_identity").distinct(), "named").join(half(conn.select(*RECORD, "pair_identity", "o_blank"), "blank"), RECORD, "full")
    records = cut(both.withColumn("combined", either(F.col("named"), F.col("blank"))).fillna(0, ["n_named", "n_blank"]))

    at = rows.where("s_blank is not null").select(*GRAPH, F.col("s_blank").alias("node")).union(rows.where("o_blank is not null").select(*GRAPH, "o_blank")).distinct()
    loose = at.join(nodes.where("parents = 0 or parents > 1"), "node").select(*GRAPH, F.col("condensed").alias("x"))
    named_graph = _halves(records.select(*GRAPH, F.col("named").alias("x"))).withColumnRenamed("identity", "named_graph")
    blank_graph = _halves(records.select(*GRAPH, F.col("blank").alias("x")).unionByName(loose)).withColumnRenamed("identity", "blank_graph")
    counts = rows.groupBy(*GRAPH).agg(F.count(F.when(F.col("s").isNotNull() & F.col("o_blank").isNull(), 1)).alias("n_named"), F.count(F.when(F.col("s").isNull() | F.col("o_blank").isNotNull(), 1)).alias("n_blank"))
    graphs = cut(named_graph.join(blank_graph, GRAPH, "full").join(counts, GRAPH).withColumn("combined", either(F.col("named_graph"), F.col("blank_graph"))))

    local = I.curies_identity(curies, ["graph"]).select("graph", F.col("identity").alias("conventions"), F.col("n").alias("n_curies"))
    meta = graphs.where("part = 'meta'").select("graph", F.col("combined").alias("metadata"))
    data = graphs.where("part = 'data'").select("graph", F.col("combined").alias("whole"), (F.col("n_named") + F.col("n_blank")).alias("n"))
    top = data.join(local, "graph", "left").join(meta, "graph", "left").join(headers.select("graph", "uri", "first_seen"), "graph")
    top = cut(top.withColumn("release", either(F.col("whole"), F.col("conventions"))))

    edge = lambda df, s, p, o: df.select(F.col(s).alias("s"), F.lit(p).alias("p"), F.col(o).alias("o")).where("s is not null and o is not null")
    inner = records.join(graphs.select(*GRAPH, "named_graph", "blank_graph"), GRAPH)
    relations = [
        edge(top, "release", WHOLE_GRAPH, "whole"), edge(top, "release", METADATA, "metadata"), edge(top, "release", CONVENTIONS, "conventions"),
        edge(graphs, "combined", NAMED_GRAPH, "named_graph"), edge(graphs, "combined", BLANK_GRAPH, "blank_graph"),
        edge(inner, "named_graph", NAMED_RECORD, "named"), edge(inner, "blank_graph", BLANK_RECORD, "blank"),
        edge(records, "combined", NAMED_RECORD, "named"), edge(records, "combined", BLANK_RECORD, "blank"),
        edge(records, "named", CONDENSED, "named_condensed"), edge(records, "blank", CONDENSED, "blank_condensed"),
    ]
    ident = lambda df, c, kind, n: df.where(F.col(c).isNotNull()).select("graph", F.col(c).alias("identity"), F.lit(kind).alias("type"), F.col(n).alias("n") if isinstance(n, str) else n.alias("n"))
    total = F.col("n_named") + F.col("n_blank")
    kinds = [
        ident(top, "release", RELEASE, "n"), ident(top, "conventions", "local_conventions", "n_curies"), ident(graphs, "combined", "graph_combined", total),
        ident(graphs, "named_graph", "named_embedded_seq", "n_named"), ident(graphs, "blank_graph", "bnode_conn_free_seq", "n_blank"),
        ident(records, "named", "named_embedded", "n_named"), ident(records, "named_condensed", "named_condensed", "n_named"),
        ident(records, "blank", "bnode_embedded", "n_blank"), ident(records, "blank_condensed", "bnode_condensed", "n_blank"), ident(records, "combined", "record_combined", total),
    ]
    every = kinds[0]
    for x in kinds[1:]:
        every = every.unionByName(x)
    every = every.join(small_or_plain(headers.select("graph", "first_seen")), "graph").groupBy("identity", "type").agg(F.max("n").alias("n"), F.min("first_seen").alias("first_seen"))
    edges = relations[0]
    for x in relations[1:]:
        edges = edges.unionByName(x)

    keyed = lambda df, half: df.select(*RECORD, "triple_identity").distinct().join(records.select(*RECORD, F.col(half).alias("record")), RECORD).select("record", "triple_identity").distinct()
    none = F.lit(None).cast("binary")
    content = rows.where("s_blank is not null").join(own, "s_blank").join(to, "o_blank", "left").select("subgraph", *VALUES, "o_subgraph").distinct()
    return Store(
        cut(edges.distinct()), cut(every),
        cut(named.select("triple_identity", "s", *VALUES, none.alias("o_subgraph")).unionByName(conn.select("triple_identity", "s", *VALUES, "o_subgraph")).dropDuplicates(["triple_identity"])),
        cut(keyed(named, "named").union(keyed(conn, "blank"))), cut(content), records, top.select("graph", "uri", "first_seen", "release", "metadata"),
    )


def _up(store: Store) -> DataFrame:
    """Edges from a part to what holds it; metadata doesn't lead to the release that it describes, nor a record to one by itself."""
    return store.relations.where(F.col("p") != METADATA).select(F.col("o").alias("a"), F.col("s").alias("b"))


def metadata_of(store: Store) -> DataFrame:
    """(release, uri, type, title, version, version_iri): down from a release to its metadata's named record and that record's triples."""
    step = lambda df, p, at, to: df.join(store.relations.where(F.col("p") == p).select(F.col("s").alias(at), F.col("o").alias(to)), at)
    down = store.relations.where(F.col("p") == METADATA).select(F.col("s").alias("release"), F.col("o").alias("graph"))
    down = step(step(down, NAMED_GRAPH, "graph", "half"), NAMED_RECORD, "half", "record").select("release", "record")
    rows = down.join(store.record_triples, "record").join(store.triples, "triple_identity")
    value = lambda p: F.min(F.when(F.col("p") == p, F.coalesce("o", "o_lit")))
    return rows.groupBy("release", F.col("s").alias("uri")).agg(
        value("rdf:type").alias("type"), value("dc:title").alias("title"), value("owl:versionInfo").alias("version"), value("owl:versionIRI").alias("version_iri")
    )


def sources_of(store: Store, subjects: DataFrame) -> DataFrame:
    """For each of ``subjects`` (s) each release that says anything about it: s, release, first_seen and the release's metadata.

    Found by walking up the relations from the identities of the subject's records, named and blank, to identities of releases.
    """
    own = store.triples.join(subjects.select("s").distinct(), "s", "left_semi").select("s", "triple_identity")
    records = cut(own.join(store.record_triples, "triple_identity").select("s", "record").distinct())
    met = reach(_up(store), records.select(F.col("record").alias("start"), F.col("record").alias("node")))
    ends = store.identities.where(F.col("type") == RELEASE).select(F.col("identity").alias("node"), "first_seen")
    found = met.join(small_or_plain(ends), "node").select(F.col("start").alias("record"), F.col("node").alias("release"), "first_seen")
    pairs = records.join(found, "record").select("s", "release", "first_seen").distinct()
    return pairs.join(small_or_plain(cut(metadata_of(store)), 4096), "release", "left")


def versions_of(store: Store, subjects: DataFrame) -> DataFrame:
    """Distinct versions of each of ``subjects`` (s), told apart by both halves of its record.

    s, record (combined identity of the halves), graph (identity of the version's rows as a graph), triple_count (rows of the subject and
    of all blank nodes below it, equal subgraphs once), sources (array of uri, title, first_seen of the releases that have this version, the
    earliest first), place (of the version among the subject's, the earliest first).
    """
    own = store.records.where("part = 'data'").join(subjects.select("s").distinct(), "s", "left_semi")
    versions = cut(own.select("s", "named", "blank", "combined").distinct())
    conn = store.record_triples.join(store.triples.where("o_subgraph is not null"), "triple_identity").select(F.col("record").alias("blank"), F.col("o_subgraph").alias("node"), "triple_identity")
    conn = cut(conn.join(versions.select("blank").distinct(), "blank", "left_semi"))
    links = store.subgraphs.where("o_subgraph is not null").select(F.col("subgraph").alias("a"), F.col("o_subgraph").alias("b")).distinct()
    below = reach(links, conn.select(F.col("blank").alias("start"), "node"))
    sizes = store.subgraphs.groupBy(F.col("subgraph").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    inner = below.join(sizes, "node").groupBy(F.col("start").alias("blank")).agg(F.sum("n").alias("n_below"))
    linked = store.record_triples.groupBy("record").agg(F.count(F.lit(1)).alias("n"))
    # nodes with several parents within the version count once more in the identity of its blank half
    parents = below.select("start", F.col("node").alias("a")).join(store.subgraphs.where("o_subgraph is not null").select(F.col("subgraph").alias("a"), "p", F.col("o_subgraph").alias("node")).distinct(), "a").select("start", "node")
    parents = parents.unionByName(conn.select(F.col("blank").alias("start"), "node")).groupBy("start", "node").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    digests = parents.select("start", F.col("node").alias("x")).unionByName(versions.where("blank is not null").select(F.col("blank").alias("start"), F.col("blank").alias("x")).distinct())
    half = digests.groupBy("start").agg(sequence_identity(F.collect_list("x")).alias("identity"))
    counted = versions.join(linked.withColumnsRenamed({"record": "named", "n": "n_named"}), "named", "left").join(linked.withColumnsRenamed({"record": "blank", "n": "n_conn"}), "blank", "left")
    counted = counted.join(inner, "blank", "left").join(half.withColumnsRenamed({"start": "blank", "identity": "blank_half"}), "blank", "left").fillna(0, ["n_named", "n_conn", "n_below"])
    named_half = F.when(F.col("named").isNotNull(), h("named"))
    every = counted.select("s", "combined", either(named_half, F.col("blank_half")).alias("graph_identity"), (F.col("n_named") + F.col("n_conn") + F.col("n_below")).alias("triple_count"))
    title = cut(metadata_of(store).select("release", "title"))
    where_ = own.select("s", "combined", "graph").join(small_or_plain(store.sources.join(title, "release", "left"), 1024), "graph")
    lists = where_.groupBy("s", "combined").agg(F.sort_array(F.collect_set(F.struct("first_seen", "uri", "title"))).alias("sources"))
    out = every.join(lists, ["s", "combined"])
    place = F.row_number().over(W.partitionBy("s").orderBy(F.col("sources")[0]["first_seen"], low("combined")))
    return out.select("s", F.col("combined").alias("record"), F.col("graph_identity").alias("graph"), "triple_count", "sources", place.alias("place"))


def header_identities(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """The nine identities of each graph's metadata, with counts; a graph whose metadata has several named subjects is an error.

    graph, type, identity, n, kept: six types are stored, those without rows are not.  ``rows`` are metadata graphs: every row counts.
    """
    rows = cut(_scoped(rows))
    many = rows.where("s is not null").groupBy("graph").agg(F.count_distinct("s").alias("k"), F.min("s").alias("a"), F.max("s").alias("b")).where("k > 1").limit(1).collect()
    if many:
        raise ValueError(f"{many[0].k} subjects in the metadata of {many[0].graph}: {many[0].a}, {many[0].b}")
    own = headers.select("graph", F.col("uri").alias("head"))
    nodes, _ = I.bnode_records(rows)
    to = nodes.select(F.col("node").alias("o_blank"), "condensed", "parents")
    tops = rows.where("s is not null").join(to, "o_blank", "left")
    obj = F.when(F.col("o_blank").isNotNull(), F.col("condensed")).otherwise(object_identity())
    pairs = tops.select("graph", "s", pair_identity(obj).alias("pair"), F.col("o_blank").isNotNull().alias("blank"))
    # one blank object named twice is two rows of one pair; equal rows have gone with `distinct`
    some = lambda c: sequence_identity(F.collect_list(F.when(c, F.col("pair"))))
    per = pairs.groupBy("graph", "s").agg(
        sequence_identity(F.collect_list("pair")).alias("condensed"), some(~F.col("blank")).alias("named_condensed"), some(F.col("blank")).alias("bnode_condensed"),
        F.count(F.lit(1)).alias("pairs"), F.count(F.when(~F.col("blank"), 1)).alias("n_named"), F.count(F.when(F.col("blank"), 1)).alias("n_conn"),
    )
    embedded = lambda c: h(F.concat(h("s"), F.col(c)))
    per = per.withColumn("embedded", embedded("condensed")).withColumn("named_embedded", embedded("named_condensed")).withColumn("bnode_embedded", embedded("bnode_condensed"))
    loose = rows.where("s_blank is not null").select("graph", F.col("s_blank").alias("node")).distinct().join(nodes.where("parents = 0 or parents > 1"), "node")
    digests = per.where("n_conn > 0").select("graph", F.col("bnode_embedded").alias("x")).unionByName(loose.select("graph", F.col("condensed").alias("x")))
    bnode = digests.groupBy("graph").agg(sequence_identity(F.collect_list("x")).alias("identity"))
    inner = rows.where("s is null").groupBy("graph").agg(F.count(F.lit(1)).alias("n_inner"))
    one = own.join(per, (per["graph"] == own["graph"]) & (F.col("s") == F.col("head")), "left").drop(per["graph"])
    one = one.join(bnode.withColumnRenamed("identity", "bnode"), "graph", "left").join(inner, "graph", "left").fillna(0, ["pairs", "n_named", "n_conn", "n_inner"])
    none = null_identity()
    named_ = F.col("n_named") > 0
    n_blank = F.col("n_conn") + F.col("n_inner")
    seq = h  # identity of a list of one
    total = F.col("n_named") + n_blank
    kinds = (
        ("metadata_graph", F.when(F.col("pairs") > 0, seq("embedded")).otherwise(none), total, False),
        ("embedded", F.coalesce("embedded", none), total, False), ("condensed", F.coalesce("condensed", none), total, False),
        ("graph_combined", either(F.when(named_, seq("named_embedded")), F.col("bnode")), total, True),
        ("named_embedded_seq", F.when(named_, seq("named_embedded")).otherwise(none), F.col("n_named"), True),
        ("named_embedded", F.when(named_, F.col("named_embedded")).otherwise(none), F.col("n_named"), True),
        ("named_condensed", F.when(named_, F.col("named_condensed")).otherwise(none), F.col("n_named"), True),
        ("bnode_conn_free_seq", F.coalesce("bnode", none), n_blank, True),
        ("bnode_condensed", F.when(F.col("n_conn") > 0, F.col("bnode_condensed")).otherwise(none), n_blank, True),
    )
    each = F.array(*[F.struct(F.lit(t).alias("type"), i.alias("identity"), n.alias("n"), (F.lit(k) & (n > 0)).alias("kept")) for t, i, n, k in kinds])
    return one.select("graph", F.explode(each).alias("x")).select("graph", "x.type", "x.identity", "x.n", "x.kept")


def records_from(store: Store, wanted: DataFrame) -> DataFrame:
    """Rows of the records with ``wanted`` (record) combined identities, rebuilt from the relations and content alone.

    record, s or s_subgraph, p, o, o_lit, datatype, language, o_subgraph: down to both halves, to their triples, and from those to all
    subgraphs below by way of content.  Equal subgraphs of a record are one.
    """
    halves = store.relations.where(F.col("p").isin(NAMED_RECORD, BLANK_RECORD)).select(F.col("s").alias("record"), F.col("o").alias("half"))
    halves = cut(wanted.select("record").distinct().join(halves, "record"))
    rows = store.record_triples.withColumnRenamed("record", "half").join(halves, "half").join(store.triples, "triple_identity")
    top = cut(rows.select("record", "s", F.lit(None).cast("binary").alias("s_subgraph"), *VALUES, "o_subgraph"))
    links = store.subgraphs.where("o_subgraph is not null").select(F.col("subgraph").alias("a"), F.col("o_subgraph").alias("b")).distinct()
    below = reach(links, top.where("o_subgraph is not null").select(F.col("record").alias("start"), F.col("o_subgraph").alias("node")))
    inner = below.withColumnsRenamed({"start": "record", "node": "subgraph"}).join(store.subgraphs, "subgraph")
    return top.unionByName(inner.select("record", F.lit(None).cast("string").alias("s"), F.col("subgraph").alias("s_subgraph"), *VALUES, "o_subgraph"))


def identity_walk(store: Store, starts: DataFrame, up: bool = False, types: list[str] | None = None, predicates: list[str] | None = None) -> DataFrame:
    """(start, s, p, o): relations that a walk down (or up) from each of ``starts`` (start) meets.

    Types of the far end and predicates are filtered after the walk, so what is left out still leads on.
    """
    src, dst = ("o", "s") if up else ("s", "o")
    edges = store.relations
    pairs = reach(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")), starts.select("start", F.col("start").alias("node")))
    met = pairs.withColumnRenamed("node", src).join(edges, src).select("start", "s", "p", "o")
    if predicates is not None:
        met = met.where(F.col("p").isin(*predicates))
    if types is not None:
        ok = store.identities.where(F.col("type").isin(*types)).select(F.col("identity").alias(dst)).distinct()
        met = met.join(ok, dst, "left_semi").select("start", "s", "p", "o")
    return met
