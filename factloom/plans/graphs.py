"""Closures, identities, blank nodes, versions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.identity import h, joined, low
from ..operators import closure as C
from ..operators import identities as I
from ..operators import lookup as L
from ..operators import versions as V
from ..sources import triplify
from .base import graph_rows, head_log, query, table, triples

PART_OF = "ex:partOf"
ASIA = "region WHERE r_name = 'ASIA'"


def asia(spark, d):
    return table(spark, d, "region").where("r_name = 'ASIA'").select(triplify.iri("region", "r_regionkey").alias("node"))


def places(spark, d, *more):
    return triples(spark, d, "region", "nation", "customer", "supplier", *more)


@query(f"""WITH RECURSIVE e AS (SELECT s, p, o FROM places WHERE p = 'ex:partOf'),
 w AS (SELECT 'http://ex.org/region/' || r_regionkey AS node FROM {ASIA} UNION SELECT e.s FROM w JOIN e ON e.o = w.node), f AS (SELECT DISTINCT e.* FROM e JOIN w ON e.o = w.node)
 SELECT f.s, f.p, f.o, max(x.o_lit) AS label FROM f LEFT JOIN places x ON x.s = f.s AND x.p = 'rdfs:label' GROUP BY f.s, f.p, f.o""", "places", recursive=True)
def entry_part_of_asia(spark, d):
    """Everything that is part of Asia at any depth, with labels."""
    t = places(spark, d)
    found = C.transitive_closure(t.where(F.col("p") == PART_OF), asia(spark, d), direction="object")
    names = t.where("p = 'rdfs:label'").select("s", F.col("o_lit").alias("label"))
    return found.join(names, "s", "left").select("s", "p", "o", "label")


@query(f"SELECT s, p, o FROM places WHERE p = 'ex:partOf' AND o IN (SELECT 'http://ex.org/region/' || r_regionkey FROM {ASIA})", "places")
def g1_closure_one_hop(spark, d):
    return C.transitive_closure(places(spark, d).where("p = 'ex:partOf'"), asia(spark, d), "object", 0)


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS s, p_partkey // 2 AS o FROM part WHERE p_partkey > 1), w AS (SELECT p_partkey AS node FROM part UNION SELECT e.o FROM w JOIN e ON e.s = w.node)
 SELECT DISTINCT CAST(e.s AS VARCHAR) AS s, CAST(e.o AS VARCHAR) AS o FROM e JOIN w ON e.s = w.node""")
def g11_superclass_ladder(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part").select("p_partkey")
    edges = part.where(k > 1).select(k.cast("string").alias("s"), F.lit(triplify.SUB).alias("p"), F.floor(k / 2).cast("string").alias("o"))
    return C.transitive_closure(edges, part.select(k.cast("string").alias("node"))).select("s", "o")


@query("""SELECT 'http://ex.org/supplier/' || s_suppkey AS s, p, 'http://ex.org/nation/' || s_nationkey AS o FROM supplier, (VALUES ('ex:partOf', 1), ('ex:locatedIn', 3)) v(p, k) WHERE s_suppkey % k = 0
 UNION SELECT 'http://ex.org/supplier/' || s_suppkey, p, 'http://ex.org/nation/' || (s_nationkey + 100) FROM supplier, (VALUES ('ex:partOf', 1), ('ex:locatedIn', 3)) v(p, k) WHERE s_suppkey % k = 0 AND s_suppkey % 5 = 0""")
def g4_lift_restrictions(spark, d):
    """Some restrictions have two properties, some two values: every pair is lifted."""
    t = triplify.with_blanks(spark, d)
    k = F.regexp_extract("s_blank", "^r([0-9]+)$", 1).cast("long")
    also = t.where(k % 3 == 0).where("p = 'owl:onProperty'").withColumn("o", F.lit("ex:locatedIn"))
    more = t.where(k % 5 == 0).where("p = 'owl:someValuesFrom'").withColumn("o", F.concat(F.lit("http://ex.org/nation/"), (F.expr("try_cast(substring_index(o, '/', -1) AS bigint)") + 100).cast("string")))
    return C.lift_restrictions(t.unionByName(also).unionByName(more))


@query("""SELECT DISTINCT 'http://ex.org/supplier/' || s_suppkey AS s, 'http://ex.org/nation/' || s_nationkey AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def g2_closure_lifted(spark, d):
    lifted = C.lift_restrictions(triplify.with_blanks(spark, d))
    starts = places(spark, d).where("p = 'ex:partOf'").join(asia(spark, d).withColumnRenamed("node", "o"), "o", "left_semi").select(F.col("s").alias("node"))
    return C.transitive_closure(lifted, starts, "object").select("s", "o")


@query(f"""WITH RECURSIVE e AS (SELECT s, p, o FROM places WHERE p = 'ex:partOf'),
 w AS (SELECT 'http://ex.org/region/' || r_regionkey AS node FROM {ASIA} UNION SELECT e.s FROM w JOIN e ON e.o = w.node), f AS (SELECT DISTINCT e.* FROM e JOIN w ON e.o = w.node),
 m AS (SELECT s AS x FROM f UNION SELECT o FROM f UNION SELECT p FROM f)
 SELECT s, p, o, CAST(NULL AS VARCHAR) AS o_lit FROM f UNION SELECT s, p, o, o_lit FROM places WHERE p IN ('rdf:type', 'rdfs:label') AND s IN (SELECT x FROM m)""", "places", recursive=True)
def g5_transitive_with_metadata(spark, d):
    t = places(spark, d)
    return C.with_labels_and_types(C.transitive_closure(t.where("p = 'ex:partOf'"), asia(spark, d), "object"), t)


@query("SELECT 'c' || c_custkey AS s, 'n' || c_nationkey AS o, 'record' AS s_type, 'graph' AS o_type FROM customer WHERE c_nationkey < 3")
def g6_identity_up(spark, d):
    cust = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("s"), F.lit("in").alias("p"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("o"))
    kinds = cust.select("s", F.lit("record")).union(cust.select("o", F.lit("graph")).distinct()).toDF("node", "type")
    starts = cust.where("o in ('n0', 'n1', 'n2')").select(F.col("o").alias("node")).distinct()
    return C.identity_walk(cust, kinds, starts, "object", "graph").select("s", "o", "s_type", "o_type")


@query("""WITH RECURSIVE e AS (SELECT s, o FROM places WHERE p = 'ex:partOf'), w AS (SELECT s AS a, o AS b FROM e UNION SELECT w.a, e.o FROM w JOIN e ON e.s = w.b)
 SELECT b AS s, count(*) AS n_below, min(a) AS first FROM w GROUP BY b""", "places", recursive=True)
def g14_descendants(spark, d):
    pairs = C.all_pairs(places(spark, d).where("p = 'ex:partOf'").select("s", "o"))
    return pairs.groupBy(F.col("b").alias("s")).agg(F.count(F.lit(1)).alias("n_below"), F.min("a").alias("first"))


@query("SELECT s AS node, CAST(CASE WHEN s LIKE '%/region/%' THEN 0 WHEN s LIKE '%/nation/%' THEN 1 ELSE 2 END AS INTEGER) AS level FROM places WHERE p = 'rdf:type'", "places")
def g16_levels(spark, d):
    return C.topological_levels(places(spark, d).where("p = 'ex:partOf'"))


@query("SELECT s, p, o, pair, triple FROM ids", "ids")
def i1_triple_identity(spark, d):
    return I.with_triple_identity(triples(spark, d)).select("s", "p", "o", low("pair_identity").alias("pair"), low("triple_identity").alias("triple"))


RECORDS = "SELECT s, sha256(unhex(string_agg(pair, '' ORDER BY pair))) AS condensed, count(*) AS n FROM (SELECT DISTINCT s, pair FROM ids) GROUP BY s"


@query(f"SELECT s, condensed, n, sha256(unhex(sha256(s)) || unhex(condensed)) AS embedded FROM ({RECORDS})", "ids")
def i2_named_records(spark, d):
    return I.named_records(triples(spark, d)).select("s", low("condensed").alias("condensed"), "n", low("embedded").alias("embedded"))


def buckets(source: str) -> str:
    """SQL of the bucketed identity of (g, x): digests by six leading digits, those by three, then all."""
    step = "SELECT g, substr(k, 1, {n}) AS k, sha256(unhex(string_agg(x, '' ORDER BY k, x))) AS x FROM ({t}) GROUP BY g, substr(k, 1, {n})"
    t = f"SELECT g, x AS k, x FROM ({source})"
    for n in (6, 3, 0):
        t = step.format(n=n, t=t)
    return t


@query(f"""SELECT x AS named, sha256(unhex(x) || unhex(sha256(''))) AS graph FROM ({buckets(f"SELECT '' AS g, sha256(unhex(sha256(s)) || unhex(condensed)) AS x FROM ({RECORDS})")})""", "ids")
def i4_graph_identity(spark, d):
    import hashlib

    t = triples(spark, d)
    named = I.sequence_of(I.named_records(t), "embedded")
    return t.sparkSession.createDataFrame([(named.hex(), hashlib.sha256(named + hashlib.sha256(b"").digest()).hexdigest())], "named string, graph string")


def _pair(p, obj):
    return f"sha256(unhex(sha256('{p}')) || unhex({obj}))"


_LIT = "sha256(unhex(sha256({0})) || unhex(sha256('')) || unhex(sha256('')))"
RESTRICTION = f"""sha256(unhex(list_aggregate(list_sort([{_pair('rdf:type', "sha256('owl:Restriction')")}, {_pair('owl:onProperty', "sha256('ex:partOf')")}, {_pair('owl:someValuesFrom', "sha256('http://ex.org/nation/' || s_nationkey)")}]), 'string_agg', '')))"""
PLACE = f"sha256(unhex({_pair('ex:partOf', '''sha256('http://ex.org/nation/' || c_nationkey)''')}))"
ADDRESS = f"sha256(unhex(list_aggregate(list_sort([{_pair('ex:segment', _LIT.format('c_mktsegment'))}, {_pair('ex:place', PLACE)}]), 'string_agg', '')))"


@query(f"SELECT 'r' || s_suppkey AS node, {RESTRICTION} AS condensed FROM supplier UNION ALL SELECT 'c' || c_custkey, {PLACE} FROM customer UNION ALL SELECT 'a' || c_custkey, {ADDRESS} FROM customer")
def i3_bnode_identity(spark, d):
    nodes, _ = I.bnode_records(triplify.with_blanks(spark, d))
    return nodes.select("node", low("condensed").alias("condensed"))


@query(f"SELECT 'http://ex.org/customer/' || c_custkey AS s, sha256(unhex(sha256('http://ex.org/customer/' || c_custkey)) || unhex(sha256(unhex({_pair('ex:address', ADDRESS)})))) AS embedded FROM customer UNION ALL SELECT 'http://ex.org/supplier/' || s_suppkey, sha256(unhex(sha256('http://ex.org/supplier/' || s_suppkey)) || unhex(sha256(unhex({_pair('rdfs:subClassOf', RESTRICTION)})))) FROM supplier")
def i3_bnode_embedded(spark, d):
    _, embedded = I.bnode_records(triplify.with_blanks(spark, d))
    return embedded.select("s", low("embedded").alias("embedded"))


@query(f"SELECT 'http://ex.org/supplier/' || s_suppkey AS s, sha256(unhex(sha256(unhex(sha256('http://ex.org/supplier/' || s_suppkey)) || unhex(sha256(unhex({_pair('rdfs:label', _LIT.format('s_name'))}))))) || unhex(sha256(unhex(sha256('http://ex.org/supplier/' || s_suppkey)) || unhex(sha256(unhex({_pair('rdfs:subClassOf', RESTRICTION)})))))) AS combined FROM supplier")
def i4_record_combined(spark, d):
    t = triplify.with_blanks(spark, d)
    _, embedded = I.bnode_records(t)
    sup = t.where("s like '%/supplier/%'")
    return I.record_combined(I.named_records(sup.where("o_blank is null")), embedded.where("s like '%/supplier/%'")).select("s", low("combined").alias("combined"))


@query(f"SELECT 'http://ex.org/supplier/' || s_suppkey AS s, sha256(unhex(sha256('http://ex.org/supplier/' || s_suppkey)) || unhex({_pair('rdfs:subClassOf', RESTRICTION)})) AS identity FROM supplier")
def i1_conn_identity(spark, d):
    t = triplify.with_blanks(spark, d)
    nodes, _ = I.bnode_records(t)
    return I.conn_identities(t.where("s is null or p = 'rdfs:subClassOf'"), nodes).select("s", low("triple_identity").alias("identity"))


@query("SELECT r_name AS k, sha256(unhex(string_agg(x, '' ORDER BY x))) AS identity, count(*) AS n FROM (SELECT r_name, sha256(unhex(sha256(n_name)) || unhex(sha256('http://ns/' || n_nationkey))) AS x FROM nation JOIN region ON r_regionkey = n_regionkey) GROUP BY r_name")
def i5_curies_identity(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("r_name").alias("k"), F.col("n_name").alias("prefix"), F.concat(F.lit("http://ns/"), F.col("n_nationkey").cast("string")).alias("namespace"))
    return I.curies_identity(rows, ["k"]).select("k", low("identity").alias("identity"), "n")


@query(f"SELECT condensed, count(*) AS n, max(k) AS last FROM (SELECT condensed, row_number() OVER (PARTITION BY condensed ORDER BY node) - 1 AS k FROM (SELECT 'r' || s_suppkey AS node, {RESTRICTION} AS condensed FROM supplier)) GROUP BY condensed")
def w3_bnode_replicas(spark, d):
    nodes, _ = I.bnode_records(triplify.with_blanks(spark, d).where("s_blank like 'r%' or s like '%/supplier/%'"))
    return I.replicas(nodes).groupBy(low("condensed").alias("condensed")).agg(F.count(F.lit(1)).alias("n"), F.max("replica").cast("long").alias("last"))


@query("SELECT 'a' || c_custkey AS root, 'a' || c_custkey AS node, 0 AS local FROM customer UNION ALL SELECT 'a' || c_custkey, 'c' || c_custkey, 1 FROM customer UNION ALL SELECT 'r' || s_suppkey, 'r' || s_suppkey, 0 FROM supplier")
def w4_local_integers(spark, d):
    return I.local_integers(triplify.with_blanks(spark, d))


@query("SELECT 'http://ex.org/customer/' || c_custkey AS s, CAST(1 AS BIGINT) AS links, CAST(2 AS BIGINT) AS below FROM customer")
def g7_subject_subgraphs(spark, d):
    """Rows of subjects and of all blank nodes below them: a walk over links, then the rows."""
    t = triplify.with_blanks(spark, d)
    own = t.where("s like '%/customer/%'")
    links = t.where("s_blank is not null and o_blank is not null").select(F.col("s_blank").alias("s"), "p", F.col("o_blank").alias("o"))
    start = own.select(F.col("o_blank").alias("node"))
    walk = C.transitive_closure(links, start)
    nodes = start.join(own.select("s", F.col("o_blank").alias("node")), "node").union(walk.join(own.select(F.col("s").alias("top"), F.col("o_blank").alias("s")), "s").select("o", "top")).toDF("node", "s").distinct()
    rows = nodes.join(t.where("s_blank is not null").select(F.col("s_blank").alias("node"), "p"), "node")
    below = rows.groupBy("s").agg(F.count_distinct("node").alias("below"))
    return own.groupBy("s").agg(F.count(F.lit(1)).alias("links")).join(below, "s")


@query("SELECT 'http://ex.org/supplier/' || s_suppkey AS s, 'rdfs:label' AS p, s_name AS v FROM supplier UNION ALL SELECT 'http://ex.org/supplier/' || s_suppkey, 'rdfs:subClassOf', NULL FROM supplier UNION ALL SELECT NULL, p, o FROM supplier, (VALUES ('rdf:type', 'owl:Restriction'), ('owl:onProperty', 'ex:partOf')) x(p, o) UNION ALL SELECT NULL, 'owl:someValuesFrom', 'http://ex.org/nation/' || s_nationkey FROM supplier")
def j11_graph_from_subjects(spark, d):
    t = triplify.with_blanks(spark, d)
    asked = table(spark, d, "supplier").select(triplify.iri("supplier", "s_suppkey").alias("s"))
    return L.graph_from_subjects(t, asked).select("s", "p", F.coalesce("o", "o_lit").alias("v"))


@query("SELECT 'http://ex.org/supplier/' || s_suppkey AS s, 'r' || s_suppkey AS blank, 'http://ex.org/nation/' || s_nationkey AS o FROM supplier")
def j25_subgraph_expansion(spark, d):
    t = triplify.with_blanks(spark, d)
    own = t.where("s is not null and o_blank is not null").select("s", F.col("o_blank").alias("s_blank"))
    return t.where("p = 'owl:someValuesFrom'").select("s_blank", "o").join(own, "s_blank").select("s", F.col("s_blank").alias("blank"), "o")


@query("SELECT s, p, coalesce(o, o_lit) AS v FROM triples WHERE s LIKE 'http://ex.org/nation/%' UNION ALL SELECT 'http://ex.org/onto', 'dc:title', 'nations'", "triples")
def g10_ontology_from_spec(spark, d):
    spec = V.make_spec(table(spark, d, "nation").groupBy().agg(F.collect_list(triplify.iri("nation", "n_nationkey")).alias("subjects")).select(
        F.lit("http://ex.org/onto/spec").alias("uri"), F.lit("nations").alias("title"), "subjects"))
    return V.ontology_from_spec(spec, triples(spark, d)).select("s", "p", F.coalesce("o", "o_lit").alias("v"))


@query("SELECT 'http://ex.org/spec/' || r_regionkey AS s, CAST(count(*) + 2 AS BIGINT) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def v11_make_spec(spark, d):
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(triplify.iri("nation", "n_nationkey")).alias("subjects"))
    return V.make_spec(rows.select(triplify.iri("spec", "n_regionkey").alias("uri"), F.lit("t").alias("title"), "subjects")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))


VERSIONS = """WITH i AS (SELECT graph, s, sha256(unhex(sha256(s)) || unhex(sha256(unhex(sha256(p)) || unhex(CASE WHEN o IS NOT NULL THEN sha256(o) ELSE sha256(unhex(sha256(o_lit)) || unhex(sha256('')) || unhex(sha256(''))) END)))) AS t FROM graphs),
 v AS (SELECT graph, s, sha256(unhex(string_agg(t, '' ORDER BY t))) AS version, count(*) AS n FROM i GROUP BY graph, s)"""


@query(VERSIONS + " SELECT s, version, n, string_agg(graph, ',' ORDER BY graph) AS graphs FROM v GROUP BY s, version, n", "graphs")
def v2_distinct_versions(spark, d):
    return V.distinct_versions(graph_rows(spark, d)).withColumn("version", low("version"))


@query("SELECT s, string_agg(DISTINCT graph, ',' ORDER BY graph) AS graphs FROM graphs GROUP BY s", "graphs")
def v1_sources_of_subject(spark, d):
    return graph_rows(spark, d).groupBy("s").agg(F.array_join(F.sort_array(F.collect_set("graph")), ",").alias("graphs"))


@query(VERSIONS + " SELECT s, version FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY CASE graph WHEN 'g2' THEN 0 WHEN 'g0' THEN 1 ELSE 2 END, graph) AS r FROM v) WHERE r = 1", "graphs")
def v3_latest_for_group(spark, d):
    """A group's own version, else the base's, else another's."""
    v = V.distinct_versions(graph_rows(spark, d)).select("s", "version", F.explode(F.split("graphs", ",")).alias("graph"))
    rank = F.when(F.col("graph") == "g2", 0).when(F.col("graph") == "g0", 1).otherwise(2)
    return L.best(v, ["s"], [rank, "graph"]).select("s", low("version").alias("version"))


@query("""WITH a AS (SELECT s, p, coalesce(o, o_lit) AS v FROM graphs WHERE graph = 'g0'), b AS (SELECT s, p, coalesce(o, o_lit) AS v FROM graphs WHERE graph = 'g1'),
 j AS (SELECT a.s AS x, b.s AS y FROM a FULL JOIN b ON a.s = b.s AND a.p = b.p AND a.v = b.v)
 SELECT CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'same' END AS state, count(*) AS n FROM j GROUP BY 1""", "graphs")
def v4_graph_diff(spark, d):
    g = graph_rows(spark, d)
    return V.graph_diff(g.where("graph = 'g0'"), g.where("graph = 'g1'")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _patch(spark, d):
    part = table(spark, d, "part").where("p_partkey % 4 = 1")
    t = lambda p, lit, op: triplify.rule(part, triplify.iri("part", "p_partkey"), p, o_lit=lit).withColumn("op", F.lit(op))
    wrong = F.when(F.col("p_partkey") % 8 == 1, F.col("p_brand")).otherwise(F.lit("no such brand"))
    return t("ex:brand", wrong, "del").unionByName(t("ex:note", F.lit("checked"), "add"))


@query("""SELECT 'http://ex.org/part/' || p_partkey AS s, x.p, CASE WHEN x.p = 'ex:brand' AND p_partkey % 8 <> 1 THEN 'delete absent' END AS error FROM part, (VALUES ('ex:brand'), ('ex:note')) x(p) WHERE p_partkey % 4 = 1""")
def u4_check_patch(spark, d):
    return V.check_patch(triples(spark, d, "part"), _patch(spark, d)).select("s", "p", "error")


@query(f"""WITH k AS (SELECT 'http://ex.org/part/' || p_partkey AS s FROM part WHERE p_partkey % 8 = 1),
 x AS (SELECT s, pair FROM ids WHERE s IN (SELECT s FROM k) AND p <> 'ex:brand' UNION SELECT s, {_pair('ex:note', _LIT.format("'checked'"))} FROM k)
 SELECT s, sha256(unhex(string_agg(pair, '' ORDER BY pair))) AS condensed, count(*) AS n FROM x GROUP BY s""", "ids")
def v5_apply_patch(spark, d):
    return V.apply_patch(triples(spark, d, "part"), _patch(spark, d)).select("s", low("condensed").alias("condensed"), "n")


@query("SELECT perspective, subject, head FROM (SELECT *, row_number() OVER (PARTITION BY perspective, subject ORDER BY ts DESC, head DESC) AS r FROM log) WHERE r = 1 AND head <> ''", "log")
def v6_heads_from_log(spark, d):
    return V.heads(head_log(spark, d)).select("perspective", "subject", "head")


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders),
 w AS (SELECT max(o_orderkey) AS node FROM o GROUP BY o_custkey UNION SELECT o.prev FROM w JOIN o ON o.o_orderkey = w.node WHERE o.prev IS NOT NULL)
 SELECT CAST(o_orderkey AS VARCHAR) AS record, CAST(prev AS VARCHAR) AS previous FROM o JOIN w ON o_orderkey = node WHERE prev IS NOT NULL""")
def v7_history_chain(spark, d):
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), "o_orderdate")
    chain = o.withColumn("previous", F.lag("k").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "k")))
    starts = o.groupBy("o_custkey").agg(F.max("k").cast("string").alias("node")).select("node")
    history = chain.select(F.col("k").cast("string").alias("record"), F.col("previous").cast("string").alias("previous"))
    return V.history_chain(history, starts).select(F.col("s").alias("record"), F.col("o").alias("previous"))


@query("SELECT perspective, replace(subject, '/part/', '/team' || perspective || '/') AS subject, head FROM (SELECT *, row_number() OVER (PARTITION BY perspective, subject ORDER BY ts DESC, head DESC) AS r FROM log) WHERE r = 1 AND head <> '' AND perspective <> 0", "log")
def v8_variants(spark, d):
    heads = V.heads(head_log(spark, d)).where("perspective <> 0")
    mine = F.concat(F.lit("/team"), F.col("perspective").cast("string"), F.lit("/"))
    return heads.select("perspective", F.replace("subject", F.lit("/part/"), mine).alias("subject"), "head")


@query(f"SELECT g AS source, x AS identity FROM ({buckets('SELECT source AS g, sha256(CAST(doc_id AS VARCHAR)) AS x FROM documents')})")
def a3_ordered_digest(spark, d):
    """Digests of each source's documents in order, through buckets, as a source may hold a third of all rows."""
    rows = table(spark, d, "documents").select("source", h(F.col("doc_id").cast("string")).alias("x"))
    return I.bucketed_identity(rows, "x", ("source",)).select("source", low("identity").alias("identity"))


@query("SELECT s, string_agg(pair, '' ORDER BY pair) AS joined FROM (SELECT DISTINCT s, pair FROM ids) GROUP BY s", "ids")
def a12_identity_lists(spark, d):
    t = I.with_triple_identity(triples(spark, d)).select("s", "pair_identity").distinct()
    return t.groupBy("s").agg(low(joined(F.collect_list("pair_identity"))).alias("joined"))
