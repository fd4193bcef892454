"""Reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.identity import low
from ..operators import identities as I
from ..operators import lookup as L
from ..operators import reports as R
from ..sources import triplify
from ..sources.triplify import iri, rule, union
from .base import CTES, query, table, triples
from .graphs import RESTRICTION
from .merging import CU, existing_tables
from .releases import REL, _of, store

SYN = R.TABULAR["synonyms"]


@query(f"""WITH f AS (SELECT p_partkey AS k, 'http://ex.org/part/' || p_partkey AS s FROM part),
 x AS (SELECT s, 'label' AS g, p_name AS v FROM f JOIN part ON p_partkey = k UNION ALL SELECT s, 'synonyms', p_brand || ' ' || (k % 6) FROM f JOIN part ON p_partkey = k UNION ALL SELECT s, 'synonyms', 'zz' || (k % 5) FROM f WHERE k % 2 = 0 UNION ALL SELECT s, 'definition', p_type FROM f JOIN part ON p_partkey = k WHERE k % 4 > 0
   UNION ALL SELECT s, 'subClassOf', 'http://ex.org/part/' || (k // 2) FROM f WHERE k > 1 UNION ALL SELECT s, 'subClassOf', 'http://ex.org/part/' || (k // 3) FROM f WHERE k % 5 = 0 AND k > 1 UNION ALL SELECT s, 'preferred', 'http://x/' || k FROM f WHERE k % 3 = 0 UNION ALL SELECT s, 'existing', 'http://x/' || k FROM f UNION ALL SELECT s, 'existing', 'http://w/' || k FROM f WHERE k % 7 = 0 UNION ALL SELECT s, 'type', 'owl:Class' FROM f)
 SELECT s, {', '.join(f"string_agg(v, chr(31) ORDER BY v) FILTER (WHERE g = '{g}') AS {g}" for g in R.TABULAR)} FROM x GROUP BY s""")
def s14_all_columns(spark, d):
    """A row for each part with labels, synonyms of six kinds, definition, superclasses, preferred and existing iris, and type."""
    part, k, s = table(spark, d, "part"), F.col("p_partkey"), iri("part", "p_partkey")
    text = k.cast("string")
    kind = F.element_at(F.array(*[F.lit(x) for x in SYN]), (k % 6 + 1).cast("int"))
    facts = union(
        rule(part, s, "rdfs:label", o_lit=F.col("p_name")), rule(part, s, kind, o_lit=F.concat_ws(" ", "p_brand", (k % 6).cast("string"))), rule(part.where(k % 2 == 0), s, "ex:synonym", o_lit=F.concat(F.lit("zz"), (k % 5).cast("string"))),
        rule(part.where(k % 4 > 0), s, "ex:definition", o_lit=F.col("p_type")), rule(part.where(k > 1), s, "rdfs:subClassOf", o=iri("part", F.floor(k / 2))), rule(part.where((k % 5 == 0) & (k > 1)), s, "rdfs:subClassOf", o=iri("part", F.floor(k / 3))),
        rule(part.where(k % 3 == 0), s, "ex:hasPreferredId", o=F.concat(F.lit("http://x/"), text)), rule(part, s, "ex:hasExistingId", o=F.concat(F.lit("http://x/"), text)), rule(part.where(k % 7 == 0), s, "ex:hasExistingId", o=F.concat(F.lit("http://w/"), text)), rule(part, s, "rdf:type", o=F.lit("owl:Class")),
    )
    got = L.export_tabular(facts, R.TABULAR)
    return got.select("s", *[F.when(F.col(g) != "", F.col(g)).alias(g) for g in R.TABULAR])


@query("""SELECT 'http://ex.org/load' AS s, p, v FROM (SELECT unnest(['rdf:type', 'dc:title', 'ex:source', 'ex:started', 'ex:ended', 'ex:epoch', 'owl:versionInfo', 'owl:versionIRI', 'ex:tripleCount', 'ex:subjectCount']) AS p,
  unnest(['owl:Ontology', 'a load', 'tables', strftime(a, '%Y-%m-%dT%H:%M:%S'), strftime(b, '%Y-%m-%dT%H:%M:%S'), CAST(CAST(floor(epoch(b)) AS BIGINT) AS VARCHAR), strftime(b, '%Y-%m-%dT%H:%M:%S'), 'http://ex.org/load/version/' || CAST(floor(epoch(b)) AS BIGINT), CAST(n AS VARCHAR), CAST(m AS VARCHAR)]) AS v
  FROM (SELECT min(ts) AS a, max(ts) AS b FROM events), (SELECT count(*) AS n, count(DISTINCT s) AS m FROM triples))
 UNION ALL SELECT 'http://ex.org/load', 'ex:maxId/' || CASE p_partkey % 4 WHEN 0 THEN 'cde' WHEN 1 THEN 'pde' ELSE 'tx' END, CAST(max(p_partkey) AS VARCHAR) FROM part GROUP BY 2""", "triples")
def s21_load_header(spark, d):
    """All header facts of a load, with times of the events as its own and the largest id of each prefix."""
    span = table(spark, d, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    k = F.col("p_partkey")
    ids = table(spark, d, "part").select(F.when(k % 4 == 0, "cde").when(k % 4 == 1, "pde").otherwise("tx").alias("prefix"), k.alias("number"))
    return R.load_header(triples(spark, d), ids, "http://ex.org/load", "a load", "tables", F.lit(span.a).cast("timestamp"), F.lit(span.b).cast("timestamp"))


@query(f"""WITH e AS (SELECT * FROM cu_r), x AS (SELECT 'label' AS kind, lower(trim(p_name)) AS key, CAST(p_partkey AS VARCHAR) AS m FROM part UNION SELECT 'iri', iri, CAST(tid AS VARCHAR) FROM e UNION SELECT 'curies', iri, curie FROM e UNION SELECT 'versions', CAST(tid AS VARCHAR), CAST(version AS VARCHAR) FROM e
   UNION SELECT 'types', 'http://ex.org/part/' || p_partkey, unnest(['owl:Class', 'owl:NamedIndividual']) FROM part WHERE p_partkey % 9 = 0 UNION SELECT 'free subgraphs', {RESTRICTION}, 'r' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)
 SELECT kind, key, count(*) AS n, min(m) AS least FROM x GROUP BY kind, key HAVING count(*) > 1""", *CU, recursive=True)
def a4_six_groupings(spark, d):
    """Labels, iris, curies, versions, types and free subgraphs that stand several times."""
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    types = rule(part, iri("part", "p_partkey"), "rdf:type", o=F.lit("owl:Class")).unionByName(rule(part.where(k % 9 == 0), iri("part", "p_partkey"), "rdf:type", o=F.lit("owl:NamedIndividual")))
    # restrictions of suppliers with an even number hang on nothing here
    rows = triplify.with_blanks(spark, d).where("p <> 'rdfs:subClassOf' or try_cast(substring_index(s, '/', -1) AS bigint) % 2 = 1")
    nodes, _ = I.bnode_records(rows)
    return R.repeats(part.select(k.alias("id"), F.col("p_name").alias("label")), existing_tables(spark, d)[1], types, nodes)


@query("""SELECT 'a' || c_custkey AS node, CAST(2 AS BIGINT) AS as_subject, CAST(1 AS BIGINT) AS as_object, false AS dangling FROM customer UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END, 1, c_custkey % 4 = 0 FROM customer
 UNION ALL SELECT 'r' || s_suppkey, 3, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END, false FROM supplier""")
def a5_nodes_and_dangling(spark, d):
    """Blank nodes by how often they stand on either side; places of every fourth customer are named and never described."""
    t = triplify.with_blanks(spark, d)
    gone = F.coalesce((F.col("p") == "ex:partOf") & (F.expr("try_cast(substring(s_blank, 2) AS bigint)") % 4 == 0), F.lit(False)) | F.coalesce((F.col("p") == "rdfs:subClassOf") & (F.expr("try_cast(substring_index(s, '/', -1) AS bigint)") % 2 == 0), F.lit(False))
    return R.node_counts(t.where(~gone))


CTES["rel_n"] = """SELECT *, CASE WHEN k % 5 = 0 AND g >= 3 THEN 2 ELSE 1 END AS nn, CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END AS nc, 3 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS ni, DATE '2020-01-20' - CAST(2 * g AS INTEGER) AS seen FROM rel_r"""
CTES["rel_t"] = """SELECT *, CASE WHEN g <> 2 THEN 4 ELSE 3 END AS hn, CASE WHEN g <> 4 THEN 1 ELSE 0 END AS hc, CASE WHEN g <> 4 THEN 2 ELSE 0 END AS hb FROM rel_s JOIN (SELECT g, sum(nn) AS gn, sum(nc + ni) AS gb FROM rel_n GROUP BY g) USING (g) JOIN (SELECT n_regionkey AS g, count(*) AS nl FROM nation GROUP BY 1) USING (g)"""


@query("SELECT identity, type, CAST(max(n) AS BIGINT) AS n, min(seen) AS first_seen FROM (" + " UNION ALL ".join([
    *(f"SELECT {i} AS identity, '{t}' AS type, {n} AS n, first_seen AS seen FROM rel_t WHERE {i} IS NOT NULL" for i, t, n in [
        ("release", "graph_combined_local_conventions", "gn + gb"), ("conventions", "local_conventions", "nl"), ("whole", "graph_combined", "gn + gb"), ("metadata", "graph_combined", "hn + hb"), ("named_graph", "named_embedded_seq", "gn"), (_of("named"), "named_embedded_seq", "hn"),
        ("blank_graph", "bnode_conn_free_seq", "gb"), (_of("blank"), "bnode_conn_free_seq", "hb"), ("named", "named_embedded", "hn"), ("named_condensed", "named_condensed", "hn"), ("blank", "bnode_embedded", "hc"), ("blank_condensed", "bnode_condensed", "hc"), (_of("named", "coalesce(blank, sha256(''))"), "record_combined", "hn + hc")]),
    *(f"SELECT {i}, '{t}', {n}, seen FROM rel_n" for i, t, n in [("named", "named_embedded", "nn"), ("named_condensed", "named_condensed", "nn"), ("blank", "bnode_embedded", "nc"), ("blank_condensed", "bnode_condensed", "nc"), ("combined", "record_combined", "nn + nc")]),
]) + ") GROUP BY identity, type", *REL, "rel_n", "rel_t")
def a12_identity_counts(spark, d):
    """Rows of every identity: headers, data, each subject's halves, and conventions, with the time that each was first seen."""
    return store(spark, d).identities.select(low("identity").alias("identity"), "type", "n", "first_seen")


@query("""WITH p AS (SELECT page_id AS k, 'f' || page_id AS identity FROM pages)
 SELECT DISTINCT name, identity, type FROM (SELECT unnest(['http://a/' || (k // 2), 'http://b/' || k]) AS name, identity, 'pointer' AS type FROM p WHERE k % 3 > 0 UNION ALL SELECT 'http://bound/' || (k // 3), identity, 'bound' FROM p WHERE k % 5 > 0 UNION ALL SELECT 'http://bound/' || (k // 3) || '/v' || (k % 4), identity, 'bound_version' FROM p WHERE k % 4 > 0)""")
def i7_names_and_bindings(spark, d):
    """Names that point to files on the way, names bound in them, and names of their versions."""
    k = F.col("page_id")
    text = lambda a, x: F.concat(F.lit(a), x.cast("string"))
    bound = text("http://bound/", F.floor(k / 3))
    rows = table(spark, d, "pages").select(
        F.when(k % 3 > 0, F.array(text("http://a/", F.floor(k / 2)), text("http://b/", k))).otherwise(F.array().cast("array<string>")).alias("names"), F.when(k % 5 > 0, bound).alias("bound"),
        F.when(k % 4 > 0, F.concat(bound, F.lit("/v"), (k % 4).cast("string"))).alias("version"), text("f", k).alias("identity"))
    return R.name_bindings(rows)[1]
