"""Releases of a graph over the given tables: sources and versions of subjects, header identities, rebuilt records, walks over identities.

Each region is a release of two customers out of three.  A customer has named facts, and an address in blank nodes two levels deep; releases
differ in labels, and for even customers only in a fact below the second blank node.  Each release has a header of its own, most with a
credit in a blank node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.identity import low
from ..operators import identities as I
from ..operators import rebuild as B
from ..operators import releases as R
from ..sources import ntriples, triplify
from ..sources.triplify import iri
from .base import CTES, query, table, triples
from .graphs import ADDRESS, RESTRICTION, buckets

def _members(spark, d):
    """(g, r_name, k, c_name, c_mktsegment, n): which customer is in which release."""
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("g"), "r_name")
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment", F.col("c_nationkey").alias("n"))
    return cust.withColumn("g", F.explode(F.array(*[F.lit(x).cast("long") for x in range(5)]))).where("(k + g) % 3 <> 0").join(region, "g")


def _fact(df, p, s=None, sb=None, o=None, lit=None, ob=None):
    none = F.lit(None).cast("string")
    pick = lambda x: none if x is None else x
    return df.select(
        F.concat(F.lit("g"), F.col("g").cast("string")).alias("graph"), pick(s).alias("s"), F.lit(p).alias("p"), pick(o).alias("o"), pick(lit).alias("o_lit"),
        none.alias("datatype"), none.alias("language"), pick(sb).alias("s_blank"), pick(ob).alias("o_blank"),
    )


def data_rows(spark, d):
    m = _members(spark, d)
    k, g, s = F.col("k"), F.col("g"), iri("customer", "k")
    label = lambda x: F.concat(F.lit(x), k.cast("string"))
    a, c, b = label("a"), label("c"), label("b")
    return reduce(lambda x, y: x.unionByName(y), [
        _fact(m, "ex:segment", s=s, lit=F.col("c_mktsegment")), _fact(m.where((k % 5 == 0) & (g >= 3)), "rdfs:label", s=s, lit=F.col("c_name")),
        _fact(m, "ex:address", s=s, ob=a), _fact(m.where(k % 7 == 0), "ex:billing", s=s, ob=a), _fact(m, "ex:kind", sb=a, lit=F.lit("home")),
        _fact(m, "ex:place", sb=a, ob=c), _fact(m, "ex:partOf", sb=c, o=iri("nation", "n")), _fact(m.where(k % 2 == 0), "ex:zone", sb=c, lit=(g % 2).cast("string")),
        _fact(m.where(k % 3 == 0), "ex:place", sb=a, ob=b), _fact(m.where(k % 3 == 0), "ex:partOf", sb=b, o=iri("nation", (F.col("n") + 1) % 25)),
    ])


def header_rows(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("g"), "r_name")
    uri, g = iri("release", "g"), F.col("g")
    return reduce(lambda x, y: x.unionByName(y), [
        _fact(r, "rdf:type", s=uri, o=F.lit("owl:Ontology")), _fact(r, "dc:title", s=uri, lit=F.col("r_name")), _fact(r, "owl:versionInfo", s=uri, lit=F.concat(F.lit("v"), g.cast("string"))),
        _fact(r.where(g != 2), "owl:versionIRI", s=uri, o=F.concat(uri, F.lit("/version"))), _fact(r.where(g != 4), "ex:credit", s=uri, ob=F.lit("h")), _fact(r.where(g != 4), "ex:by", sb=F.lit("h"), lit=F.col("r_name")),
    ])


def headers(spark, d):
    g = F.col("r_regionkey")
    return table(spark, d, "region").select(F.concat(F.lit("g"), g.cast("string")).alias("graph"), iri("release", g).alias("uri"), F.date_add(F.lit("2020-01-20").cast("date"), (-2 * g).cast("int")).alias("first_seen"))


def store(spark, d):
    nation = table(spark, d, "nation").select(F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("graph"), F.col("n_name").alias("prefix"), F.concat(F.lit("http://ns/"), F.col("n_nationkey").cast("string")).alias("namespace"))
    return R.build(data_rows(spark, d).unionByName(header_rows(spark, d)), headers(spark, d), nation)


def subjects(spark, d):
    return table(spark, d, "customer").select(iri("customer", "c_custkey").alias("s"))


# --- the same in SQL: identities from their definitions -------------------------------------------------------------------

def _of(*digests):
    """Digest of digests put together."""
    return f"sha256({' || '.join(f'unhex({x})' for x in digests)})"


def _pair(p, obj):
    return _of(f"sha256('{p}')", obj)


def _lit(x):
    return _of(f"sha256({x})", "sha256('')", "sha256('')")


def _seq(*parts):
    """Digest of a sorted list; a part is a digest or (condition, digest)."""
    rows = ", ".join(f"CASE WHEN {x[0]} THEN {x[1]} END" if isinstance(x, tuple) else x for x in parts)
    return f"sha256(unhex(list_aggregate(list_sort(list_filter([{rows}], lambda x: x IS NOT NULL)), 'string_agg', '')))"


_NATION = "sha256('http://ex.org/nation/' || {0})"
CTES |= {
    "rel_m": "SELECT r_regionkey AS g, r_name, c_custkey AS k, c_name, c_mktsegment, c_nationkey AS n, 'http://ex.org/customer/' || c_custkey AS s FROM region, customer WHERE (c_custkey + r_regionkey) % 3 <> 0",
    "rel_b": f"SELECT *, {_seq(_pair('ex:partOf', _NATION.format('n')), ('k % 2 = 0', _pair('ex:zone', _lit('CAST(g % 2 AS VARCHAR)'))))} AS c_id, {_seq(_pair('ex:partOf', _NATION.format('((n + 1) % 25)')))} AS b_id FROM rel_m",
    "rel_a": f"SELECT *, {_seq(_pair('ex:kind', _lit(repr('home'))), _pair('ex:place', 'c_id'), ('k % 3 = 0', _pair('ex:place', 'b_id')))} AS a_id FROM rel_b",
    "rel_p": f"SELECT *, {_seq(_pair('ex:segment', _lit('c_mktsegment')), ('k % 5 = 0 AND g >= 3', _pair('rdfs:label', _lit('c_name'))))} AS named_condensed, {_seq(_pair('ex:address', 'a_id'), ('k % 7 = 0', _pair('ex:billing', 'a_id')))} AS blank_condensed FROM rel_a",
    "rel_q": f"SELECT *, {_of('sha256(s)', 'named_condensed')} AS named, {_of('sha256(s)', 'blank_condensed')} AS blank FROM rel_p",
    "rel_r": f"SELECT *, {_of('named', 'blank')} AS combined FROM rel_q",
    "rel_w": f"""SELECT a.g, a.x AS named_graph, b.x AS blank_graph, {_of('a.x', 'b.x')} AS whole FROM ({buckets('SELECT g, named AS x FROM rel_r')}) a
        JOIN ({buckets('SELECT g, blank AS x FROM rel_r UNION ALL SELECT g, a_id FROM rel_r WHERE k % 7 = 0')}) b USING (g)""",
    "rel_h": f"""SELECT *, {_of('sha256(uri)', 'named_condensed')} AS named, CASE WHEN g <> 4 THEN {_of('sha256(uri)', 'blank_condensed')} END AS blank, {_of('sha256(uri)', 'condensed')} AS embedded FROM (
        SELECT g, r_name AS title, uri, DATE '2020-01-20' - CAST(2 * g AS INTEGER) AS first_seen, 'v' || g AS version, CASE WHEN g <> 2 THEN uri || '/version' END AS version_iri,
          {_seq("kind", "name", "info", ("g <> 2", "viri"))} AS named_condensed, CASE WHEN g <> 4 THEN {_seq("credit")} END AS blank_condensed, {_seq("kind", "name", "info", ("g <> 2", "viri"), ("g <> 4", "credit"))} AS condensed
        FROM (SELECT r_regionkey AS g, r_name, 'http://ex.org/release/' || r_regionkey AS uri, {_pair('rdf:type', "sha256('owl:Ontology')")} AS kind, {_pair('dc:title', _lit('r_name'))} AS name,
          {_pair('owl:versionInfo', _lit("'v' || r_regionkey"))} AS info, {_pair('owl:versionIRI', "sha256('http://ex.org/release/' || r_regionkey || '/version')")} AS viri,
          {_pair('ex:credit', _seq(_pair('ex:by', _lit('r_name'))))} AS credit FROM region))""",
    "rel_s": f"""SELECT h.*, w.named_graph, w.blank_graph, w.whole, {_of('whole', 'conventions')} AS release, conventions, {_of(_of('named'), f"coalesce({_of('blank')}, sha256(''))")} AS metadata FROM rel_h h JOIN rel_w w USING (g)
        JOIN (SELECT n_regionkey AS g, sha256(unhex(string_agg(x, '' ORDER BY x))) AS conventions FROM (SELECT n_regionkey, {_of('sha256(n_name)', "sha256('http://ns/' || n_nationkey)")} AS x FROM nation) GROUP BY 1) USING (g)""",
    "rel_e": f"""SELECT DISTINCT * FROM (
        SELECT release AS s, 'hasGraph' AS p, whole AS o FROM rel_s UNION ALL SELECT release, 'hasMetadataGraph', metadata FROM rel_s UNION ALL SELECT release, 'hasLocalConventions', conventions FROM rel_s
        UNION ALL SELECT whole, 'hasNamedGraph', named_graph FROM rel_s UNION ALL SELECT whole, 'hasBnodeGraph', blank_graph FROM rel_s
        UNION ALL SELECT metadata, 'hasNamedGraph', {_of('named')} FROM rel_s UNION ALL SELECT metadata, 'hasBnodeGraph', {_of('blank')} FROM rel_s UNION ALL SELECT {_of('named')}, 'hasNamedRecord', named FROM rel_s UNION ALL SELECT {_of('blank')}, 'hasBnodeRecord', blank FROM rel_s
        UNION ALL SELECT {_of('named', "coalesce(blank, sha256(''))")}, unnest(['hasNamedRecord', 'hasBnodeRecord']), unnest([named, blank]) FROM rel_s UNION ALL SELECT unnest([named, blank]), 'hasCondensed', unnest([named_condensed, blank_condensed]) FROM rel_s
        UNION ALL SELECT named_graph, 'hasNamedRecord', named FROM rel_r JOIN rel_w USING (g) UNION ALL SELECT blank_graph, 'hasBnodeRecord', blank FROM rel_r JOIN rel_w USING (g)
        UNION ALL SELECT combined, unnest(['hasNamedRecord', 'hasBnodeRecord']), unnest([named, blank]) FROM rel_r UNION ALL SELECT unnest([named, blank]), 'hasCondensed', unnest([named_condensed, blank_condensed]) FROM rel_r) WHERE o IS NOT NULL""",
}
REL = ("rel_m", "rel_b", "rel_a", "rel_p", "rel_q", "rel_r", "rel_w", "rel_h", "rel_s", "rel_e")


@query("SELECT * FROM rel_e", *REL)
def i6_identity_relations(spark, d):
    """All relations between the identities of the releases, their halves, records and headers."""
    return store(spark, d).relations.select(low("s").alias("s"), "p", low("o").alias("o"))


@query("""WITH RECURSIVE up AS (SELECT s, named AS node FROM rel_r UNION SELECT s, blank FROM rel_r UNION SELECT up.s, e.s FROM up JOIN rel_e e ON e.o = up.node AND e.p <> 'hasMetadataGraph')
 SELECT up.s, release, first_seen, uri, 'owl:Ontology' AS type, title, version, version_iri FROM up JOIN rel_s ON release = node""", *REL, recursive=True)
def v1_sources_by_identity(spark, d):
    """The releases that say anything about a customer, up from the identities of its records, with their metadata."""
    return R.sources_of(store(spark, d), subjects(spark, d)).withColumn("release", low("release"))


@query(f"""WITH v AS (SELECT DISTINCT s, combined, named, blank, k, a_id, CASE WHEN k % 5 = 0 AND g >= 3 THEN 2 ELSE 1 END + 2 + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END + 2 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS n FROM rel_r),
 a AS (SELECT r.s, r.combined, string_agg(x.uri || '|' || x.title || '|' || x.first_seen, ',' ORDER BY x.first_seen, x.uri) AS sources, min(x.first_seen) AS first FROM rel_r r JOIN rel_s x USING (g) GROUP BY r.s, r.combined)
 SELECT v.s, combined AS record, {_of(_of('named'), _seq('blank', ('k % 7 = 0', 'a_id')))} AS graph, CAST(n AS BIGINT) AS triple_count, sources, CAST(row_number() OVER (PARTITION BY v.s ORDER BY first, combined) AS INTEGER) AS place FROM v JOIN a USING (s, combined)""", *REL)
def v2_versions_of_both_halves(spark, d):
    """Versions of every customer; some differ only below the second blank node."""
    one = F.transform("sources", lambda x: F.concat_ws("|", x["uri"], x["title"], x["first_seen"].cast("string")))
    return R.versions_of(store(spark, d), subjects(spark, d)).select("s", low("record").alias("record"), low("graph").alias("graph"), "triple_count", F.array_join(one, ",").alias("sources"), "place")


_NINE = [
    ("metadata_graph", _of("embedded"), "nn + nb", "false"), ("embedded", "embedded", "nn + nb", "false"), ("condensed", "condensed", "nn + nb", "false"), ("graph_combined", "metadata", "nn + nb", "true"),
    ("named_embedded_seq", _of("named"), "nn", "true"), ("named_embedded", "named", "nn", "true"), ("named_condensed", "named_condensed", "nn", "true"),
    ("bnode_conn_free_seq", f"coalesce({_of('blank')}, sha256(''))", "nb", "nb > 0"), ("bnode_condensed", "coalesce(blank_condensed, sha256(''))", "nb", "nb > 0"),
]


@query("WITH c AS (SELECT *, CASE WHEN g <> 2 THEN 4 ELSE 3 END AS nn, CASE WHEN g <> 4 THEN 2 ELSE 0 END AS nb FROM rel_s) " + " UNION ALL ".join(
    f"SELECT 'g' || g AS graph, '{t}' AS type, {i} AS identity, CAST({n} AS BIGINT) AS n, {k} AS kept FROM c" for t, i, n, k in _NINE), *REL)
def i6_header_identities(spark, d):
    """Nine identities of each release's header, of which six are kept, and those of an empty half are not."""
    return R.header_identities(header_rows(spark, d), headers(spark, d)).withColumn("identity", low("identity"))


_TOPS = [("ex:segment", "CAST(NULL AS VARCHAR)", "c_mktsegment", "NULL", "s", "true"), ("rdfs:label", "NULL", "c_name", "NULL", "s", "k % 5 = 0 AND g >= 3"), ("ex:address", "NULL", "NULL", "a_id", "s", "true"), ("ex:billing", "NULL", "NULL", "a_id", "s", "k % 7 = 0")]
_INNER = [("ex:kind", "NULL", "'home'", "NULL", "a_id", "true"), ("ex:place", "NULL", "NULL", "c_id", "a_id", "true"), ("ex:place", "NULL", "NULL", "b_id", "a_id", "k % 3 = 0"), ("ex:partOf", "'http://ex.org/nation/' || n", "NULL", "NULL", "c_id", "true"),
          ("ex:zone", "NULL", "CAST(g % 2 AS VARCHAR)", "NULL", "c_id", "k % 2 = 0"), ("ex:partOf", "'http://ex.org/nation/' || ((n + 1) % 25)", "NULL", "NULL", "b_id", "k % 3 = 0")]


@query(" UNION ".join([f"SELECT combined AS record, CAST({s} AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS s_subgraph, '{p}' AS p, CAST({o} AS VARCHAR) AS o, CAST({lit} AS VARCHAR) AS o_lit, CAST({ob} AS VARCHAR) AS o_subgraph FROM rel_r WHERE {c}" for p, o, lit, ob, s, c in _TOPS]
                      + [f"SELECT combined, NULL, {s}, '{p}', {o}, {lit}, {ob} FROM rel_r WHERE {c}" for p, o, lit, ob, s, c in _INNER]), *REL)
def g9_records_from_identities(spark, d):
    """Every record of every release, rebuilt from relations and content alone."""
    st = store(spark, d)
    got = R.records_from(st, st.records.where("part = 'data'").select(F.col("combined").alias("record")))
    return got.select(low("record").alias("record"), "s", low("s_subgraph").alias("s_subgraph"), "p", "o", "o_lit", low("o_subgraph").alias("o_subgraph"))


@query("""WITH RECURSIVE w AS (SELECT release AS start, release AS node FROM rel_s UNION SELECT w.start, e.o FROM w JOIN rel_e e ON e.s = w.node)
 SELECT DISTINCT w.start, e.s, e.p, e.o FROM w JOIN rel_e e ON e.s = w.node WHERE e.o IN (SELECT named FROM rel_r UNION SELECT named FROM rel_s)""", *REL, recursive=True)
def g6_identity_down(spark, d):
    """Down from each release; the type of the far end is filtered after the walk."""
    st = store(spark, d)
    found = R.identity_walk(st, st.sources.select(F.col("release").alias("start")), types=["named_embedded"])
    return found.select(*[low(c).alias(c) if c != "p" else F.col(c) for c in ("start", "s", "p", "o")])


@query("""WITH RECURSIVE b AS (SELECT DISTINCT named AS start FROM rel_r WHERE k % 5 = 0), w AS (SELECT start, start AS node FROM b UNION SELECT w.start, e.s FROM w JOIN rel_e e ON e.o = w.node)
 SELECT DISTINCT w.start, e.s, e.p, e.o FROM w JOIN rel_e e ON e.o = w.node WHERE e.p IN ('hasGraph', 'hasNamedGraph')""", *REL, recursive=True)
def g6_identity_up_to_releases(spark, d):
    """Up from the named records of customers with several labels; predicates are filtered after the walk."""
    st = store(spark, d)
    own = st.records.where("part = 'data' and try_cast(substring_index(s, '/', -1) AS bigint) % 5 = 0").select(F.col("named").alias("start")).distinct()
    found = R.identity_walk(st, own, up=True, predicates=["hasGraph", "hasNamedGraph"])
    return found.select(*[low(c).alias(c) if c != "p" else F.col(c) for c in ("start", "s", "p", "o")])


_FIRST = "CASE WHEN k % 3 = 0 AND 'http://ex.org/nation/' || ((n + 1) % 25) < 'http://ex.org/nation/' || n THEN 2 ELSE 1 END"


@query(" UNION ALL ".join(f"SELECT 'g' || g AS graph, s, CAST({a} AS INTEGER) AS s_local, '{p}' AS p, {v} AS v, CAST({o} AS INTEGER) AS o_local FROM rel_m WHERE {c}" for a, p, v, o, c in [
    ("NULL", "ex:address", "NULL", "0", "true"), ("NULL", "ex:billing", "NULL", "0", "k % 7 = 0"), ("0", "ex:kind", "'home'", "NULL", "true"), ("0", "ex:place", "NULL", _FIRST, "true"), ("0", "ex:place", "NULL", f"3 - {_FIRST}", "k % 3 = 0"),
    (_FIRST, "ex:partOf", "'http://ex.org/nation/' || n", "NULL", "true"), (_FIRST, "ex:zone", "CAST(g % 2 AS VARCHAR)", "NULL", "k % 2 = 0"), (f"3 - {_FIRST}", "ex:partOf", "'http://ex.org/nation/' || ((n + 1) % 25)", "NULL", "k % 3 = 0")]), *REL)
def w4_integers_without_labels(spark, d):
    """Rows of all releases with blank nodes as integers; the labels that they came with make no difference."""
    rows = R._scoped(data_rows(spark, d))
    local = I.nested_integers(rows)
    root = rows.where("s is not null and o_blank is not null").select("s", F.col("o_blank").alias("root")).distinct()
    sub, obj = local.toDF("root", "s_blank", "s_local"), local.toDF("root", "o_blank", "o_local")
    inner = rows.where("s_blank is not null").drop("s").join(sub, "s_blank").join(obj, ["root", "o_blank"], "left").join(root, "root")
    top = rows.where("s is not null and o_blank is not null").withColumn("o_local", F.lit(0)).withColumn("s_local", F.lit(None).cast("int"))
    cols = ["graph", "s", "s_local", "p", F.coalesce("o", "o_lit").alias("v"), "o_local"]
    return inner.select(*cols).unionByName(top.select(*cols))


_IRI, _TEXT, _NODE = "'<' || {0} || '>'", """'"' || replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '"'""", "'_:sg_' || {0} || '_0'"
_RDF = [(_IRI.format("s") if s == "s" else _NODE.format(s), p, _IRI.format(o) if o not in ("NULL", "CAST(NULL AS VARCHAR)") else _TEXT.format(lit) if lit != "NULL" else _NODE.format(ob), c) for p, o, lit, ob, s, c in [*_TOPS, *_INNER]]


@query(" UNION ".join(f"SELECT {s} AS s, '<{p}>' AS p, {o} AS o FROM rel_r WHERE {c}" for s, p, o, c in _RDF) + f""" UNION SELECT '<' || s || '>', '<' || p || '>', CASE WHEN o IS NOT NULL THEN '<' || o || '>' ELSE {_TEXT.format('o_lit')} || CASE WHEN datatype IS NOT NULL THEN '^^<' || datatype || '>' WHEN language IS NOT NULL THEN '@' || language ELSE '' END END FROM triples""", *REL, "triples")
def s13_rows_as_rdf(spark, d):
    """All rows of the releases and of the tables as RDF terms: typed and tagged literals, escapes, blank nodes by content."""
    rows = R._scoped(data_rows(spark, d)).drop("graph")
    nodes, _ = I.bnode_records(rows)
    named = triples(spark, d).withColumns({"s_blank": F.lit(None).cast("string"), "o_blank": F.lit(None).cast("string")})
    return ntriples.labelled_rows(rows.unionByName(named), nodes.select("node", low("condensed").alias("identity")))


@query("SELECT 'g' || g AS graph, 'meta' AS part, uri AS s, p, v FROM (SELECT g, uri, unnest(['rdf:type', 'dc:title', 'owl:versionInfo']) AS p, unnest(['owl:Ontology', title, version]) AS v FROM rel_h UNION ALL SELECT g, uri, 'owl:versionIRI', version_iri FROM rel_h WHERE g <> 2 UNION ALL SELECT g, uri, 'ex:credit', NULL FROM rel_h WHERE g <> 4 UNION ALL SELECT g, NULL, 'ex:by', title FROM rel_h WHERE g <> 4)"
       + " UNION ALL " + " UNION ALL ".join(f"SELECT 'g' || g, 'data', {'s' if s == 's' else 'NULL'}, '{p}', coalesce({o}, {lit}) FROM rel_r WHERE {c}" for p, o, lit, _, s, c in [*_TOPS, *_INNER]), *REL)
def g15_header_and_data(spark, d):
    """Every row of every release, told apart: those of its header and of the blank nodes below it, and all others."""
    rows = R.parted(data_rows(spark, d).unionByName(header_rows(spark, d)), headers(spark, d))
    return rows.select("graph", "part", "s", "p", F.coalesce("o", "o_lit").alias("v"))


_LABEL_RECORD = f"sha256(unhex(sha256('http://ex.org/supplier/' || s_suppkey)) || unhex(sha256(unhex({_pair('rdfs:label', _lit('s_name'))}))))"


@query(f"SELECT half, x AS identity FROM (SELECT g AS half, x FROM ({buckets(f"SELECT 'named' AS g, {_LABEL_RECORD} AS x FROM supplier")}) UNION ALL SELECT g, x FROM ({buckets(f"SELECT 'blank' AS g, sha256(unhex(sha256('http://ex.org/supplier/' || s_suppkey)) || unhex(sha256(unhex({_pair('rdfs:subClassOf', RESTRICTION)})))) AS x FROM supplier UNION ALL SELECT 'blank', sha256(unhex(sha256('http://ex.org/customer/' || c_custkey)) || unhex(sha256(unhex({_pair('ex:address', ADDRESS)})))) FROM customer")}))")
def s19_identities_of_the_rebuilt(spark, d):
    """Identities of both halves of the graph with blank nodes, after it was stored by content and rebuilt."""
    got = I.graph_identity(B.rebuild(B.store(triplify.with_blanks(spark, d), "g"), "g"))
    return spark.createDataFrame([(k, got[k].hex()) for k in ("named", "blank")], "half string, identity string")
