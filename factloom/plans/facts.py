"""Sources, lookups, joins, aggregates, windows, sets and scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import iris
from ..functions.identity import low
from ..operators import lookup as L
from ..sources import ntriples, triplify
from .base import query, table, triples

NATIONS = [("http://ex.org/nation/1",), ("http://ex.org/nation/2",), ("http://ex.org/part/3",), ("http://ex.org/none",)]


def subjects(spark):
    return spark.createDataFrame(NATIONS, "s string")


IN = "s IN ('http://ex.org/nation/1', 'http://ex.org/nation/2', 'http://ex.org/part/3', 'http://ex.org/none')"


@query("SELECT coalesce(s, '') AS s, p, o, o_lit, datatype, language FROM triples", "triples")
def s6_triplify(spark, d):
    return triples(spark, d)


@query("""SELECT 'http://uri.ex.org/base/' || tx AS s, p, o, o_lit, datatype FROM (
 SELECT tx, type AS ty, 'rdf:type' AS p, CASE type WHEN 'annotation' THEN 'owl:AnnotationProperty' WHEN 'relationship' THEN 'owl:ObjectProperty' WHEN 'TermSet' THEN 'ex:TermSet' ELSE 'owl:Class' END AS o, CAST(NULL AS VARCHAR) AS o_lit, CAST(NULL AS VARCHAR) AS datatype FROM terms
 UNION ALL SELECT tx, type, 'rdfs:label', NULL, trim(label), NULL FROM terms
 UNION ALL SELECT tx, type, 'ex:definition', NULL, definition, NULL FROM terms WHERE definition <> ''
 UNION ALL SELECT tx, type, 'owl:deprecated', NULL, 'true', 'xsd:boolean' FROM terms WHERE status = '-2'
 UNION ALL SELECT tx, type, CASE WHEN (id // 2) % 10 = 0 THEN 'ex:synonym' ELSE ['ex:synonyms/abbreviation', 'ex:synonyms/broad', 'ex:synonyms/exact', 'ex:synonyms/narrow', 'ex:synonyms/related', 'fma:synonym', 'NIFRID:synonym', 'NIFRID:synonym', 'NIFRID:abbrev'][(id // 2) % 10] END, NULL, p_brand || ' ' || p_size, NULL FROM terms JOIN part ON p_partkey = id WHERE id % 2 = 0
 UNION ALL SELECT a.tx, a.type, 'http://uri.ex.org/base/tx_0000001', 'http://uri.ex.org/base/' || b.tx, NULL, NULL FROM terms a JOIN terms b ON b.id = a.id // 3 + 1 WHERE a.id > 10 AND a.id % 5 > 0 AND b.type <> 'cde'
 UNION ALL SELECT tx, type, 'http://uri.ex.org/base/tx_0000010', CASE WHEN id % 2 = 0 THEN 'http://purl.org/sig/ont/fma/fma' || id END, CASE WHEN id % 2 = 1 THEN p_type END, NULL FROM terms JOIN part ON p_partkey = id WHERE id > 10 AND id % 9 > 0
 UNION ALL SELECT a.tx, a.type, CASE WHEN a.type IN ('annotation', 'relationship') THEN 'rdfs:subPropertyOf' ELSE 'rdfs:subClassOf' END, 'http://uri.ex.org/base/' || b.tx, NULL, NULL FROM terms a JOIN terms b ON b.id = a.id // 2 WHERE a.id > 1 AND b.type <> 'cde'
 UNION ALL SELECT tx, type, 'ex:hasExternalId', iri, NULL, NULL FROM terms JOIN existing ON tid = id WHERE iri NOT LIKE 'http://uri.ex.org/base/%') WHERE ty <> 'cde'""", "terms", "existing")
def s6_triplify_terms(spark, d):
    return triplify.triplify_terms(triplify.term_tables(spark, d)).select("s", "p", "o", "o_lit", "datatype")


@query("SELECT id, label, type FROM terms WHERE type <> 'cde' AND definition <> '' AND status = '0'", "terms")
def s7_read_term_db(spark, d):
    return triplify.term_tables(spark, d)["terms"].where("type <> 'cde' and definition <> '' and status = '0'").select("id", "label", "type")


@query("""SELECT p, CAST(count(*) AS BIGINT) AS n, min(coalesce(o, o_lit)) AS first FROM (
 SELECT 'rdf:type' AS p, CASE type WHEN 'annotation' THEN 'owl:AnnotationProperty' WHEN 'relationship' THEN 'owl:ObjectProperty' WHEN 'TermSet' THEN 'ex:TermSet' ELSE 'owl:Class' END AS o, CAST(NULL AS VARCHAR) AS o_lit FROM terms
 UNION ALL SELECT 'ex:sourceType', NULL, type FROM terms UNION ALL SELECT 'rdfs:label', NULL, label FROM terms UNION ALL SELECT 'ex:definition', NULL, definition FROM terms WHERE definition IS NOT NULL
 UNION ALL SELECT 'ex:hasTermId', 'http://uri.ex.org/base/' || tx, NULL FROM terms UNION ALL SELECT 'ex:hasExistingId', iri, NULL FROM existing
 UNION ALL SELECT 'ex:hasExternalId', iri, NULL FROM existing WHERE iri NOT LIKE 'http://uri.ex.org/base/%' UNION ALL SELECT 'ex:hasPreferredId', iri, NULL FROM existing WHERE preferred = '1') GROUP BY p""", "terms", "existing")
def s20_term_records(spark, d):
    return triplify.term_records(triplify.term_tables(spark, d)).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("o", "o_lit")).alias("first"))


@query(r"""SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o IS NOT NULL THEN '<' || o || '>' ELSE
 '"' || replace(replace(replace(replace(replace(o_lit, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"'
 || CASE WHEN datatype IS NOT NULL THEN '^^<' || datatype || '>' WHEN language IS NOT NULL THEN '@' || language ELSE '' END END || ' .' AS line FROM triples""", "triples")
def s10_dump_ntriples(spark, d):
    return ntriples.dump_ntriples(triples(spark, d))


@query("SELECT s, p, o, o_lit, datatype, language FROM triples", "triples")
def s1_ntriples_round_trip(spark, d):
    """Lines of all triples read back by the parser."""
    lines = ntriples.dump_ntriples(triples(spark, d)).withColumnRenamed("line", "value")
    return ntriples.parse_lines(lines).select("s", "p", "o", "o_lit", "datatype", "language")


@query("SELECT s, p FROM triples WHERE NOT EXISTS (SELECT 1 FROM triples x WHERE x.s = triples.s AND x.o LIKE '%owl#Ontology')", "triples")
def s11_without_ontology(spark, d):
    return ntriples.without_ontology_subjects(triples(spark, d)).select("s", "p")


@query("SELECT s, coalesce(max(label), '') AS label, coalesce(max(brand), '') AS brand, coalesce(max(kind), '') AS kind FROM (SELECT s, CASE WHEN p = 'rdfs:label' THEN string_agg(o_lit, chr(31) ORDER BY o_lit) END AS label, CASE WHEN p = 'ex:brand' THEN string_agg(o_lit, chr(31) ORDER BY o_lit) END AS brand, CASE WHEN p = 'rdf:type' THEN string_agg(o, chr(31) ORDER BY o) END AS kind FROM triples WHERE p IN ('rdfs:label', 'ex:brand', 'rdf:type') GROUP BY s, p) GROUP BY s", "triples")
def s14_export_tabular(spark, d):
    wide = L.export_tabular(triples(spark, d), {"label": ["rdfs:label"], "brand": ["ex:brand"], "kind": ["rdf:type"]})
    return wide.fillna("", ["label", "brand", "kind"])


@query("SELECT CASE WHEN s IS NOT NULL THEN 'name' END AS kind, count(*) AS n FROM triples GROUP BY 1", "triples")
def s18_subset_counts(spark, d):
    return ntriples.subset_counts(triples(spark, d))


@query("SELECT s, any_value(label) AS labels, any_value(kind) AS types, count(iri) AS n_existing FROM (SELECT s, max(o_lit) FILTER (WHERE p = 'rdfs:label') AS label, max(o) FILTER (WHERE p = 'rdf:type') AS kind FROM triples GROUP BY s) LEFT JOIN (SELECT DISTINCT 'http://ex.org/part/' || tid AS s, iri FROM existing) USING (s) GROUP BY s", "triples", "existing")
def s16_index_records(spark, d):
    ids = triplify.term_tables(spark, d)["existing"].select(triplify.iri("part", "tid").alias("s"), "iri")
    rec = L.index_records(triples(spark, d), ids)
    n = F.when(F.col("existing").isNull(), 0).otherwise(F.size("existing")).cast("long")
    return rec.select("s", F.get("labels", 0).alias("labels"), F.get("types", 0).alias("types"), n.alias("n_existing"))


@query("SELECT p_brand AS key, max(p_partkey) AS v FROM part WHERE p_partkey % 2 = 1 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 20 = 0) GROUP BY p_brand")
def s8_append_new(spark, d):
    part = table(spark, d, "part")
    new = part.where("p_partkey % 2 = 1").groupBy(F.col("p_brand").alias("key")).agg(F.max("p_partkey").alias("v"))
    return ntriples.append_new(new, part.where("p_partkey % 20 = 0").select(F.col("p_brand").alias("key")).distinct(), ["key"])


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer")
def s9_upsert(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("v"))
    return ntriples.upsert(old, old.where("key % 5 = 0").withColumn("v", F.lit("new")), ["key"])


@query("SELECT order_key FROM (SELECT o_orderkey AS order_key, sha256(CAST(o_orderkey AS VARCHAR)) AS i FROM orders) WHERE order_key % 3 <> 0")
def s5_skip_already_loaded(spark, d):
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("identity"))
    done = m.where("order_key % 3 = 0").select(F.col("identity").alias("s"), F.lit("parsedTo").alias("p"))
    return ntriples.skip_already_loaded(m, done).select("order_key")


@query("SELECT DISTINCT p_brand AS o_lit, p_size FROM part")
def s2_dedupe(spark, d):
    return ntriples.dedupe(table(spark, d, "part").select(F.col("p_brand").alias("o_lit"), "p_size"))


# --- lookups ---------------------------------------------------------------------------------------------------------

@query(f"SELECT s, o_lit FROM triples WHERE p = 'rdfs:label' AND {IN}", "triples")
def p1_labels(spark, d):
    return L.labels(triples(spark, d), subjects(spark))


@query("SELECT 'http://uri.ex.org/base/' || tx AS s, definition AS o_lit FROM terms WHERE definition IS NOT NULL", "terms")
def p2_definitions(spark, d):
    ts = triplify.term_tables(spark, d)
    asked = ts["terms"].select(F.concat(F.lit(triplify.BASE), "tx").alias("s"))
    return L.definitions(triplify.triplify_terms(ts, include_cdes=True), asked)


@query("""WITH q AS (SELECT DISTINCT upper(n_name) AS label FROM nation WHERE n_nationkey < 5 UNION SELECT 'customer#00000000_' UNION SELECT 'nowhere'),
 h AS (SELECT DISTINCT label, s FROM q JOIN triples ON p = 'rdfs:label' AND lower(o_lit) LIKE lower(label))
 SELECT q.label, count(s) AS n, CASE count(s) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS status, coalesce(min(s), '') AS first FROM q LEFT JOIN h USING (label) GROUP BY q.label""", "triples")
def p3_by_label(spark, d):
    asked = table(spark, d, "nation").where("n_nationkey < 5").select(F.upper("n_name").alias("label"))
    asked = asked.union(spark.createDataFrame([("customer#00000000_",), ("nowhere",)], "label string"))
    out = L.by_label(triples(spark, d), asked)
    return out.select("label", "n", "status", F.coalesce(F.get("found", 0)["s"], F.lit("")).alias("first"))


@query(f"SELECT s, o FROM triples WHERE p = 'ex:partOf' AND {IN}", "triples")
def p4_subjects_objects(spark, d):
    return L.objects_for(triples(spark, d), subjects(spark), "ex:partOf").select("s", "o")


@query("SELECT s, p, o, triple AS identity FROM ids WHERE triple IN (SELECT triple FROM ids WHERE s LIKE '%nation/1%')", "ids")
def p5_by_ids(spark, d):
    from ..operators.identities import with_triple_identity

    t = with_triple_identity(triples(spark, d))
    asked = t.where(F.col("s").contains("nation/1")).select("triple_identity")
    return t.join(asked, "triple_identity", "left_semi").select("s", "p", "o", low("triple_identity").alias("identity"))


@query("SELECT iri, EXISTS (SELECT 1 FROM triples WHERE s = iri) AS as_subject, EXISTS (SELECT 1 FROM triples WHERE p = iri) AS as_predicate FROM (SELECT unnest(['http://ex.org/nation/1', 'ex:partOf', 'ex:nothing']) AS iri)", "triples")
def p6_known(spark, d):
    return L.known(triples(spark, d), spark.createDataFrame([("http://ex.org/nation/1",), ("ex:partOf",), ("ex:nothing",)], "iri string"))


@query("SELECT p_name AS o_lit, min(p_partkey) AS id FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_partkey < 20) GROUP BY p_name")
def p7_label_exact(spark, d):
    part = table(spark, d, "part")
    return part.join(part.where("p_partkey < 20").select("p_name").distinct(), "p_name", "left_semi").groupBy(F.col("p_name").alias("o_lit")).agg(F.min("p_partkey").alias("id"))


@query("""WITH r AS (SELECT p_name AS o_lit, min(p_partkey) AS s FROM part GROUP BY p_name), q AS (SELECT p_partkey AS request, p_name AS o_lit FROM part)
 SELECT request, 'http://ex.org/part/' || s AS s, count(*) AS n FROM q JOIN r USING (o_lit) GROUP BY request, s""")
def p8_entity_conflicts(spark, d):
    part = table(spark, d, "part")
    registry = part.groupBy(F.col("p_name").alias("o_lit")).agg(F.min("p_partkey").alias("k")).select("o_lit", triplify.iri("part", "k").alias("s"), F.lit("label").alias("p"))
    asked = part.select(F.col("p_partkey").alias("request"), F.col("p_name").alias("o_lit"), F.lit("exact").alias("p"))
    return L.entity_conflicts(registry, asked).select("request", "s", "n")


@query("""WITH b AS (SELECT r_name AS prefix, 'http://ex.org/region/' || r_regionkey AS namespace FROM region), g AS (SELECT n_name AS grp, r_name AS prefix, 'http://own/' || n_nationkey AS namespace FROM nation JOIN region ON n_regionkey = r_regionkey)
 SELECT x.grp, b.prefix, coalesce(o.namespace, b.namespace) AS namespace FROM (SELECT DISTINCT grp FROM g) x CROSS JOIN b LEFT JOIN g o ON o.grp = x.grp AND o.prefix = b.prefix UNION ALL SELECT grp, 'tx.' || grp, 'http://ex.org/' || grp FROM g""")
def p9_group_curies(spark, d):
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    base = region.select(F.col("r_name").alias("prefix"), triplify.iri("region", "r_regionkey").alias("namespace"))
    own = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("grp"), F.col("r_name").alias("prefix"), F.concat(F.lit("http://own/"), F.col("n_nationkey").cast("string")).alias("namespace"))
    derived = nation.select(F.col("n_name").alias("grp"), F.concat(F.lit("tx."), "n_name").alias("prefix"), F.concat(F.lit("http://ex.org/"), "n_name").alias("namespace"))
    return L.group_curies(base, own, derived)


@query("SELECT tid, iri FROM existing WHERE preferred = '1'", "existing")
def p10_existing_iris(spark, d):
    return triplify.term_tables(spark, d)["existing"].where("preferred = '1'").select("tid", "iri")


@query("""SELECT perspective, subject, head FROM (SELECT *, row_number() OVER (PARTITION BY perspective, subject ORDER BY ts DESC, head DESC) AS r FROM log) WHERE r = 1 AND head <> '' AND perspective = 3""", "log")
def p12_head(spark, d):
    from ..operators.versions import heads
    from .base import head_log

    return heads(head_log(spark, d).where("perspective = 3")).select("perspective", "subject", "head")


@query("""WITH q(query) AS (VALUES ('united kingdom'), ('Supplier#000000001'), ('china')),
 t AS (SELECT s, p, ' ' || lower(trim(regexp_replace(o_lit, '[^\\p{L}\\p{N}]+', ' ', 'g'))) || ' ' AS x FROM (SELECT s, p, o_lit FROM triples WHERE p <> 'ex:title' UNION ALL SELECT 'http://ex.org/document/' || doc_id, 'ex:title', string_split(text, chr(10))[1] FROM documents
   UNION ALL SELECT 'http://ex.org/document/' || doc_id, 'ex:text', text FROM documents) WHERE o_lit IS NOT NULL),
 h AS (SELECT DISTINCT query, s, p, CASE p WHEN 'rdfs:label' THEN 4.0 WHEN 'ex:title' THEN 1.2 ELSE 1.0 END AS b FROM q JOIN t ON contains(x, ' ' || lower(trim(regexp_replace(query, '[^\\p{L}\\p{N}]+', ' ', 'g'))) || ' '))
 SELECT query, s, CAST(max(b) + 0.3 * (sum(b) - max(b)) AS DOUBLE) AS score FROM h GROUP BY query, s""".replace("\\\\", "\\"), "triples")
def p13_full_text(spark, d):
    q = spark.createDataFrame([("united kingdom",), ("Supplier#000000001",), ("china",)], "query string")
    return L.search(L.tokens(triplify.triplify_testdata(spark, d, texts=True)), F.broadcast(q))  # three rows


@query("SELECT k AS position, found FROM (SELECT p_partkey AS k, p_partkey % 2 = 0 AS found FROM part)")
def p16_identities_exist(spark, d):
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("position"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("identity"))
    return L.identities_exist(ids, ids.where("position % 2 = 0")).select("position", "found")


# --- joins -----------------------------------------------------------------------------------------------------------

def term_iris(spark, d):
    return triplify.term_tables(spark, d)["existing"].select(triplify.iri("part", "tid").alias("s"), "iri", "tid")


@query("SELECT t.s, t.p, iri FROM triples t JOIN existing ON t.s = 'http://ex.org/part/' || tid WHERE t.p = 'rdfs:label'", "triples", "existing")
def j1_mapped_triples(spark, d):
    return triples(spark, d, "part").where("p = 'rdfs:label'").join(term_iris(spark, d), "s").select("s", "p", "iri")


@query("SELECT s, p FROM triples WHERE s NOT IN (SELECT 'http://ex.org/part/' || tid FROM existing WHERE preferred = '1')", "triples", "existing")
def j2_unmapped_triples(spark, d):
    ids = triplify.term_tables(spark, d)["existing"].where("preferred = '1'").select(triplify.iri("part", "tid").alias("s"))
    return triples(spark, d).join(ids, "s", "left_anti").select("s", "p")


@query("SELECT DISTINCT a.iri AS asked, b.tid, b.iri FROM existing a JOIN existing b ON a.tid = b.tid WHERE a.preferred = '1'", "existing")
def j3_co_mapped(spark, d):
    ids = triplify.term_tables(spark, d)["existing"]
    asked = ids.where("preferred = '1'").select(F.col("iri").alias("asked"), "tid")
    return asked.join(ids.select("tid", "iri"), "tid").select("asked", "tid", "iri").distinct()


@query("SELECT k AS position, iri FROM (VALUES (0, 9), (1, 3), (2, 6)) v(k, id) JOIN existing ON tid = id", "existing")
def j4_existing_for_ids(spark, d):
    asked = spark.createDataFrame([([9, 3, 6],)], "ids array<long>").select(F.posexplode("ids").alias("position", "tid"))
    return triplify.term_tables(spark, d)["existing"].join(F.broadcast(asked), "tid").select("position", "iri")  # three rows


@query("SELECT DISTINCT a.iri, b.iri AS own FROM existing a JOIN existing b ON a.tid = b.tid WHERE a.iri LIKE 'http://purl.ex.net/obo/%' AND b.iri LIKE 'http://uri.ex.org/base/%'", "existing")
def j5_existing_in_namespace(spark, d):
    ids = triplify.term_tables(spark, d)["existing"].select("tid", "iri")
    a = ids.where(F.col("iri").startswith("http://purl.ex.net/obo/"))
    b = ids.where(F.col("iri").startswith(triplify.BASE)).withColumnRenamed("iri", "own")
    return a.join(b, "tid").select("iri", "own").distinct()


@query("SELECT id FROM terms WHERE orig_cid = 2 OR (id % 11 = 0 AND status = '0')", "terms")
def j6_group_terms(spark, d):
    t = triplify.term_tables(spark, d)["terms"]
    return t.where("orig_cid = 2").select("id").union(t.where("id % 11 = 0 and status = '0'").select("id")).distinct()


@query("SELECT name, first, latest FROM (SELECT source AS name, min(doc_id) AS first, max(doc_id) AS latest FROM documents GROUP BY source)")
def j8_names_first_latest(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("latest"))


@query("SELECT o_custkey AS name, o_orderkey AS identity FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def j9_latest_by_name(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return L.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("identity"))


@query("SELECT n_name AS prefix FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
def j10_curies_by_name(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return n.join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select(F.col("n_name").alias("prefix"))


@query("SELECT iri AS s, p, coalesce(o, o_lit) AS v FROM existing JOIN triples ON s = 'http://ex.org/part/' || tid WHERE tid < 30 UNION SELECT s, p, coalesce(o, o_lit) FROM triples WHERE s LIKE 'http://ex.org/nation/%'", "existing", "triples")
def j12_term_by_id(spark, d):
    t = triples(spark, d)
    a = term_iris(spark, d).where("tid < 30").join(t, "s").select(F.col("iri").alias("s"), "p", F.coalesce("o", "o_lit").alias("v"))
    return a.union(t.where(F.col("s").startswith("http://ex.org/nation/")).select("s", "p", F.coalesce("o", "o_lit").alias("v"))).distinct()


@query("SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def j15_overview(spark, d):
    """Counts are taken before the joins, so no side multiplies the other."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    n = table(spark, d, "nation")
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").fillna(0, ["customers", "suppliers"]).select("n_name", "customers", "suppliers")


@query("SELECT DISTINCT c_name, s_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7' AND c_mktsegment = 'BUILDING'")
def j16_contributions(spark, d):
    t = lambda n: table(spark, d, n)
    sup = t("supplier").join(t("nation").where("n_name = 'NATION_7'"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name")
    items = t("lineitem").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_name")
    cust = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return t("orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("c_name", "s_name").distinct()


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) NOT LIKE '%.org'")
def j17_free_names(spark, d):
    return table(spark, d, "pages").select("page_id", iris.host(F.col("url")).alias("host")).where("host not like '%.org'")


@query("SELECT a.conv_id, a.turn, a.role, a.text, b.role AS replies_to FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def j18_comments(spark, d):
    a = table(spark, d, "conversations")
    b = a.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("replies_to"))
    return a.join(b, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "text", "replies_to")


@query("SELECT id FROM terms WHERE NOT (type IN ('term', 'fde') AND id <= 100)", "terms")
def j20_delete_up_to(spark, d):
    t = triplify.term_tables(spark, d)["terms"]
    limits = spark.createDataFrame([("term", 100), ("fde", 100)], "type string, top long")
    gone = t.join(F.broadcast(limits), "type").where("id <= top").select("id")  # two rows
    return t.join(gone, "id", "left_anti").select("id")


@query("SELECT DISTINCT review, reviewer FROM votes WHERE EXISTS (SELECT 1 FROM committee c WHERE c.review = votes.review AND c.reviewer = votes.reviewer)", "votes", "committee")
def j22_exists(spark, d):
    from .base import committee, votes

    return votes(spark, d).join(committee(spark, d), ["review", "reviewer"], "left_semi").select("review", "reviewer").distinct()


@query("SELECT s, p, coalesce(o, o_lit) AS v FROM triples WHERE s IN (SELECT s FROM triples WHERE p = 'rdf:type' AND o = 'http://ex.org/Nation')", "triples")
def j24_subjects_of_type(spark, d):
    t = triples(spark, d)
    return t.join(t.where("p = 'rdf:type' and o = 'http://ex.org/Nation'").select("s"), "s", "left_semi").select("s", "p", F.coalesce("o", "o_lit").alias("v"))


@query("SELECT DISTINCT iri FROM existing JOIN triples ON s = 'http://ex.org/part/' || tid WHERE contains(lower(o_lit), 'red')", "existing", "triples")
def j26_labels_containing(spark, d):
    return triples(spark, d, "part").where(F.lower("o_lit").contains("red")).join(term_iris(spark, d), "s").select("iri").distinct()


@query("SELECT t.s, t.o, coalesce(n_name, t.o) AS shown FROM triples t LEFT JOIN nation ON t.o = 'http://ex.org/nation/' || n_nationkey WHERE t.p = 'ex:partOf'", "triples")
def j28_objects_to_existing(spark, d):
    names = table(spark, d, "nation").select(triplify.iri("nation", "n_nationkey").alias("o"), "n_name")
    return triples(spark, d).where("p = 'ex:partOf'").join(names, "o", "left").select("s", "o", F.coalesce("n_name", "o").alias("shown"))


# --- aggregates, windows, order, sets ------------------------------------------------------------------------------------

@query("SELECT o AS type, count(*) AS n FROM triples WHERE p = 'rdf:type' GROUP BY o", "triples")
def a1_type_counts(spark, d):
    return triples(spark, d).where("p = 'rdf:type'").groupBy(F.col("o").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'http://uri.ex.org/base/tx_' || lpad(CAST(k AS VARCHAR), 7, '0') AS p, k = 1 OR k = 10 AS is_property FROM (VALUES (1), (10)) v(k) UNION ALL SELECT p, false FROM (VALUES ('rdf:type'), ('rdfs:label'), ('ex:definition'), ('owl:deprecated'), ('ex:synonym'), ('ex:synonyms/broad'), ('ex:synonyms/exact'), ('ex:synonyms/narrow'), ('ex:synonyms/related'), ('NIFRID:synonym'), ('NIFRID:abbrev'), ('rdfs:subClassOf'), ('rdfs:subPropertyOf'), ('ex:hasExternalId')) w(p)")
def a2_predicate_is_property(spark, d):
    return L.predicate_is_property(triplify.triplify_terms(triplify.term_tables(spark, d)))


@query("SELECT lower(p_name) AS key, count(DISTINCT p_partkey) AS n, min(p_partkey) AS least FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def a4_duplicate_groups(spark, d):
    return L.duplicate_groups(table(spark, d, "part"), F.lower("p_name"), "p_partkey")


@query("SELECT coalesce(a.s, b.o) AS node, coalesce(a.n, 0) AS as_subject, coalesce(b.n, 0) AS as_object FROM (SELECT s, count(*) AS n FROM triples GROUP BY s) a FULL JOIN (SELECT o, count(*) AS n FROM triples WHERE o IS NOT NULL GROUP BY o) b ON a.s = b.o", "triples")
def a5_subject_object_counts(spark, d):
    t = triples(spark, d)
    a = t.groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("as_subject"))
    b = t.where("o is not null").groupBy(F.col("o").alias("node")).agg(F.count(F.lit(1)).alias("as_object"))
    return a.join(b, "node", "full").fillna(0, ["as_subject", "as_object"])


@query("SELECT review, vote, count(*) AS n, count(DISTINCT reviewer) AS voters FROM votes GROUP BY review, vote", "votes")
def a6_votes_by_kind(spark, d):
    from .base import votes

    return votes(spark, d).groupBy("review", "vote").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("reviewer").alias("voters"))


@query("SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY lang")
def a7_collect_sets(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query("SELECT tid, arg_min(iri, CASE WHEN iri LIKE 'http://purl%' THEN 0 ELSE 1 END) AS iri FROM existing GROUP BY tid", "existing")
def a8_preferred_iri(spark, d):
    rank = F.when(F.col("iri").startswith("http://purl"), 0).otherwise(1)
    return triplify.term_tables(spark, d)["existing"].groupBy("tid").agg(F.min_by("iri", rank).alias("iri"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, string_agg(DISTINCT regexp_extract(url, '^([a-z]+):', 1), ',' ORDER BY regexp_extract(url, '^([a-z]+):', 1)) AS schemes, count(*) AS n FROM pages GROUP BY 1")
def a9_host_schemes(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").groupBy(iris.host(u).alias("host")).agg(F.array_join(F.sort_array(F.collect_set(iris.scheme(u))), ",").alias("schemes"), F.count(F.lit(1)).alias("n"))


@query("SELECT 'tx' AS prefix, max(CAST(right(tx, 7) AS BIGINT)) AS top FROM terms", "terms")
def a10_max_suffix(spark, d):
    x = F.concat(F.lit("/"), F.col("tx"))
    return triplify.term_tables(spark, d)["terms"].groupBy(iris.term_prefix(x).alias("prefix")).agg(F.max(iris.term_number(x).cast("long")).alias("top"))


@query("SELECT c_nationkey AS k, greatest(max(c_custkey), 500) AS quota FROM customer GROUP BY c_nationkey")
def a11_quota(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.greatest(F.max("c_custkey"), F.lit(500)).alias("quota"))


@query("SELECT perspective, subject, head, ts FROM (SELECT *, row_number() OVER (PARTITION BY perspective, subject ORDER BY ts DESC, head DESC) AS r FROM log) WHERE r = 1", "log")
def w2_latest_per_key(spark, d):
    from .base import head_log

    return L.latest(head_log(spark, d), ["perspective", "subject"], ["ts", "head"])


@query("SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS replica FROM part")
def w3_replica_number(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", (F.row_number().over(W.partitionBy("p_name").orderBy("p_partkey")) - 1).cast("long").alias("replica"))


@query("SELECT s_name, lpad(regexp_extract(s_name, '([0-9]+)', 1), 20, '0') AS digits FROM supplier")
def w5_natural_key(spark, d):
    return table(spark, d, "supplier").select("s_name", F.regexp_extract(iris.natural_key(F.col("s_name")), "([0-9]+)$", 1).alias("digits"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o2_page(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT tid, iri FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY CASE split_part(curie, ':', 1) WHEN 'X' THEN 0 WHEN 'TX' THEN 1 ELSE 2 END, iri) AS r FROM existing) WHERE r = 1", "existing")
def o3_rank_list(spark, d):
    rank = F.array_position(F.array(F.lit("X"), F.lit("TX")), F.substring_index("curie", ":", 1))
    return L.best(triplify.term_tables(spark, d)["existing"], ["tid"], [F.when(rank == 0, 99).otherwise(rank), "iri"]).select("tid", "iri")


@query("SELECT DISTINCT o AS type FROM triples WHERE p = 'rdf:type' EXCEPT SELECT o FROM triples WHERE p = 'rdf:type' AND s IN (SELECT s FROM triples WHERE p = 'ex:partOf')", "triples")
def u3_top_level_types(spark, d):
    t = triples(spark, d)
    types = t.where("p = 'rdf:type'").select("s", F.col("o").alias("type"))
    return types.select("type").subtract(types.join(t.where("p = 'ex:partOf'").select("s"), "s", "left_semi").select("type"))


@query("SELECT p_name FROM part WHERE p_partkey % 2 = 0 INTERSECT SELECT p_name FROM part WHERE p_partkey % 3 = 0")
def u4_set_intersection(spark, d):
    p = table(spark, d, "part")
    return p.where("p_partkey % 2 = 0").select("p_name").intersect(p.where("p_partkey % 3 = 0").select("p_name"))


@query("""WITH o AS (SELECT n_name AS prefix, 'ns' || n_nationkey AS old FROM nation WHERE n_nationkey < 15), n AS (SELECT n_name AS prefix, CASE WHEN n_nationkey = 12 THEN 'moved' WHEN n_nationkey = 20 THEN 'ns1' ELSE 'ns' || n_nationkey END AS new FROM nation WHERE n_nationkey >= 10)
 SELECT prefix, old, new, CASE WHEN new IS NULL THEN 'kept' WHEN old <> new THEN 'conflict: prefix is bound' WHEN old = new THEN 'existing' WHEN new IN (SELECT old FROM o) THEN 'conflict: namespace is bound' ELSE 'add' END AS state FROM o FULL JOIN n USING (prefix)""")
def u5_curie_diff(spark, d):
    n = table(spark, d, "nation")
    ns = F.concat(F.lit("ns"), F.col("n_nationkey").cast("string"))
    old = n.where("n_nationkey < 15").select(F.col("n_name").alias("prefix"), ns.alias("namespace"))
    new = n.where("n_nationkey >= 10").select(F.col("n_name").alias("prefix"), F.when(F.col("n_nationkey") == 12, "moved").when(F.col("n_nationkey") == 20, "ns1").otherwise(ns).alias("namespace"))
    return L.curie_diff(old, new)


# --- scalar functions ---------------------------------------------------------------------------------------------------

@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, string_split(url, '/')[-1] AS fragment, array_to_string(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), '|') AS parts FROM pages")
def f3_uri_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", iris.host(u).alias("host"), iris.path(u).alias("path"), iris.fragment(u).alias("fragment"), F.array_join(iris.path_parts(u), "|").alias("parts"))


@query("SELECT iri, CASE WHEN iri LIKE '%tx!_%' ESCAPE '!' THEN 'tx' END AS prefix, CASE WHEN iri LIKE '%tx!_%' ESCAPE '!' THEN right(iri, 7) END AS number FROM existing", "existing")
def f4_term_id_parts(spark, d):
    i = F.col("iri")
    return triplify.term_tables(spark, d)["existing"].select("iri", iris.term_prefix(i).alias("prefix"), iris.term_number(i).alias("number"))


@query("SELECT curie, CASE WHEN curie LIKE 'X:%' THEN 'http://purl.ex.net/obo/X_' || substr(curie, 3) END AS iri, CASE WHEN curie LIKE 'X:%' THEN 'ok' ELSE 'unknown prefix' END AS status FROM existing", "existing")
def f6_expand_curies(spark, d):
    curies = spark.createDataFrame([("X", "http://purl.ex.net/obo/X_")], "prefix string, namespace string")
    return iris.expand_curies(triplify.term_tables(spark, d)["existing"].select("curie"), "curie", F.broadcast(curies))  # one row


@query("SELECT iri, CASE WHEN iri LIKE 'http://purl%' THEN 'X:' || substr(iri, 26) ELSE 'base:' || substr(iri, 24) END AS curie FROM existing", "existing")
def f6_shrink_iris(spark, d):
    curies = spark.createDataFrame([("X", "http://purl.ex.net/obo/X_"), ("obo", "http://purl.ex.net/obo/"), ("base", "http://uri.ex.org/base/")], "prefix string, namespace string")
    return iris.shrink_iris(triplify.term_tables(spark, d)["existing"].select("iri"), "iri", curies)


@query("SELECT id, nullif(trim(label), '') AS trimmed, label <> trim(label) AS edge FROM terms", "terms")
def f8_trim(spark, d):
    return triplify.term_tables(spark, d)["terms"].select("id", iris.trimmed(F.col("label")).alias("trimmed"), iris.edge_white(F.col("label")).alias("edge"))


@query("SELECT n_nationkey, c_custkey, 'c' || n_nationkey || '_' || lpad(CAST(100 + row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS VARCHAR), 7, '0') AS minted FROM customer JOIN nation ON c_nationkey = n_nationkey")
def f9_mint_ids(spark, d):
    """Ids for a batch of requests: each prefix goes on from its largest number, without gaps."""
    k = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) + 100
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", F.concat(F.lit("c"), F.col("c_nationkey").cast("string"), F.lit("_"), F.lpad(k.cast("string"), 7, "0")).alias("minted"))


@query(r"SELECT doc_id, replace(replace(replace(regexp_replace(text, '[\x20\x09-\x0D]+', '%20', 'g'), '[', '%5B'), ']', '%5D'), ';', '%3B') AS fixed FROM documents")
def f10_iri_repair(spark, d):
    """Characters that iris can't hold, in the whole text of every document."""
    return table(spark, d, "documents").select("doc_id", iris.repaired(F.col("text")).alias("fixed"))


@query(r"""SELECT doc_id, '"' || replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' AS quoted FROM documents""")
def f12_json_text(spark, d):
    return table(spark, d, "documents").select("doc_id", iris.json_text(F.col("text")).alias("quoted"))


@query("SELECT o_orderkey, dayofweek(o_orderdate) AS dow, date_trunc('day', o_orderdate) + INTERVAL 1 DAY AS next_day, CAST(epoch(o_orderdate) AS BIGINT) AS epoch FROM orders")
def f14_dates(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", (F.dayofweek(t) - 1).cast("long").alias("dow"), (F.date_trunc("DAY", t) + F.make_interval(days=F.lit(1))).alias("next_day"), F.unix_timestamp(t).alias("epoch"))


@query("SELECT iri, CASE WHEN contains(iri, '/base/') THEN replace(iri, '/base/', '/team/') ELSE iri END AS rewritten FROM existing", "existing")
def f15_group_rewrite(spark, d):
    return triplify.term_tables(spark, d)["existing"].select("iri", iris.rewrite_group(F.col("iri"), "base", "team").alias("rewritten"))


@query("SELECT id, CASE type WHEN 'annotation' THEN 'owl:AnnotationProperty' WHEN 'relationship' THEN 'owl:ObjectProperty' WHEN 'TermSet' THEN 'ex:TermSet' ELSE 'owl:Class' END AS class FROM terms", "terms")
def f17_type_map(spark, d):
    return triplify.term_tables(spark, d)["terms"].select("id", triplify.mapped(triplify.TYPES, F.col("type")).alias("class"))


@query("SELECT coalesce(b.iri, t.s) AS s, t.p, t.o_lit FROM triples t LEFT JOIN existing b ON b.preferred = '1' AND t.s = 'http://ex.org/part/' || b.tid WHERE t.p = 'rdfs:label'", "triples", "existing")
def f18_preferred_rewrite(spark, d):
    pref = triplify.term_tables(spark, d)["existing"].where("preferred = '1'").select(triplify.iri("part", "tid").alias("s"), "iri")
    return triples(spark, d).where("p = 'rdfs:label'").join(pref, "s", "left").select(F.coalesce("iri", "s").alias("s"), "p", "o_lit")


@query("SELECT page_id, 'http://ex.org/base/ontologies/' || regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS reference FROM pages")
def f19_reference_name(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("http://ex.org/base/ontologies/"), iris.host(u), iris.path(u)).alias("reference"))
