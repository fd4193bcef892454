"""Rebuilds, remaining lookups, joins and functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import iris
from ..functions.identity import low
from ..operators import closure as C
from ..operators import identities as I
from ..operators import lookup as L
from ..operators import rebuild as B
from ..operators import versions as V
from ..operators.review import ROLES, role_rank
from ..sources import ntriples, triplify
from .base import graph_rows, query, table, triples


@query("SELECT kind, count(*) AS n FROM (SELECT unnest(['conn', 'term', 'term', 'term', 'name']) AS kind FROM supplier UNION ALL SELECT unnest(['conn', 'term', 'link', 'term']) FROM customer) GROUP BY kind")
def s3_split_triples(spark, d):
    return ntriples.split_triples(triplify.with_blanks(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query()
def s4_file_checksums(spark, d):
    """Size and digest of every file of the given tables."""
    every = ntriples.file_checksums(spark, [f"{d}/{t}.parquet" for t in TABLES])
    return every.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


@query("SELECT '_:bxr' || s_suppkey || ' <owl:someValuesFrom> <http://ex.org/nation/' || s_nationkey || '> .' AS line FROM supplier UNION ALL SELECT '<http://ex.org/supplier/' || s_suppkey || '> <rdfs:subClassOf> _:bxr' || s_suppkey || ' .' FROM supplier")
def s12_nt_lines_of_blanks(spark, d):
    return ntriples.dump_ntriples(triplify.with_blanks(spark, d).where("p in ('owl:someValuesFrom', 'rdfs:subClassOf')"))


@query("SELECT p, count(*) AS n, count(o) AS iris, count(o_lit) AS literals FROM triples GROUP BY p", "triples")
def s15_all_rows(spark, d):
    return triples(spark, d).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count("o").alias("iris"), F.count("o_lit").alias("literals"))


@query("SELECT 'http://ex.org/load' AS s, p, v FROM (SELECT unnest(['ex:tripleCount', 'ex:subjectCount', 'ex:topPart']) AS p, unnest([CAST(count(*) AS VARCHAR), CAST(count(DISTINCT s) AS VARCHAR), (SELECT CAST(max(p_partkey) AS VARCHAR) FROM part)]) AS v FROM triples)", "triples")
def s21_load_metadata(spark, d):
    one = triples(spark, d).agg(F.count(F.lit(1)).alias("a"), F.count_distinct("s").alias("b")).crossJoin(F.broadcast(table(spark, d, "part").agg(F.max("p_partkey").alias("c"))))  # one row
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("v")) for p, c in (("ex:tripleCount", "a"), ("ex:subjectCount", "b"), ("ex:topPart", "c"))]))
    return one.select(pairs.alias("x")).select(F.lit("http://ex.org/load").alias("s"), "x.p", "x.v")


BLANK_COUNTS = "SELECT p, count(*) AS n FROM (SELECT unnest(['rdfs:subClassOf', 'rdf:type', 'owl:onProperty', 'owl:someValuesFrom', 'rdfs:label']) AS p FROM supplier UNION ALL SELECT unnest(['ex:address', 'ex:segment', 'ex:place', 'ex:partOf']) FROM customer) GROUP BY p"


@query(BLANK_COUNTS)
def g8_graph_by_identity(spark, d):
    """The graph with blank nodes, stored by content and rebuilt."""
    return B.rebuild(B.store(triplify.with_blanks(spark, d), "g"), "g").groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT true AS equal")
def s19_reingest_check(spark, d):
    return spark.createDataFrame([(B.reingest_check(triplify.with_blanks(spark, d)),)], "equal boolean")


@query("SELECT 'http://ex.org/customer/' || c_custkey AS s, CAST(1 AS BIGINT) AS copies FROM customer WHERE c_custkey = 7")
def g9_record_by_identity(spark, d):
    t = triplify.with_blanks(spark, d)
    nodes, embedded = I.bnode_records(t)
    wanted = embedded.where("s = 'http://ex.org/customer/7'").select(F.col("embedded").alias("e"))
    return embedded.join(wanted, F.col("embedded") == F.col("e")).groupBy("s").agg(F.count(F.lit(1)).alias("copies"))


@query("SELECT p, coalesce(o, o_lit) AS v FROM (SELECT 'ex:address' AS p, NULL AS o, NULL AS o_lit UNION ALL SELECT 'ex:segment', NULL, c_mktsegment FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'ex:place', NULL, NULL UNION ALL SELECT 'ex:partOf', 'http://ex.org/nation/' || c_nationkey, NULL FROM customer WHERE c_custkey = 7)")
def g15_metadata_subgraph(spark, d):
    meta, _ = B.metadata_subgraph(triplify.with_blanks(spark, d), "http://ex.org/customer/7")
    return meta.select("p", F.coalesce("o", "o_lit").alias("v"))


@query("SELECT s, p, coalesce(o, o_lit) AS v FROM places WHERE s = 'http://ex.org/customer/7' OR s IN (SELECT 'http://ex.org/nation/' || c_nationkey FROM customer WHERE c_custkey = 7) OR s IN (SELECT 'http://ex.org/region/' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7)", "places")
def g12_referenced_closure(spark, d):
    start = spark.createDataFrame([("http://ex.org/customer/7",)], "node string")
    t = triples(spark, d, "region", "nation", "customer", "supplier").where("p <> 'ex:segment'")
    return B.referenced_closure(t, start).select("s", "p", F.coalesce("o", "o_lit").alias("v"))


@query("""WITH RECURSIVE e AS (SELECT id AS s, id // 10 AS o FROM terms WHERE id > 9), w AS (SELECT CAST(3 AS BIGINT) AS node UNION SELECT e.s FROM w JOIN e ON e.o = w.node) SELECT node AS member FROM w WHERE node <> 3""", "terms", recursive=True)
def g13_termset_members(spark, d):
    t = triplify.term_tables(spark, d)["terms"]
    edges = t.where("id > 9").select(F.floor(F.col("id") / 10).cast("string").alias("s"), F.lit("ex:includesTerm").alias("p"), F.col("id").cast("string").alias("o"))
    return C.transitive_closure(edges, spark.createDataFrame([("3",)], "node string")).select(F.col("o").cast("long").alias("member")).distinct()


@query("SELECT s, o, 'direct' AS kind FROM places WHERE p = 'ex:partOf' AND o IN ('http://ex.org/nation/1', 'http://ex.org/nation/2') UNION ALL SELECT DISTINCT 'http://ex.org/supplier/' || s_suppkey, 'http://ex.org/nation/' || s_nationkey, 'lifted' FROM supplier WHERE s_nationkey IN (1, 2)", "places")
def g3_closure_all(spark, d):
    starts = spark.createDataFrame([("http://ex.org/nation/1",), ("http://ex.org/nation/2",)], "node string")
    direct = triples(spark, d, "region", "nation", "customer", "supplier").where("p = 'ex:partOf'").select("s", F.lit("direct").alias("p"), "o")
    lifted = C.lift_restrictions(triplify.with_blanks(spark, d)).select("s", F.lit("lifted").alias("p"), "o")
    return C.transitive_closure(direct.unionByName(lifted), starts, "object").select("s", "o", F.col("p").alias("kind"))


@query("SELECT s, sha256(unhex(string_agg(pair, '' ORDER BY pair))) AS condensed FROM (SELECT DISTINCT s, pair FROM ids) GROUP BY s", "ids")
def i6_metadata_identity(spark, d):
    return I.named_records(triples(spark, d)).select("s", low("condensed").alias("condensed"))


@query("SELECT source AS name, sha256(source || lang) AS identity, CASE WHEN count(*) OVER (PARTITION BY source) = 1 THEN 'bound' ELSE 'pointer' END AS type FROM (SELECT DISTINCT source, lang FROM documents)")
def i7_name_bindings(spark, d):
    pairs = table(spark, d, "documents").select("source", "lang").distinct()
    n = pairs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(n, "source").select(F.col("source").alias("name"), F.sha2(F.concat("source", "lang"), 256).alias("identity"), F.when(F.col("n") == 1, "bound").otherwise("pointer").alias("type"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'etag' WHEN p_partkey % 7 = 0 THEN 'length' END AS mismatch FROM part")
def i8_metadata_mismatch(spark, d):
    k = F.col("p_partkey")
    old = (F.lit("a"), F.col("p_size"))
    new = (F.when(k % 5 == 0, "b").when(k % 3 == 0, None).otherwise("a"), F.when(k % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    differs = lambda a, b: F.coalesce(a != b, F.lit(False))  # noqa: E731  a missing value is no mismatch
    return table(spark, d, "part").select("p_partkey", F.when(differs(old[0], new[0]), "etag").when(differs(old[1], new[1]), "length").alias("mismatch"))


@query("SELECT CAST(count(*) FILTER (WHERE k > 1) AS BIGINT) AS asked_before, CAST(count(*) FILTER (WHERE k = 1 AND low IN (SELECT lower(n_name) FROM nation)) AS BIGINT) AS registered, CAST(count(*) FILTER (WHERE k = 1 AND low NOT IN (SELECT lower(n_name) FROM nation)) AS BIGINT) AS minted FROM (SELECT lower(p_name) AS low, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS k FROM part)")
def v9_new_entities(spark, d):
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("request"), F.col("p_name").alias("label"))
    minted, bad = B.new_entities(asked, table(spark, d, "nation").select(F.col("n_name").alias("label")), 1000)
    both = minted.select(F.lit("minted").alias("r")).unionByName(bad.select(F.col("reason").alias("r")))
    n = lambda x: F.count_if(F.col("r") == x)
    return both.agg(n("asked before").alias("asked_before"), n("registered").alias("registered"), n("minted").alias("minted"))


@query("SELECT 'http://ex.org/spec/' || n_regionkey AS s, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS kept, count(*) FILTER (WHERE n_nationkey % 2 = 1) AS gone FROM nation GROUP BY 1")
def v10_spec_patch(spark, d):
    n = table(spark, d, "nation")
    spec = V.make_spec(n.groupBy("n_regionkey").agg(F.collect_list(triplify.iri("nation", "n_nationkey")).alias("subjects")).select(triplify.iri("spec", "n_regionkey").alias("uri"), F.lit("t").alias("title"), "subjects"))
    gone = triplify.rule(n.where("n_nationkey % 2 = 1"), triplify.iri("spec", "n_regionkey"), "ex:include-subject", o=triplify.iri("nation", "n_nationkey")).withColumn("op", F.lit("del"))
    checked = V.check_patch(spec, gone)
    members = spec.where("p = 'ex:include-subject'").groupBy("s").agg(F.count(F.lit(1)).alias("all"))
    cut = checked.where("error is null").groupBy("s").agg(F.count(F.lit(1)).alias("gone"))
    return members.join(cut, "s", "left").fillna(0, ["gone"]).select("s", (F.col("all") - F.col("gone")).alias("kept"), "gone")


@query("SELECT graph, count(*) AS n, count(DISTINCT s) AS subjects FROM graphs WHERE graph IN ('g0', 'g3') GROUP BY graph", "graphs")
def p11_replicas_of_graphs(spark, d):
    asked = spark.createDataFrame([("g0",), ("g3",)], "graph string")
    return graph_rows(spark, d).join(F.broadcast(asked), "graph", "left_semi").groupBy("graph").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"))  # two rows


@query("SELECT page_id, coalesce(n_name, url) AS target FROM (SELECT page_id, url, CAST(page_id % 40 AS INTEGER) AS k FROM pages) LEFT JOIN nation ON n_nationkey = k")
def p14_uri_path_lookup(spark, d):
    """The mapped term, else the raw uri."""
    mapped = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    return table(spark, d, "pages").select("page_id", "url", (F.col("page_id") % 40).alias("k")).join(mapped, "k", "left").select("page_id", F.coalesce("n_name", "url").alias("target"))


@query("SELECT n_name FROM nation WHERE n_name IN ('NATION_3', 'NATION_7', 'ATLANTIS')")
def p15_group_lookup(spark, d):
    return table(spark, d, "nation").where(F.col("n_name").isin("NATION_3", "NATION_7", "ATLANTIS")).select("n_name")


@query("SELECT sha256(unhex(sha256(s)) || unhex(c)) AS record, s FROM (SELECT s, sha256(unhex(string_agg(pair, '' ORDER BY pair))) AS c FROM (SELECT DISTINCT s, pair FROM ids) GROUP BY s)", "ids")
def p17_subject_of_record(spark, d):
    return I.named_records(triples(spark, d)).groupBy(low("embedded").alias("record")).agg(F.min("s").alias("s"))


@query("SELECT DISTINCT id, p, v FROM (SELECT id, 'synonym' AS p, p_brand || ' ' || p_size AS v FROM terms JOIN part ON p_partkey = id WHERE id % 2 = 0 UNION ALL SELECT a.id, 'super', b.tx FROM terms a JOIN terms b ON b.id = a.id // 2 WHERE a.id > 1 UNION ALL SELECT a.id, 'related', b.tx FROM terms a JOIN terms b ON b.id = a.id // 3 + 1 WHERE a.id > 10 AND a.id % 5 > 0 UNION ALL SELECT id, 'note', CASE WHEN id % 2 = 0 THEN 'FMAID: ' || id ELSE p_type END FROM terms JOIN part ON p_partkey = id WHERE id > 10 AND id % 9 > 0)", "terms")
def j7_id_triples(spark, d):
    ts = triplify.term_tables(spark, d)
    name = ts["terms"].select(F.col("id").alias("other"), F.col("tx").alias("v"))
    parts = [
        ts["synonyms"].select(F.col("tid").alias("id"), F.lit("synonym").alias("p"), F.col("literal").alias("v")),
        ts["superclasses"].withColumnRenamed("superclass_tid", "other").join(name, "other").select(F.col("tid").alias("id"), F.lit("super").alias("p"), "v"),
        ts["relationships"].where("withdrawn <> '1'").withColumnRenamed("term2_id", "other").join(name, "other").select(F.col("term1_id").alias("id"), F.lit("related").alias("p"), "v"),
        ts["annotations"].where("withdrawn <> '1'").select(F.col("tid").alias("id"), F.lit("note").alias("p"), F.col("value").alias("v")),
    ]
    return triplify.union(*parts).distinct()


@query("SELECT DISTINCT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'P'")
def j14_pulls(spark, d):
    t = lambda n: table(spark, d, n)
    return (
        t("orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")
    )


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'owner' WHEN 2 THEN 'contributor' WHEN 3 THEN 'curator' ELSE 'view' END AS role, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 < 3")
def j19_roles(spark, d):
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    held = table(spark, d, "supplier").withColumn("role", role).where(role_rank(F.col("role")) <= 3)
    return held.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "role", "n_name")


@query("SELECT t.triple AS about, 'checked ' || t.s AS note FROM ids t WHERE t.s LIKE '%/region/%'", "ids")
def j23_annotations(spark, d):
    t = I.with_triple_identity(triples(spark, d, "region"))
    notes = t.select(F.col("triple_identity").alias("about"), F.concat(F.lit("checked "), "s").alias("note"))
    return t.join(notes, F.col("triple_identity") == F.col("about")).select(low("about").alias("about"), "note")


@query("SELECT e.curie, CAST(min(p.tid) AS BIGINT) AS tid FROM existing e JOIN existing p ON p.iri = 'http://purl.ex.net/obo/X_' || substr(e.curie, 3) WHERE e.curie LIKE 'X:%' GROUP BY e.curie", "existing")
def j27_namespace_redirect(spark, d):
    ids = triplify.term_tables(spark, d)["existing"]
    curies = spark.createDataFrame([("X", "http://purl.ex.net/obo/X_")], "prefix string, namespace string")
    asked = iris.expand_curies(ids.where("curie like 'X:%'").select("curie").distinct(), "curie", F.broadcast(curies))  # one row
    return asked.join(ids.select("iri", "tid"), "iri").groupBy("curie").agg(F.min("tid").alias("tid"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '/[a-z]{2}/[0-9]+$') THEN regexp_extract(url, '/([a-z]{2})/[0-9]+$', 1) ELSE 'error' END AS grp FROM pages")
def j29_user_uri_map(spark, d):
    got = F.nullif(F.regexp_extract("url", "/([a-z]{2})/[0-9]+$", 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", F.coalesce(got, F.lit("error")).alias("grp"))


@query("SELECT p_partkey, md5(p_name) AS k, substr(sha256(p_name), 1, 19) AS tag, string_split(p_name, ' ')[-1] AS last FROM part")
def f1_digests(spark, d):
    return table(spark, d, "part").select("p_partkey", F.md5("p_name").alias("k"), F.substring(F.sha2("p_name", 256), 1, 19).alias("tag"), F.substring_index("p_name", " ", -1).alias("last"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'http://purl.org/sig/ont/fma/fma' || id END AS iri, CASE WHEN id % 2 = 1 THEN p_type END AS literal FROM terms JOIN part ON p_partkey = id WHERE id > 10", "terms")
def f11_annotation_objects(spark, d):
    i, lit = iris.annotation_object(F.col("value"))
    return triplify.term_tables(spark, d)["annotations"].select(F.col("tid").alias("id"), i.alias("iri"), lit.alias("literal"))


@query("SELECT id, CASE WHEN (id // 2) % 10 = 0 THEN 'ex:synonym' ELSE ['ex:synonyms/abbreviation', 'ex:synonyms/broad', 'ex:synonyms/exact', 'ex:synonyms/narrow', 'ex:synonyms/related', 'fma:synonym', 'NIFRID:synonym', 'NIFRID:synonym', 'NIFRID:abbrev'][(id // 2) % 10] END AS p FROM terms WHERE id % 2 = 0", "terms")
def f16_synonym_types(spark, d):
    return triplify.term_tables(spark, d)["synonyms"].select(F.col("tid").alias("id"), triplify.synonym_predicate(F.col("type")).alias("p"))


@query("SELECT s, p, coalesce(o, o_lit) AS v FROM triples WHERE s IN ('http://ex.org/nation/1', 'http://ex.org/nation/2') UNION SELECT s, p, o_lit FROM triples WHERE p = 'ex:brand'", "triples")
def u1_union_distinct(spark, d):
    t = triples(spark, d).select("s", "p", F.coalesce("o", "o_lit").alias("v"))
    return t.where(F.col("s").isin("http://ex.org/nation/1", "http://ex.org/nation/2")).union(t.where("p = 'ex:brand'")).distinct()


@query("SELECT 'part' AS kind, p_name AS name, p_size AS size FROM part UNION ALL SELECT 'nation', n_name, NULL FROM nation")
def u2_union_all(spark, d):
    a = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return a.unionByName(table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_name").alias("name")), allowMissingColumns=True)


@query("SELECT c_nationkey, c_mktsegment, c_name, c_acctbal FROM customer ORDER BY c_nationkey, c_mktsegment DESC, c_acctbal DESC, c_name")
def o1_multi_key_order(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_name", "c_acctbal")
    return rows.orderBy("c_nationkey", F.desc("c_mktsegment"), F.desc("c_acctbal"), "c_name")


@query("SELECT DISTINCT p FROM triples", "triples")
def c13_untyped_predicates(spark, d):
    """Predicates in use that no triple types as a property."""
    return L.predicate_is_property(triples(spark, d)).where("not is_property").select("p")


@query("SELECT perspective, count(*) AS heads FROM (SELECT *, row_number() OVER (PARTITION BY perspective, subject ORDER BY ts DESC, head DESC) AS r FROM log) WHERE r = 1 GROUP BY perspective", "log")
def t2_heads_stream(spark, d):
    """The log read as a stream of files to its end: each subject's newest head, counted by perspective."""
    from ..streaming.streams import heads_stream, run_to_end

    log = event_stream(spark, d).select(
        (F.col("user_id") % 25).alias("perspective"), F.concat(F.lit("http://ex.org/part/"), (F.col("event_id") % 200).cast("string")).alias("subject"),
        F.when(F.col("event_type") == "error", "").otherwise(F.sha2((F.col("event_id") % 97).cast("string"), 256)).alias("head"), "ts")
    return run_to_end(heads_stream(log), "complete").groupBy("perspective").agg(F.count(F.lit(1)).alias("heads"))


def event_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY user_id, event_type")
def t1_incremental_ingest(spark, d):
    """Events ingested as a stream, then once more: what is there already is not added again, and only folders of a batch's keys are read."""
    from ..functions.shared import new_path
    from ..streaming.streams import ingest_stream

    schema, sink = "event_id long, user_id long, event_type string", new_path(spark, "sink")
    for _ in range(2):
        ingest_stream(spark, f"{d}/events.parquet*", schema, sink, ["event_id"], new_path(spark, "state"), by=F.floor(F.col("event_id") / 10_000)).awaitTermination()
    return spark.read.schema(schema).parquet(sink).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT review, count(DISTINCT reviewer) AS present FROM votes WHERE vote <> 'absent' GROUP BY review", "votes")
def t3_quorum_stream(spark, d):
    """Distinct voters of each review, kept as state while votes stream in."""
    from ..streaming.streams import keyed_state, quorum_stream, run_to_end

    kind = triplify.mapped({"purchase": "approve", "click": "approve", "error": "deny", "signup": "absent"}, F.col("event_type"))
    votes = event_stream(spark, d).select((F.col("event_id") % 60).alias("review"), (F.col("user_id") % 15).alias("reviewer"), F.coalesce(kind, F.lit("present")).alias("vote"))
    with keyed_state(spark):
        return run_to_end(quorum_stream(votes, 5), "update").groupBy("review").agg(F.max("present").alias("present"))


def to_millis(at):
    """A time to the nearest millisecond, halves away from 1970, as DuckDB's ``epoch_ms`` takes it."""
    t = at.cast("timestamp")
    rest = F.unix_micros(t) - F.unix_millis(t) * 1000
    return F.timestamp_millis(F.unix_millis(t) + F.when((rest > 500) | (rest == 500) & (F.unix_micros(t) > 0), 1).otherwise(0))


@query("""WITH e AS (SELECT event_id, epoch_ms(ts) AS born, event_id % 7 * 86400000 AS delay, (event_id % 5 + 1) * 86400000 AS life, (SELECT epoch_ms(max(ts)) FROM events) - 3600000 AS now FROM events)
 SELECT event_id AS key, state FROM (SELECT event_id, unnest([CASE WHEN true THEN 'early' END, CASE WHEN born + delay <= now THEN 'active' END, CASE WHEN born + delay + life <= now THEN 'expired' END]) AS state FROM e) WHERE state IS NOT NULL""")
def t4_token_timers(spark, d):
    """Every token's states as event time passes their limits: no further row of a token is needed."""
    from ..streaming.streams import run_timers, token_steps

    k, ts = F.col("event_id"), to_millis(F.col("ts"))
    rows = event_stream(spark, d).select(k.alias("key"), ts.alias("ts"), token_steps(ts, k % 7 * 86400, (k % 5 + 1) * 86400).alias("steps"))
    return run_timers(rows, "1 hour").select("key", "state")


@query("""WITH s AS (SELECT event_id AS review, ts AS start, CAST(event_id % 9 AS INTEGER) AS days, CASE WHEN event_id % 3 > 0 THEN event_id % 7 END AS dow FROM events),
 a AS (SELECT *, start + to_days(days) AS after FROM s), c AS (SELECT review, CASE WHEN dow IS NULL THEN after ELSE date_trunc('day', after) + to_days(CAST((dow - dayofweek(after) + 7) % 7 + 1 AS INTEGER)) - INTERVAL 1 SECOND END AS closes FROM a)
 SELECT review, closes, epoch_ms(closes) <= (SELECT epoch_ms(max(ts)) FROM events) - 3600000 AS closed FROM c""")
def r7_review_timers(spark, d):
    """Reviews that close by themselves: each one's closing time, and whether the stream has told of it."""
    from ..operators.review import close_time
    from ..streaming.streams import review_steps, run_timers

    def opened(events):
        k = F.col("event_id")
        return events.select(k.alias("key"), "ts", close_time(F.col("ts"), (k % 9).cast("int"), F.when(k % 3 > 0, k % 7)).alias("closes"))

    told = run_timers(opened(event_stream(spark, d)).select("key", to_millis(F.col("ts")).alias("ts"), review_steps(to_millis(F.col("closes"))).alias("steps")), "1 hour")
    closed = told.where("state = 'closed'").select("key", F.lit(True).alias("closed"))
    return opened(table(spark, d, "events")).join(closed, "key", "left").select(F.col("key").alias("review"), "closes", F.coalesce("closed", F.lit(False)).alias("closed"))


@query("""WITH t AS (SELECT 'http://ex.org/order/' || o_orderkey AS subject, o_orderstatus AS event_type, unnest(['http://ex.org/customer/' || c_custkey, 'http://ex.org/nation/' || c_nationkey, 'http://ex.org/region/' || n_regionkey]) AS target
   FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
 f AS (SELECT 'n' || n_nationkey AS follower, 'http://ex.org/nation/' || n_nationkey AS target, CASE WHEN n_nationkey % 2 = 0 THEN 'F' ELSE 'O' END AS kind FROM nation UNION ALL SELECT 'r' || r_regionkey, 'http://ex.org/region/' || r_regionkey, 'P' FROM region
   UNION ALL SELECT 'c' || c_custkey, 'http://ex.org/customer/' || c_custkey, 'O' FROM customer WHERE c_custkey % 10 = 0)
 SELECT follower, t.target, subject, event_type FROM t JOIN f ON f.target = t.target AND f.kind = t.event_type""")
def t6_follow_ancestors(spark, d):
    """Orders stream in; followers of a customer, its nation or its region hear of those of their kind, over a closure that grows."""
    from ..functions.shared import new_path
    from ..operators.closure import extend_closure
    from ..streaming.streams import follow_ancestors_stream

    places = triples(spark, d, "region", "nation", "customer").where("p = 'ex:partOf'").select(F.col("s").alias("a"), F.col("o").alias("b"))
    pairs, notices = new_path(spark, "closure"), new_path(spark, "notices")
    extend_closure(spark.createDataFrame([], "node string, ancestor string"), places).write.parquet(f"{pairs}/batch=-1")
    who = lambda t, key, letter, kind: table(spark, d, t).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("follower"), triplify.iri(t, key).alias("target"), kind.alias("event_type"))
    all_ = who("nation", "n_nationkey", "n", F.when(F.col("n_nationkey") % 2 == 0, "F").otherwise("O")).unionByName(who("region", "r_regionkey", "r", F.lit("P")))
    all_ = all_.unionByName(who("customer", "c_custkey", "c", F.when(F.col("c_custkey") % 10 == 0, "O")).where("event_type is not null"))
    orders = spark.readStream.schema(table(spark, d, "orders").schema).parquet(f"{d}/orders.parquet*")
    events = orders.select(triplify.iri("order", "o_orderkey").alias("subject"), triplify.iri("customer", "o_custkey").alias("part_of"), F.col("o_orderstatus").alias("event_type"), F.col("o_orderdate").alias("ts"))
    follow_ancestors_stream(events, pairs, all_.select("follower", "target"), all_.select("follower", "event_type"), notices, new_path(spark, "state")).awaitTermination()
    return spark.read.schema("follower string, target string, subject string, event_type string, ts timestamp").parquet(notices).select("follower", "target", "subject", "event_type")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def t4_event_windows_stream(spark, d):
    """Hourly counts of each kind of event over event time, as a stream."""
    from ..streaming.streams import run_to_end, token_windows

    return run_to_end(token_windows(event_stream(spark, d), "0 seconds"), "complete").select("event_type", F.col("window.start").alias("start"), "n")


@query("SELECT 'g' || k AS graph, count(*) AS n FROM (SELECT n_regionkey AS k FROM nation) GROUP BY k")
def s17_load_resource_list(spark, d):
    """One file of lines for each graph of a list, all read in one job; the file names the graph."""
    from ..functions.shared import new_path

    t = triples(spark, d, "nation").where("p = 'ex:partOf'")
    graph = F.concat(F.lit("g"), F.substring_index("o", "/", -1))
    path = new_path(spark, "resources")
    ntriples.dump_ntriples(t.withColumn("graph", graph)).select(F.concat(F.lit("g"), F.regexp_extract("line", "region/([0-9]+)>", 1)).alias("graph"), F.col("line").alias("value")).write.partitionBy("graph").text(path)
    got = ntriples.read_ntriples(spark, path)
    return got.select(F.regexp_extract("graph", "graph=([^/]+)/", 1).alias("graph")).groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
