"""Writes over the given tables: new entities in bundles, patches with history and heads, pulls, specs, preferred iris."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.identity import low
from ..operators import entities as E
from ..operators.review import ROLES
from ..operators.versions import heads as heads_of
from ..sources.triplify import iri, rule, union
from .base import CTES, head_log, query, table, triples
from .releases import _lit, _of, _pair

HOST = "http://uri.ex.org/"


# --- new entities ---------------------------------------------------------------------------------------------------------

def _bundle(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    text = lambda c: F.col(c).cast("string")
    requests = part.select(k.alias("request"), F.lit("owl:Class").alias("rdf_type"), F.concat_ws(" ", "p_name", text("p_size"), F.when(k % 3 == 0, text("p_brand"))).alias("label"), F.concat(F.lit("group"), (k % 5).cast("string")).alias("grp"), F.to_timestamp(F.lit("2024-01-01")).alias("ts"))
    exacts = part.where(k % 4 == 1).select(k.alias("request"), F.concat_ws(" ", "p_brand", text("p_size")).alias("literal")).unionByName(part.where(k % 6 == 1).select(k.alias("request"), F.concat(F.lit("x"), text("p_partkey")).alias("literal")))
    exacts = exacts.unionByName(part.where(k % 12 == 5).select(k.alias("request"), F.concat_ws(" ", "p_name", (F.col("p_size") + 1).cast("string")).alias("literal")))
    registry = table(spark, d, "nation").select(F.col("n_name").alias("label")).unionByName(part.where(k % 50 == 1).select(F.concat_ws(" ", F.upper("p_name"), text("p_size")).alias("label")))
    return E.bundle(requests, exacts, registry, 1000, HOST)


CTES |= {
    "en_r": "SELECT p_partkey AS request, p_name || ' ' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_brand ELSE '' END AS label, 'group' || (p_partkey % 5) AS grp FROM part",
    "en_x": """SELECT p_partkey AS request, p_brand || ' ' || p_size AS literal FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT p_partkey, 'x' || p_partkey FROM part WHERE p_partkey % 6 = 1
        UNION ALL SELECT p_partkey, p_name || ' ' || (p_size + 1) FROM part WHERE p_partkey % 12 = 5""",
    "en_k": "SELECT lower(n_name) AS low FROM nation UNION SELECT lower(p_name || ' ' || p_size) FROM part WHERE p_partkey % 50 = 1",
    "en_b": """SELECT DISTINCT x.request FROM en_x x LEFT JOIN (SELECT lower(label) AS low, min(request) AS by_ FROM en_r GROUP BY 1) l ON l.low = lower(literal) JOIN (SELECT lower(literal) AS low, min(request) AS first FROM en_x GROUP BY 1) f ON f.low = lower(literal)
        WHERE lower(literal) IN (SELECT low FROM en_k) OR first < x.request OR by_ <> x.request""",
    "en_a": "SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY request) AS turn, lower(label) IN (SELECT low FROM en_k) AS known FROM en_r WHERE request NOT IN (SELECT request FROM en_b)",
    "en_m": "SELECT *, 'http://uri.ex.org/base/' || id AS s, 'http://uri.ex.org/' || grp || '/ontologies/' || id AS meta FROM (SELECT *, 'tx_' || lpad(CAST(1000 + row_number() OVER (ORDER BY request) AS VARCHAR), 7, '0') AS id FROM en_a WHERE turn = 1 AND NOT known)",
    "en_t": f"""SELECT m.request, {_pair('rdf:type', "sha256('owl:Class')")} AS pair FROM en_m m UNION SELECT request, {_pair('rdfs:label', _lit('label'))} FROM en_m UNION SELECT m.request, {_pair('ex:hasExactSynonym', _lit('literal'))} FROM en_m m JOIN en_x USING (request)""",
    "en_p": f"""SELECT m.*, sha256(unhex(sha256(m.s)) || unhex(c)) AS s_record, n AS s_n, {_of(_pair('rdf:type', "sha256('owl:Ontology')"))} AS meta_condensed FROM en_m m JOIN (SELECT request, sha256(unhex(string_agg(pair, '' ORDER BY pair))) AS c, count(*) AS n FROM en_t GROUP BY request) USING (request)""",
    "en_q": f"SELECT *, {_of('sha256(meta)', 'meta_condensed')} AS meta_record FROM en_p",
    "en_g": f"""SELECT *, {_of('s_record', "sha256('')")} AS s_combined, sha256(unhex(CASE WHEN s_record < meta_record THEN s_record || meta_record ELSE meta_record || s_record END)) AS seq, {_of('meta_record')} AS meta_seq FROM en_q""",
    "en_h": f"""SELECT *, {_of('seq', "sha256('')")} AS graph, {_of('meta_seq', "sha256('')")} AS meta_graph FROM en_g""",
    "en_f": f"""SELECT *, {_of("sha256('')", 'graph')} AS release FROM en_h""",
}
EN = ("en_r", "en_x", "en_k", "en_b", "en_a", "en_m", "en_t", "en_p", "en_q", "en_g", "en_h", "en_f")


@query("SELECT request, id, 'http://uri.ex.org/base/' || id AS s, meta, CAST(NULL AS VARCHAR) AS reason FROM en_m UNION ALL SELECT request, NULL, NULL, NULL, 'exact synonym is taken' FROM en_b UNION ALL SELECT request, NULL, NULL, NULL, CASE WHEN known THEN 'registered' ELSE 'asked before' END FROM en_a WHERE turn > 1 OR known", *EN)
def v9_minted_or_refused(spark, d):
    """Every request: the id that it got, or why it got none."""
    b = _bundle(spark, d)
    none = F.lit(None).cast("string")
    return b["minted"].withColumn("reason", none).unionByName(b["refused"].select("request", none.alias("id"), none.alias("s"), none.alias("meta"), "reason"))


_EDGES = [("release", "hasLocalConventions", "sha256('')"), ("release", "hasGraph", "graph"), ("graph", "hasNamedGraph", "seq"), ("graph", "hasBnodeGraph", "sha256('')"), ("seq", "hasNamedRecord", "s_record"), ("seq", "hasNamedRecord", "meta_record"), ("s_combined", "hasNamedRecord", "s_record"),
          ("release", "hasMetadataGraph", "meta_graph"), ("meta_graph", "hasNamedGraph", "meta_seq"), ("meta_graph", "hasBnodeGraph", "sha256('')"), ("meta_seq", "hasNamedRecord", "meta_record"), ("meta_record", "hasCondensed", "meta_condensed")]


@query(" UNION ".join(f"SELECT {a} AS s, '{p}' AS p, {o} AS o FROM en_f" for a, p, o in _EDGES), *EN)
def v9_relations(spark, d):
    """The twelve relations of each new entity."""
    return _bundle(spark, d)["relations"].select(low("s").alias("s"), "p", low("o").alias("o"))


@query("SELECT grp, s AS subject, s_combined AS head, sha256('') AS previous, s_n AS n, (SELECT count(*) FROM en_x WHERE request = f.request) + 1 AS strings FROM en_f f", *EN)
def v9_history_and_heads(spark, d):
    """Head, history and registered strings of each new entity."""
    b = _bundle(spark, d)
    n = b["identities"].where("type = 'record_combined'").select(F.col("identity").alias("head"), "n")
    strings = b["strings"].groupBy("id").agg(F.count(F.lit(1)).alias("strings"))
    out = b["heads"].join(b["history"].select(F.col("record").alias("head"), "previous"), "head").join(n, "head").join(b["minted"].select("id", F.col("s").alias("subject")), "subject").join(strings, "id")
    return out.select("grp", "subject", low("head").alias("head"), low("previous").alias("previous"), "n", "strings")


# --- patches --------------------------------------------------------------------------------------------------------------

def _commit(spark, d):
    part, k, s = table(spark, d, "part"), F.col("p_partkey"), iri("part", "p_partkey")
    t = triples(spark, d, "part")
    row = lambda where, p, value, op: rule(part.where(where), s, p, o_lit=value).withColumn("op", F.lit(op))
    patch = row(k % 4 == 1, "ex:brand", F.when(k % 8 == 1, F.col("p_brand")).otherwise(F.lit("no such brand")), "del").unionByName(row(k % 4 == 1, "ex:note", F.lit("checked"), "add")).unionByName(row(k % 4 == 2, "rdfs:label", F.col("p_name"), "add"))
    heads = part.where(k % 3 == 0).select(F.lit("team").alias("grp"), s.alias("subject"), F.unhex(F.sha2(k.cast("string"), 256)).alias("head")).union(part.select(F.lit("other"), s, F.unhex(F.sha2(F.lit(""), 256))))
    return E.commit(t, patch, heads, "team", F.to_timestamp(F.lit("2024-05-01")))


_RECORD = "sha256(unhex(sha256(unhex(sha256(s)) || unhex(sha256(unhex(string_agg(pair, '' ORDER BY pair)))))) || unhex(sha256('')))"


@query(f"""WITH k AS (SELECT p_partkey AS k, 'http://ex.org/part/' || p_partkey AS s FROM part), b AS (SELECT s, {_RECORD} AS made FROM (SELECT DISTINCT s, pair FROM ids) GROUP BY s),
 x AS (SELECT s, pair FROM ids WHERE s IN (SELECT s FROM k WHERE k % 8 = 1) AND p <> 'ex:brand' UNION SELECT s, {_pair('ex:note', _lit("'checked'"))} FROM k WHERE k % 8 = 1), n AS (SELECT s, {_RECORD} AS record, count(*) AS n FROM x GROUP BY s)
 SELECT k.s, record, CASE WHEN k % 3 = 0 THEN sha256(CAST(k AS VARCHAR)) ELSE made END AS previous, n, record AS head, CASE WHEN k % 8 = 5 THEN 'delete absent' WHEN k % 4 = 2 THEN 'add present' END AS reason
 FROM k LEFT JOIN n ON n.s = k.s LEFT JOIN b ON b.s = k.s AND n.s IS NOT NULL WHERE k % 4 IN (1, 2)""".replace("CASE WHEN k % 3 = 0 THEN sha256", "CASE WHEN record IS NULL THEN NULL WHEN k % 3 = 0 THEN sha256"), "ids")
def v5_commit(spark, d):
    """Patched subjects with their new record, history and head, or why the patch was refused."""
    c = _commit(spark, d)
    done = c["records"].join(c["history"].select("s", "previous"), "s").join(c["heads"].select(F.col("subject").alias("s"), "head"), "s")
    done = done.select("s", low("record").alias("record"), low("previous").alias("previous"), "n", low("head").alias("head"), F.lit(None).cast("string").alias("reason"))
    return done.unionByName(c["refused"].select("s", *[F.lit(None).cast(t).alias(x) for x, t in (("record", "string"), ("previous", "string"), ("n", "long"), ("head", "string"))], "reason"))


# --- pulls ----------------------------------------------------------------------------------------------------------------

HEADS = "h AS (SELECT perspective, subject, head FROM (SELECT *, row_number() OVER (PARTITION BY perspective, subject ORDER BY ts DESC, head DESC) AS r FROM log) WHERE r = 1 AND head <> '')"
ASKED = "q AS (SELECT o_orderkey AS pull, 'http://ex.org/part/' || (o_orderkey % 250) AS subject, o_custkey % 25 AS from_p, o_orderkey % 37 AS to_p, o_custkey % 30 AS actor FROM orders)"


def _pulls(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("pull"), F.concat(F.lit("http://ex.org/part/"), (k % 250).cast("string")).alias("subject"), (F.col("o_custkey") % 25).alias("from_p"), (k % 37).alias("to_p"), (F.col("o_custkey") % 30).alias("actor"))


@query(f"""WITH {HEADS}, {ASKED}, c AS (SELECT 'http://ex.org/part/' || (p_partkey % 250) AS subject, sha256(CAST(p_partkey % 120 AS VARCHAR)) AS record, p_partkey AS seen FROM part WHERE p_partkey % 7 > 0),
 u AS (SELECT subject, arg_max(record, (seen, record)) AS newest FROM c WHERE (subject, record) NOT IN (SELECT (subject, head) FROM log) GROUP BY subject),
 x AS (SELECT pull, a.head AS from_head, coalesce(b.head, CASE WHEN a.head IS NOT NULL THEN newest END) AS to_head, b.head AS own FROM q LEFT JOIN h a ON a.subject = q.subject AND a.perspective = from_p LEFT JOIN h b ON b.subject = q.subject AND b.perspective = to_p LEFT JOIN u ON u.subject = q.subject)
 SELECT pull, from_head, to_head, CASE WHEN from_head IS NULL AND own IS NULL THEN 'no heads' WHEN from_head IS NULL THEN 'no source head' WHEN from_head = to_head THEN 'same head' END AS error FROM x""", "log")
def r1_open_pulls(spark, d):
    """Pulls with both heads; a target without one stands at the newest record that was never a head."""
    k = F.col("p_partkey")
    records = table(spark, d, "part").where(k % 7 > 0).select(F.concat(F.lit("http://ex.org/part/"), (k % 250).cast("string")).alias("subject"), F.sha2((k % 120).cast("string"), 256).alias("record"), k.alias("first_seen"))
    log = head_log(spark, d)
    return E.open_pulls(_pulls(spark, d), heads_of(log), records, log.select("subject", "head")).select("pull", "from_head", "to_head", "error")


_MERGE = f"""WITH {HEADS}, {ASKED}, x AS (SELECT q.*, CASE WHEN pull % 7 = 0 THEN 'merged' ELSE 'pending' END AS status, CASE WHEN pull % 5 = 0 THEN 'other' ELSE head END AS expected FROM q JOIN h ON h.subject = q.subject AND h.perspective = from_p),
 r AS (SELECT c_custkey % 30 AS actor, c_nationkey AS grp, min(c_custkey % 13 + 1) AS rank FROM customer GROUP BY ALL),
 o AS (SELECT x.*, CASE WHEN status <> 'pending' THEN 'not pending' WHEN expected = 'other' THEN 'head moved' WHEN NOT (x.actor = to_p OR coalesce(rank, 99) < 5) THEN 'no role' ELSE 'merged' END AS outcome FROM x LEFT JOIN r ON r.actor = x.actor AND r.grp = to_p)"""


def _merged(spark, d):
    now = heads_of(head_log(spark, d))
    k = F.col("pull")
    own = now.select("subject", F.col("perspective").alias("from_p"), "head")
    p = _pulls(spark, d).join(own, ["subject", "from_p"]).select("*", F.col("to_p").alias("to_grp"), F.when(k % 7 == 0, "merged").otherwise("pending").alias("status"), F.when(k % 5 == 0, "other").otherwise(F.col("head")).alias("expected")).drop("head")
    c = F.col("c_custkey")
    roles = table(spark, d, "customer").select((c % 30).alias("actor"), F.col("c_nationkey").alias("grp"), F.element_at(F.array(*[F.lit(r) for r in ROLES]), (c % 13 + 1).cast("int")).alias("role"))
    return E.merge(p, now, roles)


@query(f"{_MERGE} SELECT pull, outcome FROM o", "log")
def r2_merge_outcomes(spark, d):
    """Actors are the target group itself or have a role there before view."""
    return _merged(spark, d)[0].select("pull", "outcome")


@query(f"{_MERGE} SELECT to_p AS perspective, subject, arg_max(expected, pull) AS head FROM o WHERE outcome = 'merged' GROUP BY 1, 2", "log")
def r2_moved_heads(spark, d):
    return _merged(spark, d)[1]


# --- specs ----------------------------------------------------------------------------------------------------------------

def _specs(spark, d):
    cust, c = table(spark, d, "customer"), F.col("c_custkey")
    include = "ex:include-subject"
    spec = lambda of: iri("spec", F.floor(of / 10))
    row = lambda where, o, op=None: (lambda x: x if op is None else x.withColumn("op", F.lit(op)))(rule(cust.where(where), spec(c), include, o=o))
    stored = row(c % 2 == 0, iri("customer", "c_custkey"))
    patch = row((c % 10 == 2) & (c % 30 != 12), iri("customer", "c_custkey"), "del").unionByName(row((c % 10 == 3) & (c % 40 != 13), iri("customer", c), "add")).unionByName(row(c % 50 == 4, iri("customer", c), "add")).unionByName(row(c % 70 == 5, iri("customer", c), "del")).unionByName(row(c % 90 == 7, iri("nowhere", c), "add")).unionByName(row(c % 110 == 9, iri("record", c), "add"))
    known = cust.select(iri("customer", "c_custkey").alias("s"), F.lit("term").alias("type")).union(cust.select(iri("record", "c_custkey"), F.lit("record")))
    return E.patch_specs(stored, patch, known, create=True)


CTES |= {
    "sp_c": "SELECT c_custkey AS c, 'http://ex.org/spec/' || (c_custkey // 10) AS s, 'http://ex.org/customer/' || c_custkey AS o FROM customer",
    "sp_e": """SELECT s, o, 'add present' AS reason FROM sp_c WHERE c % 50 = 4 UNION ALL SELECT s, o, 'delete absent' FROM sp_c WHERE c % 70 = 5 AND c % 2 = 1 UNION ALL SELECT s, 'http://ex.org/nowhere/' || c, 'unknown subject' FROM sp_c WHERE c % 90 = 7
        UNION ALL SELECT s, 'http://ex.org/record/' || c, 'subject is a record' FROM sp_c WHERE c % 110 = 9""",
}


@query("SELECT s, o FROM sp_c WHERE c % 2 = 0 AND NOT (s NOT IN (SELECT s FROM sp_e) AND c % 10 = 2 AND c % 30 <> 12) UNION SELECT s, o FROM sp_c WHERE s NOT IN (SELECT s FROM sp_e) AND c % 10 = 3 AND c % 40 <> 13", "sp_c", "sp_e")
def v10_patched_specs(spark, d):
    """Specs after a patch; those with any error are as they were."""
    return _specs(spark, d)[0].select("s", "o")


@query("SELECT s, o, reason FROM sp_e", "sp_c", "sp_e")
def v10_refused_subjects(spark, d):
    return _specs(spark, d)[1]


# --- preferred iris -------------------------------------------------------------------------------------------------------

_X = "'http://purl.ex.net/' || CASE WHEN k % 2 = 0 THEN 'obo' ELSE 'ncbi' END || '/X_' || (k % 400)"
CTES |= {
    "pf_k": "SELECT p_partkey AS k, 'http://ex.org/part/' || p_partkey AS iri, p_name, p_brand FROM part",
    "pf_e": f"SELECT k, iri, {_X} AS existing, CASE WHEN k % 2 = 0 THEN 'obo' ELSE 'ncbi' END AS prefix, 'X_' || (k % 400) AS suffix FROM pf_k WHERE k % 3 = 0 UNION ALL SELECT k, iri, 'http://other.ex.net/Y_' || k, 'other', 'Y_' || k FROM pf_k WHERE k % 4 = 0",
    "pf_m": "SELECT iri, arg_min(existing, (CASE prefix WHEN 'obo' THEN 1 WHEN 'ncbi' THEN 2 ELSE 3 END, CASE WHEN prefix = 'other' THEN prefix ELSE '' END, suffix, existing)) AS to_ FROM pf_e GROUP BY iri UNION ALL SELECT 'ex:brand', 'http://purl.ex.net/p/brand'",
    "pf_t": """SELECT iri AS s, 'rdfs:label' AS p, CAST(NULL AS VARCHAR) AS o, p_name AS o_lit FROM pf_k UNION ALL SELECT iri, 'ex:brand', NULL, p_brand FROM pf_k UNION ALL SELECT iri, 'ex:like', 'http://ex.org/part/' || (k // 2), NULL FROM pf_k
        UNION ALL SELECT iri, 'ex:hasExistingId', 'http://ex.org/part/' || k, NULL FROM pf_k WHERE k % 7 = 0 UNION ALL SELECT iri, 'ex:hasTermId', iri, NULL FROM pf_k WHERE k % 5 > 0""",
    "pf_n": """SELECT t.s AS was, coalesce(a.to_, t.s) AS s, CASE WHEN p IN ('ex:hasTermId', 'rdfs:label') THEN p ELSE coalesce(b.to_, p) END AS p, CASE WHEN p IN ('ex:hasTermId', 'ex:hasExistingId') THEN o ELSE coalesce(c.to_, o) END AS o, o_lit, p AS was_p
        FROM pf_t t LEFT JOIN pf_m a ON a.iri = t.s LEFT JOIN pf_m b ON b.iri = t.p LEFT JOIN pf_m c ON c.iri = t.o""",
}


@query("""SELECT DISTINCT s, p, o, o_lit FROM pf_n WHERE was_p <> 'rdfs:label' UNION SELECT s, CASE WHEN row_number() OVER (PARTITION BY s ORDER BY was, o_lit) = 1 THEN p ELSE 'ex:deprecatedLabel' END, o, o_lit FROM pf_n WHERE was_p = 'rdfs:label'
 UNION SELECT s, 'ex:MISSING_TERM_ID', NULL, 'true' FROM pf_n GROUP BY s HAVING NOT bool_or(was_p = 'ex:hasTermId')""", "pf_k", "pf_e", "pf_m", "pf_t", "pf_n")
def f18_preferred_everywhere(spark, d):
    """Parts under their preferred ids as subjects, predicates and objects; labels that meet collapse to one, missing term ids are flagged."""
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    s, prefix, suffix = iri("part", "p_partkey"), F.when(k % 2 == 0, "obo").otherwise("ncbi"), F.concat(F.lit("X_"), (k % 400).cast("string"))
    y = F.concat(F.lit("Y_"), k.cast("string"))
    existing = part.where(k % 3 == 0).select(s.alias("iri"), F.concat(F.lit("http://purl.ex.net/"), prefix, F.lit("/"), suffix).alias("existing"), prefix.alias("prefix"), suffix.alias("suffix"))
    existing = existing.unionByName(part.where(k % 4 == 0).select(s.alias("iri"), F.concat(F.lit("http://other.ex.net/"), y).alias("existing"), F.lit("other").alias("prefix"), y.alias("suffix")))
    preferred = E.best_existing(existing, ["obo", "ncbi"]).unionByName(spark.createDataFrame([("ex:brand", "http://purl.ex.net/p/brand")], "iri string, to string"))
    t = union(rule(part, s, "rdfs:label", o_lit=F.col("p_name")), rule(part, s, "ex:brand", o_lit=F.col("p_brand")), rule(part, s, "ex:like", o=iri("part", F.floor(k / 2))), rule(part.where(k % 7 == 0), s, E.EXISTING, o=s), rule(part.where(k % 5 > 0), s, E.HAS_ID, o=s))
    return E.prefer(t, preferred).select("s", "p", "o", "o_lit")
