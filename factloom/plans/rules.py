"""Validators, and operators that had no query of their own, over the given tables with rows bent on purpose by their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import iris
from ..functions.identity import low
from ..operators import closure as C
from ..operators import identities as I
from ..operators import lookup as L
from ..operators import quality as Q
from ..operators import validators as V
from ..operators.review import ROLES, role_rank
from ..sources import ntriples, triplify
from .base import head_log, query, table, triples
from .more import event_stream

def null():
    return F.lit(None).cast("string")


def joined(errors="errors"):
    return F.array_join(errors, ",").alias("errors")


def pick(k, values):
    """The value at place ``k`` (from 0) of a list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


_FORMS = "SELECT 'part/' || p_partkey AS s, p_partkey AS k, p_partkey % 5 AS form, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS copies, p_partkey % 2 = 0 AS blank FROM part"


@query(f"""SELECT CASE WHEN blank THEN 'blank ' ELSE 'named ' END || ['iri', 'literal', 'typed', 'language', 'node'][form + 1] AS key, coalesce(CASE WHEN NOT blank THEN s END, '') AS s, coalesce(CASE WHEN blank THEN s END, '') AS s_blank, CAST(copies AS BIGINT) AS n
 FROM ({_FORMS}) WHERE copies > 1""")
def c4_partial_keys(spark, d):
    """A row of each of the ten forms for each part, every third one twice; a copy in another subgraph is no copy."""
    k = F.col("p_partkey")
    form, blank, s = k % 5, k % 2 == 0, F.concat(F.lit("part/"), k.cast("string"))
    rows = table(spark, d, "part").select(
        F.when(~blank, s).alias("s"), F.when(blank, s).alias("s_blank"), F.lit("ex:p").alias("p"), F.when(form == 0, "ex:o").alias("o"), F.when(form == 4, "b1").alias("o_blank"),
        F.when(form.isin(1, 2, 3), F.col("p_name")).alias("o_lit"), F.when(form == 2, "xsd:string").alias("datatype"), F.when(form == 3, "en").alias("language"),
        F.explode(F.sequence(F.lit(1), F.when(k % 3 == 0, 2).otherwise(1))).alias("copy"), F.lit("g").alias("subgraph_identity"))
    other = rows.where("s_blank is not null").withColumn("subgraph_identity", F.concat("s_blank", F.lit("x"))).where("copy = 1")
    return V.partial_key_errors(rows.unionByName(other)).select("key", F.coalesce("s", F.lit("")).alias("s"), F.coalesce("s_blank", F.lit("")).alias("s_blank"), "n")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN 'unknown prefix' WHEN p_partkey % 7 = 0 THEN 'digits' WHEN p_partkey % 6 = 0 AND p_partkey % 4 = 0 THEN 'digits' WHEN p_partkey % 6 = 4 AND p_partkey % 4 = 0 THEN 'digits' ELSE '' END AS errors FROM part""")
def c6_ids_of_prefixes(spark, d):
    """tmp wants nine digits and pde eight, of which every fourth has seven; every seventh id has six."""
    k = F.col("p_partkey")
    prefix = pick(k, ["tmp", "tx", "cde", "fde", "pde", "zzz"])
    digits = F.when(k % 7 == 0, 6).when(k % 4 == 0, 7).otherwise(9)
    return table(spark, d, "part").select("p_partkey", joined(V.id_errors(prefix, F.lpad(k.cast("string"), 9, "0").substr(F.lit(10) - digits, digits))))


@query("SELECT term, iri, perspective, array_to_string(list_filter([CASE WHEN iri LIKE 'http://uri.ex.org/%' THEN 'own host' END, CASE WHEN n > 1 THEN 'several' END], lambda x: x IS NOT NULL), ',') AS errors FROM (SELECT tid AS term, iri, tid % 3 AS perspective, count(*) OVER (PARTITION BY iri, tid % 3) AS n FROM existing)", "existing")
def c7_external_maps(spark, d):
    rows = triplify.term_tables(spark, d)["existing"].select(F.col("tid").alias("term"), "iri", (F.col("tid") % 3).alias("perspective"))
    return V.external_map_errors(rows, "ex.org").select("term", "iri", "perspective", joined())


_RELATIONS = "SELECT l_orderkey AS s, ['parsedTo', 'hasNamedRecord', 'hasBnodeRecord'][l_linenumber % 3 + 1] AS p, CASE WHEN l_partkey % 50 = 0 THEN l_orderkey ELSE l_partkey END AS o FROM lineitem"


@query(f"""WITH r AS ({_RELATIONS}) SELECT s, p, 'self' AS error, count(*) AS n FROM r WHERE s = o GROUP BY s, p
 UNION ALL SELECT s, p, 'several', count(*) FROM (SELECT DISTINCT s, p, o FROM r WHERE p NOT IN ('hasBnodeRecord', 'hasNamedRecord')) GROUP BY s, p HAVING count(*) > 1""")
def c8_relations(spark, d):
    k = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("s"), pick(k, ["parsedTo", "hasNamedRecord", "hasBnodeRecord"]).alias("p"),
        F.when(F.col("l_partkey") % 50 == 0, F.col("l_orderkey")).otherwise(F.col("l_partkey")).alias("o"))
    return V.relation_errors(rows)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def c9_missing_parts(spark, d):
    """Lines whose part isn't among those of a size of 40 at most."""
    return Q.check_foreign(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part").where("p_size <= 40"), "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'host' WHEN 1 THEN 'group' WHEN 2 THEN 'path' ELSE '' END AS errors FROM customer")
def c10_spec_uris(spark, d):
    k = F.col("c_custkey")
    n = F.concat(F.lit("c"), k.cast("string"))
    uri = F.concat(F.when(k % 4 == 0, "http://other.org/").otherwise("http://uri.ex.org/"), F.when(k % 4 == 1, "other").otherwise(n), F.lit("/ontologies/"), F.when(k % 4 == 2, "wrong").otherwise("a/b"))
    rows = table(spark, d, "customer").select("c_custkey", n.alias("grp"), F.lit("a/b").alias("path"), uri.alias("uri"))
    return rows.select("c_custkey", joined(V.spec_uri_errors("http://uri.ex.org/")))


_OPS = "['rdf:type', 'rdfs:label', 'ex:duplicateOf', 'ex:hasExactSynonym', 'ex:definition', 'ex:definition', 'ex:other']"


@query(f"""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 OR p_partkey // 2 % 10 = 7 THEN 'add' ELSE 'del' END AS op, p_partkey // 2 AS s, {_OPS}[(p_partkey // 4) % 7 + 1] AS p FROM part),
 n AS (SELECT p_partkey AS s, 'ex:definition' AS p, count(*) AS n FROM part WHERE p_partkey % 3 > 0 GROUP BY 1), c AS (SELECT s, p, count(*) FILTER (WHERE op = 'add') AS a, count(*) FILTER (WHERE op = 'del') AS d FROM x GROUP BY s, p)
 SELECT p_partkey, array_to_string(list_filter([CASE WHEN op = 'add' AND x.p IN ('rdf:type', 'rdfs:label', 'ex:duplicateOf') THEN 'cannot add' END, CASE WHEN op = 'del' AND x.p IN ('rdf:type', 'rdfs:label', 'ex:duplicateOf', 'ex:hasExactSynonym') THEN 'cannot delete' END,
  CASE WHEN x.p IN ('ex:definition', 'rdfs:label') AND a > 1 THEN 'several' END, CASE WHEN x.p = 'ex:definition' AND n > 0 AND d = 0 THEN 'missing delete' END, CASE WHEN x.p = 'ex:definition' AND n > 0 AND a = 0 THEN 'missing add' END], lambda e: e IS NOT NULL), ',') AS errors FROM x LEFT JOIN n ON n.s = x.s AND n.p = x.p JOIN c ON c.s = x.s AND c.p = x.p""")
def c12_special_predicates(spark, d):
    k = F.col("p_partkey")
    half = F.floor(k / 2)
    part = table(spark, d, "part")
    # two rows of a patch for each subject: one adds, the other deletes, or adds as well where the subject's number ends in 7
    patch = part.select("p_partkey", F.when((k % 2 == 0) | (half % 10 == 7), "add").otherwise("del").alias("op"), half.alias("s"), pick(F.floor(k / 4), ["rdf:type", "rdfs:label", "ex:duplicateOf", "ex:hasExactSynonym", "ex:definition", "ex:definition", "ex:other"]).alias("p"))
    stored = part.where(k % 3 > 0).select(k.alias("s"), F.lit("ex:definition").alias("p"))
    return V.special_errors(patch, stored).select("p_partkey", joined())


_PATCH = ["ok", "base subject", "literal", "special", "other host", "no value", "no kind", "odd kind", "space", "no path", "other group", "other subject", "user predicate", "bad predicate", "user object", "scheme", "object group"]
_FAULT = {"no value": "not a triple", "no kind": "object missing type", "odd kind": "unknown object type", "space": "white space", "no path": "s: no group and path", "other group": "s: other group", "other subject": "s: other subject",
          "user predicate": "p: user iri", "bad predicate": "p: bad predicate", "user object": "o: user iri", "scheme": "o: bad scheme", "object group": "o: other group"}


@query(f"""WITH c AS (SELECT p_partkey AS k, {_PATCH}[p_partkey % {len(_PATCH)} + 1] AS c FROM part), e AS (SELECT *, CASE c {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _FAULT.items())} END AS error FROM c)
 SELECT k AS p_partkey, error, CASE WHEN error IS NULL THEN 'http://uri.ex.org/base/tx_' || k END AS new_s, CASE WHEN error IS NULL THEN CASE c WHEN 'special' THEN 'rdfs:label' WHEN 'other host' THEN 'http://out.org/p' ELSE 'http://uri.ex.org/base/tx_0000010' END END AS new_p,
  CASE WHEN error IS NULL AND c NOT IN ('literal', 'special') THEN CASE c WHEN 'other host' THEN 'https://out.org/team/o' ELSE 'http://uri.ex.org/base/tx_7' END END AS new_o FROM e""")
def c11_patch_triples(spark, d):
    """A patch row of each kind for every part: its first fault, else the triple with the base's group in place of the team's."""
    k = F.col("p_partkey")
    part = table(spark, d, "part").select("p_partkey", pick(k, _PATCH).alias("c"))
    c, text = F.col("c"), k.cast("string")
    own = lambda g: F.concat(F.lit(f"http://uri.ex.org/{g}/tx_"), text)
    rows = part.select(
        "p_partkey", F.lit("team").alias("grp"), F.concat(F.lit("tx_"), text).alias("frag"),
        F.when(c == "base subject", own("base")).when(c == "no path", "http://uri.ex.org/team").when(c == "other group", own("rival")).when(c == "other subject", F.concat(own("team"), F.lit("9"))).otherwise(own("team")).alias("s"),
        F.when(c == "special", "rdfs:label").when(c == "other host", "http://out.org/p").when(c == "user predicate", "http://uri.ex.org/team/uris/x").when(c == "bad predicate", "http://uri.ex.org/base/word").otherwise("http://uri.ex.org/team/tx_0000010").alias("p"),
        F.when(c == "no kind", null()).when(c == "odd kind", "thing").when(c.isin("literal", "special", "space"), "literal").otherwise("uri").alias("kind"),
        F.when(c == "no value", null()).when(c == "space", "a ").when(c.isin("literal", "special"), "any text").when(c == "other host", "https://out.org/team/o").when(c == "user object", "http://uri.ex.org/team/uris/y").when(c == "scheme", "curie:x").when(c == "object group", "http://uri.ex.org/rival/tx_7").otherwise("http://uri.ex.org/team/tx_7").alias("value"),
        null().alias("datatype"), null().alias("language"))
    return V.patch_triples(rows, "uri.ex.org").select("p_partkey", "error", "new_s", "new_p", "new_o")


@query("""WITH g AS (SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'abc' WHEN 1 THEN 'Group' || c_custkey WHEN 2 THEN 'x y' || c_custkey || 'zz' WHEN 3 THEN 'cde_' || c_custkey WHEN 4 THEN repeat('n', 41) || c_custkey WHEN 5 THEN 'FRANCE' ELSE 'name' || c_custkey // 2 END AS name FROM customer)
 SELECT c_custkey, array_to_string(list_filter([CASE WHEN length(name) < 5 THEN 'short' END, CASE WHEN length(name) > 40 THEN 'long' END, CASE WHEN NOT regexp_matches(name, '^[A-Za-z][A-Za-z0-9_-]*$') THEN 'shape' END,
  CASE WHEN regexp_matches(lower(name), '(tmp|tx|cde|fde|pde)_.*') OR regexp_matches(lower(name), '^(group|user|test)') THEN 'taboo' END, CASE WHEN lower(name) LIKE '%name7_%' THEN 'own name' END, CASE WHEN lower(name) IN (SELECT lower(n_name) FROM nation) THEN 'reserved' END,
  CASE WHEN count(*) OVER (PARTITION BY lower(name)) > 1 THEN 'taken' END], lambda e: e IS NOT NULL), ',') AS errors FROM g""")
def c14_names_of_groups(spark, d):
    k = F.col("c_custkey")
    text = k.cast("string")
    name = (
        F.when(k % 9 == 0, "abc").when(k % 9 == 1, F.concat(F.lit("Group"), text)).when(k % 9 == 2, F.concat(F.lit("x y"), text, F.lit("zz"))).when(k % 9 == 3, F.concat(F.lit("cde_"), text))
        .when(k % 9 == 4, F.concat(F.repeat(F.lit("n"), 41), text)).when(k % 9 == 5, "FRANCE").otherwise(F.concat(F.lit("name"), F.floor(k / 2).cast("string")))
    )
    groups = table(spark, d, "customer").select("c_custkey", name.alias("name"))
    return V.group_name_errors(groups, table(spark, d, "nation").select(F.col("n_name").alias("name")), "Name7").select("c_custkey", joined())


_TARGETS = "c AS (SELECT conv_id, turn, conv_id * 31 + turn AS k FROM conversations), x AS (SELECT *, ['ontology', 'subject', 'triple', 'subgraph', 'pull', 'review'][k % 6 + 1] AS t, k % 2 = 0 AS iri, k % 3 = 0 AS triple, k % 5 = 0 AS sub, k % 10 = 9 AS node, k % 7 = 0 AS ctx, k % 4 = 0 AS pers, k % 11 > 5 AS pull, k % 13 > 6 AS rev FROM c)"


def _targets(spark, d):
    k = F.col("conv_id") * 31 + F.col("turn")
    some = lambda on, name, of=1: F.when(on, F.concat(F.lit("x"), F.floor(k / of).cast("string"))).alias(name)
    return table(spark, d, "conversations").select(
        "conv_id", "turn", pick(k, ["ontology", "subject", "triple", "subgraph", "pull", "review"]).alias("target_type"), some(k % 2 == 0, "iri", 4), some(k % 3 == 0, "triple_identity"),
        some(k % 5 == 0, "subgraph_identity"), F.when(k % 10 == 9, 1).alias("subgraph_blank"), F.when(k % 7 == 0, "c").alias("context_identity"), F.when(k % 4 == 0, "p").alias("perspective"), some(k % 11 > 5, "pull", 2), some(k % 13 > 6, "review"))


@query(f"""WITH {_TARGETS}
 SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN iri AND (triple OR sub OR node) THEN 'iri and identity' END, CASE WHEN triple AND (sub OR node) THEN 'triple and subgraph' END, CASE WHEN ctx AND pers THEN 'context and perspective' END,
  CASE WHEN (ctx OR pers) AND NOT (iri OR triple OR sub) THEN 'nothing in context' END,
  CASE WHEN NOT (t IN ('ontology', 'subject') AND iri OR t = 'triple' AND triple OR t = 'subgraph' AND sub OR t = 'pull' AND pull OR t = 'review' AND rev) THEN 'target missing' END], lambda e: e IS NOT NULL), ',') AS errors FROM x""")
def c15_comment_targets(spark, d):
    return _targets(spark, d).select("conv_id", "turn", joined(V.comment_target_errors()))


@query(f"""WITH {_TARGETS}, y AS (SELECT *, CASE WHEN ctx THEN 'c' ELSE '-' END || '|' || CASE WHEN pers THEN 'p' ELSE '-' END AS scope FROM x)
 SELECT key, value, count(*) AS n FROM (SELECT 'iri' AS key, scope || '|x' || (k // 4) AS value FROM y WHERE iri UNION ALL SELECT 'triple', scope || '|x' || k FROM y WHERE triple UNION ALL SELECT 'subgraph', scope || '|x' || k || '|1' FROM y WHERE sub AND node
  UNION ALL SELECT 'pull', 'x' || (k // 2) FROM y WHERE pull UNION ALL SELECT 'review', 'x' || k FROM y WHERE rev) GROUP BY key, value HAVING count(*) > 1""")
def c15_repeated_targets(spark, d):
    """Targets of comments that are there twice under the key of what they are about."""
    return V.comment_target_repeats(_targets(spark, d))


_ROLES = "['admin', 'owner', 'contributor', 'curator', 'view', 'org', 'pending', 'deactivated', 'deleted', 'banned', 'erased', 'blacklist', 'builtin']"


@query(f"""SELECT c_custkey, array_to_string(list_filter([CASE WHEN g = a THEN 'itself' END, CASE WHEN NOT (r BETWEEN 2 AND 5 AND g <> 0 OR role = 'deleted' AND g <> 0 OR r = 1 AND g = 0) THEN 'role' END,
  CASE WHEN u AND role NOT IN ('view', 'deleted') THEN 'user to user' END, CASE WHEN r <= 1 THEN 'own role' END], lambda e: e IS NOT NULL), ',') AS errors
 FROM (SELECT c_custkey, c_nationkey AS g, c_custkey % 25 AS a, c_custkey % 13 + 1 AS r, {_ROLES}[c_custkey % 13 + 1] AS role, c_nationkey % 2 = 1 AS u FROM customer)""")
def c16_roles_of_groups(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("grp"), (k % 25).alias("actor"), pick(k, ROLES).alias("role"), (F.col("c_nationkey") % 2 == 1).alias("grp_is_user"))
    return rows.select("c_custkey", joined(F.concat(V.role_errors(), V.own_role_errors(F.col("role")))))


@query("""WITH k AS (SELECT o_orderkey, o_custkey AS actor, CASE WHEN o_orderkey % 11 = 0 THEN 'bad key' ELSE 'ix' || ['p', 'r', 'w'][o_orderkey % 3 + 1] || '_' || o_orderkey END AS key, ['personal', 'read', 'web'][CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE o_orderkey % 3 + 1 END] AS kind,
  CASE WHEN o_orderkey % 5 = 0 THEN 30 WHEN o_orderkey % 5 = 1 THEN 3600 END AS lifetime, o_orderstatus = 'F' AS revoked, o_orderkey % 13 = 0 AS adm, o_orderkey % 17 IN (0, 1) AS spaced FROM orders), n AS (SELECT actor, count(*) FILTER (WHERE NOT revoked) AS n, count(*) AS al FROM k GROUP BY actor)
 SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT regexp_matches(key, '^ix[prw]_[0-9A-Za-z]+$') THEN 'shape' END, CASE WHEN kind[1] <> key[3] THEN 'type' END, CASE WHEN lifetime <= 60 THEN 'lifetime' END,
  CASE WHEN NOT revoked AND n > greatest(CASE WHEN actor % 2 = 0 THEN actor % 20 ELSE 5 END, 5) THEN 'quota' END, CASE WHEN al > greatest(CASE WHEN actor % 2 = 0 THEN actor % 30 ELSE 12 END, 12) THEN 'total quota' END,
  CASE WHEN actor % 5 = 0 THEN 'not owner' END, CASE WHEN adm AND actor % 3 > 0 THEN 'admin scope' END, CASE WHEN spaced THEN 'note' END], lambda e: e IS NOT NULL), ',') AS errors FROM k LEFT JOIN n USING (actor)""")
def c17_keys(spark, d):
    k = F.col("o_orderkey")
    keys = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("actor"), F.when(k % 11 == 0, "bad key").otherwise(F.concat(F.lit("ix"), pick(k, ["p", "r", "w"]), F.lit("_"), k.cast("string"))).alias("key"),
        F.when(k % 7 == 0, "personal").otherwise(pick(k, ["personal", "read", "web"])).alias("key_type"), F.when(k % 5 == 0, 30).when(k % 5 == 1, 3600).alias("lifetime"), (F.col("o_orderstatus") == "F").alias("revoked"),
        F.when(k % 13 == 0, "admin").otherwise("read").alias("scope"), F.when(k % 17 == 0, " a note").when(k % 17 == 1, "a note\t").when(k % 17 == 2, "a note").alias("note"))
    c = F.col("c_custkey")
    quotas = table(spark, d, "customer").where("c_custkey % 2 = 0").select(c.alias("actor"), (c % 20).alias("active"), (c % 30).alias("total"))
    users = table(spark, d, "customer").select(c.alias("actor"), F.when(c % 5 == 0, "pending").otherwise("owner").alias("own_role"), (c % 3 == 0).alias("admin"))
    return V.key_errors(keys, quotas, users, 5, 12).select("o_orderkey", joined())


@query("SELECT 'g' || c_custkey AS graph, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN 1 ELSE 2 END AS n, CASE c_custkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'ambiguous' END AS verdict FROM customer")
def c20_ambiguous_graphs(spark, d):
    k = F.col("c_custkey")
    graph = F.concat(F.lit("g"), k.cast("string"))
    cust = table(spark, d, "customer")
    heads = cust.select(graph.alias("graph"), F.explode(F.sequence(F.lit(1), F.when(k % 3 == 0, 1).otherwise(k % 3).cast("int"))).alias("i"), k.alias("k")).where("k % 3 > 0")
    rows = heads.select("graph", F.concat("graph", F.lit("/"), F.col("i").cast("string")).alias("s"), F.lit("rdf:type").alias("p"), F.lit("owl:Ontology").alias("o"))
    return V.ambiguous_names(rows.unionByName(cust.select(graph.alias("graph"), triplify.iri("customer", "c_custkey").alias("s"), F.lit("rdf:type").alias("p"), F.lit("owl:Class").alias("o"))))


_CASES = ["accept literal", "accept iri", "accept typed", "accept language", "reject datatype and language", "reject twice", "reject group in s", "reject group in o", "reject hash", "reject loop", "reject no object"]


@query(f"SELECT s_suppkey, c AS expected, c LIKE 'accept%' AS accepted FROM supplier, (SELECT unnest({_CASES}) AS c)")
def c21_expectations(spark, d):
    """Rows that the store has to take or refuse, one of each for every supplier, through all checks of rows."""
    c = F.col("expected")
    base, team = "http://uri.ex.org/base/tx_0000001", "http://uri.ex.org/team/tx_0000001"
    rows = table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(*[F.lit(x) for x in _CASES])).alias("expected")).select(
        "s_suppkey", "expected", F.when(c == "reject group in s", team).otherwise(F.concat(F.lit("http://ex.org/s/"), F.col("s_suppkey").cast("string"), F.lit("/"), F.replace(c, F.lit(" "), F.lit("_")))).alias("s"), F.lit("ex:p").alias("p"),
        F.when(c == "accept iri", base).when(c == "reject group in o", team).alias("o"), F.when(~c.isin("accept iri", "reject group in o", "reject no object", "reject loop"), F.lit("your object")).alias("o_lit"),
        F.when(c.isin("accept typed", "reject datatype and language"), "xsd:string").alias("datatype"), F.when(c.isin("accept language", "reject datatype and language"), "ja").alias("language"), null().alias("s_blank"), null().alias("o_blank"), null().alias("subgraph_identity"))
    rows = rows.withColumn("o", F.when(c == "reject loop", F.col("s")).otherwise(F.col("o")))
    rows = rows.unionByName(rows.where(c == "reject twice"))
    identified = I.with_triple_identity(rows)
    stored = identified.withColumn("stored_identity", F.when(c == "reject hash", F.col("pair_identity")).otherwise(F.col("triple_identity")))
    bad = lambda x: x.select("s_suppkey", "expected").distinct()
    twice = V.partial_key_errors(rows.where("o is not null or o_lit is not null")).where("s not like '%/team/%'").select(F.regexp_extract("s", "/s/([0-9]+)/", 1).cast("long").alias("s_suppkey"), F.replace(F.substring_index("s", "/", -1), F.lit("_"), F.lit(" ")).alias("expected"))
    refused = bad(Q.check_shape(rows)).union(bad(Q.check_term_uris(rows, "uri.ex.org"))).union(bad(Q.check_hashes(stored.drop("pair_identity", "triple_identity")))).union(twice.select("s_suppkey", "expected")).distinct().withColumn("bad", F.lit(True))
    return rows.select("s_suppkey", "expected").distinct().join(refused, ["s_suppkey", "expected"], "left").select("s_suppkey", "expected", F.col("bad").isNull().alias("accepted"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 6 = 0 THEN 'name off host' END, CASE WHEN p_partkey % 6 = 1 THEN 'expected' END, CASE WHEN p_partkey % 6 IN (2, 5) THEN 'set elsewhere' END,
 CASE WHEN e IS NOT NULL AND count(*) OVER (PARTITION BY e) > 1 THEN 'taken' END], lambda e: e IS NOT NULL), ',') AS errors
 FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 'other' WHEN 2 THEN CAST(p_partkey AS VARCHAR) || 'new' WHEN 3 THEN 'shared' || (p_partkey // 12) WHEN 4 THEN NULL ELSE CAST(p_partkey AS VARCHAR) END AS e FROM part)""")
def c22_reference_names(spark, d):
    """Off the host; an expected name on the host that is another's; any update once it is set elsewhere; one expected name of two."""
    k = F.col("p_partkey")
    text = k.cast("string")
    own, out = F.concat(F.lit("http://uri.ex.org/g/"), text), F.concat(F.lit("http://out.org/"), text)
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(k % 6 == 0, out).otherwise(own).alias("name"),
        F.when(k % 6 == 1, "http://uri.ex.org/g/other").when(k % 6 == 2, F.concat(out, F.lit("/new"))).when(k % 6 == 3, F.concat(F.lit("http://out.org/shared"), F.floor(k / 12).cast("string"))).when(k % 6 == 4, null()).otherwise(out).alias("expected"),
        F.when((k % 6).isin(2, 5), out).when(k % 6 == 3, own).alias("old_expected"))
    return V.reference_name_errors(rows, "uri.ex.org").select("p_partkey", joined())


@query("""WITH p AS (SELECT c_custkey, c_nationkey AS grp, CASE WHEN c_custkey % 4 = 0 THEN n_name WHEN c_custkey % 4 = 1 THEN 'other' ELSE 'p' || c_custkey END AS name, c_custkey % 8 IN (0, 2) AS is_default, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)
 SELECT c_custkey, array_to_string(list_filter([CASE WHEN is_default AND name <> n_name THEN 'default name' END, CASE WHEN NOT is_default AND name = n_name THEN 'other name' END, CASE WHEN is_default AND count(*) FILTER (WHERE is_default) OVER (PARTITION BY grp) > 1 THEN 'defaults' END,
  CASE WHEN count(*) OVER (PARTITION BY grp, name) > 1 THEN 'taken' END], lambda e: e IS NOT NULL), ',') AS errors FROM p""")
def c23_perspectives(spark, d):
    k = F.col("c_custkey")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("grp"), F.col("n_name").alias("group_name"))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("grp")).join(nation, "grp").select(
        "c_custkey", "grp", F.when(k % 4 == 0, F.col("group_name")).when(k % 4 == 1, "other").otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("name"), (k % 8).isin(0, 2).alias("is_default"))
    return V.perspective_errors(rows, nation).select("c_custkey", joined())


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN ['x', 'y'][p_partkey % 3] END AS b, CASE WHEN p_partkey // 3 % 3 > 0 THEN ['x', 'y'][p_partkey // 3 % 3] END AS s, CASE WHEN p_partkey // 9 % 3 > 0 THEN ['x', 'y'][p_partkey // 9 % 3] END AS g, p_partkey % 2 = 0 AS up FROM part)
 SELECT p_partkey, CASE WHEN b IS NULL AND s IS NULL AND g IS NULL THEN CASE WHEN up THEN 'accept' ELSE 'error: no name, use the upload' END WHEN b IS NULL AND s <> g THEN 'error: no name in the file, and stored differs from given' WHEN b IS NULL THEN 'error: no name in the file'
  WHEN s IS NULL AND g IS NULL THEN 'set to bound' WHEN s IS NULL THEN CASE WHEN b = g THEN 'set to bound' ELSE 'error: bound differs from given' END WHEN g IS NULL THEN CASE WHEN b = s THEN 'accept' ELSE 'error: bound differs from stored' END WHEN b = s AND s = g THEN 'accept' ELSE 'error: names differ' END AS verdict FROM n""")
def c24_name_cases(spark, d):
    k = F.col("p_partkey")
    one = lambda x, name: F.when(x % 3 == 1, "x").when(x % 3 == 2, "y").alias(name)
    rows = table(spark, d, "part").select("p_partkey", one(k, "bound"), one(F.floor(k / 3), "stored"), one(F.floor(k / 9), "given"), (k % 2 == 0).alias("upload"))
    return rows.select("p_partkey", V.name_agreement(F.col("upload")).alias("verdict"))


# --- operators without a query of their own -----------------------------------------------------------------------------

@query("""SELECT s, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN o LIKE '\\_:sg%' ESCAPE '\\' THEN 1 ELSE 0 END) AS BIGINT) AS links FROM (
 SELECT 'http://ex.org/supplier/' || s_suppkey AS s, '_:sg_x' AS o FROM supplier UNION ALL SELECT 'http://ex.org/supplier/' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'http://ex.org/customer/' || c_custkey, '_:sg_y' FROM customer) GROUP BY s""")
def s13_rows_to_rdf(spark, d):
    """Rows with labels for blank nodes made of the subgraph's identity; only subjects with a name are counted here, as labels are digests."""
    t = triplify.with_blanks(spark, d)
    nodes, _ = I.bnode_records(t)
    out = ntriples.labelled_rows(t, nodes.select("node", low("condensed").alias("identity")))
    return out.where("not startswith(s, '_:')").groupBy(F.translate("s", "<>", "").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o").startswith("_:sg")).alias("links"))


@query("""WITH h AS (SELECT perspective, subject, head FROM (SELECT *, row_number() OVER (PARTITION BY perspective, subject ORDER BY ts DESC, head DESC) AS r FROM log) WHERE r = 1 AND head <> '')
 SELECT subject, n_name AS grp, head, CAST(p_size AS INTEGER) AS size FROM h JOIN nation ON n_nationkey = perspective JOIN part ON subject = 'http://ex.org/part/' || p_partkey""", "log")
def j13_heads_for_subject(spark, d):
    """Every subject's heads with the group of each perspective and what is known of the record."""
    from ..operators.versions import heads

    now = heads(head_log(spark, d)).select("perspective", "subject", "head")
    groups = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("perspective"), F.col("n_name").alias("grp"))
    about = table(spark, d, "part").select(triplify.iri("part", "p_partkey").alias("subject"), F.col("p_size").cast("int").alias("size"))
    return L.heads_for_subject(now, groups, about)


@query("SELECT o_orderkey, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS above FROM orders")
def j21_one_row(spark, d):
    """A single row joined to all rows."""
    o = table(spark, d, "orders")
    return o.crossJoin(F.broadcast(o.agg(F.avg("o_totalprice").alias("mean")))).select("o_orderkey", (F.col("o_totalprice") > F.col("mean")).alias("above"))  # one row


@query(f"SELECT c_custkey, role, CAST(list_position({_ROLES}, role) - 1 AS INTEGER) AS ordinal, list_position({_ROLES}, role) <= list_position({_ROLES}, 'view') AS may_act FROM (SELECT c_custkey, {_ROLES}[c_custkey % 13 + 1] AS role FROM customer)")
def w1_role_ordinals(spark, d):
    role = pick(F.col("c_custkey"), ROLES)
    return table(spark, d, "customer").select("c_custkey", role.alias("role"), (role_rank(role) - 1).cast("int").alias("ordinal"), (role_rank(role) <= role_rank(F.lit("view"))).alias("may_act"))


@query("SELECT s, p, lower(pair) AS hexed, substr(lower(pair), 1, 19) AS tag FROM ids", "ids")
def f2_hex_prefix(spark, d):
    hexed = low("pair_identity")
    return I.with_triple_identity(triples(spark, d)).select("s", "p", hexed.alias("hexed"), F.substring(hexed, 1, 19).alias("tag"))


@query("SELECT DISTINCT s, regexp_extract(s, '[^/]*$') AS fragment FROM triples", "triples")
def f5_fragments(spark, d):
    return triples(spark, d).select("s", iris.fragment(F.col("s")).alias("fragment")).distinct()


@query("SELECT a.p_partkey, lower(p_name) = lower(upper(p_name)) AS same, lower(p_name) LIKE '%blue%' AS liked, regexp_matches(lower(p_type), 'steel') AS matched, NOT regexp_matches(lower(p_brand), '^brand#1') AS unmatched FROM part a")
def f7_without_case(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", (F.lower(name) == F.lower(F.upper(name))).alias("same"), name.ilike("%BLUE%").alias("liked"), F.col("p_type").rlike("(?i)STEEL").alias("matched"), (~F.col("p_brand").rlike("(?i)^BRAND#1")).alias("unmatched"))


@query("SELECT s, p, coalesce(o, o_lit) AS value, greatest(length(s), coalesce(length(o_lit), 0)) AS longest, s || '|' || datatype AS typed, TRY_CAST(o_lit AS BIGINT) AS number FROM triples", "triples")
def f13_scalars(spark, d):
    """A null in a concatenation gives null; a null in a comparison of sizes counts as 0 here."""
    return triples(spark, d).select(
        "s", "p", F.coalesce("o", "o_lit").alias("value"), F.greatest(F.length("s"), F.coalesce(F.length("o_lit"), F.lit(0))).cast("long").alias("longest"),
        F.concat("s", F.lit("|"), F.col("datatype")).alias("typed"), F.expr("try_cast(o_lit as bigint)").alias("number"))


@query("SELECT iri, array_to_string(list_transform(regexp_extract_all(iri, '([0-9]+|[^0-9]+)'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), '') AS key FROM existing", "existing")
def f20_natural_keys(spark, d):
    return triplify.term_tables(spark, d)["existing"].select("iri", iris.natural_key(F.col("iri")).alias("key"))


@query("SELECT page_id, CASE page_id % 8 WHEN 0 THEN substr(url || ';', 1, length(url)) WHEN 1 THEN 'http://named.org/resolver/' || page_id WHEN 2 THEN 'https://evsexplore.semantics.cancer.gov/evsexplore/concept/ncim/C' || page_id WHEN 3 THEN 'http://x.org/TOPNT_a_b_' || page_id WHEN 4 THEN 'http://x.org/TOPNT%20%5B' || page_id || '%5D' WHEN 5 THEN 'http://x.org/SNOMEDCT/' || page_id WHEN 6 THEN NULL ELSE url END AS fixed FROM pages")
def f10_existing_iri_rules(spark, d):
    """One page in eight for each rule: semicolon, named host, code browser, three kinds of blanks, a blank that can't be mended, and none."""
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    say = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    iri = (
        F.when(k % 8 == 0, say(F.col("url"), ";")).when(k % 8 == 1, say("https://named.org/resolver/RRID:", n)).when(k % 8 == 2, say(iris.OLD_CODES, "C", n)).when(k % 8 == 3, say("http://x.org/TOPNT a  b ", n))
        .when(k % 8 == 4, say("http://x.org/TOPNT [", n, "]")).when(k % 8 == 5, say("http://x.org/SNOMEDCT / ", n)).when(k % 8 == 6, say("http://x.org/a b", n)).otherwise(F.col("url"))
    )
    return table(spark, d, "pages").select("page_id", iris.existing_repaired(iri, "named.org").alias("fixed"))


@query("""WITH RECURSIVE e AS (SELECT s, p, o, triple FROM ids WHERE p IN ('ex:partOf', 'rdf:type')), st AS (SELECT 'http://ex.org/region/' || r_regionkey AS node FROM region),
 w AS (SELECT node FROM st UNION SELECT e.s FROM w JOIN e ON e.o = w.node) SELECT DISTINCT e.s, e.p, e.o, e.triple FROM e JOIN w ON e.o = w.node""", "ids", recursive=True)
def g1_closure_of_predicates(spark, d):
    """A list of predicates from objects to subjects, without a limit of depth, with the identities of the triples met."""
    starts = table(spark, d, "region").select(triplify.iri("region", "r_regionkey").alias("node"))
    t = I.with_triple_identity(triples(spark, d))
    return C.connected(t, starts, ["ex:partOf", "rdf:type"], "object").select("s", "p", "o", low("triple_identity").alias("triple"))


@query("""WITH e AS (SELECT s, p, o, triple FROM ids WHERE p IN ('ex:partOf', 'rdf:type')), a AS (SELECT e.* FROM e WHERE s LIKE '%/customer/%')
 SELECT s, p, o, triple FROM a UNION SELECT e.s, e.p, e.o, e.triple FROM e JOIN a ON e.s = a.o""", "ids")
def g1_closure_two_hops(spark, d):
    """From every customer, two hops from subject to object."""
    starts = table(spark, d, "customer").select(triplify.iri("customer", "c_custkey").alias("node"))
    t = I.with_triple_identity(triples(spark, d))
    return C.connected(t, starts, ["ex:partOf", "rdf:type"], "subject", 1).select("s", "p", "o", low("triple_identity").alias("triple"))


@query("SELECT 'http://ex.org/customer/' || c_custkey AS s, p, v FROM customer, (VALUES ('ex:address', 0), ('ex:segment', 1), ('ex:place', 0), ('ex:partOf', 2)) x(p, k), LATERAL (SELECT CASE k WHEN 1 THEN c_mktsegment WHEN 2 THEN 'http://ex.org/nation/' || c_nationkey END AS v)")
def j11_nested_subgraphs(spark, d):
    """Rows of every customer and of blank nodes at any depth below."""
    asked = table(spark, d, "customer").select(triplify.iri("customer", "c_custkey").alias("s"))
    return L.nested_graph(triplify.with_blanks(spark, d), asked).select(F.col("top").alias("s"), "p", F.coalesce("o", "o_lit").alias("v"))


@query("SELECT 'a' || c_custkey AS root, node, CAST(local AS INTEGER) AS local FROM customer, LATERAL (SELECT 'a' || c_custkey AS node, 0 AS local UNION ALL SELECT 'c' || c_custkey, 1) UNION ALL SELECT 'r' || s_suppkey, 'r' || s_suppkey, 0 FROM supplier")
def w4_nested_integers(spark, d):
    """Integers of the nodes below each linked root at any depth, level by level and in the order of their predicates."""
    return I.nested_integers(triplify.with_blanks(spark, d))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'ETag' END, CASE WHEN p_partkey % 7 = 0 THEN 'Content-Length' END, CASE WHEN p_partkey % 11 = 0 AND p_partkey % 2 = 0 THEN 'Last-Modified' END], lambda e: e IS NOT NULL), ',') AS differ FROM part")
def i8_header_mismatch(spark, d):
    """The three headers of two responses; one that either lacks is no mismatch."""
    k = F.col("p_partkey")
    pair = lambda bad, gone, a, b: (F.lit(a), F.when(bad, b).when(gone, None).otherwise(a))
    tag, size, at = pair(k % 5 == 0, k % 3 == 0, "a", "b"), pair(k % 7 == 0, F.lit(False), "10", "11"), pair((k % 11 == 0) & (k % 2 == 0), k % 2 == 1, "Mon", "Tue")
    rows = table(spark, d, "part").select("p_partkey", *[F.create_map(*[v for name, p in (("ETag", tag), ("Content-Length", size), ("Last-Modified", at)) for v in (F.lit(name), p[i])]).alias(n) for i, n in enumerate(("old", "new"))])
    return rows.select("p_partkey", F.array_join(L.header_mismatch(F.col("old"), F.col("new")), ",").alias("differ"))


@query("SELECT user_id, count(*) AS n, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS refused, max(event_id) AS last FROM events GROUP BY user_id")
def t5_audit_stream(spark, d):
    """Every change appended to a log as it comes; what the log then says of each user."""
    from ..functions.shared import new_path
    from ..streaming.streams import audit_stream

    path = new_path(spark, "audit")
    changes = event_stream(spark, d).select("event_id", "user_id", "event_type", "ts")
    audit_stream(changes, path, new_path(spark, "audit-state")).awaitTermination()
    log = spark.read.schema(changes.schema).parquet(path)
    return log.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("refused"), F.max("event_id").alias("last"))


@query("""SELECT n_nationkey AS follower, event_type, count(*) AS n FROM events JOIN customer ON c_custkey = event_id % 200 + 1 JOIN nation ON n_nationkey = c_nationkey
 WHERE event_type IN (CASE WHEN n_nationkey % 2 = 0 THEN 'purchase' ELSE 'error' END, 'signup') GROUP BY 1, 2""")
def t6_follow_stream(spark, d):
    """Nations follow their customers; even ones hear of purchases, odd ones of errors, all of sign-ups."""
    from ..streaming.streams import follow_stream, run_to_end

    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("follower"))
    follows = table(spark, d, "customer").select(F.col("c_nationkey").alias("follower"), F.col("c_nationkey").alias("target"), F.col("c_custkey").alias("subject"))
    kinds = nation.select("follower", F.explode(F.array(F.when(F.col("follower") % 2 == 0, "purchase").otherwise("error"), F.lit("signup"))).alias("event_type"))
    events = event_stream(spark, d).select((F.col("event_id") % 200 + 1).alias("subject"), "event_type", "ts")
    return run_to_end(follow_stream(events, follows, kinds), "append").groupBy("follower", "event_type").agg(F.count(F.lit(1)).alias("n"))
