"""Groups and their people over the given tables: nations are groups, customers their members, orders pulls and writes, conversations comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import community as G
from ..operators.review import ROLES
from .base import query, table

_ROLES = "[" + ", ".join(f"'{r}'" for r in ROLES) + "]"


def groups(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("grp"), F.col("n_name").alias("group_name"))


def perspectives(spark, d):
    g = groups(spark, d)
    p = F.col("grp")
    return g.select(p.alias("perspective"), F.col("group_name").alias("name"), "grp", F.lit(True).alias("is_default")).unionByName(g.where("grp % 3 = 0").select(p + 100, F.concat("group_name", F.lit("-draft")), "grp", F.lit(False)).toDF("perspective", "name", "grp", "is_default"))


_PERSPECTIVES = "p AS (SELECT n_nationkey AS perspective, n_name AS name, n_nationkey AS grp, n_name AS group_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name || '-draft', n_nationkey, n_name FROM nation WHERE n_nationkey % 3 = 0)"


def roles(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("grp"), (c % 25).alias("actor"), F.element_at(F.array(*[F.lit(r) for r in ROLES]), (c % 13 + 1).cast("int")).alias("role"))


@query("""SELECT c_nationkey AS grp, p_partkey AS id FROM part JOIN customer ON c_custkey = p_partkey % 3000 UNION SELECT p_partkey % 7 * 3, p_partkey FROM part WHERE p_partkey % 5 = 1 AND p_partkey % 4 > 0""")
def j6_terms_of_groups(spark, d):
    """Parts that members of a nation made, or that a community of it approved."""
    k = F.col("p_partkey")
    part, cust = table(spark, d, "part"), table(spark, d, "customer")
    approvals = part.where(k % 5 == 1).select(k.alias("id"), (k % 7).alias("cid"), F.when(k % 4 > 0, "approved").otherwise("pending").alias("status"))
    communities = spark.range(7).select(F.col("id").alias("cid"), (F.col("id") * 3).alias("grp"))
    return G.group_terms(part.select(k.alias("id"), (k % 3000).alias("uid")), cust.select(F.col("c_nationkey").cast("long").alias("grp"), F.col("c_custkey").alias("uid")), communities, approvals)


@query("""WITH n AS (SELECT page_id, 'name' || (page_id // 2) AS name, CASE WHEN page_id % 3 = 0 THEN 'r' ELSE 'f' END || (page_id % 40) AS identity FROM pages),
 r AS (SELECT name, CASE WHEN identity LIKE 'r%' THEN identity ELSE 'r' || (CAST(substr(identity, 2) AS BIGINT) % 30) END AS release FROM n)
 SELECT DISTINCT name, n_name AS prefix, 'http://ns/' || n_nationkey AS namespace FROM r JOIN nation ON n_regionkey = CAST(substr(release, 2) AS BIGINT) % 6""")
def j10_curies_of_names(spark, d):
    """Three hops: a name to a file or release, a file to its release, a release to its conventions and their prefixes."""
    k = F.col("page_id")
    text = lambda a, x: F.concat(F.lit(a), x.cast("string"))
    names = table(spark, d, "pages").select(text("name", F.floor(k / 2)).alias("name"), F.when(k % 3 == 0, text("r", k % 40)).otherwise(text("f", k % 40)).alias("identity"))
    i = F.col("id")
    relations = spark.range(40).select(text("f", i).alias("s"), F.lit("parsedTo").alias("p"), text("r", i % 30).alias("o")).unionByName(spark.range(40).select(text("r", i).alias("s"), F.lit("hasLocalConventions").alias("p"), text("c", i % 6).alias("o")))
    curies = table(spark, d, "nation").select(text("c", F.col("n_regionkey")).alias("identity"), F.col("n_name").alias("prefix"), text("http://ns/", F.col("n_nationkey")).alias("namespace"))
    return G.curies_by_name(names, names, relations, curies)


@query(f"""WITH {_PERSPECTIVES}, q AS (SELECT o_orderkey AS pull, 'http://ex.org/part/' || (o_orderkey % 200) AS subject, o_custkey % 25 AS from_p, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 25 + 100 ELSE o_orderkey % 25 END AS to_p, o_custkey % 27 AS actor, o_orderstatus AS status FROM orders),
 a AS (SELECT c_nationkey AS grp, count(DISTINCT c_custkey % 25) AS n FROM customer WHERE c_custkey % 13 < 4 GROUP BY 1)
 SELECT pull, subject, f.group_name AS from_group, f.name AS from_name, t.group_name AS to_group, t.name AS to_name, n_name AS actor_name, status, CASE WHEN pull % 3 = 0 THEN pull * 10 END AS review, CASE WHEN pull % 3 = 0 THEN pull % 2 = 0 END AS closed, coalesce(n, 0) AS may_act
 FROM q JOIN p f ON f.perspective = from_p JOIN p t ON t.perspective = to_p JOIN nation ON n_nationkey = actor LEFT JOIN a ON a.grp = t.grp""")
def j14_pulls_with_reviews(spark, d):
    """Pulls with both sides, the actor, the review if there is one, and how many may act on the target."""
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    q = orders.select(k.alias("pull"), F.concat(F.lit("http://ex.org/part/"), (k % 200).cast("string")).alias("subject"), (F.col("o_custkey") % 25).alias("from_p"), F.when(k % 4 == 0, k % 25 + 100).otherwise(k % 25).alias("to_p"), (F.col("o_custkey") % 27).alias("actor"), F.col("o_orderstatus").alias("status"))
    reviews = orders.where(k % 3 == 0).select(k.alias("pull"), (k * 10).alias("review"), (k % 2 == 0).alias("closed"))
    return G.pulls(q, perspectives(spark, d), groups(spark, d), reviews, roles(spark, d), "view")


@query(f"""WITH r AS (SELECT DISTINCT o_custkey AS uid, n_name, o_orderkey % 13 + 1 AS rank, {_ROLES}[o_orderkey % 13 + 1] AS role FROM orders JOIN nation ON n_nationkey = o_orderkey % 25)
 SELECT c_custkey AS uid, c_name AS name, coalesce((SELECT string_agg(n_name || ':' || role, ',' ORDER BY rank, n_name) FROM r WHERE uid = c_custkey), '') AS groups, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 'b' || c_custkey || ',a' || c_custkey ELSE 'a' || c_custkey END ELSE '' END AS emails FROM customer""")
def j15_overviews(spark, d):
    """Every user with the lists of its groups, best role first, and addresses."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    held = table(spark, d, "orders").select(F.col("o_custkey").alias("uid"), (k % 25).alias("grp"), F.element_at(F.array(*[F.lit(r) for r in ROLES]), (k % 13 + 1).cast("int")).alias("role")).distinct()
    cust = table(spark, d, "customer")
    mail = cust.where(c % 2 == 0).select(c.alias("uid"), F.concat(F.lit("a"), c.cast("string")).alias("email"), (c % 4 != 0).alias("primary")).unionByName(cust.where(c % 4 == 0).select(c.alias("uid"), F.concat(F.lit("b"), c.cast("string")).alias("email"), F.lit(True).alias("primary")))
    out = G.overview(cust.select(c.alias("uid"), F.col("c_name").alias("name")), held, groups(spark, d), mail)
    return out.select("uid", "name", F.array_join("groups", ",").alias("groups"), F.array_join("emails", ",").alias("emails"))


@query(f"""WITH {_PERSPECTIVES}, h AS (SELECT DISTINCT 'r' || (l_orderkey % 500) AS record, CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey % 25 + 100 ELSE l_suppkey % 25 END AS perspective, l_partkey % 40 AS uid, CAST(l_shipdate AS DATE) AS ts FROM lineitem)
 SELECT uid, 's' || (CAST(substr(record, 2) AS BIGINT) % 90) AS subject, record, name, group_name, ts, CAST(row_number() OVER (PARTITION BY uid ORDER BY ts DESC, 's' || (CAST(substr(record, 2) AS BIGINT) % 90), record, name) AS INTEGER) AS place FROM h JOIN p USING (perspective)""")
def j16_newest_contributions(spark, d):
    """Distinct records that each user wrote, newest first."""
    item = table(spark, d, "lineitem")
    record = lambda k: F.concat(F.lit("r"), k.cast("string"))
    history = item.select(record(F.col("l_orderkey") % 500).alias("record"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey") % 25 + 100).otherwise(F.col("l_suppkey") % 25).alias("perspective"), (F.col("l_partkey") % 40).alias("uid"), F.col("l_shipdate").cast("date").alias("ts"))
    subjects = item.select((F.col("l_orderkey") % 500).alias("k")).distinct().select(record(F.col("k")).alias("record"), F.concat(F.lit("s"), (F.col("k") % 90).cast("string")).alias("subject"))
    return G.contributions(history, perspectives(spark, d), groups(spark, d), subjects)


@query("""WITH n AS (SELECT page_id AS k, CASE WHEN page_id % 6 = 0 THEN 'http://uri.ex.org/o/' ELSE 'http://out.org/o/' END || (page_id // 2) AS name, 'f' || page_id AS identity, CASE WHEN page_id % 5 = 0 THEN 'pointer' ELSE 'bound' END AS type FROM pages),
 b AS (SELECT DISTINCT name FROM n WHERE type = 'bound' AND name LIKE 'http://out.org/%' AND k % 3 > 0), r AS (SELECT name, bool_or(k % 4 = 0) AS first FROM n WHERE k % 7 < 3 GROUP BY name)
 SELECT name, CASE WHEN first THEN 'of the first group' ELSE 'nobody''s' END AS verdict FROM b LEFT JOIN r USING (name) WHERE first OR first IS NULL""")
def j17_free_names(spark, d):
    """Names off the host with a parsed file: expected by a name of the first group, or by none."""
    k = F.col("page_id")
    text = lambda a, x: F.concat(F.lit(a), x.cast("string"))
    name = F.concat(F.when(k % 6 == 0, "http://uri.ex.org/o/").otherwise("http://out.org/o/"), F.floor(k / 2).cast("string"))
    pages = table(spark, d, "pages")
    names = pages.select(name.alias("name"), text("f", k).alias("identity"), F.when(k % 5 == 0, "pointer").otherwise("bound").alias("type"))
    relations = pages.where(k % 3 > 0).select(text("f", k).alias("s"), F.lit("parsedTo").alias("p"), text("r", k).alias("o"))
    return G.free_ontologies(names, relations, pages.where(k % 7 < 3).select(name.alias("expected"), (k % 4).alias("grp")), "uri.ex.org")


@query("""SELECT conv_id AS target, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY ts DESC, comment DESC) AS INTEGER) AS place, comment, c_name AS author, n_name AS seen_as, sha256(coalesce(text, '')) AS text
 FROM (SELECT conv_id, conv_id * 1000 + turn AS comment, turn // 2 AS ts, text, (conv_id + turn) % 100 + 1 AS uid FROM conversations) JOIN customer ON c_custkey = uid LEFT JOIN nation ON n_nationkey = conv_id % 40""")
def j18_comments_of_targets(spark, d):
    """Comments on each conversation, newest first, with author and the perspective that it is seen by, if any."""
    t = table(spark, d, "conversations")
    targets = t.select(F.col("conv_id").alias("target"), (F.col("conv_id") % 40).alias("perspective")).distinct()
    notes = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("comment"), F.col("conv_id").alias("target"), ((F.col("conv_id") + F.col("turn")) % 100 + 1).alias("uid"), F.floor(F.col("turn") / 2).alias("ts"), "text")
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"))
    return G.comments(targets, notes, users, perspectives(spark, d).where("is_default")).withColumn("text", F.sha2(F.coalesce("text", F.lit("")), 256))


@query(f"""WITH r AS (SELECT g.n_name AS giver, h.n_name AS holder, {_ROLES}[c_custkey % 13 + 1] AS role FROM customer JOIN nation g ON g.n_nationkey = c_nationkey JOIN nation h ON h.n_nationkey = c_custkey % 25 WHERE c_custkey % 13 <> 8)
 SELECT 'granted' AS kind, giver AS grp, holder AS other, role FROM r UNION ALL SELECT 'held', holder, giver, role FROM r""")
def j19_roles_both_ways(spark, d):
    return G.roles_of(roles(spark, d), groups(spark, d))


@query("""WITH q AS (SELECT DISTINCT o_custkey % 4 AS grp, CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS prefix, CAST(o_orderkey % 300 AS VARCHAR) AS suffix FROM orders),
 c AS (SELECT * FROM (VALUES (0, 'A', 'http://a/'), (0, 'B', 'http://b/'), (1, 'B', 'http://own/b/'), (2, 'C', 'http://c/')) v(grp, prefix, namespace)),
 i AS (SELECT q.grp, q.prefix || ':' || suffix AS curie, coalesce(o.namespace, l.namespace) || suffix AS iri FROM q LEFT JOIN c o ON o.grp = q.grp AND o.prefix = q.prefix LEFT JOIN c l ON l.grp = 0 AND l.prefix = q.prefix),
 e AS (SELECT p_partkey % 3 AS grp, CASE WHEN p_partkey % 2 = 0 THEN 'http://a/' ELSE 'http://b/' END || p_partkey AS iri, 'tx:' || p_partkey AS term FROM part UNION ALL SELECT 1, 'http://own/b/' || p_partkey, 'own:' || p_partkey FROM part WHERE p_partkey % 4 = 1)
 SELECT i.grp, curie, i.iri, coalesce(m.term, b.term) AS term, CASE WHEN coalesce(m.term, b.term) IS NOT NULL THEN 'term' WHEN i.iri IS NOT NULL THEN 'iri' ELSE 'unknown prefix' END AS status FROM i LEFT JOIN e m ON m.grp = i.grp AND m.iri = i.iri LEFT JOIN e b ON b.grp = 0 AND b.iri = i.iri""")
def j27_redirects(spark, d):
    """Curies of a group to iris and terms, by its own meaning before the base's."""
    k, p = F.col("o_orderkey"), F.col("p_partkey")
    asked = table(spark, d, "orders").select((F.col("o_custkey") % 4).alias("grp"), F.concat(F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (k % 4 + 1).cast("int")), F.lit(":"), (k % 300).cast("string")).alias("curie"))
    curies = spark.createDataFrame([(0, "A", "http://a/"), (0, "B", "http://b/"), (1, "B", "http://own/b/"), (2, "C", "http://c/")], "grp long, prefix string, namespace string")
    part = table(spark, d, "part")
    existing = part.select((p % 3).alias("grp"), F.concat(F.when(p % 2 == 0, "http://a/").otherwise("http://b/"), p.cast("string")).alias("iri"), F.concat(F.lit("tx:"), p.cast("string")).alias("term"))
    existing = existing.unionByName(part.where(p % 4 == 1).select(F.lit(1).cast("long").alias("grp"), F.concat(F.lit("http://own/b/"), p.cast("string")).alias("iri"), F.concat(F.lit("own:"), p.cast("string")).alias("term")))
    return G.redirects(asked, curies, existing)


@query("""WITH i AS (SELECT c_custkey AS k, n_name, n_nationkey AS g FROM customer JOIN nation ON n_nationkey = c_nationkey)
 SELECT CASE k % 7 WHEN 0 THEN 'http://out.org/' || k WHEN 1 THEN 'http://uri.ex.org/' || n_name || '/ontologies/' || k WHEN 2 THEN 'http://uri.ex.org/nobody/uris/' || k WHEN 3 THEN 'http://uri.ex.org/' || n_name || '/uris' ELSE 'http://uri.ex.org/' || n_name || '/uris/a/b' || k END AS iri,
  CASE k % 7 WHEN 0 THEN NULL WHEN 2 THEN 'nobody' ELSE n_name END AS group_name, CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN CAST(k AS VARCHAR) WHEN 2 THEN CAST(k AS VARCHAR) WHEN 3 THEN NULL ELSE 'a/b' || k END AS path, CASE WHEN k % 7 IN (0, 2) THEN NULL ELSE g END AS perspective,
  CASE k % 7 WHEN 0 THEN 'other host' WHEN 1 THEN 'not under uris' WHEN 2 THEN 'unknown group' WHEN 3 THEN 'no path' END AS error FROM i""")
def j29_user_iris(spark, d):
    """User iris to group, path and default perspective, with an error for each that isn't one."""
    k = F.col("k")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("grp")).join(groups(spark, d), "grp")
    text, host_ = k.cast("string"), F.lit("http://uri.ex.org/")
    iri = F.when(k % 7 == 0, F.concat(F.lit("http://out.org/"), text)).when(k % 7 == 1, F.concat(host_, "group_name", F.lit("/ontologies/"), text)).when(k % 7 == 2, F.concat(host_, F.lit("nobody/uris/"), text)).when(k % 7 == 3, F.concat(host_, "group_name", F.lit("/uris"))).otherwise(F.concat(host_, "group_name", F.lit("/uris/a/b"), text))
    return G.user_iris(rows.select(iri.alias("iri")), groups(spark, d), perspectives(spark, d), "http://uri.ex.org/")


@query("""SELECT DISTINCT grp, path, reader, CASE WHEN k % 3 = 0 THEN 'tx:' || k END AS term, CASE WHEN k % 3 > 0 AND k % 2 = 0 AND (grp = reader OR (grp + reader) % 4 = 0) THEN 'r' || k END AS record,
 CASE WHEN k % 3 = 0 THEN 'term' WHEN k % 2 > 0 THEN 'none' WHEN grp = reader OR (grp + reader) % 4 = 0 THEN 'record' ELSE 'private' END AS status FROM (SELECT page_id AS k, page_id % 25 AS grp, 'p' || page_id AS path, page_id // 25 % 25 AS reader FROM pages)""")
def p14_paths(spark, d):
    """Paths of groups to mapped terms, else to the group's own record where the reader may see it."""
    k = F.col("page_id")
    pages = table(spark, d, "pages")
    own = [(k % 25).alias("grp"), F.concat(F.lit("p"), k.cast("string")).alias("path")]
    g, r = F.col("grp"), F.col("reader")
    may = groups(spark, d).select("grp").withColumn("reader", F.explode(F.sequence(F.lit(0), F.lit(24)).cast("array<long>"))).where((g + r) % 4 == 0)
    return G.by_path(pages.select(*own, (F.floor(k / 25) % 25).alias("reader")), pages.where(k % 3 == 0).select(*own, F.concat(F.lit("tx:"), k.cast("string")).alias("term")), pages.where(k % 2 == 0).select(*own, F.concat(F.lit("r"), k.cast("string")).alias("record")), may)


@query("""WITH b AS (SELECT DISTINCT 'name' || (page_id // 3) AS name, 'i' || (page_id % 50) AS identity FROM pages WHERE page_id % 4 > 0), i AS (SELECT 'i' || k AS identity, DATE '2020-01-01' + CAST(k AS INTEGER) AS seen FROM range(45) t(k))
 SELECT name, count(seen) AS n, min(seen) AS first, max(seen) AS latest FROM (SELECT DISTINCT 'name' || (page_id // 3) AS name FROM pages) LEFT JOIN (SELECT name, seen FROM b JOIN i USING (identity)) USING (name) GROUP BY name""")
def j8_names_seen(spark, d):
    """When each name first and last stood for something new; some names stand for nothing known."""
    k = F.col("page_id")
    text = lambda a, x: F.concat(F.lit(a), x.cast("string"))
    pages = table(spark, d, "pages")
    identities = spark.range(45).select(text("i", F.col("id")).alias("identity"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("first_seen"))
    return G.names_seen(pages.select(text("name", F.floor(k / 3)).alias("name")), pages.where(k % 4 > 0).select(text("name", F.floor(k / 3)).alias("name"), text("i", k % 50).alias("identity")), identities)


def _registry(spark, d):
    part, k = table(spark, d, "part"), F.col("p_partkey")
    row = lambda p, x: part.select(F.when(k % 10 == 2, "cde").otherwise("tx").alias("prefix"), F.lpad(k.cast("string"), 7, "0").alias("id"), F.lit(p).alias("p"), x.alias("o_lit"))
    return row("label", F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).unionByName(row("exact", F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))))


@query("""WITH r AS (SELECT CASE WHEN p_partkey % 10 = 2 THEN 'cde' ELSE 'tx' END AS prefix, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS id, unnest(['label', 'exact']) AS p, unnest([p_name || ' ' || p_size, p_brand || ' ' || p_size]) AS o_lit FROM part)
 SELECT * FROM r WHERE o_lit IN (SELECT p_brand || ' ' || (l_quantity::INT) FROM lineitem JOIN part ON p_partkey = l_partkey UNION SELECT p_name || ' ' || (l_quantity::INT) FROM lineitem JOIN part ON p_partkey = l_partkey UNION SELECT upper(p_name) || ' 5' FROM part)""")
def p7_exact_labels(spark, d):
    """Registry rows of strings that line items ask for; another case is another string."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    item = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    q = F.col("l_quantity").cast("int").cast("string")
    asked = item.select(F.explode(F.array(F.concat_ws(" ", "p_brand", q), F.concat_ws(" ", "p_name", q))).alias("string")).unionByName(part.select(F.concat(F.upper("p_name"), F.lit(" 5")).alias("string")))
    return G.exact_labels(asked, _registry(spark, d))


@query("""SELECT 'http://uri.ex.org/base/tx_' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS term, 'http://x.ex.net/' || (p_partkey // 2) AS iri, p_partkey % 5 AS grp FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def p10_existing_of_terms(spark, d):
    """Existing iris of the terms that returned line items name."""
    k = F.col("p_partkey")
    key = lambda x: F.lpad(x.cast("string"), 7, "0").alias("id")
    existing = table(spark, d, "part").select(F.lit("tx").alias("prefix"), key(k), F.concat(F.lit("http://x.ex.net/"), F.floor(k / 2).cast("string")).alias("iri"), (k % 5).alias("grp"))
    asked = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.lit("tx").alias("prefix"), key(F.col("l_partkey")))
    return G.existing_of(existing, "http://uri.ex.org/base/", asked)


@query("""SELECT name, n_name AS group_name, n_nationkey % 6 = 1 AS builtin FROM (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN n_name ELSE 'no ' || c_custkey END AS name FROM customer JOIN nation ON n_nationkey = c_nationkey) LEFT JOIN nation ON lower(n_name) = lower(name)""")
def p15_groups_by_name(spark, d):
    """Groups that customers ask for by name in any case, with the built-in ones told; others are unknown."""
    c = F.col("c_custkey")
    known = groups(spark, d).withColumn("own_role", F.when(F.col("grp") % 6 == 1, "builtin").otherwise("owner"))
    asked = table(spark, d, "customer").join(known, F.col("c_nationkey") == F.col("grp")).select(F.when(c % 3 == 0, F.lower("group_name")).when(c % 3 == 1, F.col("group_name")).otherwise(F.concat(F.lit("no "), c.cast("string"))).alias("name"))
    return G.group_lookup(asked, known.select("group_name", "own_role"))


@query("SELECT p_partkey AS id, 'http://ex.org/part/' || p_partkey AS s, p AS note_p, note FROM part JOIN (SELECT l_partkey AS id, 'ex:flag' AS p, l_returnflag AS note FROM lineitem UNION ALL SELECT l_partkey, 'ex:line', CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_linenumber > 5) n ON n.id = p_partkey")
def j23_notes_on_rows(spark, d):
    """Rows with the notes whose blank subject is their id: line items are notes on parts."""
    item = table(spark, d, "lineitem")
    note = lambda where, p, x: item.where(where).select(F.col("l_partkey").alias("s_blank"), F.lit(p).alias("p"), x.cast("string").alias("o_lit"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("http://ex.org/part/"), F.col("p_partkey").cast("string")).alias("s"))
    return G.annotations(rows, note("true", "ex:flag", F.col("l_returnflag")).unionByName(note("l_linenumber > 5", "ex:line", F.col("l_linenumber"))))


@query("""SELECT c_custkey AS uid, kind, greatest(base, coalesce(CASE WHEN c_custkey % 4 = 0 AND kind = 'keys' THEN c_custkey % 40 WHEN c_custkey % 6 = 0 AND kind = 'pulls' THEN 7 END, base)) AS most FROM customer, (VALUES ('keys', 10), ('pulls', 20), ('groups', 3)) v(kind, base)""")
def a11_quotas(spark, d):
    """The quota of each kind that holds for each user."""
    c = F.col("c_custkey")
    cust = table(spark, d, "customer")
    own = cust.where(c % 4 == 0).select(c.alias("uid"), F.lit("keys").alias("kind"), (c % 40).cast("long").alias("most")).unionByName(cust.where(c % 6 == 0).select(c.alias("uid"), F.lit("pulls").alias("kind"), F.lit(7).cast("long").alias("most")))
    default = spark.createDataFrame([("keys", 10), ("pulls", 20), ("groups", 3)], "kind string, most long")
    return G.quotas_of(cust.select(c.alias("uid")), own, default)
