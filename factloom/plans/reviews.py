"""Pulls, votes, validators and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import review as R
from ..operators import versions as V
from ..operators.identities import with_triple_identity
from ..sources import triplify
from .base import committee, head_log, query, rules, table, triples, votes

HEADS = "h AS (SELECT perspective, subject, head FROM (SELECT *, row_number() OVER (PARTITION BY perspective, subject ORDER BY ts DESC, head DESC) AS r FROM log) WHERE r = 1 AND head <> '')"
PULLS = "q AS (SELECT o_orderkey AS pull, 'http://ex.org/part/' || (o_orderkey % 200) AS subject, o_custkey % 25 AS from_p, o_orderkey % 25 AS to_p FROM orders)"


def pulls(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("pull"), F.concat(F.lit("http://ex.org/part/"), (k % 200).cast("string")).alias("subject"), (F.col("o_custkey") % 25).alias("from_p"), (k % 25).alias("to_p"))


@query(f"""WITH {HEADS}, {PULLS} SELECT pull, a.head AS from_head, b.head AS to_head, CASE WHEN from_p = to_p THEN 'same perspective' WHEN a.head IS NULL THEN 'no source head' WHEN a.head = b.head THEN 'same head' END AS error
 FROM q LEFT JOIN h a ON a.subject = q.subject AND a.perspective = from_p LEFT JOIN h b ON b.subject = q.subject AND b.perspective = to_p""", "log")
def r1_new_pulls(spark, d):
    return R.new_pulls(pulls(spark, d), V.heads(head_log(spark, d))).select("pull", "from_head", "to_head", "error")


@query(f"""WITH {HEADS}, {PULLS}, x AS (SELECT q.*, CASE WHEN pull % 7 = 0 THEN 'merged' ELSE 'pending' END AS status, CASE WHEN pull % 5 = 0 THEN 'other' ELSE head END AS from_head, pull % 10 AS actor FROM q JOIN h ON h.subject = q.subject AND h.perspective = from_p)
 SELECT pull, CASE WHEN status <> 'pending' THEN 'not pending' WHEN from_head = 'other' THEN 'head moved' WHEN (actor + to_p) % 3 <> 0 OR (actor + to_p) % 5 = 4 THEN 'no role' ELSE 'merged' END AS outcome FROM x""", "log")
def r2_merge_pulls(spark, d):
    """Roles: actor a has one at perspective p if a + p is a multiple of three; where it leaves 4 over five, only to view."""
    now = V.heads(head_log(spark, d))
    own = now.select("subject", F.col("perspective").alias("from_p"), "head")
    k = F.col("pull")
    p = pulls(spark, d).join(own, ["subject", "from_p"]).select(
        "pull", "subject", "from_p", "to_p", F.when(k % 7 == 0, "merged").otherwise("pending").alias("status"), F.when(k % 5 == 0, "other").otherwise(F.col("head")).alias("from_head"), (k % 10).alias("actor"))
    n = F.col("actor") + F.col("perspective")
    roles = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("perspective"), F.explode(F.sequence(F.lit(0), F.lit(9)).cast("array<long>")).alias("actor")).where(n % 3 == 0)
    roles = roles.select("actor", "perspective", F.when(n % 5 == 4, "view").when(n % 2 == 0, "admin").otherwise("curator").alias("role"))
    return R.merge_pulls(p, now, roles).select("pull", "outcome")


@query("SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderdate, o_orderkey) AS log FROM orders GROUP BY o_custkey")
def r3_pull_log(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))).alias("x"))
    return rows.select("o_custkey", F.array_join(F.col("x.o_orderstatus"), "").alias("log"))


@query("""WITH v AS (SELECT v.review, v.reviewer, v.ts, v.vote, c.reviewer IS NOT NULL AS member, row_number() OVER (PARTITION BY v.review, v.reviewer ORDER BY v.ts, v.vote) AS turn, (SELECT min(ts) + INTERVAL 20 DAY FROM events) AS close FROM votes v LEFT JOIN committee c ON c.review = v.review AND c.reviewer = v.reviewer)
 SELECT coalesce(CASE WHEN NOT member THEN 'not on committee' WHEN ts > close THEN 'closed' WHEN turn > 1 AND review % 2 = 0 THEN 'voted before' END, 'fine') AS reason, count(*) AS n FROM v GROUP BY 1""", "votes", "committee")
def r4_vote_eligibility(spark, d):
    end = table(spark, d, "events").agg((F.min("ts") + F.make_interval(days=F.lit(20))).alias("close"))
    reviews = rules(spark, d).select("review", (F.col("review") % 2 == 1).alias("allow_change")).crossJoin(F.broadcast(end))  # one row
    out = R.eligibility(votes(spark, d), committee(spark, d), reviews)
    return out.groupBy(F.coalesce("reason", F.lit("fine")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT review, coalesce(present, 0) AS present, coalesce(size, 0) AS size, CASE WHEN quorum_exact IS NOT NULL THEN coalesce(present, 0) >= quorum_exact WHEN quorum_ratio = 1 THEN coalesce(present, 0) >= coalesce(size, 0) ELSE coalesce(present, 0) > coalesce(size, 0) * quorum_ratio END AS quorum
 FROM rules LEFT JOIN (SELECT review, count(DISTINCT reviewer) AS size FROM committee GROUP BY review) USING (review) LEFT JOIN (SELECT review, count(DISTINCT reviewer) AS present FROM votes WHERE vote <> 'absent' GROUP BY review) USING (review)""", "rules", "votes", "committee")
def r5_quorum(spark, d):
    return R.quorum(votes(spark, d), committee(spark, d), rules(spark, d))


@query("""WITH l AS (SELECT review, vote FROM (SELECT *, row_number() OVER (PARTITION BY review, reviewer ORDER BY ts DESC, vote DESC) AS r FROM votes) WHERE r = 1),
 n AS (SELECT review, count(*) FILTER (WHERE vote = 'approve') AS approve, count(*) FILTER (WHERE vote = 'deny') AS deny, count(*) FILTER (WHERE vote <> 'absent') AS total FROM l GROUP BY review),
 f AS (SELECT *, coalesce(CASE WHEN fail_exact IS NOT NULL THEN deny >= fail_exact WHEN fail_ratio = 1 THEN deny >= total AND total > 0 ELSE deny > total * fail_ratio END, false) AS failed,
  coalesce(CASE WHEN pass_exact IS NOT NULL THEN approve >= pass_exact WHEN pass_ratio = 1 THEN approve >= total AND total > 0 ELSE approve > total * pass_ratio END, false) AS ok FROM rules JOIN n USING (review))
 SELECT review, approve, deny, total, ok AND NOT failed AS passed, failed FROM f""", "votes", "rules")
def r6_tally(spark, d):
    return R.tally(votes(spark, d), rules(spark, d))


@query("SELECT o_orderkey, date_trunc('day', o_orderdate + INTERVAL 7 DAY) + to_days(CAST((5 - dayofweek(o_orderdate + INTERVAL 7 DAY) + 7) % 7 + 1 AS INTEGER)) - INTERVAL 1 SECOND AS close FROM orders")
def r7_close_time(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.close_time(F.col("o_orderdate"), F.lit(7), F.lit(5)).alias("close"))


@query("SELECT review, (quorum_exact IS NULL) <> (quorum_ratio IS NULL) AND (pass_exact IS NULL) <> (pass_ratio IS NULL) AS valid FROM rules", "rules")
def r8_voting_system_valid(spark, d):
    one = lambda a, b: F.col(a).isNull() != F.col(b).isNull()
    return rules(spark, d).select("review", (one("quorum_exact", "quorum_ratio") & one("pass_exact", "pass_ratio")).alias("valid"))


@query("SELECT event_id, CASE WHEN age < 86400 THEN 'early' WHEN age < 86400 * 11 THEN 'active' ELSE 'expired' END AS state FROM (SELECT event_id, CAST(epoch((SELECT max(ts) FROM events)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS age FROM events)")
def t4_token_windows(spark, d):
    """Each token's state at the newest event's time, taken to the nearest second (halves to the even one), as the SQL's cast does."""
    e = table(spark, d, "events")
    now = e.agg(F.timestamp_seconds(F.rint(F.unix_micros(F.max("ts").cast("timestamp")) / 1e6)).alias("now"))
    return e.crossJoin(F.broadcast(now)).select("event_id", R.token_state(F.col("ts"), F.col("now"), 86400, 10 * 86400).alias("state"))  # one row


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS trail FROM events GROUP BY user_id")
def t5_audit_log(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    return rows.select("user_id", F.array_join(F.col("x.event_type"), ",").alias("trail"))


@query("SELECT n_name AS follower, c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'")
def t6_follow_fanout(spark, d):
    """Followers of a nation hear of its customers' closed orders."""
    from ..streaming.streams import follow_fanout

    follows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("follower"), F.col("n_nationkey").alias("target"), F.col("c_custkey").alias("subject"))
    events = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("event_type"), F.col("o_orderdate").alias("ts"))
    return follow_fanout(events, follows).select("follower", F.col("subject").alias("c_custkey"), F.col("event_type").alias("o_orderkey"))


# --- validators --------------------------------------------------------------------------------------------------------

def _bent(spark, d):
    """Triples of parts, some of them broken on purpose by their key."""
    k = F.col("p_partkey")
    s = triplify.iri("part", "p_partkey")
    t = triplify.rule(table(spark, d, "part"), F.when(k % 50 != 1, s), "ex:x", o=F.when(k % 50 == 2, s), o_lit=F.when(k % 50 != 2, F.col("p_name")), datatype=F.when(k % 50 == 3, "xsd:string"), language=F.when(k % 25 == 3, "en"))
    return t.withColumns({"s_blank": F.lit(None).cast("string"), "o_blank": F.lit(None).cast("string")})


@query("""SELECT coalesce(s, '') AS s, errors FROM (SELECT CASE WHEN p_partkey % 50 <> 1 THEN 'http://ex.org/part/' || p_partkey END AS s, CASE WHEN p_partkey % 50 = 1 THEN 'subject' WHEN p_partkey % 50 = 2 THEN 'loop' WHEN p_partkey % 50 = 3 THEN 'datatype and language' END AS errors FROM part) WHERE errors IS NOT NULL""")
def c1_shape(spark, d):
    return Q.check_shape(_bent(spark, d)).select(F.coalesce("s", F.lit("")).alias("s"), F.array_join("errors", ",").alias("errors"))


@query("SELECT s, p FROM ids WHERE right(s, 1) = '7'", "ids")
def c2_hashes(spark, d):
    t = with_triple_identity(triples(spark, d))
    stored = t.withColumn("stored_identity", F.when(F.col("s").endswith("7"), F.col("pair_identity")).otherwise(F.col("triple_identity"))).drop("pair_identity", "triple_identity")
    return Q.check_hashes(stored).select("s", "p")


@query("SELECT iri FROM (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'http://uri.ex.org/team/tx_' ELSE 'http://uri.ex.org/base/tx_' END || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS iri FROM part) WHERE iri LIKE '%/team/%'")
def c3_term_uris(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    group = F.when(k % 10 == 0, "team").otherwise("base")
    t = triplify.rule(part, F.concat(F.lit("http://uri.ex.org/"), group, F.lit("/tx_"), F.lpad(k.cast("string"), 7, "0")), "ex:x", o_lit=F.lit("v"))
    return Q.check_term_uris(t, "uri.ex.org").select(F.col("s").alias("iri"))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def c4_unique(spark, d):
    return Q.check_unique(table(spark, d, "part"), ["p_name"])


@query("SELECT id FROM terms WHERE label <> trim(label)", "terms")
def c5_edge_space(spark, d):
    return Q.check_edges(triplify.term_tables(spark, d)["terms"], "label", "definition").select("id")


@query("SELECT id FROM terms WHERE id % 9 = 0", "terms")
def c6_id_pattern(spark, d):
    t = triplify.term_tables(spark, d)["terms"].withColumn("tx", F.when(F.col("id") % 9 == 0, F.concat("tx", F.lit("x"))).otherwise(F.col("tx")))
    return t.where(~F.col("tx").rlike("^tx_[0-9]{7}$")).select("id")


@query("SELECT iri FROM existing WHERE iri LIKE 'http://uri.ex.org/%'", "existing")
def c7_external_not_own(spark, d):
    from ..functions.iris import host

    return triplify.term_tables(spark, d)["existing"].where(host(F.col("iri")) == "uri.ex.org").select("iri")


@query("SELECT n_regionkey AS s, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
def c8_one_relation(spark, d):
    return Q.check_unique(table(spark, d, "nation").select(F.col("n_regionkey").alias("s")), ["s"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def c9_foreign_keys(spark, d):
    """Customers without an urgent order."""
    orders = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    return Q.check_foreign(table(spark, d, "customer"), "c_custkey", orders, "o_custkey").select("c_custkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0")
def c10_spec_path(spark, d):
    k = F.col("n_nationkey")
    uri = F.concat(F.lit("http://ex.org/"), F.when(k % 3 == 0, "other").otherwise(F.lower("n_name")), F.lit("/spec"))
    return table(spark, d, "nation").where(uri != F.concat(F.lit("http://ex.org/"), F.lower("n_name"), F.lit("/spec"))).select("n_nationkey")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'shape' WHEN p_partkey % 10 = 1 THEN 'object type' WHEN p_partkey % 10 = 2 THEN 'scheme' WHEN p_partkey % 10 = 3 THEN 'white space' WHEN p_partkey % 10 = 4 THEN 'user uri' ELSE '' END AS errors FROM part""")
def c11_patch_errors(spark, d):
    k = F.col("p_partkey") % 10
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(k != 0, "http://ex.org/s").alias("s"), F.when(k == 4, "http://uri.ex.org/a/uris/b").otherwise("ex:p").alias("p"), F.when(k == 2, "no scheme").otherwise("http://ex.org/o").alias("o"),
        F.when(k == 3, " v").otherwise("v").alias("o_lit"), F.when(k == 1, "other").when((k == 2) | (k > 6), "uri").otherwise("literal").alias("kind"))
    return rows.select("p_partkey", F.array_join(Q.patch_errors("uri.ex.org"), ",").alias("errors"))


@query("SELECT 'http://ex.org/brand/' || p_brand AS s, count(*) AS n FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY p_brand HAVING count(*) > 1")
def c12_cardinality(spark, d):
    rows = triplify.rule(table(spark, d, "part").select("p_brand", "p_name").distinct(), triplify.iri("brand", "p_brand"), triplify.LABEL, o_lit=F.col("p_name"))
    return Q.cardinality_errors(rows).select("s", "n")


@query("SELECT n_name FROM nation WHERE length(n_name) < 5 OR NOT regexp_matches(lower(n_name), '^[a-z]+$') OR n_name IN (SELECT r_name FROM region)")
def c14_group_names(spark, d):
    n = table(spark, d, "nation")
    shape = n.where((F.length("n_name") < 5) | ~F.lower("n_name").rlike("^[a-z]+$"))
    reserved = n.join(table(spark, d, "region").select(F.col("r_name").alias("n_name")), "n_name", "left_semi")
    return shape.select("n_name").union(reserved.select("n_name")).distinct()


@query("SELECT conv_id, turn FROM conversations WHERE role NOT IN ('user', 'assistant') OR trim(text) = ''")
def c15_comment_shape(spark, d):
    return table(spark, d, "conversations").where(~F.col("role").isin("user", "assistant") | (F.trim("text") == "")).select("conv_id", "turn")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 5 < 2")
def c16_role_ranges(spark, d):
    role = F.element_at(F.array(*[F.lit(r) for r in R.ROLES]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "customer").where(R.role_rank(role) <= 2).select("c_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) > 5")
def c17_quota(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 5")


@query("""WITH g AS (SELECT *, lower(trim(label)) AS low, count(*) OVER (PARTITION BY lower(trim(label))) AS n FROM terms),
 l AS (SELECT *, status = '0' AND type NOT IN ('TermSet', 'cde') AS live FROM g WHERE n > 1), f AS (SELECT *, min(CASE WHEN live THEN id END) OVER (PARTITION BY low) AS first FROM l)
 SELECT id, first AS duplicate_of FROM f WHERE live AND id <> first""", "terms")
def c18_label_duplicates(spark, d):
    none = spark.createDataFrame([], "id long, label string")
    return Q.dedupe_labels(triplify.term_tables(spark, d)["terms"], none)[1]


@query("SELECT count(*) AS n, count(DISTINCT id) AS labels FROM (SELECT id FROM (SELECT *, count(*) OVER (PARTITION BY lower(trim(label))) AS n FROM terms) WHERE n > 1)", "terms")
def c18_labels_are_unique(spark, d):
    labels = Q.dedupe_labels(triplify.term_tables(spark, d)["terms"], spark.createDataFrame([(8, "a name of its own")], "id long, label string"))[0]
    return labels.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.lower("new_label")).alias("labels"))


@query("SELECT tid, iri, CASE WHEN iri LIKE 'http://uri.ex.org/%' THEN 'keep: own' WHEN tid = min(tid) OVER (PARTITION BY iri) THEN 'keep: external' ELSE 'other term' END AS verdict FROM existing", "existing")
def c19_cull_existing(spark, d):
    return Q.cull_existing(triplify.term_tables(spark, d)["existing"], "http://uri.ex.org/").select("tid", "iri", "verdict")


@query("SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def c20_ambiguous_names(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count_distinct("lang").alias("n")).where("n > 1")


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 = 1")
def c22_name_change(spark, d):
    k = F.col("p_partkey")
    before, after = F.when(k % 2 == 1, F.col("p_name")), F.when(k % 4 == 1, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").where(before.isNotNull() & (before != after)).select("p_partkey")


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey % 2 = 0 GROUP BY n_regionkey HAVING count(*) <> 1")
def c23_one_default(spark, d):
    return table(spark, d, "nation").where("n_nationkey % 2 = 0").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")).where("n <> 1")
