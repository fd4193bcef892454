"""The given tables as the operators' inputs, and the same tables as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import triplify

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str, recursive: bool = False):
    """Register a query under its function's name, with its SQL over the named CTEs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_ctes(sql, *ctes, recursive=recursive)
        return f

    return add


def with_ctes(sql: str, *ctes: str, recursive: bool = False) -> str:
    names = [n for n in CTES if n in ctes or any(n in NEEDS.get(c, ()) for c in ctes)]
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in names)
    body = sql.strip()
    if not names:
        return body
    if body[:5].upper() == "WITH ":
        rest = body[5:].removeprefix("RECURSIVE ")
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {rest}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triples(spark, sf_dir, *tables) -> DataFrame:
    return triplify.triplify_testdata(spark, sf_dir, *([tables] if tables else []))


def _t(name, key, label, above):
    n = "NULL"
    rows = [f"SELECT 'http://ex.org/{name}/'||{key} AS s, 'rdf:type' AS p, 'http://ex.org/{name.capitalize()}' AS o, CAST(NULL AS VARCHAR) AS o_lit, CAST(NULL AS VARCHAR) AS datatype, CAST(NULL AS VARCHAR) AS language FROM {name}"]
    if label:
        rows.append(f"SELECT 'http://ex.org/{name}/'||{key}, 'rdfs:label', {n}, {label}, {n}, {n} FROM {name}")
    if above:
        rows.append(f"SELECT 'http://ex.org/{name}/'||{key}, 'ex:partOf', 'http://ex.org/{above[0]}/'||{above[1]}, {n}, {n}, {n} FROM {name}")
    return rows


_PLACES = [
    *_t("region", "r_regionkey", "r_name", None), *_t("nation", "n_nationkey", "n_name", ("region", "n_regionkey")),
    *_t("customer", "c_custkey", "c_name", ("nation", "c_nationkey")), *_t("supplier", "s_suppkey", "s_name", ("nation", "s_nationkey")),
]
CTES = {
    "places": " UNION ALL ".join(_PLACES),
    "triples": " UNION ALL ".join([
        *_PLACES, *_t("part", "p_partkey", "p_name", None),
        "SELECT 'http://ex.org/customer/'||c_custkey, 'ex:segment', NULL, c_mktsegment, NULL, NULL FROM customer",
        "SELECT 'http://ex.org/part/'||p_partkey, 'ex:brand', NULL, p_brand, NULL, NULL FROM part",
        "SELECT 'http://ex.org/part/'||p_partkey, 'ex:size', NULL, CAST(p_size AS VARCHAR), 'xsd:integer', NULL FROM part",
        "SELECT 'http://ex.org/document/'||doc_id, 'rdf:type', 'http://ex.org/Document', NULL, NULL, NULL FROM documents",
        "SELECT 'http://ex.org/document/'||doc_id, 'ex:title', NULL, substr(string_split(text, chr(10))[1], 1, 40), NULL, lang FROM documents",
        "SELECT 'http://ex.org/document/'||doc_id, 'ex:source', 'http://ex.org/source/'||source, NULL, NULL, NULL FROM documents",
    ]),
    "ids": """SELECT *, sha256(unhex(sha256(s)) || unhex(pair)) AS triple FROM (SELECT *, sha256(unhex(sha256(p)) || unhex(CASE WHEN o IS NOT NULL THEN sha256(o)
        ELSE sha256(unhex(sha256(coalesce(o_lit, ''))) || unhex(sha256(coalesce(datatype, ''))) || unhex(sha256(coalesce(language, '')))) END)) AS pair FROM triples)""",
    "terms": """SELECT p_partkey AS id, 'tx_' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS tx, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE '' END AS label,
        CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS definition, CASE p_partkey % 10 WHEN 0 THEN 'annotation' WHEN 1 THEN 'relationship' WHEN 2 THEN 'cde' WHEN 3 THEN 'TermSet' WHEN 4 THEN 'fde' WHEN 5 THEN 'pde' ELSE 'term' END AS type,
        CASE p_partkey % 50 WHEN 7 THEN '-2' WHEN 8 THEN '-1' ELSE '0' END AS status, p_partkey % 7 AS orig_cid FROM part""",
    "existing": """SELECT p_partkey AS tid, 'http://uri.ex.org/base/tx_' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS iri, 'TX:' || p_partkey AS curie, '0' AS preferred FROM part
        UNION ALL SELECT p_partkey, 'http://purl.ex.net/obo/X_' || (p_partkey % 500), 'X:' || (p_partkey % 500), '1' FROM part WHERE p_partkey % 3 = 0""",
    "log": """SELECT user_id % 25 AS perspective, 'http://ex.org/part/' || (event_id % 200) AS subject, CASE WHEN event_type = 'error' THEN '' ELSE sha256(CAST(event_id % 97 AS VARCHAR)) END AS head, ts FROM events""",
    "votes": """SELECT event_id % 60 AS review, user_id % 15 AS reviewer, ts, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'click' THEN 'approve' WHEN 'error' THEN 'deny' WHEN 'signup' THEN 'absent' ELSE 'present' END AS vote FROM events""",
    "committee": "SELECT DISTINCT n_nationkey + 25 * r AS review, k AS reviewer FROM nation, range(3) a(r), range(12) b(k) WHERE (n_nationkey + k) % 3 > 0",
    "rules": """SELECT CAST(review AS BIGINT) AS review, CASE WHEN review % 2 = 0 THEN 5 END AS quorum_exact, CAST(CASE review % 4 WHEN 1 THEN 0.5 WHEN 3 THEN 1 END AS DOUBLE) AS quorum_ratio,
        CASE WHEN review % 3 = 0 THEN 4 END AS pass_exact, CAST(CASE review % 3 WHEN 1 THEN 0.5 WHEN 2 THEN 1 END AS DOUBLE) AS pass_ratio, CASE WHEN review % 5 = 0 THEN 3 END AS fail_exact, CAST(CASE WHEN review % 5 = 1 THEN 0.25 END AS DOUBLE) AS fail_ratio
        FROM (SELECT DISTINCT event_id % 60 AS review FROM events)""",
    "graphs": """SELECT 'g' || (l_orderkey % 4) AS graph, 'http://ex.org/part/' || l_partkey AS s, 'ex:supplier' AS p, 'http://ex.org/supplier/' || (l_suppkey % 3) AS o, CAST(NULL AS VARCHAR) AS o_lit, CAST(NULL AS VARCHAR) AS datatype, CAST(NULL AS VARCHAR) AS language FROM lineitem
        UNION SELECT 'g' || (l_orderkey % 4), 'http://ex.org/part/' || l_partkey, 'ex:flag', NULL, l_returnflag, NULL, NULL FROM lineitem""",
}
NEEDS = {"ids": ("triples",)}


def head_log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 25).alias("perspective"), F.concat(F.lit("http://ex.org/part/"), (F.col("event_id") % 200).cast("string")).alias("subject"),
        F.when(F.col("event_type") == "error", "").otherwise(F.sha2((F.col("event_id") % 97).cast("string"), 256)).alias("head"), "ts",
    )


def votes(spark, sf_dir) -> DataFrame:
    kind = triplify.mapped({"purchase": "approve", "click": "approve", "error": "deny", "signup": "absent"}, F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") % 60).alias("review"), (F.col("user_id") % 15).alias("reviewer"), "ts", F.coalesce(kind, F.lit("present")).alias("vote")
    )


def committee(spark, sf_dir) -> DataFrame:
    r, k = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", r).select("n_nationkey", "r", k).where("(n_nationkey + k) % 3 > 0")
    return rows.select((F.col("n_nationkey") + 25 * F.col("r")).cast("long").alias("review"), F.col("k").cast("long").alias("reviewer")).distinct()


def rules(spark, sf_dir) -> DataFrame:
    r = F.col("review")
    return table(spark, sf_dir, "events").select((F.col("event_id") % 60).alias("review")).distinct().select(
        "review", F.when(r % 2 == 0, 5).alias("quorum_exact"), F.when(r % 4 == 1, 0.5).when(r % 4 == 3, 1.0).alias("quorum_ratio"),
        F.when(r % 3 == 0, 4).alias("pass_exact"), F.when(r % 3 == 1, 0.5).when(r % 3 == 2, 1.0).alias("pass_ratio"),
        F.when(r % 5 == 0, 3).alias("fail_exact"), F.when(r % 5 == 1, 0.25).alias("fail_ratio"),
    )


def graph_rows(spark, sf_dir) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    graph, s = F.concat(F.lit("g"), (F.col("l_orderkey") % 4).cast("string")), triplify.iri("part", "l_partkey")
    none = F.lit(None).cast("string")
    end = (none.alias("datatype"), none.alias("language"))
    a = item.select(graph.alias("graph"), s.alias("s"), F.lit("ex:supplier").alias("p"), triplify.iri("supplier", F.col("l_suppkey") % 3).alias("o"), none.alias("o_lit"), *end)
    b = item.select(graph.alias("graph"), s.alias("s"), F.lit("ex:flag").alias("p"), none.alias("o"), F.col("l_returnflag").alias("o_lit"), *end)
    return a.unionByName(b).distinct()
