"""Ranked search and nested term sets over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, rebuild
from ..sources.triplify import iri, rule
from .base import CTES, query, table

QUERIES = ("small ring", "red widget", "Brand#2", "TX:15", "tx:7", "TX:red", "china", "token", "small", "ECONOMY brand", "no such words", "united  states")
TOP = 25
PREFIXES = ["TX"]


def values(spark, d):
    """(s, field, text): parts by name, type and brand, curie and iri; nations and documents by label and text."""
    part, docs = table(spark, d, "part"), table(spark, d, "documents")
    k = F.col("p_partkey").cast("string")
    of = lambda df, s, field, text: df.select(s.alias("s"), F.lit(field).alias("field"), text.alias("text"))
    s, doc = iri("part", "p_partkey"), iri("document", "doc_id")
    rows = [
        of(part, s, "label", F.col("p_name")), of(part, s, "definition", F.concat_ws(" ", "p_type", "p_brand")), of(part, s, "synonyms", F.col("p_brand")), of(part.where(F.col("p_partkey") % 3 == 0), s, "synonyms", F.concat("p_name", F.lit(" "), F.col("p_type"))),
        of(part, s, "curie", F.concat(F.lit("TX:"), k)), of(part, s, "iri", s), of(part.where(F.col("p_partkey") % 5 == 0), s, "existing_curies", F.concat(F.lit("TX:"), (F.col("p_partkey") % 50).cast("string"))),
        of(table(spark, d, "nation"), iri("nation", "n_nationkey"), "label", F.col("n_name")), of(docs, doc, "label", F.split("text", "\n")[0]), of(docs, doc, "objects", F.col("text")),
    ]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out


_WORDS = r"list_filter(string_split(lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"
_BOOST = lambda m: "CASE field " + " ".join(f"WHEN '{f}' THEN {b}" for f, b in m.items()) + " ELSE 0 END"
CTES |= {
    "se_v": """SELECT 'http://ex.org/part/' || p_partkey AS s, unnest(['label', 'definition', 'synonyms', 'curie', 'iri']) AS field, unnest([p_name, p_type || ' ' || p_brand, p_brand, 'TX:' || p_partkey, 'http://ex.org/part/' || p_partkey]) AS text FROM part
        UNION ALL SELECT 'http://ex.org/part/' || p_partkey, 'synonyms', p_name || ' ' || p_type FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'http://ex.org/part/' || p_partkey, 'existing_curies', 'TX:' || (p_partkey % 50) FROM part WHERE p_partkey % 5 = 0
        UNION ALL SELECT 'http://ex.org/nation/' || n_nationkey, 'label', n_name FROM nation UNION ALL SELECT 'http://ex.org/document/' || doc_id, unnest(['label', 'objects']), unnest([string_split(text, chr(10))[1], text]) FROM documents""",
    "se_r": f"SELECT *, row_number() OVER () AS r FROM (SELECT DISTINCT s, field, text, {_WORDS.format('text')} AS w FROM se_v WHERE text IS NOT NULL) WHERE len(w) > 0",
    "se_l": "SELECT field, s, sum(len(w)) AS n FROM se_r GROUP BY field, s",
    "se_f": "SELECT field, count(*) AS records, avg(n) AS mean FROM se_l GROUP BY field",
    "se_q": f"SELECT query, w, regexp_matches(query, '^TX:[^:]*$') AS identifier FROM (SELECT query, {_WORDS.format('query')} AS w FROM (VALUES {', '.join(f'({q!r})' for q in QUERIES)}) v(query))",
    "se_p": "SELECT field, s, r, unnest(w) AS token, unnest(range(len(w))) AS position FROM se_r",
    "se_t": "SELECT query, identifier, len(w) AS n_words, unnest(w) AS token, unnest(range(len(w))) AS k FROM se_q",
    "se_i": "SELECT query, field, sum(ln(1 + (records - df + 0.5) / (df + 0.5))) AS idf FROM se_t JOIN (SELECT field, token, count(DISTINCT s) AS df FROM se_p GROUP BY field, token) USING (token) JOIN se_f USING (field) GROUP BY query, field",
    "se_h": "SELECT query, identifier, field, s, count(*) AS tf FROM (SELECT query, identifier, n_words, field, s, r, position - k AS start FROM se_p JOIN se_t USING (token) GROUP BY ALL HAVING count(DISTINCT k) = n_words) GROUP BY query, identifier, field, s",
}
SE = ("se_v", "se_r", "se_l", "se_f", "se_q", "se_p", "se_t", "se_i", "se_h")


@query(f"""WITH x AS (SELECT query, s, CASE WHEN identifier THEN {_BOOST(ranking.IDENTIFIER_BOOSTS)} ELSE {_BOOST(ranking.BOOSTS)} END * idf * tf / (tf + {ranking.K1} * (1 - {ranking.B} + {ranking.B} * n / mean)) AS x
   FROM se_h JOIN se_i USING (query, field) JOIN se_l USING (field, s) JOIN se_f USING (field)),
 z AS (SELECT query, s, round(max(x) + 0.3 * (sum(x) - max(x)), 6) AS score FROM x WHERE x > 0 GROUP BY query, s)
 SELECT query, CAST(place AS INTEGER) AS place, s, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, s) AS place FROM z) WHERE place <= {TOP}""", *SE)
def p13_ranked_search(spark, d):
    """The best records of twelve queries, identifiers among them, scored within fields."""
    asked = spark.createDataFrame([(q,) for q in QUERIES], "query string")
    return ranking.search(ranking.index(values(spark, d)), asked, PREFIXES, TOP)


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS k, p_partkey // 10 AS j FROM part WHERE p_partkey % 10 = 3), e AS (SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON b.j IN (2 * a.j, 2 * a.j + 1) OR (a.j % 7 = 0 AND b.j = a.j // 2)),
 m AS (SELECT k AS a, p.p_partkey AS b FROM t JOIN part p ON p.p_partkey IN (k + 1, k + 2) OR (j % 5 = 0 AND p.p_partkey = k + 10)),
 w AS (SELECT k AS start, k AS node FROM t JOIN nation ON j = n_nationkey UNION SELECT w.start, e.b FROM w JOIN e ON e.a = w.node)
 SELECT DISTINCT 'http://ex.org/part/' || w.start AS start, 'http://ex.org/part/' || m.b AS member, 'http://ex.org/part/' || w.node AS in_set FROM w JOIN m ON m.a = w.node""")
def g13_nested_termsets(spark, d):
    """Members of the sets that nations name, through sets within sets, some of which hold a set above them."""
    k, j = F.col("p_partkey"), F.floor(F.col("p_partkey") / 10)
    part = table(spark, d, "part").select("p_partkey")
    sets = part.where(k % 10 == 3)
    have = lambda df, col: df.where(f"{col} is not null").join(part.select(F.col("p_partkey").alias(col)), col, "left_semi")
    inner = have(sets.select("p_partkey", F.explode(F.array(20 * j + 3, 20 * j + 13, F.when(j % 7 == 0, 10 * F.floor(j / 2) + 3))).alias("o")), "o")
    terms = have(sets.select("p_partkey", F.explode(F.array(k + 1, k + 2, F.when(j % 5 == 0, k + 10))).alias("o")), "o")
    facts = rule(inner, iri("part", "p_partkey"), rebuild.INCLUDES_SET, o=iri("part", "o")).unionByName(rule(terms, iri("part", "p_partkey"), rebuild.INCLUDES_TERM, o=iri("part", "o")))
    starts = have(table(spark, d, "nation").select((F.col("n_nationkey") * 10 + 3).alias("k")), "k").select(iri("part", "k").alias("start"))
    return rebuild.termset_members(facts, starts)[0]
