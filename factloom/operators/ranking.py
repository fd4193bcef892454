"""Ranked search: an inverted index by field with lengths and document frequencies, phrase scores within fields, the best k of each query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import cut

#: Weights of fields for plain queries and for identifiers, and the share of a record's lesser fields: fixed values.
BOOSTS = {"label": 4.0, "synonyms": 2.0, "definition": 1.2, "objects": 1.0, "existing_curies": 1.0, "existing_iris": 1.0, "curie": 1.2, "iri": 1.0}
IDENTIFIER_BOOSTS = {"existing_curies": 1.0, "existing_iris": 1.0, "curie": 3.0, "iri": 2.0, "label": 4.0, "synonyms": 1.0, "definition": 1.0}
TIE = 0.3
#: How fast repeated hits and long fields count for less.
K1, B = 1.2, 0.75


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda x: x != "")


@dataclass
class Index:
    postings: DataFrame  # field, token, s, literal (place of the value in the field), position
    lengths: DataFrame  # field, s, n: words of a record's field
    fields: DataFrame  # field, records, mean: how many records have it, and their mean length


def index(values: DataFrame) -> Index:
    """Index of ``values`` (s, field, text); a field may have several values, and a phrase lies within one."""
    rows = values.where("text is not null").select("s", "field", F.xxhash64("text").alias("literal"), words(F.col("text")).alias("w"))
    rows = rows.dropDuplicates(["s", "field", "literal"])
    rows = cut(rows.where(F.size("w") > 0))
    lengths = rows.groupBy("field", "s").agg(F.sum(F.size("w")).alias("n"))
    fields = lengths.groupBy("field").agg(F.count(F.lit(1)).alias("records"), F.avg("n").alias("mean"))
    return Index(rows.select("field", "s", "literal", F.posexplode("w").alias("position", "token")), lengths, fields)


def search(ix: Index, queries: DataFrame, prefixes: list[str], k: int) -> DataFrame:
    """(query, place, s, score) of the ``k`` best records of each of ``queries`` (query), a report that is asked for by its length.

    A query ``prefix:suffix`` with a known prefix asks for identifiers and has other weights of fields.  Its words have to follow each other
    in a value.  A field's score is the sum of its words' rarities, damped by repeats and length; a record's is its best weighted field
    and a share of the others.  Ties go by ``s``.  Each task first keeps its own best of a query, so a word of very many records is no
    load for one task.  Postings of the queries' words alone are read out of the index.
    """
    known = F.split("query", ":")[0].isin(prefixes) & (F.size(F.split("query", ":")) == 2)
    asked = queries.select("query").distinct().withColumn("identifier", known).withColumn("w", words(F.col("query"))).where(F.size("w") > 0)
    terms = asked.select("query", "identifier", F.posexplode("w").alias("k", "token"), F.size("w").alias("n_words"))
    hit = ix.postings.join(F.broadcast(terms.select("token").distinct()) if _few(queries) else terms.select("token").distinct(), "token", "left_semi")
    hit = cut(hit)
    rarity = hit.groupBy("field", "token").agg(F.count_distinct("s").alias("df")).join(ix.fields, "field")
    rarity = rarity.select("field", "token", F.log(1 + (F.col("records") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = terms.join(rarity, "token").groupBy("query", "field").agg(F.sum("idf").alias("idf"))
    at = hit.join(terms, "token").groupBy("query", "identifier", "n_words", "field", "s", "literal", (F.col("position") - F.col("k")).alias("start")).agg(F.count_distinct("k").alias("c"))
    tf = at.where("c = n_words").groupBy("query", "identifier", "field", "s").agg(F.count(F.lit(1)).alias("tf"))
    boost = lambda m: F.coalesce(F.create_map(*[F.lit(v) for kv in m.items() for v in kv])[F.col("field")], F.lit(0.0))
    damp = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    scored = tf.join(weight, ["query", "field"]).join(ix.lengths, ["field", "s"]).join(F.broadcast(ix.fields), "field")  # a row for each field
    scored = scored.select("query", "s", (F.when(F.col("identifier"), boost(IDENTIFIER_BOOSTS)).otherwise(boost(BOOSTS)) * F.col("idf") * damp).alias("x")).where("x > 0")
    total = scored.groupBy("query", "s").agg(F.round(F.max("x") + TIE * (F.sum("x") - F.max("x")), 6).alias("score"))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "s"))
    return total.withColumn("place", place).where(F.col("place") <= k).select("query", "place", "s", "score")


def _few(queries: DataFrame, most: int = 100_000) -> bool:
    """Queries whose words are proven to fit into every task."""
    size = queries.agg(F.sum(F.octet_length("query") + 16).alias("b")).first().b or 0
    return size <= 8 * most
