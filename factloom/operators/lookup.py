"""Lookups, joins and aggregates over triples and the tables around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..sources.triplify import SYNONYMS

DEFINITIONS = ("ex:definition", "skos:definition", "iao:definition")


def objects_for(triples: DataFrame, subjects: DataFrame, *predicates: str) -> DataFrame:
    """(s, p, o, o_lit) of the subjects for any of the predicates."""
    return triples.where(F.col("p").isin(*predicates)).join(subjects.select("s").distinct(), "s", "left_semi").select("s", "p", "o", "o_lit")


def labels(triples: DataFrame, subjects: DataFrame) -> DataFrame:
    return objects_for(triples, subjects, "rdfs:label").select("s", "o_lit")


def definitions(triples: DataFrame, subjects: DataFrame) -> DataFrame:
    return objects_for(triples, subjects, *DEFINITIONS).select("s", "o_lit")


def by_label(triples: DataFrame, asked: DataFrame, exact: bool = False) -> DataFrame:
    """For each asked ``label``: status none, one or many, and the subjects with their definitions.

    Labels compare without case; ``%`` and ``_`` in an asked label are wildcards unless ``exact``.  Labels without
    wildcards join by equality, so only the rest is compared by pattern.
    """
    rows = triples.where("p = 'rdfs:label' and o_lit is not null").select("s", F.lower("o_lit").alias("low"))
    q = asked.select("label").distinct().withColumn("want", F.lower("label"))
    wild = q.where(F.lit(not exact) & F.col("want").rlike("[%_]"))
    plain = q.join(wild.select("label"), "label", "left_anti").join(rows, F.col("want") == F.col("low"))
    hits = plain.select("label", "s")
    if not exact:
        hits = hits.unionByName(wild.join(rows, F.expr("low like want")).select("label", "s"))
    defs = triples.where(F.col("p").isin(*DEFINITIONS)).groupBy("s").agg(F.min("o_lit").alias("definition"))
    many = hits.distinct().join(defs, "s", "left").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("s", F.coalesce("definition", F.lit("")).alias("definition")))).alias("found")
    )
    return q.select("label").join(many, "label", "left").select(
        "label", F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "one").otherwise("many").alias("status"),
        F.coalesce("n", F.lit(0)).alias("n"), "found",
    )


def known(triples: DataFrame, asked: DataFrame) -> DataFrame:
    """Which asked ``iri`` occurs as subject, which as predicate."""
    s = triples.select(F.col("s").alias("iri")).distinct().withColumn("as_s", F.lit(True))
    p = triples.select(F.col("p").alias("iri")).distinct().withColumn("as_p", F.lit(True))
    out = asked.select("iri").distinct().join(s, "iri", "left").join(p, "iri", "left")
    return out.select("iri", F.coalesce("as_s", F.lit(False)).alias("as_subject"), F.coalesce("as_p", F.lit(False)).alias("as_predicate"))


def entity_conflicts(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request, p, o_lit) against the registry of unique strings, a list of conflicts for each request and subject."""
    hit = requests.withColumnRenamed("p", "submitted").join(registry.withColumnRenamed("p", "existing"), "o_lit")
    return hit.groupBy("request", "s").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("o_lit", "existing", "submitted"))).alias("conflicts")
    )


def group_curies(base: DataFrame, own: DataFrame, derived: DataFrame) -> DataFrame:
    """(grp, prefix, namespace): derived entries win over a group's own, those over the base's."""
    base = F.broadcast(base) if base.count() <= 100_000 else base
    groups = own.select("grp").union(derived.select("grp")).distinct()
    every = (
        groups.crossJoin(base).withColumn("rank", F.lit(2))  # each group has the whole base map, so the product is the result
        .unionByName(own.withColumn("rank", F.lit(1))).unionByName(derived.withColumn("rank", F.lit(0)))
    )
    return every.groupBy("grp", "prefix").agg(F.min_by("namespace", F.struct("rank", "namespace")).alias("namespace"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of each key; the last order column breaks ties."""
    best = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def best(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def identities_exist(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """``position``, ``identity``, ``found`` for each asked identity."""
    have = stored.select("identity").distinct().withColumn("found", F.lit(True))
    return asked.join(have, "identity", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def graph_from_subjects(triples: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rows of the subjects and of the blank nodes that they hold directly."""
    own = triples.join(subjects.select("s"), "s", "left_semi")
    held = own.where("o_blank is not null").select(F.col("o_blank").alias("s_blank")).distinct()
    return own.unionByName(triples.join(held, "s_blank", "left_semi").select(*triples.columns)).distinct()


def nested_graph(triples: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rows of the subjects and of all blank nodes at any depth below them, with ``top``, the subject that each row belongs to."""
    own = triples.join(subjects.select("s").distinct(), "s", "left_semi").withColumn("top", F.col("s"))
    links = cut(triples.where("s_blank is not null and o_blank is not null").select(F.col("s_blank").alias("node"), F.col("o_blank").alias("below")).distinct())
    new = cut(own.where("o_blank is not null").select("top", F.col("o_blank").alias("node")).distinct())
    found = new
    while not new.isEmpty():  # a pair enters once, so cycles end
        new = cut(new.join(links, "node").select("top", F.col("below").alias("node")).distinct().join(found, ["top", "node"], "left_anti"))
        found = found.unionByName(new)
    below = triples.join(found.withColumnRenamed("node", "s_blank"), "s_blank")
    return own.unionByName(below.select(*triples.columns, "top"))


def heads_for_subject(heads: DataFrame, groups: DataFrame, identities: DataFrame) -> DataFrame:
    """(subject, grp, head, ...): heads with the group of their perspective and what is known of what they point to."""
    return heads.join(groups, "perspective").join(identities, "subject").drop("perspective")


def header_mismatch(old: Column, new: Column) -> Column:
    """Names of the compared headers that both maps hold with different values."""
    names = ("ETag", "Content-Length", "Last-Modified")  # fixed values
    return F.array_compact(F.array(*[F.when(old[n] != new[n], n) for n in names]))


def predicate_is_property(triples: DataFrame) -> DataFrame:
    """(p, is_property): whether all types of each used predicate are property types."""
    types = triples.where("p = 'rdf:type'").groupBy("s").agg(F.bool_and(F.col("o").endswith("Property")).alias("ok"))
    used = triples.select(F.col("p").alias("s")).distinct()
    return used.join(types, "s", "left").select(F.col("s").alias("p"), F.coalesce("ok", F.lit(False)).alias("is_property"))


def duplicate_groups(df: DataFrame, key: Column, member: str) -> DataFrame:
    """(key, n, members) of keys that several distinct members share."""
    return df.groupBy(key.alias("key")).agg(F.count_distinct(member).alias("n"), F.min(member).alias("least")).where("n > 1")


def curie_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each prefix of either map: ``state`` add, existing, kept, or a conflict."""
    o, n = old.select("prefix", F.col("namespace").alias("old")), new.select("prefix", F.col("namespace").alias("new"))
    both = o.join(n, "prefix", "full")
    bound = old.select(F.col("namespace").alias("new"), F.col("prefix").alias("bound"))
    twice = new.groupBy(F.col("namespace").alias("new")).agg(F.count(F.lit(1)).alias("times"))
    out = both.join(bound, "new", "left").join(twice, "new", "left")
    return out.select(
        "prefix", "old", "new",
        F.when(F.col("new").isNull(), "kept").when(F.col("times") > 1, "conflict: not injective")
        .when(F.col("old") != F.col("new"), "conflict: prefix is bound").when(F.col("old") == F.col("new"), "existing")
        .when(F.col("bound").isNotNull(), "conflict: namespace is bound").otherwise("add").alias("state"),
    )


def tokens(triples: DataFrame) -> DataFrame:
    """(s, p, literal, token, position) of all literals: an inverted index.  ``literal`` is a digest, so that rows stay short."""
    words = F.filter(F.split(F.lower(F.regexp_replace("o_lit", r"[^\p{L}\p{N}]+", " ")), " "), lambda x: x != "")
    rows = triples.where("o_lit is not null").select("s", "p", F.sha2("o_lit", 256).alias("literal"), words.alias("words"))
    return rows.select("s", "p", "literal", F.posexplode("words").alias("position", "token"))


#: Weight of a hit by predicate: fixed values.
BOOSTS = {"rdfs:label": 4.0, "ex:synonym": 2.0, "ex:definition": 1.2, "ex:title": 1.2}


def search(index: DataFrame, queries: DataFrame, tie: float = 0.3) -> DataFrame:
    """(query, s, score) of literals that hold a query's words one after the other.

    A subject's score is its best field's boost and a share of the others'.
    """
    words = F.filter(F.split(F.lower(F.regexp_replace("query", r"[^\p{L}\p{N}]+", " ")), " "), lambda x: x != "")
    q = queries.select("query", F.posexplode(words).alias("k", "token"), F.size(words).alias("n"))
    hit = index.join(q, "token").groupBy("query", "n", "s", "p", "literal", (F.col("position") - F.col("k")).alias("at")).agg(F.count_distinct("k").alias("c"))
    boost = F.coalesce(F.create_map(*[F.lit(v) for kv in BOOSTS.items() for v in kv])[F.col("p")], F.lit(1.0))
    field = hit.where("c = n").select("query", "s", "p", boost.alias("b")).distinct()
    return field.groupBy("query", "s").agg((F.max("b") + tie * (F.sum("b") - F.max("b"))).alias("score"))


def export_tabular(triples: DataFrame, groups: dict[str, list[str]], sep: str = "\x1f") -> DataFrame:
    """One row for each subject, a column for each group of predicates, several values joined."""
    back = F.create_map(*[F.lit(v) for g, ps in groups.items() for p in ps for v in (p, g)])
    rows = triples.select("s", back[F.col("p")].alias("g"), F.coalesce("o_lit", "o").alias("v")).where("g is not null and v is not null")
    return rows.groupBy("s").pivot("g", list(groups)).agg(F.array_join(F.sort_array(F.collect_list("v")), sep))


def index_records(triples: DataFrame, existing: DataFrame) -> DataFrame:
    """Nested search records: labels, synonyms, types, existing iris of each subject."""
    pick = lambda *p: F.sort_array(F.collect_set(F.when(F.col("p").isin(*p), F.coalesce("o_lit", "o"))))
    own = triples.groupBy("s").agg(pick("rdfs:label").alias("labels"), pick("ex:synonym", *SYNONYMS.values()).alias("synonyms"), pick("rdf:type").alias("types"))
    ids = existing.groupBy("s").agg(F.sort_array(F.collect_set("iri")).alias("existing"))
    return own.join(ids, "s", "left")
