"""Validators: each returns the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.iris import edge_white, host
from .identities import with_triple_identity


def shape_errors() -> Column:
    """Names of the rules of form that a triple row breaks."""
    has = lambda c: F.col(c).isNotNull().cast("int")
    rules = {
        "subject": has("s") + has("s_blank") != 1, "object": has("o") + has("o_lit") + has("o_blank") != 1,
        "datatype and language": has("datatype") + has("language") > 1, "datatype without literal": (has("datatype") + has("language") > 0) & F.col("o_lit").isNull(),
        "loop": F.coalesce(F.col("s") == F.col("o"), F.lit(False)) | F.coalesce(F.col("s_blank") == F.col("o_blank"), F.lit(False)),
        "predicate": F.col("p").isNull(),
    }
    return F.array_compact(F.array(*[F.when(r, n) for n, r in rules.items()]))


def check_shape(triples: DataFrame) -> DataFrame:
    return triples.withColumn("errors", shape_errors()).where(F.size("errors") > 0)


def check_hashes(stored: DataFrame) -> DataFrame:
    """Rows (triple columns, stored_identity) whose hash isn't the one worked out again."""
    return with_triple_identity(stored).where(~F.col("triple_identity").eqNullSafe(F.col("stored_identity")))


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_foreign(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).join(other.select(F.col(other_key).alias(key)), key, "left_anti")


def check_edges(df: DataFrame, *cols: str) -> DataFrame:
    """Rows with white space at an edge of any of the columns."""
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(edge_white(F.col(c)), F.lit(False)) for c in cols]))


def check_term_uris(triples: DataFrame, own_host: str) -> DataFrame:
    """Term ids of the own host that stand under another group than base."""
    bad = lambda c: F.coalesce((host(F.col(c)) == own_host) & F.col(c).rlike("/[a-z]+_[0-9]+$") & ~F.col(c).rlike("^[a-z]+://[^/]+/base/"), F.lit(False))
    return triples.where(bad("s") | bad("p") | bad("o"))


def patch_errors(own_host: str) -> Column:
    """Errors of a patch row (s, p, o, o_lit, kind)."""
    f = lambda x: F.coalesce(x, F.lit(False))
    return F.array_compact(F.array(
        F.when(F.col("s").isNull() | F.col("p").isNull(), "shape"), F.when(~f(F.col("kind").isin("uri", "literal")), "object type"),
        F.when((F.col("kind") == "uri") & ~f(F.col("o").rlike("^[a-z][a-z0-9+.-]*:")), "scheme"),
        F.when((F.col("kind") == "literal") & f(edge_white(F.col("o_lit"))), "white space"),
        F.when((F.col("kind") == "literal") & F.col("o_lit").isNull(), "no value"),
        F.when(f((host(F.col("p")) == own_host) & F.col("p").contains("/uris/")), "user uri"),
    ))


def cardinality_errors(triples: DataFrame, predicates: tuple[str, ...] = ("rdfs:label", "ex:definition")) -> DataFrame:
    return triples.where(F.col("p").isin(*predicates)).groupBy("s", "p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dedupe_labels(terms: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels that several terms share made apart: (labels, duplicates).

    An override gives its label.  Else deprecated and deleted terms, term sets and data elements get a suffix.  Of the others the lowest id
    keeps the label and the rest are its duplicates, which their suffix says.  ``labels``: id, label, new_label, reason.
    """
    low = F.lower(F.trim("label"))
    shared = terms.where("label is not null").withColumn("low", low).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("low"))).where("n > 1")
    named = shared.join(overrides.toDF("id", "override"), "id", "left")
    live = F.col("override").isNull() & (F.col("status") == "0") & ~F.col("type").isin("TermSet", "cde")
    first = F.min(F.when(live, F.col("id"))).over(W.partitionBy("low"))
    out = named.withColumn("live", live).withColumn("first", first)
    suffix = (
        F.when(F.col("override").isNotNull(), None).when(F.col("status") == "-2", " (deprecated)").when(F.col("status") == "-1", " (deleted)")
        .when(F.col("type") == "TermSet", " (TermSet)").when(F.col("type") == "cde", " (CDE)")
        .when(F.col("id") != F.col("first"), F.concat(F.lit(" (duplicateOf "), F.col("first").cast("string"), F.lit(")"))).otherwise("")
    )
    made = out.withColumn("made", F.coalesce("override", F.concat(F.trim("label"), suffix)))
    again = F.row_number().over(W.partitionBy(F.lower("made")).orderBy("id"))
    labels = made.withColumn("k", again).select(
        "id", "label", F.when(F.col("k") > 1, F.concat("made", F.lit(" #"), F.col("id").cast("string"))).otherwise(F.col("made")).alias("new_label")
    )
    pairs = out.where("live and id <> first").select("id", F.col("first").alias("duplicate_of"))
    return labels, pairs


def cull_existing(existing: DataFrame, own_prefix: str) -> DataFrame:
    """Existing ids with ``verdict``: keep, or why a row goes.

    Repeated rows, iris with white space, several curies for one iri of a term, and iris that belong to several terms (the lowest
    term keeps them) go; own iris are told apart from external ones.
    """
    copy = F.row_number().over(W.partitionBy("tid", "iri", "curie").orderBy("preferred"))
    curie = F.dense_rank().over(W.partitionBy("tid", "iri").orderBy("curie"))
    owner = F.min("tid").over(W.partitionBy("iri"))
    return existing.withColumns({"copy": copy, "curies": curie, "owner": owner}).select(
        "tid", "iri", "curie",
        F.when(F.col("copy") > 1, "repeated").when(F.col("iri").rlike(r"\s"), "bad iri").when(F.col("curies") > 1, "several curies")
        .when(F.col("tid") != F.col("owner"), "other term").when(F.col("iri").startswith(own_prefix), "keep: own").otherwise("keep: external").alias("verdict"),
    )
