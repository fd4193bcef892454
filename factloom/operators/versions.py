"""Versions of subjects, heads of logs, diffs, patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import sequence_identity
from .identities import named_records, with_triple_identity
from .lookup import latest


def distinct_versions(rows: DataFrame) -> DataFrame:
    """Rows (graph, s, named triple columns) -> one row for each version of a subject.

    Graphs with equal sets of triples about a subject have one version: (s, version, n, graphs).
    """
    ids = with_triple_identity(rows).select("graph", "s", "triple_identity").distinct()
    per = ids.groupBy("graph", "s").agg(sequence_identity(F.collect_list("triple_identity")).alias("version"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("s", "version", "n").agg(F.array_join(F.sort_array(F.collect_set("graph")), ",").alias("graphs"))


def heads(log: DataFrame) -> DataFrame:
    """Newest head of each (perspective, subject); an empty head means deleted and goes."""
    return latest(log, ["perspective", "subject"], ["ts", "head"]).where("head <> ''")


def graph_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(triple_identity, state): added, removed or same."""
    x = with_triple_identity(a).select("triple_identity").distinct().withColumn("a", F.lit(1))
    y = with_triple_identity(b).select("triple_identity").distinct().withColumn("b", F.lit(1))
    return x.join(y, "triple_identity", "full").select(
        "triple_identity", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("same").alias("state")
    )


KEY = ["s", "p", "o", "o_lit", "datatype", "language"]


def check_patch(triples: DataFrame, patch: DataFrame) -> DataFrame:
    """Patch rows (op, triple columns) with ``error``: add present, delete absent, both at once; null is fine."""
    have = with_triple_identity(triples).select("triple_identity").distinct().withColumn("have", F.lit(True))
    p = with_triple_identity(patch)
    both = p.groupBy("triple_identity").agg((F.count_distinct("op") > 1).alias("both"))
    return p.join(have, "triple_identity", "left").join(both, "triple_identity").withColumn(
        "error",
        F.when(F.col("both"), "added and deleted").when((F.col("op") == "add") & F.col("have").isNotNull(), "add present")
        .when((F.col("op") == "del") & F.col("have").isNull(), "delete absent"),
    )


def apply_patch(triples: DataFrame, patch: DataFrame) -> DataFrame:
    """New records (s, condensed, embedded, n) of patched subjects; a subject with any bad row is left out."""
    checked = check_patch(triples, patch)
    bad = checked.where("error is not null").select("s").distinct()
    good = checked.join(bad, "s", "left_anti")
    touched = good.select("s").distinct()
    old = with_triple_identity(triples.join(touched, "s", "left_semi"))
    kept = old.join(good.where("op = 'del'").select("triple_identity"), "triple_identity", "left_anti").select(*KEY)
    return named_records(kept.unionByName(good.where("op = 'add'").select(*KEY)))


def history_chain(history: DataFrame, starts: DataFrame) -> DataFrame:
    """Records before each start, newest first by way of ``previous``."""
    from .closure import transitive_closure

    edges = history.where("previous is not null").select(F.col("record").alias("s"), F.lit("previous").alias("p"), F.col("previous").alias("o"))
    return transitive_closure(edges, starts)


def make_spec(specs: DataFrame) -> DataFrame:
    """(uri, title, subjects) -> triples: type, title, one include-subject each."""
    from ..sources.triplify import rule, union

    return union(
        rule(specs, F.col("uri"), "rdf:type", o=F.lit("owl:Ontology")), rule(specs, F.col("uri"), "dc:title", o_lit=F.col("title")),
        rule(specs.select("uri", F.explode("subjects").alias("x")), F.col("uri"), "ex:include-subject", o=F.col("x")),
    )


def ontology_from_spec(spec: DataFrame, triples: DataFrame) -> DataFrame:
    """Rows of all included subjects, and the title under the spec's uri without ``/spec``."""
    subjects = spec.where("p = 'ex:include-subject'").select(F.col("o").alias("s")).distinct()
    title = spec.where("p = 'dc:title'").withColumn("s", F.regexp_replace("s", "/spec$", ""))
    return triples.join(subjects, "s", "left_semi").select(*KEY).unionByName(title.select(*KEY))
