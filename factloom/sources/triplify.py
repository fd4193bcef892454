"""Relational tables as triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EX = "http://ex.org/"
TYPE, LABEL, SUB, PART_OF = "rdf:type", "rdfs:label", "rdfs:subClassOf", "ex:partOf"
COLUMNS = ("s", "p", "o", "o_lit", "datatype", "language")


def iri(kind: str, key) -> Column:
    return F.concat(F.lit(f"{EX}{kind}/"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def rule(df: DataFrame, s, p, o=None, o_lit=None, datatype=None, language=None) -> DataFrame:
    """One triple for each row; ``p`` and ``datatype`` may be plain strings."""
    as_col = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x.cast("string")
    return df.select(*[as_col(x).alias(n) for n, x in zip(COLUMNS, (s, p, o, o_lit, datatype, language), strict=True)])


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def triplify_testdata(spark: SparkSession, sf_dir: str, tables=("region", "nation", "customer", "supplier", "part", "documents"), texts: bool = False) -> DataFrame:
    """Types, labels, literals and the partOf chain of the given tables.

    With ``texts`` a document's title is its whole first line and its whole text is a literal, ``ex:text``.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = []
    for table, key, label, above in (
        ("region", "r_regionkey", "r_name", None), ("nation", "n_nationkey", "n_name", ("region", "n_regionkey")),
        ("customer", "c_custkey", "c_name", ("nation", "c_nationkey")), ("supplier", "s_suppkey", "s_name", ("nation", "s_nationkey")),
        ("part", "p_partkey", "p_name", None), ("orders", "o_orderkey", None, ("customer", "o_custkey")),
    ):
        if table not in tables:
            continue
        df, s = read(table), iri(table, key)
        out.append(rule(df, s, TYPE, o=F.lit(EX + table.capitalize())))
        if label:
            out.append(rule(df, s, LABEL, o_lit=F.col(label)))
        if above:
            out.append(rule(df, s, PART_OF, o=iri(*above)))
    if "customer" in tables:
        out.append(rule(read("customer"), iri("customer", "c_custkey"), "ex:segment", o_lit=F.col("c_mktsegment")))
    if "part" in tables:
        part = read("part")
        out.append(rule(part, iri("part", "p_partkey"), "ex:brand", o_lit=F.col("p_brand")))
        out.append(rule(part, iri("part", "p_partkey"), "ex:size", o_lit=F.col("p_size"), datatype="xsd:integer"))
    if "documents" in tables:
        docs = read("documents")
        out.append(rule(docs, iri("document", "doc_id"), TYPE, o=F.lit(EX + "Document")))
        first = F.split("text", "\n")[0]
        out.append(rule(docs, iri("document", "doc_id"), "ex:title", o_lit=first if texts else F.substring(first, 1, 40), language=F.col("lang")))
        if texts:
            out.append(rule(docs, iri("document", "doc_id"), "ex:text", o_lit=F.col("text"), language=F.col("lang")))
        out.append(rule(docs, iri("document", "doc_id"), "ex:source", o=iri("source", "source")))
    return union(*out)


def with_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples with blank nodes: a class restriction for each supplier, a two-step address for each customer.

    Columns are those of triples plus ``s_blank`` and ``o_blank`` (node labels within the graph).
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    sup, cust = read("supplier"), read("customer")
    b = F.concat(F.lit("r"), F.col("s_suppkey"))
    a, c = F.concat(F.lit("a"), F.col("c_custkey")), F.concat(F.lit("c"), F.col("c_custkey"))
    none = F.lit(None).cast("string")

    def blank(df, s, sb, p, o, ob, lit=None):
        return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), (none if lit is None else lit).alias("o_lit"), none.alias("datatype"), none.alias("language"), sb.alias("s_blank"), ob.alias("o_blank"))

    return union(
        blank(sup, iri("supplier", "s_suppkey"), none, SUB, none, b),
        blank(sup, none, b, TYPE, F.lit("owl:Restriction"), none),
        blank(sup, none, b, "owl:onProperty", F.lit(PART_OF), none),
        blank(sup, none, b, "owl:someValuesFrom", iri("nation", "s_nationkey"), none),
        blank(sup, iri("supplier", "s_suppkey"), none, LABEL, none, none, F.col("s_name")),
        blank(cust, iri("customer", "c_custkey"), none, "ex:address", none, a),
        blank(cust, none, a, "ex:segment", none, none, F.col("c_mktsegment")),
        blank(cust, none, a, "ex:place", none, c),
        blank(cust, none, c, PART_OF, iri("nation", "c_nationkey"), none),
    )


#: Source types as classes, and synonym types as predicates: fixed values.
TYPES = {"term": "owl:Class", "TermSet": "ex:TermSet", "cde": "owl:Class", "fde": "owl:Class", "pde": "owl:Class", "annotation": "owl:AnnotationProperty", "relationship": "owl:ObjectProperty"}
SYNONYMS = {
    "abbrev": "ex:synonyms/abbreviation",
    "oboInOwl:hasBroadSynonym": "ex:synonyms/broad",
    "oboInOwl:hasExactSynonym": "ex:synonyms/exact",
    "oboInOwl:hasNarrowSynonym": "ex:synonyms/narrow",
    "oboInOwl:hasRelatedSynonym": "ex:synonyms/related",
    "fma:synonym": "fma:synonym",
    "NIFRID:synonym": "NIFRID:synonym",
    "vocab:synonym": "NIFRID:synonym",
    "NIFRID:abbrev": "NIFRID:abbrev",
}


def mapped(values: dict, x: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in values.items() for v in kv])[x]


def synonym_predicate(kind: Column) -> Column:
    """Predicate of a synonym's type; an empty or unknown type is a plain synonym."""
    return F.coalesce(mapped(SYNONYMS, kind), F.lit("ex:synonym"))


def term_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A term database laid over ``part``: names of tables as the triplifier reads them."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    kind = mapped({0: "annotation", 1: "relationship", 2: "cde", 3: "TermSet", 4: "fde", 5: "pde", 6: "term", 7: "term", 8: "term", 9: "term"}, (k % 10).cast("int"))
    tx = F.concat(F.lit("tx_"), F.lpad(k.cast("string"), 7, "0"))
    ext = F.concat(F.lit("http://purl.ex.net/obo/X_"), (k % 500).cast("string"))
    return {
        "terms": part.select(
            k.alias("id"), tx.alias("tx"), F.concat("p_name", F.when(k % 3 == 0, " ").otherwise("")).alias("label"), F.when(k % 4 != 0, F.col("p_type")).alias("definition"),
            kind.alias("type"), F.when(k % 50 == 7, "-2").when(k % 50 == 8, "-1").otherwise("0").alias("status"), (k % 7).alias("orig_cid"),
        ),
        "existing": part.select(k.alias("tid"), F.concat(F.lit("http://uri.ex.org/base/"), tx).alias("iri"), F.concat(F.lit("TX:"), k.cast("string")).alias("curie"), F.lit("0").alias("preferred"))
        .unionByName(part.where(k % 3 == 0).select(k.alias("tid"), ext.alias("iri"), F.concat(F.lit("X:"), (k % 500).cast("string")).alias("curie"), F.lit("1").alias("preferred"))),
        "synonyms": part.where(k % 2 == 0).select(k.alias("tid"), F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string")).alias("literal"), F.element_at(F.array(*[F.lit(x) for x in ("", *SYNONYMS)]), (F.floor(k / 2) % 10 + 1).cast("int")).alias("type")),
        "superclasses": part.where(k > 1).select(k.alias("tid"), F.floor(k / 2).alias("superclass_tid")),
        "relationships": part.where(k > 10).select(k.alias("term1_id"), (F.floor(k / 3) + 1).alias("term2_id"), F.lit(1).cast("long").alias("relationship_tid"), F.when(k % 5 == 0, "1").otherwise("0").alias("withdrawn")),
        "annotations": part.where(k > 10).select(k.alias("tid"), F.lit(10).cast("long").alias("annotation_tid"), F.when(k % 2 == 0, F.concat(F.lit("FMAID: "), k.cast("string"))).otherwise(F.col("p_type")).alias("value"), F.when(k % 9 == 0, "1").otherwise("0").alias("withdrawn")),
    }


BASE = "http://uri.ex.org/base/"


def triplify_terms(ts: dict[str, DataFrame], include_cdes: bool = False) -> DataFrame:
    """Term tables as triples: one select per rule, term ids resolved by joins on the term table."""
    from ..functions.iris import annotation_object, trimmed

    terms = ts["terms"] if include_cdes else ts["terms"].where("type <> 'cde'")
    terms = terms.withColumn("s", F.concat(F.lit(BASE), "tx"))
    ref = lambda name: terms.select(F.col("id").alias(f"{name}_id"), F.col("s").alias(f"{name}_iri"))
    own = lambda df, col: df.join(terms.select(F.col("id").alias(col), "s", "type" if "type" not in df.columns else F.col("type").alias("term_type")), col)
    s = F.col("s")
    syn = own(ts["synonyms"].where("literal <> ''"), "tid")
    rel = ts["relationships"].where("withdrawn <> '1'").join(ref("term1"), "term1_id").join(ref("term2"), "term2_id")
    rel = rel.join(ref("relationship").withColumnRenamed("relationship_id", "relationship_tid"), "relationship_tid")
    ann = own(ts["annotations"].where("withdrawn <> '1'"), "tid").join(ref("annotation").withColumnRenamed("annotation_id", "annotation_tid"), "annotation_tid")
    sup = own(ts["superclasses"], "tid").join(ref("superclass").withColumnRenamed("superclass_id", "superclass_tid"), "superclass_tid")
    a_iri, a_lit = annotation_object(F.col("value"))
    is_property = F.col("type").isin("annotation", "relationship")
    ext = own(ts["existing"], "tid")
    return union(
        rule(terms, s, TYPE, o=mapped(TYPES, F.col("type"))),
        rule(terms.where(trimmed(F.col("label")).isNotNull()), s, LABEL, o_lit=trimmed(F.col("label"))),
        rule(terms.where("definition <> ''"), s, "ex:definition", o_lit=F.col("definition")),
        rule(terms.where("status = '-2'"), s, "owl:deprecated", o_lit=F.lit("true"), datatype="xsd:boolean"),
        rule(syn, s, synonym_predicate(F.col("type")), o_lit=F.col("literal")),
        rule(rel, F.col("term1_iri"), F.col("relationship_iri"), o=F.col("term2_iri")),
        rule(ann, s, F.col("annotation_iri"), o=a_iri, o_lit=a_lit),
        rule(sup, s, F.when(is_property, "rdfs:subPropertyOf").otherwise(SUB), o=F.col("superclass_iri")),
        rule(ext.where(~F.col("iri").startswith(BASE)), s, "ex:hasExternalId", o=F.col("iri")),
    )


def term_records(ts: dict[str, DataFrame]) -> DataFrame:
    """Record triples of each term: type, source type, label, definition, own id, and its existing ids."""
    terms = ts["terms"].withColumn("s", F.concat(F.lit(BASE), "tx"))
    s = F.col("s")
    ext = ts["existing"].join(terms.select(F.col("id").alias("tid"), "s"), "tid")
    iri_ = F.col("iri")
    return union(
        rule(terms, s, TYPE, o=mapped(TYPES, F.col("type"))), rule(terms, s, "ex:sourceType", o_lit=F.col("type")),
        rule(terms, s, LABEL, o_lit=F.col("label")), rule(terms.where("definition is not null"), s, "ex:definition", o_lit=F.col("definition")),
        rule(terms, s, "ex:hasTermId", o=s), rule(ext, s, "ex:hasExistingId", o=iri_),
        rule(ext.where(~iri_.startswith(BASE)), s, "ex:hasExternalId", o=iri_), rule(ext.where("preferred = '1'"), s, "ex:hasPreferredId", o=iri_),
    )
