"""Expressions over iris, curies and term ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1), F.lit(""))


def scheme(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), F.lit(""))


def path(x: Column) -> Column:
    return F.regexp_extract(x, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_parts(x: Column) -> Column:
    return F.filter(F.split(path(x), "/"), lambda p: p != "")


def fragment(x: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(x, "/", -1)


def term_prefix(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, "/([a-z]+)_([0-9]+)$", 1), F.lit(""))


def term_number(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, "/([a-z]+)_([0-9]+)$", 2), F.lit(""))


def natural_key(x: Column) -> Column:
    """Sort key in which runs of digits compare as numbers; zeros in front stay as a tie-break."""
    parts = F.regexp_extract_all(x, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def rewrite_group(x: Column, old: str, new: str) -> Column:
    """First ``/old/`` of an iri becomes ``/new/``."""
    at = F.instr(x, f"/{old}/")
    return F.when(at == 0, x).otherwise(
        F.concat(F.substr(x, F.lit(1), at), F.lit(new), F.substr(x, at + 1 + len(old), F.length(x)))
    )


def json_text(x: Column) -> Column:
    """A string in JSON quotes."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), x, F.lit('"'))


def trimmed(x: Column) -> Column:
    """Edge white space off; what is then empty is null."""
    return F.nullif(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit(""))


def edge_white(x: Column) -> Column:
    return x.rlike(r"^\s|\s$")


#: Fixed repairs of iris, in order: pattern and replacement.
REPAIRS = [(r"\s+", "%20"), (r"\[", "%5B"), (r"\]", "%5D"), (";", "%3B")]


def repaired(x: Column, plain_hosts: tuple[str, ...] = ()) -> Column:
    """Characters that iris can't hold are quoted; hosts that only answer to http lose the s."""
    for a, b in REPAIRS:
        x = F.regexp_replace(x, a, b)
    for name in plain_hosts:
        x = F.when(x.startswith(f"https://{name}/"), F.concat(F.lit("http"), F.substr(x, F.lit(6), F.length(x)))).otherwise(x)
    return x


#: A code browser's old and new address, and ids in which blanks have a known meaning.
OLD_CODES = "https://ncimeta.nci.nih.gov/ncimbrowser/ConceptReport.jsp?dictionary=NCI%20Metathesaurus&code="
NEW_CODES = "https://evsexplore.semantics.cancer.gov/evsexplore/concept/ncim/"
BLANK_AS_LINE, BLANK_AS_NOTHING = "TOPNT", "SNOMEDCT"


def existing_repaired(x: Column, http_host: str) -> Column:
    """An existing iri mended, or null where its blanks have no known meaning.

    Blanks become underscores, or are quoted beside brackets, or go, as the iri's kind says.  Then a semicolon at the end goes; else the
    named host loses its s and the id its prefix; else old addresses of codes become new ones.
    """
    rep = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    quoted = rep(rep(rep(x, " ", "%20"), "[", "%5B"), "]", "%5D")
    line = rep(rep(x, " ", "_"), "__", "_")
    y = F.when(~x.contains(" "), x).when(x.contains(BLANK_AS_LINE), F.when(x.contains("["), quoted).otherwise(line)).when(x.contains(BLANK_AS_NOTHING), rep(x, " ", ""))
    plain = rep(F.concat(F.lit("http"), F.substr(y, F.lit(6))), "RRID:", "")
    return F.when(y.endswith(";"), F.left(y, F.length(y) - 1)).when(y.startswith(f"https://{http_host}"), plain).otherwise(rep(y, OLD_CODES, NEW_CODES))


#: Fixed prefixes that annotation values carry in front of an id: pattern and namespace.
ANNOTATION_PREFIXES = [("^FMAID: ?", "http://purl.org/sig/ont/fma/fma"), ("^NCBITaxon: ?", "http://purl.obolibrary.org/obo/NCBITaxon_"), ("^PATO ", "http://purl.obolibrary.org/obo/PATO_")]


def annotation_object(x: Column) -> tuple[Column, Column]:
    """(iri, literal) of an annotation value; exactly one is set."""
    fixed = x
    for a, b in ANNOTATION_PREFIXES:
        fixed = F.regexp_replace(fixed, a, b)
    is_iri = fixed.rlike(r"^https?://\S+$")
    return F.when(is_iri, fixed), F.when(~is_iri, x)


def expand_curies(df: DataFrame, col: str, curies: DataFrame) -> DataFrame:
    """Adds ``iri`` and ``status`` (ok, prefix only, unknown prefix, not a curie)."""
    parts = df.withColumn("_prefix", F.when(F.col(col).contains(":"), F.substring_index(F.col(col), ":", 1)))
    out = parts.join(curies.select(F.col("prefix").alias("_p"), "namespace"), F.col("_prefix") == F.col("_p"), "left")
    rest = F.expr(f"substr({col}, length(_prefix) + 2)")
    return out.select(
        *df.columns,
        F.when(rest != "", F.concat("namespace", rest)).alias("iri"),
        F.when(F.col("_prefix").isNull(), "not a curie").when(F.col("namespace").isNull(), "unknown prefix")
        .when(rest == "", "prefix only").otherwise("ok").alias("status"),
    )


def shrink_iris(df: DataFrame, col: str, curies: DataFrame) -> DataFrame:
    """Adds ``curie`` by the longest namespace that an iri begins with.

    Namespaces end in ``/``, ``#`` or ``_`` there, so the iri's own cuts at those marks are looked up by equality.
    """
    cuts = F.expr(f"transform(filter(sequence(1, length({col})), i -> substr({col}, i, 1) in ('/', '#', '_')), i -> substr({col}, 1, i))")
    keys = df.select(col).where(F.length(col) > 0).distinct().withColumn("_ns", F.explode(cuts))
    best = keys.join(curies.select(F.col("namespace").alias("_ns"), "prefix"), "_ns").groupBy(col).agg(
        F.max_by(F.struct("prefix", "_ns"), F.struct(F.length("_ns"), "prefix")).alias("m")
    )
    return df.join(best, col, "left").withColumn(
        "curie", F.concat(F.col("m.prefix"), F.lit(":"), F.expr(f"substr({col}, length(m._ns) + 1)"))
    ).drop("m")
