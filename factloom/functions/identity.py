"""Content hashes as column expressions: SHA-256 over bytes, parts put together without separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def h(x) -> Column:
    """Digest as 32 bytes."""
    return F.unhex(F.sha2(F.col(x) if isinstance(x, str) else x, 256))


def text(x) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def object_identity(o="o", o_lit="o_lit", datatype="datatype", language="language") -> Column:
    """An iri hashes alone; a literal hashes its value, datatype and language, each hashed first."""
    literal = h(F.concat(h(text(o_lit)), h(text(datatype)), h(text(language))))
    return F.when(F.col(o).isNotNull(), h(o)).otherwise(literal)


def pair_identity(obj: Column, p="p") -> Column:
    return h(F.concat(h(p), obj))


def triple_identity(pair: Column, s="s") -> Column:
    return h(F.concat(h(s), pair))


def joined(digests: Column) -> Column:
    """The digests of an array, sorted bytewise and put together."""
    return F.unhex(F.array_join(F.sort_array(F.transform(digests, F.hex)), ""))


def sequence_identity(digests: Column) -> Column:
    """Identity of a list of identities, duplicates kept, order left out."""
    return h(joined(digests))


def null_identity() -> Column:
    return F.unhex(F.sha2(F.lit(""), 256))


def either(a: Column, b: Column) -> Column:
    """Identity of two halves, of which one may be missing."""
    return h(F.concat(F.coalesce(a, null_identity()), F.coalesce(b, null_identity())))


def low(x) -> Column:
    return F.lower(F.hex(x))
