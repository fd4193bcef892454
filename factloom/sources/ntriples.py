"""N-Triples in and out, file manifests, counts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.iris import json_text

#: Iris and labels hold no control characters, which also mark the groups below.
_IRI, _BLANK = r"<([^>\x00-\x1F]*)>", r"_:([^\s\x00-\x1F]+)"
LINE = rf'^\s*(?:{_IRI}|{_BLANK})\s+{_IRI}\s+(?:{_IRI}|{_BLANK}|"((?:[^"\\]|\\.)*)"(?:\^\^{_IRI}|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'


def unescaped(x: Column) -> Column:
    """String escapes undone, one pass over what doubled backslashes leave apart."""

    def piece(p: Column) -> Column:
        for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\b", "\b"), ("\\f", "\f"), ("\\'", "'")):
            p = F.replace(p, F.lit(a), F.lit(b))
        # code points: cut before each escape, the first digits of a cut are the number
        cut = F.split(p, r"\\(?=u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})", -1)
        one = lambda c, i: F.when((i == 0) | ~c.rlike("^[uU]"), c).otherwise(
            F.concat(
                F.decode(
                    F.unhex(F.when(c.startswith("u"), F.concat(F.lit("0000"), F.substr(c, F.lit(2), F.lit(4)))).otherwise(F.substr(c, F.lit(2), F.lit(8)))),
                    "UTF-32",
                ),
                F.when(c.startswith("u"), F.substr(c, F.lit(6), F.length(c))).otherwise(F.substr(c, F.lit(10), F.length(c))),
            )
        )
        return F.array_join(F.transform(cut, one), "")

    return F.array_join(F.transform(F.split(x, r"\\\\", -1), piece), "\\")


def parse_lines(lines: DataFrame, strict: bool = True, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Triples of N-Triples lines.  Empty lines and comments give none; a bad line raises, or goes if not ``strict``."""
    v = F.col(value)
    rows = lines.where(~v.rlike(r"^\s*(#.*)?$"))
    # the pattern runs once a line: its groups between marks, the literal last, as it may hold the mark; a bad line stays as it is
    groups = F.split(F.regexp_replace(v, LINE, "\x02\x01$1\x01$2\x01$3\x01$4\x01$5\x01$7\x01$8\x01$6"), "\x01", 9)
    rows = rows.withColumn("_g", groups)
    part = lambda k: F.nullif(F.get("_g", F.lit(k if k < 6 else k - 1)), F.lit(""))
    lit = F.when(part(4).isNull() & part(5).isNull(), unescaped(F.get("_g", F.lit(8))))
    good = (F.get("_g", F.lit(0)) == "\x02") & ~v.startswith("\x02")
    if strict:
        rows = rows.where(F.coalesce(F.assert_true(good, F.concat(F.lit("not a triple: "), v)).cast("boolean"), F.lit(True)))
    else:
        rows = rows.where(good)
    return rows.select(
        unescaped(part(1)).alias("s"), part(2).alias("s_blank"), unescaped(part(3)).alias("p"), unescaped(part(4)).alias("o"),
        part(5).alias("o_blank"), lit.alias("o_lit"), part(7).alias("datatype"), part(8).alias("language"), *keep,
    )


def read_ntriples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Triples of all files under a path, with the file each came from as ``graph``."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("graph"))
    return parse_lines(lines, strict, keep=("graph",))


def nt_line(hex_len: int = 19) -> Column:
    """A row of any kind as an N-Triples line; blank labels begin with the subgraph's digest if there is one."""
    tag = F.coalesce(F.substring(F.lower(F.hex("subgraph_identity")), 1, hex_len), F.lit("b"))
    node = lambda iri, blank: F.when(F.col(iri).isNotNull(), F.concat(F.lit("<"), F.col(iri), F.lit(">"))).otherwise(
        F.concat(F.lit("_:"), tag, F.lit("x"), F.col(blank).cast("string"))
    )
    lit = F.concat(
        json_text(F.col("o_lit")),
        F.when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">")))
        .when(F.col("language").isNotNull(), F.concat(F.lit("@"), F.col("language"))).otherwise(""),
    )
    obj = F.when(F.col("o_lit").isNotNull(), lit).otherwise(node("o", "o_blank"))
    return F.concat(node("s", "s_blank"), F.lit(" <"), F.col("p"), F.lit("> "), obj, F.lit(" ."))


def with_kind_columns(triples: DataFrame) -> DataFrame:
    """Missing blank columns added as nulls, so that named triples go through the same code."""
    for c, t in (("s_blank", "string"), ("o_blank", "string"), ("subgraph_identity", "binary")):
        if c not in triples.columns:
            triples = triples.withColumn(c, F.lit(None).cast(t))
    return triples


def dump_ntriples(triples: DataFrame, hex_len: int = 19) -> DataFrame:
    return with_kind_columns(triples).select(nt_line(hex_len).alias("line"))


def without_ontology_subjects(triples: DataFrame) -> DataFrame:
    """Rows whose subject isn't an ontology header; rows with blank subjects stay."""
    headers = triples.where(F.col("o").endswith("owl#Ontology")).select("s").where("s is not null").distinct()
    return triples.join(headers, "s", "left_anti")


def split_triples(triples: DataFrame) -> DataFrame:
    """Adds ``kind``: name, conn, link or term by where blank nodes stand."""
    s, o = F.col("s_blank").isNotNull(), F.col("o_blank").isNotNull()
    return triples.withColumn("kind", F.when(~s & ~o, "name").when(~s & o, "conn").when(s & o, "link").otherwise("term"))


def subset_counts(triples: DataFrame) -> DataFrame:
    """Triples of each kind; their sum is the whole."""
    return split_triples(with_kind_columns(triples)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def dedupe(triples: DataFrame, strict: bool = False) -> DataFrame:
    """Distinct triples; ``strict`` fails if there were repeats."""
    if strict and triples.count() != triples.distinct().count():
        raise ValueError("the triples hold repeats")
    return triples.distinct()


class whole_files:  # noqa: N801  used as `with whole_files(spark):` around a job
    """Each file is read by one task from its beginning to its end, and little at a time reaches Python, in jobs that run inside; then as it was."""

    conf = {"spark.sql.files.maxPartitionBytes": 1 << 50, "spark.sql.files.openCostInBytes": 1 << 50, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in self.conf}
        for k, v in self.conf.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def _digests_of_lines(batches):
    """(file, sha256) of files whose ``line``s, each with a newline, come one after the other; null if that isn't all of the file's ``size``."""
    file, size, seen, digest, held = None, 0, 0, None, b""

    def done():  # the newline of the last line is held back until the size tells whether the file has it
        if seen == size:
            digest.update(held)
        return pa.RecordBatch.from_pydict({"file": [file], "sha256": [digest.hexdigest() if seen in (size, size + 1) else None]}, schema=pa.schema([("file", pa.string()), ("sha256", pa.string())]))

    for b in batches:
        runs = pc.run_end_encode(b.column("file"))
        begin = 0
        for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            if name != file:
                if digest:
                    yield done()
                file, size, seen, digest, held = name, b.column("size")[begin].as_py(), 0, hashlib.sha256(), b""
            lines = b.column("line")
            _, ends, data = lines.buffers()
            ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(lines.type) else np.int32)
            text = memoryview(data)[ends[lines.offset + begin] : ends[lines.offset + end]]
            digest.update(held)
            digest.update(text[:-1])
            seen, held, begin = seen + len(text), bytes(text[-1:]), end
    if digest:
        yield done()


def file_checksums(spark: SparkSession, path: str | list[str], whole: int = 32 << 20, line: int = 16 << 20) -> DataFrame:
    """(path, length, sha256) of every file under a path or several.

    Files over ``whole`` bytes don't go into one row: a task reads each as lines and hashes them one by one.  A file that can't be had back
    from its lines (a run of ``line`` bytes without a newline, a byte order mark, a name that Spark would unpack) is streamed through the
    driver's JVM; that a file is had back is told by its size.
    """
    from ..functions.shared import cut

    deep = {"recursiveFileLookup": True}  # no column is made of a folder's name
    files = spark.read.format("binaryFile").options(**deep).load(path)
    small = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", "length", F.col("_metadata.file_path").alias("file")).collect()  # names of few files
    if not large:
        return small
    size = F.col("_metadata.file_size")
    # a line that is too long, or a file that can't be read on, leaves too few bytes
    text = spark.read.options(**deep, ignoreCorruptFiles=True).option("mapreduce.input.linerecordreader.line.maxlength", line).text(path, lineSep="\n")
    lines = text.where(size > whole).select(F.col("_metadata.file_path").alias("file"), size.alias("size"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"))
    with whole_files(spark):
        digests = cut(lines.mapInArrow(_digests_of_lines, "file string, sha256 string"))
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    unpacked = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(hadoop)
    known = {r.file: r.sha256 for r in digests.collect()}
    rows = []
    for r in large:
        at = jvm.org.apache.hadoop.fs.Path(r.path)
        sha = None if unpacked.getCodec(at) else known.get(r.file)
        if not sha:
            stream = at.getFileSystem(hadoop).open(at)
            try:
                sha = jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
            finally:
                stream.close()
        rows.append((r.path, r.length, sha))
    return small.unionByName(spark.createDataFrame(rows, small.schema))


def skip_already_loaded(manifest: DataFrame, relations: DataFrame, key: str = "identity") -> DataFrame:
    """Manifest rows whose bytes were not parsed before."""
    done = relations.where("p = 'parsedTo'").select(F.col("s").alias(key))
    return manifest.join(done, key, "left_anti")


def append_new(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't stored, one for each key."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def labelled_rows(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """(s, p, o) of every row as RDF terms: iris in angle brackets, literals escaped with their type or language, blank nodes by content.

    ``nodes``: (node, identity, replica); without a replica copies of one subgraph point to number 0.  The identity is hex, so labels don't
    depend on the order of rows.  Columns that ``triples`` lacks count as null.
    """
    copy = F.col("replica").cast("string") if "replica" in nodes.columns else F.lit("0")
    label = nodes.select("node", F.concat(F.lit("_:sg_"), "identity", F.lit("_"), copy).alias("label"))
    out = triples.join(label.toDF("s_blank", "s_label"), "s_blank", "left").join(label.toDF("o_blank", "o_label"), "o_blank", "left")
    have = lambda c: F.col(c) if c in triples.columns else F.lit(None).cast("string")
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    literal = F.concat(json_text(F.col("o_lit")), F.when(have("datatype").isNotNull(), F.concat(F.lit("^^"), iri(have("datatype")))).when(have("language").isNotNull(), F.concat(F.lit("@"), have("language"))).otherwise(""))
    return out.select(F.coalesce(iri(F.col("s")), "s_label").alias("s"), iri(F.col("p")).alias("p"), F.coalesce(iri(F.col("o")), "o_label", literal).alias("o")).distinct()
