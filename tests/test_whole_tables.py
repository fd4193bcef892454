"""Queries take every row and all of its text: comparison with brute force on small tables."""

import gzip
import hashlib
import random
import re
from datetime import datetime

from pyspark.sql import functions as F

import __spark_entry__ as entry
from factloom.plans import more
from factloom.sources import ntriples


def write(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_iri_repair_takes_whole_texts_of_all_rows(spark, tmp_path):
    texts = ["a; b", "a \n\t b", "x" * 300 + " ;[y]", "plain", "tab\there", None, ""]
    d = write(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    fixed = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", "%20", t).replace("[", "%5B").replace("]", "%5D").replace(";", "%3B")
    got = {r.doc_id: r.fixed for r in entry.queries()["f10_iri_repair"](spark, d).collect()}
    assert got == {k: None if t is None else fixed(t) for k, t in enumerate(texts)}


TABLES = {
    "region": ([(1, "CHINA")], "r_regionkey long, r_name string"), "nation": ([(1, "UNITED KINGDOM", 1)], "n_nationkey long, n_name string, n_regionkey long"),
    "customer": ([(k, f"Customer {k}", 1, "AUTO") for k in range(1, 121)], "c_custkey long, c_name string, c_nationkey long, c_mktsegment string"),
    "supplier": ([(k, f"Supplier#{k:09}", 1) for k in range(1, 41)], "s_suppkey long, s_name string, s_nationkey long"),
    "part": ([(k, f"name {k % 7}", "B", k, "TYPE") for k in range(1, 101)], "p_partkey long, p_name string, p_brand string, p_size long, p_type string"),
}


def test_full_text_finds_phrases_anywhere(spark, tmp_path):
    texts = ["x " * 30 + "united  kingdom", "first line\nsecond: made in China", "united\nkingdom", "united states, kingdom", "chinaware", None]
    d = write(spark, tmp_path, **TABLES, documents=([(k, t, "en", "a") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    got = {(r.query, r.s.removeprefix("http://ex.org/")): round(r.score, 6) for r in entry.queries()["p13_full_text"](spark, d).collect()}
    assert got == {
        ("united kingdom", "nation/1"): 4, ("united kingdom", "document/0"): 1.5, ("united kingdom", "document/2"): 1,
        ("china", "region/1"): 4, ("china", "document/1"): 1, ("Supplier#000000001", "supplier/1"): 4,
    }


def test_no_subject_is_left_out(spark, tmp_path):
    rng = random.Random(4)
    orders = [(k, rng.randrange(1, 121), datetime(2020, 1, 1 + rng.randrange(28))) for k in range(1, 301)]
    d = write(spark, tmp_path, **TABLES, orders=(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp"))
    run = lambda name: [tuple(r) for r in entry.queries()[name](spark, d).collect()]
    assert sorted(run("g7_subject_subgraphs")) == sorted((f"http://ex.org/customer/{k}", 1, 2) for k in range(1, 121))
    assert sorted(run("g11_superclass_ladder")) == sorted((str(k), str(k // 2)) for k in range(2, 101))
    of_supplier = lambda k: [(f"http://ex.org/supplier/{k}", "rdfs:label", f"Supplier#{k:09}"), (f"http://ex.org/supplier/{k}", "rdfs:subClassOf", None), (None, "rdf:type", "owl:Restriction"), (None, "owl:onProperty", "ex:partOf"), (None, "owl:someValuesFrom", "http://ex.org/nation/1")]
    assert sorted(run("j11_graph_from_subjects"), key=str) == sorted((r for k in range(1, 41) for r in of_supplier(k)), key=str)
    assert sorted(run("p2_definitions")) == [(f"http://uri.ex.org/base/tx_{k:07}", "TYPE") for k in range(1, 101) if k % 4]
    assert sorted(run("p8_entity_conflicts")) == sorted((k, f"http://ex.org/part/{k % 7 or 7}", 1) for k in range(1, 101))
    chains = {}
    for k, c, at in sorted(orders, key=lambda o: (o[2], o[0])):
        chains.setdefault(c, []).append(k)
    pairs = [(str(b), str(a)) for x in chains.values() for a, b in zip(x, x[1 : x.index(max(x)) + 1])]
    assert sorted(run("v7_history_chain")) == sorted(pairs)


def test_reingest_check_takes_the_whole_graph(spark, tmp_path, monkeypatch):
    from factloom.operators import rebuild
    from factloom.sources import triplify

    d, seen, check = write(spark, tmp_path, **TABLES), [], rebuild.reingest_check
    monkeypatch.setattr(rebuild, "reingest_check", lambda g: seen.append(g.count()) or check(g))
    assert entry.queries()["s19_reingest_check"](spark, d).first().equal
    assert seen == [triplify.with_blanks(spark, d).count()] == [5 * 40 + 4 * 120]


def test_checksums_of_large_files(spark, tmp_path):
    """A file over the reader's bound for one row (2 GB, here 33 MB) is digested as well."""
    rng = random.Random(5)
    for t in more.TABLES:
        (tmp_path / f"{t}.parquet").write_bytes(rng.randbytes(40_000_000 if t == "lineitem" else 1_000))
    name = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(name, 33 << 20)
    try:
        got = {r.file: (r.length, r.sha256) for r in entry.queries()["s4_file_checksums"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(name)
    assert got == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir()}


def test_checksums_of_files_that_lines_change(spark, tmp_path):
    files = {
        "ends": b"a\nb\n" * 9_000, "open": b"a\nb\n" * 9_000 + b"c", "empty lines": b"\n" * 25_000, "returns": b"\r\n\r" * 300, "bytes": bytes(range(256)) * 50, "small": b"ab",
        "mark": b"\xef\xbb\xbfab\n" + b"c\n" * 300, "long": b"x\n" + b"y" * 5_000 + b"\nz\n", "no line": b"y" * 5_000, "packed.gz": gzip.compress(random.Random(1).randbytes(3_000)), "plain.gz": b"a\n" * 300,
    }
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    before = {k: spark.conf.get(k) for k in ntriples.whole_files.conf}
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in ntriples.file_checksums(spark, str(tmp_path), whole=100, line=2_000).collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in files.items()}
    assert {k: spark.conf.get(k) for k in before} == before
