"""Identities of many releases, walks over them, and integers of blank nodes, on small graphs."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from factloom.operators import closure, identities, releases

SCHEMA = "graph string, s string, p string, o string, o_lit string, datatype string, language string, s_blank string, o_blank string"


def row(g, s=None, p="p", o=None, lit=None, sb=None, ob=None):
    return (g, s, p, o, lit, None, None, sb, ob)


def H(*x):
    return sha256(b"".join(y.encode() if isinstance(y, str) else y for y in x)).digest()


def lit(x):
    return H(H(x), H(""), H(""))


def pair(p, obj):
    return H(H(p), obj)


def seq(*x):
    return H(b"".join(sorted(x)))


def two_releases(spark):
    """Two graphs that differ in a fact below a blank node, and use one blank label for different nodes."""
    rows = [row(g, s=f"u:{g}", p="rdf:type", o="owl:Ontology") for g in "ab"] + [row("a", s="u:a", p="dc:title", lit="first"), row("b", s="u:b", ob="h"), row("b", sb="h", p="by", lit="me")]
    rows += [row(g, s="x", p="n", lit="1") for g in "ab"] + [row(g, s="x", p="q", ob="b1") for g in "ab"] + [row(g, sb="b1", p="r", ob="b2") for g in "ab"] + [row("a", sb="b2", p="v", lit="A"), row("b", sb="b2", p="v", lit="B")]
    rows += [row("a", s="y", p="n", lit="2"), row("a", s="y", p="n", lit="2"), row("a", sb="free", p="v", lit="loose")]
    heads = spark.createDataFrame([("a", "u:a", "2020-01-02"), ("b", "u:b", "2020-01-01")], "graph string, uri string, first_seen string")
    curies = spark.createDataFrame([("a", "ex", "http://ex/")], "graph string, prefix string, namespace string")
    return releases.build(spark.createDataFrame(rows, SCHEMA), heads, curies)


def test_relations_sources_and_versions(spark):
    st = two_releases(spark)
    inner = {g: seq(pair("r", seq(pair("v", lit(g.upper()))))) for g in "ab"}
    blank = {g: H(H("x"), seq(pair("q", inner[g]))) for g in "ab"}
    named = H(H("x"), seq(pair("n", lit("1"))))
    got = {(r.graph, r.s): r for r in st.records.where("part = 'data'").collect()}
    assert {g: bytes(got[g, "x"].combined) for g in "ab"} == {g: H(named, blank[g]) for g in "ab"}
    assert got["a", "y"].blank is None and bytes(got["a", "y"].combined) == H(H(H("y"), seq(pair("n", lit("2")))), H(""))
    asked = spark.createDataFrame([("x",), ("y",), ("nothing",), ("x",)], "s string")
    found = sorted((r.s, r.uri, r.first_seen, r.title, r.type) for r in releases.sources_of(st, asked).collect())
    assert found == [("x", "u:a", "2020-01-02", "first", "owl:Ontology"), ("x", "u:b", "2020-01-01", None, "owl:Ontology"), ("y", "u:a", "2020-01-02", "first", "owl:Ontology")]
    versions = {(r.s, r.place): r for r in releases.versions_of(st, asked).collect()}
    assert {k: ([x.uri for x in v.sources], v.triple_count) for k, v in versions.items()} == {("x", 1): (["u:b"], 4), ("x", 2): (["u:a"], 4), ("y", 1): (["u:a"], 1)}
    assert bytes(versions["x", 1].graph) == H(H(named), seq(blank["b"]))
    # the header is no source of itself, and a header without blank nodes has no blank half
    kinds = {(r.type, r.n) for r in st.identities.collect() if r.type.startswith("bnode")}
    assert ("bnode_embedded", 1) in kinds and all(n > 0 for _, n in kinds)
    walked = releases.identity_walk(st, st.sources.select(F.col("release").alias("start")), types=["record_combined"]).count()
    assert walked == 0  # combined records are reached from no release, only their halves are


def test_records_come_back_from_identities_alone(spark):
    st = two_releases(spark)
    wanted = st.records.where("graph = 'b' and s = 'x'").select(F.col("combined").alias("record"))
    got = sorted((r.s or "", r.p, r.o_lit or "", r.o_subgraph is not None, r.s_subgraph is not None) for r in releases.records_from(st, wanted).collect())
    assert got == [("", "r", "", True, True), ("", "v", "B", False, True), ("x", "n", "1", False, False), ("x", "q", "", True, False)]


def test_headers_have_one_subject(spark):
    heads = spark.createDataFrame([("a", "u:a")], "graph string, uri string")
    two = spark.createDataFrame([row("a", s="u:a", lit="1"), row("a", s="other", lit="1")], SCHEMA)
    with pytest.raises(ValueError, match="2 subjects in the metadata of a"):
        releases.header_identities(two, heads)
    none = releases.header_identities(two.limit(0), heads).collect()
    assert len(none) == 9 and not any(r.kept for r in none) and {r.n for r in none} == {0}


def test_reach_keeps_its_start_and_ends_on_cycles(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(1, 1), (2, 3), (3, 2)]
    starts = [(f"s{k % 5}", k) for k in range(0, 40, 3)] + [("s0", 0)]
    want = set()
    for s, n in starts:
        todo, seen = [n], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b for a, b in edges if a == x]
        want |= {(s, x) for x in seen}
    got = closure.reach(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(starts, "start string, node long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert closure.reach(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([], "start string, node long")).count() == 0


def numbered_rows(spark, rows):
    """Rows with blank nodes as integers, as a multiset for each root's content."""
    t = spark.createDataFrame(rows, SCHEMA).drop("graph")
    local = {(r.root, r.node): r.local for r in identities.nested_integers(t).collect()}
    out = []
    for root in {k for k, _ in local}:
        own = sorted((local[root, r[7]], r[2], r[3] or "", r[4] or "", local[root, r[8]] if r[8] else -1) for r in set(rows) if r[7] and (root, r[7]) in local)
        out.append((sorted(n for (k, _), n in local.items() if k == root), own))
    return sorted(out)


def test_integers_do_not_depend_on_labels(spark):
    rows = [row("g", s="x", ob="a"), row("g", s="y", ob="t")]
    # two equal children of one parent, two children that differ two levels down, one shared child, parents that differ
    rows += [row("g", sb="a", p="c", ob=f"c{k}") for k in range(4)] + [row("g", sb=f"c{k}", p="d", ob=f"d{k}") for k in range(4)] + [row("g", sb=f"d{k}", p="v", lit=str(k // 2)) for k in range(4)]
    rows += [row("g", sb="c0", p="z", ob="shared"), row("g", sb="c3", p="z", ob="shared"), row("g", sb="shared", p="v", lit="s")]
    rows += [row("g", sb="t", p="m", ob="u1"), row("g", sb="t", p="m", ob="u2"), row("g", sb="u1", p="k", lit="1"), row("g", sb="u2", p="k", lit="2"), row("g", sb="u1", p="w", ob="w1"), row("g", sb="u2", p="w", ob="w2"), row("g", sb="w1", p="e", lit=""), row("g", sb="w2", p="e", lit="")]
    want = numbered_rows(spark, rows)
    assert [x[0] for x in want] == [list(range(5)), list(range(10))] or [x[0] for x in want] == [list(range(10)), list(range(5))]
    labels = sorted({x for r in rows for x in r[7:] if x})
    for seed in range(2):
        new = labels[:]
        random.Random(seed).shuffle(new)
        to = dict(zip(labels, new))
        assert numbered_rows(spark, [(*r[:7], to.get(r[7]), to.get(r[8])) for r in rows]) == want
    # w1 and w2 are alike below: their parents, which differ, tell them apart
    tail = next(own for n, own in want if len(n) == 5)
    first = {v: s for s, p, _, v, _ in tail if p == "k"}
    assert [o for s, p, _, _, o in tail if p == "w" and s == first["1"]] < [o for s, p, _, _, o in tail if p == "w" and s == first["2"]]
