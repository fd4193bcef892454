"""Identities, closures, versions, reviews and validators on small fixtures; digests by hashlib."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import iris
from factloom.operators import closure, identities, lookup, quality, rebuild, review, versions
from factloom.sources import ntriples

T = "s string, s_blank string, p string, o string, o_lit string, o_blank string, datatype string, language string"


def H(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).digest()


def row(s, p, o=None, lit=None, dt=None, lang=None):
    blank = lambda x: x[2:] if x and x.startswith("_:") else None
    iri = lambda x: None if x is None or x.startswith("_:") else x
    return (iri(s), blank(s), p, iri(o), lit, blank(o), dt, lang)


def graph(spark, rows):
    return spark.createDataFrame([row(*r) for r in rows], T)


def brute_nodes(rows):
    """Condensed identities of blank nodes by plain recursion."""
    obj = lambda o, lit, dt, lang: H(o) if o else H(H(lit) + H(dt or "") + H(lang or ""))
    by = {}
    for r in {row(*r) for r in rows}:
        if r[1]:
            by.setdefault(r[1], []).append(r)

    def condensed(n):
        if n not in by:
            return H("")
        return H(b"".join(sorted(H(H(r[2]) + (condensed(r[5]) if r[5] else obj(r[3], r[4], r[6], r[7]))) for r in by[n])))

    return {n: condensed(n) for n in by}


ROUND_TRIP = [
    ("onto", "rdf:type", "owl:Ontology"), ("onto", "ex:meta", "_:m"), ("_:m", "ex:next", "_:m2"), ("_:m2", "ex:v", None, "1"),
    ("s0", "p0", "_:shared"), ("s1", "p0", "_:shared"), ("s2", "p9", "_:shared"), ("_:shared", "q", "o"),
    ("s0", "list", "_:l1"), ("_:l1", "first", "a"), ("_:l1", "rest", "_:l2"), ("_:l2", "first", "b"), ("_:l2", "rest", "nil"),
    ("s0", "list", "_:k1"), ("_:k1", "first", "b"), ("_:k1", "rest", "_:k2"), ("_:k2", "first", "a"), ("_:k2", "rest", "nil"),
    ("_:h", "p", "_:hh"), ("_:hh", "q", None, "x", "xsd:string"), ("_:h2", "p", "_:hh2"), ("_:hh2", "q", None, "x", "xsd:string"),
    ("s3", "p1", "_:one"), ("_:one", "z", "w"), ("_:free", "z", "w"), ("s4", "rdfs:label", None, "l", None, "en"), ("s4", "p5", "o5"),
]


def test_triple_and_record_identities(spark):
    g = graph(spark, [("s", "p", "o"), ("s", "q", None, "v", None, "en"), ("s", "q", None, "v", None, "en")])
    pairs = [H(H("p") + H("o")), H(H("q") + H(H("v") + H("") + H("en")))]
    got = {bytes(r.triple_identity) for r in identities.with_triple_identity(g).collect()}
    assert got == {H(H("s") + x) for x in pairs}
    rec = identities.named_records(g).first()
    assert bytes(rec.condensed) == H(b"".join(sorted(pairs))) and rec.n == 2
    assert bytes(rec.embedded) == H(H("s") + bytes(rec.condensed))


@pytest.mark.parametrize("rows", [ROUND_TRIP, [("s0", "p0", "_:a"), ("_:a", "p1", "o0")], [("s0", "p0", "_:a"), ("_:a", "p1", "_:b"), ("_:b", "p2", "o0"), ("s", "p", "o")]])
def test_blank_nodes_equal_recursion_whatever_their_names(spark, rows):
    nodes, embedded = identities.bnode_records(graph(spark, rows))
    assert {r.node: bytes(r.condensed) for r in nodes.collect()} == brute_nodes(rows)
    names = {f"_:{n}": f"_:x{k}" for k, n in enumerate(random.Random(1).sample(sorted(brute_nodes(rows)), len(brute_nodes(rows))))}
    other = [tuple(names.get(x, x) for x in r) for r in reversed(rows)]
    assert identities.graph_identity(graph(spark, rows)) == identities.graph_identity(graph(spark, other))


def test_cycles_and_dangling_nodes(spark):
    with pytest.raises(ValueError, match="cycle"):
        identities.bnode_records(graph(spark, [("_:a", "p", "_:b"), ("_:b", "p", "_:a")]))
    nodes, _ = identities.bnode_records(graph(spark, [("s", "p", "_:gone")]))
    assert bytes(nodes.first().condensed) == H("")


def test_versions_do_not_mix(spark):
    shared = [("s0", "a", "Class"), ("_:r", "a", "Restriction"), ("_:r", "onProperty", "prop0"), ("_:r", "someValuesFrom", "value0")]
    out = []
    for p in ("p0", "p1"):
        g = graph(spark, [*shared, ("s0", p, "_:r")])
        nodes, _ = identities.bnode_records(g)
        conn = identities.conn_identities(g, nodes).first()
        out.append((bytes(conn.subgraph_identity), bytes(conn.triple_identity), conn.p))
    assert out[0][0] == out[1][0] and out[0][1] != out[1][1] and (out[0][2], out[1][2]) == ("p0", "p1")


def test_rebuilt_graph_has_the_same_identity(spark):
    g = graph(spark, ROUND_TRIP)
    tables = rebuild.store(g, "g")
    back = rebuild.rebuild(tables, "g")
    assert back.count() == g.distinct().count()
    assert identities.graph_identity(back) == identities.graph_identity(g)
    meta, rest = rebuild.metadata_subgraph(g, "onto")
    assert meta.count() == 4 and rest.count() == len(ROUND_TRIP) - 4


EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "e"), ("d", "a")]


@pytest.mark.parametrize("depth,expected", [(0, {"ab"}), (1, {"ab", "bc", "be"}), (2, {"ab", "bc", "be", "cd"}), (-1, {"ab", "bc", "be", "cd", "da"})])
def test_closure_depths(spark, depth, expected):
    e = spark.createDataFrame([(s, "p", o) for s, o in EDGES], "s string, p string, o string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.s + r.o for r in closure.transitive_closure(e, start, "subject", depth).collect()} == expected
    back = closure.transitive_closure(e, start, "object", depth)
    assert {r.s + r.o for r in back.collect()} <= {s + o for s, o in EDGES} and back.count() >= 1
    nothing = spark.createDataFrame([("zz",)], "node string")
    assert closure.transitive_closure(e, nothing).count() == 0


def test_all_pairs_levels_and_cycles(spark):
    e = spark.createDataFrame([(s, "p", o) for s, o in EDGES], "s string, p string, o string")
    assert {(r.a, r.b) for r in closure.all_pairs(e).collect()} == {(a, b) for a in "abcd" for b in "abcde"}
    with pytest.raises(ValueError, match="cycle"):
        closure.topological_levels(e)
    tree = e.where("o <> 'a'")
    assert {r.node: r.level for r in closure.topological_levels(tree).collect()} == {"d": 0, "e": 0, "c": 1, "b": 2, "a": 3}


@pytest.mark.parametrize("old,new,states", [
    ({}, {"a": "a", "b": "a"}, {"conflict: not injective"}), ({"a": "a"}, {"a": "b"}, {"conflict: prefix is bound"}), ({"a": "b"}, {}, {"kept"}),
    ({}, {"a": "b"}, {"add"}), ({"a": "b"}, {"c": "d"}, {"kept", "add"}), ({"a": "b"}, {"a": "b"}, {"existing"}),
    ({"a": "b"}, {"a": "b", "c": "d"}, {"existing", "add"}), ({"a": "b", "c": "d"}, {"a": "b"}, {"existing", "kept"}), ({"a": "b"}, {"c": "b"}, {"kept", "conflict: namespace is bound"}),
])
def test_curie_diff(spark, old, new, states):
    df = lambda d: spark.createDataFrame(list(d.items()), "prefix string, namespace string")
    assert {r.state for r in lookup.curie_diff(df(old), df(new)).collect()} == states


def test_ntriples_round_trip_and_bad_lines(spark):
    rows = [("http://s", "http://p", None, 'q"uote\\ \n\t end\\n', None, "en"), ("_:b1", "http://p", "_:b2"), ("http://s", "http://p", None, "5", "http://int"), ("http://s", "http://p", "http://o"), ("_:b1", "http://q", "http://o"), ("http://s", "http://p", None, "")]
    g = graph(spark, rows)
    lines = ntriples.dump_ntriples(g).withColumnRenamed("line", "value")
    lines = lines.union(spark.createDataFrame([("# comment",), ("   ",)], "value string"))
    back = ntriples.parse_lines(lines).select("s", "p", "o", "o_lit", "datatype", "language", F.regexp_replace("s_blank", "^bx", "").alias("s_blank"), F.regexp_replace("o_blank", "^bx", "").alias("o_blank"))
    key = ["s", "s_blank", "p", "o", "o_lit", "o_blank", "datatype", "language"]
    assert sorted(map(str, back.select(key).collect())) == sorted(map(str, g.select(key).collect()))
    text = spark.createDataFrame([(r'<http://s> <http://p> "é \U0001F600 \\u0041" .',)], "value string")
    assert ntriples.parse_lines(text).first().o_lit == "é \U0001f600 \\u0041"
    bad = spark.createDataFrame([("<a> <b> .",), ("<a> <b> <c> .",)], "value string")
    assert ntriples.parse_lines(bad, strict=False).count() == 1
    with pytest.raises(Exception, match="not a triple"):
        ntriples.parse_lines(bad).collect()


def test_loading_twice_changes_nothing(spark):
    g = identities.with_triple_identity(graph(spark, ROUND_TRIP).where("s is not null and o_blank is null"))
    assert ntriples.append_new(g, g, ["triple_identity"]).count() == 0
    with pytest.raises(ValueError, match="repeats"):
        ntriples.dedupe(g.union(g), strict=True)


def test_patches(spark):
    key = versions.KEY
    g = graph(spark, [("s", "p", "o"), ("s", "q", None, "v"), ("t", "p", "o")]).select(key)
    patch = lambda *rows: graph(spark, [r[1:] for r in rows]).select(key).withColumn("op", F.lit(rows[0][0]))
    add, gone, absent = patch(("add", "s", "new", "x")), patch(("del", "s", "p", "o")), patch(("del", "t", "p", "none"))
    assert [r.error for r in versions.check_patch(g, absent).collect()] == ["delete absent"]
    assert [r.error for r in versions.check_patch(g, patch(("add", "s", "p", "o"))).collect()] == ["add present"]
    done = versions.apply_patch(g, add.union(gone).union(absent)).collect()
    expected = identities.named_records(graph(spark, [("s", "q", None, "v"), ("s", "new", "x")])).first()
    assert [(r.s, bytes(r.embedded)) for r in done] == [("s", bytes(expected.embedded))]


def test_votes(spark):
    votes = spark.createDataFrame([(1, k, 10 + k, "approve") for k in range(3)] + [(1, 0, 99, "deny"), (2, 0, 1, "approve"), (2, 1, 1, "absent")], "review long, reviewer long, ts long, vote string")
    rules = spark.createDataFrame([(1, None, 1.0, None, 0.5, 1, None), (2, 1, None, None, 1.0, None, None)], "review long, quorum_exact int, quorum_ratio double, pass_exact int, pass_ratio double, fail_exact int, fail_ratio double")
    committee = spark.createDataFrame([(1, k) for k in range(3)] + [(2, 0), (2, 1)], "review long, reviewer long")
    got = {r.review: r for r in review.tally(votes, rules).collect()}
    assert (got[1].approve, got[1].deny, got[1].failed, got[1].passed) == (2, 1, True, False)
    assert got[2].passed and not got[2].failed
    assert {r.review: r.quorum for r in review.quorum(votes, committee, rules).collect()} == {1: True, 2: True}


def test_shape_rules(spark):
    good = [row("s", "p", "o"), row("s", "p", None, "v", "dt"), row("s", "p", None, "v", None, "ja"), row("_:a", "p", "_:b")]
    bad = [row("s", "p", None, "v", "dt", "ja"), row("s", "p", "s"), row("s", "p"), (None, None, "p", "o", None, None, None, None), ("s", None, None, "o", None, None, None, None)]
    assert quality.check_shape(spark.createDataFrame(good, T)).count() == 0
    assert quality.check_shape(spark.createDataFrame(bad, T)).count() == len(bad)


def test_labels_become_unique(spark):
    rows = [(1, "Heart", "term", "0"), (2, "heart ", "term", "0"), (3, "HEART", "term", "-2"), (4, "heart", "TermSet", "0"), (5, "lung", "term", "0"), (6, "heart", "cde", "0"), (7, "heart", "term", "0")]
    labels, pairs = quality.dedupe_labels(spark.createDataFrame(rows, "id long, label string, type string, status string"), spark.createDataFrame([(7, "cor")], "id long, label string"))
    got = {r.id: r.new_label for r in labels.collect()}
    assert got == {1: "Heart", 2: "heart (duplicateOf 1)", 3: "HEART (deprecated)", 4: "heart (TermSet)", 6: "heart (CDE)", 7: "cor"}
    assert [(r.id, r.duplicate_of) for r in pairs.collect()] == [(2, 1)]


def test_curies_and_search(spark):
    curies = spark.createDataFrame([("a", "http://x/"), ("b", "http://x/y_")], "prefix string, namespace string")
    df = spark.createDataFrame([("http://x/y_1",), ("http://x/z",), ("urn:1",)], "iri string")
    assert {r.iri: r.curie for r in iris.shrink_iris(df, "iri", curies).collect()} == {"http://x/y_1": "b:1", "http://x/z": "a:z", "urn:1": None}
    back = iris.expand_curies(spark.createDataFrame([("b:1",), ("a:",), ("c:1",), ("none",)], "c string"), "c", curies)
    assert {(r.c, r.iri, r.status) for r in back.collect()} == {("b:1", "http://x/y_1", "ok"), ("a:", None, "prefix only"), ("c:1", None, "unknown prefix"), ("none", None, "not a curie")}
    t = graph(spark, [("s", "rdfs:label", None, "Left Heart valve"), ("s", "ex:synonym", None, "the left heart"), ("t", "rdfs:label", None, "heart left")])
    got = lookup.search(lookup.tokens(t), spark.createDataFrame([("left heart",)], "query string")).collect()
    assert [(r.s, round(r.score, 6)) for r in got] == [("s", 4.6)]
