"""Label deduplication, the cull, bundles, patches, streams with timers and lines against small cases worked out by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import shared
from factloom.functions.identity import h, null_identity
from factloom.operators import closure, entities, merging, ranking, rebuild
from factloom.sources import ntriples
from factloom.streaming import streams

KEY = "s string, p string, o string, o_lit string, datatype string, language string"


def test_lines_with_control_characters_are_refused(spark):
    bad = ["<http://a/\x01b> <http://p> <http://o> .", "\x02\x01garbage", "_:a\x01b <http://p> <http://o> .", '<http://a> <http://p> "x"^^<http://t\x01y> .']
    good = ['<http://a> <http://p> "a\x01b\x02" .', '<http://a> <http://p> "x"@en . # note', "_:b <http://p> _:c ."]
    rows = spark.createDataFrame([(x,) for x in [*bad, *good, "", "# only a note"]], "value string")
    got = [(r.s, r.s_blank, r.p, r.o, r.o_blank, r.o_lit, r.datatype, r.language) for r in ntriples.parse_lines(rows, strict=False).collect()]
    assert got == [("http://a", None, "http://p", None, None, "a\x01b\x02", None, None), ("http://a", None, "http://p", None, None, "x", None, "en"), (None, "b", "http://p", None, "c", None, None, None)]
    with pytest.raises(Exception, match="not a triple"):
        ntriples.parse_lines(spark.createDataFrame([(bad[0],)], "value string")).collect()


def test_rows_as_rdf_keep_types_languages_and_escapes(spark):
    t = spark.createDataFrame([("a", "p", None, 'x "y"\n', None, None, None, None), ("a", "p", None, "1", "t", None, None, None), ("a", "p", None, "1", None, "en", None, None), ("a", "p", None, None, None, None, None, "n"), (None, "p", "o", None, None, None, "n", None)], f"{KEY}, s_blank string, o_blank string")
    nodes = spark.createDataFrame([("n", "ab", 3)], "node string, identity string, replica int")
    got = sorted(tuple(r) for r in ntriples.labelled_rows(t, nodes).collect())
    assert got == sorted([("<a>", "<p>", '"x \\"y\\"\\n"'), ("<a>", "<p>", '"1"^^<t>'), ("<a>", "<p>", '"1"@en'), ("<a>", "<p>", "_:sg_ab_3"), ("_:sg_ab_3", "<p>", "<o>")])


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Dir:
                    @staticmethod
                    def getCheckpointDir():  # noqa: N802
                        class Empty:
                            isDefined = staticmethod(lambda: False)  # noqa: N815
                        return Empty

                return Dir

    class Session:
        sparkContext = Context  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session)


def dedupe(spark, terms, known=(), overrides=(), fixed=(), synonyms=()):
    t = spark.createDataFrame([(i, p, label, kind, status, 1, None) for i, p, label, kind, status in terms], "id long, prefix string, label string, type string, status string, owner long, superclass long")
    table = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return merging.dedupe(t, table(known, "id long, target long"), table(overrides, "id long, new string"), table([], "superclass long, suffix string"), table(fixed, "low string, fixed long"), table([], "owner long, user string"), table(synonyms, "id long, literal string"))


def test_duplicates_point_to_the_lowest_live_term(spark):
    terms = [(1, "tx", "Heart", "term", "-2"), (2, "tx", "heart ", "term", "0"), (3, "tx", "HEART", "term", "0"), (4, "cde", "heart", "cde", "0"), (5, "pde", "heart", "pde", "0"), (6, "tx", "heart", "TermSet", "0"),
             (7, "tx", "lung", "term", "0"), (8, "tx", "Lung", "term", "0"), (9, "tx", "alone", "term", "0"), (10, "tx", None, "term", "0"), (11, "tx", "", "term", "0")]
    out = dedupe(spark, terms, known=[(2, 7), (3, 9), (7, 3)], overrides=[(8, "the lung")])
    labels = {r.id: (r.new_label, r.branch) for r in out.labels.collect()}
    assert labels == {
        1: ("Heart (deprecated)", "deprecated"), 2: ("heart", "kept"), 3: ("HEART TX:3 (duplicateOf TX:2)", "duplicate"), 4: ("heart (CDE)", "data element"), 5: ("heart (guid 1)", "guid"), 6: ("heart (TermSet)", "term set"),
        7: ("lung (duplicateOf TX:2)", "duplicate"), 8: ("the lung", "override"),
    }
    assert {(r.id, r.target) for r in out.duplicates.collect()} == {(3, 2), (7, 2)}
    assert {(r.id, r.target) for r in out.removed.collect()} == {(2, 7), (3, 9), (7, 3)}  # each pointed up or past the lowest
    assert {r.rule: r.n for r in merging.dedupe_faults(out).collect()} == dict.fromkeys(["labels are unique", "pairs are unique", "one target", "target is lower", "a target is no duplicate"], 0)


def test_labels_that_are_still_equal_get_their_ids(spark):
    terms = [(k, "tx", "set", "TermSet", "0") for k in range(1, 5)] + [(9, "tx", "set (TermSet)", "term", "0"), (10, "tx", "set (TermSet) TX:2", "term", "0")]
    got = {r.id: r.new_label for r in dedupe(spark, terms).labels.collect()}
    assert len({x.lower() for x in got.values()} | {"set (termset)", "set (termset) tx:2"}) == len(got) + 2 and set(got) == {1, 2, 3, 4}
    long = dedupe(spark, [(1, "tx", "n (TA98)", "term", "0"), (2, "tx", "n (TA98)", "term", "0")], synonyms=[(2, "N OF X"), (2, "short")])
    assert {r.id: (r.new_label, r.branch) for r in long.labels.collect()} == {1: ("n (TA98)", "anatomy"), 2: ("N OF X (TA98)", "long form")}
    assert dedupe(spark, []).labels.count() == 0


def test_cull_settles_conflicts_by_what_other_iris_say(spark):
    base = "http://own/base/"
    terms = spark.createDataFrame([(k, "tx", "-2" if k in (5, 6) else "0", f"tx_{k}") for k in range(1, 8)], "id long, prefix string, status string, tx string")
    rows = [(1, "http://x/1"), (2, "http://x/1"), (3, "http://x/1"), (1, f"{base}tx_3"), (4, "http://x/4"), (5, "http://x/4"), (6, "http://x/1"), (2, f"{base}tx_1"), (7, "http://x/7"), (7, "http://x/7"), (7, "http://x/a b")]
    out = merging.cull(spark.createDataFrame([(t, i, "c", 0) for t, i in rows], "tid long, iri string, curie string, version long"), terms, base, "http://own/")
    got = sorted((r.tid, r.iri, r.verdict) for r in out.rows.collect())
    assert got == sorted([
        (1, "http://x/1", None or "external"), (2, "http://x/1", "merged"), (3, "http://x/1", "merged"), (6, "http://x/1", "dead duplicate"), (1, f"{base}tx_3", "base: duplicateOf"), (2, f"{base}tx_1", "base: duplicateOf"),
        (4, "http://x/4", "external"), (5, "http://x/4", "dead duplicate"), (7, "http://x/7", "external"), (7, "http://x/7", "repeated"), (7, "http://x/a b", "bad iri"),
    ])
    assert {(r.id, r.target, r.kind) for r in out.pairs.collect()} == {(3, 1, "duplicateOf"), (2, 1, "duplicateOf"), (6, 1, "duplicateOf"), (5, 4, "duplicateOf")}
    assert merging.not_injective(out).count() == 0


def test_patches_that_change_nothing_are_refused(spark):
    t = spark.createDataFrame([("a", "p", None, "1", None, None), ("b", "p", None, "1", None, None), ("c", "p", None, "1", None, None)], KEY)
    patch = spark.createDataFrame([("add", "a", "p", None, "2", None, None), ("del", "b", "p", None, "1", None, None), ("add", "c", "p", None, "1", None, None)], f"op string, {KEY}")
    heads = spark.createDataFrame([], "grp string, subject string, head binary")
    got = entities.commit(t, patch, heads, "g", F.lit("2024").alias("ts"))
    assert {r.s: r.n for r in got["records"].collect()} == {"a": 2}
    assert {r.subject: r.head is None for r in got["heads"].collect()} == {"a": False, "b": True}  # b's last row went
    assert {(r.s, r.reason) for r in got["refused"].collect()} == {("c", "add present")}
    assert got["history"].where(F.col("record") == null_identity()).select("s").collect()[0].s == "b"
    ahead = got["heads"].where("subject = 'a'").select("grp", "subject", "head")
    again = entities.commit(t, patch.where("s = 'a'"), ahead, "g", F.lit("2024"))
    assert {(r.s, r.reason) for r in again["refused"].collect()} == {("a", "no change")} and again["heads"].count() == 0
    assert h is not None


def test_timers_fire_without_a_further_row(spark, tmp_path):
    day = lambda d, hour=0: datetime(2024, 1, d, hour)
    rows = [(1, day(1), 86400, 86400), (2, day(2), 86400, 86400 * 9), (3, day(1), 0, 3600), (9, day(5), 1, 1)]
    spark.createDataFrame(rows, "key long, ts timestamp, delay long, life long").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key long, ts timestamp, delay long, life long").parquet(str(tmp_path / "in"))
    told = streams.run_timers(source.select("key", "ts", streams.token_steps(F.col("ts"), F.col("delay"), F.col("life")).alias("steps")), "1 hour")
    got = {k: {r.state for r in told.collect() if r.key == k} for k in (1, 2, 3, 9)}
    assert got == {1: {"early", "active", "expired"}, 2: {"early", "active"}, 3: {"early", "active", "expired"}, 9: {"early"}}
    assert {r.ts for r in told.where("key = 1 and state = 'expired'").collect()} == {day(3)}


def test_ingest_of_a_new_run_keeps_what_is_there(spark, tmp_path):
    sink = str(tmp_path / "sink")
    for k, part in enumerate(([(1, "a"), (200, "b")], [(1, "z"), (2, "c")])):
        spark.createDataFrame(part, "k long, v string").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        streams.ingest_stream(spark, str(tmp_path / f"in{k}"), "k long, v string", sink, ["k"], str(tmp_path / f"ck{k}"), by=F.floor(F.col("k") / 100)).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.schema("k long, v string").parquet(sink).collect()) == [(1, "a"), (2, "c"), (200, "b")]


def test_closure_grows_by_new_edges(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "a string, b string")
    first = closure.extend_closure(spark.createDataFrame([], "node string, ancestor string"), pairs([("a", "b"), ("c", "d")]))
    new = closure.extend_closure(first, pairs([("b", "c"), ("a", "b"), ("x", "a"), ("d", "d")]))
    assert {tuple(r) for r in new.collect()} == {("b", "c"), ("a", "c"), ("b", "d"), ("a", "d"), ("x", "a"), ("x", "b"), ("x", "c"), ("x", "d"), ("d", "d")}


def test_search_ranks_within_fields(spark):
    rows = [("1", "label", "red cup"), ("2", "label", "cup of red"), ("3", "objects", "a red cup and a red cup " + "filler " * 20), ("4", "curie", "TX:7"), ("5", "label", "TX 7"), ("6", "label", None), ("6", "label", "")]
    ix = ranking.index(spark.createDataFrame(rows, "s string, field string, text string"))
    ask = lambda q, k=9: [(r.s, r.place) for r in ranking.search(ix, spark.createDataFrame([(q,)], "query string"), ["TX"], k).orderBy("place").collect()]
    assert [s for s, _ in ask("red cup")] == ["1", "3"] and ask("red cup", 1) == [("1", 1)] and ask("nothing such") == []
    assert {s for s, _ in ask("TX:7")} == {"4", "5"}


def test_sets_included_as_terms_end_there(spark):
    facts = [("a", "ex:includesTermSet", "b"), ("b", "ex:includesTermSet", "a"), ("b", "ex:includesTerm", "t"), ("a", "ex:includesTerm", "c"), ("c", "ex:includesTerm", "u"), ("c", "ex:includesTermSet", "d")]
    t = spark.createDataFrame([(s, p, o, None, None, None) for s, p, o in facts], KEY)
    members, sets = rebuild.termset_members(t, spark.createDataFrame([("a",)], "start string"))
    assert {(r.member, r.in_set) for r in members.collect()} == {("t", "b"), ("c", "a")} and {r.set for r in sets.collect()} == {"a", "b"}
