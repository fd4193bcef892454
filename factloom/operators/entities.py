"""What follows from a write: new entities, patches, merged pulls, specs and preferred iris, each as the rows to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import either, h, null_identity
from ..functions.shared import cut
from ..sources.triplify import LABEL, TYPE, rule, union
from .identities import named_records, with_triple_identity
from .rebuild import new_entities
from .versions import KEY, check_patch

EXACT, ONTOLOGY = "ex:hasExactSynonym", "owl:Ontology"
NONE = "none"


def bundle(requests: DataFrame, exacts: DataFrame, registry: DataFrame, top: int, base: str) -> dict[str, DataFrame]:
    """All rows of new entities in one go.

    ``requests``: (request, rdf_type, label, grp, ts), ``exacts``: (request, literal), ``registry``: (label) of labels and exact synonyms that
    are taken.  A request whose label or any of whose exact synonyms is taken, or was asked for before, is refused as a whole.

    minted (request, id, s, meta), refused (request, reason), strings for the registry, triples of the entity and of its header, records
    (s, condensed, embedded, n, combined), relations (s, p, o), identities (identity, type, n), history (record, previous, grp, ts) and heads
    (grp, subject, head).  The graph of an entity holds its record and that of its header; it has no blank half and no conventions of its own.
    """
    low = registry.select(F.lower("label").alias("low")).distinct().withColumn("known", F.lit(True))
    asked = exacts.withColumn("low", F.lower("literal")).join(requests.select("request"), "request")
    labels = requests.select("request", F.lower("label").alias("low"))
    # an exact synonym clashes with the registry, with any request's label but its own, and with exact synonyms of earlier requests
    first = asked.groupBy("low").agg(F.min("request").alias("first"))
    by = labels.groupBy("low").agg(F.min("request").alias("by"))
    bad = asked.join(low, "low", "left").join(first, "low").join(by, "low", "left")
    bad = bad.where(F.col("known") | (F.col("first") < F.col("request")) | (F.col("by") != F.col("request"))).select("request").distinct()
    rest = requests.join(bad, "request", "left_anti")
    minted, twice = new_entities(rest.select("request", "label"), registry.select("label"), top)
    group = requests.select("request", "rdf_type", "grp", "ts")
    minted = cut(minted.join(group, "request").select(
        "request", "label", "rdf_type", "grp", "ts", "id", F.concat(F.lit(f"{base}base/"), "id").alias("s"), F.concat(F.lit(base), "grp", F.lit("/ontologies/"), "id").alias("meta")
    ))
    own = exacts.join(minted.select("request", "id", "s"), "request")
    body = union(rule(minted, F.col("s"), TYPE, o=F.col("rdf_type")), rule(minted, F.col("s"), LABEL, o_lit=F.col("label")), rule(own, F.col("s"), EXACT, o_lit=F.col("literal"))).distinct()
    head = rule(minted, F.col("meta"), TYPE, o=F.lit(ONTOLOGY))
    records = cut(named_records(body.unionByName(head)).withColumn("combined", either(F.col("embedded"), F.lit(None).cast("binary"))))
    rec, meta = (records.select(F.col("s").alias(k), F.col("embedded").alias(f"{k}_record"), F.col("condensed").alias(f"{k}_condensed"), F.col("combined").alias(f"{k}_combined"), F.col("n").alias(f"{k}_n")) for k in ("s", "meta"))
    none = null_identity()
    pair = lambda a, b: h(F.when(F.hex(a) < F.hex(b), F.concat(a, b)).otherwise(F.concat(b, a)))
    g = minted.join(rec, "s").join(meta, "meta").withColumn("seq", pair(F.col("s_record"), F.col("meta_record"))).withColumn("graph", h(F.concat("seq", none)))
    g = g.withColumn("release", h(F.concat(none, "graph"))).withColumn("meta_seq", h("meta_record")).withColumn("meta_graph", h(F.concat("meta_seq", none)))
    g = cut(g)
    edges = [
        ("release", "hasLocalConventions", none), ("release", "hasGraph", "graph"), ("graph", "hasNamedGraph", "seq"), ("graph", "hasBnodeGraph", none), ("seq", "hasNamedRecord", "s_record"), ("seq", "hasNamedRecord", "meta_record"),
        ("s_combined", "hasNamedRecord", "s_record"), ("release", "hasMetadataGraph", "meta_graph"), ("meta_graph", "hasNamedGraph", "meta_seq"), ("meta_graph", "hasBnodeGraph", none), ("meta_seq", "hasNamedRecord", "meta_record"), ("meta_record", "hasCondensed", "meta_condensed"),
    ]
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    relations = g.select(F.explode(F.array(*[F.struct(F.col(a).alias("s"), F.lit(p).alias("p"), as_col(o).alias("o")) for a, p, o in edges])).alias("x")).select("x.*").distinct()
    both = F.col("s_n") + F.col("meta_n")
    kinds = [("s_combined", "record_combined", "s_n"), ("s_record", "named_embedded", "s_n"), ("seq", "named_embedded_seq", both), ("graph", "graph_combined", both), ("release", "graph_combined_local_conventions", both),
             ("meta_record", "named_embedded", "meta_n"), ("meta_seq", "named_embedded_seq", "meta_n"), ("meta_graph", "graph_combined", "meta_n"), ("meta_condensed", "named_condensed", "meta_n")]
    identities = g.select(F.explode(F.array(*[F.struct(F.col(a).alias("identity"), F.lit(t).alias("type"), as_col(n).alias("n")) for a, t, n in kinds])).alias("x")).select("x.*").distinct()
    refused = bad.select("request", F.lit("exact synonym is taken").alias("reason")).unionByName(twice.select("request", "reason"))
    return {
        "minted": minted.select("request", "id", "s", "meta"), "refused": refused, "triples": body.unionByName(head), "records": records, "relations": relations, "identities": identities,
        "strings": minted.select("id", F.lit("label").alias("p"), F.col("label").alias("o_lit")).unionByName(own.select("id", F.lit("exact").alias("p"), F.col("literal").alias("o_lit"))),
        "history": g.select(F.col("s_combined").alias("record"), none.alias("previous"), "grp", "ts"), "heads": g.select("grp", F.col("s").alias("subject"), F.col("s_combined").alias("head")),
    }


def commit(triples: DataFrame, patch: DataFrame, heads: DataFrame, grp: str, ts: Column) -> dict[str, DataFrame]:
    """A patch (op, triple columns) of a group's subjects: new records, history, heads and what was refused.

    A subject with any bad row is refused as a whole, and so is one whose patch changes nothing.  History tells the record, the one before it
    (the group's head, else the record that the triples make), the group and the time.  A subject whose last row went has no record, and its
    head is taken away by one that is null.
    """
    checked = cut(check_patch(triples, patch))
    bad = checked.where("error is not null").select("s").distinct()
    good = checked.join(bad, "s", "left_anti")
    touched = good.select("s").distinct()
    old = cut(with_triple_identity(triples.join(touched, "s", "left_semi")))
    kept = old.join(good.where("op = 'del'").select("triple_identity"), "triple_identity", "left_anti").select(*KEY)
    combined = lambda df: named_records(df).select("s", either(F.col("embedded"), F.lit(None).cast("binary")).alias("record"), "n")
    new = cut(combined(kept.unionByName(good.where("op = 'add'").select(*KEY))))
    before = combined(old.select(*KEY)).select("s", F.col("record").alias("made"))
    mine = heads.where(F.col("grp") == grp).select(F.col("subject").alias("s"), "head")
    out = cut(touched.join(new, "s", "left").join(before, "s", "left").join(mine, "s", "left").withColumn("previous", F.coalesce("head", "made")))
    same = out.where("record <=> previous")
    moved = out.where("not (record <=> previous)")
    refused = checked.where("error is not null").groupBy("s").agg(F.array_join(F.sort_array(F.collect_set("error")), ", ").alias("reason"))
    return {
        "records": moved.where("record is not null").select("s", "record", "n"), "history": moved.select("s", F.coalesce("record", null_identity()).alias("record"), F.coalesce("previous", null_identity()).alias("previous"), F.lit(grp).alias("grp"), ts.alias("ts")),
        "heads": moved.select(F.lit(grp).alias("grp"), F.col("s").alias("subject"), F.col("record").alias("head")), "refused": refused.unionByName(same.select("s", F.lit("no change").alias("reason"))),
    }


def open_pulls(requests: DataFrame, heads: DataFrame, records: DataFrame, log: DataFrame) -> DataFrame:
    """Requests (pull, subject, from_p, to_p) with both heads and ``error``.

    ``heads``: (perspective, subject, head).  A target without a head stands at the newest of the subject's ``records`` (subject, record,
    first_seen) that no head in ``log`` (subject, head) ever was, if there is one.
    """
    a = heads.select("subject", F.col("perspective").alias("from_p"), F.col("head").alias("from_head"))
    b = heads.select("subject", F.col("perspective").alias("to_p"), F.col("head").alias("own_head"))
    unused = records.join(log.select("subject", F.col("head").alias("record")).distinct(), ["subject", "record"], "left_anti")
    newest = unused.groupBy("subject").agg(F.max(F.struct("first_seen", "record")).alias("x")).select("subject", F.col("x.record").alias("newest"))
    out = requests.join(a, ["subject", "from_p"], "left").join(b, ["subject", "to_p"], "left").join(newest, "subject", "left")
    source = F.col("from_head").isNotNull()
    out = out.withColumn("to_head", F.coalesce("own_head", F.when(source, F.col("newest"))))
    return out.withColumn(
        "error", F.when(~source & F.col("own_head").isNull(), "no heads").when(~source, "no source head").when(F.col("from_head") == F.col("to_head"), "same head")
    ).drop("own_head", "newest")


def merge(pulls: DataFrame, heads: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pulls (pull, subject, from_p, to_p, to_grp, status, expected, actor) with ``outcome``, and heads (perspective, subject, head) that move.

    The source's head has to be the expected one.  The actor is the target group itself, or has a role there that ranks before view.  What
    the target's head was is not looked at.  Of several pulls to one target of one subject the last by number moves the head.
    """
    from .review import ROLES, role_rank

    now = heads.select("subject", F.col("perspective").alias("from_p"), F.col("head").alias("now_head"))
    role = roles.groupBy("actor", F.col("grp").alias("to_grp")).agg(F.min(role_rank(F.col("role"))).alias("rank"))
    out = pulls.join(now, ["subject", "from_p"], "left").join(role, ["actor", "to_grp"], "left")
    allowed = (F.col("actor") == F.col("to_grp")) | (F.coalesce("rank", F.lit(99)) <= ROLES.index("view"))
    out = cut(out.withColumn(
        "outcome", F.when(F.col("status") != "pending", "not pending").when(~F.col("now_head").eqNullSafe(F.col("expected")), "head moved").when(~allowed, "no role").otherwise("merged")
    ).drop("now_head", "rank"))
    moved = out.where("outcome = 'merged'").groupBy(F.col("to_p").alias("perspective"), "subject").agg(F.max_by("expected", "pull").alias("head"))
    return out, moved


def patch_specs(spec: DataFrame, patch: DataFrame, known: DataFrame, include: str = "ex:include-subject", create: bool = False) -> tuple[DataFrame, DataFrame]:
    """Specs (triple columns) after a ``patch`` (op, triple columns), and what of it was refused: (s, o, reason).

    A row that adds what is there, deletes what isn't, or stands on both sides is an error, and so is a patch of a spec that changes nothing.
    With ``create`` subjects have to be ``known`` (s, type): unknown ones and records are refused.  A spec with any error stays as it was.
    """
    checked = cut(check_patch(spec, patch))
    types = known.groupBy(F.col("s").alias("o")).agg(F.bool_or(F.col("type") == "record").alias("record"))
    adds = checked.join(types, "o", "left")
    reason = F.when(F.col("error").isNotNull(), F.col("error"))
    if create:
        mine = (F.col("op") == "add") & (F.col("p") == include)
        reason = reason.when(mine & F.col("record").isNull(), "unknown subject").when(mine & F.col("record"), "subject is a record")
    judged = cut(adds.withColumn("reason", reason))
    bad = judged.where("reason is not null").select("s").distinct()
    good = judged.join(bad, "s", "left_anti")
    gone = good.where("op = 'del'").select("triple_identity")
    kept = with_triple_identity(spec).join(gone, "triple_identity", "left_anti").select(*KEY)
    return kept.unionByName(good.where("op = 'add'").select(*KEY)).distinct(), judged.where("reason is not null").select("s", "o", "reason")


HAS_ID, EXISTING, DEPRECATED_LABEL, MISSING = "ex:hasTermId", "ex:hasExistingId", "ex:deprecatedLabel", "ex:MISSING_TERM_ID"


def prefer(triples: DataFrame, preferred: DataFrame) -> DataFrame:
    """Triples with iris as they are ``preferred`` (iri, to): subjects, predicates and objects, but no existing ids as objects.

    Term ids stay as they are.  Of the labels that a subject then has the first by the old subject and the label stays, the others become
    deprecated labels.  Subjects without a term id of any of their old names are flagged.
    """
    to = lambda c: preferred.select(F.col("iri").alias(c), F.col("to").alias(f"{c}_to"))
    rows = triples.select(*KEY).join(to("s"), "s", "left").join(to("p"), "p", "left").join(to("o"), "o", "left")
    old_s, p = F.col("s"), F.col("p")
    is_id, is_label = p == HAS_ID, p == LABEL
    new = rows.select(
        old_s.alias("was"), F.coalesce("s_to", "s").alias("s"), F.when(is_id | is_label, p).otherwise(F.coalesce("p_to", "p")).alias("p"),
        F.when(is_id | (p == EXISTING), F.col("o")).otherwise(F.coalesce("o_to", "o")).alias("o"), "o_lit", "datatype", "language", is_label.alias("is_label"), is_id.alias("is_id"),
    )
    new = cut(new)
    value = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("o_lit", "datatype", "language")])
    label = new.where("is_label").withColumn("k", F.row_number().over(W.partitionBy("s").orderBy("was", value)))
    label = label.withColumn("p", F.when(F.col("k") > 1, DEPRECATED_LABEL).otherwise(F.col("p"))).select(*KEY)
    missing = new.where("s is not null").groupBy("s").agg(F.bool_or("is_id").alias("ok")).where("not ok")
    flag = rule(missing, F.col("s"), MISSING, o_lit=F.lit("true"), datatype="xsd:boolean")
    return new.where("not is_label").select(*KEY).unionByName(label).unionByName(flag).distinct()


def best_existing(existing: DataFrame, ranking: list[str]) -> DataFrame:
    """(iri, to) of each term iri's preferred existing id: the first prefix in the ranking, then the suffix; others by prefix and suffix."""
    place = F.array_position(F.array(*[F.lit(x) for x in ranking]), F.col("prefix"))
    rank = F.struct(F.when(place == 0, len(ranking) + 1).otherwise(place).alias("a"), F.when(place == 0, F.col("prefix")).otherwise("").alias("b"), F.col("suffix").alias("c"), F.col("existing").alias("d"))
    return existing.groupBy("iri").agg(F.min_by("existing", rank).alias("to"))
