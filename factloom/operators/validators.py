"""Validators of naming, keys, roles and patches: each adds or returns the names of the rules that a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.iris import host
from .review import role_rank


def _errors(**rules: Column) -> Column:
    """Names of the rules that hold, in order; a rule over nulls doesn't."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name.replace("_", " ")) for name, rule in rules.items()]))


def partial_key_errors(triples: DataFrame) -> DataFrame:
    """(key, s, s_blank, p, n) of rows that are there more than once under the unique key of their form.

    Ten keys: named or blank subject, by iri, plain literal, typed literal, literal with language, or blank object.  The keys exclude each
    other, so one aggregate checks all of them; blank forms count within their subgraph.
    """
    side = F.when(F.col("s").isNotNull(), "named").otherwise("blank")
    form = (
        F.when(F.col("o").isNotNull(), "iri").when(F.col("o_blank").isNotNull(), "node").when(F.col("datatype").isNotNull(), "typed")
        .when(F.col("language").isNotNull(), "language").otherwise("literal")
    )
    part = F.when((side == "blank") | (form == "node"), F.col("subgraph_identity"))
    rows = triples.where("o is not null or o_lit is not null or o_blank is not null").select(
        F.concat_ws(" ", side, form).alias("key"), "s", "s_blank", "p", "o", "o_blank", F.md5("o_lit").alias("literal"), "datatype", "language", part.alias("part")
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "s", "s_blank", "p", "n")


#: Digits of the ids of each prefix: fixed values.
ID_DIGITS = {"tmp": 9, "tx": 7, "cde": 7, "fde": 7, "pde": 8}


def id_errors(prefix: Column, number: Column) -> Column:
    """An id needs at least so many digits in a row as its prefix says; other prefixes have no ids."""
    ok = F.lit(False)
    for name, digits in ID_DIGITS.items():
        ok = ok | ((prefix == name) & number.rlike(f"[0-9]{{{digits}}}"))
    return _errors(unknown_prefix=~prefix.isin(*ID_DIGITS), digits=prefix.isin(*ID_DIGITS) & ~ok)


def external_map_errors(rows: DataFrame, own_host: str) -> DataFrame:
    """(term, iri, perspective) with ``errors``: the iri is on the own host, or its perspective maps it more than once."""
    n = rows.groupBy("iri", "perspective").agg(F.count(F.lit(1)).alias("_n"))
    out = rows.join(n, ["iri", "perspective"])
    return out.withColumn("errors", _errors(own_host=host(F.col("iri")).endswith(own_host), several=F.col("_n") > 1)).drop("_n")


#: Relations of which a subject may have several: fixed values.
MANY = ("hasBnodeRecord", "hasNamedRecord")


def relation_errors(relations: DataFrame) -> DataFrame:
    """(s, p, error, n): a relation to itself, or several objects of a relation that allows one."""
    loops = relations.where("s = o").groupBy("s", "p").agg(F.count(F.lit(1)).alias("n")).withColumn("error", F.lit("self"))
    many = relations.where(~F.col("p").isin(*MANY)).distinct().groupBy("s", "p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("error", F.lit("several"))
    return loops.unionByName(many).select("s", "p", "error", "n")


def spec_uri_errors(base: str) -> Column:
    """A spec's ``uri`` has to be the base, its ``grp``, ``/ontologies/`` and its ``path``."""
    uri, lead = F.col("uri"), F.concat(F.lit(base), F.col("grp"), F.lit("/ontologies/"))
    return _errors(host=~uri.startswith(base), group=uri.startswith(base) & ~uri.startswith(lead), path=uri.startswith(lead) & (uri != F.concat(lead, F.col("path"))))


#: Predicates that patches can't add, can't delete, and may hold once: fixed values.
NO_ADD = ("rdf:type", "rdfs:label", "ex:duplicateOf", "ex:replacedBy", "ex:hasTermId")
NO_DELETE = ("rdf:type", "rdfs:label", "ex:hasExactSynonym", "ex:duplicateOf", "ex:replacedBy", "ex:hasTermId")
ONE = ("ex:definition", "rdfs:label")


def special_errors(patch: DataFrame, stored: DataFrame) -> DataFrame:
    """Patch rows (op, s, p, ...) with ``errors``: cannot add, cannot delete, or rules of predicates that a subject holds once.

    Such a predicate takes one value: several added ones are an error.  Where the subject has a value already, the patch has to take that
    one away and add another; one without the other is an error of every row of that subject and predicate.
    """
    now = stored.where(F.col("p").isin(*ONE)).groupBy("s", "p").agg(F.count(F.lit(1)).alias("_now"))
    change = patch.where(F.col("p").isin(*ONE)).groupBy("s", "p").agg(F.count_if(F.col("op") == "add").alias("_adds"), F.count_if(F.col("op") == "del").alias("_dels"))
    out = patch.join(now, ["s", "p"], "left").join(change, ["s", "p"], "left")
    p, op = F.col("p"), F.col("op")
    once, held = p.isin(*ONE), F.coalesce("_now", F.lit(0)) > 0
    return out.withColumn(
        "errors", _errors(
            cannot_add=(op == "add") & p.isin(*NO_ADD), cannot_delete=(op == "del") & p.isin(*NO_DELETE), several=once & (F.col("_adds") > 1),
            missing_delete=once & held & (F.col("_dels") == 0), missing_add=once & held & (F.col("_adds") == 0),
        )
    ).drop("_now", "_adds", "_dels")


#: Longest and shortest group name, and the patterns that none may have: fixed values.
NAME_LENGTH = (5, 40)
NAME_SHAPE = "(?i)^[A-Za-z][A-Za-z0-9_-]*$"
NAME_TABOO = ("(?i)(tmp|tx|cde|fde|pde)_.*", "(?i)^group.*", "(?i)^user.*", "(?i)^test.*")


def group_name_errors(groups: DataFrame, reserved: DataFrame, own: str, name: str = "name") -> DataFrame:
    """Groups with ``errors``: too short, too long, shape, taboo, reserved, or taken (names compare without case).

    ``own`` is the system's own name, with which no group's name may go on.
    """
    x, low = F.col(name), F.lower(name)
    out = groups.join(reserved.select(F.lower("name").alias("_r")).distinct(), low == F.col("_r"), "left")
    out = out.join(groups.groupBy(low.alias("_low")).agg(F.count(F.lit(1)).alias("_n")), low == F.col("_low"), "left")
    taboo = F.lit(False)
    for pattern in NAME_TABOO:
        taboo = taboo | x.rlike(pattern)
    short, long = NAME_LENGTH
    return out.withColumn(
        "errors", _errors(short=F.char_length(x) < short, long=F.char_length(x) > long, shape=~x.rlike(NAME_SHAPE), taboo=taboo, own_name=low.contains(own.lower()) & ~low.endswith(own.lower()), reserved=F.col("_r").isNotNull(), taken=F.col("_n") > 1)
    ).drop("_r", "_low", "_n")


def comment_target_errors() -> Column:
    """Rules over (target_type, iri, triple_identity, subgraph_identity, subgraph_blank, context_identity, perspective, pull, review)."""
    has = lambda c: F.col(c).isNotNull()
    kind = F.col("target_type")
    thing = has("iri") | has("triple_identity") | has("subgraph_identity")
    subgraph = has("subgraph_identity") | has("subgraph_blank")
    needs = (
        (kind.isin("ontology", "subject") & has("iri")) | ((kind == "triple") & has("triple_identity")) | ((kind == "subgraph") & has("subgraph_identity"))
        | ((kind == "pull") & has("pull")) | ((kind == "review") & has("review"))
    )
    return _errors(
        iri_and_identity=has("iri") & (has("triple_identity") | subgraph), triple_and_subgraph=has("triple_identity") & subgraph,
        context_and_perspective=has("context_identity") & has("perspective"), nothing_in_context=(has("context_identity") | has("perspective")) & ~thing,
        target_missing=~F.coalesce(needs, F.lit(False)),
    )


def comment_target_repeats(targets: DataFrame) -> DataFrame:
    """(key, n) of comment targets that are there more than once: a pull or a review has one target, and each thing one for each context.

    Nulls of context and perspective count as equal; each kind of thing has a key of its own.
    """
    scope = ["context_identity", "perspective"]
    out = None
    for key, cols, when in (
        ("iri", [*scope, "iri"], "iri is not null"), ("triple", [*scope, "triple_identity"], "triple_identity is not null"),
        ("subgraph", [*scope, "subgraph_identity", "subgraph_blank"], "subgraph_identity is not null and subgraph_blank is not null"),
        ("pull", ["pull"], "pull is not null"), ("review", ["review"], "review is not null"),
    ):
        own = targets.where(when).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        own = own.select(F.lit(key).alias("key"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols]).alias("value"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def role_errors() -> Column:
    """Rules over (grp, actor, role, grp_is_user): the first group is for admins only, others reach from owner to view or are deleted."""
    r, g = role_rank(F.col("role")), F.col("grp")
    inside = (r > role_rank(F.lit("admin"))) & ((r <= role_rank(F.lit("view"))) | (F.col("role") == "deleted")) & (g != 0)
    admin = (F.col("role") == "admin") & (g == 0)
    return _errors(itself=g == F.col("actor"), role=~(inside | admin), user_to_user=F.col("grp_is_user") & ~F.col("role").isin("view", "deleted"))


def own_role_errors(role: Column) -> Column:
    """A group's own role is below admin."""
    return _errors(own_role=role_rank(role) <= role_rank(F.lit("admin")))


#: Shape of a key, and the least seconds that it lives: fixed values.
KEY_SHAPE, KEY_SECONDS = "(?i)^ix[prw]_[0-9A-Za-z]+$", 60


def key_errors(keys: DataFrame, quotas: DataFrame, users: DataFrame, active: int, total: int) -> DataFrame:
    """Keys (actor, key, key_type, scope, lifetime, revoked, note) with ``errors``.

    ``quotas``: (actor, active, total), of which the greater of an actor's own and the default (``active``, ``total``) holds; the first is
    for keys that aren't revoked, the second for all.  ``users``: (actor, own_role, admin): keys are for owners of their own group, keys with
    the scope admin for those that are admin in the first group.
    """
    used = keys.groupBy("actor").agg(F.count_if(~F.col("revoked")).alias("_active"), F.count(F.lit(1)).alias("_total"))
    own = quotas.select("actor", F.col("active").alias("_own_active"), F.col("total").alias("_own_total"))
    out = keys.join(used, "actor", "left").join(own, "actor", "left").join(users.select("actor", "own_role", F.col("admin").alias("_admin")), "actor", "left")
    most = lambda c, least: F.greatest(F.coalesce(c, F.lit(least)), F.lit(least))
    k, note = F.col("key"), F.col("note")
    return out.withColumn(
        "errors",
        _errors(
            shape=~k.rlike(KEY_SHAPE), type=F.substring("key_type", 1, 1) != F.substring("key", 3, 1), lifetime=F.col("lifetime") <= KEY_SECONDS,
            quota=~F.col("revoked") & (F.col("_active") > most("_own_active", active)), total_quota=F.col("_total") > most("_own_total", total), not_owner=~F.col("own_role").eqNullSafe(F.lit("owner")),
            admin_scope=(F.col("scope") == "admin") & ~F.coalesce("_admin", F.lit(False)), note=note.rlike(r"^\s|\s$") | (note == ""),
        ),
    ).drop("_active", "_total", "_own_active", "_own_total", "own_role", "_admin")


def ambiguous_names(triples: DataFrame) -> DataFrame:
    """(graph, n, verdict) over the ontology subjects of each graph: none, one, or ambiguous."""
    own = triples.where("p = 'rdf:type' and o = 'owl:Ontology'").groupBy("graph").agg(F.count_distinct("s").alias("n"))
    every = triples.select("graph").distinct().join(own, "graph", "left").fillna(0, ["n"])
    return every.withColumn("verdict", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("ambiguous"))


def reference_name_errors(rows: DataFrame, own_host: str) -> DataFrame:
    """Reference names (name, expected, old_expected) with ``errors``.

    Names are on the host; an expected name is the name itself or elsewhere, and belongs to one name.  ``old_expected`` is that of the row
    which an update replaces: once it is elsewhere, no update is taken, not even one that leaves it as it is.
    """
    name, exp, old = F.col("name"), F.col("expected"), F.col("old_expected")
    n = rows.where("expected is not null").groupBy(F.col("expected").alias("_e")).agg(F.count(F.lit(1)).alias("_n"))
    fits = ((host(exp) == own_host) & (exp == name)) | (host(exp) != own_host)
    out = rows.join(n, exp == F.col("_e"), "left")
    return out.withColumn("errors", _errors(name_off_host=~host(name).eqNullSafe(F.lit(own_host)), expected=exp.isNotNull() & ~fits, set_elsewhere=old.isNotNull() & (old != name), taken=F.col("_n") > 1)).drop("_e", "_n")


def perspective_errors(perspectives: DataFrame, groups: DataFrame) -> DataFrame:
    """Perspectives (grp, name, is_default) with ``errors`` against groups (grp, group_name)."""
    n = perspectives.where("is_default").groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    same = perspectives.groupBy("grp", "name").agg(F.count(F.lit(1)).alias("_same"))
    out = perspectives.join(groups, "grp", "left").join(n, "grp", "left").join(same, ["grp", "name"])
    is_name = F.col("name").eqNullSafe(F.col("group_name"))
    return out.withColumn(
        "errors", _errors(default_name=F.col("is_default") & ~is_name, other_name=~F.col("is_default") & is_name, defaults=F.col("is_default") & (F.col("_n") > 1), taken=F.col("_same") > 1)
    ).drop("_n", "_same", "group_name")


def name_agreement(upload: Column) -> Column:
    """Verdict over (bound, stored, given) names; ``upload`` says that a file without any name came through the group's upload."""
    b, s, g = (F.col(c) for c in ("bound", "stored", "given"))
    none = lambda x: x.isNull()
    return (
        F.when(none(b) & none(s) & none(g), F.when(upload, "accept").otherwise("error: no name, use the upload"))
        .when(none(b) & ~none(s) & ~none(g), F.when(s != g, "error: no name in the file, and stored differs from given").otherwise("error: no name in the file"))
        .when(none(b), "error: no name in the file")
        .when(none(s) & none(g), "set to bound")
        .when(none(s), F.when(b != g, "error: bound differs from given").otherwise("set to bound"))
        .when(none(g), F.when(b != s, "error: bound differs from stored").otherwise("accept"))
        .otherwise(F.when((b == s) & (s == g), "accept").otherwise("error: names differ"))
    )


#: Predicates that a patch may use though they aren't terms: fixed values.
SPECIAL = ("rdf:type", "rdfs:label", "ex:hasExactSynonym", "ex:hasExternalId", "ex:duplicateOf", "ex:replacedBy", "ex:hasTermId", "ex:synonym", "ex:definition")
TERM_PREFIXES = ("tx_", "tmp_")


def patch_triples(patch: DataFrame, own_host: str) -> DataFrame:
    """Patch rows (grp, frag, s, p, kind, value, datatype, language) with their first ``error`` and the triple as it is stored.

    In order: three parts, an object with a known type, no white space at an edge, and for the subject, predicate and iri object in turn: on
    the own host a group and a path, of the patch's group or base, the patched term as subject, a special or term predicate, no user iris; on
    other hosts http or https.  ``new_s``, ``new_p``, ``new_o`` have the base's group in place of the patch's.
    """
    c = F.col
    iri_object = c("kind") == "uri"
    edge = lambda x: F.coalesce(c(x).rlike(r"^\s|\s$"), F.lit(False))
    error = (
        F.when(c("s").isNull() | c("p").isNull() | c("value").isNull(), "not a triple").when(c("kind").isNull(), "object missing type").when(~c("kind").isin("uri", "literal"), "unknown object type")
        .when(edge("s") | edge("p") | edge("value") | edge("datatype") | edge("language"), "white space")
    )
    special = c("p").isin(*SPECIAL)
    term = lambda x: F.lit(False) if not TERM_PREFIXES else F.array_contains(F.array(*[x.startswith(t) for t in TERM_PREFIXES]), True)
    for x, position in (("s", "s"), ("p", "p"), ("value", "o")):
        here = F.lit(True) if position != "o" else iri_object
        if position == "p":
            here = here & ~special
        own = host(c(x)) == own_host
        parts = F.split(F.regexp_replace(c(x), r"^[a-z]+://[^/]*/?", ""), "/")
        group, frag = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        on = here & F.coalesce(own, F.lit(False))
        error = error.when(on & frag.isNull(), f"{position}: no group and path").when(on & ~group.isin("base") & (group != c("grp")), f"{position}: other group")
        if position == "s":
            error = error.when(on & (frag != c("frag")), "s: other subject")
        if position == "p":
            user = (group == c("grp")) & (frag == "uris")
            error = error.when(on & ~term(frag) & user, "p: user iri").when(on & ~term(frag), "p: bad predicate")
        if position == "o":
            error = error.when(on & c(x).contains("/uris/"), "o: user iri")
        error = error.when(here & ~F.coalesce(own, F.lit(False)) & ~c(x).rlike("^https?://"), f"{position}: bad scheme")
    base = lambda x: F.replace(c(x), F.concat(F.lit(f"{own_host}/"), c("grp"), F.lit("/")), F.lit(f"{own_host}/base/"))
    out = patch.withColumn("error", error)
    keep = lambda x: F.when(c("error").isNull(), base(x))
    return out.withColumns({"new_s": keep("s"), "new_p": keep("p"), "new_o": F.when(iri_object, keep("value"))})
