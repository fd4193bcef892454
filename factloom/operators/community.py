"""Joins around groups and their people: terms, prefixes, pulls, overviews, comments, roles, redirects of curies and of user iris."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.iris import host
from .review import ROLES, role_rank


def group_terms(terms: DataFrame, members: DataFrame, communities: DataFrame, approvals: DataFrame) -> DataFrame:
    """(grp, id): terms that members of a group made, and terms that a community of the group has approved.

    ``terms``: (id, uid), ``members``: (grp, uid), ``communities``: (cid, grp), ``approvals``: (id, cid, status).
    """
    made = terms.join(members, "uid").select("grp", "id")
    taken = approvals.where("status = 'approved'").join(communities, "cid").select("grp", "id")
    return made.union(taken.join(terms.select("id"), "id", "left_semi").select("grp", "id")).distinct()


def curies_by_name(asked: DataFrame, names: DataFrame, relations: DataFrame, curies: DataFrame) -> DataFrame:
    """(name, prefix, namespace) of what each of ``asked`` (name) stands for.

    A name points to a file or to a release (``names``: name, identity); a file was parsed to a release, a release has conventions
    (``relations``: s, p, o), and conventions have prefixes (``curies``: identity, prefix, namespace).
    """
    start = names.join(asked.select("name").distinct(), "name", "left_semi").select("name", "identity")
    step = lambda df, p: df.join(relations.where(F.col("p") == p).select(F.col("s").alias("identity"), F.col("o").alias("to")), "identity").select("name", F.col("to").alias("identity"))
    releases = start.unionByName(step(start, "parsedTo")).distinct()
    return step(releases, "hasLocalConventions").join(curies, "identity").select("name", "prefix", "namespace").distinct()


def pulls(pulls_: DataFrame, perspectives: DataFrame, groups: DataFrame, reviews: DataFrame, roles: DataFrame, before: str) -> DataFrame:
    """Pulls with the names of both perspectives and their groups, who acted, the review if there is one, and who may act on the target.

    ``pulls_``: (pull, subject, from_p, to_p, actor, status), ``perspectives``: (perspective, name, grp), ``groups``: (grp, group_name),
    ``reviews``: (pull, review, closed), ``roles``: (grp, actor, role).  ``may_act``: the number of actors whose role at the target's group
    ranks before ``before``.
    """
    side = lambda x: perspectives.join(groups, "grp").select(F.col("perspective").alias(f"{x}_p"), F.col("name").alias(f"{x}_name"), F.col("group_name").alias(f"{x}_group"), F.col("grp").alias(f"{x}_grp"))
    who = groups.select(F.col("grp").alias("actor"), F.col("group_name").alias("actor_name"))
    able = roles.where(role_rank(F.col("role")) < ROLES.index(before) + 1).groupBy(F.col("grp").alias("to_grp")).agg(F.count_distinct("actor").alias("may_act"))
    out = pulls_.join(side("from"), "from_p").join(side("to"), "to_p").join(who, "actor").join(reviews, "pull", "left").join(able, "to_grp", "left")
    return out.select("pull", "subject", "from_group", "from_name", "to_group", "to_name", "actor_name", "status", "review", "closed", F.coalesce("may_act", F.lit(0)).alias("may_act"))


def overview(users: DataFrame, roles: DataFrame, groups: DataFrame, emails: DataFrame) -> DataFrame:
    """(uid, name, groups, emails): of each user the groups and roles that it has, best first, and its addresses, primary ones first.

    Lists are made before the join; a user without any has empty ones.
    """
    rows = roles.join(groups, "grp").withColumn("rank", role_rank(F.col("role"))).where(F.col("rank").isNotNull())
    held = rows.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "group_name", "role"))).alias("x")).select("uid", F.transform("x", lambda g: F.concat_ws(":", g["group_name"], g["role"])).alias("groups"))
    mail = emails.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct((~F.col("primary")).alias("k"), "email"))).alias("x")).select("uid", F.col("x.email").alias("emails"))
    none = F.array().cast("array<string>")
    return users.join(held, "uid", "left").join(mail, "uid", "left").select("uid", "name", F.coalesce("groups", none).alias("groups"), F.coalesce("emails", none).alias("emails"))


def contributions(history: DataFrame, perspectives: DataFrame, groups: DataFrame, subjects: DataFrame) -> DataFrame:
    """Distinct records (uid, subject, record, name, group_name, ts) that each user wrote, with their place from the newest on.

    ``history``: (record, perspective, uid, ts), ``subjects``: (record, subject).
    """
    rows = history.join(perspectives, "perspective").join(groups, "grp").join(subjects, "record").select("uid", "subject", "record", "name", "group_name", "ts").distinct()
    place = F.row_number().over(W.partitionBy("uid").orderBy(F.desc("ts"), "subject", "record", "name"))
    return rows.withColumn("place", place)


def free_ontologies(names: DataFrame, relations: DataFrame, references: DataFrame, own_host: str) -> DataFrame:
    """(name, verdict) of bound names off the own host whose file was parsed.

    ``names``: (name, identity, type), ``references``: (expected, grp).  A name that is expected by a reference name counts only if that is
    of the first group; one that none expects counts as it is.
    """
    bound = names.where((F.col("type") == "bound") & (host(F.col("name")) != own_host))
    parsed = bound.join(relations.where("p = 'parsedTo'").select(F.col("s").alias("identity")).distinct(), "identity", "left_semi")
    ref = references.groupBy(F.col("expected").alias("name")).agg(F.bool_or(F.col("grp") == 0).alias("first"))
    return parsed.select("name").distinct().join(ref, "name", "left").where("first or first is null").select("name", F.when(F.col("first"), "of the first group").otherwise("nobody's").alias("verdict"))


def comments(targets: DataFrame, notes: DataFrame, users: DataFrame, perspectives: DataFrame) -> DataFrame:
    """Comments on each target, newest first: target, place, comment, name, perspective's name if it has one.

    ``targets``: (target, perspective), ``notes``: (comment, target, uid, ts, text).
    """
    rows = notes.join(targets, "target").join(users.select("uid", F.col("name").alias("author")), "uid").join(perspectives.select("perspective", F.col("name").alias("seen_as")), "perspective", "left")
    place = F.row_number().over(W.partitionBy("target").orderBy(F.desc("ts"), F.desc("comment")))
    return rows.select("target", place.alias("place"), "comment", "author", "seen_as", "text")


def roles_of(roles: DataFrame, groups: DataFrame) -> DataFrame:
    """(kind, grp, other, role): roles that a group has granted, and those that it holds; a removed role is none."""
    name = lambda k, c: groups.select(F.col("grp").alias(k), F.col("group_name").alias(c))
    rows = roles.where("role <> 'deleted'").join(name("grp", "giver"), "grp").join(name("actor", "holder"), "actor")
    return rows.select(F.lit("granted").alias("kind"), F.col("giver").alias("grp"), F.col("holder").alias("other"), "role").unionByName(
        rows.select(F.lit("held").alias("kind"), F.col("holder").alias("grp"), F.col("giver").alias("other"), "role"))


def redirects(asked: DataFrame, curies: DataFrame, existing: DataFrame, base: int = 0) -> DataFrame:
    """For each of ``asked`` (grp, curie): the iri, and the term that it stands for if there is one.

    The group's own meaning of a prefix comes before the base's (``curies``: grp, prefix, namespace), the group's own map of an iri to a term
    before the base's (``existing``: grp, iri, term).  ``status``: term, iri, or unknown prefix.
    """
    q = asked.select("grp", "curie").distinct().withColumn("prefix", F.split("curie", ":")[0]).withColumn("suffix", F.expr("substring(curie, instr(curie, ':') + 1)"))
    own = q.join(curies, ["grp", "prefix"], "left").withColumnRenamed("namespace", "own")
    low = curies.where(F.col("grp") == base).select("prefix", F.col("namespace").alias("low"))
    iri = own.join(low, "prefix", "left").withColumn("iri", F.concat(F.coalesce("own", "low"), "suffix"))
    mine = iri.join(existing.select("grp", "iri", F.col("term").alias("my_term")), ["grp", "iri"], "left")
    both = mine.join(existing.where(F.col("grp") == base).select("iri", F.col("term").alias("base_term")), "iri", "left")
    term = F.coalesce("my_term", "base_term")
    best = both.groupBy("grp", "curie").agg(F.min(F.struct(F.col("my_term").isNull().alias("k"), term.alias("term"), "iri")).alias("x"))
    return best.select("grp", "curie", "x.iri", "x.term", F.when(F.col("x.term").isNotNull(), "term").when(F.col("x.iri").isNotNull(), "iri").otherwise("unknown prefix").alias("status"))


def user_iris(iris: DataFrame, groups: DataFrame, perspectives: DataFrame, base: str) -> DataFrame:
    """(iri, group_name, path, perspective, error) of iris of the own host: ``base``, a group, ``uris`` and a path.

    An iri that isn't under ``uris``, has no path, or whose group or default perspective is unknown is an error.
    """
    rest = F.when(F.col("iri").startswith(base), F.expr(f"substring(iri, {len(base) + 1})"))
    rows = iris.select("iri", F.split(rest, "/", 3).alias("x"))
    rows = rows.select("iri", F.get("x", F.lit(0)).alias("group_name"), F.get("x", F.lit(1)).alias("kind"), F.get("x", F.lit(2)).alias("path"))
    own = perspectives.where("is_default").groupBy("grp").agg(F.min("perspective").alias("perspective"))
    rows = rows.join(groups, "group_name", "left").join(own, "grp", "left")
    error = F.when(F.col("group_name").isNull(), "other host").when(~F.col("kind").eqNullSafe(F.lit("uris")), "not under uris").when(F.coalesce("path", F.lit("")) == "", "no path").when(F.col("grp").isNull(), "unknown group").when(F.col("perspective").isNull(), "no perspective")
    return rows.select("iri", "group_name", "path", "perspective", error.alias("error"))


def by_path(asked: DataFrame, mapped: DataFrame, raw: DataFrame, may_read: DataFrame) -> DataFrame:
    """For each of ``asked`` (grp, path, reader): the term that the path is mapped to, else the group's own record for readers that may see it.

    ``mapped``: (grp, path, term), ``raw``: (grp, path, record), ``may_read``: (grp, reader).  ``status``: term, record, private, or none.
    """
    out = asked.join(mapped, ["grp", "path"], "left").join(raw, ["grp", "path"], "left").join(may_read.distinct().withColumn("ok", F.lit(True)), ["grp", "reader"], "left")
    ok: Column = (F.col("grp") == F.col("reader")) | F.coalesce("ok", F.lit(False))
    status = F.when(F.col("term").isNotNull(), "term").when(F.col("record").isNull(), "none").when(ok, "record").otherwise("private")
    return out.withColumn("status", status).select("grp", "path", "reader", "term", F.when(F.col("status") == "record", F.col("record")).alias("record"), "status")


def names_seen(names: DataFrame, bindings: DataFrame, identities: DataFrame) -> DataFrame:
    """(name, n, first, latest): how many identities each name stood for, and when the first and the latest of them was first seen.

    Names without any have nulls; bindings to unknown identities don't count.
    """
    seen = bindings.select("name", "identity").distinct().join(identities.select("identity", "first_seen"), "identity")
    span = seen.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("first_seen").alias("first"), F.max("first_seen").alias("latest"))
    return names.select("name").distinct().join(span, "name", "left").fillna(0, ["n"])


def exact_labels(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows (prefix, id, p, o_lit) of the registry whose string is one of ``asked`` (string), letter by letter."""
    return registry.join(asked.select(F.col("string").alias("o_lit")).distinct(), "o_lit", "left_semi").select("prefix", "id", "p", "o_lit")


def existing_of(existing: DataFrame, own: str, terms: DataFrame | None = None) -> DataFrame:
    """(term, iri, grp) of the map of existing iris with the terms' own iris; of all, or of ``terms`` (prefix, id) only."""
    rows = existing if terms is None else existing.join(terms.select("prefix", "id").distinct(), ["prefix", "id"], "left_semi")
    return rows.select(F.concat(F.lit(own), "prefix", F.lit("_"), "id").alias("term"), "iri", "grp")


def group_lookup(asked: DataFrame, groups: DataFrame) -> DataFrame:
    """(name, group_name, builtin) of each of ``asked`` (name): groups (group_name, own_role) compare without case; unknown ones have nulls."""
    low = groups.select(F.lower("group_name").alias("low"), "group_name", (F.col("own_role") == "builtin").alias("builtin"))
    return asked.select("name").distinct().withColumn("low", F.lower("name")).join(low, "low", "left").select("name", "group_name", "builtin")


def annotations(triples: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, s, note_p, note): rows (id, s, ...) with the notes on them, whose blank subject is the row's id (``notes``: s_blank, p, o_lit)."""
    return triples.join(notes.select(F.col("s_blank").alias("id"), F.col("p").alias("note_p"), F.col("o_lit").alias("note")), "id").select("id", "s", "note_p", "note")


def quotas_of(users: DataFrame, own: DataFrame, default: DataFrame) -> DataFrame:
    """(uid, kind, most): of every user and kind the greater of its own quota and the default.  ``own``: (uid, kind, most), ``default``: (kind, most)."""
    kinds = default.select("kind", "most").limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of quotas")
    each = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.most).alias("base")) for r in kinds])
    rows = users.select("uid", F.inline(each))
    return rows.join(own, ["uid", "kind"], "left").select("uid", "kind", F.greatest("base", F.coalesce("most", "base")).alias("most"))
