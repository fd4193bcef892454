"""Terms that share labels, and existing ids that several terms share, told apart and merged.

Groups of equal labels or iris may hold a large part of all terms, so each is first brought down to one row (its size, its lowest ids) and
joined back; no group is held in one place, and its members are linked to its lowest one instead of to each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut
from .closure import components

TERM_SET, MUSCLE = "TermSet", "(TA98)"


@dataclass
class Deduped:
    labels: DataFrame  # id, label, new_label, branch: every term whose label was shared
    duplicates: DataFrame  # id, target, reason: one target for each id, lower than it
    removed: DataFrame  # id, target: known duplicates that contradict these


def name(prefix: Column, key: Column) -> Column:
    return F.concat(F.upper(prefix), F.lit(":"), key.cast("string"))


def targets(links: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, target): for every id of ``links`` (id, target) the lowest live term of its component, or its lowest term if none is live."""
    comp = cut(components(links.toDF("a", "b")).withColumnsRenamed({"node": "id"}))
    live = terms.select("id", (F.col("status") == "0").alias("live"))
    low = comp.join(live, "id", "left").groupBy("comp").agg(F.coalesce(F.min(F.when(F.col("live"), F.col("id"))), F.min("id")).alias("target"))
    return comp.join(low, "comp").select("id", "target")


def dedupe(terms: DataFrame, known: DataFrame, overrides: DataFrame, suffixes: DataFrame, fixed: DataFrame, users: DataFrame, synonyms: DataFrame) -> Deduped:
    """Labels that several terms share made apart.

    ``terms``: id, prefix (tx, cde or pde), label, type, status ("0" live, "-1" deleted, "-2" deprecated), owner, superclass.  Tables of
    exceptions: ``overrides`` (id, new), ``suffixes`` (superclass, suffix), ``fixed`` (low, fixed: a label's one target), ``users``
    (owner, user).  ``known`` (id, target) are duplicates so far, ``synonyms`` (id, literal) other names.

    The first rule that holds gives the label: an override; a term set; a user's own term; a data element under a known superclass; a label
    with a fixed target; an anatomical term with one synonym of the long form; a duplicate of its component's lowest live term, where a
    component is joined by equal labels and by known duplicates; deprecated or deleted; a data element beside a plain term.  What is still
    equal then gets its own id, but for one that had its label before, or the lowest.
    """
    low = F.lower(F.trim("label"))
    every = terms.where(F.trim("label") != "").withColumn("low", low)
    plain = ~F.col("type").isin("pde", TERM_SET) & (F.col("prefix") != "pde")
    every = every.withColumn("plain", plain).withColumn("tx", plain & (F.col("prefix") == "tx") & ~F.contains("label", F.lit(MUSCLE)))
    sizes = cut(every.groupBy("low").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("plain").alias("n_plain"), F.count_if("tx").alias("n_tx"), F.min(F.when(F.col("tx"), F.col("id"))).alias("first")
    ).where("n > 1"))
    shared = cut(every.join(sizes, "low").join(overrides, "id", "left").join(users, "owner", "left").join(suffixes, "superclass", "left").join(fixed, "low", "left"))
    eligible = F.col("tx") & F.col("new").isNull() & F.col("fixed").isNull()
    # a term to the lowest of its label, and known duplicates of or by any of them
    star = shared.where(eligible & (F.col("n_tx") > 1)).select("id", F.col("first").alias("target"))
    ends = cut(targets(star.unionByName(known.select("id", "target")), terms))
    rows = shared.join(ends, "id", "left")
    is_duplicate = eligible & (F.col("id") > F.col("target"))
    own, other = name(F.col("prefix"), F.col("id")), lambda c: name(F.lit("tx"), F.col(c))
    with_id = F.when(F.col("n_plain") > 2, F.concat(F.lit(" "), own)).otherwise("")
    long_form = synonyms.where(F.col("literal").contains("OF")).groupBy("id").agg(F.count(F.lit(1)).alias("n_long"), F.min("literal").alias("long"))
    rows = rows.join(long_form, "id", "left")
    text = F.trim("label")
    add = lambda *x: F.concat(text, *[F.lit(y) if isinstance(y, str) else y for y in x])
    cases = [
        ("override", F.col("new").isNotNull(), F.col("new")),
        ("term set", (F.col("type") == TERM_SET) & ~F.contains("low", F.lit("(termset)")), add(" (TermSet)")),
        ("user", ((F.col("prefix") == "pde") | (F.col("type") == "pde")) & F.col("user").isNotNull(), add(" (user ", F.col("user"), ")")),
        ("guid", (F.col("prefix") == "pde") | (F.col("type") == "pde"), add(" (guid ", F.coalesce(F.col("owner").cast("string"), F.lit("")), ")")),
        ("superclass", (F.col("prefix") == "cde") & F.col("suffix").isNotNull(), add(" (", F.col("suffix"), ")")),
        ("fixed", F.col("fixed").isNotNull() & (F.col("id") != F.col("fixed")), add(" ", own, " (duplicateOf ", other("fixed"), ")")),
        ("long form", F.contains("label", F.lit(MUSCLE)) & (F.col("n_long") == 1), F.concat("long", F.lit(f" {MUSCLE}"))),
        ("anatomy", F.contains("label", F.lit(MUSCLE)), text),
        ("duplicate", is_duplicate, add(with_id, " (duplicateOf ", other("target"), ")")),
        ("deprecated", F.col("status") == "-2", add(" (deprecated)")), ("deleted", F.col("status") == "-1", add(" (deleted)")),
        ("data element", (F.col("prefix") == "cde") & (F.col("n_tx") > 0), add(" (CDE)")),
    ]
    branch = new = None
    for what, when, value in cases:
        branch = F.when(when, what) if branch is None else branch.when(when, what)
        new = F.when(when, value) if new is None else new.when(when, value)
    made = rows.select("id", "prefix", "label", new.otherwise(text).alias("new_label"), branch.otherwise("kept").alias("branch"))
    alone = every.join(sizes, "low", "left_anti").select("id", "prefix", "label", F.trim("label").alias("new_label"), F.lit("alone").alias("branch"))
    labels = apart(cut(made.unionByName(alone))).where("branch <> 'alone'").select("id", "label", "new_label", "branch")

    by_fixed = shared.where(F.col("new").isNull() & F.col("fixed").isNotNull() & (F.col("id") > F.col("fixed"))).select("id", F.col("fixed").alias("target"), F.lit("fixed").alias("reason"))
    by_label = rows.where(is_duplicate).select("id", "target", F.lit("label").alias("reason"))
    known_ends = known.select("id").distinct().join(ends, "id").where("id > target").select("id", "target", F.lit("known").alias("reason"))
    order = F.when(F.col("reason") == "fixed", 0).when(F.col("reason") == "label", 1).otherwise(2)
    pairs = by_fixed.unionByName(by_label).unionByName(known_ends).groupBy("id").agg(F.min(F.struct(order.alias("k"), "reason", "target")).alias("x"))
    pairs = cut(pairs.select("id", "x.target", "x.reason"))
    ends = _roots(pairs.select("id", "target")).withColumnRenamed("root", "target")  # a fixed target may be a duplicate itself
    pairs = cut(pairs.drop("target").join(ends, "id").select("id", "target", "reason"))
    removed = known.select("id", "target").distinct().join(pairs.select("id", "target"), ["id", "target"], "left_anti")
    return Deduped(labels, pairs, removed)


def apart(labels: DataFrame) -> DataFrame:
    """``labels`` (id, prefix, label, new_label, branch) with ids added, round by round, where new labels are still equal without case."""
    while True:
        low = F.lower("new_label")
        changed = (F.col("new_label") != F.trim("label")).cast("int")
        keeps = labels.groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(changed.alias("c"), "id")).alias("x")).where("n > 1")
        keeps = cut(keeps.select("low", F.col("x.id").alias("keeps")))
        if keeps.isEmpty():
            return labels
        more = F.col("keeps").isNotNull() & (F.col("keeps") != F.col("id"))
        labels = cut(labels.withColumn("low", low).join(keeps, "low", "left").select(
            "id", "prefix", "label", F.when(more, F.concat("new_label", F.lit(" "), name(F.col("prefix"), F.col("id")))).otherwise(F.col("new_label")).alias("new_label"),
            F.when(more, F.concat("branch", F.lit(", own id"))).otherwise(F.col("branch")).alias("branch"),
        ))


def dedupe_faults(done: Deduped) -> DataFrame:
    """(rule, n): how many rows break each condition that must hold afterwards; all are 0."""
    one = lambda rule, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
    several = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    d = done.duplicates
    return (
        one("labels are unique", several(done.labels, F.lower("new_label"))).unionByName(one("pairs are unique", several(d, "id", "target")))
        .unionByName(one("one target", several(d, "id"))).unionByName(one("target is lower", d.where("target >= id")))
        .unionByName(one("a target is no duplicate", d.select(F.col("target").alias("id")).join(d.select("id"), "id", "left_semi")))
    )


# --- existing ids ---------------------------------------------------------------------------------------------------------

@dataclass
class Culled:
    rows: DataFrame  # tid, iri, curie, version, fixed (the iri as it is kept), verdict
    pairs: DataFrame  # id, target, kind: duplicateOf or replacedBy


def _roots(pairs: DataFrame) -> DataFrame:
    """(id, root) for pairs (id, target), the lowest target of each id followed to its end; targets are lower, so chains end."""
    at = cut(pairs.groupBy("id").agg(F.min("target").alias("root")))
    while True:
        far = at.join(at.select(F.col("id").alias("root"), F.col("root").alias("far")), "root", "left")
        new = cut(far.select("id", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        at = new.select("id", "root")
        if new.where("moved").isEmpty():
            return at


def cull(existing: DataFrame, terms: DataFrame, base: str, own: str, obsolete: str = r"obsolete\.example/", fixable: str = r"^https?://[^ ]*/TOP", ignore: tuple[int, ...] = ()) -> Culled:
    """A verdict for each existing id (tid, iri, curie, version) of ``terms`` (id, prefix, status, tx), and what follows of duplicates.

    ``base``: beginning of the iris of terms, ``own``: of all iris of this host; ``obsolete`` and ``fixable`` are patterns of iris that go
    and of iris whose spaces are mended.  Dead terms in ``ignore`` count as live.

    Several terms with one iri: of dead and live ones the dead ones' rows go and each becomes a duplicate of the live one, if after merging
    what is known to be one term a single live one is left; several such make a conflict.  Iris of another term of the own host say that one
    of the two is a duplicate of the other (the higher of the lower) or, for data elements, replaced by it.  New pairs can settle conflicts,
    so this goes on until no pair is new.
    """
    rows = existing.select("tid", "iri", "curie", F.coalesce("version", F.lit(0)).alias("version"))
    state = terms.select(F.col("id").alias("tid"), "prefix", (F.col("status").isin("-1", "-2") & ~F.col("id").isin(list(ignore))).alias("dead"))
    newest = rows.groupBy("tid").agg(F.max("version").alias("newest"))
    trimmed = F.regexp_replace("iri", ";$", "")
    fixed = F.when(F.col("iri").rlike(r"\s") & F.col("iri").rlike(fixable), F.replace(F.replace(F.replace(trimmed, F.lit(" "), F.lit("%20")), F.lit("["), F.lit("%5B")), F.lit("]"), F.lit("%5D"))).otherwise(trimmed)
    one = rows.groupBy("tid", "iri", "curie", "version").agg(F.count(F.lit(1)).alias("copies"))
    lowest = rows.groupBy("tid", "iri", "version").agg(F.min("curie").alias("lowest"))
    one = one.join(lowest, ["tid", "iri", "version"]).join(newest, "tid").join(state, "tid", "left").withColumn("fixed", fixed)
    ids = terms.select(F.concat(F.lit(base), "tx").alias("fixed"), F.col("id").alias("names"))
    one = one.join(ids, "fixed", "left")
    first = (
        F.when(F.col("fixed").rlike(r"\s"), "bad iri").when(F.col("version") < F.col("newest"), "stale version").when(F.col("curie") != F.col("lowest"), "several curies")
        .when(F.col("names") == F.col("tid"), "self").when(F.col("fixed").rlike(obsolete), "obsolete")
    )
    one = cut(one.withColumn("verdict", first))
    active = one.where("verdict is null")
    # a term's row with another term's own iri: the higher id is the duplicate, whichever way it is said
    other = active.where("names is not null and not coalesce(dead, false)")
    replaced = other.where("prefix = 'cde'").select(F.col("names").alias("id"), F.col("tid").alias("target")).distinct()
    said = other.where("prefix <> 'cde'").select(F.greatest("names", "tid").alias("id"), F.least("names", "tid").alias("target")).distinct()
    users = active.where("names is null").select("fixed", "tid", F.coalesce("dead", F.lit(False)).alias("dead")).distinct()
    by_iri = users.groupBy("fixed").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    many = cut(users.join(by_iri.select("fixed"), "fixed", "left_semi"))
    pairs, before = cut(said), -1
    while True:
        found = pairs.count()
        if found == before:
            break
        before = found
        root = cut(_roots(pairs))
        live = many.where("not dead").join(root.withColumnRenamed("id", "tid"), "tid", "left").select("fixed", F.coalesce("root", "tid").alias("root")).distinct()
        ends = cut(live.groupBy("fixed").agg(F.count(F.lit(1)).alias("k"), F.min("root").alias("root")))
        new = many.where("dead").join(ends.where("k = 1"), "fixed").where("root < tid").select(F.col("tid").alias("id"), F.col("root").alias("target")).distinct()
        pairs = cut(said.unionByName(new).distinct())
    settled = many.select("fixed", "tid", "dead").join(ends.withColumnRenamed("root", "end"), "fixed", "left").join(root.withColumnsRenamed({"id": "tid", "root": "own"}), "tid", "left")
    settled = settled.select("fixed", "tid", F.when(F.col("dead"), "dead duplicate").when(F.col("k") > 1, "conflict").when(F.coalesce("own", "tid") != F.col("tid"), "merged").alias("settled"))
    last = F.when(F.col("names").isNotNull() & (F.col("prefix") == "cde"), "base: replacedBy").when(F.col("names").isNotNull(), "base: duplicateOf").when(F.col("fixed").startswith(own), "user").otherwise("external")
    out = one.join(settled, ["fixed", "tid"], "left").withColumn("verdict", F.coalesce("verdict", F.when(F.col("names").isNull(), F.col("settled")), last))
    kept = out.select("tid", "iri", "curie", "version", "fixed", "verdict")
    copies = one.where("copies > 1").select("tid", "iri", "curie", "version", "fixed", F.explode(F.array_repeat(F.lit("repeated"), (F.col("copies") - 1).cast("int"))).alias("verdict"))
    kinds = pairs.select("id", "target", F.lit("duplicateOf").alias("kind")).unionByName(replaced.select("id", "target", F.lit("replacedBy").alias("kind")))
    return Culled(kept.unionByName(copies), kinds)


def not_injective(culled: Culled) -> DataFrame:
    """(kind, key, n): kept iris of several terms, and terms with several targets of one kind."""
    keep = culled.rows.where("verdict in ('external', 'user')").select("tid", "fixed").distinct()
    a = keep.groupBy(F.col("fixed").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("iri of several terms").alias("kind"), "key", "n")
    b = culled.pairs.groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.concat(F.lit("several targets: "), "kind").alias("kind"), F.col("id").cast("string").alias("key"), "n")
    return a.unionByName(b)
