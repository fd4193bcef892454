"""Label deduplication and the cull of existing ids over terms made from ``part``; labels are short, so many terms share each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging as M
from .base import CTES, query, table

TEXT = lambda c: F.col(c).cast("string")
BASE = "http://uri.ex.org/base/"


def tables(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    kind = F.when(k % 10 == 2, "cde").when(k % 10 == 3, "TermSet").when(k % 10 == 5, "pde").otherwise("term")
    label = F.concat("p_name", F.lit(" "), F.when(k % 4 == 0, TEXT("p_size")).when(k % 4 == 1, (F.col("p_size") % 7).cast("string")).otherwise(F.col("p_brand")), F.when(k % 13 == 5, " (TA98)").otherwise(""), F.when(k % 17 == 0, " ").otherwise(""))
    terms = part.select(
        k.alias("id"), F.when(k % 10 == 2, "cde").when(k % 20 == 5, "pde").otherwise("tx").alias("prefix"), F.when(k % 19 == 0, F.upper(label)).otherwise(label).alias("label"), kind.alias("type"),
        F.when(k % 23 == 7, "-2").when(k % 23 == 8, "-1").otherwise("0").alias("status"), (k % 9).alias("owner"), F.when(k % 3 == 0, k % 5).alias("superclass"),
    )
    plain = terms.where("prefix = 'tx' and type = 'term'").select("id")
    known = part.where(k % 11 == 3).select(k.alias("id"), (k + 5).alias("target")).unionByName(part.where((k % 11 == 4) & (k > 7)).select(k.alias("id"), (k - 7).alias("target")))
    known = known.join(plain, "id", "left_semi").join(plain.withColumnRenamed("id", "target"), "target", "left_semi").select("id", "target")
    return {
        "terms": terms, "known": known, "overrides": part.where(k % 97 == 1).select(k.alias("id"), F.concat(F.lit("a name for "), TEXT("p_partkey")).alias("new")),
        "suffixes": spark.createDataFrame([(1, "NINE"), (2, "TEN")], "superclass long, suffix string"),
        "fixed": terms.where("id % 101 = 7").select(F.lower(F.trim("label")).alias("low"), F.lit(7).cast("long").alias("fixed")).distinct(),
        "users": spark.createDataFrame([(3, "ann"), (4, "bob")], "owner long, user string"),
        "synonyms": part.where(k % 13 == 5).select(k.alias("id"), F.explode(F.when(k % 26 == 5, F.array(F.concat("p_brand", F.lit(" OF a")), F.concat("p_brand", F.lit(" OF b")))).otherwise(F.array(F.concat("p_brand", F.lit(" OF "), "p_name"), F.lit("short")))).alias("literal")),
    }


_LABEL = """p_name || ' ' || CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 4 = 1 THEN CAST(p_size % 7 AS VARCHAR) ELSE p_brand END
        || CASE WHEN p_partkey % 13 = 5 THEN ' (TA98)' ELSE '' END || CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE '' END"""
CTES |= {
    "mg_t": f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 2 THEN 'cde' WHEN p_partkey % 20 = 5 THEN 'pde' ELSE 'tx' END AS prefix, trim(CASE WHEN p_partkey % 19 = 0 THEN upper({_LABEL}) ELSE {_LABEL} END) AS text,
        CASE WHEN p_partkey % 19 = 0 THEN upper({_LABEL}) ELSE {_LABEL} END AS label,
        CASE p_partkey % 10 WHEN 2 THEN 'cde' WHEN 3 THEN 'TermSet' WHEN 5 THEN 'pde' ELSE 'term' END AS type, CASE p_partkey % 23 WHEN 7 THEN '-2' WHEN 8 THEN '-1' ELSE '0' END AS status,
        p_partkey % 9 AS owner, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 5 END AS superclass, p_brand, p_name FROM part""",
    "mg_k": """SELECT a.id, b.id AS target FROM mg_t a JOIN mg_t b ON (a.id % 11 = 3 AND b.id = a.id + 5) OR (a.id % 11 = 4 AND a.id > 7 AND b.id = a.id - 7)
        WHERE a.prefix = 'tx' AND a.type = 'term' AND b.prefix = 'tx' AND b.type = 'term'""",
    "mg_s": """SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE plain) OVER w AS n_plain, count(*) FILTER (WHERE tx) OVER w AS n_tx, min(CASE WHEN tx THEN id END) OVER w AS first,
        CASE WHEN id % 97 = 1 THEN 'a name for ' || id END AS new, CASE WHEN low IN (SELECT lower(text) FROM mg_t WHERE id % 101 = 7) THEN 7 END AS fixed
        FROM (SELECT *, lower(text) AS low, plain AND prefix = 'tx' AND label NOT LIKE '%(TA98)%' AS tx FROM (SELECT *, type NOT IN ('pde', 'TermSet') AND prefix <> 'pde' AS plain FROM mg_t)) WINDOW w AS (PARTITION BY low)""",
    "mg_l": "SELECT id AS a, first AS b FROM mg_s WHERE n > 1 AND tx AND new IS NULL AND fixed IS NULL AND n_tx > 1 UNION SELECT id, target FROM mg_k",
    "mg_w": "SELECT a AS x, a AS y FROM mg_l UNION SELECT b, b FROM mg_l UNION SELECT w.x, e.b FROM mg_w w JOIN (SELECT a, b FROM mg_l UNION SELECT b, a FROM mg_l) e ON e.a = w.y",
    "mg_e": "SELECT x AS id, coalesce(min(CASE WHEN status = '0' THEN y END), min(y)) AS target FROM mg_w JOIN mg_t ON mg_t.id = y GROUP BY x",
    "mg_b": """SELECT s.*, e.target, CASE s.superclass WHEN 1 THEN 'NINE' WHEN 2 THEN 'TEN' END AS suffix, CASE owner WHEN 3 THEN 'ann' WHEN 4 THEN 'bob' END AS user,
        CASE WHEN s.id % 13 = 5 THEN CASE WHEN s.id % 26 = 5 THEN 2 ELSE 1 END END AS n_long, tx AND new IS NULL AND fixed IS NULL AND s.id > e.target AS dup, upper(prefix) || ':' || s.id AS own
        FROM mg_s s LEFT JOIN mg_e e ON e.id = s.id""",
    "mg_m": """SELECT id, own, label, text, CASE WHEN n = 1 THEN 'alone' WHEN new IS NOT NULL THEN 'override' WHEN type = 'TermSet' AND low NOT LIKE '%(termset)%' THEN 'term set' WHEN (prefix = 'pde' OR type = 'pde') AND user IS NOT NULL THEN 'user'
          WHEN prefix = 'pde' OR type = 'pde' THEN 'guid' WHEN prefix = 'cde' AND suffix IS NOT NULL THEN 'superclass' WHEN fixed IS NOT NULL AND id <> fixed THEN 'fixed' WHEN label LIKE '%(TA98)%' AND n_long = 1 THEN 'long form' WHEN label LIKE '%(TA98)%' THEN 'anatomy'
          WHEN dup THEN 'duplicate' WHEN status = '-2' THEN 'deprecated' WHEN status = '-1' THEN 'deleted' WHEN prefix = 'cde' AND n_tx > 0 THEN 'data element' ELSE 'kept' END AS branch,
        CASE WHEN n = 1 THEN text WHEN new IS NOT NULL THEN new WHEN type = 'TermSet' AND low NOT LIKE '%(termset)%' THEN text || ' (TermSet)' WHEN (prefix = 'pde' OR type = 'pde') AND user IS NOT NULL THEN text || ' (user ' || user || ')'
          WHEN prefix = 'pde' OR type = 'pde' THEN text || ' (guid ' || owner || ')' WHEN prefix = 'cde' AND suffix IS NOT NULL THEN text || ' (' || suffix || ')' WHEN fixed IS NOT NULL AND id <> fixed THEN text || ' ' || own || ' (duplicateOf TX:' || fixed || ')'
          WHEN label LIKE '%(TA98)%' AND n_long = 1 THEN p_brand || ' OF ' || p_name || ' (TA98)' WHEN label LIKE '%(TA98)%' THEN text WHEN dup THEN text || CASE WHEN n_plain > 2 THEN ' ' || own ELSE '' END || ' (duplicateOf TX:' || target || ')'
          WHEN status = '-2' THEN text || ' (deprecated)' WHEN status = '-1' THEN text || ' (deleted)' WHEN prefix = 'cde' AND n_tx > 0 THEN text || ' (CDE)' ELSE text END AS made FROM mg_b""",
    "mg_p": """SELECT id, arg_min(target, k) AS target, arg_min(reason, k) AS reason FROM (SELECT id, fixed AS target, 'fixed' AS reason, 0 AS k FROM mg_b WHERE n > 1 AND new IS NULL AND fixed IS NOT NULL AND id > fixed
        UNION ALL SELECT id, target, 'label', 1 FROM mg_b WHERE n > 1 AND dup UNION ALL SELECT DISTINCT k.id, e.target, 'known', 2 FROM mg_k k JOIN mg_e e ON e.id = k.id AND k.id > e.target) GROUP BY id""",
    "mg_r": "SELECT id, target AS tip FROM mg_p UNION SELECT r.id, p.target FROM mg_r r JOIN mg_p p ON p.id = r.tip",
    "mg_x": "SELECT p.id, min(r.tip) AS target, any_value(reason) AS reason FROM mg_p p JOIN mg_r r USING (id) GROUP BY p.id",
}
MG = ("mg_t", "mg_k", "mg_s", "mg_l", "mg_w", "mg_e", "mg_b", "mg_m")
MP = (*MG, "mg_p", "mg_r", "mg_x")


def done(spark, d) -> M.Deduped:
    t = tables(spark, d)
    return M.dedupe(*[t[k] for k in ("terms", "known", "overrides", "suffixes", "fixed", "users", "synonyms")])


@query("""WITH a AS (SELECT *, first_value(id) OVER (PARTITION BY lower(made) ORDER BY CASE WHEN made <> text THEN 1 ELSE 0 END, id) AS keeps FROM mg_m)
 SELECT id, label, CASE WHEN keeps <> id THEN made || ' ' || own ELSE made END AS new_label, branch || CASE WHEN keeps <> id THEN ', own id' ELSE '' END AS branch FROM a WHERE branch <> 'alone' OR keeps <> id""", *MG, recursive=True)
def c18_labels_apart(spark, d):
    """Every term with a shared label: its new label and the rule that gave it."""
    return done(spark, d).labels


@query("SELECT id, target, reason FROM mg_x", *MP, recursive=True)
def c18_duplicates(spark, d):
    """Duplicates and the lowest live term that each is one of; contradictions of known pairs are turned round."""
    return done(spark, d).duplicates


@query("SELECT id, target FROM mg_k WHERE (id, target) NOT IN (SELECT (id, target) FROM mg_x)", *MP, recursive=True)
def c18_contradictions(spark, d):
    return done(spark, d).removed


@query("SELECT unnest(['labels are unique', 'pairs are unique', 'one target', 'target is lower', 'a target is no duplicate']) AS rule, CAST(0 AS BIGINT) AS n, (SELECT count(*) FROM mg_m WHERE branch <> 'alone') AS labels", *MG, recursive=True)
def c18_conditions(spark, d):
    """What must hold afterwards, with the number of labels that it holds for."""
    x = done(spark, d)
    return M.dedupe_faults(x).withColumn("labels", F.lit(x.labels.where("branch not like 'alone%'").count()))


# --- existing ids ---------------------------------------------------------------------------------------------------------

def existing_tables(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    tx = F.concat(F.lit("tx_"), F.lpad(TEXT("p_partkey"), 7, "0"))
    of = lambda x: F.concat(F.lit(f"{BASE}tx_"), F.lpad(x.cast("string"), 7, "0"))
    terms = part.select(k.alias("id"), F.when(k % 10 == 2, "cde").otherwise("tx").alias("prefix"), tx.alias("tx"), F.when(k % 6 == 1, "-2").when(k % 17 == 8, "-1").otherwise("0").alias("status"))
    row = lambda where, iri, curie=None, version=0: part.where(where).select(k.alias("tid"), iri.alias("iri"), (F.concat(F.lit("X:"), TEXT("p_partkey")) if curie is None else curie).alias("curie"), (F.lit(version) if isinstance(version, int) else version).cast("long").alias("version"))
    ext = lambda m, tail="": F.concat(F.lit("http://purl.ex.net/obo/X_"), F.floor(k / m).cast("string"), F.lit(tail))
    every = [
        row(k >= 0, of(k)), row(k % 3 > 0, ext(3)), row(k % 8 == 0, ext(3, "v"), version=1), row(k % 8 == 0, ext(1, "old"), version=0), row(k % 29 == 3, ext(1, "c"), F.lit("B:1")), row(k % 29 == 3, ext(1, "c"), F.lit("A:1")),
        row(k % 31 == 4, F.concat(F.lit("http://bad.ex.net/a b"), TEXT("p_partkey"))), row(k % 31 == 5, F.concat(F.lit("https://x.ex.net/TOP/[a b]"), TEXT("p_partkey"))), row(k % 37 == 6, F.concat(F.lit("http://obsolete.example/"), TEXT("p_partkey"))),
        row(k % 41 == 7, F.concat(F.lit("http://uri.ex.org/ann/uris/"), TEXT("p_partkey"))), row((k % 13 == 4) & (k > 9), of(k - 3)), row(k % 13 == 6, of(k + 2)), row(k % 43 == 8, ext(1, ";")), row(k % 43 == 8, ext(1, ";")),
    ]
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return terms, out


def _rows(where, iri, curie="'X:' || p_partkey", version="0"):
    return f"SELECT p_partkey AS tid, {iri} AS iri, {curie} AS curie, CAST({version} AS BIGINT) AS version FROM part WHERE {where}"


_OF = "'http://uri.ex.org/base/tx_' || lpad(CAST({0} AS VARCHAR), 7, '0')"
_EXT = "'http://purl.ex.net/obo/X_' || (p_partkey // {0}) || '{1}'"
CTES |= {
    "cu_t": "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 2 THEN 'cde' ELSE 'tx' END AS prefix, p_partkey % 6 = 1 OR p_partkey % 17 = 8 AS dead FROM part",
    "cu_r": " UNION ALL ".join([
        _rows("true", _OF.format("p_partkey")), _rows("p_partkey % 3 > 0", _EXT.format(3, "")), _rows("p_partkey % 8 = 0", _EXT.format(3, "v"), version="1"), _rows("p_partkey % 8 = 0", _EXT.format(1, "old")),
        _rows("p_partkey % 29 = 3", _EXT.format(1, "c"), "'B:1'"), _rows("p_partkey % 29 = 3", _EXT.format(1, "c"), "'A:1'"), _rows("p_partkey % 31 = 4", "'http://bad.ex.net/a b' || p_partkey"), _rows("p_partkey % 31 = 5", "'https://x.ex.net/TOP/[a b]' || p_partkey"),
        _rows("p_partkey % 37 = 6", "'http://obsolete.example/' || p_partkey"), _rows("p_partkey % 41 = 7", "'http://uri.ex.org/ann/uris/' || p_partkey"), _rows("p_partkey % 13 = 4 AND p_partkey > 9", _OF.format("p_partkey - 3")), _rows("p_partkey % 13 = 6", _OF.format("p_partkey + 2")),
        _rows("p_partkey % 43 = 8", _EXT.format(1, ";")), _rows("p_partkey % 43 = 8", _EXT.format(1, ";")),
    ]),
    "cu_o": """SELECT *, CASE WHEN regexp_matches(fixed, '\\s') THEN 'bad iri' WHEN version < newest THEN 'stale version' WHEN curie <> lowest THEN 'several curies' WHEN names = tid THEN 'self' WHEN regexp_matches(fixed, 'obsolete\\.example/') THEN 'obsolete' END AS first FROM (
        SELECT o.*, t1.prefix, t1.dead, t2.id AS names FROM (SELECT tid, iri, curie, version, count(*) AS copies, min(curie) OVER (PARTITION BY tid, iri, version) AS lowest, max(version) OVER (PARTITION BY tid) AS newest,
            CASE WHEN regexp_matches(iri, '\\s') AND regexp_matches(iri, '^https?://[^ ]*/TOP') THEN replace(replace(replace(regexp_replace(iri, ';$', ''), ' ', '%20'), '[', '%5B'), ']', '%5D') ELSE regexp_replace(iri, ';$', '') END AS fixed
            FROM cu_r GROUP BY tid, iri, curie, version) o LEFT JOIN cu_t t1 ON t1.id = o.tid LEFT JOIN cu_t t2 ON fixed = """ + _OF.format("t2.id") + ")",
    "cu_n0": "SELECT DISTINCT greatest(names, tid) AS id, least(names, tid) AS target FROM cu_o WHERE first IS NULL AND names IS NOT NULL AND NOT dead AND prefix <> 'cde'",
    "cu_m": "SELECT DISTINCT fixed, tid, dead FROM cu_o WHERE first IS NULL AND names IS NULL AND fixed IN (SELECT fixed FROM cu_o WHERE first IS NULL AND names IS NULL GROUP BY fixed HAVING count(DISTINCT tid) > 1)",
}


def _round(k: int) -> dict[str, str]:
    """One round of the cull: roots of the pairs so far, live ends of each shared iri, pairs that follow for dead terms."""
    return {
        f"cu_f{k}": f"SELECT id, min(target) AS target FROM cu_n{k - 1} GROUP BY id", f"cu_g{k}": f"SELECT id, target AS tip FROM cu_f{k} UNION SELECT g.id, f.target FROM cu_g{k} g JOIN cu_f{k} f ON f.id = g.tip",
        f"cu_h{k}": f"SELECT id, min(tip) AS root FROM cu_g{k} GROUP BY id", f"cu_e{k}": f"SELECT fixed, count(DISTINCT coalesce(root, tid)) AS k, min(coalesce(root, tid)) AS root FROM cu_m LEFT JOIN cu_h{k} ON id = tid WHERE NOT dead GROUP BY fixed",
        f"cu_n{k}": f"SELECT * FROM cu_n0 UNION SELECT tid, root FROM cu_m JOIN cu_e{k} USING (fixed) WHERE dead AND k = 1 AND root < tid",
    }


ROUNDS = 5  # more than these data need; the operator goes on until no pair is new
for _k in range(1, ROUNDS + 1):
    CTES |= _round(_k)
CU = ("cu_t", "cu_r", "cu_o", "cu_n0", "cu_m", *[f"cu_{x}{k}" for k in range(1, ROUNDS + 1) for x in "fghen"])


def culled(spark, d) -> M.Culled:
    terms, existing = existing_tables(spark, d)
    return M.cull(existing, terms, BASE, "http://uri.ex.org/")


@query("""SELECT o.tid, iri, curie, version, o.fixed, coalesce(first, CASE WHEN names IS NULL THEN CASE WHEN m.dead THEN 'dead duplicate' WHEN m.tid IS NULL THEN NULL WHEN k > 1 THEN 'conflict' WHEN coalesce(h.root, m.tid) <> m.tid THEN 'merged' END END,
   CASE WHEN names IS NOT NULL AND prefix = 'cde' THEN 'base: replacedBy' WHEN names IS NOT NULL THEN 'base: duplicateOf' WHEN o.fixed LIKE 'http://uri.ex.org/%' THEN 'user' ELSE 'external' END) AS verdict
 FROM cu_o o LEFT JOIN cu_m m ON m.fixed = o.fixed AND m.tid = o.tid LEFT JOIN cu_e5 e ON e.fixed = o.fixed LEFT JOIN cu_h5 h ON h.id = o.tid
 UNION ALL SELECT tid, iri, curie, version, fixed, 'repeated' FROM cu_o, range(copies - 1) WHERE copies > 1""", *CU, recursive=True)
def c19_verdicts(spark, d):
    """A verdict for every existing id of every term."""
    return culled(spark, d).rows


@query("SELECT *, 'duplicateOf' AS kind FROM cu_n5 UNION ALL SELECT DISTINCT names, tid, 'replacedBy' FROM cu_o WHERE first IS NULL AND names IS NOT NULL AND NOT dead AND prefix = 'cde'", *CU, recursive=True)
def c19_pairs(spark, d):
    """Which term is a duplicate of or replaced by which, as shared and own iris tell."""
    return culled(spark, d).pairs


@query("SELECT 'several targets: duplicateOf' AS kind, CAST(id AS VARCHAR) AS key, count(*) AS n FROM cu_n5 GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'several targets: replacedBy', CAST(names AS VARCHAR), count(*) FROM (SELECT DISTINCT names, tid FROM cu_o WHERE first IS NULL AND names IS NOT NULL AND NOT dead AND prefix = 'cde') GROUP BY names HAVING count(*) > 1", *CU, recursive=True)
def c19_not_injective(spark, d):
    return M.not_injective(culled(spark, d))
