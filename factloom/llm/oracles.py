"""DuckDB SQL for those queries that SQL can express."""

WS = r"[\x20\x09-\x0D]+"

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""

OP2 = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
x AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM d),
y AS (SELECT r, list(p) AS gone FROM x GROUP BY r),
u AS (SELECT w.r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
k AS (SELECT u.r, string_agg(word, ' ' ORDER BY u.p) AS kept FROM u LEFT JOIN x ON x.r = u.r AND x.p = u.p WHERE x.p IS NULL GROUP BY u.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN y USING (r) LEFT JOIN k USING (r)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH w AS (SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 'b', item_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
b AS (SELECT DISTINCT id, len(list_slice(w, i, i + 12)) AS k, array_to_string(list_slice(w, i, i + 12), ' ') AS g
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM w WHERE kind = 'b' AND len(w) > 0)),
k AS (SELECT DISTINCT k FROM b),
d AS (SELECT id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (
  SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, k WHERE kind = 'd' AND len(w) >= k)),
o AS (SELECT d.id, d.i, d.k, b.id AS item FROM d JOIN b ON d.g = b.g AND d.k = b.k),
h AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + k)) AS p FROM o) GROUP BY id),
t AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM o) GROUP BY id)
SELECT w.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM w LEFT JOIN h ON h.id = w.id LEFT JOIN t ON t.id = w.id WHERE kind = 'd'
"""

OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '### ', ''))) // 4
      + (length(text) - length(replace(text, '</turn>', ''))) // 7 + (length(text) - length(replace(text, '<part/>', ''))) // 7 AS body,
    length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, ':', '')) AS rolechars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN before IS NULL THEN 6 + rolechars WHEN before = role THEN 7 ELSE 14 + rolechars END) + 8 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP8 = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, unnest(range(i, i + 5)) AS p, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS n
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM g WHERE n > 1 GROUP BY doc_id),
f AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        coalesce(r.n, 0) AS n_repeat_words, greatest(len(w), 1) AS dw, greatest(len(l), 1) AS dl
      FROM w LEFT JOIN r USING (doc_id)),
m AS (SELECT doc_id, lang, source, n_words, metric, v, CASE WHEN v < 32 THEN v ELSE (v >> (length(bin(v)) - 5)) << (length(bin(v)) - 5) END AS b FROM (
        SELECT doc_id, lang, source, n_words, 'word_length' AS metric, word_chars * 10 // dw AS v FROM f
        UNION ALL SELECT doc_id, lang, source, n_words, 'symbols', n_symbols * 1000 // dw FROM f
        UNION ALL SELECT doc_id, lang, source, n_words, 'dup_lines', n_dup_lines * 1000 // dl FROM f
        UNION ALL SELECT doc_id, lang, source, n_words, 'repeats', n_repeat_words * 1000 // dw FROM f)),
s AS (SELECT 0 AS level, lang, source, metric, b, count(*) AS n FROM m WHERE n_words > 0 GROUP BY ALL
      UNION ALL SELECT 1, lang, NULL, metric, b, count(*) FROM m WHERE n_words > 0 GROUP BY ALL
      UNION ALL SELECT 2, NULL, NULL, metric, b, count(*) FROM m WHERE n_words > 0 GROUP BY ALL),
c AS (SELECT level, lang, source, metric, b, lead(b) OVER w AS nxt, sum(n) OVER w AS upto, sum(n) OVER v AS al, sum(CAST(n AS DOUBLE) * b) OVER w AS s1, sum(CAST(n AS DOUBLE) * b) OVER v AS s, sum(CAST(n AS DOUBLE) * b * b) OVER v AS q
      FROM s WINDOW v AS (PARTITION BY level, lang, source, metric), w AS (PARTITION BY level, lang, source, metric ORDER BY b)),
q AS (SELECT level, lang, source, max(al) AS al, min(b) FILTER (WHERE upto * 100 >= al * 10) AS q10, min(b) FILTER (WHERE upto * 100 >= al * 90) AS q90 FROM c WHERE metric = 'word_length' GROUP BY ALL),
p AS (SELECT *, 3 * greatest(q90 - q10, 1 << greatest(length(bin(q90)) - 5, 0)) AS span FROM q),
x AS (SELECT *, pow(al * s1 - upto * s, 2) / (CAST(upto AS DOUBLE) * (al - upto)) AS between_, al * q - s * s AS whole FROM c WHERE metric <> 'word_length' AND nxt IS NOT NULL),
t AS (SELECT level, lang, source, metric, al, CAST(NULL AS DOUBLE) AS low, CASE WHEN between_ >= 0.85 * whole THEN (b + nxt) / 2 END AS high
      FROM (SELECT *, row_number() OVER (PARTITION BY level, lang, source, metric ORDER BY between_ DESC, b) AS r FROM x) WHERE r = 1
      UNION ALL SELECT level, lang, source, 'word_length', al, CAST(q10 - span AS DOUBLE), CAST(q90 + span AS DOUBLE) FROM p),
u AS (SELECT * FROM t WHERE level = 2 OR al >= 50),
b AS (SELECT m.doc_id, bool_or(CASE WHEN m.metric = 'word_length' THEN v > coalesce(o.high, l.high, w.high) OR v < coalesce(o.low, l.low, w.low)
        ELSE v > round(exp((coalesce(ln(o.high), 0) + coalesce(ln(l.high), 0) + coalesce(ln(w.high), 0)) / nullif((o.high IS NOT NULL)::INT + (l.high IS NOT NULL)::INT + (w.high IS NOT NULL)::INT, 0)), 3) END) AS bad
      FROM m LEFT JOIN u o ON o.level = 0 AND o.metric = m.metric AND o.lang IS NOT DISTINCT FROM m.lang AND o.source IS NOT DISTINCT FROM m.source
        LEFT JOIN u l ON l.level = 1 AND l.metric = m.metric AND l.lang IS NOT DISTINCT FROM m.lang
        LEFT JOIN u w ON w.level = 2 AND w.metric = m.metric GROUP BY m.doc_id),
z AS (SELECT f.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept
FROM z LEFT JOIN b USING (doc_id)
"""

OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
c AS (SELECT doc_id AS a, doc_id AS c FROM w UNION SELECT l.b, c.c FROM c JOIN l ON l.a = c.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.c) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.a = w.doc_id GROUP BY w.doc_id
"""

#: Checksums (crc32): a table of 256 steps, and the checksum of the bytes of a text by it.
_CRC_TABLE = "SELECT list(list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS tab FROM range(256) t(i)"


def _crc(text: str) -> str:
    digits = f"hex(encode({text}))"
    of_byte = f"list_transform(range(length({digits}) // 2), lambda k: CAST('0x' || substr({digits}, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce({of_byte}, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


OP11 = rf"""
WITH RECURSIVE t AS ({_CRC_TABLE}),
r AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
h AS (SELECT w, n, {_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM r, t WHERE length(w) >= 6),
v AS (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM h)
      WHERE length(w) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
x AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
s AS (SELECT DISTINCT x.word AS long, v.word AS short FROM x JOIN v ON v.word = x.a || x.b),
p AS (SELECT x.word, y.word AS other FROM x JOIN x y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
      UNION ALL SELECT long, short FROM s UNION ALL SELECT short, long FROM s),
o AS (SELECT p.word, other, v.n, count(*) OVER (PARTITION BY p.word) AS k, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, other) AS place FROM p JOIN v ON v.word = other),
f AS (SELECT v.word, v.n, coalesce(k, 0) AS n_near, CASE WHEN o.n >= 5 * v.n THEN other END AS form, CASE WHEN o.n >= 5 * v.n THEN o.n END AS form_n
      FROM v LEFT JOIN o ON o.word = v.word AND place = 1),
c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL
"""

_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_UP = "SELECT tree, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM {0} WHERE n > 1 GROUP BY tree, lvl, pos // 8, n"
_STEP = """SELECT f.r, f.tree, f.lvl + 1, f.pos // 8, sha256(array_to_string(list_concat(kids[:f.pos % 8], [f.h], kids[f.pos % 8 + 2:]), '')),
        proof || array_to_string(list_concat(kids[:f.pos % 8], kids[f.pos % 8 + 2:]), '') FROM {0} f JOIN k ON k.tree = f.tree AND k.lvl = f.lvl AND k.up = f.pos // 8"""

OP12 = f"""
WITH RECURSIVE t AS ({_CRC_TABLE}),
d AS (SELECT row_number() OVER () AS r, doc_id, 't' || coalesce('=' || lang, '') AS tree, {_LEAF.format(text="text")} AS leaf,
        CASE WHEN coalesce({_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0, false) THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
        ELSE {_LEAF.format(text="text")} END AS now FROM documents, t),
e AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
a(tree, lvl, pos, n, h) AS (SELECT tree, 0, pos, n, leaf FROM e UNION ALL {_UP.format("a")}),
s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
b(tree, lvl, pos, n, h) AS (SELECT '', 0, pos, n, subroot FROM s UNION ALL {_UP.format("b")}),
k AS (SELECT tree, lvl, pos // 8 AS up, list(h ORDER BY pos) AS kids FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE n > 1 GROUP BY ALL),
f1(r, tree, lvl, pos, h, proof) AS (SELECT r, tree, 0, pos, now, '' FROM e UNION ALL {_STEP.format("f1")}),
g AS (SELECT f1.r, '' AS tree, 0 AS lvl, s.pos, f1.h, f1.proof FROM f1 JOIN a ON a.tree = f1.tree AND a.lvl = f1.lvl AND a.pos = f1.pos AND a.n = 1 JOIN s ON s.tree = f1.tree),
f2(r, tree, lvl, pos, h, proof) AS (SELECT * FROM g UNION ALL {_STEP.format("f2")})
SELECT d.doc_id, d.leaf, s.subroot, w.h AS root, sha256(f2.proof) AS proof_sha256, f2.h AS folded_root, f2.h = w.h AS verified
FROM d JOIN s USING (tree) JOIN (SELECT h, lvl FROM b WHERE n = 1) w ON true JOIN f2 ON f2.r = d.r AND f2.lvl = w.lvl
"""


def _places(kind: int, name: str, form: str, keep: str) -> str:
    """Rows (r, kind, name, a, z) of the matches of a pattern, with places from the lengths of what lies between them."""
    return f"""SELECT r, {kind} AS kind, '{name}' AS name, a, a + length(m) AS z, m, g FROM (
        SELECT r, m[i] AS m, g[i] AS g, CAST(list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
        FROM (SELECT r, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT r, regexp_extract_all(text, {form}) AS m, regexp_extract_all(text, {form}, {2 if kind == 0 else 0}) AS g, regexp_split_to_array(text, {form}) AS p FROM d))) WHERE {keep}"""


_Q = "[\"'']?"  # an optional quote, within SQL quotes
_ASSIGN = rf"'((?i:password|passwd|secret|token|api_?key)){_Q}\x20*[:=]\x20*{_Q}([A-Za-z0-9+/_.=-]+)'"
_CLASSES = "[('[0-9a-f]+', {hex}), ('[0-9A-F]+', {hex}), ('[0-9a-z]+', {one}), ('[0-9A-Z]+', {one}), ('[A-Za-z0-9+/=_-]+', {wide})]"


def _op13() -> str:
    from . import secretscan as s

    bits = {name: s.most(window, least) for name, _, window, least in s.CLASSES}
    classes = _CLASSES.format(hex=bits["hex"], one=bits["one case"], wide=bits["base64"])
    shapes = "|".join(f"(?:{x})" for x in s.ALLOWED_SHAPES)
    listed = ", ".join(f"'{x}'" for x in sorted(s.ALLOWED))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
b AS ({_places(0, "assign", _ASSIGN, "length(g) >= 6")} UNION ALL {_places(1, "access", "'AKIA[A-Z0-9]+'", "length(m) >= 20")} UNION ALL {_places(2, "hex", "'[0-9a-f]+'", "length(m) >= 24")}),
c AS (SELECT r, a, m FROM ({_places(3, "entropy", "'[A-Za-z0-9+/_.=-]+'", "length(m) >= 20")})
      WHERE m NOT IN ({listed}) AND trim(m, '=.-') NOT IN ({listed}) AND NOT regexp_full_match(m, '{shapes}')),
x AS (SELECT r, a, m, unnest({classes}) AS k FROM c),
y AS (SELECT r, a, k[2] AS most, regexp_extract_all(m, k[1]) AS m, regexp_split_to_array(m, k[1]) AS p FROM x),
z AS (SELECT r, most, m[i] AS run, a + CAST(list_sum(list_transform(p[:i], lambda q: length(q))) + coalesce(list_sum(list_transform(m[:i - 1], lambda q: length(q))), 0) AS BIGINT) AS a
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM y)),
u AS (SELECT r, most, a + j AS a, substr(run, CAST(j + 1 AS BIGINT), 20) AS w FROM (SELECT *, unnest(range(0, length(run) - 19)) AS j FROM z WHERE length(run) >= 20)),
h AS (SELECT DISTINCT r, a, a + 20 AS z FROM u WHERE regexp_matches(w, '[0-9]') AND regexp_matches(w, '[^0-9]')
        AND list_sum(list_transform(map_values(list_histogram(string_split(w, ''))), lambda n: CAST(round(n * log2(n) * 1048576) AS BIGINT))) <= most),
i AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY r ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM h),
e AS (SELECT r, min(a) AS a, max(z) AS z FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM i) GROUP BY r, island),
l AS (SELECT r, kind, name, a, z FROM b UNION ALL
      SELECT r, 3, 'entropy', a, z FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = e.r AND b.a <= e.a AND b.z >= e.z)),
o AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
        string_agg(name || ':' || a || ':' || z, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS base, string_agg(name || ':' || a || ':' || z, ',' ORDER BY a, kind, z) AS spans FROM l GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (r)
"""


OP13 = _op13()

SQL = {"op1_warc": OP1, "op2_substring_dedup": OP2, "op4_decontaminate": OP4, "op7_chat_format": OP7, "op8_quality_rules": OP8, "op9_ngram_jaccard": OP9,
       "op11_spelling_variants": OP11, "op12_merkle_manifest": OP12, "op13_secret_scan": OP13}
