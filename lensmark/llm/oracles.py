"""DuckDB SQL for those queries of this subpackage that SQL can express on whole tables."""

from lensmark.llm.licences import LEAST, SHINGLE, TEMPLATES

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT = f"""
WITH d AS (SELECT doc_id, {LOWER.format("text")} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""


def _grams(table: str, key: str, words: str, k: int) -> str:
    """Rows (key, i, gram) of the k-word shingles of table's lists of words."""
    parts = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return f"SELECT {key}, i, concat_ws(' ', {parts}) AS gram FROM (SELECT {key}, {words}, unnest(range(1, len({words}) - {k - 2})) AS i FROM {table})"


def _licences() -> str:
    rows = ", ".join("('{}', '{}')".format(k.replace("'", "''"), t.replace("'", "''")) for k, t in sorted(TEMPLATES.items()))
    cut = r"regexp_extract_all({0}, '[^\s[:punct:]]+')"
    return f"""
WITH t AS (SELECT license, {cut.format(LOWER.format("body"))} AS w FROM (VALUES {rows}) v(license, body)),
tg AS (SELECT license, gram, min(i) AS ord FROM ({_grams("t", "license", "w", SHINGLE)}) GROUP BY ALL),
size AS (SELECT license, count(*) AS n FROM tg GROUP BY license),
d AS (SELECT doc_id, {cut.format(LOWER.format("text"))} AS w FROM documents),
dg AS (SELECT doc_id, gram, min(i) AS place FROM ({_grams("d", "doc_id", "w", SHINGLE)}) WHERE gram IN (SELECT gram FROM tg) GROUP BY ALL),
m AS (SELECT doc_id, license, count(*) AS n_matched, arg_min(place, ord) AS position FROM dg JOIN tg USING (gram) GROUP BY ALL)
SELECT doc_id, license, n_matched, n_matched / n::DOUBLE AS containment, position FROM m JOIN size USING (license) WHERE n_matched / n::DOUBLE >= {LEAST}
"""


NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, gram FROM ({_grams("d", "doc_id", "w", 4)})
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ties AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM ties UNION SELECT r.a, k.b FROM reach r JOIN ties k ON k.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(coalesce(m, d.doc_id), d.doc_id) AS component_id, least(coalesce(m, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""


#: crc32 by a table of its 256 steps, and of a text of one-byte characters.
CRC = """tab AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    """Over a row that has tab's steps."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)"


WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

PERIODIC = f"""
WITH {CRC}, d AS (SELECT doc_id, {WORDS.format("text")} AS o, len({WORDS.format("text")}) AS n, {_crc("doc_id::VARCHAR")} AS h FROM documents, tab),
e AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM d),
w AS MATERIALIZED (SELECT doc_id, n, list_transform(range(n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) AS w FROM e),
x AS (SELECT doc_id, i, dense_rank() OVER (PARTITION BY doc_id ORDER BY v) AS v FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS v FROM w)),
y AS MATERIALIZED (SELECT doc_id, list(v ORDER BY i) AS v, count(*) AS n FROM x GROUP BY doc_id),
q AS (SELECT doc_id, v, n, unnest(range(1, n // 4 + 1)) AS q FROM y),
m AS (SELECT doc_id, n, q, list_append(list_prepend(-1, list_filter(range(n - q), lambda i: v[i + 1] <> v[i + q + 1])), n - q) AS m FROM q),
g AS (SELECT doc_id, q, unnest(list_filter(list_transform(range(1, len(m)), lambda i: {{'s': m[i] + 1, 'l': m[i + 1] - m[i] - 1 + q}}), lambda r: r.l >= greatest(6, 4 * q))) AS r FROM m),
run AS MATERIALIZED (SELECT doc_id, r.s AS s, r.l AS l, min(q) AS q FROM g GROUP BY ALL),
best AS (SELECT doc_id, s, l, q FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (l * 1000000000000) // q DESC, s, q) AS k FROM run) WHERE k = 1),
al AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, list({{'s': s + q, 'e': s + l}}) AS gone FROM run GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i: len(list_filter(gone, lambda r: i >= r.s AND i < r.e)) = 0), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
FROM w LEFT JOIN al USING (doc_id) LEFT JOIN best USING (doc_id)
"""

#: A bigram model; sums of logarithms are rounded to six digits, as engines add in orders of their own.
KNESER_NEY = f"""
WITH {CRC}, d AS (SELECT doc_id, {_crc("doc_id::VARCHAR")} % 7 = 2 AS held_out, list_append({WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, ' end') AS w FROM documents, tab),
t AS MATERIALIZED (SELECT doc_id, held_out, i, w[i] AS w, CASE WHEN i = 1 THEN ' begin' ELSE w[i - 1] END AS c FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
uni AS MATERIALIZED (SELECT w, count(*) AS k FROM t WHERE NOT held_out GROUP BY w),
big AS MATERIALIZED (SELECT c, w, count(*) AS a FROM t WHERE NOT held_out GROUP BY c, w),
con AS MATERIALIZED (SELECT w, count(*) AS a FROM big GROUP BY w),
ctx AS (SELECT c, sum(a) AS total, count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 2) AS n2, count(*) FILTER (a > 2) AS n3 FROM big GROUP BY c),
f1 AS (SELECT count(*) FILTER (a = 1) AS a1, count(*) FILTER (a = 2) AS a2, count(*) FILTER (a = 3) AS a3, count(*) FILTER (a = 4) AS a4, count(*) FILTER (a > 2) AS more, sum(a) AS total FROM con),
f2 AS (SELECT count(*) FILTER (a = 1) AS a1, count(*) FILTER (a = 2) AS a2, count(*) FILTER (a = 3) AS a3, count(*) FILTER (a = 4) AS a4 FROM big),
off AS (SELECT level, greatest(0, least(1, CASE WHEN g THEN 1 - 2 * y * a2 / a1 ELSE 0.5 END)) AS d1, greatest(0, least(2, CASE WHEN g THEN 2 - 3 * y * a3 / a2 ELSE 1 END)) AS d2, greatest(0, least(3, CASE WHEN g THEN 3 - 4 * y * a4 / a3 ELSE 1.5 END)) AS d3
  FROM (SELECT *, least(a1, a2, a3, a4) > 0 AS g, a1 / (a1 + 2 * a2)::DOUBLE AS y FROM (SELECT 1 AS level, a1, a2, a3, a4 FROM f1 UNION ALL SELECT 2, * FROM f2))),
size AS (SELECT (SELECT sum(k) FROM uni) AS tokens, (SELECT count(*) FROM uni) AS types),
p AS (SELECT t.doc_id, t.held_out, uni.k, tokens, types, ctx.total, coalesce(big.a, 0) AS a, o2.d1, o2.d2, o2.d3, n1, n2, n3,
    (CASE WHEN con.a IS NULL THEN 0 ELSE greatest(con.a - CASE con.a WHEN 1 THEN o1.d1 WHEN 2 THEN o1.d2 ELSE o1.d3 END, 0) END) / f1.total + (o1.d1 * f1.a1 + o1.d2 * f1.a2 + o1.d3 * f1.more) / f1.total / (types + 1) AS low
  FROM t LEFT JOIN uni USING (w) LEFT JOIN con USING (w) LEFT JOIN ctx ON ctx.c = t.c LEFT JOIN big ON big.c = t.c AND big.w = t.w, f1, size, (SELECT * FROM off WHERE level = 1) o1, (SELECT * FROM off WHERE level = 2) o2),
s AS (SELECT *, CASE WHEN total IS NULL THEN low ELSE CASE WHEN a = 0 THEN 0 ELSE greatest(a - CASE a WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) END / total + (d1 * n1 + d2 * n2 + d3 * n3) / total * low END AS prob FROM p)
SELECT doc_id, held_out, count(*) AS n_tokens, count(k) AS n_known, max(tokens)::BIGINT AS train_tokens, round(sum(log10((coalesce(k, 0) + 1) / (tokens + types + 1)::DOUBLE)), 6) AS base_score, round(sum(log10(prob)), 6) AS score FROM s GROUP BY doc_id, held_out
"""

TRIE = f"""
WITH {CRC}, t AS (SELECT conv_id, turn, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS v FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(v ORDER BY turn NULLS FIRST, v.r, v.t) AS l, {_crc("conv_id::VARCHAR")} % 9 AS h FROM t, tab GROUP BY conv_id, steps),
seq AS MATERIALIZED (SELECT o.conv_id, list_concat(coalesce(list_slice(b.l, 1, o.h), []), list_slice(o.l, o.h + 1, len(o.l))) AS p FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
pre AS (SELECT conv_id, len(p) AS n, d, list_slice(p, 1, d) AS k FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM seq)),
node AS MATERIALIZED (SELECT k, d, min(conv_id) AS c, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM pre GROUP BY k, d),
kid AS (SELECT list_slice(k, 1, d - 1) AS k, count(*) AS kids FROM node WHERE d > 0 GROUP BY ALL),
own_ AS (SELECT node.*, coalesce(kids, 0) AS kids, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * strlen(node.k[d].t) END AS saved FROM node LEFT JOIN kid ON kid.k = node.k),
up AS (SELECT list_slice(k, 1, u) AS k, count(*) FILTER (kids = 0) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(d + 1)) AS u FROM own_) GROUP BY ALL)
SELECT o.c AS conv_id, o.d AS depth, q.c AS parent_conv_id, o.n AS n_convs, o.kids AS n_children, leaves AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM own_ o JOIN up ON up.k = o.k LEFT JOIN node q ON o.d > 0 AND q.k = list_slice(o.k, 1, o.d - 1)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": EXACT, "op6_license_scan": _licences(), "op10_near_dedup": NEAR, "op11_periodic_runs": PERIODIC, "op12_kneser_ney": KNESER_NEY, "op13_prefix_trie": TRIE}
