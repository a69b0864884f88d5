"""The same queries in DuckDB SQL, with lenses as VALUES."""

from __future__ import annotations

from lensmark.functions.text import INJECTION
from lensmark.operators.detection import ASK_HITS, CLOSING, OPENING, prompt_for
from lensmark.plans.lenses import Lens, cue_snapshot, load_lenses, pair_lenses, text_lenses
from lensmark.plans.tables import RELATIONS, SECTORS


#: Words of the pairs that cue_hits_wide and grade_wide look for.
COMMON = "of the to and in is der die und das de la le les et que en el los un une des".split()
#: What the stand-in verifier of verify_receipts looks for.
REFUSED = "Apache"


def _q(x: object) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def dims(lenses: dict[str, Lens]) -> str:
    lens, marker, det, cue = [], [], [], []
    for k, x in enumerate(lenses.values()):
        c = x.config
        labels = [t[1] for t in sorted(c.tiers)]
        lens.append((x.id, k, c.threshold, c.w_breadth, c.w_intensity, c.w_density, c.density_cap, float(len(x.markers)), float(sum(m.base_weight for m in x.markers)), *labels))
        marker += [(x.id, m.id, m.base_weight) for m in x.markers]
        for i, (m, d) in enumerate(x.detections()):
            det.append((x.id, m.id, d.id, d.weight, i))
            cue += [(x.id, d.id, j, c2, c2.strip().lower()) for j, c2 in enumerate(d.cues) if c2.strip()]
    out = [
        _values("lens", "lens_id, lens_ord, thr, wb, wi, wd, cap, nm, base, l0, l1, l2", lens),
        _values("marker", "lens_id, marker_id, base", marker),
        _values("det", "lens_id, marker_id, detection_id, weight, det_ord", det),
    ]
    if cue:
        out.append(_values("cue", "lens_id, detection_id, cue_ord, cue, norm", cue))
    return ",\n".join(out)


HITS = """cand AS (SELECT d.doc_id, d.text, lower(d.text) AS low, c.* FROM doc d JOIN cue c ON contains(lower(d.text), c.norm)),
pick AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lens_id, detection_id ORDER BY cue_ord) AS r FROM cand),
hits AS (SELECT doc_id, lens_id, detection_id, 0.55::DOUBLE AS confidence, substr(text, strpos(low, norm), length(cue)) AS span, strpos(low, norm) - 1 AS char_start,
  strpos(low, norm) - 1 + length(cue) AS char_end, 'deterministic cue match: ''' || cue || '''' AS rationale FROM pick WHERE r = 1)"""

GRADE = """c AS (SELECT h.doc_id, h.lens_id, d.marker_id, sum(greatest(0.0::DOUBLE, least(1.0::DOUBLE, h.confidence)) * d.weight) AS w FROM hits h JOIN det d USING (lens_id, detection_id) GROUP BY ALL),
m AS (SELECT doc.doc_id, k.lens_id, k.marker_id, k.base, coalesce(c.w, 0) AS w, least(1.0::DOUBLE, coalesce(c.w, 0)) AS s FROM (SELECT DISTINCT doc_id FROM doc) doc CROSS JOIN marker k LEFT JOIN c ON c.doc_id = doc.doc_id AND c.lens_id = k.lens_id AND c.marker_id = k.marker_id),
a AS (SELECT m.doc_id, m.lens_id, count(*) FILTER (s >= thr) AS present, sum(s * m.base) AS i, sum(w) AS w FROM m JOIN lens USING (lens_id) GROUP BY ALL),
b AS (SELECT a.*, doc.* EXCLUDE (doc_id), l.* EXCLUDE (lens_id), present / nm AS breadth, i / l.base AS intensity,
  CASE WHEN doc.token_count > 0 AND cap <> 0 THEN least(1.0::DOUBLE, a.w / (doc.token_count / 1000.0::DOUBLE) / cap) ELSE 0.0::DOUBLE END AS density FROM a JOIN doc USING (doc_id) JOIN lens l USING (lens_id)),
g AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE * (wb * breadth + wi * intensity + wd * density))) AS idx FROM b),
graded AS (SELECT *, CASE WHEN round(idx, 2) >= 60 THEN l2 WHEN round(idx, 2) >= 35 THEN l1 ELSE l0 END AS tier FROM g)"""

SUMMARY = """dated AS (SELECT *, date IS NOT NULL AND date <> '' AS has FROM graded),
ranked AS (SELECT *, CASE WHEN has THEN row_number() OVER (PARTITION BY subject, lens_id, has ORDER BY date, ord) END AS r, CASE WHEN has THEN count(*) OVER (PARTITION BY subject, lens_id, has) END AS n FROM dated)
SELECT subject, lens_id, round(max(idx) + 1e-9, 6) AS max_index, round(avg(idx) + 1e-9, 6) AS mean_index, count(*) AS n_documents, count(*) FILTER (present > 0) AS n_documents_with_signal,
  CASE WHEN max(n) IS NULL OR max(n) < 2 THEN 'insufficient-data'
       WHEN avg(idx) FILTER (r > floor(n / 2)) - avg(idx) FILTER (r <= floor(n / 2)) > 5 THEN 'rising'
       WHEN avg(idx) FILTER (r > floor(n / 2)) - avg(idx) FILTER (r <= floor(n / 2)) < -5 THEN 'falling' ELSE 'flat' END AS trend
FROM ranked GROUP BY subject, lens_id"""

TOKENS = "greatest(1, floor(len(regexp_extract_all({0}, '\\S+')) / 0.75::DOUBLE))::BIGINT"
DOC = f"doc AS (SELECT doc_id, text, source AS subject, NULL::VARCHAR AS date, doc_id AS ord, {TOKENS.format('text')} AS token_count FROM documents WHERE trim(text) <> '')"
TURN = f"doc AS (SELECT conv_id || '/' || turn AS doc_id, trim(text) AS text, conv_id::VARCHAR AS subject, lpad(turn::VARCHAR, 6, '0') AS date, turn AS ord, {TOKENS.format('text')} AS token_count FROM conversations WHERE trim(text) <> '')"
DAYS = """ev AS (SELECT user_id || '/' || ts::DATE AS doc_id, user_id::VARCHAR AS subject, (ts::DATE)::VARCHAR AS date, event_type, value FROM events),
doc AS (SELECT doc_id, subject, date, 0 AS ord, count(*) * 250 AS token_count FROM ev GROUP BY ALL),
hits AS (SELECT doc_id, 'event_register' AS lens_id, event_type AS detection_id, value / 100 AS confidence FROM ev)"""
HTML = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"

SECTOR = "[" + ", ".join(map(_q, SECTORS)) + "]"
GRAPH = f"""ent AS (SELECT 'S' || s_suppkey AS id, s_name AS name, {SECTOR}[(s_nationkey % 10) + 1] AS sector FROM supplier
  UNION ALL SELECT DISTINCT p_brand, p_brand, {SECTOR}[(regexp_extract(p_brand, '[0-9]+')::INT % 10) + 1] FROM part),
sums AS (SELECT l_suppkey, p_brand, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL),
edge AS (SELECT 'S' || l_suppkey AS source, p_brand AS target FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, p_brand) AS r FROM sums) WHERE r <= 2),
adj AS MATERIALIZED (SELECT source AS src, target AS dst FROM edge UNION SELECT target, source FROM edge),
deg AS (SELECT ent.id, count(a.dst) AS degree, count(a.dst) / greatest((SELECT count(*) FROM ent) - 1, 1)::DOUBLE AS degree_centrality FROM ent LEFT JOIN adj a ON a.src = ent.id GROUP BY ent.id)"""
BRIDGED = "bridged AS (SELECT e.id, list_sort(coalesce(list(DISTINCT o.sector) FILTER (o.sector IS NOT NULL AND (e.sector IS NULL OR o.sector <> e.sector)), [])) AS bridged FROM ent e LEFT JOIN adj a ON a.src = e.id LEFT JOIN ent o ON o.id = a.dst GROUP BY e.id)"
ROLES = """tri AS (SELECT b.id, a.sector AS ga, b.sector AS gb, c.sector AS gc FROM adj x JOIN adj y ON x.src = y.src AND x.dst <> y.dst JOIN ent b ON b.id = x.src JOIN ent a ON a.id = x.dst JOIN ent c ON c.id = y.dst
  WHERE a.sector IS NOT NULL AND b.sector IS NOT NULL AND c.sector IS NOT NULL AND NOT EXISTS (SELECT 1 FROM adj z WHERE z.src = x.dst AND z.dst = y.dst)),
named AS (SELECT id, CASE WHEN ga = gb AND gb = gc THEN 'coordinator' WHEN ga = gb THEN 'representative' WHEN gb = gc THEN 'gatekeeper' WHEN ga = gc THEN 'consultant' ELSE 'liaison' END AS role FROM tri),
roles AS (SELECT ent.id, count(*) FILTER (role = 'coordinator') AS coordinator, count(*) FILTER (role = 'gatekeeper') AS gatekeeper, count(*) FILTER (role = 'representative') AS representative,
  count(*) FILTER (role = 'consultant') AS consultant, count(*) FILTER (role = 'liaison') AS liaison FROM ent LEFT JOIN named USING (id) GROUP BY ent.id)"""
LEVELS = 12


def between() -> str:
    """All shortest paths by unrolled breadth-first search, then the pair formula."""
    out = ["v0 AS MATERIALIZED (SELECT DISTINCT src AS s, src AS v, 0 AS d, 1.0::DOUBLE AS paths FROM adj)"]
    for i in range(1, LEVELS + 1):
        out.append(
            f"v{i} AS MATERIALIZED (SELECT * FROM v{i - 1} UNION ALL SELECT f.s, a.dst, {i}, sum(f.paths) FROM v{i - 1} f JOIN adj a ON a.src = f.v WHERE f.d = {i - 1} "
            f"AND NOT EXISTS (SELECT 1 FROM v{i - 1} o WHERE o.s = f.s AND o.v = a.dst) GROUP BY f.s, a.dst)"
        )
    p = f"v{LEVELS}"
    out.append(
        f"dep AS (SELECT x.v AS id, sum(x.paths * y.paths / t.paths) AS total FROM {p} t JOIN {p} x ON x.s = t.s AND x.d > 0 AND x.d < t.d JOIN {p} y ON y.s = x.v AND y.v = t.v AND y.d = t.d - x.d GROUP BY x.v),\n"
        "bc AS (SELECT ent.id, coalesce(total, 0) / 2 / (CASE WHEN n > 2 THEN (n - 1) * (n - 2) / 2.0::DOUBLE ELSE 1 END) AS betweenness FROM ent LEFT JOIN dep USING (id), (SELECT count(*)::DOUBLE AS n FROM ent))"
    )
    return ",\n".join(out)


def _cut_of(table: str, column: str) -> str:
    return f"(SELECT {column} FROM {table} ORDER BY {column} LIMIT 1 OFFSET (SELECT round_even(0.9::DOUBLE * (count(*) - 1), 0)::BIGINT FROM {table}))"


NETWORK = f"""met AS (SELECT ent.*, bc.betweenness, deg.degree, deg.degree_centrality, roles.* EXCLUDE (id), bridged.bridged, cume_dist() OVER (ORDER BY round(betweenness, 12)) AS pb, cume_dist() OVER (ORDER BY degree_centrality) AS pd, count(*) OVER () AS n
  FROM ent JOIN bc USING (id) JOIN deg USING (id) JOIN roles USING (id) JOIN bridged USING (id)),
bar AS (SELECT {_cut_of("met", "betweenness")} AS cb, {_cut_of("met", "degree_centrality")} AS cd),
nhits AS (
  SELECT id AS doc_id, 'high-betweenness' AS detection_id, CASE WHEN pb > 0.9 THEN least(1.0::DOUBLE, 0.8 + 0.2 * (pb - 0.9) / 0.1) ELSE 0.8 END AS confidence FROM met, bar WHERE betweenness > 0 AND betweenness >= cb - 1e-12
  UNION ALL SELECT id, 'hub-degree', CASE WHEN pd > 0.9 THEN least(1.0::DOUBLE, 0.75 + 0.25 * (pd - 0.9) / 0.1) ELSE 0.75 END FROM met, bar WHERE degree > 0 AND degree_centrality >= cd
  UNION ALL SELECT id, 'cross-group-broker', least(1.0::DOUBLE, 0.7 + 0.15 * (len(bridged) - 2)) FROM met WHERE gatekeeper + representative + consultant + liaison > 0 AND len(bridged) >= 2)"""


def careers(least: int) -> str:
    rel = "CASE left(o_orderpriority, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RELATIONS.items()) + " END"
    return f"""ent AS (SELECT 'C' || c_custkey AS id, c_name AS name, {SECTOR}[(c_nationkey % 10) + 1] AS sector FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name, {SECTOR}[(s_nationkey % 10) + 1] FROM supplier),
edge AS (SELECT 'C' || o_custkey AS source, 'S' || l_suppkey AS target, {rel} AS rel, o_orderdate, o_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= {least}),
mv AS (SELECT e.*, coalesce(t.name, e.target) AS name, t.sector FROM edge e LEFT JOIN ent t ON t.id = e.target WHERE rel IS NULL OR rel <> 'funded-by'),
car AS (SELECT source AS id, count(*) AS n_moves, list_sort(list(DISTINCT sector) FILTER (sector IS NOT NULL)) AS s, bool_and(rel IS NULL) AS untyped,
  string_agg(name || ' (' || coalesce(sector, '?') || ')', ' -> ' ORDER BY o_orderdate, o_orderkey, l_linenumber, name) AS chain FROM mv GROUP BY source),
fund AS (SELECT e.target AS id, count(*) AS n_recipients, list_sort(list(DISTINCT t.sector) FILTER (t.sector IS NOT NULL)) AS r FROM edge e LEFT JOIN ent t ON t.id = e.source WHERE rel = 'funded-by' GROUP BY e.target)"""


CAREER_HITS = """al AS (SELECT ent.id, coalesce(n_moves, 0) AS n, coalesce(s, []) AS s, len(coalesce(s, [])) AS k, coalesce(n_recipients, 0) AS f, coalesce(r, []) AS r FROM ent LEFT JOIN car USING (id) LEFT JOIN fund USING (id)),
chits AS (SELECT id AS doc_id, 'spans-three-sectors' AS detection_id, least(1.0::DOUBLE, 0.85 + 0.05 * (k - 3)) AS confidence FROM al WHERE k >= 3
  UNION ALL SELECT id, 'spans-four-plus-sectors', 1.0 FROM al WHERE k >= 4
  UNION ALL SELECT id, 'three-plus-moves', least(1.0::DOUBLE, 0.8 + 0.1 * (n - 3)) FROM al WHERE n >= 3
  UNION ALL SELECT id, 'five-plus-moves', 1.0 FROM al WHERE n >= 5
  UNION ALL SELECT id, 'watchdog-then-join', 1.0 FROM al WHERE list_has_any(s, ['tank', 'intel', 'media']) AND list_has_any(s, ['tech', 'fin'])
  UNION ALL SELECT id, 'crosses-gov-industry', 1.0 FROM al WHERE list_contains(s, 'gov') AND list_has_any(s, ['tech', 'fin'])
  UNION ALL SELECT id, 'funds-three-plus', least(1.0::DOUBLE, 0.8 + 0.05 * (f - 3)) FROM al WHERE f >= 3
  UNION ALL SELECT id, 'funds-recipient-and-evaluator', 1.0 FROM al WHERE list_has_any(r, ['tech', 'fin']) AND list_contains(r, 'tank'))"""

RECORDS = """rec AS (SELECT s_name AS institution, CASE WHEN l_linenumber = 6 THEN 'no_such_lens' ELSE 'license_register' END AS lens, p_type AS marker, c_mktsegment AS actor,
  CASE l_returnflag WHEN 'R' THEN 'FACT' WHEN 'A' THEN 'ATTRIBUTED' ELSE 'RUMOR' END AS assurance, l_linenumber, l_orderkey * 10 + l_linenumber AS ord, (l_shipdate::DATE)::VARCHAR AS day, l_discount * 5 AS sc,
  l_quantity / 50 * (CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.6 ELSE 0.25 END)::DOUBLE * (1.0::DOUBLE - l_discount * 5) AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def _board(name: str, where: str = "TRUE") -> str:
    return f"""{name} AS (SELECT institution, coalesce(sum(score) FILTER (assurance = 'FACT'), 0) AS fact, coalesce(sum(score) FILTER (assurance <> 'FACT'), 0) AS unverified, count(DISTINCT marker) AS n_markers,
  coalesce(avg(sc) FILTER (sc > 0), 0) AS self_correction_mean, count(*) AS n_records, min(ord) AS first_ord FROM rec WHERE {where} GROUP BY institution)"""


def all_queries() -> dict[str, str]:
    every = load_lenses()
    text = {k: v for k, v in text_lenses(every).items() if k != "event_register"}
    days = {"event_register": every["event_register"]}
    graded = f"WITH {dims(text)},\n{DOC},\n{HITS},\n{GRADE}"
    by_day = f"WITH {dims(days)},\n{DAYS},\n{GRADE}"
    net = f"{GRAPH},\n{between()},\n{BRIDGED},\n{ROLES},\n{NETWORK}"
    wide = pair_lenses(COMMON)
    few = {k: text[k] for k in ("license_register", "contact_register")}
    clean = "(CASE WHEN length(c) > 20000 THEN left(c, 20000) || ' […truncated]' ELSE c END)"
    fenced = "replace(text, '\"\"\"', '\"​\"​\"')"
    heads = _values("head", "lens_id, head", [(x.id, prompt_for(x)) for x in text.values()])
    drift = f"""WITH {RECORDS},\n{_board('p', "day < '1996-01-01'")},\n{_board('c', "day < '1997-01-01'")},
both_ AS (SELECT coalesce(p.institution, c.institution) AS i, p.institution IS NULL AS added, c.institution IS NULL AS removed, round(p.fact + 1e-9, 6) AS f0, round(c.fact + 1e-9, 6) AS f1, p.n_markers AS m0, c.n_markers AS m1 FROM p FULL JOIN c USING (institution)),
moved AS (SELECT i, round(f1 - f0, 2) AS up, abs(f1 - f0) >= 0.01 AS f, m0 <> m1 AS m, f0, f1, m0, m1 FROM both_ WHERE NOT added AND NOT removed AND (abs(f1 - f0) >= 0.01 OR m0 <> m1))"""
    receipt = """high AS (SELECT id AS doc_id, 'high-betweenness' AS detection_id, name || printf(': betweenness %.3f (top %d%% of %d nodes); bridges sectors ', betweenness, greatest(1, round_even((1 - pb) * 100, 0)::INT), n) || CASE WHEN len(bridged) > 0 THEN array_to_string(bridged, ', ') ELSE coalesce(sector, '?') END AS span FROM met, bar WHERE betweenness > 0 AND betweenness >= cb - 1e-12),
hub AS (SELECT id, 'hub-degree', name || printf(': degree %d (centrality %.3f, top %d%% of %d nodes)', degree, degree_centrality, greatest(1, round_even((1 - pd) * 100, 0)::INT), n) FROM met, bar WHERE degree > 0 AND degree_centrality >= cd),
mix AS (SELECT *, concat_ws(', ', CASE WHEN coordinator > 0 THEN 'coordinator:' || coordinator END, CASE WHEN gatekeeper > 0 THEN 'gatekeeper:' || gatekeeper END, CASE WHEN representative > 0 THEN 'representative:' || representative END,
  CASE WHEN consultant > 0 THEN 'consultant:' || consultant END, CASE WHEN liaison > 0 THEN 'liaison:' || liaison END) AS roles_ FROM met WHERE gatekeeper + representative + consultant + liaison > 0 AND len(bridged) >= 2),
across AS (SELECT id, 'cross-group-broker', name || ' (' || coalesce(sector, '?') || ') brokers across ' || len(bridged) || ' sectors [' || array_to_string(bridged, ', ') || ']; roles {' || roles_ || '}' FROM mix)
SELECT * FROM high UNION ALL SELECT * FROM hub UNION ALL SELECT * FROM across"""
    shown = "round(idx + 1e-9, 6) AS index, tier, round(breadth + 1e-9, 6) AS breadth, round(intensity + 1e-9, 6) AS intensity, round(density + 1e-9, 6) AS density"
    injection = INJECTION.replace("'", "''").replace(r"\{", "[{]")
    lens_rows = [(x.id, ",".join(m.id for m in x.markers), len(x.detections()), sum(len(d.cues) for _, d in x.detections())) for x in every.values()]
    cue_rows = [(x["id"], m["id"], d["id"], len(d["cues"])) for x in cue_snapshot(every) for m in x["markers"] for d in m["detections"]]
    summed = "SELECT doc_id, round(idx + 1e-9, 6) AS index, tier FROM graded"
    return {
        "cue_hits": f"WITH {dims(text)},\n{DOC},\n{HITS} SELECT doc_id, lens_id, detection_id, span, char_start, char_end, rationale FROM hits",
        "cue_hits_wide": f"WITH {dims(wide)},\n{DOC},\n{HITS} SELECT doc_id, lens_id, detection_id, span, char_start, char_end, rationale FROM hits",
        "grade_wide": f"WITH {dims(wide)},\n{DOC},\n{HITS},\n{GRADE} SELECT doc_id, lens_id, {shown} FROM graded WHERE idx > 0",
        "sql_cue_hits": f"WITH {dims({'license_register': text['license_register']})},\n{DOC.replace("WHERE trim(text) <> ''", '')},\n{HITS} SELECT doc_id, lens_id, detection_id, confidence, span, char_start, rationale FROM hits",
        "sql_marker_sums": f"{graded} SELECT doc_id, lens_id, marker_id, round(s + 1e-9, 6) AS score FROM m WHERE s > 0",
        "sql_text_functions": f"SELECT page_id, text, {TOKENS.format('text')} AS tokens, regexp_matches(html, '{injection}') AS flagged FROM (SELECT page_id, html, {HTML} AS text FROM pages)",
        "page_hits": f"WITH {dims(text)},\ndoc AS (SELECT DISTINCT url AS doc_id, {HTML} AS text FROM pages),\n{HITS} SELECT doc_id, lens_id, detection_id, char_start FROM hits",
        "grade_documents": f"{graded} SELECT doc_id, lens_id, token_count, {shown} FROM graded",
        "token_estimate": f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents",
        "html_to_text": f"SELECT page_id, {HTML} AS text FROM pages",
        "page_source": f"SELECT url, length(text) AS n_chars, sha256(text) AS text_sha256 FROM (SELECT url, {HTML} AS text FROM pages)",
        "stream_summaries": f"WITH {dims(text)},\n{TURN},\n{HITS},\n{GRADE},\n{SUMMARY}",
        "sanitize": f"WITH c AS (SELECT doc_id, text, replace(text, '\"\"\"', '\"​\"​\"') AS c FROM documents) SELECT doc_id, CASE WHEN length(c) > 20000 THEN left(c, 20000) || ' […truncated]' ELSE c END AS clean, regexp_matches(text, '{injection}') AS flagged FROM c",
        "span_locate": "SELECT doc_id, CASE WHEN strpos(text, 'tion') > 0 THEN strpos(text, 'tion') - 1 END AS at, NULL::BIGINT AS empty FROM documents",
        "grade_event_days": f"{by_day} SELECT doc_id, {shown} FROM graded",
        "marker_scores_long": f"{by_day} SELECT doc_id, marker_id, round(s + 1e-9, 6) AS score FROM m",
        "markers_present": f"{by_day} SELECT m.doc_id, m.marker_id FROM m JOIN lens USING (lens_id) WHERE s >= thr",
        "tier_histogram": f"{by_day} SELECT tier, count(*) AS n FROM graded GROUP BY tier",
        "subject_lens_summary": f"{graded},\n{SUMMARY}",
        "subject_trend": f"{by_day},\n{SUMMARY}",
        "subject_timeline": f"{by_day} SELECT subject, date, round(idx + 1e-9, 6) AS event_register FROM graded",
        "conversation_trend": f"WITH {dims(text)},\n{TURN},\n{HITS},\n{GRADE},\n{SUMMARY}",
        "record_score": f"WITH {RECORDS} SELECT institution, ord, assurance, round(score + 1e-9, 6) AS score FROM rec",
        "board": f"WITH {RECORDS},\n{_board('bd')} SELECT row_number() OVER (ORDER BY round(fact, 9) DESC, first_ord) AS rank, institution, round(fact + 1e-9, 6) AS fact, round(unverified + 1e-9, 6) AS unverified, n_markers, round(self_correction_mean + 1e-9, 6) AS self_correction_mean, n_records FROM bd",
        "board_by_actor": f"WITH {RECORDS} SELECT institution, actor, round(sum(score) + 1e-9, 6) AS score FROM rec GROUP BY ALL",
        "board_validate": f"WITH {RECORDS} SELECT institution, kind, count(*) AS n FROM (SELECT institution, CASE WHEN lens = 'license_register' THEN 'unknown-marker' ELSE 'unknown-lens' END AS kind FROM rec UNION ALL SELECT institution, 'no-receipt' FROM rec WHERE l_linenumber = 7) GROUP BY ALL",
        "snapshot_delta": f"WITH {RECORDS},\n{_board('p', "day < '1996-01-01'")},\n{_board('c', "day < '1997-01-01'")} SELECT institution, CASE WHEN p.institution IS NULL THEN 'added' WHEN c.institution IS NULL THEN 'removed' ELSE 'changed' END AS change, round(p.fact + 1e-9, 6) AS fact_before, round(c.fact + 1e-9, 6) AS fact_now, p.n_markers AS markers_before, c.n_markers AS markers_now FROM p FULL JOIN c USING (institution) WHERE p.institution IS NULL OR c.institution IS NULL OR abs(c.fact - p.fact) >= 0.01 OR p.n_markers <> c.n_markers",
        "board_markdown": f"""WITH {RECORDS},\n{_board('bd')}, k AS (SELECT *, row_number() OVER (ORDER BY round(fact, 3) DESC, first_ord) AS r FROM bd)
SELECT 'row' AS kind, institution AS name, 1 AS n_lines, r AS place FROM k UNION ALL SELECT 'institution', institution, 1, r FROM k UNION ALL SELECT 'other', '', 2 + count(*), 1 FROM k
UNION ALL SELECT 'receipt', '', count(*), 1 FROM rec""",
        "betweenness_by_joins": f"WITH {GRAPH},\n{between()} SELECT id, round(betweenness + 1e-9, 6) AS betweenness FROM bc",
        "jsonl_of_subject": """WITH d AS (SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 5 > 0 THEN source END AS p FROM documents WHERE trim(text) <> ''), o AS (SELECT min(source) AS one FROM documents WHERE doc_id % 5 > 0)
SELECT doc_id, 'own' AS lane FROM d, o WHERE p = one UNION ALL SELECT doc_id, 'with unnamed' FROM d, o WHERE p = one OR p IS NULL""",
        "record_lines": f"WITH {RECORDS} SELECT institution, actor, assurance, round(score + 1e-9, 6) AS score, CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END AS n_receipts, ord::VARCHAR AS note FROM rec",
        "written_graph": f"WITH {GRAPH} SELECT sector, count(*) AS n_nodes, sum(degree)::BIGINT AS degrees FROM deg JOIN ent USING (id) GROUP BY sector",
        "detect_order": f"{graded} SELECT doc_id, lens_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(idx, 2) DESC, lens_ord) AS place FROM graded",
        "timeline_order": f"WITH {TURN} SELECT doc_id, row_number() OVER (PARTITION BY subject ORDER BY date, ord) AS place, count(*) OVER (PARTITION BY subject) AS n FROM doc",
        "actor_order": f"WITH {RECORDS}, s AS (SELECT institution, actor, round(sum(round(score, 4)), 4) AS s FROM rec GROUP BY ALL) SELECT institution, string_agg(actor, ',' ORDER BY s DESC, actor) AS actors FROM s GROUP BY institution",
        "betweenness_reduced": f"WITH {GRAPH},\n{between()} SELECT id, round(betweenness + 1e-9, 6) AS betweenness FROM bc",
        "board_totals": f"WITH {RECORDS} SELECT count(DISTINCT institution) AS institutions, count(*) AS records FROM rec",
        "career_moves": f"WITH {careers(46)} SELECT id, n_moves, array_to_string(coalesce(s, []), ',') AS sectors, untyped FROM car",
        "career_chain": f"WITH {careers(46)} SELECT id, chain FROM car",
        "career_hits": f"""WITH {careers(49)},\n{CAREER_HITS},
note AS (SELECT al.id, n, k, f, CASE WHEN coalesce(untyped, FALSE) THEN ' (untyped affiliations; order is not known)' ELSE '' END AS note FROM al LEFT JOIN car USING (id))
SELECT doc_id, detection_id, round(confidence::DOUBLE + 1e-9, 6) AS confidence, CASE WHEN detection_id LIKE 'spans-%' THEN 'moves across ' || k || ' sectors' WHEN detection_id LIKE '%-moves' THEN n || ' moves'
  WHEN detection_id = 'watchdog-then-join' THEN 'a monitoring and an industry sector' WHEN detection_id = 'crosses-gov-industry' THEN 'government and industry'
  WHEN detection_id = 'funds-three-plus' THEN 'funds ' || f || ' recipients' ELSE 'recipient and evaluator' END || note AS rationale FROM chits JOIN note ON id = doc_id""",
        "career_grades": f"WITH {dims({'revolving_door': every['revolving_door']})},\n{careers(49)},\n{CAREER_HITS},\ndoc AS (SELECT id AS doc_id, 0 AS token_count FROM ent),\nhits AS (SELECT doc_id, 'revolving_door' AS lens_id, detection_id, confidence::DOUBLE AS confidence FROM chits),\n{GRADE} {summed}",
        "funder_hits": f"WITH {careers(49)} SELECT id, n_recipients, array_to_string(coalesce(r, []), ',') AS sectors FROM fund",
        "graph_degree": f"WITH {GRAPH} SELECT id, degree, round(degree_centrality + 1e-9, 6) AS degree_centrality FROM deg",
        "graph_roles": f"WITH {GRAPH},\n{ROLES} SELECT * FROM roles",
        "bridged_sectors": f"WITH {GRAPH},\n{BRIDGED} SELECT id, array_to_string(bridged, ',') AS bridged FROM bridged",
        "decile_cut": f"WITH {GRAPH} SELECT round({_cut_of('deg', 'degree_centrality')} + 1e-9, 6) AS cut",
        "top_node": f"WITH {GRAPH} SELECT id, round(degree_centrality + 1e-9, 6) AS degree_centrality FROM deg ORDER BY deg.degree_centrality DESC, id LIMIT 1",
        "model_answers": "SELECT doc_id, 'license_register' AS lens_id, 'copyleft' AS detection_id, round((doc_id % 10) / 10.0::DOUBLE + 1e-9, 6) AS confidence, coalesce(substr(text, 3, 12), '') AS span,\n"
        + "  CASE WHEN length(text) > 2 THEN strpos(text, substr(text, 3, 12)) - 1 END AS char_start, CASE WHEN length(text) > 2 THEN strpos(text, substr(text, 3, 12)) - 1 + length(substr(text, 3, 12)) END AS char_end, 'as told' AS rationale FROM documents",
        "model_answers_cached": f"SELECT doc_id, 'words: ' || {TOKENS.format('text')} AS answer, '' AS error FROM documents",
        "jsonl_documents": "SELECT doc_id::VARCHAR AS doc_id, source AS subject, length(text) AS n_chars FROM documents WHERE trim(text) <> ''",
        "exported_posts": "SELECT doc_id::VARCHAR AS doc_id, source AS subject, (DATE '2020-01-01' + (doc_id % 365)::INT)::VARCHAR AS date, length(text) AS n_chars FROM documents WHERE trim(text) <> ''",
        "percentile_rank": f"WITH {GRAPH} SELECT id, round(cume_dist() OVER (ORDER BY degree_centrality) + 1e-9, 6) AS p FROM deg",
        "betweenness": f"WITH {GRAPH},\n{between()} SELECT id, round(betweenness + 1e-9, 6) AS betweenness FROM bc",
        "network_hits": f"WITH {net} SELECT doc_id, detection_id, round(round(confidence::DOUBLE, 3) + 1e-9, 6) AS confidence FROM nhits",
        "network_grades": f"WITH {dims({'network_brokerage': every['network_brokerage']})},\n{net},\ndoc AS (SELECT id AS doc_id, 0 AS token_count FROM ent),\nhits AS (SELECT doc_id, 'network_brokerage' AS lens_id, detection_id, round(confidence::DOUBLE, 3) AS confidence FROM nhits),\n{GRADE} {summed}",
        "two_lane_profile": f"WITH {dims({**text, 'revolving_door': every['revolving_door']})},\n{careers(49)},\n{CAREER_HITS},\nquoted AS (SELECT doc_id, detection_id, confidence FROM chits),\n"
        + f"tdoc AS (SELECT doc_id, source, text, {TOKENS.format('text')} AS token_count FROM documents WHERE trim(text) <> ''),\n"
        + "doc AS (SELECT doc_id::VARCHAR AS doc_id, text, token_count, source AS subject, 'text' AS lane FROM tdoc UNION ALL SELECT id, '', 0, id, 'graph' FROM ent),\n"
        + HITS.replace("hits AS (", "thits AS (")
        + ",\nhits AS (SELECT doc_id, lens_id, detection_id, confidence FROM thits UNION ALL SELECT doc_id, 'revolving_door', detection_id, confidence::DOUBLE FROM quoted),\n"
        + f"{GRADE} SELECT lane, subject, lens_id, round(max(idx) + 1e-9, 6) AS index FROM graded WHERE (lane = 'graph') = (lens_id = 'revolving_door') GROUP BY ALL",
        "affiliations": f"WITH {GRAPH},\nends AS (SELECT source AS id, target AS other FROM edge UNION ALL SELECT target, source FROM edge) SELECT e.id, array_to_string(list_sort(list(DISTINCT n.name)), '|') AS affiliations, count(DISTINCT n.name) AS n_affiliations FROM ends e JOIN ent n ON n.id = e.other GROUP BY e.id",
        "affiliation_counts": f"WITH {GRAPH},\nends AS (SELECT source AS id, target AS other FROM edge UNION ALL SELECT target, source FROM edge) SELECT e.id, count(DISTINCT n.name) AS n_affiliations FROM ends e JOIN ent n ON n.id = e.other GROUP BY e.id",
        "career_spans": f"""WITH {careers(49)} SELECT id AS doc_id, 'three-plus-moves' AS detection_id, chain || ' [' || n_moves || ' moves]' AS span FROM car WHERE n_moves >= 3 AND id IN (SELECT id FROM ent)
UNION ALL SELECT id, 'crosses-gov-industry', chain || ' [crosses gov <-> industry: ' || array_to_string(list_filter(['fin', 'tech'], lambda x: list_contains(s, x)), ', ') || ']' FROM car WHERE list_contains(s, 'gov') AND list_has_any(s, ['fin', 'tech']) AND id IN (SELECT id FROM ent)""",
        "entity_lookup_many": "WITH q AS (SELECT DISTINCT lower(trim(right(c_name, 4))) AS q FROM customer), m AS (SELECT q, s_suppkey AS id, s_name AS name, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN lower(s_name) = q OR s_suppkey::VARCHAR = q THEN 0 ELSE 1 END, s_suppkey) AS r FROM q JOIN supplier ON contains(lower(s_name), q) OR contains(s_suppkey::VARCHAR, q))\n"
        "SELECT c_custkey AS query_id, m.id, m.name FROM customer JOIN m ON m.q = lower(trim(right(c_name, 4))) AND r = 1",
        "graph_documents": """WITH last AS (SELECT o_custkey, max_by(o_orderstatus || '-' || o_orderkey, o_orderkey) AS clerk, max_by(o_orderkey, o_orderkey) AS k FROM orders GROUP BY o_custkey)
SELECT 'entity' AS kind, 'C' || o_custkey AS a, clerk AS b, CASE WHEN k % 2 = 0 THEN 'http://orders/' || k ELSE 'https://orders/' || k END AS c FROM last
UNION ALL SELECT 'edge', 'C' || o_custkey, left(o_orderpriority, 1), CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END FROM orders""",
        "graph_subject_sources": "SELECT 'C' || o_custkey AS id, count(*) AS n_sources FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY ALL",
        "entity_lookup": "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE contains(lower(s_name), 'supplier') ORDER BY CASE WHEN lower(s_name) = 'supplier' THEN 0 ELSE 1 END, s_suppkey LIMIT 1",
        "eval_floor": f"{graded},\nfx AS (SELECT l.doc_id, quality = 0 AS fire, toxic = 1 AS skip, coalesce(present, 0) > 0 AS fired, coalesce(s, 0) >= 0.3 AS hit FROM labels l LEFT JOIN (SELECT doc_id, present FROM graded WHERE lens_id = 'morpheme_register') USING (doc_id) LEFT JOIN (SELECT doc_id, s FROM m WHERE marker_id = 'latinate') USING (doc_id)) "
        "SELECT count(*) FILTER (NOT skip AND fire AND fired) AS pos_hit, count(*) FILTER (NOT skip AND fire) AS pos_total, count(*) FILTER (NOT skip AND NOT fire AND NOT fired) AS neg_quiet, count(*) FILTER (NOT skip AND NOT fire) AS neg_total, count(*) FILTER (NOT skip AND fire AND hit) AS cover_hit, count(*) FILTER (NOT skip AND fire) AS cover_total, count(*) FILTER (skip) AS skipped, count(*) FILTER (NOT skip AND ((fire AND (NOT fired OR NOT hit)) OR (NOT fire AND fired))) AS failures FROM fx",
        "eval_confusion": f"""WITH {dims({"morpheme_register": text["morpheme_register"]})},\n{DOC.replace("WHERE trim(text) <> ''", "")},\n{HITS},
kept AS (SELECT DISTINCT doc_id FROM hits JOIN (SELECT doc_id, {fenced} AS c FROM documents) USING (doc_id) WHERE NOT contains({clean}, {_q(REFUSED)})),
cs AS (SELECT quality = 1 AS e, k.doc_id IS NOT NULL AS k FROM documents d JOIN labels USING (doc_id) LEFT JOIN kept k USING (doc_id))
SELECT *, fp = 0 AND fn = 0 AS passed FROM (SELECT count(*) FILTER (e AND k) AS tp, count(*) FILTER (NOT e AND k) AS fp, count(*) FILTER (e AND NOT k) AS fn, count(*) FILTER (NOT e AND NOT k) AS tn FROM cs)""",
        "verify_receipts": f"WITH {dims(text)},\n{DOC},\n{HITS} SELECT doc_id, lens_id, detection_id, 0.9::DOUBLE AS confidence, span, char_start FROM hits JOIN (SELECT doc_id, {fenced} AS c FROM doc) USING (doc_id) WHERE NOT contains({clean}, {_q(REFUSED)})",
        "prompts": f"WITH {heads},\nd AS (SELECT doc_id, lens_id, head || {_q(OPENING)} || {clean} || {_q(CLOSING + ASK_HITS)} AS prompt FROM (SELECT doc_id, {fenced} AS c FROM documents) CROSS JOIN head) SELECT doc_id, lens_id, length(prompt) AS n_chars, sha256(prompt) AS prompt_sha256 FROM d",
        "network_receipts": f"WITH {net},\n{receipt}",
        "delta_lines": f"{drift} SELECT '- **New on the board:** ' || string_agg(i, ', ' ORDER BY i) AS line FROM both_ WHERE added HAVING count(*) > 0 UNION ALL SELECT '- **Dropped:** ' || string_agg(i, ', ' ORDER BY i) FROM both_ WHERE removed HAVING count(*) > 0 "
        "UNION ALL SELECT '- **' || i || ':** ' || concat_ws('; ', CASE WHEN f THEN 'FACT ' || f0 || '->' || f1 || ' (' || CASE WHEN up >= 0 THEN '+' ELSE '' END || up || ')' END, CASE WHEN m THEN 'markers ' || m0 || '->' || m1 END) FROM moved",
        "board_receipts": f"WITH {RECORDS} SELECT institution, row_number() OVER (PARTITION BY institution ORDER BY score DESC, ord) AS place, marker, actor, assurance, round(score + 1e-9, 6) AS score, CASE WHEN l_linenumber = 7 THEN '' ELSE 'order/' || (ord // 10) END AS receipts FROM rec",
        "board_credits": f"WITH {RECORDS} SELECT institution, count(*) AS n_records, count(*) FILTER (sc > 0) AS n_credits, round(coalesce(sum(sc) FILTER (sc > 0), 0) + 1e-9, 6) AS credits FROM rec GROUP BY institution",
        "lens_summary": f"WITH {_values('x', 'lens_id, markers, n_detections, n_cues', lens_rows)} SELECT lens_id, markers, n_detections::BIGINT AS n_detections, n_cues::BIGINT AS n_cues FROM x",
        "cue_snapshot": f"WITH {_values('x', 'lens_id, marker_id, detection_id, n_cues', cue_rows)} SELECT lens_id, marker_id, detection_id, n_cues::BIGINT AS n_cues FROM x",
        "detect_api": f"WITH {dims(few)},\n{DOC},\n{HITS},\n{GRADE} SELECT doc_id, lens_id, round(idx + 1e-9, 6) AS index FROM graded",
        "event_windows": "SELECT (ts::DATE)::VARCHAR AS day, event_type, count(*) AS n, round(sum(value) + 1e-9, 6) AS total FROM events GROUP BY ALL",
    }
