"""The library's functions under SQL names, for one session: scalar ones, and table functions that a query joins laterally.

They are SQL functions, which Catalyst inlines where they are called: no Python, no join, and what a caller does not select is not
computed. Beyond CASES cues cue_hits() reads the places that the automaton finds in one pass of a text (a Python function over Arrow).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lensmark.functions.text import INJECTION
from lensmark.operators import detection
from lensmark.plans.lenses import Lens, load_lenses, text_lenses


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_STRIP = r"regexp_replace(regexp_replace({0}, '(?U)^\\s+', ''), '(?U)\\s+$', '')"
SCALAR = {
    "token_estimate(text STRING) RETURNS INT": r"greatest(1, CAST(regexp_count(coalesce(text, ''), '(?U)\\S+') / CAST(0.75 AS DOUBLE) AS INT))",
    "html_to_text(html STRING) RETURNS STRING": r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript).*?</\\1>', ' '), '(?s)<[^>]+>', ' '), '(?U)\\s+', ' '))",
    "injection_flag(text STRING) RETURNS BOOLEAN": f"coalesce(text, '') RLIKE {_q(INJECTION)}",
    "blank(text STRING) RETURNS BOOLEAN": f"coalesce({_STRIP.format('text')}, '') = ''",
    "span_start(text STRING, span STRING) RETURNS INT": "CASE WHEN length(span) > 0 AND instr(text, span) > 0 THEN instr(text, span) - 1 END",
    "top_percent(percentile DOUBLE) RETURNS INT": "greatest(1, CAST(bround((1.0 - percentile) * 100, 0) AS INT))",
}
_HIT = "lens_id STRING, detection_id STRING, confidence DOUBLE, span STRING, char_start INT, char_end INT, rationale STRING, hit_ord INT"
_CUE = "array<struct<lens_id:string,detection_id:string,det_ord:int,cue:string,at:int>>"


def _cue_array(spark: SparkSession, cues: list[tuple[str, str, int, list[str]]], text: str) -> str:
    """SQL for the cues of a text, one a detection at most. The lower-cased text is a lambda's variable, so it is made once."""
    if not cues:
        return f"CAST(array() AS {_CUE})"
    if sum(len(x[3]) for x in cues) > detection.CASES:
        finder = detection.CueFinder(cues)
        spark.udf.register("cue_places", F.arrow_udf(lambda low: finder(low), "array<struct<cue:int,at:int>>"))
        known = ", ".join(f"named_struct('lens_id', {_q(a)}, 'detection_id', {_q(b)}, 'det_ord', {i}, 'cue', {_q(c)})" for a, b, i, own in cues for c in own)
        told = "named_struct('lens_id', k.lens_id, 'detection_id', k.detection_id, 'det_ord', k.det_ord, 'cue', k.cue, 'at', p.at)"
        return f"CAST(transform(cue_places(lower({text})), p -> transform(array(get(array({known}), p.cue)), k -> {told})[0]) AS {_CUE})"
    cases = []
    for lens, found, order, own in cues:
        whens = " ".join(f"WHEN contains(low, {_q(c.strip().lower())}) THEN named_struct('lens_id', {_q(lens)}, 'detection_id', {_q(found)}, 'det_ord', {order}, 'cue', {_q(c)}, 'at', instr(low, {_q(c.strip().lower())}))" for c in own)
        cases.append(f"CASE {whens} END")
    return f"CAST(transform(array(lower({text})), low -> array_compact(array({', '.join(cases)})))[0] AS {_CUE})"


def register(spark: SparkSession, lenses: dict[str, Lens] | None = None) -> list[str]:
    """Makes temporary functions of this session, with those lenses (the own text lenses, if none are given), and returns their names.

    Table functions: cue_hits(text, lens) - the hits of a text under a lens, or under all where lens is null; marker_sums(text, lens) - what its hits add up to by
    marker (capped at 1), those with hits only.
    """
    lenses = text_lenses(load_lenses()) if lenses is None else lenses
    for head, body in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    cues = detection._cues(lenses)
    # One projection over one generator over one row: the form that Catalyst inlines into the outer row instead of joining back by text.
    own = f"filter({_cue_array(spark, cues, 'cue_hits.text')}, c -> cue_hits.lens IS NULL OR c.lens_id = cue_hits.lens)"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION cue_hits(text STRING, lens STRING DEFAULT NULL) RETURNS TABLE({_HIT}) RETURN "
        f"SELECT c.lens_id, c.detection_id, CAST({detection.CUE_CONFIDENCE} AS DOUBLE), substr(cue_hits.text, c.at, length(c.cue)), c.at - 1, c.at - 1 + length(c.cue), concat({_q(detection.CUE_RATIONALE)}, c.cue, {_q("'")}), c.det_ord "
        f"FROM (SELECT explode({own}) AS c)"
    )
    weights = lambda m: "map(" + ", ".join(f"{_q(d.id)}, CAST({d.weight} AS DOUBLE)" for d in m.detections) + ")" if m.detections else "CAST(map() AS MAP<STRING, DOUBLE>)"
    markers = ", ".join(f"named_struct('lens', {_q(x.id)}, 'marker', {_q(m.id)}, 'weights', {weights(m)})" for x in lenses.values() for m in x.markers)
    added = f"aggregate(found, CAST(0 AS DOUBLE), (a, h) -> a + IF(h.lens_id = m.lens, CAST({detection.CUE_CONFIDENCE} AS DOUBLE) * coalesce(try_element_at(m.weights, h.detection_id), CAST(0 AS DOUBLE)), CAST(0 AS DOUBLE)))"
    sums = f"transform(array({_cue_array(spark, cues, 'marker_sums.text')}), found -> transform(array({markers}), m -> named_struct('lens', m.lens, 'marker', m.marker, 'score', least(CAST(1 AS DOUBLE), {added}))))[0]" if markers else "CAST(array() AS array<struct<lens:string,marker:string,score:double>>)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION marker_sums(text STRING, lens STRING DEFAULT NULL) RETURNS TABLE(lens_id STRING, marker_id STRING, score DOUBLE) RETURN "
        f"SELECT s.lens, s.marker, s.score FROM (SELECT explode(filter({sums}, s -> s.score > 0 AND (marker_sums.lens IS NULL OR s.lens = marker_sums.lens))) AS s)"
    )
    return [*(head.split("(")[0] for head in SCALAR), "cue_hits", "marker_sums"]
