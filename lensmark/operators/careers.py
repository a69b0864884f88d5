"""Careers and funding: hits for every subject of a typed edge list.

entities: id, name, sector; edges: source, target, rel, edge_ord. Aggregates by subject; lists, as long as one subject's own moves, are
made only where a chain is shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensmark.functions.text import chain_label
from lensmark.operators.grading import grade_rows
from lensmark.plans.lenses import Lens

LENS = "revolving_door"
# Relations that are moves; sectors that watch, that are watched, and government.
MOVES = ["employed-by", "moved-to", "founded", "member-of", "appointed-by", "recruited"]
MONITOR, INDUSTRY, GOVERNMENT = ["intel", "media", "tank"], ["fin", "tech"], ["gov"]


def is_move(rel: Column) -> Column:
    """A relation that moves someone, or none at all: an affiliation of an untyped graph."""
    return rel.isNull() | (rel == "") | rel.isin(*MOVES)


def _named(edges: DataFrame, entities: DataFrame, end: str) -> DataFrame:
    e = entities.select(F.col("id").alias(end), F.col("name").alias("n"), F.col("sector"))
    return edges.join(e, end, "left").withColumn("name", F.coalesce("n", F.col(end).cast("string"))).drop("n")


def moves(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that are moves, with the target's name and sector."""
    return _named(edges.filter(is_move(F.col("rel"))), entities, "target")


def careers(entities: DataFrame, edges: DataFrame, chains: bool = True) -> DataFrame:
    """Per source of moves: n_moves, sectors (sorted), untyped (all moves lack a relation) and, if wanted, chain. Without it nothing is kept of a source but counts
    and sectors, so that one with any share of all moves is partial sums."""
    known = [F.count("*").alias("n_moves"), F.array_sort(F.collect_set("sector")).alias("sectors"), F.every(F.col("rel").isNull() | (F.col("rel") == "")).alias("untyped")]
    path = [F.array_sort(F.collect_list(F.struct("edge_ord", "name", "sector"))).alias("path")] if chains else []
    grouped = moves(entities, edges).groupBy(F.col("source").alias("id")).agg(*known, *path)
    return grouped.withColumn("chain", chain_label(F.col("path"))).drop("path") if chains else grouped


def funding(entities: DataFrame, edges: DataFrame, lists: bool = True) -> DataFrame:
    """Per funder (the target of ``funded-by``): n_recipients (repeats count), recipient_sectors and, if wanted, recipients."""
    named = _named(edges.filter("rel = 'funded-by'"), entities, "source")
    known = [F.count("*").alias("n_recipients"), F.array_sort(F.collect_set("sector")).alias("recipient_sectors")]
    path = [F.array_sort(F.collect_list(F.struct("edge_ord", "name", "sector"))).alias("path")] if lists else []
    grouped = named.groupBy(F.col("target").alias("id")).agg(*known, *path)
    return grouped.withColumn("recipients", F.regexp_replace(chain_label(F.col("path")), " -> ", ", ")).drop("path") if lists else grouped


def _of(sectors: Column, wanted: list[str]) -> Column:
    return F.array_intersect(F.array(*map(F.lit, wanted)), sectors)


def _career_rows(entities: DataFrame, edges: DataFrame, spans: bool) -> DataFrame:
    """doc_id and hits, a row an entity. Without spans no chain and no list of recipients is made."""
    known = entities.select("id", F.coalesce("name", F.col("id").cast("string")).alias("name"))
    rows = known.join(careers(entities, edges, spans), "id", "left").join(funding(entities, edges, spans), "id", "left")
    if not spans:
        rows = rows.withColumns({"chain": F.lit(None).cast("string"), "recipients": F.lit(None).cast("string")})
    none = F.array().cast("array<string>")
    s, r = F.coalesce("sectors", none), F.coalesce("recipient_sectors", none)
    n, k, f = F.coalesce("n_moves", F.lit(0)), F.size(s), F.coalesce("n_recipients", F.lit(0))
    monitor, industry = _of(s, MONITOR), _of(s, INDUSTRY)
    listed = F.array_join(s, ", ")
    spread = F.concat(F.col("chain"), F.lit(" ["), n, F.lit(" moves, "), k, F.lit(" sectors: "), listed, F.lit("]"))
    count = F.concat(F.col("chain"), F.lit(" ["), n, F.lit(" moves]"))
    one = F.lit(1.0)
    rules = [
        ("spans-three-sectors", k >= 3, F.least(one, 0.85 + 0.05 * (k - 3)), spread, F.concat(F.lit("moves across "), k, F.lit(" sectors"))),
        ("spans-four-plus-sectors", k >= 4, one, spread, F.concat(F.lit("moves across "), k, F.lit(" sectors"))),
        ("three-plus-moves", n >= 3, F.least(one, 0.8 + 0.1 * (n - 3)), count, F.concat(n, F.lit(" moves"))),
        ("five-plus-moves", n >= 5, one, count, F.concat(n, F.lit(" moves"))),
        ("watchdog-then-join", (F.size(monitor) > 0) & (F.size(industry) > 0), one, F.concat(F.col("chain"), F.lit(" [monitor: "), F.array_join(monitor, ", "), F.lit(" -> industry: "), F.array_join(industry, ", "), F.lit("]")), F.lit("a monitoring and an industry sector")),
        ("crosses-gov-industry", (F.size(_of(s, GOVERNMENT)) > 0) & (F.size(industry) > 0), one, F.concat(F.col("chain"), F.lit(" [crosses gov <-> industry: "), F.array_join(industry, ", "), F.lit("]")), F.lit("government and industry")),
        ("funds-three-plus", f >= 3, F.least(one, 0.8 + 0.05 * (f - 3)), F.concat(F.col("name"), F.lit(" funds: "), F.col("recipients"), F.lit(" ["), f, F.lit(" recipients]")), F.concat(F.lit("funds "), f, F.lit(" recipients"))),
        ("funds-recipient-and-evaluator", F.arrays_overlap(r, F.array(*map(F.lit, INDUSTRY))) & F.array_contains(r, "tank"), one, F.concat(F.col("name"), F.lit(" funds both an industry node and an evaluating body: "), F.col("recipients")), F.lit("recipient and evaluator")),
    ]
    note = F.when(F.coalesce("untyped", F.lit(False)), F.lit(" (untyped affiliations; order is not known)")).otherwise(F.lit(""))
    made = [
        F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(i).alias("hit_ord"), F.lit(LENS).alias("lens_id"), F.lit(d).alias("detection_id"), c.alias("confidence"), span.alias("span"), F.concat(why, note).alias("rationale")))
        for i, (d, rule, c, span, why) in enumerate(rules)
    ]
    return rows.select(F.col("id").alias("doc_id"), F.filter(F.array(*made), lambda h: h.isNotNull()).alias("hits"))


def career_hits(entities: DataFrame, edges: DataFrame, spans: bool = True) -> DataFrame:
    """Hits for every entity, in the order of the rules: doc_id (the entity) and the columns of a hit; spans are null if they are not wanted."""
    hits = _career_rows(entities, edges, spans).select("doc_id", F.explode("hits").alias("h"))
    return hits.select("doc_id", "h.lens_id", "h.detection_id", "h.confidence", "h.span", "h.rationale", "h.hit_ord")


def career_grades(entities: DataFrame, edges: DataFrame, lenses: dict[str, Lens], rounded: bool = True, receipts: bool = True) -> DataFrame:
    rows = _career_rows(entities, edges, receipts).withColumn("token_count", F.lit(0))
    return grade_rows(rows, {LENS: lenses[LENS]}, rounded, receipts)
