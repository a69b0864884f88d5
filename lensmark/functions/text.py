"""Scalar text functions, all built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: phrases that mark an attempt to instruct a reader that is a model.
INJECTION = (
    r"(?i)("
    r"ignore (all |the |any |your )?(previous|prior|above|preceding)|"
    r"disregard (the |all |any )?(previous|prior|above|instructions?)|"
    r"forget (everything|all|the above|previous)|"
    r"you are (now|actually|really)\b|new instructions?\b|system prompt|developer (message|mode)|"
    r"</?(system|instructions?|prompt)>|\[/?(system|inst|instructions?)\]|"
    r"jailbreak|do anything now|\bDAN\b|"
    r"(reveal|print|output|repeat|ignore) (your |the |all )?(system )?(prompt|instructions?|rules)|"
    r"act as (an?|the)\b|pretend (to be|you are)|roleplay as|"
    r"respond (only )?with|return (only |exactly )?(the )?(json|\{)|do not (analyze|follow|flag)"
    r")"
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row: a lambda's variable is not inlined where it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def token_estimate(text: Column) -> Column:
    """Words by white space over 0.75, 1 at least."""
    return F.greatest(F.lit(1), (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+")) / F.lit(0.75)).cast("int"))


def html_to_text(html: Column) -> Column:
    """Visible text: script, style and noscript bodies and all tags as spaces, white space collapsed. Entities stay."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript).*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def injection_flag(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(INJECTION)


def sanitize(text: Column, limit: int = 20_000) -> Column:
    """STRUCT<clean, flagged>: fences broken by zero-width spaces, then cut at ``limit`` characters; flagged tells of the raw text."""
    clean = F.replace(F.coalesce(text, F.lit("")), F.lit('"""'), F.lit('"​"​"'))
    cut = F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit), F.lit(" […truncated]"))).otherwise(clean)
    return F.struct(cut.alias("clean"), injection_flag(text).alias("flagged"))


def span_start(text: Column, span: Column) -> Column:
    """Where span first is, from 0, with case; null if it is empty or absent."""
    at = F.instr(text, span)
    return F.when((F.length(span) > 0) & (at > 0), at - 1).cast("int")


def strip_fences(text: Column) -> Column:
    """Without a surrounding Markdown code fence."""
    s = strip(text)
    body = F.when(F.instr(s, F.lit("\n")) > 0, F.regexp_replace(s, r"^[^\n]*\n", "")).otherwise(F.substring(s, 4, 2**31 - 1))
    fenced = F.regexp_replace(body, r"(?U)```\s*$", "")
    return F.when(s.startswith("```"), strip(fenced)).otherwise(s)


def iso_day(stamp: Column) -> Column:
    return F.left(stamp, F.lit(10))


def chain_label(moves: Column) -> Column:
    """``Name (sector) -> ...`` of an ordered array of structs with name and sector."""
    return F.array_join(F.transform(moves, lambda m: F.concat(m["name"], F.lit(" ("), F.coalesce(m["sector"], F.lit("?")), F.lit(")"))), " -> ")


def top_percent(percentile: Column) -> Column:
    """``top N%``, 1 at least; ties to even."""
    return F.greatest(F.lit(1), F.bround((F.lit(1.0) - percentile) * 100, 0).cast("int"))
