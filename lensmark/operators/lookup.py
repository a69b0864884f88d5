"""Entities by name for many queries at once, through an inverted index of three-character grams.

A query's best match is the entity whose id or name is the query, case aside, else the first in order whose name or id contains it.
Equal ones are found by a join on the lower-cased text. For the rest, a query of up to GRAM characters is itself a gram: its answer is the least
order of the entities that have it, an aggregate. A longer one takes as candidates the entities of its rarest gram, fewest as they are, and
these are verified by containment. Equal queries are one. No entity meets a query with which it shares no gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensmark.functions.text import strip

GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """Distinct stretches of ``size`` characters."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def lookup_many(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """entities: id, name, ord (unique); queries: query_id, query. query_id, id, name, ord and exact of each query's best match; queries without one, and blank ones, have no row."""
    asked = queries.select("query_id", F.lower(strip(F.col("query"))).alias("q")).filter("q <> ''")
    wanted = asked.select("q").distinct()
    known = entities.select("id", "name", "ord", F.array_distinct(F.array(F.lower(F.col("id").cast("string")), F.lower(F.coalesce("name", F.lit(""))))).alias("texts"))
    texts = known.select("id", "name", "ord", F.explode("texts").alias("t"))
    best = lambda: F.min_by(F.struct("id", "name", "ord"), "ord").alias("e")

    equal = texts.join(wanted, texts["t"] == wanted["q"]).groupBy("q").agg(best()).withColumn("exact", F.lit(True))
    rest = wanted.join(equal.select("q"), "q", "left_anti")

    short = rest.filter(F.length("q") <= GRAM)
    own = texts.select("id", "name", "ord", F.explode(F.flatten(F.array(*(_grams(F.col("t"), k) for k in range(1, GRAM + 1))))).alias("q"))
    brief = own.join(short, "q", "left_semi").groupBy("q").agg(best())

    # A gram's share of texts is counted once; a query is sought by the gram that fewest texts have, and by none that no text has.
    posted = texts.withColumn("g", F.explode(_grams(F.col("t"), GRAM)))
    share = posted.groupBy("g").agg(F.count("*").alias("n"))
    long = rest.filter(F.length("q") > GRAM).select("q", F.explode(_grams(F.col("q"), GRAM)).alias("g"))
    rarest = long.join(share, "g", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).filter("r.n > 0").select("q", "r.g")
    found = posted.join(rarest, "g").filter(F.contains("t", F.col("q"))).groupBy("q").agg(best())

    every = equal.unionByName(brief.unionByName(found).withColumn("exact", F.lit(False)))
    return asked.join(every, "q").select("query_id", "e.id", "e.name", "e.ord", "exact")
