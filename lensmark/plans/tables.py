"""The driver's tables seen as documents, hits, graphs, careers and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lensmark.sources.scratch import importable

#: Sectors by nation or brand number, modulo 10.
SECTORS = ["tech", "fin", "gov", "tank", "intel", "media", "academia", "legal", "civil", "other"]
#: What an order's priority says of a career edge; 4 says nothing.
RELATIONS = {"1": "employed-by", "2": "moved-to", "3": "member-of", "5": "funded-by"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("subject"), F.lit(None).cast("string").alias("date"), F.col("doc_id").alias("ord"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as subjects; turns are their dates."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat("conv_id", F.lit("/"), "turn").alias("doc_id"), "text", F.col("conv_id").cast("string").alias("subject"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("date"), F.col("turn").alias("ord"))


def event_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A user's days as documents of 250 tokens an event, and their events as hits."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").cast("string").alias("date"), "event_id", "event_type", "value")
    e = e.withColumn("doc_id", F.concat("user_id", F.lit("/"), "date"))
    docs = e.groupBy("doc_id", "user_id", "date").agg((F.count("*") * 250).alias("token_count")).withColumns({"subject": F.col("user_id").cast("string"), "ord": F.lit(0)})
    hits = e.select("doc_id", F.lit("event_register").alias("lens_id"), F.col("event_type").alias("detection_id"), (F.col("value") / 100).alias("confidence"))
    return docs.drop("user_id"), hits


def sector(number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, SECTORS)), (F.pmod(number.cast("int"), F.lit(10)) + 1).cast("int"))


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and the two brands of which most came back; entities and edges."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), sector(F.col("s_nationkey")).alias("sector"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    number = F.regexp_extract("p_brand", "[0-9]+", 0)
    b = p.select("p_brand").distinct().select(F.col("p_brand").alias("id"), F.col("p_brand").alias("name"), sector(number).alias("sector"))
    back = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey", "l_quantity").join(p, F.col("l_partkey") == F.col("p_partkey"))
    sums = back.groupBy("l_suppkey", "p_brand").agg(F.sum("l_quantity").alias("q"))
    top = sums.withColumn("r", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("q"), "p_brand"))).filter("r <= 2")
    edges = top.select(F.concat(F.lit("S"), "l_suppkey").alias("source"), F.col("p_brand").alias("target"), F.lit(None).cast("string").alias("rel"))
    return s.unionByName(b), edges


def careers(spark: SparkSession, sf_dir: str, least: int = 46) -> tuple[DataFrame, DataFrame]:
    """Customers who move to suppliers by large order lines; entities and edges."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_name").alias("name"), sector(F.col("c_nationkey")).alias("sector"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), sector(F.col("s_nationkey")).alias("sector"))
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= least).select("l_orderkey", "l_linenumber", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.left("o_orderpriority", F.lit(1)).alias("p"))
    rel = F.coalesce(*(F.when(F.col("p") == k, F.lit(v)) for k, v in RELATIONS.items()))
    order = F.struct("o_orderdate", "o_orderkey", "l_linenumber")
    edges = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("C"), "o_custkey").alias("source"), F.concat(F.lit("S"), "l_suppkey").alias("target"), rel.alias("rel"), order.alias("edge_ord"))
    return c.unionByName(s), edges


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as evidence about suppliers."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    # orders meet customers first, so that lines, many times as many, are not shuffled for it
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")
    j = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    assurance = F.when(F.col("l_returnflag") == "R", "FACT").when(F.col("l_returnflag") == "A", "ATTRIBUTED").otherwise("RUMOR")
    receipts = F.when(F.col("l_linenumber") == 7, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("order/"), "l_orderkey")))
    lens = F.when(F.col("l_linenumber") == 6, F.lit("no_such_lens")).otherwise(F.lit("license_register"))
    return j.select(
        F.col("s_name").alias("institution"), lens.alias("lens"), F.col("p_type").alias("marker"), F.col("l_linestatus").alias("move"), F.col("c_mktsegment").alias("actor"), assurance.alias("assurance"),
        (F.col("l_quantity") / 50).alias("severity"), (F.col("l_discount") * 5).alias("self_correction"), F.col("p_type").alias("span"), receipts.alias("receipts"), F.lit(None).cast("string").alias("note"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_shipdate").cast("date").cast("string").alias("day"),
    )
