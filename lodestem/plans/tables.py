"""The driver tables in the roles of corpus, queries, attributes, interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_tokens
from ..operators.ranking import Attribute


#: Stored bytes of a part of the corpus (about twice as many of text).
PART_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows by a key, so that counts per key need no exchange of their own:
    over all cores (a small file is one input split), and in parts of bounded
    size, so that no task's table of counts grows with the input."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # noqa: SLF001
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), key)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, features``: lower-case ASCII words of ``documents``."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"), "doc_id")
    return docs.select("doc_id", plain_tokens(F.col("text")).alias("features"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, features`` of ``benchmark``."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), plain_tokens(F.col("text")).alias("features"))


TEXT_ATTRIBUTES = (Attribute("popularity", "popularity"), Attribute("rating", ("rating_num", "rating_den"), "ratio"), Attribute("engagement", "engagement"))


def text_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, labelled quality (missing without a label) and number of lines."""
    # lines are counted before the join: no text travels
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.size(F.split("text", "\n", -1)).cast("long").alias("engagement"))
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = docs.join(lab, "doc_id", "left")
    return out.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("n_chars").alias("popularity"),
        F.col("quality").cast("long").alias("rating_num"),
        F.when(F.col("quality").isNotNull(), F.lit(1)).otherwise(0).cast("long").alias("rating_den"),
        "engagement",
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, doc_id, weight``: customers, parts, largest quantity."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("o_custkey").cast("string").alias("user_id"), F.col("l_partkey").cast("string").alias("doc_id")).agg(F.max("l_quantity").alias("weight"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, features`` of ``part``: words of name, type and brand."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("doc_id"), plain_tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("features"))


def item_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of each part: lines, mean quantity as an exact ratio, suppliers."""
    li = table(spark, sf_dir, "lineitem")
    agg = li.groupBy("l_partkey").agg(F.count("*").alias("popularity"), F.sum(F.col("l_quantity").cast("long")).alias("rating_num"), F.count("*").alias("rating_den"), F.countDistinct("l_suppkey").alias("engagement"))
    p = table(spark, sf_dir, "part").select("p_partkey")
    return p.join(agg, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_partkey").cast("string").alias("doc_id"), "popularity", "rating_num", "rating_den", "engagement")
