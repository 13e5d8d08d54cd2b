"""Incremental document frequencies, and scoring of a stream of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.model import Model, embed
from ..operators.ranking import rank
from ..operators.scoring import touched_scores


def streaming_frequencies(docs: DataFrame, features_col: str = "features") -> DataFrame:
    """``token, df, cf`` of a stream of documents (each arriving once): integer
    sums, so every trigger is exact.  Write in ``update`` or ``complete`` mode."""
    per_doc = docs.select(F.explode(F.array_distinct(features_col)).alias("token"), F.col(features_col).alias("f"))
    n = F.size(F.filter("f", lambda x: x == F.col("token")))
    return per_doc.select("token", n.alias("n")).groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


def score_stream(queries: DataFrame, model: Model, attributes: DataFrame, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Rank each micro-batch of ``queries(query_id, features)`` against a frozen
    model; top-k rows are appended to ``path`` by batch."""

    def one(batch: DataFrame, batch_id: int) -> None:
        top = rank(touched_scores(model, embed(model, batch)), attributes, "pi").where(F.col("rnk") <= k)
        top.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
