"""Timing that checks first: no ratio of two ways to compute something is given
unless their results are the same, bit for bit."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numerics import Reduction, bits_column
from .functions.text import plain_tokens
from .operators import ranking, scoring
from .operators.model import embed, fit
from .sources.corpora import SyntheticSpec, synthetic


class ResultsDiffer(AssertionError):
    """Two ways that should agree do not; nothing was timed."""


def check_same_bits(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> int:
    """Rows compared; a key that one side lacks, or a value that differs in any
    bit, raises."""
    x = a.select(*keys, bits_column(F.col(value)).alias("__x"))
    y = b.select(*keys, bits_column(F.col(value)).alias("__y"))
    both = x.join(y, keys, "full_outer")
    got = both.agg(F.count("*").alias("n"), F.count_if(~F.col("__x").eqNullSafe(F.col("__y"))).alias("off")).first()
    if got["off"]:
        raise ResultsDiffer(f"{got['off']} of {got['n']} values differ")
    return got["n"]


def check_same_order(a: DataFrame, b: DataFrame) -> int:
    """Two rankings ``query_id, rnk, doc_id`` put the same document at each rank."""
    x = a.select("query_id", "rnk", F.col("doc_id").alias("__x"))
    y = b.select("query_id", "rnk", F.col("doc_id").alias("__y"))
    got = x.join(y, ["query_id", "rnk"], "full_outer").agg(F.count("*").alias("n"), F.count_if(~F.col("__x").eqNullSafe(F.col("__y"))).alias("off")).first()
    if got["off"]:
        raise ResultsDiffer(f"{got['off']} of {got['n']} ranks differ")
    return got["n"]


@dataclass(frozen=True)
class Timing:
    name: str
    best: float
    runs: int


def measure(name: str, run: Callable[[], DataFrame], repeats: int = 3) -> Timing:
    """Least wall-clock seconds of several runs after one that does not count."""
    times = []
    for i in range(repeats + 1):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    return Timing(name, min(times[1:]), repeats)


def run_benchmarks(spark: SparkSession, n_docs: int = 2000, n_queries: int = 20, terms: int = 8, k: int = 10, repeats: int = 3) -> dict:
    """Fit apart from scoring and ranking, on the synthetic corpus; joins of
    either kind must score alike before either is timed."""
    data = synthetic(spark, SyntheticSpec(n_docs=n_docs))
    docs = data.documents.select("doc_id", plain_tokens(F.col("text")).alias("features")).persist()
    docs.count()
    began = time.perf_counter()
    model = fit(docs, keep=lambda df: df.persist())
    model.stats.count(), model.weights.count()
    seconds = {"fit": time.perf_counter() - began}
    words = model.vocab.orderBy(F.xxhash64("token"), "token").limit(n_queries * terms).withColumn("i", F.xxhash64("token"))
    queries = words.select(F.concat(F.lit("q"), F.pmod("i", F.lit(n_queries)).cast("string")).alias("query_id"), "token").groupBy("query_id").agg(F.sort_array(F.collect_list("token")).alias("features"))
    vectors = embed(model, queries).persist()
    vectors.count()
    ways = {h: (lambda h=h: scoring.touched_scores(model, vectors, hint=h)) for h in ("broadcast", "shuffle_hash", "merge")}
    n = check_same_bits(ways["broadcast"](), ways["merge"](), ["query_id", "doc_id"], "score")
    check_same_bits(ways["broadcast"](), ways["shuffle_hash"](), ["query_id", "doc_id"], "score")
    attrs = ranking.dense_ranks(data.documents, ranking.DEFAULT_ATTRIBUTES).persist()
    scores = ways["broadcast"]().persist()
    ids = queries.select("query_id")
    full = scoring.all_scores(model, vectors, ids)
    top = lambda: ranking.top(scores, ids, attrs, "pi", k)
    check_same_order(top(), ranking.rank(full, attrs, "pi", k))
    for name, run in (*((f"score_{h}", w) for h, w in ways.items()), ("top_k", top), ("rank_all", lambda: ranking.rank(full, attrs, "pi"))):
        seconds[name] = measure(name, run, repeats).best
    for policy in Reduction:
        seconds[f"norms_{policy.value}"] = measure(policy.value, lambda p=policy: scoring.norms(model.weights, reduction=p), 1).best
    return {"documents": model.n_documents, "queries": queries.count(), "scores": n, "seconds": {k: round(v, 4) for k, v in seconds.items()}}


def format_report(report: dict) -> str:
    lines = [f"{report['documents']} documents, {report['queries']} queries, {report['scores']} scores above 0"]
    return "\n".join(lines + [f"{name:24s} {1000 * s:10.1f} ms" for name, s in report["seconds"].items()])
