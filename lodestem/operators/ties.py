"""Near-tie structure of rankings: balls, chains, cliques, inflation.

Near means ``abs(a - b) <= tau`` on the computed difference; a RANGE frame adds
tau to one side first and is wrong at the boundary.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import ChainInflation, TauExceedsRange


def check_tau(tau: float) -> float:
    if not tau >= 0.0:
        raise ValueError(f"tau must be a non-negative number, got {tau}")
    return float(tau)


def score_runs(ranking: DataFrame, query_ids: DataFrame | None = None, n_documents: int = 0) -> DataFrame:
    """``query_id, score, n``: how often each query has each score.  With
    ``query_ids``, the rows are the touched scores only, and the other documents
    of each query are one run of score 0."""
    if "n" in ranking.columns:
        return ranking
    rows = ranking.select("query_id", "score", F.lit(1).cast("long").alias("n"))
    if query_ids is not None:
        seen = ranking.groupBy("query_id").agg(F.count("*").alias("seen"))
        rest = query_ids.select("query_id").distinct().join(seen, "query_id", "left")
        rest = rest.select("query_id", F.lit(0.0).alias("score"), (F.lit(n_documents) - F.coalesce("seen", F.lit(0))).alias("n")).where("n > 0")
        rows = rows.unionByName(rest)
    # dealt by query once: the windows over runs need that anyway
    return rows.repartition("query_id").groupBy("query_id", "score").agg(F.sum("n").alias("n"))


def run_gaps(runs: DataFrame) -> DataFrame:
    """``query_id, rnk, gap`` of neighbouring scores that differ; neighbours
    within a run have gap 0, ``n - 1`` times."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"))
    rows = runs.withColumn("rnk", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("gap", F.col("score") - F.lead("score").over(w))
    return rows.where("gap is not null").select("query_id", "rnk", "gap")


def every_gap(runs: DataFrame) -> DataFrame:
    """``query_id, rnk, gap`` to the next rank, for every rank but the last."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"))
    rows = runs.withColumn("hi", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("next", F.col("score") - F.lead("score").over(w))
    rows = rows.select("query_id", "hi", "next", F.explode(F.sequence(F.col("hi") - F.col("n") + 1, "hi")).alias("rnk"))
    return rows.select("query_id", "rnk", F.when(F.col("rnk") < F.col("hi"), F.lit(0.0)).otherwise(F.col("next")).alias("gap")).where("gap is not null")


def closest(gaps: DataFrame, limit: int) -> DataFrame:
    """The smallest positive gaps: by gap, then rank, then query."""
    return gaps.where("gap > 0").orderBy("gap", "rnk", "query_id").limit(limit)


def chains(ranking: DataFrame, tau: float) -> DataFrame:
    """``query_id, chain, lo, hi`` (0-based, half-open): maximal runs of ranks
    whose neighbours are near.  Gaps and islands over one window of distinct
    scores; takes a ranking, or its ``score_runs``."""
    check_tau(tau)
    w = W.partitionBy("query_id").orderBy(F.desc("score"))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    cut = F.when(F.coalesce(F.lag("score").over(w) - F.col("score") > tau, F.lit(False)), 1).otherwise(0)
    marked = score_runs(ranking).withColumn("__cut", cut).withColumn("hi", F.sum("n").over(upto)).withColumn("chain", F.sum("__cut").over(upto))
    return marked.groupBy("query_id", "chain").agg(F.min(F.col("hi") - F.col("n")).alias("lo"), F.max("hi").alias("hi"))


def reach(scores: np.ndarray, tau: float) -> np.ndarray:
    """For each rank of a non-increasing array: the last rank that is near.

    The computed difference never shrinks along the order, so the rank found by
    bisection on ``score - tau`` is off by rounding only and is settled by the
    exact predicate."""
    n = len(scores)
    right = np.maximum(np.searchsorted(-scores, -(scores - tau), side="right") - 1, np.arange(n))
    while True:
        grow = (right + 1 < n) & (scores - scores[np.minimum(right + 1, n - 1)] <= tau)
        shrink = scores - scores[right] > tau
        if not grow.any() and not shrink.any():
            return right
        right = np.where(grow, right + 1, np.where(shrink, right - 1, right))


def _per_query(ranking: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(sorted scores) -> DataFrame`` for each query's score array.  Equal
    scores of a query arrive as counts, so the block of untouched documents is
    one entry."""
    runs = score_runs(ranking)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score", ascending=False)
        out = fn(pdf["score"].to_numpy(), pdf["n"].to_numpy())
        out.insert(0, "query_id", key[0])
        return out

    return runs.groupBy("query_id").applyInPandas(run, f"query_id string, {schema}")


def balls(ranking: DataFrame, tau: float) -> DataFrame:
    """``query_id, lo, hi, ball_lo, ball_hi``: for each run of equal scores (ranks
    ``lo..hi`` half-open) the interval of ranks near it."""
    check_tau(tau)

    def fn(scores, n):
        ends = np.cumsum(n)
        starts = ends - n
        r = reach(scores, tau)
        left = np.searchsorted(r, np.arange(len(scores)))  # first run that reaches this one
        return pd.DataFrame({"lo": starts, "hi": ends, "ball_lo": starts[left], "ball_hi": ends[r]})

    return _per_query(ranking, fn, "lo long, hi long, ball_lo long, ball_hi long")


def cliques(ranking: DataFrame, tau: float) -> DataFrame:
    """``query_id, lo, hi``: maximal intervals of diameter at most tau; they may
    overlap."""
    check_tau(tau)

    def fn(scores, n):
        ends = np.cumsum(n)
        r = reach(scores, tau)
        new = np.append(True, r[1:] > r[:-1])
        return pd.DataFrame({"lo": (ends - n)[new], "hi": ends[r[new]]})

    return _per_query(ranking, fn, "lo long, hi long")


def tie_report(ranking: DataFrame, tau: float) -> DataFrame:
    """Per query: numbers and largest sizes of chains and cliques, their ratio
    rho, and the two warning conditions."""
    c = chains(ranking, tau).groupBy("query_id").agg(F.count("*").alias("n_chains"), F.max(F.col("hi") - F.col("lo")).alias("largest_chain"))
    q = cliques(ranking, tau).groupBy("query_id").agg(F.count("*").alias("n_cliques"), F.max(F.col("hi") - F.col("lo")).alias("largest_clique"))
    s = score_runs(ranking).groupBy("query_id").agg((F.max("score") - F.min("score")).alias("range"))
    rho = F.col("largest_chain") / F.col("largest_clique")
    out = c.join(q, "query_id").join(s, "query_id").withColumn("rho", rho)
    return out.withColumn("tau_exceeds_range", (F.lit(tau) >= F.col("range")) & ~((F.lit(tau) == 0) & (F.col("range") == 0))).withColumn("inflated", F.col("rho") > 2)


def warn_on(report: DataFrame) -> None:
    """Raise Python warnings for what a report found."""
    got = report.agg(F.count_if("tau_exceeds_range").alias("t"), F.count_if("inflated").alias("i")).first()
    if got["t"]:
        warnings.warn(f"tau spans all scores of {got['t']} queries", TauExceedsRange, stacklevel=2)
    if got["i"]:
        warnings.warn(f"chains exceed twice the largest clique in {got['i']} queries", ChainInflation, stacklevel=2)


def rho_sweep(ranking: DataFrame) -> DataFrame:
    """``query_id, tau, rho``: the whole step function of tau, at every gap
    between neighbours and every span of a clique that begins there."""

    def fn(scores, n):
        gaps = scores[:-1] - scores[1:]
        taus = np.unique(np.concatenate([[0.0], gaps]))
        spans = np.unique(np.concatenate([[0.0], *[scores[i] - scores[reach(scores, t)] for t in taus for i in [np.arange(len(scores))]]]))
        rows = []
        for t in np.unique(np.concatenate([taus, spans])):
            cut = np.concatenate([[0], np.flatnonzero(gaps > t) + 1, [len(scores)]])
            total = np.concatenate([[0], np.cumsum(n)])
            chain = max(total[b] - total[a] for a, b in zip(cut, cut[1:], strict=False))
            r = reach(scores, t)
            clique = (total[r + 1] - total[np.arange(len(scores))]).max()
            rows.append((float(t), float(chain / clique)))
        return pd.DataFrame(rows, columns=["tau", "rho"])

    return _per_query(ranking, fn, "tau double, rho double")
