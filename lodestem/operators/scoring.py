"""Cosine scores of sparse vectors, bit for bit the same under any join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import Reduction, ordered_sum
from . import local
from .model import Model, norms

# What evaluating a bound itself may lose, relative and absolute.
BOUND_SLACK = (1e-12, 1e-15)


def cosine_of(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    """``dot / (a * b)``, not clamped; 0 where a norm (or their product) is 0."""
    both = norm_a * norm_b
    return F.when((norm_a == 0) | (norm_b == 0) | (both == 0), F.lit(0.0)).otherwise(dot / both)


def dots(query_vectors: DataFrame, weights: DataFrame, reduction: Reduction = Reduction.NAIVE, hint: str | None = None) -> DataFrame:
    """``query_id, doc_id, dot`` of pairs with a common term.  ``hint`` chooses
    the physical join (``broadcast``, ``merge``, ``shuffle_hash``); by default
    Spark does, by the measured size of the query side."""
    q = query_vectors.select("query_id", "token", F.col("weight").alias("qw"))
    if hint:
        q = q.hint(hint)
    joined = weights.select("doc_id", "token", "weight").join(q, "token")
    return joined.groupBy("query_id", "doc_id").agg(ordered_sum(F.col("token"), F.col("qw") * F.col("weight"), reduction).alias("dot"))


def touched_scores(model: Model, query_vectors: DataFrame, reduction: Reduction | None = None, hint: str | None = None) -> DataFrame:
    """``query_id, doc_id, score`` of documents that share a term.  A bounded set
    of queries goes to the documents, which are scored where they lie; more
    queries, or a ``hint``, join tables."""
    red = reduction or model.reduction
    few = local.postings(query_vectors) if hint is None else None
    if few is not None:
        return local.score(model.arranged(), few, red)
    d = dots(query_vectors, model.weights, red, hint)
    qn = norms(query_vectors, "query_id", red).select("query_id", F.col("norm").alias("qn"))
    return d.join(qn, "query_id").join(model.stats.select("doc_id", "norm"), "doc_id").select("query_id", "doc_id", cosine_of(F.col("dot"), F.col("qn"), F.col("norm")).alias("score"))


def leading_scores(model: Model, query_vectors: DataFrame, k: int, slack: float = 0.0) -> DataFrame:
    """Those ``touched_scores`` above 0 that ``ranking.leading`` may keep for ``k``,
    also once scores are rounded by at most half of ``slack``: for a bounded set of
    queries a bounded number of each part, ties aside; else all."""
    few = local.postings(query_vectors)
    return touched_scores(model, query_vectors) if few is None else local.leading(model.arranged(), few, k, slack, model.reduction)


def all_scores(model: Model, query_vectors: DataFrame, query_ids: DataFrame, excluded: DataFrame | None = None, hint: str | None = None) -> DataFrame:
    """Scores of every stated query against every document: documents that
    share no term, and all under a query without known terms, score 0.
    ``excluded(query_id, doc_id)`` leaves the candidates out first.  The output
    is queries x documents by definition; use ``touched_scores`` for top-k."""
    few = local.postings(query_vectors, query_ids) if hint is None and excluded is None else None
    if few is not None:
        asked = query_ids.select("query_id").distinct()
        some = local.score(model.arranged(), few, model.reduction, dense=True).join(F.broadcast(asked), "query_id", "left_semi")
        if model.made is not None:
            return some
        bare = model.stats.where("length = 0").select("doc_id").join(asked, F.lit(True)).select("query_id", "doc_id", F.lit(0.0).alias("score"))
        return some.unionByName(bare)
    grid = model.stats.select("doc_id").join(F.broadcast(query_ids.select("query_id").distinct()) if hint == "broadcast" else query_ids.select("query_id").distinct(), F.lit(True))
    if excluded is not None:
        grid = grid.join(excluded, ["query_id", "doc_id"], "left_anti")
    got = touched_scores(model, query_vectors, hint=hint)
    return grid.join(got, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def cosine_pairs(model: Model) -> DataFrame:
    """``a, b, score`` for ``a < b`` that share a term: the upper triangle of
    the document-by-document matrix; the rest mirrors it or is 0."""
    left = model.weights.select(F.col("doc_id").alias("a"), "token", F.col("weight").alias("wa"))
    right = model.weights.select(F.col("doc_id").alias("b"), "token", F.col("weight").alias("wb"))
    d = left.join(right, "token").where("a < b").groupBy("a", "b").agg(ordered_sum(F.col("token"), F.col("wa") * F.col("wb"), model.reduction).alias("dot"))
    na = model.stats.select(F.col("doc_id").alias("a"), F.col("norm").alias("na"))
    nb = model.stats.select(F.col("doc_id").alias("b"), F.col("norm").alias("nb"))
    return d.join(na, "a").join(nb, "b").select("a", "b", cosine_of(F.col("dot"), F.col("na"), F.col("nb")).alias("score"))


def lipschitz(pairs: DataFrame, nu: str = "nu", nv: str = "nv", nu2: str = "nu2", nv2: str = "nv2", du: str = "du", dv: str = "dv", before: str | None = None, after: str | None = None) -> DataFrame:
    """Append the bounds on how far a cosine moves when ``u, v`` move by ``du,
    dv`` (norms of the differences): with the smallest of the four norms, and the
    tighter one; null unless all four norms are positive.  With the cosines
    ``before`` and ``after``, also the ``observed`` move, whether both bounds
    hold up to the rounding of the bounds themselves, and how much of the tight
    one is used."""
    c = F.col
    ok = (c(nu) > 0) & (c(nv) > 0) & (c(nu2) > 0) & (c(nv2) > 0)
    least = F.least(nu, nv, nu2, nv2)
    tight = F.when(ok, 2 * c(du) / (c(nu) + c(nu2)) + 2 * c(dv) / (c(nv) + c(nv2)))
    out = pairs.withColumn("min_norm", F.when(ok, least)).withColumn("constant", F.when(ok, 1 / least)).withColumn("uniform", F.when(ok, (c(du) + c(dv)) / least)).withColumn("tight", tight)
    if before is None or after is None:
        return out
    out = out.withColumn("observed", F.when(ok, F.abs(c(after) - c(before))))
    slack = F.greatest(F.lit(1.0), "uniform") * BOUND_SLACK[0] + BOUND_SLACK[1]
    return out.withColumn("holds", (c("observed") <= c("uniform") + slack) & (c("observed") <= c("tight") + slack)).withColumn("tightness", F.when(ok, F.coalesce(F.try_divide(c("observed"), c("tight")), F.lit(0.0))))


def difference_norms(before: DataFrame, after: DataFrame, key: str = "doc_id", reduction: Reduction = Reduction.NAIVE) -> DataFrame:
    """``key, difference``: length of the difference of two sparse vectors, over
    the tokens of both, added in token order; vectors that only one side has are
    as long as they are."""
    return local.difference(local.paired(before.select(key, "token", "weight"), after.select(key, "token", "weight"), key), key, reduction)


def units(vectors: DataFrame, key: str = "doc_id", reduction: Reduction = Reduction.NAIVE, dealt: bool = False) -> DataFrame:
    """``key, token, weight`` of the unit vectors; zero vectors have none.  Vectors
    that are ``dealt`` (``local.arranged``) are divided where they lie."""
    if dealt:
        return local.unit_rows(vectors, key, reduction)
    n = norms(vectors, key, reduction).where("norm > 0").select(key, "norm")
    return vectors.join(n, key).select(key, "token", (F.col("weight") / F.col("norm")).alias("weight"))


def corpus_lipschitz(weights: DataFrame) -> DataFrame:
    """One row: ``sqrt`` of the largest number of terms of a document (its norm
    is at least one over that); null without terms."""
    return weights.groupBy("doc_id").agg(F.count("*").alias("nnz")).agg(F.sqrt(F.max("nnz").cast("double")).alias("constant"))
