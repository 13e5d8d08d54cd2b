"""Corpus edits and what they do to idf, vectors and scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateId
from .local import paired, postings, score_both, shift_parts
from .model import Model, embed, fit
from .scoring import BOUND_SLACK, touched_scores
from .texts import both_sides


#: Rows of an edit (tokens or documents of one side only) that are broadcast.
FEW = 200_000


# ------------------------------------------------------------------ edits
def _exists(docs: DataFrame, doc_id: str) -> bool:
    return bool(docs.where(F.col("doc_id") == doc_id).head(1))


def add_document(docs: DataFrame, row: DataFrame) -> DataFrame:
    """Append rows with new ids; an id that exists raises."""
    if row.join(docs.select("doc_id"), "doc_id", "left_semi").head(1):
        raise DuplicateId("the document is already there")
    return docs.unionByName(row)


def remove_document(docs: DataFrame, doc_id: str) -> DataFrame:
    if not _exists(docs, doc_id):
        raise KeyError(doc_id)
    return docs.where(F.col("doc_id") != doc_id)


def edit_document(docs: DataFrame, doc_id: str, **changes: Column) -> DataFrame:
    """Replace columns of one document."""
    if not _exists(docs, doc_id):
        raise KeyError(doc_id)
    return docs.withColumns({c: F.when(F.col("doc_id") == doc_id, v).otherwise(F.col(c)) for c, v in changes.items()})


def duplicate_document(docs: DataFrame, doc_id: str, new_id: str) -> DataFrame:
    if not _exists(docs, doc_id):
        raise KeyError(doc_id)
    return add_document(docs, docs.where(F.col("doc_id") == doc_id).withColumn("doc_id", F.lit(new_id)))


def touched_features(before: DataFrame, after: DataFrame, features_col: str = "features") -> DataFrame:
    """Features of changed documents on exactly one side."""
    ex = lambda d: d.select(F.explode(features_col).alias("token")).distinct()
    gone, came = before.exceptAll(after), after.exceptAll(before)
    a, b = ex(gone), ex(came)
    return a.join(b, "token", "left_anti").unionByName(b.join(a, "token", "left_anti"))


# -------------------------------------------------------------- alignment
def align(before: DataFrame, after: DataFrame) -> DataFrame:
    """Union vocabulary: ``token, in_before, in_after, idf_before, idf_after,
    delta``; the idf of a token that a side lacks is 0."""
    a = before.select("token", F.col("idf").alias("idf_before"))
    b = after.select("token", F.col("idf").alias("idf_after"))
    both = a.join(b, "token", "full_outer")
    zero = F.lit(0.0)
    return both.select(
        "token",
        F.col("idf_before").isNotNull().alias("in_before"),
        F.col("idf_after").isNotNull().alias("in_after"),
        F.coalesce("idf_before", zero).alias("idf_before"),
        F.coalesce("idf_after", zero).alias("idf_after"),
        (F.coalesce("idf_after", zero) - F.coalesce("idf_before", zero)).alias("delta"),
    )


def idf_shift(alignment: DataFrame) -> DataFrame:
    """One row: largest move over all tokens and over shared ones, the first
    token in byte order that moves the most, and their ratio."""
    d = F.abs("delta")
    shared = F.col("in_before") & F.col("in_after")
    worst = F.min_by("token", F.struct(-d, "token"))
    out = alignment.agg(F.max(d).alias("linf"), F.coalesce(F.max(F.when(shared, d)), F.lit(0.0)).alias("linf_shared"), worst.alias("worst_token"), F.count_if(shared).alias("n_shared"),
                        F.count_if(~F.col("in_before")).alias("n_gained"), F.count_if(~F.col("in_after")).alias("n_lost"))
    return out.withColumn("looseness", F.when(F.col("linf_shared") > 0, F.col("linf") / F.col("linf_shared")))


def _small(df: DataFrame) -> DataFrame:
    """The rows, to be broadcast if they are few; they are counted for it."""
    df = df.persist()
    return F.broadcast(df) if df.count() <= FEW else df


def _marked(weights: DataFrame, tokens: DataFrame) -> DataFrame:
    """Append ``alone``: is the token among these (without repeats)?"""
    return weights.join(_small(tokens.withColumn("__alone", F.lit(True))), "token", "left").withColumn("alone", F.col("__alone").isNotNull()).drop("__alone")


def vector_shift(before: Model, after: Model) -> DataFrame:
    """Per document of both models: the move of its vector, the three terms that
    bound it, and the parts on shared, gained and lost tokens.

    Ties of the dominant term go to local, then global, then interaction.
    """
    al = align(before.vocab, after.vocab).persist()
    top = al.agg(F.max(F.abs("idf_before")).alias("m"), F.max(F.abs("delta")).alias("d")).first()
    idf_max, delta_max = float(top["m"] or 0.0), float(top["d"] or 0.0)
    docs = before.stats.select("doc_id").join(after.stats.select("doc_id"), "doc_id")
    cols = [F.col(c) for c in ("doc_id", "token", "weight", "tf")]
    a = _marked(before.weights.select(*cols), al.where("not in_after").select("token"))
    b = _marked(after.weights.select(*cols), al.where("not in_before").select("token"))
    parts = shift_parts(paired(a, b))
    out = docs.join(parts, "doc_id", "left").na.fill(0.0)
    out = out.withColumns({"local": F.col("dtf") * idf_max, "global": F.col("tf") * delta_max, "interaction": F.col("dtf") * delta_max})
    out = out.withColumn("total", F.col("local") + F.col("global") + F.col("interaction"))
    most = F.greatest("local", "global", "interaction")
    name = F.when(F.col("local") == most, "local").when(F.col("global") == most, "global").otherwise("interaction")
    sq = F.col("shared_shift") ** 2 + F.col("gained_mass") ** 2 + F.col("lost_mass") ** 2
    o2 = F.col("observed") ** 2
    return (
        out.withColumn("holds", F.col("observed") <= F.col("total") * (1 + BOUND_SLACK[0]) + BOUND_SLACK[1])
        .withColumn("tightness", F.when(F.col("total") > 0, F.col("observed") / F.when(F.col("total") > 0, F.col("total"))))
        .withColumn("dominant", F.when(F.col("total") > 0, name))
        .withColumn("pythagoras_holds", F.abs(o2 - sq) <= 1e-9 * F.greatest(F.lit(1.0), o2))
        .withColumn("churn_fraction", F.when(o2 > 0, (F.col("gained_mass") ** 2 + F.col("lost_mass") ** 2) / F.when(o2 > 0, o2)).otherwise(0.0))
    )


def dominant_terms(shift: DataFrame) -> DataFrame:
    return shift.where("dominant is not null").groupBy("dominant").agg(F.count("*").alias("n"))


def score_shift(before: Model, after: Model, query_before: DataFrame, query_after: DataFrame) -> DataFrame:
    """``query_id, doc_id, score_before, score_after, shift`` over documents of
    both models that share a term with the query in one of them, the query
    embedded in each; all others score 0 on both sides and are left out."""
    p, q = postings(query_before, query_after), postings(query_after, query_before)
    if p is not None and q is not None and (near := both_sides(before, after)) is not None:
        out = score_both(near, p, q, (before.reduction, after.reduction))
        return out.withColumn("shift", F.abs(F.col("score_after") - F.col("score_before")))
    if p is not None and q is not None:
        a, b = before.stats.select("doc_id"), after.stats.select("doc_id")
        gone = _small(a.join(b, "doc_id", "left_anti").unionByName(b.join(a, "doc_id", "left_anti")))
        sides = [m.weights.select("doc_id", "token", "weight").join(gone, "doc_id", "left_anti") for m in (before, after)]
        out = score_both(paired(*sides), p, q, (before.reduction, after.reduction))
        return out.withColumn("shift", F.abs(F.col("score_after") - F.col("score_before")))
    s = touched_scores(before, query_before).withColumnRenamed("score", "score_before")
    t = touched_scores(after, query_after).withColumnRenamed("score", "score_after")
    kept = before.stats.select("doc_id").join(after.stats.select("doc_id"), "doc_id")
    both = s.join(t, ["query_id", "doc_id"], "full_outer").join(kept, "doc_id", "left_semi")
    zero = F.lit(0.0)
    out = both.select("query_id", "doc_id", F.coalesce("score_before", zero).alias("score_before"), F.coalesce("score_after", zero).alias("score_after"))
    return out.withColumn("shift", F.abs(F.col("score_after") - F.col("score_before")))


def all_bounds_hold(shift: DataFrame) -> bool:
    return not shift.where(~F.col("holds")).head(1)


@dataclass(frozen=True)
class PerturbationReport:
    """One edit of the corpus, seen from both models."""

    alignment: DataFrame
    vectors: DataFrame
    scores: DataFrame

    def summary(self) -> DataFrame:
        """One row: idf and score moves, and whether every bound holds."""
        i = idf_shift(self.alignment).select("linf", "linf_shared", "n_shared", "n_gained", "n_lost")
        s = self.scores.agg(F.coalesce(F.max("shift"), F.lit(0.0)).alias("max_score_shift"))
        v = self.vectors.agg(F.count("*").alias("n_documents"), F.coalesce(F.bool_and("holds"), F.lit(True)).alias("all_bounds_hold"), F.coalesce(F.max("observed"), F.lit(0.0)).alias("max_vector_shift"))
        return i.join(s, F.lit(True)).join(v, F.lit(True))

    def dominant(self) -> DataFrame:
        return dominant_terms(self.vectors)


def run_perturbation(before: DataFrame, after: DataFrame, queries: DataFrame, features_col: str = "features", fit_with=fit) -> PerturbationReport:
    """Fit both sides, embed the queries in each, and compare by id."""
    a, b = fit_with(before, features_col=features_col), fit_with(after, features_col=features_col)
    return PerturbationReport(align(a.vocab, b.vocab), vector_shift(a, b), score_shift(a, b, embed(a, queries, features_col), embed(b, queries, features_col)))


def certified_stable(certificates: DataFrame, shifts: DataFrame) -> DataFrame:
    """Per query and k: did the largest move stay below the certified radius?
    Null where nothing is certified."""
    most = shifts.groupBy("query_id").agg(F.max("shift").alias("max_shift"))
    out = certificates.join(most, "query_id", "left").withColumn("max_shift", F.coalesce("max_shift", F.lit(0.0)))
    return out.withColumn("certified", F.when(F.col("defined"), F.col("max_shift") < F.col("set_radius")))
