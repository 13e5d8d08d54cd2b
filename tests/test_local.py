"""Scores, norms and edits where documents lie, against joins of tables."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestem.functions.numerics import Reduction
from lodestem.functions.text import counted, preprocess
from lodestem.operators import analysis, local, perturbation, scoring
from lodestem.operators.model import embed, fit, norms
from lodestem.operators.vocabulary import term_counts


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    docs = [(f"d{i}", rng.choices(words, k=rng.choice([0, 1, 5, 400]))) for i in range(60)]
    qs = [(f"q{i}", rng.choices([*words, "unknown"], k=6)) for i in range(8)] + [("none", ["unknown"])]
    return spark.createDataFrame(docs, "doc_id string, features array<string>"), spark.createDataFrame(qs, "query_id string, features array<string>")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("policy", list(Reduction))
def test_scores_and_norms_are_those_of_joins(spark, made, policy):
    docs, qs = made
    m = fit(docs, check=False, reduction=policy)
    assert _rows(local.folded_norms(m.arranged(), policy=policy)) == _rows(norms(m.weights, reduction=policy).select("doc_id", "length", "norm"))
    here = scoring.touched_scores(m, embed(m, qs))
    assert _rows(here) == _rows(scoring.touched_scores(m, embed(m, qs), hint="merge"))
    # no pair of a query and a document is exchanged
    plan = here._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert "Join" not in plan and "Aggregate" not in plan
    grid = scoring.all_scores(m, embed(m, qs), qs.select("query_id"))
    assert grid.count() == 60 * 9 and _rows(grid.where("score > 0")) == _rows(here.where("score > 0"))


def test_batches_are_cut_between_documents():
    keys = ["a", "a", "b", "b", "b", "b", "c"]
    for size in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_pydict({"doc_id": keys[i : i + size]}) for i in range(0, len(keys), size)]
        parts = [t["doc_id"].to_pylist() for t in local.whole(batches, "doc_id")]
        assert sum(parts, []) == keys and sum(len(set(p)) for p in parts) == 3


def test_an_edit_seen_from_both_sides(spark, made):
    docs, qs = made
    a, b = fit(docs, check=False), fit(perturbation.remove_document(docs, "d1"), check=False)
    old = {(q, d): s for q, d, s in _rows(scoring.touched_scores(a, embed(a, qs), hint="merge")) if d != "d1"}
    new = {(q, d): s for q, d, s in _rows(scoring.touched_scores(b, embed(b, qs), hint="merge"))}
    got = {(q, d): (x, y) for q, d, x, y, _ in _rows(perturbation.score_shift(a, b, embed(a, qs), embed(b, qs)))}
    assert got == {k: (old.get(k, 0.0), new.get(k, 0.0)) for k in old.keys() | new.keys()}


def test_counts_of_texts_hold_one_document_at_a_time(spark):
    rows = [("a", "Running runs of the RUNNERS running"), ("a", "runs again"), ("b", None), ("c", "ﬁne ſtones " * 40)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3, "doc_id")
    got = counted(docs)
    assert _rows(got) == sorted(tuple(r) for r in term_counts(preprocess(docs).select("doc_id", "features")).collect())
    # the arrays of all features of a batch are never made, and no exchange follows
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan


def test_cells_of_trials_need_no_ranking(spark):
    ranked = spark.createDataFrame([("q", r, f"d{r}", 1.0 - 0.1 * r) for r in range(1, 7)] + [("t", r, f"d{r}", 0.5 if r < 3 else 0.25) for r in range(1, 7)], "query_id string, rnk int, doc_id string, score double")
    attrs = spark.createDataFrame([(f"d{i}", 6 - i, 0, 0) for i in range(1, 7)], "doc_id string, popularity_rank int, rating_rank int, engagement_rank int")
    base = analysis._with_radius(ranked, 2)
    trial = spark.range(30).withColumnRenamed("id", "trial")
    # whole steps of a half make many scores equal, which attributes decide
    eps = F.lit(0.5) * F.round(2 * analysis._draw(F.lit(1), F.col("query_id"), F.col("doc_id"), F.col("trial"))) / analysis._draw(F.lit(0), F.col("query_id"), F.col("doc_id"), F.col("trial"))
    flat = base.withColumn("score", F.lit(0.0))
    got = {(r["query_id"], r["trial"]): r["left"] > 0 for r in analysis._perturbed(flat, attrs, 2, trial, eps, 0).collect()}
    noisy = flat.join(trial, F.lit(True)).withColumn("moved", F.lit(0.0) + eps * analysis._draw(F.lit(0), F.col("query_id"), F.col("doc_id"), F.col("trial")))
    w = W.partitionBy("query_id", "trial").orderBy(F.desc("moved"), "popularity_rank", "rating_rank", "engagement_rank", "doc_id")
    ranked = noisy.join(attrs, "doc_id").withColumn("r", F.row_number().over(w)).groupBy("query_id", "trial").agg((F.count_if((F.col("rnk") <= 2) & (F.col("r") > 2)) > 0).alias("left"))
    assert got == {(r["query_id"], r["trial"]): r["left"] for r in ranked.collect()} and len(set(got.values())) == 2
