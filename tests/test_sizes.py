"""Steps that must not grow faster than their input, against plainer ones."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestem.operators import local, model, profiles, ranking, scoring
from lodestem.operators.model import embed, fit
from lodestem.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_sizes_are_those_of_the_folds(spark, tmp_path):
    counts = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "x", 1), ("c", "z", 3)], "doc_id string, token string, cnt long")
    liked = [("u", "a"), ("u", "b"), ("u", "c"), ("u", "bare"), ("v", "a"), ("v", "bare"), ("w", "a"), ("n", "bare"), ("n", "none")]
    items = spark.createDataFrame(liked, "user_id string, doc_id string")
    for name, df in (("counts", counts), ("items", items)):
        df.write.parquet(str(tmp_path / name))
    counts, items = (spark.read.parquet(str(tmp_path / name)) for name in ("counts", "items"))
    want = profiles.fold_counts(items, counts, 2).groupBy("query_id").agg(F.count("*").alias("n_features"), F.sum("cnt").alias("length"))
    got = profiles.fold_sizes(items, counts, 2)
    assert _rows(got) == _rows(want) and len(_rows(got)) == 5 and got.dtypes == want.dtypes
    # the step is not left to size estimates: parts and their counts were broadcast, however many they were
    assert "BroadcastExchange" in _plan(profiles.fold_counts(items, counts, 2)) and "BroadcastExchange" not in _plan(got)


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    docs = [(f"d{i}", rng.choices(words, [1 / (j + 1) for j in range(80)], k=rng.choice([0, 1, 7, 60]))) for i in range(80)]
    qs = [(f"q{i}", rng.choices([*words, "unknown"], k=5)) for i in range(6)] + [("none", ["unknown"])]
    return spark.createDataFrame(docs, "doc_id string, features array<string>").repartition(3, "doc_id"), spark.createDataFrame(qs, "query_id string, features array<string>")


@pytest.mark.parametrize("most", [0, 1, 30])
def test_frequent_tokens_meet_counts_where_they_lie(made, monkeypatch, most):
    whole = fit(made[0], check=False)
    monkeypatch.setattr(model, "FREQUENT", most)
    m = fit(made[0], check=False)
    assert _rows(m.weights) == _rows(whole.weights) and _rows(m.stats) == _rows(whole.stats)
    # documents are whole and sorted in their part
    parts = [(p, d, t) for p, d, t in (tuple(r) for r in m.arranged().select(F.spark_partition_id(), "doc_id", "token").collect())]
    assert parts == sorted(parts) and len({(p, d) for p, d, _ in parts}) == len({d for _, d, _ in parts})
    # all weights went to their token, and back to their document
    plan = _plan(m.weights).split("InMemoryRelation")[1]
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(doc_id" in x]
    assert most == 0 or all("REPARTITION_BY_NUM" in x for x in dealt)


@pytest.mark.parametrize("k", [1, 4, 200])
def test_leading_scores_are_the_leading_ones(made, monkeypatch, k):
    monkeypatch.setattr(local, "CELLS", 40)
    docs, qs = made
    m = fit(docs, check=False)
    every = scoring.touched_scores(m, embed(m, qs)).where("score > 0")
    some = scoring.leading_scores(m, embed(m, qs), k, 2e-3)
    for digits in (3, 17):
        at = lambda df: df.withColumn("score", F.round("score", digits)).where("score > 0")  # noqa: B023, E731
        assert _rows(ranking.leading(at(some), k)) == _rows(ranking.leading(at(every), k))
    assert k > 4 or some.count() < every.count()


def test_units_and_norms_of_dealt_vectors_need_no_lists(made):
    m = fit(made[0], check=False)
    got = scoring.units(m.arranged(), dealt=True)
    assert _rows(got) == _rows(scoring.units(m.weights))
    assert not any(x in _plan(got).split("InMemoryRelation")[0] for x in ("Aggregate", "Join", "Exchange"))


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", ["row_norms_exact", "unit_weights"])
def test_queries_on_vectors_are_folds_where_they_lie(spark, name):
    # lists of all weights of a document were collected, in one task of many documents
    assert "collect_list" not in _plan(QUERIES[name](spark, SF)).split("InMemoryRelation")[0]


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", ["term_frequencies", "vocab_min_max_df", "vocab_max_features_df_desc", "vocab_max_features_cf_desc", "vocab_max_features_cf_token"])
def test_terms_are_counted_in_parts_of_bounded_size(spark, name):
    # a task held the counts of every document and token of its part, after texts were dealt
    plan = _plan(QUERIES[name](spark, SF))
    assert "doc_id" not in plan.split("Exchange")[1] and "Generate" not in plan


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
def test_weights_are_made_without_an_exchange(spark):
    q = QUERIES["tfidf_weights"](spark, SF)
    # rows of documents and tokens went to their token, back to their document and to disk
    assert not any(x in _plan(q) for x in ("hashpartitioning(token", "Sort", "Join", "InMemoryRelation"))
