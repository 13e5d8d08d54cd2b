"""Model, profiles, edits, sources, store, streaming on small fixtures."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestem import cli
from lodestem.errors import BadConfig, BadData, DuplicateId, EmptyVocabulary
from lodestem.functions.numerics import naive, smoothed_idf
from lodestem.functions.text import plain_tokens
from lodestem.operators import model as M
from lodestem.operators import perturbation, profiles, ranking, scoring, vocabulary
from lodestem.sources import corpora, store
from lodestem.streaming.incremental import streaming_frequencies

TEXTS = {"d1": "river stone bridge water", "d2": "river stone bridge lamp", "d3": "green field", "d4": "green field", "d5": "", "d6": "violin"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string").select("doc_id", plain_tokens(F.col("text")).alias("features"))


@pytest.fixture(scope="module")
def model(docs):
    return M.fit(docs)


def test_weights_bit_for_bit(model):
    toks = {d: t.split() for d, t in TEXTS.items()}
    df = {w: sum(w in t for t in toks.values()) for t in toks.values() for w in t}
    got = {(r["doc_id"], r["token"]): r["weight"] for r in model.weights.collect()}
    assert got == {(d, w): 1 / len(t) * smoothed_idf(df[w], 6) for d, t in toks.items() for w in t}
    norm = {r["doc_id"]: r["norm"] for r in model.stats.collect()}
    assert norm["d5"] == 0.0 and norm["d1"] == naive(got["d1", w] ** 2 for w in sorted(toks["d1"])) ** 0.5
    assert [r["doc_id"] for r in model.zero_norm_documents().collect()] == ["d5"]


def test_joins_agree_to_the_bit(spark, model):
    q = spark.createDataFrame([("q1", ["river", "bridge"]), ("q2", ["green"]), ("q3", []), ("q4", ["unknown"])], "query_id string, features array<string>")
    v = M.embed(model, q)
    runs = [{(r["query_id"], r["doc_id"]): r["score"] for r in scoring.touched_scores(model, v, hint=h).collect()} for h in ("broadcast", "merge", "shuffle_hash")]
    assert runs[0] == runs[1] == runs[2]
    assert runs[0]["q2", "d3"] == runs[0]["q2", "d4"]
    full = scoring.all_scores(model, v, q)
    assert full.count() == 24 and full.where("query_id IN ('q3', 'q4') AND score <> 0").count() == 0
    assert profiles.zero_vectors(full).count() == 2


def test_vocabulary(docs):
    counts = vocabulary.term_counts(docs)
    assert vocabulary.threshold(0.1, 30, True) == 3 and vocabulary.threshold(0.5, 3, False) == 1 and vocabulary.threshold(0.95, 7, False) == 6
    top = vocabulary.vocabulary(counts, 6, vocabulary.VocabularyConfig(max_features=2))
    assert {r["token"] for r in top.collect()} == {"bridge", "field"}
    ids = {r["token"]: r["term_id"] for r in vocabulary.numbered(vocabulary.frequencies(counts)).collect()}
    assert [k for k, _ in sorted(ids.items(), key=lambda kv: kv[1])] == sorted(ids)
    with pytest.raises(EmptyVocabulary):
        vocabulary.vocabulary(counts, 6, vocabulary.VocabularyConfig(min_df=5))
    with pytest.raises(BadConfig):
        vocabulary.threshold(1.5, 3, True)


def test_duplicate_ids(docs):
    with pytest.raises(DuplicateId):
        M.fit(docs.union(docs))


def test_edits(docs, model):
    less = perturbation.remove_document(docs, "d6")
    after = M.fit(less)
    al = {r["token"]: r for r in perturbation.align(model.vocab, after.vocab).collect()}
    assert not al["violin"]["in_after"] and al["river"]["in_before"]
    shift = perturbation.vector_shift(model, after).collect()
    assert all(r["holds"] and r["pythagoras_holds"] for r in shift) and len(shift) == 5
    more = perturbation.duplicate_document(docs, "d1", "d9")
    assert more.count() == 7
    with pytest.raises(DuplicateId):
        perturbation.add_document(docs, docs.limit(1))
    counts = vocabulary.term_counts(docs)
    got = vocabulary.df_after_edit(vocabulary.document_frequencies(counts), counts.where("doc_id = 'd6'"), counts.limit(0))
    assert "violin" not in {r["token"] for r in got.collect()}


def test_folds(spark, docs):
    items = spark.createDataFrame([("u", d) for d in ("d1", "d2", "d3", "d4", "d6")] + [("v", "d1")], "user_id string, doc_id string")
    q, ex = profiles.leave_one_out(items, 6)
    assert q.count() == 5 and {r["n_candidates"] for r in q.collect()} == {2}
    assert ex.where("query_id = 'u::d1'").count() == 4
    counts = vocabulary.term_counts(docs)
    fold = {(r["query_id"], r["token"]): r["cnt"] for r in profiles.fold_counts(items, counts).collect()}
    assert fold["u::d1", "river"] == 1 and ("u::d6", "violin") not in fold and fold["u::d6", "river"] == 2
    with pytest.raises(BadConfig):
        profiles.eligible_users(items, 1)


def test_store_round_trip(spark, model, tmp_path):
    path = str(tmp_path / "m")
    store.save_model(model, path)
    again = store.load_model(spark, path)
    assert again.digest() == model.digest()
    again.weights.limit(3).write.mode("overwrite").parquet(path + "/weights2")
    spark.read.parquet(path + "/weights2").write.mode("overwrite").parquet(path + "/weights")
    with pytest.raises(BadData):
        store.load_model(spark, path)
    with pytest.raises(BadData):
        store.load_model(spark, str(tmp_path / "none"))


def archive(rating="3.5"):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("x/movies.csv", "﻿movieId,title,genres\n10,\"Big, City (1999)\",Drama|Comedy\n2,Quiet (2001),Drama\n")
        z.writestr("x/ratings.csv", f"userId,movieId,rating,timestamp\n1,10,4.0,1\n2,10,{rating},1\n")
        z.writestr("x/tags.csv", "userId,movieId,tag,timestamp\n1,10,noir,1\n")
    return raw.getvalue()


def test_rating_archive(spark):
    data = corpora.load_rating_archive(spark, archive())
    rows = [r.asDict() for r in data.documents.collect()]
    assert [r["doc_id"] for r in rows] == ["2", "10"]
    assert rows[1] | {"text": ""} == {"doc_id": "10", "text": "", "popularity": 2, "rating_sum2": 15, "rating_count": 2, "engagement": 1}
    assert "noir" in rows[1]["text"] and "(" not in rows[1]["text"] and rows[0]["rating_count"] == 0
    assert [tuple(r) for r in data.interactions.collect()] == [("1", "10", 4.0)]
    with pytest.raises(Exception, match="one half"):
        corpora.load_rating_archive(spark, archive("3.7")).documents.collect()
    with pytest.raises(BadData):
        corpora.load_rating_archive(spark, archive(), expect_sha256="0" * 64)


def test_synthetic(spark):
    a = corpora.load_dataset(spark, "synthetic_tiny")
    assert a.documents.count() == 120 + 4 + 12
    assert a.documents.repartition(7).count() == a.documents.count() and a.digest() == corpora.load_dataset(spark, "synthetic_tiny").digest()
    t = {r["doc_id"]: r["text"] for r in a.documents.collect()}
    assert t["dup0000"] == t["d000000"] and t["twin0000b"].startswith(t["twin0000a"] + " ")
    assert corpora.near_duplicate_twins(a.documents).count() == 6


def test_jsonl_and_cli(spark, tmp_path, capsys):
    p = tmp_path / "c.jsonl"
    p.write_text("".join(json.dumps({"doc_id": d, "text": t}) + "\n" for d, t in TEXTS.items()) + "\n")
    assert corpora.load_jsonl_corpus(spark, str(p)).documents.count() == 6
    (tmp_path / "bad.jsonl").write_text('{"doc_id": "x"}\n')
    with pytest.raises(BadData):
        corpora.load_jsonl_corpus(spark, str(tmp_path / "bad.jsonl"))
    out = str(tmp_path / "model")
    assert cli.main(["build", f"jsonl:{p}", out], spark) == 0
    assert cli.main(["verify", out], spark) == 0 and cli.main(["schema"]) == 0
    assert cli.main(["verify", str(tmp_path / "nothing")], spark) == 1
    with pytest.raises(BadConfig):
        cli.load_config('{"vocabulary": {"nope": 1}}')


def test_streaming_frequencies(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = streaming_frequencies(stream).writeStream.outputMode("complete").format("memory").queryName("freqs").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = {(r["token"], r["df"], r["cf"]) for r in vocabulary.frequencies(vocabulary.term_counts(docs)).collect()}
    assert {(r["token"], r["df"], r["cf"]) for r in spark.table("freqs").collect()} == want


def test_topk_plan_prunes(model, spark):
    s = scoring.touched_scores(model, M.embed(model, spark.createDataFrame([("q", ["river"])], "query_id string, features array<string>")))
    attrs = model.stats.select("doc_id").withColumns({f"{n}_rank": F.lit(0) for n in ("popularity", "rating", "engagement")})
    plan = ranking.rank(s, attrs, "pi", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
