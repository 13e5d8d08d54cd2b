"""Query grid, runners, corpora on disk, events, harness, bits."""

import logging
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestem import logs, runners
from lodestem.errors import BadConfig, BadData, DuplicateId, check_finite, check_non_negative, check_unique
from lodestem.functions import numerics as N
from lodestem.functions import text as T
from lodestem.harness import ResultsDiffer, check_same_bits, check_same_order, run_benchmarks
from lodestem.operators import analysis, grid, profiles, ranking, scoring
from lodestem.operators.model import embed, fit, norms
from lodestem.operators.vocabulary import term_counts
from lodestem.sources import corpora, store

DOCS = {"a": "x y z", "b": "x x w", "c": "y w", "d": "q", "e": "z z z y", "f": "q x"}
LIKES = {"u": "abc", "v": "de", "w": "abdef", "n": "d"}


@pytest.fixture(scope="module")
def world(spark):
    docs = spark.createDataFrame([(k, v.split()) for k, v in DOCS.items()], "doc_id string, features array<string>").persist()
    items = spark.createDataFrame([(u, d) for u, ds in LIKES.items() for d in ds], "user_id string, doc_id string").persist()
    return docs, items, fit(docs), term_counts(docs)


def brute_cosine(features, doc):
    n = len(DOCS)
    df = {t: sum(t in d.split() for d in DOCS.values()) for t in {t for d in DOCS.values() for t in d.split()}}
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}

    def vec(ts):
        ts = [t for t in ts if t in idf]
        return {t: ts.count(t) / len(ts) * idf[t] for t in ts}

    a, b = vec(features), vec(DOCS[doc].split())
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return sum(a[t] * b.get(t, 0) for t in a) / (size(a) * size(b)) if a and b else 0.0


def test_grid(spark, world):
    docs, items, model, counts = world
    loo = grid.build_grid(items, counts, len(DOCS), min_interactions=2)
    want = {f"{u}::{d}": [t for x in ds if x != d for t in DOCS[x].split()] for u, ds in LIKES.items() if len(ds) >= 2 for d in ds}
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in grid.evaluate(loo, model).collect()}
    for q, features in want.items():
        u, target = q.split("::")
        for d in DOCS:
            out = d in LIKES[u] and d != target
            assert (q, d) not in got if out else abs(got.get((q, d), 0.0) - brute_cosine(features, d)) < 1e-12
    whole = grid.build_grid(items, counts, len(DOCS), "user_profile", 2)
    results = {r["query_id"]: r for r in grid.outcomes(whole, grid.evaluate(whole, model)).collect()}
    assert {k: r["n_candidates"] for k, r in results.items()} == {"u": 3, "v": 4, "w": 1}
    assert results["u"]["kind"] == "scored" and results["w"]["n_scored"] == 1
    p = grid.provenance(whole, grid.outcomes(whole, grid.evaluate(whole, model)))
    assert (p["n_queries"], p["n_users"], p["n_candidates_min"], p["n_candidates_max"]) == (3, 3, 1, 4)
    some = grid.build_grid(items, counts, len(DOCS), min_interactions=2, limit=2)
    assert sorted(r["query_id"] for r in some.queries.collect()) == ["u::a", "u::b"]
    with pytest.raises(BadConfig):
        grid.build_grid(items, counts, len(DOCS), "item")
    # no features at all, or none that is known: different findings
    odd = spark.createDataFrame([("empty", None, None, 6), ("strange", None, None, 6)], "query_id string, user_id string, target string, n_candidates long")
    g = grid.Grid(odd, spark.createDataFrame([("strange", "nowhere", 1)], "query_id string, token string, cnt long"), loo.excluded.limit(0), "x", 2)
    assert {r["query_id"]: r["kind"] for r in grid.outcomes(g, grid.evaluate(g, model)).collect()} == {"empty": "degenerate", "strange": "zero"}
    spread = profiles.candidate_spread(spark.createDataFrame([(x,) for x in (5, 1, 3, 9)], "n_candidates long")).first()
    assert tuple(spread) == (1, 5, 9)


def test_runners(spark, world, tmp_path):
    docs, items, model, counts = world
    attrs = spark.createDataFrame([(d, i, i % 2, 5 - i) for i, d in enumerate(DOCS)], "doc_id string, popularity_rank int, rating_rank int, engagement_rank int")
    queries = spark.createDataFrame([("q1", ["x", "y"]), ("q2", ["q"]), ("q3", ["nothing"])], "query_id string, features array<string>")
    vectors, ids = embed(model, queries).persist(), queries.select("query_id")
    g = grid.build_grid(items, counts, len(DOCS), min_interactions=2)
    with logs.capture() as seen:
        one = runners.run_similarity(model, g, attrs, str(tmp_path / "sim"), 2)
        again = runners.run_similarity(model, g, attrs, str(tmp_path / "sim2"), 2)
    assert one.digests == again.digests and one.require_reproducible() is one and len(seen.of(logs.EventKind.WRITE)) == 6
    profile = runners.run_stability_profile(model, vectors, ids, attrs, str(tmp_path / "st"), 2, trials=3, audit_trials=3)
    assert set(profile.digests) == {"margins", "curve", "audit"}
    assert spark.read.parquet(str(tmp_path / "st/audit")).where("certified and not unchanged").first()["n"] == 0
    assert runners.run_ablations(model, vectors, ids, attrs, str(tmp_path / "ab"), 0.1).digests.keys() == {"pairs", "rates"}
    assert spark.read.parquet(str(tmp_path / "ab/strata")).count() == 2 * 8 * len(runners.KS)
    data = corpora.Dataset("t", spark.createDataFrame([("a", "x y", 1, 2, 1, 0)], corpora.CORPUS_SCHEMA), spark.createDataFrame([("u", "a", 4.0)], corpora.INTERACTION_SCHEMA))
    snap = runners.run_snapshot(data, model, str(tmp_path / "snap"), g)
    assert {"data.corpus", "data.interactions", "data.spec", "model", "queries"} == set(snap.digests)
    assert corpora.verify_corpus(spark, str(tmp_path / "snap/data")).documents.count() == 1
    with pytest.raises(BadData):
        store.Manifest("x", {}, {"a": ""}).require_reproducible()


def test_noise_floor_against_python(spark, world):
    docs, _, model, _ = world
    queries = spark.createDataFrame([(f"q{i}", [random.Random(i).choice("xyzwq") for _ in range(5)]) for i in range(6)], "query_id string, features array<string>")
    qv = embed(model, queries).persist()
    vec = lambda rows, key: {k: sorted((r["token"], r["weight"]) for r in rows if r[key] == k) for k in {r[key] for r in rows}}
    q, d = vec(qv.collect(), "query_id"), vec(model.weights.collect(), "doc_id")
    got = {r["policy"]: r for r in analysis.noise_floor(model, qv, 6).collect()}

    def score(x, y, add):
        y = dict(y)
        dot = add([w * y[t] for t, w in x if t in y])
        n = [math.sqrt(add([w * w for _, w in v])) for v in (x, sorted(y.items()))]
        return dot / (n[0] * n[1]) if any(t in y for t, _ in x) else 0.0

    for policy in ("naive", "neumaier", "pairwise"):
        gaps = [abs(score(x, y, N.SUMS[N.Reduction(policy)]) - score(x, y, math.fsum)) for x in q.values() for y in d.values()]
        assert (got[policy]["n_compared"], got[policy]["n_differing"], got[policy]["max_abs"]) == (36, sum(g > 0 for g in gaps), max(gaps))


def test_reductions_bit_for_bit(spark):
    r = random.Random(1)
    vectors = {f"d{i}": [(f"t{j:04d}", r.uniform(-1, 1) * 10.0 ** r.randint(-8, 8)) for j in range(r.randint(1, 400))] for i in range(12)}
    df = spark.createDataFrame([(d, t, 1, w) for d, v in vectors.items() for t, w in v], "doc_id string, token string, cnt long, weight double").repartition(5)
    seen = {}
    for policy in N.Reduction:
        got = {x["doc_id"]: x for x in norms(df, reduction=policy).withColumn("bits", N.bits_column(F.col("norm"))).collect()}
        for d, v in vectors.items():
            want = math.sqrt(N.SUMS[policy]([w * w for _, w in sorted(v)]))
            assert N.same_bits(got[d]["norm"], want) and got[d]["bits"] == N.bits(want), (policy, d)
        seen[policy] = [got[d]["norm"] for d in sorted(vectors)]
    assert len({tuple(v) for v in seen.values()}) >= 2
    assert N.delta_idf(3, 2, 10, 9) == N.smoothed_idf(2, 9) - N.smoothed_idf(3, 10)
    assert N.unit([3.0, 4.0]) == [0.6, 0.8]
    with pytest.raises(ValueError):
        N.unit([0.0])
    same = scoring.difference_norms(df, df).agg(F.max("difference")).first()[0]
    assert same == 0.0


def test_lemmas_gaps_and_assets(spark, tmp_path):
    table = spark.createDataFrame([("mice", "mouse"), ("ran", "run")], "token string, lemma string")
    df = spark.createDataFrame([(1, ["mice", T.GAP, "ran", "mice", "off"]), (2, []), (3, ["off"])], "doc_id long, features array<string>")
    got = {r["doc_id"]: r["features"] for r in T.looked_up(df, table, fallback=F.upper("token")).collect()}
    assert got == {1: ["mouse", T.GAP, "run", "mouse", "OFF"], 2: [], 3: ["OFF"]}
    assert T.gapped([T.GAP, "a", "king", T.GAP, "of", "pop", T.GAP], frozenset(["of", "a"])) == ["king", T.GAP, "pop"]
    assert T.gapped(["king", "of", "pop"], frozenset(["of"]), False) == ["king", "pop"]
    (tmp_path / "w.txt").write_text("the # article\n\n# none\nof\n")
    import hashlib

    (tmp_path / "M").write_text(f"{hashlib.sha256((tmp_path / 'w.txt').read_bytes()).hexdigest()}  w.txt\n")
    words = T.load_stopwords(str(tmp_path / "w.txt"), str(tmp_path / "M"))
    assert words.words == {"the", "of"} and "of" in words
    (tmp_path / "w.txt").write_text("changed")
    with pytest.raises(BadData):
        T.load_stopwords(str(tmp_path / "w.txt"), str(tmp_path / "M"))
    cfg = T.PreprocessingConfig()
    assert cfg.digest() != cfg.digest({"a": "b"})
    rows = spark.createDataFrame([(1, ["a", "b", "the", "c", "d", "e"]), (2, ["a"]), (3, [])], "doc_id long, features array<string>")
    for n in (1, 2, 3):
        want = sorted((d, g) for d, ts in ((1, ["b", "the", "c", "d", "e"]),) for g in T.ngrams_of(T.gapped(ts, frozenset(["a", "the"])), n, n))
        assert sorted((r["doc_id"], r["token"]) for r in T.plain_ngram_rows(rows, "features", n, ("a", "the")).collect()) == want


def test_zipf_is_exact(spark):
    b = corpora.zipf_bounds(spark, 50).orderBy("rank").collect()
    assert [r["hi"] - r["lo"] for r in b] == [max(1, corpora.ZIPF_SCALE // (k + 1)) for k in range(50)]
    assert all(x["hi"] == y["lo"] for x, y in zip(b, b[1:], strict=False))
    total = b[-1]["hi"]
    draws = [0, 1, total - 1, *(r["lo"] for r in b), *(r["hi"] - 1 for r in b), -5, total + 3]
    got = {r["x"]: r["rank"] for r in corpora.zipf_ranks(spark.createDataFrame([(x,) for x in draws], "x long"), "x", 50).collect()}
    for x in draws:
        assert got[x] == next(r["rank"] for r in b if r["lo"] <= x % total < r["hi"])


def test_events_and_validators(capsys):
    import io

    out = io.StringIO()
    logs.configure(logging.INFO, out)
    logs.configure(logging.INFO, out)
    logs.log_event(logs.EventKind.FIT, n=3, name_of="x")
    logs.log_event(logs.EventKind.RANK)
    logs.reset()
    logs.log_event(logs.EventKind.FIT)
    assert out.getvalue() == 'INFO fit n=3 name_of="x"\n'
    with logs.capture() as a:
        logs.log_event(logs.EventKind.EDIT, b=1, a=2)
    assert [e.to_dict() for e in a.events] == [{"event": "edit", "a": 2, "b": 1}] and len(a.digest()) == 64
    assert check_non_negative([0.0, 1.0]) == [0.0, 1.0] and check_unique("ab") == ["a", "b"]
    for bad in (lambda: check_finite([math.nan]), lambda: check_non_negative([-1.0])):
        with pytest.raises(BadData):
            bad()
    with pytest.raises(DuplicateId):
        check_unique("aa")


def test_atomic_writes(tmp_path):
    path = tmp_path / "x.json"
    store.write_json(str(path), {"b": math.inf, "a": 1})
    assert path.read_text() == '{"a": 1, "b": null}\n' and list(tmp_path.iterdir()) == [path]
    store.write_jsonl_file(str(path), [{"a": 1}, {"a": 2}])
    assert path.read_text().count("\n") == 2


def test_harness(spark):
    report = run_benchmarks(spark, n_docs=60, n_queries=4, terms=3, k=3, repeats=1)
    assert report["scores"] > 0 and report["seconds"]["fit"] > 0
    a = spark.createDataFrame([(1, 0.1 + 0.2)], "k long, score double")
    with pytest.raises(ResultsDiffer):
        check_same_bits(a, a.withColumn("score", F.lit(0.3)), ["k"], "score")
    x = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b")], "query_id string, rnk int, doc_id string")
    with pytest.raises(ResultsDiffer):
        check_same_order(x, x.withColumn("rnk", 3 - F.col("rnk")))
    assert ranking.operator_digest("pi") != ranking.operator_digest("pi_alt")
    r = ranking.Ranking(x.withColumn("score", F.lit(1.0)), 3)
    assert r.top(1).count() == 1 and r.rank_of("b").first()["rnk"] == 2 and r.order_within(x.where("doc_id = 'b'").select("doc_id")).first()["pos"] == 1
    with pytest.raises(BadData):
        r.require_complete()
