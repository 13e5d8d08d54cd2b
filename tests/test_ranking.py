"""Ranking, margins, ties, distances against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestem.errors import RankOutOfRange, resolve_k
from lodestem.operators import analysis, distances, ranking, ties


def ranked(spark, scores: dict[str, list[float]]):
    rows = [(q, i + 1, f"d{i:03d}", s) for q, xs in scores.items() for i, s in enumerate(sorted(xs, reverse=True))]
    return spark.createDataFrame(rows, "query_id string, rnk int, doc_id string, score double")


def test_ratio_ranks(spark):
    rows = [("a", 14, 2), ("b", 21, 3), ("c", 1, 3), ("d", 10**17 + 1, 3 * 10**17), ("e", 0, 5), ("f", 3, 0), ("g", None, 2)]
    df = spark.createDataFrame(rows, "doc_id string, num long, den long")
    got = {r["doc_id"]: r["r_rank"] for r in ranking.dense_ranks(df, (ranking.Attribute("r", ("num", "den"), "ratio"),)).collect()}
    assert got["a"] == got["b"] == 0
    assert (got["d"], got["c"], got["e"]) == (1, 2, 3)
    assert got["f"] == got["g"] == 2147483647


def test_missing_policies(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "doc_id string, x long")
    first = ranking.dense_ranks(df, (ranking.Attribute("x", "x", missing="first"),)).collect()
    assert {r["doc_id"]: r["x_rank"] for r in first} == {"a": 0, "b": -1}
    with pytest.raises(Exception, match="is missing"):
        ranking.dense_ranks(df, (ranking.Attribute("x", "x", missing="forbid"),)).collect()


def test_margins(spark):
    r = ranked(spark, {"q": [0.5, 0.25, 0.25], "one": [0.1]})
    got = {(x["query_id"], x["k"]): x for x in ranking.margins(r, (1, 2, 3, 9)).collect()}
    assert got["q", 1]["boundary"] == 0.25 and got["q", 1]["inner"] is None
    assert got["q", 2]["exact_tie"] and got["q", 2]["inner"] == 0.25
    assert not got["q", 3]["defined"] and got["q", 9]["k_effective"] == 3
    assert not got["one", 1]["defined"]
    c = {x["k"]: x for x in ranking.certificates(ranking.margins(r.where("query_id = 'q'"), (1,))).collect()}
    assert c[1]["set_radius"] == 0.125
    w = {x["doc_id"]: x["perturbed"] for x in ranking.flip_witness(r, 1, 2.0**-30).where("query_id = 'q'").collect()}
    assert w["d001"] > w["d000"]
    with pytest.raises(RankOutOfRange):
        resolve_k(5, 3, strict=True)
    assert resolve_k(5, 3) == 3


def test_ties_against_brute_force(spark):
    rng = random.Random(5)
    tau = 0.001
    data = {f"q{i}": [round(rng.random() * 0.02, 4 if i % 2 else 3) for _ in range(rng.randint(1, 25))] for i in range(12)}
    data["edge"] = [0.6239016948897019, 0.6229016948897019]
    r = ranked(spark, data)
    cliques = {(x["query_id"], x["lo"], x["hi"]) for x in ties.cliques(r, tau).collect()}
    chains = {(x["query_id"], x["lo"], x["hi"]) for x in ties.chains(r, tau).collect()}
    balls = {(x["query_id"], x["lo"]): (x["ball_lo"], x["ball_hi"]) for x in ties.balls(r, tau).collect()}
    for q, xs in data.items():
        s = sorted(xs, reverse=True)
        n = len(s)
        reach = [max(b for b in range(a, n) if s[a] - s[b] <= tau) for a in range(n)]
        assert {(lo, hi) for k, lo, hi in cliques if k == q} == {(a, reach[a] + 1) for a in range(n) if a == 0 or reach[a] > reach[a - 1]}
        cuts = [0, *[i for i in range(1, n) if s[i - 1] - s[i] > tau], n]
        assert {(lo, hi) for k, lo, hi in chains if k == q} == set(itertools.pairwise(cuts))
        for j in range(n):
            lo = s.index(s[j])
            near = [i for i in range(n) if abs(s[i] - s[j]) <= tau]
            assert balls[q, lo] == (near[0], near[-1] + 1)
    with pytest.raises(ValueError):
        ties.check_tau(float("nan"))


def test_dyadic_ladder(spark):
    tau = 2.0**-20
    r = ranked(spark, {"q": [i * tau for i in range(10)]})
    rep = ties.tie_report(r, tau).first()
    assert (rep["largest_chain"], rep["largest_clique"], rep["rho"], rep["inflated"]) == (10, 2, 5.0, True)


def fks(a, b, p=0.5):
    total = 0.0
    for x, y in itertools.combinations(sorted({*a, *b}), 2):
        ia, ib = [v in a for v in (x, y)], [v in b for v in (x, y)]
        if all(ia) and all(ib):
            total += (a.index(x) < a.index(y)) != (b.index(x) < b.index(y))
        elif all(ia) and any(ib) or all(ib) and any(ia):
            both, other = (a, b) if all(ia) else (b, a)
            there, gone = (x, y) if x in other else (y, x)
            total += both.index(gone) < both.index(there)
        elif all(ia) or all(ib):
            total += p
        else:
            total += 1
    return total


def test_list_distances(spark):
    pairs = {"t1": ([3, 1, 0], [5, 3, 4]), "t2": ([5, 3, 4], [5, 4, 2]), "t3": ([3, 1, 0], [5, 4, 2]), "same": ([1, 2], [1, 2]), "apart": ([1, 2, 3], [4, 5, 6])}
    rows = [(k, s, str(x), i + 1) for k, ab in pairs.items() for s, xs in zip("ab", ab, strict=True) for i, x in enumerate(xs)]
    got = {r["key"]: r for r in distances.compare_top_k(spark.createDataFrame(rows, "key string, side string, item string, pos int")).collect()}
    for k, (a, b) in pairs.items():
        assert got[k]["fks_raw"] == fks(a, b), k
    assert [got[f"t{i}"]["fks_raw"] for i in (1, 2, 3)] == [6, 2, 12]
    assert got["apart"]["fks"] == 1.0 and got["apart"]["jaccard"] == 1.0 and got["same"]["fks"] == 0.0


def test_inversions(spark):
    rng = random.Random(1)
    seqs = {str(i): [rng.randint(0, 9) for _ in range(rng.randint(0, 30))] for i in range(8)}
    df = spark.createDataFrame([(k, i, x) for k, xs in seqs.items() for i, x in enumerate(xs)], "key string, i int, x int")
    got = {r["key"]: r["inversions"] for r in distances.inversions(df).collect()}
    assert all(got[k] == sum(a > b for a, b in itertools.combinations(xs, 2)) for k, xs in seqs.items() if xs)


def test_audit_is_sound(spark):
    r = ranked(spark, {"q": [0.9, 0.7, 0.4, 0.1], "tied": [0.5, 0.5, 0.5, 0.1]})
    attrs = r.select("doc_id").distinct().withColumns({f"{n}_rank": F.lit(0) for n in ("popularity", "rating", "engagement")})
    cells = {(x["certified"], x["unchanged"]): x["n"] for x in analysis.certificate_audit(r, attrs, 1, trials=50).collect()}
    assert cells[True, False] == 0 and sum(cells.values()) == 50 and cells[True, True] > 0


def test_bands():
    assert [b[0] for b in analysis.bands(1e-3)][0] == "(0, tau/100]" and analysis.bands(1e-3)[-1][0] == "(100*tau, inf)"


def test_band_probes(spark):
    r = ranked(spark, {"q": [1.0, 0.75, 0.5, 0.5, 0.46875], "z": [0.5, 0.25]})
    assert analysis.band_probes(r, 0.0, 0.5) == [0.0, 0.03125, 0.25] and analysis.band_probes(r, 0.25, 0.5) == [0.25, 0.375]
    assert analysis.is_band_invariant(r, 0.03125, 0.25) and not analysis.is_band_invariant(r, 0.0, 0.25)
    band = analysis.tau_band(r, 1e-15).first()
    assert (band["g_min"], band["n_exact_ties"], band["n_positive_gaps"], band["n_gaps_in_band"], band["is_invariant"]) == (0.03125, 1, 4, 0, True)


def test_count_inversions():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 7, 64, 65, 200):
        xs = [rng.randrange(40) for _ in range(n)]
        import numpy as np

        assert distances.count_inversions(np.array(xs)) == sum(a > b for a, b in itertools.combinations(xs, 2))


def test_top_without_a_grid(spark):
    rng = random.Random(6)
    docs = [f"d{i:02d}" for i in range(30)]
    attrs = spark.createDataFrame([(d, rng.randrange(4), rng.randrange(4), rng.randrange(4)) for d in docs], "doc_id string, popularity_rank int, rating_rank int, engagement_rank int")
    rows = [(f"q{q}", d, round(rng.random(), 1)) for q in range(8) for d in rng.sample(docs, q * 3)]
    queries = spark.createDataFrame([(f"q{q}",) for q in range(8)], "query_id string")
    touched = spark.createDataFrame(rows, "query_id string, doc_id string, score double")
    full = queries.join(attrs.select("doc_id"), F.lit(True)).join(touched, ["query_id", "doc_id"], "left").na.fill(0.0)
    for op in ranking.OPERATORS:
        for k in (1, 4, 12):
            want = {(r["query_id"], r["rnk"]): (r["doc_id"], r["score"]) for r in ranking.rank(full, attrs, op, k).collect()}
            got = {(r["query_id"], r["rnk"]): (r["doc_id"], r["score"]) for r in ranking.top(touched, queries, attrs, op, k).collect()}
            assert got == want
    ranks = {(r["query_id"], r["doc_id"]): r for r in ranking.rank_all(full, attrs).collect()}
    cut = ranking.top_all(touched, queries, attrs, 4).collect()
    for r in cut:
        for op in ranking.OPERATORS:
            true = ranks[r["query_id"], r["doc_id"]][f"rnk_{op}"]
            assert r[f"rnk_{op}"] == (true if true <= 5 else None)
    ranking.check_strict_order(full.join(attrs, "doc_id"))
    sub = ranking.subset_ranks(attrs, touched.select("query_id", "doc_id"), ("popularity",))
    for q in {r["query_id"] for r in sub.collect()}:
        got = {r["doc_id"]: r["popularity_rank"] for r in sub.where(F.col("query_id") == q).collect()}
        value = {r["doc_id"]: r["popularity_rank"] for r in attrs.collect()}
        order = sorted({value[d] for d in got})
        assert got == {d: order.index(value[d]) for d in got}


def test_ratio_products_fit(spark):
    df = lambda rows: spark.createDataFrame(rows, "n long, d long")
    assert ranking.ratios_fit(df([(2**40, 2**30), (1, 1)]), "n", "d") and not ranking.ratios_fit(df([(2**40, 1), (1, 2**30)]), "n", "d")
    assert ranking.ratios_fit(df([(2**62, 2**62)]), "n", "d") and ranking.ratios_fit(df([]), "n", "d")


def test_non_finite_scores_are_refused(spark):
    bad = spark.createDataFrame([("q", "d", float("nan"))], "query_id string, doc_id string, score double")
    with pytest.raises(Exception, match="not finite"):
        ranking.check_scores(bad).collect()

