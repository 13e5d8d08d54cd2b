"""Experiments over rankings: distributions, ablations, strata, noise floor,
tau bands, transition curves and certificate audits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import BadConfig
from ..functions.numerics import Reduction, bits_column, exact_mean
from .distances import compare_top_k, top_lists
from .local import disagreements, postings
from .model import Model, norms
from .ranking import sort_keys
from .scoring import touched_scores
from .ties import chains, run_gaps, score_runs

PERCENTILES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
RATIOS = (0.25, 0.5, 0.9, 0.99, 1.0, 1.01, 1.1, 2.0, 5.0, 20.0)


def summarise(rows: DataFrame, value: str, by: list[str] | None = None, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """Counts, nearest-rank percentiles over defined values, exactly rounded
    mean.  NaN and null are counted, not averaged."""
    v = F.when(~F.isnan(value), F.col(value))
    aggs = [F.count("*").alias("n"), F.count_if(F.isnan(value) | F.col(value).isNull()).alias("n_nan"), F.count_if(F.col(value) == 0).alias("n_zero"), exact_mean(v).alias("mean")]
    aggs += [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY CASE WHEN NOT isnan({value}) THEN {value} END)").alias(f"p{round(100 * p)}") for p in percentiles]
    out = rows.groupBy(*(by or [])).agg(*aggs)
    defined = F.col("n") - F.col("n_nan")
    return out.withColumn("share_zero", F.when(defined > 0, F.col("n_zero") / F.when(defined > 0, defined)))


def ablate(ranks: DataFrame, ks: tuple[int, ...], others: tuple[str, ...] = ("pi_score", "pi_alt"), n_candidates: int | None = None) -> DataFrame:
    """``query_id, pair, k, k_effective`` and all list distances of each other
    operator against ``pi``.  Where k exceeds the candidates it is clamped, and
    the clamped rows say so in ``k_effective``.  Ranks cut to the best of each
    operator (``top_all``) need the number of candidates."""
    n = ranks.groupBy("query_id").agg((F.count("*") if n_candidates is None else F.lit(n_candidates).cast("long")).alias("n"))
    out = None
    for o in others:
        d = compare_top_k(top_lists(ranks, "rnk_pi", f"rnk_{o}", ks))
        d = d.select(F.col("key.query_id").alias("query_id"), F.lit(f"pi|{o}").alias("pair"), F.col("key.k").alias("k"), "fks", "jaccard", "intersection_size", "kendall_intersection", "sets_differ", "swapped")
        out = d if out is None else out.unionByName(d)
    return out.join(n, "query_id").withColumn("k_effective", F.least("k", "n").cast("int")).drop("n")


def disagreement_rate(pairs: DataFrame) -> DataFrame:
    """Per pair and effective k: share of queries whose top-k sets differ; each
    query counts once however many k were clamped to the same."""
    once = pairs.dropDuplicates(["query_id", "pair", "k_effective"])
    return once.groupBy("pair", "k_effective").agg(F.count("*").alias("n"), F.count_if("sets_differ").alias("n_disagree"), F.avg(F.col("sets_differ").cast("double")).alias("rate"))


def bands(tau: float) -> list[tuple[str, float, float]]:
    """Decades around tau, each open below and closed above.  The labels are
    fixed values."""
    edges = [(0.0, "0"), (tau / 100, "tau/100"), (tau / 10, "tau/10"), (tau, "tau"), (tau * 10, "10*tau"), (tau * 100, "100*tau"), (math.inf, "inf")]
    return [(f"({a[1]}, {b[1]}{')' if b[0] == math.inf else ']'}", a[0], b[0]) for a, b in zip(edges, edges[1:], strict=False)]


def band_of(value: Column, tau: float) -> Column:
    """``undefined``, ``exact_tie`` or a decade."""
    out = F.when(value.isNull() | F.isnan(value), "undefined").when(value == 0, "exact_tie")
    named = bands(tau)
    for label, _, hi in named[:-1]:
        out = out.when(value <= hi, label)
    return out.otherwise(named[-1][0])


def stratify(margin_rows: DataFrame, pairs: DataFrame, tau: float, ks: tuple[int, ...]) -> DataFrame:
    """Per band of the boundary margin and k: queries, disagreements, mean
    distances.  Empty bands keep their row, with null means."""
    spark = pairs.sparkSession
    labels = ["undefined", "exact_tie", *[b[0] for b in bands(tau)]]
    grid = spark.createDataFrame([(b, k) for b in labels for k in ks], "band string, k int")
    m = margin_rows.select("query_id", F.col("k").alias("mk"), band_of(F.col("boundary"), tau).alias("mband"))
    got = pairs.join(m, (pairs["query_id"] == m["query_id"]) & (F.col("k") == F.col("mk"))).groupBy(F.col("mband").alias("band"), "k").agg(
        F.count("*").alias("n"), F.count_if("sets_differ").alias("n_disagree"), F.avg("fks").alias("mean_fks"), F.avg("jaccard").alias("mean_jaccard")
    )
    zero = F.lit(0).cast("long")
    return grid.join(got, ["band", "k"], "left").select("band", "k", F.coalesce("n", zero).alias("n"), F.coalesce("n_disagree", zero).alias("n_disagree"), "mean_fks", "mean_jaccard")


def noise_floor(model: Model, query_vectors: DataFrame, n_queries: int | None = None) -> DataFrame:
    """Per reduction policy against exactly rounded sums: scores compared, that
    differ, largest difference, and that in units of the last place.  Norms are
    recomputed under each policy.  With ``n_queries``, every pair of a query and
    a document counts as compared: those without a common term are 0 either way."""

    policies = (Reduction.NAIVE, Reduction.NEUMAIER, Reduction.PAIRWISE)
    few = postings(query_vectors)
    if few is not None:
        d = disagreements(model.arranged(), few, policies).groupBy("policy")
        compared = F.sum("n") if n_queries is None else F.lit(n_queries * model.n_documents).cast("long")
        got = d.agg(compared.alias("n_compared"), *[f.alias(c) for c, f in (("n_differing", F.sum("n_differing")), ("max_abs", F.max("max_abs")), ("max_ulps", F.max("max_ulps")))])
        rows = model.vocab.sparkSession.createDataFrame([(p.value,) for p in policies], "policy string").join(got, "policy", "left")
        none = F.lit(0 if n_queries is None else n_queries * model.n_documents).cast("long")
        zero = F.lit(0).cast("long")
        return rows.select(F.coalesce("n_compared", none).alias("n_compared"), F.coalesce("n_differing", zero).alias("n_differing"), F.coalesce("max_abs", F.lit(0.0)).alias("max_abs"), F.coalesce("max_ulps", zero).alias("max_ulps"), "policy")

    def under(policy: Reduction) -> DataFrame:
        own = Model(model.vocab, model.weights, norms(model.weights, reduction=policy), model.n_documents, policy)
        return touched_scores(own, query_vectors, policy)

    exact, out = under(Reduction.EXACT).withColumnRenamed("score", "exact"), None
    for policy in policies:
        d = under(policy).join(exact, ["query_id", "doc_id"])
        gap = F.abs(F.col("score") - F.col("exact"))
        compared = F.count("*") if n_queries is None else F.lit(n_queries * model.n_documents).cast("long")
        ulps = F.coalesce(F.max(F.abs(bits_column(F.col("score")) - bits_column(F.col("exact")))), F.lit(0)).cast("long")
        row = d.agg(compared.alias("n_compared"), F.count_if(gap > 0).alias("n_differing"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_abs"), ulps.alias("max_ulps")).withColumn("policy", F.lit(policy.value))
        out = row if out is None else out.unionByName(row)
    return out


def tau_floor(floor: DataFrame) -> float:
    """Twice the worst disagreement with exact arithmetic."""
    return 2.0 * float(floor.agg(F.max("max_abs")).first()[0] or 0.0)


def tau_band(ranking: DataFrame, floor: float) -> DataFrame:
    """One row: the interval between arithmetic noise and the smallest positive
    gap, with the counts that back it, and whether any observed gap lies inside
    it.  Takes a ranking, or its ``score_runs``."""
    runs = score_runs(ranking)
    g, f = run_gaps(runs), F.lit(float(floor))
    ties = runs.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_exact_ties"))
    inf = F.lit(float("inf"))
    out = g.agg(F.coalesce(F.min("gap"), inf).alias("g_min"), F.count("*").alias("n_positive_gaps"), F.count_if(F.col("gap") <= f).alias("n_below_floor")).join(ties, F.lit(True))
    inside = g.join(out.select("g_min"), F.lit(True)).agg(F.count_if((F.col("gap") > f) & (F.col("gap") < F.col("g_min"))).alias("n_gaps_in_band"))
    out = out.join(inside, F.lit(True)).withColumn("tau_floor", f)
    valid = F.col("tau_floor") < F.col("g_min")
    ratio = F.col("g_min") / F.when(F.col("tau_floor") > 0, F.col("tau_floor"))
    display = F.when(F.col("g_min") == inf, F.col("tau_floor")).when(F.col("tau_floor") <= 0, F.col("g_min") / 2).otherwise(F.sqrt(F.col("tau_floor") * F.col("g_min")))
    return (
        out.withColumn("is_valid", valid)
        .withColumn("is_invariant", valid & (F.col("n_gaps_in_band") == 0))
        .withColumn("decades", F.when(valid & (F.col("tau_floor") > 0), F.log10(ratio)))
        .withColumn("display_tau", F.when(valid, display))
    )


def band_probes(ranking: DataFrame, floor: float, g_min: float, probes: int = 8) -> list[float]:
    """Thresholds that can tell whether chains change within ``[floor, g_min)``.

    Chains are a step function of the threshold that only steps at observed gaps.
    So the floor, the gaps inside the band (the smallest ``probes`` of them) and,
    where there is none, a point between the band's ends say all there is.
    """
    if probes < 1:
        raise BadConfig("at least one probe")
    runs = score_runs(ranking)
    found = run_gaps(runs).where((F.col("gap") > floor) & (F.col("gap") < g_min)).select("gap").distinct().orderBy("gap").limit(probes).collect()
    steps = [r["gap"] for r in found]
    if not steps:
        steps = [floor + 1.0 if math.isinf(g_min) else floor + (g_min - floor) / 2]
    return [floor, *steps]


def is_band_invariant(ranking: DataFrame, floor: float, g_min: float, probes: int = 8) -> bool:
    """Do chains stay the same all over the band?"""
    runs = score_runs(ranking)
    shapes = None
    for tau in band_probes(runs, floor, g_min, probes):
        one = chains(runs, tau).select("query_id", "lo", "hi", F.lit(tau).alias("tau"))
        shapes = one if shapes is None else shapes.unionByName(one)
    # a chain of every probe is a chain of all of them
    n = shapes.select("tau").distinct().count()
    return not shapes.groupBy("query_id", "lo", "hi").agg(F.count("*").alias("n")).where(F.col("n") < n).head(1)


def _draw(*keys: Column) -> Column:
    """Uniform in [-1, 1) from a hash of the keys: the same under any
    partitioning, unlike ``rand``."""
    return (F.xxhash64(*keys) / F.lit(2.0**63)).cast("double")


def _perturbed(base: DataFrame, attributes: DataFrame, k: int, trials: DataFrame, eps: Column, seed: int, near: Column | None = None) -> DataFrame:
    """Per cell (query and row of ``trials``): is the top-k set unchanged, and by how
    much did scores really move?

    The set changes if the best score outside passes the worst inside, so cells
    are extremes, aggregated where the rows are; only cells where the two are
    equal, which attributes decide, are ranked.  ``near`` says of an outside row
    and a cell whether it can matter at all.
    """
    keys = trials.columns
    noisy = base.join(F.broadcast(trials), F.lit(True))
    if near is not None:
        noisy = noisy.where((F.col("rnk") <= k) | near)
    noisy = noisy.withColumn("moved", F.col("score") + eps * _draw(F.lit(seed), F.col("query_id"), F.col("doc_id"), *[F.col(c) for c in keys]))
    inside = F.col("rnk") <= k
    found = noisy.groupBy("query_id", *keys).agg(
        F.min(F.when(inside, F.col("moved"))).alias("worst"), F.max(F.when(~inside, F.col("moved"))).alias("best"),
        F.max(F.abs(F.col("moved") - F.col("score"))).alias("realised"), F.max("radius").alias("radius"),
    ).persist()
    tied = found.where("worst = best").select("query_id", *[F.col(c).alias(f"__{c}") for c in keys], "worst")
    # the rows at the tied score: the set changes if one outside comes before one inside
    at = noisy.join(F.broadcast(tied), "query_id").where(F.col("moved") == F.col("worst"))
    for c in keys:
        at = at.where(F.col(c) == F.col(f"__{c}"))
    order = F.row_number().over(W.partitionBy("query_id", *keys).orderBy(*sort_keys("pi", F.col("moved"))))
    order = at.select("query_id", *keys, "doc_id", "moved", inside.alias("inside")).join(attributes, "doc_id").withColumn("r", order)
    passed = order.groupBy("query_id", *keys).agg((F.min(F.when(~F.col("inside"), F.col("r"))) < F.max(F.when(F.col("inside"), F.col("r")))).alias("passed"))
    changed = F.coalesce(F.col("best") > F.col("worst"), F.lit(False)) | F.coalesce("passed", F.lit(False))
    return found.join(passed, ["query_id", *keys], "left").withColumn("left", changed.cast("long"))


def _with_radius(ranking: DataFrame, k: int) -> DataFrame:
    """Ranked rows of queries with a positive margin at k, and its half."""
    m = ranking.groupBy("query_id").agg((F.max(F.when(F.col("rnk") == k, F.col("score"))) - F.max(F.when(F.col("rnk") == k + 1, F.col("score")))).alias("m"), F.max(F.when(F.col("rnk") == k, F.col("score"))).alias("kth"))
    return ranking.join(m.where("m > 0").select("query_id", (F.col("m") / 2).alias("radius"), "kth"), "query_id")


def transition_curve(ranking: DataFrame, attributes: DataFrame, k: int, ratios: tuple[float, ...] = RATIOS, trials: int = 40, seed: int = 0) -> DataFrame:
    """``ratio, flips, n, rate``: how often uniform noise of ``ratio`` times the
    radius changes the top-k set.  Queries tied or undefined at k are left out;
    more noise than the radius cannot be needed at ratios below 1."""
    base = _with_radius(ranking, k).persist()
    # k documents stay above kth - eps, so what lies more than 2 eps below kth
    # never enters the set: leaving it out changes no count, and each ratio has
    # its own reach
    reach = lambda ratio: F.col("score") >= F.col("kth") - F.col("radius") * (2.000001 * ratio) - 1e-12
    base = base.where(reach(max(ratios)))
    spark = ranking.sparkSession
    trial = spark.range(trials).select(F.col("id").alias("trial"), F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("ratio"))
    got = _perturbed(base, attributes, k, trial, F.col("radius") * F.col("ratio"), seed, reach(F.col("ratio")))
    return got.groupBy("ratio").agg(F.count_if(F.col("left") > 0).alias("flips"), F.count("*").alias("n")).withColumn("rate", F.col("flips") / F.col("n"))


def certificate_audit(ranking: DataFrame, attributes: DataFrame, k: int, trials: int = 40, max_ratio: float = 3.0, seed: int = 0) -> DataFrame:
    """``certified, unchanged, n`` of the four cells; the certificate is sound
    only if (certified, changed) is empty."""
    base = _with_radius(ranking, k)
    trial = ranking.sparkSession.range(trials).withColumnRenamed("id", "trial")
    size = (_draw(F.lit(seed + 1), F.col("query_id"), F.col("trial")) + 1) / 2 * max_ratio
    got = _perturbed(base, attributes, k, trial, F.col("radius") * size, seed)
    cell = got.select((F.col("realised") < F.col("radius")).alias("certified"), (F.col("left") == 0).alias("unchanged")).groupBy("certified", "unchanged").agg(F.count("*").alias("n"))
    grid = ranking.sparkSession.createDataFrame([(a, b) for a in (True, False) for b in (True, False)], "certified boolean, unchanged boolean")
    return grid.join(cell, ["certified", "unchanged"], "left").select("certified", "unchanged", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def rank_trajectories(ranking: DataFrame, k: int, query_id: str, docs: int = 12, steps: int = 80, max_ratio: float = 4.0, seed: int = 0) -> DataFrame:
    """``ratio, doc_id, rnk`` along one random direction for the leading documents
    of a query."""
    base = _with_radius(ranking.where(F.col("query_id") == query_id), k)
    ratio = ranking.sparkSession.range(steps).select((F.col("id") * (max_ratio / max(1, steps - 1))).alias("ratio"))
    moved = base.join(ratio, F.lit(True)).withColumn("moved", F.col("score") + F.col("radius") * F.col("ratio") * _draw(F.lit(seed), F.col("query_id"), F.col("doc_id")))
    now = F.row_number().over(W.partitionBy("ratio").orderBy(F.desc("moved"), "doc_id"))
    return moved.withColumn("now", now).where(F.col("rnk") <= docs).select("ratio", "doc_id", F.col("now").alias("rnk"))


def closest_pair(ranking: DataFrame) -> DataFrame:
    """The two neighbours with the smallest positive gap: the case to look at."""
    nxt = F.lead(F.struct("doc_id", "score")).over(W.partitionBy("query_id").orderBy("rnk"))
    pairs = ranking.withColumn("n", nxt).select("query_id", "rnk", F.col("doc_id").alias("upper"), F.col("n.doc_id").alias("lower"), (F.col("score") - F.col("n.score")).alias("gap"))
    return pairs.where("gap > 0").orderBy("gap", "rnk", "query_id").limit(1)
