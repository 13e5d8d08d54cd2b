"""Runs over a corpus: similarity, stability profile, ablations and a snapshot.

Each takes tables, writes Parquet tables under a folder and returns the manifest
of the run; what it counts is aggregated on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .logs import EventKind, log_event
from .operators import analysis, ranking, scoring, ties
from .operators.grid import Grid, embed_grid, evaluate, outcomes, provenance
from .operators.model import Model
from .sources.corpora import Dataset, table_digest, write_corpus
from .sources.store import Manifest, save_model

KS = (1, 5, 10, 20, 50)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    log_event(EventKind.WRITE, path=path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_similarity(model: Model, grid: Grid, attributes: DataFrame, out: str, k: int = 10, operator: str = "pi") -> Manifest:
    """Score every query of a grid over its own candidates: ``queries`` with what
    came of each, and ``top``, the best ``k`` candidates that score above 0."""
    log_event(EventKind.SCORE, mode=grid.mode, k=k)
    scores = _written(ranking.check_scores(evaluate(grid, model)), f"{out}/scores")
    results = _written(outcomes(grid, scores), f"{out}/queries")
    top = _written(ranking.rank(scores.where("score > 0"), attributes, operator, k).where(F.col("rnk") <= k), f"{out}/top")
    skipped = results.where("kind = 'degenerate'").count()
    if skipped:
        log_event(EventKind.SKIPPED, degenerate=skipped)
    return Manifest("similarity", {"k": k, "operator": ranking.operator_digest(operator), **provenance(grid, results)}, {"queries": table_digest(results), "top": table_digest(top)})


def _touched(model: Model, queries: DataFrame) -> DataFrame:
    return ranking.check_scores(scoring.touched_scores(model, queries))


def run_stability_profile(model: Model, query_vectors: DataFrame, query_ids: DataFrame, attributes: DataFrame, out: str, k: int = 10, trials: int = 40, seed: int = 0, audit_trials: int = 20, audit_ratio: float = 8.0) -> Manifest:
    """Margins and their distribution, the tau band, ties, the transition curve
    and the audit of the certificates, over all documents."""
    touched = _written(_touched(model, query_vectors), f"{out}/scores")
    top = _written(ranking.top(touched, query_ids, attributes, "pi", max(KS)), f"{out}/top")
    margins = _written(ranking.certificates(ranking.margins(top, KS, n_candidates=model.n_documents)), f"{out}/margins")
    _written(analysis.summarise(margins, "boundary", ["k"]), f"{out}/distribution")
    runs = _written(ties.score_runs(touched, query_ids, model.n_documents), f"{out}/runs")
    floor = analysis.tau_floor(analysis.noise_floor(model, query_vectors, query_ids.count()))
    band = _written(analysis.tau_band(runs, floor), f"{out}/band")
    tau = band.first()["display_tau"]
    if tau is not None:
        _written(ties.tie_report(runs, tau), f"{out}/ties")
    full = scoring.all_scores(model, query_vectors, query_ids)
    ranked = _written(ranking.rank(full, attributes, "pi"), f"{out}/ranking")
    curve = _written(analysis.transition_curve(ranked, attributes, k, trials=trials, seed=seed), f"{out}/curve")
    audit = _written(analysis.certificate_audit(ranked, attributes, k, trials=audit_trials, max_ratio=audit_ratio, seed=seed), f"{out}/audit")
    unsound = audit.where("certified and not unchanged and n > 0").head(1)
    if unsound:
        log_event(EventKind.REFUSED, certified_but_changed=unsound[0]["n"])
    return Manifest("stability", {"k": k, "trials": trials, "seed": seed, "tau_floor": floor, "display_tau": tau}, {"margins": table_digest(margins), "curve": table_digest(curve), "audit": table_digest(audit)})


def run_ablations(model: Model, query_vectors: DataFrame, query_ids: DataFrame, attributes: DataFrame, out: str, tau: float) -> Manifest:
    """Each other operator against ``pi``: list distances per query, the share of
    queries that differ, and both by band of the margin."""
    touched = _written(_touched(model, query_vectors), f"{out}/scores")
    ranks = _written(ranking.top_all(touched, query_ids, attributes, max(KS)), f"{out}/ranks")
    pairs = _written(analysis.ablate(ranks, KS, n_candidates=model.n_documents), f"{out}/pairs")
    rates = _written(analysis.disagreement_rate(pairs), f"{out}/rates")
    top = ranking.top(touched, query_ids, attributes, "pi", max(KS))
    margins = ranking.margins(top, KS, n_candidates=model.n_documents)
    strata = None
    for (pair,) in pairs.select("pair").distinct().orderBy("pair").collect():  # one row per operator
        one = analysis.stratify(margins, pairs.where(F.col("pair") == pair), tau, KS).withColumn("pair", F.lit(pair))
        strata = one if strata is None else strata.unionByName(one)
    if strata is not None:
        _written(strata, f"{out}/strata")
    return Manifest("ablations", {"tau": tau, "operators": {o: ranking.operator_digest(o) for o in ranking.OPERATORS}}, {"pairs": table_digest(pairs), "rates": table_digest(rates)})


def run_snapshot(data: Dataset, model: Model, out: str, grid: Grid | None = None) -> Manifest:
    """Corpus, model and (with a grid) embedded queries in one folder, with the
    digests that let a later run prove it used the same."""
    digests = {f"data.{k}": v for k, v in write_corpus(data, f"{out}/data").items()}
    digests["model"] = save_model(model, f"{out}/model").digests["model"]
    if grid is not None:
        digests["queries"] = table_digest(_written(embed_grid(grid, model), f"{out}/queries"))
    return Manifest("snapshot", {"dataset": data.name, "n_documents": model.n_documents}, digests).require_reproducible()
