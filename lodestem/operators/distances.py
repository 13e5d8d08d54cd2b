"""Distances between top-k lists and permutations.

Lists are rows ``key, side, item, pos`` with ``side`` ``a`` or ``b``; every result
has one row per key.  Pair counts self-join lists of at most k items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENALTY = 0.5


def fks_max(k: Column | int, p: float = PENALTY) -> Column:
    """Largest generalised Kendall distance of two k-lists: disjoint ones."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(k < 1, F.lit(0.0)).otherwise(k * k + p * k * (k - 1))


def aligned(lists: DataFrame) -> DataFrame:
    """``key, item, pa, pb``: positions in both lists, null where absent."""
    return lists.groupBy("key", "item").agg(F.max(F.when(F.col("side") == "a", F.col("pos"))).alias("pa"), F.max(F.when(F.col("side") == "b", F.col("pos"))).alias("pb"))


def count_inversions(values: np.ndarray) -> int:
    """Pairs out of order: sorted blocks of doubling width are merged, all of a
    width at once, and every element of a right block counts the larger ones of
    the block to its left."""
    x = np.unique(values, return_inverse=True)[1].astype(np.int64)
    n, total, width = len(x), 0, 1
    at = np.arange(n)
    while width < n:
        pair = at // (2 * width)
        key = pair * (n + 1) + x
        left = at // width % 2 == 0
        lefts = key[left]
        ends = np.searchsorted(lefts, (pair[~left] + 1) * (n + 1))
        total += int((ends - np.searchsorted(lefts, key[~left], side="right")).sum())
        x = x[np.argsort(key, kind="stable")]
        width *= 2
    return total


def inversions(seq: DataFrame, key: str = "key", order: str = "i", value: str = "x") -> DataFrame:
    """Pairs out of order per key, counted in Arrow batches."""

    @F.pandas_udf("long")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda xs: count_inversions(np.asarray(xs)))

    got = seq.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda e: e[value]).alias("xs"))
    return got.select(key, run("xs").alias("inversions"))


def kendall_tau(lists: DataFrame) -> DataFrame:
    """``key, n, discordant, tau``: for permutations of one set; another set
    raises, fewer than two items have distance 0."""
    both = aligned(lists).withColumn("pa", F.coalesce("pa", F.raise_error(F.lit("the lists rank different sets")).cast("int"))).withColumn(
        "pb", F.coalesce("pb", F.raise_error(F.lit("the lists rank different sets")).cast("int"))
    )
    return _kendall(both)


def _kendall(both: DataFrame) -> DataFrame:
    y = both.select("key", F.col("pa").alias("qa"), F.col("pb").alias("qb"))
    bad = both.join(y, "key").where((F.col("pa") < F.col("qa")) & (F.col("pb") > F.col("qb"))).groupBy("key").agg(F.count("*").alias("discordant"))
    n = both.groupBy("key").agg(F.count("*").alias("n"))
    d = F.coalesce("discordant", F.lit(0))
    return n.join(bad, "key", "left").select("key", "n", d.alias("discordant"), F.when(F.col("n") < 2, 0.0).otherwise(d / (F.col("n") * (F.col("n") - 1) / 2)).alias("tau"))


def _pair_cost(p: float) -> tuple[Column, Column]:
    """Of the pair ``x, y`` of aligned items: its generalised Kendall cost, and
    whether both lists hold both items and disagree."""
    xa, xb, ya, yb = (F.col(c) for c in ("x.pa", "x.pb", "y.pa", "y.pb"))
    has = lambda c: c.isNotNull()
    in_a, in_b = has(xa) & has(ya), has(xb) & has(yb)
    # one list holds both, the other exactly one: it must be the one ahead
    one_b = F.when(has(xb), ya < xa).otherwise(xa < ya)
    one_a = F.when(has(xa), yb < xb).otherwise(xb < yb)
    apart = in_a & in_b & ((xa < ya) != (xb < yb))
    cost = (
        F.when(in_a & in_b, apart.cast("double"))
        .when(in_a & (has(xb) | has(yb)), one_b.cast("double"))
        .when(in_b & (has(xa) | has(ya)), one_a.cast("double"))
        .when(in_a | in_b, F.lit(float(p)))
        .otherwise(1.0)
    )
    return F.when(F.col("y").isNull(), 0.0).otherwise(cost), F.when(F.col("y").isNull(), 0).otherwise(F.coalesce(apart, F.lit(False)).cast("int"))


def _measured(lists: DataFrame, p: float) -> DataFrame:
    """Per key: sizes, the sum of pair costs and the discordant common pairs.  A
    key's items, at most two lists of k, are one array; its pairs come from
    exploding it against its own rest, so nothing is joined."""
    sizes = [F.count("pa").alias("n_a"), F.count("pb").alias("n_b"), F.count_if(F.col("pa").isNotNull() & F.col("pb").isNotNull()).alias("intersection_size"), F.count("*").alias("union_size")]
    kept = ["key", "n_a", "n_b", "intersection_size", "union_size"]
    whole = aligned(lists).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("item", "pa", "pb"))).alias("xs"), *sizes)
    one = whole.select(*kept, "xs", F.posexplode("xs").alias("i", "x"))
    pairs = one.select(*kept, "x", F.explode_outer(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("y"))
    cost, apart = _pair_cost(p)
    return pairs.groupBy(*kept).agg(F.sum(cost).alias("fks_raw"), F.sum(apart).alias("discordant"))


def kendall_fks(lists: DataFrame, p: float = PENALTY) -> DataFrame:
    """``key, fks_raw, fks``: generalised Kendall distance over the union of two
    top-k lists, raw and divided by its largest value for the longer list."""
    top = fks_max(F.greatest("n_a", "n_b"), p)
    return _measured(lists, p).select("key", "fks_raw", F.when(top > 0, F.col("fks_raw") / top).otherwise(0.0).alias("fks"))


def compare_top_k(lists: DataFrame, p: float = PENALTY) -> DataFrame:
    """All measures of two top-k lists per key.  ``kendall_intersection`` is null
    with fewer than two common items."""
    n = F.col("intersection_size")
    top, odd = fks_max(F.greatest("n_a", "n_b"), p), F.col("union_size") - n
    return _measured(lists, p).select(
        "key", "n_a", "n_b", "intersection_size", "union_size", "fks_raw", F.when(top > 0, F.col("fks_raw") / top).otherwise(0.0).alias("fks"),
        F.when(n >= 2, F.col("discordant") / (n * (n - 1) / 2)).alias("kendall_intersection"), (odd > 0).alias("sets_differ"),
        F.when(F.col("union_size") == 0, 0.0).otherwise(1 - n / F.col("union_size")).alias("jaccard"), F.floor(odd / 2).alias("swapped"),
    )


def top_lists(ranks: DataFrame, a: str, b: str, ks: tuple[int, ...]) -> DataFrame:
    """``key(query_id, k), side, item, pos`` from one row per candidate with its
    ranks ``a`` and ``b``."""
    k = F.explode(F.array(*[F.lit(x) for x in ks]))
    rows = ranks.where(F.least(a, b) <= max(ks)).select("query_id", "doc_id", a, b, k.alias("k"))
    sides = F.array(F.struct(F.lit("a").alias("side"), F.col(a).alias("pos")), F.struct(F.lit("b").alias("side"), F.col(b).alias("pos")))
    out = rows.select(F.struct("query_id", "k").alias("key"), F.col("doc_id").alias("item"), F.col("k").alias("__k"), F.inline(sides))
    return out.where(F.col("pos") <= F.col("__k")).drop("__k")
