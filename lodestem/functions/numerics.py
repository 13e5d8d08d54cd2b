"""Reproducible arithmetic: ordered sums, exactly rounded logarithms, bits.

``sum`` over doubles depends on partitioning.  Sums that must not are folds over
an array sorted by key: ``ordered_sum`` with the *naive* and *compensated* policies
stays in the JVM; *pairwise* and *exact* are grouped-aggregate Arrow UDFs.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from decimal import Context, Decimal
from enum import Enum

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NumericEnvironment

#: Addends per block of the pairwise policy.
PAIRWISE_BLOCK = 128
#: Digits of the logarithm before its one rounding.
LOG_DIGITS = 60


class Reduction(str, Enum):
    NAIVE = "naive"
    NEUMAIER = "neumaier"
    PAIRWISE = "pairwise"
    EXACT = "exact"


# --------------------------------------------------------- plain Python
def naive(values) -> float:
    total = 0.0
    for v in values:
        total += v
    return total


def neumaier(values) -> float:
    total = lost = 0.0
    for v in values:
        t = total + v
        lost += (total - t) + v if abs(total) >= abs(v) else (v - t) + total
        total = t
    return total + lost


def pairwise(values) -> float:
    """Blocks of 128 in order; equal-weight partial sums merge as they appear,
    what remains is added from the last level to the first, then the rest."""
    levels: list[tuple[int, float]] = []
    values = list(values)
    full = len(values) // PAIRWISE_BLOCK * PAIRWISE_BLOCK
    for lo in range(0, full, PAIRWISE_BLOCK):
        weight, part = 1, naive(values[lo : lo + PAIRWISE_BLOCK])
        while levels and levels[-1][0] == weight:
            part = levels.pop()[1] + part
            weight *= 2
        levels.append((weight, part))
    return naive(p for _, p in reversed(levels)) + naive(values[full:])


SUMS = {Reduction.NAIVE: naive, Reduction.NEUMAIER: neumaier, Reduction.PAIRWISE: pairwise, Reduction.EXACT: math.fsum}


def log_ratio(a: int, b: int) -> float:
    """``ln(a / b)`` of positive integers, rounded once."""
    if a == b:
        return 0.0
    ctx = Context(prec=LOG_DIGITS)
    return float(ctx.ln(ctx.divide(Decimal(a), Decimal(b))))


def smoothed_idf(df: int, n: int, exact: bool = True) -> float:
    """``ln((1 + n) / (1 + df)) + 1``."""
    if df < 0 or df > n:
        raise ValueError(f"document frequency {df} outside 0..{n}")
    return (log_ratio(1 + n, 1 + df) if exact else math.log((1 + n) / (1 + df))) + 1.0


def delta_idf(df: int, df_after: int, n: int, n_after: int, exact: bool = True) -> float:
    """What an edit of the corpus does to a smoothed idf."""
    return smoothed_idf(df_after, n_after, exact) - smoothed_idf(df, n, exact)


def bits(x: float) -> int:
    return struct.unpack("<q", struct.pack("<d", x))[0]


def ulps_between(a: float, b: float) -> int:
    key = lambda x: bits(x) if bits(x) >= 0 else -(bits(x) & 0x7FFFFFFFFFFFFFFF)
    return abs(key(a) - key(b))


def ulp(x: float) -> float:
    return math.ulp(x)


def same_bits(a: float, b: float) -> bool:
    return bits(a) == bits(b)


def unit(values: list[float]) -> list[float]:
    """The vector over its length; a zero vector has none and raises."""
    length = math.sqrt(naive(v * v for v in values))
    if length == 0.0:
        raise ValueError("a zero vector has no direction")
    return [v / length for v in values]


# -------------------------------------------------------------- columns
def bits_column(value: Column) -> Column:
    """The 64 bits of a double as a bigint, as ``bits`` has them (every NaN as
    the canonical one): two columns are equal bit for bit if these are."""
    return F.conv(F.hex(_big_endian(value)), 16, -10).cast("long")


def _big_endian(value: Column) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else struct.pack(">d", x))

    return run(value)


def fold(entries: Column, value: str = "x") -> Column:
    """Left fold from 0.0 over an array of structs, sorted by the structs."""
    return F.aggregate(F.sort_array(entries), F.lit(0.0), lambda a, e: a + e[value])


def fold_neumaier(entries: Column, value: str = "x") -> Column:
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("c"))

    def step(a, e):
        t = a["t"] + e[value]
        lost = F.when(F.abs(a["t"]) >= F.abs(e[value]), (a["t"] - t) + e[value]).otherwise((e[value] - t) + a["t"])
        return F.struct(t.alias("t"), (a["c"] + lost).alias("c"))

    return F.aggregate(F.sort_array(entries), zero, step, lambda a: a["t"] + a["c"])


def ordered_sum(key: Column, value: Column, policy: Reduction = Reduction.NAIVE) -> Column:
    """Aggregate: the sum of ``value`` in ascending ``key`` under a policy."""
    entries = F.collect_list(F.struct(key.alias("k"), value.alias("x")))
    if policy is Reduction.NAIVE:
        return fold(entries)
    if policy is Reduction.NEUMAIER:
        return fold_neumaier(entries)
    total = SUMS[policy]

    @F.pandas_udf("double")
    def over_arrays(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda xs: total(float(x) for x in xs))

    return over_arrays(F.transform(F.sort_array(entries), lambda e: e["x"]))


def exact_mean(values: Column) -> Column:
    """Aggregate: correctly rounded sum divided by the count."""

    @F.pandas_udf("double")
    def mean(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda xs: math.fsum(xs) / len(xs) if len(xs) else None)

    return mean(F.collect_list(values))


def with_idf(vocab: DataFrame, n_documents: int, df_col: str = "df", exact: bool = True) -> DataFrame:
    """Append ``idf``.  The exact logarithm runs once per distinct document frequency
    of a part; the vocabulary is read once, and nothing of it is shuffled."""
    if not exact:
        return vocab.withColumn("idf", F.log(F.lit(1.0 + n_documents) / (1 + F.col(df_col))) + 1)

    @F.pandas_udf("double")
    def idf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found: dict[int, float] = {}
        for df in parts:
            for d in df.dropna().unique():
                if d not in found:
                    found[d] = smoothed_idf(int(d), n_documents)
            yield df.map(found).astype(float)

    return vocab.withColumn("idf", idf(df_col))


def check_float_environment() -> dict:
    """Probe for binary64 with round-half-even and subnormals."""
    facts = {"radix": 2.0**53 + 1 == 2.0**53, "subnormal": 5e-324 > 0.0, "half_even": 2.0**53 + 3.0 == 2.0**53 + 4.0}
    if not all(facts.values()):
        raise NumericEnvironment(str(facts))
    return facts
