"""Vocabulary: document and collection frequencies, bounds, cuts, ids."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadConfig, EmptyVocabulary
from .ranking import positions


class Cut(Enum):
    """Which features stay when there are more than ``max_features``."""

    DF_CF = ("df", "cf")
    CF_DF = ("cf", "df")
    CF = ("cf",)


@dataclass(frozen=True)
class VocabularyConfig:
    min_df: int | float = 1
    max_df: int | float = 1.0
    max_features: int | None = None
    cut: Cut = Cut.DF_CF

    def keeps_all(self) -> bool:
        """Do these bounds leave every term of every corpus in?"""
        return self.max_features is None and self.min_df in (0, 1) and isinstance(self.min_df, int) and self.max_df == 1.0 and isinstance(self.max_df, float)


def threshold(value: int | float, n: int, lower: bool) -> int:
    """An integer stands for itself; a fraction in (0, 1] is taken of ``n``
    exactly and rounded up for a lower and down for an upper bound."""
    if isinstance(value, bool) or (isinstance(value, int) and value < 0):
        raise BadConfig(f"bad document-frequency bound {value!r}")
    if isinstance(value, int):
        return value
    if not 0.0 < value <= 1.0:
        raise BadConfig(f"a proportional bound lies in (0, 1], not {value!r}")
    exact = Fraction(value).limit_denominator(10**6) * n
    return math.ceil(exact) if lower else math.floor(exact)


def term_counts(docs: DataFrame, features_col: str = "features", id_col: str = "doc_id", lengths: bool = False) -> DataFrame:
    """``doc_id, token, cnt`` (and ``length``, the number of features): the one
    explode that everything else reuses."""
    key = ["doc_id", "token", *["length"] * lengths]
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.size(features_col).cast("long").alias("length")] * lengths, F.explode(features_col).alias("token"))
    return rows.groupBy(*key).agg(F.count("*").alias("cnt"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.count("*").alias("df"))


def collection_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.sum("cnt").alias("cf"))


def frequencies(counts: DataFrame) -> DataFrame:
    """``token, df, cf`` in one aggregation."""
    return counts.groupBy("token").agg(F.count("*").alias("df"), F.sum("cnt").alias("cf"))


def vocabulary(counts: DataFrame, n_documents: int, cfg: VocabularyConfig = VocabularyConfig(), check: bool = True) -> DataFrame:
    """``token, df, cf`` within the bounds, cut to ``max_features``.

    Terms are known by their token: its byte order *is* the order of term ids,
    so no global numbering is needed until one is exported (``numbered``).
    """
    return bounded(frequencies(counts), n_documents, cfg, check)


def bounded(found: DataFrame, n_documents: int, cfg: VocabularyConfig = VocabularyConfig(), check: bool = True) -> DataFrame:
    """``vocabulary`` of ``frequencies``."""
    lo, hi = threshold(cfg.min_df, n_documents, True), threshold(cfg.max_df, n_documents, False)
    out = found.where(F.col("df").between(max(lo, 1), hi))
    if cfg.max_features is not None:
        if cfg.max_features < 1:
            raise BadConfig("max_features must be positive")
        out = out.orderBy(*[F.desc(c) for c in cfg.cut.value], F.asc("token")).limit(cfg.max_features)
    if check and not out.head(1):
        raise EmptyVocabulary(f"no feature has a document frequency in {lo}..{hi}")
    return out


def numbered(vocab: DataFrame) -> DataFrame:
    """Append ``term_id``: the rank of the token in byte order."""
    return positions(vocab, "token", out="term_id")


def df_after_edit(df: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Document frequencies after documents (given as ``doc_id, token`` rows)
    left and came; tokens that fall to none are gone."""
    per = lambda x, sign: x.select("doc_id", "token").distinct().groupBy("token").agg((F.count("*") * sign).alias("d"))
    delta = per(removed, -1).unionByName(per(added, 1)).groupBy("token").agg(F.sum("d").alias("d"))
    return df.join(delta, "token", "full_outer").select("token", (F.coalesce("df", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("df")).where("df > 0")
