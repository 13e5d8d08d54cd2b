"""TF-IDF model: fit, embed, inspect, digest."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateId, EmptyCorpus
from ..functions.numerics import Reduction, ordered_sum, with_idf
from .local import Made, arranged, folded_norms
from .vocabulary import VocabularyConfig, term_counts, vocabulary


#: Tokens, the most frequent ones, whose idf is broadcast.
FREQUENT = 200_000


@dataclass(frozen=True)
class Model:
    """``vocab(token, df, cf, idf)``, ``weights(doc_id, token, cnt, tf, weight)``,
    ``stats(doc_id, length, norm)``; documents without a known term have length
    and norm 0."""

    vocab: DataFrame
    weights: DataFrame
    stats: DataFrame
    n_documents: int
    reduction: Reduction = Reduction.NAIVE
    config: VocabularyConfig = field(default_factory=VocabularyConfig)
    #: Are the weights dealt by document and sorted by token (``local.arranged``)?
    dealt: bool = False
    #: The same vectors, made again where the texts lie (``texts``), and what of.
    made: Made | None = None
    origin: tuple | None = None

    def arranged(self) -> DataFrame | Made:
        if self.made is not None:
            return self.made
        return self.weights if self.dealt else arranged(self.weights)

    def zero_norm_documents(self) -> DataFrame:
        return self.stats.where("norm = 0").select("doc_id")

    def intermediates(self, doc_id: str) -> DataFrame:
        """Per term of one document: counts, tf, df, idf and weight."""
        return self.weights.where(F.col("doc_id") == doc_id).join(self.vocab, "token").select("token", "cnt", "tf", "df", "idf", "weight").orderBy("token")

    def idf_linf(self) -> float:
        return self.vocab.agg(F.max(F.abs("idf"))).first()[0] or 0.0

    def digest(self) -> str:
        """Of all ids, tokens, frequencies and weight bits: rows are hashed on
        the executors, per-bucket digests (256 of them) on the driver."""
        rows = self.vocab.select(F.concat_ws("\x1f", F.lit("v"), "token", F.col("df").cast("string"), F.col("cf").cast("string")).alias("r"))
        rows = rows.unionByName(self.weights.select(F.concat_ws("\x1f", F.lit("w"), "doc_id", "token", F.col("weight").cast("string")).alias("r")))
        hashed = rows.select(F.sha2("r", 256).alias("h")).groupBy(F.substring("h", 1, 3).alias("b"))
        got = hashed.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d")).orderBy("b").collect()
        return hashlib.sha256("".join(r["d"] for r in got).encode()).hexdigest()


def _hashed(vocab: DataFrame) -> DataFrame:
    """The smaller side by far: hashed a partition at a time, nothing is sorted."""
    return vocab.select("token", "idf").hint("shuffle_hash")


def _known(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``counts`` with the idf of each token, dealt as they were.  The most frequent
    tokens, a bounded number that makes up most rows, are broadcast and meet counts
    where they lie; rows of the others go to their token and come back."""
    found, cut = 0, None
    for df, n in sorted(map(tuple, vocab.groupBy("df").count().collect()), reverse=True):
        found += n
        if found > FREQUENT:
            break
        cut = df
    often = vocab if cut is None else vocab.where(F.col("df") >= cut)
    if found <= FREQUENT:
        return counts.join(F.broadcast(often.select("token", "idf")), "token")
    if cut is None:
        return counts.join(_hashed(vocab), "token")
    marked = counts.join(F.broadcast(often.select("token", "idf")), "token", "left")
    rare = marked.where("idf is null").drop("idf").join(_hashed(vocab.where(F.col("df") < cut)), "token")
    parts = max(1, counts._jdf.queryExecution().sparkPlan().outputPartitioning().numPartitions())  # noqa: SLF001
    return marked.where("idf is not null").unionByName(rare.select(*marked.columns).repartition(parts, "doc_id"))


def _asked(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """The idf of the tokens of ``counts``: if they are few, as those of queries are,
    they go to the vocabulary, of which nothing else is moved."""
    tokens = counts.select("token").distinct().persist()
    if tokens.count() > FREQUENT:
        return _hashed(vocab)
    return F.broadcast(vocab.select("token", "idf").join(F.broadcast(tokens), "token", "left_semi"))


def weigh(counts: DataFrame, vocab: DataFrame, whole: bool = False, deal: bool = False, few: bool = False) -> DataFrame:
    """``doc_id, token, cnt, tf, weight``: tf over the in-vocabulary length.  Where
    the vocabulary is ``whole``, that is the number of features, which ``counts``
    carries as ``length``; else the known ones are added up.  Dealt rows are
    ``local.arranged``, before the numbers that compress badly are made.  ``few``: the
    counts are cheap to make and have few tokens."""
    known = _known(counts, vocab) if deal else counts.join(_asked(counts, vocab) if few else _hashed(vocab), "token")
    if not whole:
        length = known.groupBy("doc_id").agg(F.sum("cnt").alias("length"))
        known = known.drop("length").join(length, "doc_id")
    if deal:
        known = arranged(known.select("doc_id", "token", "cnt", "length", "idf"))
    tf = F.col("cnt") / F.col("length")
    return known.select("doc_id", "token", "cnt", tf.alias("tf"), (tf * F.col("idf")).alias("weight"))


def norms(weights: DataFrame, key: str = "doc_id", reduction: Reduction = Reduction.NAIVE) -> DataFrame:
    """Per vector: in-vocabulary length and L2 norm, added in token order."""
    square = ordered_sum(F.col("token"), F.col("weight") * F.col("weight"), reduction)
    return weights.groupBy(key).agg(F.sum("cnt").alias("length"), F.sqrt(square).alias("norm"))


def fit(docs: DataFrame, cfg: VocabularyConfig = VocabularyConfig(), features_col: str = "features", id_col: str = "doc_id", exact_log: bool = True, reduction: Reduction = Reduction.NAIVE, keep=lambda df: df.persist(), check: bool = True) -> Model:
    """Fit on ``docs(id, features)``.  ``keep`` decides how the reused tables are
    held (persisted by default; a writer of a shared table at scale)."""
    ids = docs.select(F.col(id_col).cast("string").alias("doc_id"))
    n = ids.count()
    if check:
        if n == 0:
            raise EmptyCorpus("no documents")
        if ids.groupBy("doc_id").count().where("count > 1").head(1):
            raise DuplicateId("document ids must be unique")
    counts = keep(term_counts(docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(features_col).alias("features")), lengths=True))
    vocab = keep(with_idf(vocabulary(counts, n, cfg, check), n, exact=exact_log))
    weights = keep(weigh(counts, vocab, cfg.keeps_all(), deal=True))
    known = folded_norms(weights, policy=reduction)
    stats = keep(ids.join(known, "doc_id", "left").select("doc_id", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("norm", F.lit(0.0)).alias("norm")))
    return Model(vocab, weights, stats, n, reduction, cfg, dealt=True)


def embed(model: Model, queries: DataFrame, features_col: str = "features", id_col: str = "query_id") -> DataFrame:
    """``query_id, token, cnt, tf, weight`` with frozen vocabulary and idf."""
    counts = term_counts(queries.select(F.col(id_col).cast("string").alias("doc_id"), F.col(features_col).alias("features")))
    return weigh(counts, model.vocab, few=True).withColumnRenamed("doc_id", "query_id")


def float_digest(values) -> str:
    """SHA-256 over the raw little-endian bits of floats."""
    return hashlib.sha256(b"".join(struct.pack("<d", v) for v in values)).hexdigest()
