"""Corpus pipeline: quality rules, near-duplicate join, substring dedup, secret
masking and packing, each a Spark operator over all that the stage before kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame.  All but the last return the columns of ``documents``.
Empty tables give empty results; columns beyond those of ``documents`` pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestem.llm import ngram_join, packing, quality_rules, secret_ledger, substring_dedup
from lodestem.llm.common import staged


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the base rules and a list learned from ``labels``.
    Null and empty texts have too few words and go; repeated rows fare alike, and
    so do equal statistics; without labels only the base rules decide."""
    rules = quality_rules.learn_from_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep_documents(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, one with the smallest
    id.  Null and empty texts and rows without an id link with nothing and stay;
    of repeated rows one stays; rows that repeat an id with another text are
    documents of their own."""
    return ngram_join.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of fifty words that an earlier document has; a document
    that loses all its words goes.  Null and empty texts, rows without an id and
    texts that lose nothing stay as they are; repeated ids are no earlier."""
    return _sized(substring_dedup.dedup_documents(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret found.  Null and empty texts and texts without a
    finding stay as they are; repeated rows and ids are masked one by one."""
    return _sized(secret_ledger.redact_documents(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences.  A null or empty text is its
    end token alone; repeated rows are packed as often as they occur; columns
    other than id and text are left behind, whatever their names."""
    import public_tokenizers

    out = packing.pack(packing.pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substrings),
    ("secret_scans", secrets),
    ("best_fit_packing", packed),
]

#: No SQL: learned rules, min-hashing and the packing have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written as
    Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
