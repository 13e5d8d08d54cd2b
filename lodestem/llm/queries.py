"""Contract queries of the corpus operators: ``opN_<name>(spark, sf_dir)``.

Each applies its operator, with production parameters, to its whole table and
derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, predict

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = predict(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_ledger import by_path, digest, scan_by_version

    return digest(by_path(scan_by_version(_table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, pieces

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pack(pieces(docs, _tokenizer("word_bpe_49k.json")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge, learn_from_tables

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_from_tables(docs, _table(spark, sf_dir, "labels"))
    out = judge(docs, rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import fit, predict

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = predict(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup

    return dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), digests_only=True)


def op7_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_codec import encode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests_only=True)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join

    return join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, predict

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs.where(fold_of("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_ledger": op2_secret_ledger,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_embedding_join": op7_embedding_join,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_language_id": op10_language_id,
}

_SPAN_LIST = """
    list_transform(range(len(m)), lambda i: {{
        'ord': {ord}, 'kind': '{kind}', 'ok': len(h[i + 1]) >= {least},
        's': list_sum([len(x) for x in p[1:i + 1]]) + coalesce(list_sum([len(x) for x in m[1:i]]), 0),
        'n': len(m[i + 1])}})
"""

_OP2_RULES = (  # the rules in RE2's syntax
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 1),
    ("hex", r"[0-9a-f]{16,}", 0, 1),
    ("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", 0, 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)


def _op2_sql() -> str:
    per_rule = " UNION ALL ".join(
        f"""SELECT doc_id, unnest({_SPAN_LIST.format(ord=k, kind=kind, least=least)}, recursive := true) FROM (
            SELECT doc_id, regexp_extract_all(t, '{pat}', 0) AS m, regexp_extract_all(t, '{pat}', {group}) AS h,
                   regexp_split_to_array(t, '{pat}') AS p FROM docs)"""
        for k, (kind, pat, group, least) in enumerate(_OP2_RULES)
    )
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({per_rule}),
named AS (SELECT doc_id, ord, kind, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS txt FROM spans WHERE ok),
agg AS (SELECT doc_id,
    count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(txt, ',' ORDER BY s, ord) FILTER (WHERE ord < 3) AS base, string_agg(txt, ',' ORDER BY s, ord) AS spans
    FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN agg USING (doc_id)
"""


ORACLE_SQL: dict[str, str] = {
    "op2_secret_ledger": _op2_sql(),
}
