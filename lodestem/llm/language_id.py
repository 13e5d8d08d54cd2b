"""Language identification: multinomial naive Bayes over hashed character
n-grams, scored in numpy against a broadcast log-probability matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, staged, text_chunks

#: Lengths of the character n-grams and log2 of the number of hash buckets.
ORDERS = (1, 2, 3)
BITS = 16
#: Labelled rows that the fit may read (all, if there are fewer).
SAMPLE_ROWS = 12_000
SMOOTHING = 0.5

_lower = np.arange(0x110000, dtype=np.uint32)
_letter: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Simple lower case and the letter flag of every code point."""
    global _letter
    if _letter is None:
        _letter = np.zeros(0x110000, dtype=bool)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                _letter[cp] = True
                low = c.lower()
                if len(low) == 1:
                    _lower[cp] = ord(low)
    return _lower, _letter


def buckets(codes: np.ndarray, doc_start: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(document, bucket)`` of every n-gram.  Runs of other characters count
    as one space; n-grams do not cross texts."""
    mask = np.uint32((1 << BITS) - 1)
    h = np.zeros(len(codes), np.uint32)
    all_doc, all_h = [], []
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + (codes[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        if n in ORDERS:
            ok = doc[:m] == doc[n - 1 :]
            g = h ^ (h >> np.uint32(15))
            g *= np.uint32(0x85EBCA6B)
            g ^= g >> np.uint32(13)
            all_h.append((g & mask)[ok])
            all_doc.append(doc[:m][ok])
    if not all_h:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate(all_doc), np.concatenate(all_h)


def chunk_grams(data: np.ndarray, offs: np.ndarray):
    """Of the texts of one chunk: ``(document, bucket, has a letter)``."""
    lower, letter = _tables()
    lead = (data & 0xC0) != 0x80
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    coffs = np.concatenate([[0], np.cumsum(lead)])[offs]
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(coffs))
    is_letter = letter[codes]
    has = np.zeros(len(offs) - 1, bool)
    has[doc[is_letter]] = True
    # one space for each run of other characters
    keep = is_letter.copy()
    if len(keep):
        keep[0] = True
        keep[1:] |= is_letter[:-1] | (doc[1:] != doc[:-1])
    codes = np.where(is_letter, lower[codes], np.uint32(32))[keep]
    doc = doc[keep]
    d, b = buckets(codes, coffs, doc)
    return d, b, has


@dataclass(frozen=True)
class LanguageModel:
    """``log_prob[bucket, language]`` and the log priors."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from rows whose language and id are not null: all rows of at most
    ``sample_rows`` ids, drawn before any text is read.  Counts are summed on the
    executors; what reaches the driver is one vector per language, bounded by
    the number of buckets."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    ids = staged(bounded_sample(known.select(F.col(id_col).alias("__pick")).distinct(), "__pick", sample_rows), "picked")
    rows = known.join(F.broadcast(ids), F.col(id_col) == F.col("__pick"))  # at most sample_rows ids
    src = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            sums: dict[str, np.ndarray] = {}
            n: dict[str, int] = {}
            for lo, hi, data, offs in text_chunks(batch.column(1)):
                d, b, _ = chunk_grams(data, offs)
                at = np.array([langs[i] for i in range(lo, hi)], dtype=object)
                for lang in set(at.tolist()):
                    mine = np.flatnonzero(at == lang)
                    pick = np.isin(d, mine)
                    sums[lang] = sums.get(lang, 0) + np.bincount(b[pick], minlength=1 << BITS)
                    n[lang] = n.get(lang, 0) + len(mine)
            for lang, v in sums.items():
                at = np.flatnonzero(v)
                k = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (k + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(v[at], n[lang]).astype(np.int64))], names=["lang", "bucket", "n"]
                )

    counts = src.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    langs = tuple(sorted(set(table.column("lang").to_pylist())))
    if not langs:
        return LanguageModel((), np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    of = np.array([langs.index(x) for x in table.column("lang").to_pylist()])
    bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy().astype(float)
    freq = np.full((1 << BITS, len(langs)), SMOOTHING)
    gram = bucket >= 0
    freq[bucket[gram], of[gram]] += n[gram]
    prior = np.zeros(len(langs))
    prior[of[~gram]] = n[~gram]
    return LanguageModel(langs, np.log(freq / freq.sum(0)).astype(np.float32), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` for every row, from the text alone.

    Null texts and texts without a letter are ``und`` with score 0, and so is
    every text under a model without languages.  Equal scores go to the
    language that is first in byte order.  Repeated rows give repeated rows.
    Narrow; the broadcast matrix is ``2**BITS`` x languages floats.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_prob, model.log_prior))

    def run(batches):
        langs, log_prob, prior = shared.value
        table = np.ascontiguousarray(log_prob.T)
        for batch in batches:
            pred, score = np.full(batch.num_rows, "und", dtype=object), np.zeros(batch.num_rows)
            for lo, hi, data, offs in text_chunks(batch.column(1), 1 << 19):
                if not len(data) or not langs:
                    continue
                d, b, has = chunk_grams(data, offs)
                total = np.stack([np.bincount(d, weights=row[b], minlength=hi - lo) for row in table], 1) + prior
                top = total.argmax(1)
                p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                at = np.flatnonzero(has)
                pred[lo + at] = np.array(langs, dtype=object)[top[at]]
                score[lo + at] = p[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["__id", "lang_pred", "score"])

    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = src.schema["__id"].dataType.simpleString()
    return src.mapInArrow(run, f"__id {kind}, lang_pred string, score double").withColumnRenamed("__id", id_col)
