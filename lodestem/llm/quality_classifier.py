"""Quality classifier: regularised quadratic discriminant over transformed
document statistics, scored with cached Cholesky factors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold_of, gram_hashes, inside, mix64, powers, staged, text_chunks, word_hashes, word_layout

#: Labelled rows that the fit may read (all, if there are fewer).
SAMPLE_ROWS = 20_000
#: Shrinkage of each class covariance to the pooled one, and of that to its
#: mean variance.
TO_POOLED = 0.1
TO_SPHERE = 0.02

FEATURES = ("words", "mean_word", "symbols", "bars", "upper", "shouts", "digits", "marks", "twin_lines", "repeats", "distinct", "line_words", "wide")


def _byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


# Classes of bytes that are counted.
BYTE_CLASSES = {
    "symbols": _byte_set(b"#*$%&<>"),
    "bars": _byte_set(b"|"),
    "upper": _byte_set(bytes(range(65, 91))),
    "shouts": _byte_set(b"!?"),
    "digits": _byte_set(b"0123456789"),
    "marks": _byte_set(b":;=_~^@/\\[]{}()"),
    "wide": np.arange(256) >= 0xC0,
}


def document_statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text of a chunk.  Texts
    without a word get the same finite row."""
    n = len(offs) - 1
    starts, ends, woff = word_layout(data, offs)
    words = np.diff(woff).astype(float)
    hashes = word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(woff))
    chars = np.maximum(np.bincount(doc, weights=(ends - starts).astype(float), minlength=n), 1.0)
    some = np.maximum(words, 1.0)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offs]).astype(float)

    count = {k: per_doc(v[data]) for k, v in BYTE_CLASSES.items()}

    def distinct(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, owner))
        o, k = owner[order], keys[order]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
        return np.bincount(o[new], minlength=n).astype(float)

    # lines that hold a word, as hashes of their word sequences
    line = np.concatenate([[0], np.cumsum(data == 10)])[starts] if len(starts) else np.zeros(0, np.int64)
    head = np.ones(len(starts), bool)
    head[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    if len(at):
        place = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
        line_hash = mix64(np.add.reduceat(hashes * powers(int(place.max()) + 1)[place], at))
    else:
        line_hash = np.zeros(0, np.uint64)
    lines = np.bincount(doc[at], minlength=n).astype(float)
    twin = lines - distinct(doc[at], line_hash)

    ok = inside(woff, 5)
    grams = gram_hashes(hashes, 5)[ok]
    gram_doc = doc[: len(ok)][ok]
    repeated = np.bincount(gram_doc, minlength=n) - distinct(gram_doc, grams)

    share = lambda a, b, eps: np.log(a / b + eps)
    some_lines = np.maximum(lines, 1.0)
    cols = {
        "words": np.log1p(words),
        "mean_word": np.log(chars / some),
        "twin_lines": share(twin, some_lines, 0.02),
        "repeats": share(repeated, some, 0.02),
        "distinct": share(distinct(doc, hashes), some, 0.02),
        "line_words": np.log1p(words / some_lines),
    }
    cols |= {k: share(count[k], chars, 0.01 if k != "wide" else 0.05) for k in BYTE_CLASSES}
    return np.stack([cols[k] for k in FEATURES], 1)


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): mean, inverse Cholesky factor of the shrunken
    covariance, and log prior less half its log determinant."""

    mean: np.ndarray
    whiten: np.ndarray
    offset: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 by the difference of log densities."""
        logs = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, o in zip(self.mean, self.whiten, self.offset, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))


def discriminant(n: np.ndarray, total: np.ndarray, outer: np.ndarray) -> Discriminant:
    """From the counts, sums and sums of outer products of both classes.  A
    class without rows takes the other's moments and a small prior; without any
    rows every score is one half."""
    d = total.shape[1]
    if n.sum() == 0:
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    for c in (0, 1):
        if n[c] == 0:
            total[c], outer[c] = total[1 - c] / n[1 - c], outer[1 - c] / n[1 - c]
    weight = np.where(n == 0, 1.0, n)
    mean = total / weight[:, None]
    cov = outer / weight[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (cov * weight[:, None, None]).sum(0) / weight.sum()
    pooled = (1 - TO_SPHERE) * pooled + TO_SPHERE * np.diag(np.maximum(np.diag(pooled), 1e-4)) + 1e-4 * np.eye(d)
    whiten, offset = [], []
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - TO_POOLED) * cov[c] + TO_POOLED * pooled + 1e-4 * np.eye(d))
        whiten.append(np.linalg.inv(factor))
        offset.append(np.log(weight[c] / weight.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(mean, np.stack(whiten), np.array(offset))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Discriminant:
    """Learn ``labels.quality`` on the learning fold (``crc32(doc_id) mod 3``
    not 1).  Moments are summed on the executors; the driver gets them only."""
    ids = labels.where((fold_of("doc_id", 3) != 1) & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("y")).dropDuplicates(["doc_id"])
    picked = F.broadcast(staged(bounded_sample(ids, "doc_id", sample_rows), "picked"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(picked, "doc_id").select("y", "text")
    d = len(FEATURES)

    def run(batches):
        moments = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in text_chunks(batch.column(1)):
                x = document_statistics(data, offs)
                for c in (0, 1):
                    mine = x[y[lo:hi] == c]
                    moments[c] += np.concatenate([[len(mine)], mine.sum(0), (mine.T @ mine).ravel()])
        size = moments.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], size).astype(np.int32)), pa.array(np.tile(np.arange(size), 2).astype(np.int32)), pa.array(moments.ravel())], names=["c", "i", "v"])

    got = rows.mapInArrow(run, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((2, 1 + d + d * d))
    for r in got:
        m[r["c"], r["i"]] = r["v"]
    return discriminant(m[:, 0], m[:, 1 : 1 + d].copy(), m[:, 1 + d :].reshape(2, d, d).copy())


def predict(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` for every row from its whole text (null: empty), narrow.
    Repeated rows give repeated rows; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            parts = [shared.value.score(document_statistics(data, offs)) for _, _, data, offs in text_chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["__id", "score"])

    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = src.schema["__id"].dataType.simpleString()
    return src.mapInArrow(run, f"__id {kind}, score double").withColumnRenamed("__id", id_col)
