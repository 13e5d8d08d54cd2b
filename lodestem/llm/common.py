"""Shared pieces of the corpus operators: shared staging folder, word layout
and 64-bit word hashing over whole Arrow batches."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words (space, tab, LF, VT, FF, CR).
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

#: Rows of a batch that goes to a Python worker: whole texts travel in them.
BATCH_ROWS = "1000"


# --------------------------------------------------------------- staging
def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.
    Only where that is unset and everything runs in one process (tests, local
    use) one is made and set; on a cluster it must be named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith(("local[", "local:")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="lodestem-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str = "t", cols: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a
    lost executor costs nothing that was finished."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestem/{name}-{uuid.uuid4().hex}"
    # the exchanges of this write serve nothing else: their files go with it;
    # whole texts travel to Python workers in small batches
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}
    old = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        df.write.mode("overwrite").parquet(path)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path  # noqa: SLF001
    return out


def discard(*frames: DataFrame) -> None:
    """Remove staged tables that no pending plan reads any more."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


def parts_of(spark: SparkSession, at_least: int = 1) -> int:
    """Number of shuffle partitions of the session, for explicit exchanges."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def split_by_ids(df: DataFrame, ids: DataFrame, id_col: str, bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """``(rows whose id may be among ids, rows whose id is not)``.

    A bitmap of ``2**bits`` hashed ids, at most ``2**(bits-6)`` rows and so of
    bounded size, is broadcast.  It never sends a listed id to the second part;
    as more ids are listed, more others land in the first.
    """
    slot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(1 << bits))
    key = ids.columns[0]
    table = ids.select(slot(key).alias("__slot")).groupBy(F.shiftright("__slot", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(__slot & 63 as int)))").alias("__bits"))
    table = F.broadcast(staged(table, "bitmap"))
    marked = df.withColumn("__slot", slot(id_col)).join(table, F.shiftright("__slot", 6) == F.col("__word"), "left")
    maybe = F.coalesce(F.expr("shiftrightunsigned(__bits, cast(__slot & 63 as int)) & 1L") == 1, F.lit(False))
    extra = ["__slot", "__word", "__bits"]
    return marked.where(maybe).drop(*extra), marked.where(~maybe).drop(*extra)


def fold_of(id_col: str | Column, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def bounded_sample(df: DataFrame, id_col: str, rows: int, seed: int = 42) -> DataFrame:
    """The ``rows`` rows with the smallest hash of their id: a uniform, bounded
    and reproducible sample.  Most rows are left out by a cut on the hash that
    follows from the row count, so that about ``rows`` rows travel in all,
    however many tasks there are.  With fewer rows, all of them."""
    draw = F.xxhash64(F.col(id_col), F.lit(seed))
    n = df.count()
    if n > rows:
        part = min(1.0, (1.2 * rows + 200) / n)
        df = df.where(draw < F.lit(int(-(2**63) + part * (2**64 - 1))))
    return df.orderBy(draw, F.col(id_col)).limit(rows)


# ---------------------------------------------------------- Arrow batches
def text_chunks(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole texts of about ``max_bytes``:
    ``(first row, row after the last, bytes, offsets from 0)``.  A null text is
    empty.  A text longer than the bound is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if arr.null_count:
        arr = arr.fill_null(b"")
    n = len(arr)
    if n == 0:
        return
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + n + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """First ``n`` powers of the odd base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(n, 256, 2 * len(_powers))
        p = np.full(size, _BASE, dtype=np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(p)
    return _powers[:n]


def word_layout(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts laid end to end: ``(start of each word, end of
    each word, index of each text's first word, with the total last)``."""
    solid = ~IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offs[1:-1]
    at = inner[inner < len(data)]
    first[at] = solid[at]
    at = inner[inner > 0] - 1
    last[at] = solid[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...] = (0,)) -> np.ndarray:
    """A 64-bit hash of each word's bytes; a row of them for each seed, if there
    are several.

    Eight bytes at a time go through a bijective finaliser, so words of up to
    eight bytes of one length never share a hash, and no algebraic structure of
    longer ones survives (a polynomial modulo 2**64 has colliding words whatever
    its base).
    """
    size = ends - starts
    out = np.empty((len(seeds), len(starts)), np.uint64)
    if len(starts):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data),), "<u8", padded, strides=(1,))
        first = eight[starts] & _LOW_BYTES[np.minimum(size, 8)]
        for h, seed in zip(out, seeds, strict=True):
            h[:] = mix64(mix64(size.astype(np.uint64) + np.uint64(seed + 1 << 40)) * _STEP + first)
        live, at = np.flatnonzero(size > 8), 8
        while len(live) and at < LONG_WORD:
            part = eight[starts[live] + at] & _LOW_BYTES[np.minimum(size[live] - at, 8)]
            for h in out:
                h[live] = mix64(h[live] * _STEP + part)
            at += 8
            live = live[size[live] > at]
        for i in live.tolist():
            raw = data[starts[i] : ends[i]].tobytes()
            for h, seed in zip(out, seeds, strict=True):
                h[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=seed.to_bytes(2, "little")).digest(), "little")
    return out[0] if len(seeds) == 1 else out


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    return mix64(a * _STEP + b)


def ladder(words: np.ndarray, most: int) -> list[np.ndarray]:
    """Hashes of the runs of 1, 2, 4 ... words from each word on, up to the
    largest power of two that is at most ``most``."""
    out = [words]
    while 1 << len(out) <= most:
        half = 1 << len(out) - 1
        out.append(joint(out[-1][:-half], out[-1][half:]))
    return out


def run_hashes(rungs: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the words ``lo`` to ``hi`` (exclusive) for each pair of bounds,
    wherever they stand: of the two longest rungs that cover them."""
    size = hi - lo
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.uint64)
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        out[at] = joint(joint(rungs[k][lo[at]], rungs[k][hi[at] - (1 << k)]), size[at].astype(np.uint64))
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (also those over the border
    of two texts; callers mask them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    top = ladder(words, k)[-1]
    cover = 1 << k.bit_length() - 1
    return joint(top[:n], top[k - cover : k - cover + n]) if cover < k else top[:n]


def inside(woff: np.ndarray, k: int) -> np.ndarray:
    """For each run of ``k`` words: does it lie within one text?"""
    n = int(woff[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    doc = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    return doc[:n] == doc[k - 1 : k - 1 + n]


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return h.view(np.int64)

