"""Exact substring dedup: passages of many words that an earlier document has.

Anchors (winnowed word runs) find where documents may share a window; passages
around shared anchors are dealt to shards by anchor, so that two documents with
a common window meet in one shard.  Each shard builds a compressed FM-index of
its distinct passages and streams them against it by backward search over the
wavelet matrix, reporting the intervals that match earlier documents for at
least a window.  Word runs outside an index are told apart by two independent
64-bit hashes; inside one, words are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, gram_hashes, ladder, parts_of, run_hashes, signed, split_by_ids, staged, text_chunks, word_hashes, word_layout
from .fm_index import repeated_windows
from .graph import runs

WINDOW = 50
#: Words of an anchor; every window has WINDOW - ANCHOR + 1 of them to choose from.
ANCHOR = 25
#: Passages per shard to aim at.
SHARD_PASSAGES = 2_500
#: Anchors with more distinct passages go window by window instead, so that one
#: frequent passage in ever new surroundings does not gather in a shard.
HOT_PASSAGES = 1_000
SEEDS = (0, 1)


def anchors(words: np.ndarray, woff: np.ndarray, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, anchor hash, first window, last window)`` for each run of
    windows of one text with the same anchor: the leftmost smallest word run."""
    none = np.zeros(0, np.int64)
    n = len(words) - window + 1
    if n <= 0:
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(words, k)
    at = np.arange(len(h))
    span, reach = 1, window - k + 1
    while 2 * span <= reach:
        a, b = at[:-span], at[span:]
        at = np.where(h[b] < h[a], b, a)
        span *= 2
    rest = reach - span
    if rest:
        a, b = at[:-rest], at[rest:]
        at = np.where(h[b] < h[a], b, a)
    at = at[:n]
    doc = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    inside = doc[:n] == doc[window - 1 :]
    start = np.ones(n, bool)
    start[1:] = (at[1:] != at[:-1]) | (doc[1:n] != doc[: n - 1]) | ~inside[:-1]
    first = np.flatnonzero(start & inside)
    stop = np.ones(n, bool)
    stop[:-1] = start[1:] | ~inside[1:]
    last = np.flatnonzero(stop & inside)
    d = doc[first]
    return d, h[at[first]], first - woff[d], last - woff[d]


def _anchor_rows(src: DataFrame, window: int, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, version = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for lo, _, data, offs in text_chunks(batch.column(2)):
                starts, ends, woff = word_layout(data, offs)
                d, h, s0, s1 = anchors(word_hashes(data, starts, ends), woff, window, k)
                if len(d):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(h)), pa.array(ids[lo + d]), pa.array(version[lo + d]), pa.array(s0.astype(np.int32)), pa.array(s1.astype(np.int32))], names=["h", "doc", "v", "s0", "s1"]
                    )

    return src.mapInArrow(run, "h long, doc long, v long, s0 int, s1 int")


_PASSAGE = pa.schema([("h", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("doc", pa.int64()), ("v", pa.int64()), ("s0", pa.int32()), ("s1", pa.int32()), ("passage", pa.binary())])


def _passage_rows(texts: DataFrame, window: int) -> DataFrame:
    """From ``(id, v, text, runs, twice)``: the passage under each shared anchor.
    A text whose id and words come again is read once a task."""

    def run(batches):
        read: set[tuple[int, int]] = set()
        for batch in batches:
            ids, version, twice = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4))
            cols: list[list] = [[] for _ in _PASSAGE]
            held = 0
            for i, (text, spans) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if twice[i]:
                    if (ids[i], version[i]) in read:
                        continue
                    read.add((ids[i], version[i]))
                raw = (text.as_py() or "").encode()
                data = np.frombuffer(raw, np.uint8)
                starts, ends, _ = word_layout(data, np.array([0, len(raw)]))
                lo, s1, h = (spans.values.field(k).to_numpy() for k in range(3))
                hi = s1 + window
                p1, p2 = (signed(run_hashes(ladder(w, int((hi - lo).max())), lo, hi)) for w in word_hashes(data, starts, ends, SEEDS))
                parts = [raw[x:y] for x, y in zip(starts[lo].tolist(), ends[hi - 1].tolist(), strict=True)]
                for c, v in zip(cols, (h, p1, p2, np.full(len(lo), ids[i], np.int64), np.full(len(lo), version[i], np.int64), lo, s1), strict=False):
                    c.append(v)
                cols[-1] += parts
                held += sum(map(len, parts))
                if held > 8 << 20:
                    yield _passages(cols)
                    cols, held = [[] for _ in _PASSAGE], 0
            if cols[0]:
                yield _passages(cols)

    return texts.mapInArrow(run, "h long, p1 long, p2 long, doc long, v long, s0 int, s1 int, passage binary")


def _passages(cols) -> pa.RecordBatch:
    flat = [np.concatenate(c) for c in cols[:-1]] + [cols[-1]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(flat, _PASSAGE, strict=True)], schema=_PASSAGE)


def word_ids(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Small numbers of words given by two hashes, equal only if both are."""
    _, at, ids = np.unique(first, return_index=True, return_inverse=True)
    if (second != second[at][ids]).any():  # different words share the first hash
        ids = np.unique(np.stack([first, second], 1), axis=0, return_inverse=True)[1].reshape(-1)
    return ids


def _search_shards(dealt: DataFrame, window: int) -> DataFrame:
    """``doc, v, lo, hi``: word intervals by each shard's FM-index."""

    def run(batches):
        for _, t in runs(batches):
            owner, version, s0 = (t.column(c).to_numpy() for c in ("doc", "v", "s0"))
            hashed, cuts = [], [np.zeros(1, np.int64)]
            for _, _, data, offs in text_chunks(t.column("passage")):
                starts, ends, woff = word_layout(data, offs)
                hashed.append(word_hashes(data, starts, ends, SEEDS))
                cuts.append(cuts[-1][-1] + woff[1:])
            words = word_ids(*np.concatenate(hashed, 1))
            got = repeated_windows(np.split(words, np.concatenate(cuts[1:])[:-1]), owner, window)
            if got:
                p, a, b = (np.array(x, np.int64) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(owner[p]), pa.array(version[p]), pa.array(s0[p] + a), pa.array(s0[p] + b + window)], names=["doc", "v", "lo", "hi"])

    return dealt.mapInArrow(run, "doc long, v long, lo long, hi long")


def _hot_windows(rows: DataFrame, window: int) -> DataFrame:
    """``w1, w2, doc, v, s`` of every window of the passages of hot anchors."""

    def run(batches):
        for batch in batches:
            doc, version, s0 = (batch.column(i).to_numpy() for i in range(3))
            for lo, hi, data, offs in text_chunks(batch.column(3)):
                starts, ends, woff = word_layout(data, offs)
                n = np.maximum(np.diff(woff) - window + 1, 0)
                owner = np.repeat(np.arange(hi - lo), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                k = woff[owner] + at
                w1, w2 = (pa.array(signed(gram_hashes(w, window)[k])) for w in word_hashes(data, starts, ends, SEEDS))
                yield pa.RecordBatch.from_arrays([w1, w2, pa.array(doc[lo + owner]), pa.array(version[lo + owner]), pa.array((s0[lo + owner] + at).astype(np.int64))], names=["w1", "w2", "doc", "v", "s"])

    return rows.select("doc", "v", "s0", "passage").mapInArrow(run, "w1 long, w2 long, doc long, v long, s long")


def _source(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """``id, v, text``: ``v`` names the text, as an id may come with several."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("v"), text.alias("text"), *more)


def repeated_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc, v, lo, hi``: word intervals (they may overlap) that cover exactly
    the words under windows that also start in a document with a smaller id;
    ``v`` is ``xxhash64`` of the text that they are of."""
    spark = docs.sparkSession
    k = max(1, window // 2)
    src = _source(docs, id_col, text_col)
    spots = staged(_anchor_rows(src.where("id is not null"), window, k), "anchors")
    shared = staged(spots.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select(F.col("h").alias("g")), "shared")
    near = staged(spots.join(shared, F.col("h") == F.col("g")).select("doc", "v", "h", "s0", "s1"), "spots")
    discard(spots, shared)
    runs_of = F.sort_array(F.collect_set(F.struct("s0", "s1", "h")))
    per_doc = staged(near.groupBy(F.col("doc"), F.col("v").alias("w")).agg(runs_of.alias("runs"), F.count("*").alias("n")).select("doc", "w", "runs", (F.col("n") > F.size("runs")).alias("twice")), "perdoc")
    some, _ = split_by_ids(src, per_doc.select("doc"), "id")
    texts = some.join(per_doc.hint("shuffle_hash"), (F.col("id") == F.col("doc")) & (F.col("v") == F.col("w"))).select("id", "v", "text", "runs", "twice")
    passages = staged(_passage_rows(texts, window), "passages")
    discard(near, per_doc)

    key = ["h", "p1", "p2"]
    classes = staged(passages.groupBy(*key).agg(F.min("doc").alias("q")), "classes")
    hot = staged(classes.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT_PASSAGES).select(F.col("h").alias("g")), "hot")
    named = classes.withColumnsRenamed({c: f"__{c}" for c in key})
    same = F.lit(True)
    for c in key:
        same = same & (F.col(c) == F.col(f"__{c}"))
    # whole passages that an earlier document has: copies of a class
    copies = passages.select(*key, "doc", "v", "s0", "s1").join(named, same).where("doc > q")
    copies = staged(copies.select("doc", "v", F.col("s0").cast("long").alias("lo"), (F.col("s1") + window).cast("long").alias("hi")), "copies")
    # one passage of each class goes to the index of its shard
    calm = named.join(hot, F.col("__h") == F.col("g"), "left_anti").hint("shuffle_hash")
    first = passages.join(calm, same & (F.col("doc") == F.col("q"))).select("h", "doc", "v", "s0", "passage")
    shards = max(1, -(-classes.count() // SHARD_PASSAGES))
    dealt = first.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")).select("shard", "doc", "v", "s0", "passage").repartition(parts_of(spark), "shard").sortWithinPartitions("shard")
    found = staged(_search_shards(dealt, window), "found")
    # the rest, window by window
    heated = named.join(hot, F.col("__h") == F.col("g"), "left_semi").hint("shuffle_hash")
    windows = staged(_hot_windows(passages.join(heated, same & (F.col("doc") == F.col("q"))), window), "windows")
    early = staged(windows.groupBy("w1", "w2").agg(F.min("doc").alias("q"), F.max("doc").alias("z")).where("q < z").select(F.col("w1").alias("v1"), F.col("w2").alias("v2"), "q"), "early")
    again = windows.join(early, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2"))).where("doc > q").select("doc", "v", F.col("s").alias("lo"), (F.col("s") + window).alias("hi"))
    out = staged(copies.unionByName(found).unionByName(again), "intervals")
    discard(passages, classes, copies, found, windows, early, hot)
    return out


def _spans(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``doc, w, spans``: the distinct intervals of each text."""
    found = repeated_intervals(docs, id_col, text_col, window)
    out = staged(found.groupBy("doc", F.col("v").alias("w")).agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    discard(found)
    return out


def _cut(raw: bytes, spans: list[dict] | None) -> tuple[int, int, bytes]:
    words = raw.split()
    if not spans:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        gone[s["lo"]] += 1
        gone[s["hi"]] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return len(words), int((~keep).sum()), b" ".join([words[i] for i in np.flatnonzero(keep)])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digests_only: bool = False) -> DataFrame:
    """``id, n_words, n_removed, kept`` (or ``kept_sha256``) for every row.

    Words are parted by ASCII white space and compared unchanged.  Every word
    under a window whose word sequence also starts in a document with a smaller
    id is removed; ``kept`` joins the others by single spaces.  A null text has
    no words.  Texts shorter than a window lose nothing, nor do rows without an
    id, which no other row is compared with.  Ids are integers.  Rows that repeat
    an id and its text fare alike; rows that repeat an id with another text are
    documents of their own, neither of which is earlier.  Other columns are not
    read.  No rows give no rows.
    """
    per_doc = _spans(docs, id_col, text_col, window)
    src = _source(docs, id_col, text_col, F.col(id_col).alias("__id"))
    kind = src.schema["__id"].dataType.simpleString()
    maybe, clean = split_by_ids(src, per_doc.select("doc"), "id")
    hit = maybe.join(per_doc.hint("shuffle_hash"), (F.col("id") == F.col("doc")) & (F.col("v") == F.col("w")), "left").select("__id", "text", "spans")
    clean = clean.select("__id", "text")

    def run(batches):
        for batch in batches:
            spans = batch.column(2) if batch.num_columns > 2 else None
            rows = [_cut((t.as_py() or "").encode(), spans[i].as_py() if spans is not None else None) for i, t in enumerate(batch.column(1))]
            n, gone = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())
            last = pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows]) if digests_only else pa.array([r[2].decode() for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), n, gone, last], names=["__id", "n_words", "n_removed", name])

    name = "kept_sha256" if digests_only else "kept"
    ddl = f"__id {kind}, n_words long, n_removed long, {name} string"
    return hit.mapInArrow(run, ddl).unionByName(clean.mapInArrow(run, ddl)).withColumnRenamed("__id", id_col)


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without their repeated passages, with the same columns.

    A text that loses nothing stays as it is, spaces included; a document that
    loses all its words goes.  Null and empty texts and rows without an id stay;
    repeated ids are as in ``dedup``.  Columns may have any names.
    """
    per_doc = _spans(docs, id_col, text_col, window)
    src = _source(docs, id_col, text_col, F.struct("*").alias("__row"))
    maybe, clean = split_by_ids(src, per_doc.select("doc"), "id")
    hit = maybe.join(per_doc.hint("shuffle_hash"), (F.col("id") == F.col("doc")) & (F.col("v") == F.col("w")), "left").select("__row", F.col("text").alias("__text"), "spans")
    clean = clean.select("__row", F.col("text").alias("__text"))

    def run(batches):
        for batch in batches:
            out = []
            for t, s in zip(batch.column(1), batch.column(2), strict=True):
                text, spans = t.as_py(), s.as_py()
                kept = text if not spans else _cut((text or "").encode(), spans)[2].decode()
                out.append((kept, bool(spans) and not kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.bool_())], names=["__row", "__text", "__gone"])

    row = hit.schema["__row"].dataType.simpleString()
    cut = hit.mapInArrow(run, f"__row {row}, __text string, __gone boolean").where("not __gone").drop("__gone")
    out = cut.unionByName(clean)
    return out.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
