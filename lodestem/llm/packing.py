"""Best-fit packing of tokenised documents into fixed-length sequences.

The configuration linear program over the length histogram is solved by
multiplicative weights with knapsack dynamic programming as pricing until every
length is covered; its solution is rounded down, and what is left is packed best-fit decreasing, in bulk
over (length, free space) groups.  The driver sees the histogram (at most
``capacity`` rows) and returns a plan whose size follows from it, not from the
number of documents; items find their place in the plan by length and rank.

Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.  The
library itself encodes words outside ``SIMPLE`` and words that hold one of its
special tokens' strings, which it turns into their ids; the merges of all other
words run on tiktoken's routine, over tokens that the library confirms one by one
(``Merges`` has the argument, tests compare thousands of random words).
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import parts_of, staged, text_chunks

CAPACITY = 4096
END_ID = 1
#: How fast a covered length loses price.
STEEPNESS = 1.5
#: A configuration is taken while its value is within this part of the best one.
SLACK = 0.02
#: Words whose ids a worker keeps (two generations of half of that).
CACHE_WORDS = 300_000


# ------------------------------------------------------------- tokenising
#: Words of these characters only are split here as the tokenizer splits them
#: after normalising; others go through the whole tokenizer, one by one.
SIMPLE = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
# Fixed value: the tokenizer's own splitting pattern, for lower-case SIMPLE words.
UNITS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^0-9a-z\u00df-\u00f6\u00f8-\u00ff]+")

#: ASCII marks: a row of them after letters is one unit.
MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())


def byte_letters() -> dict[int, int]:
    """Byte-level spelling: printable bytes stand for themselves, the others for
    code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = {}, 256
    for b in range(256):
        out[b] = b if b in plain else extra
        extra += b not in plain
    return out


class Merges:
    """The tokenizer's merges on tiktoken's merging routine, several times as
    fast on a unit, with the same ids.

    That routine joins any neighbours whose union has a rank; the tokenizer joins
    listed pairs.  They part only where two pieces that are no listed pair make
    up a token; inside that token's own spelling the tokenizer would then be
    stuck at the same two pieces.  So on the tokens that the tokenizers library
    itself spells as one token, and it can make no others, both agree.  Each is
    tried here.  A byte that UTF-8 never has marks the end of a word.
    """

    END = b"\xff"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        as_byte = {chr(c): b for b, c in byte_letters().items()}
        ended, open_ = BPE(vocab=vocab, merges=pairs, end_of_word_suffix=suffix), BPE(vocab=vocab, merges=pairs)
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + self.END: 256 + b for b in range(256)}
        ids = np.zeros(512 + len(pairs), np.uint32)
        for c, b in as_byte.items():
            ids[b], ids[256 + b] = vocab[c], vocab[c + suffix]
        for k, (x, y) in enumerate(pairs):
            token = x + y
            last = token.endswith(suffix)
            bare = token.removesuffix(suffix)
            got = (ended if last else open_).tokenize(bare)
            if len(got) == 1 and got[0].id == vocab[token]:
                ranks[bytes(as_byte[c] for c in bare) + (self.END if last else b"")] = 512 + k
                ids[512 + k] = vocab[token]
        self.ids = [int(i).to_bytes(4, "little") for i in ids]
        self.core = tiktoken.Encoding("merges", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe  # noqa: SLF001

    def unit(self, raw: bytes) -> bytes:
        ids = self.ids
        return b"".join([ids[i] for i in self.core.encode_single_piece(raw + self.END)])


class WordIds(dict):
    """Ids of words as the tokenizers library gives them (little-endian unsigned
    32-bit), kept for words that come again.

    The tokenizer never joins text across ASCII white space: it splits its input
    there, and into units of letters, digits and marks, before its merges.  So a
    text's ids are those of its words, and a word's those of its units.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.merges = Merges(path)
        self.ends: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        got = self.old.get(word)
        if got is None:
            unit, head = self.merges.unit, word.rstrip(MARKS)
            if head.isalpha():  # ASCII letters, and perhaps a unit of marks
                end = word[len(head) :]
                if end not in self.ends:
                    self.ends[end] = unit(end)
                got = unit(head.lower()) + self.ends[end]
                if len(self.ends) > 10_000:
                    self.ends = {b"": b""}
            else:
                text = word.decode("utf-8")
                if (text.isascii() or SIMPLE.fullmatch(text)) and not self.special.search(text):
                    got = b"".join([unit(u.encode()) for u in UNITS.findall(text.lower())])
                else:
                    got = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = got
        return got

    def of_texts(self, texts: list[list[bytes]]) -> list[bytes]:
        """Ids of each text, given as words."""
        out = [b"".join(map(self.__getitem__, words)) for words in texts]
        if len(self) > CACHE_WORDS // 2:
            self.old = dict(self)
            self.clear()
        return out


_word_ids: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and ``ids``, little-endian bytes).

    A document is its ids and then ``end_id``; only one longer than
    ``capacity`` is cut.  A null or empty text is ``end_id`` alone.  Repeated
    rows give repeated pieces.  Narrow; other columns are not read.
    """
    names = ["__id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        if tokenizer_path not in _word_ids:
            _word_ids[tokenizer_path] = WordIds(tokenizer_path)
        coder = _word_ids[tokenizer_path]
        for batch in batches:
            row, piece, start, length, crc, raw = [], [], [], [], [], []
            for lo, hi, data, offs in text_chunks(batch.column(1)):
                body = data.tobytes()
                for k, ids in enumerate(coder.of_texts([body[offs[i] : offs[i + 1]].split() for i in range(hi - lo)])):
                    ids += tail
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        row.append(lo + k)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            raw.append(part)
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * keep_ids, names=names)

    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = src.schema["__id"].dataType.simpleString()
    ddl = f"__id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return src.mapInArrow(run, ddl).withColumnRenamed("__id", id_col)


# --------------------------------------------------------------- planning
@dataclass
class Plan:
    """Runs of items: the items of ``length`` with ranks from ``rank`` on go to
    ``count`` sequences from ``first`` on, one each, at ``offset``."""

    length: list[int]
    rank: list[int]
    count: list[int]
    first: list[int]
    offset: list[int]
    sequences: int = 0
    #: Sequences of the fractional program, and tokens placed by its whole part.
    program: float = 0.0
    placed: int = 0

    def add(self, length: int, rank: int, count: int, first: int, offset: int) -> None:
        self.length.append(length)
        self.rank.append(rank)
        self.count.append(count)
        self.first.append(first)
        self.offset.append(offset)


def price(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Knapsack by dynamic programming: the most valuable filling of each space,
    and the index of its first size (-1: the filling of one less).  Equal values
    go to the larger size: what is small still fits elsewhere later."""
    best = np.zeros(capacity + 1)
    took = [-1] * (capacity + 1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    back, worth = sizes[::-1].copy(), value[::-1].copy()
    n = len(sizes)
    for c in range(1, capacity + 1):
        m = upto[c]
        if m:
            got = best[c - back[n - m :]] + worth[n - m :]
            k = int(got.argmax())
            if got[k] > best[c - 1]:
                best[c], took[c] = got[k], m - 1 - k
                continue
        best[c] = best[c - 1]
    return best, took


def filling(took: list[int], sizes: list[int], space: int) -> list[int]:
    """Indices of the sizes (with repeats) of the filling of ``space``."""
    out = []
    while space > 0:
        k = took[space]
        if k < 0:
            space -= 1
        else:
            out.append(k)
            space -= sizes[k]
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int | None = None) -> list[tuple[float, list[int]]]:
    """A fractional solution of the configuration program by multiplicative
    weights: a length's price falls exponentially with the part of its demand
    that is covered, and is nothing once all of it is.

    A round prices once and then takes, largest length first, the best filling
    around each open length, as long as prices have left it within ``SLACK`` of
    the best one.  Each round covers one length at least, and rounds go on until
    all demand is covered (or for ``rounds``).
    """
    covered, out, done = np.zeros(len(sizes)), [], 0
    while (rounds is None or done < rounds) and len(open_ := np.flatnonzero(covered < 1 - 1e-9)):
        done += 1
        own = sizes[open_].tolist()
        best, took = price(sizes[open_], sizes[open_] / capacity * np.exp(-STEEPNESS * covered[open_]), capacity)
        value = (sizes / capacity * np.exp(-STEEPNESS * covered)).tolist()
        least = (1 - SLACK) * best[capacity]
        for k in (-1, *range(len(open_) - 1, -1, -1)):
            if k >= 0 and value[open_[k]] + best[capacity - own[k]] < least:
                continue
            config = open_[filling(took, own, capacity) if k < 0 else [k, *filling(took, own, capacity - own[k])]].tolist()
            worth = [value[i] for i in config]
            if k >= 0 and (sum(worth) < least or not min(worth)):
                continue
            counts = Counter(config)
            step = min(float(demand[i] * (1 - covered[i]) / n) for i, n in counts.items())
            for i, n in counts.items():
                covered[i] += step * n / demand[i]
                value[i] = 0.0 if covered[i] >= 1 - 1e-9 else float(sizes[i] / capacity * np.exp(-STEEPNESS * covered[i]))
            out.append((step, config))
    return out


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None) -> Plan:
    """Pack ``histogram`` (length: items; lengths in 1..capacity): by the program,
    its rest best-fit, or all best-fit where that takes fewer sequences, as with
    lengths that are mostly large."""
    plan = _planned(histogram, capacity, rounds)
    if plan.sequences > -(-sum(n * k for n, k in histogram.items()) // capacity):
        plain = _planned(histogram, capacity, 0)
        plan = plain if plain.sequences < plan.sequences else plan
    return plan


def _planned(histogram: dict[int, int], capacity: int, rounds: int | None) -> Plan:
    plan = Plan([], [], [], [], [])
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], np.float64)
    used = dict.fromkeys(histogram, 0)
    groups: dict[int, list[tuple[int, int]]] = {}  # free space: runs of sequences
    bins = 0
    solved: dict[tuple[int, ...], float] = {}
    for x, config in configurations(sizes, demand, capacity, rounds) if len(sizes) else []:
        key = tuple(sorted(config, reverse=True))
        solved[key] = solved.get(key, 0.0) + x
        plan.program += x
    for key, x in sorted(solved.items(), key=lambda kv: (-kv[1], kv[0])):
        lengths = [int(sizes[k]) for k in key]
        copies = {n: lengths.count(n) for n in set(lengths)}
        whole = min([int(x + 1e-9), *((histogram[n] - used[n]) // a for n, a in copies.items())])
        if whole <= 0:
            continue
        at = 0
        for n in lengths:
            plan.add(n, used[n], whole, bins, at)
            used[n] += whole
            at += n
        if at < capacity:
            groups.setdefault(capacity - at, []).append((bins, whole))
        bins += whole
        plan.placed += whole * at

    free = sorted(groups)

    def put(space: int, run: tuple[int, int]) -> None:
        if space > 0:
            if space not in groups:
                groups[space] = []
                bisect.insort(free, space)
            groups[space].append(run)

    for n in sorted(histogram, reverse=True):
        rank, left = used[n], histogram[n] - used[n]
        while left:
            k = bisect.bisect_left(free, n)
            if k == len(free):
                per = capacity // n
                new = left // per or 1
                fill = min(per, left)
                for j in range(fill):
                    plan.add(n, rank + j * new, new, bins, j * n)
                rank, left = rank + fill * new, left - fill * new
                put(capacity - fill * n, (bins, new))
                bins += new
                continue
            space = free[k]
            first, count = groups[space].pop()
            take = min(left, count)
            plan.add(n, rank, take, first, capacity - space)
            rank, left = rank + take, left - take
            if count > take:
                groups[space].append((first + take, count - take))
            if not groups[space]:
                del groups[space]
                free.pop(bisect.bisect_left(free, space))
            put(space - n, (first, take))
    plan.sequences = bins
    return plan


# ---------------------------------------------------------------- placing
def pack(items: DataFrame, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """Append ``sequence_id`` and ``offset`` to items of known length.

    Every length must lie in 1..capacity.  Items of equal length are ranked in
    hashed buckets, whose offsets come from a table of counts, so that no length
    gathers in one task however common it is.  Equal items take any order among
    themselves.  No items give no rows.
    """
    spark = items.sparkSession
    items = staged(items, "items")
    plan = plan_packing({int(r[0]): int(r[1]) for r in items.groupBy(length_col).count().collect()}, capacity)
    buckets = 2 * parts_of(spark)
    keyed = items.withColumn("__b", F.pmod(F.xxhash64(*order_cols), F.lit(buckets)).cast("int"))
    counts = staged(keyed.groupBy(length_col, "__b").agg(F.count("*").alias("__n")), "counts")
    before = W.partitionBy(length_col).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    base = staged(counts.select(F.col(length_col).alias("__l"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")), "bases")
    ranked = keyed.withColumn("__r", F.row_number().over(W.partitionBy(length_col, "__b").orderBy(*order_cols)))
    ranked = ranked.join(base, (F.col(length_col) == F.col("__l")) & (F.col("__b") == F.col("__c")))
    ranked = ranked.withColumn("__rank", F.col("__base") + F.col("__r") - 1).drop("__b", "__c", "__l", "__base", "__r")

    lo = np.array(plan.length, np.int64) << 40 | np.array(plan.rank, np.int64)
    order = np.argsort(lo, kind="stable")
    table = spark.sparkContext.broadcast((lo[order], np.array(plan.first, np.int64)[order], np.array(plan.offset, np.int64)[order]))
    names = ranked.columns
    li, ri = names.index(length_col), names.index("__rank")

    def place(batches):
        keys, first, offset = table.value
        for batch in batches:
            k = batch.column(li).to_numpy().astype(np.int64) << 40 | batch.column(ri).to_numpy().astype(np.int64)
            at = np.searchsorted(keys, k, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [c for i, c in enumerate(batch.columns) if i != ri] + [pa.array(first[at] + (k - keys[at])), pa.array(offset[at])], names=[n for n in names if n != "__rank"] + ["sequence_id", "offset"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` (little-endian bytes) from packed pieces that kept
    their ids; a sequence holds at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
