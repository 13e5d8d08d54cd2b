"""Toxicity behind a noisy channel: suspicious character runs (leetspeak,
spacing, repetition) become lattices that Viterbi decodes under a character
trigram model; the restored text is scored with a lexicon learned from labels."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bounded_sample, discard, fold_of, gram_hashes, inside, mix64, powers, staged, text_chunks, word_hashes, word_layout

#: Labelled rows that the lexicon may be learned from (all, if there are fewer).
SAMPLE_ROWS = 20_000
#: A term enters the lexicon with so many toxic documents and, after shrinking
#: to the base rate by PRIOR documents, this share of toxic ones.
LEAST_DOCS = 6
#: Each round of learning looks at the toxic documents that no term explains yet.
#: Words that merely stand beside a toxic one, in copies of a document say, are
#: thus left out.  Learning ends when a round finds no term.
ROUNDS = 8
#: The share of toxic documents among those with a term must be so unlikely at
#: the base rate that by chance any of the terms tried would get there this often.
CHANCE = 0.01
LEAST_SHARE = 0.85
PRIOR = 1.0
#: Shingle orders by which near copies in the sample are known.
COPY_KEYS = 8
#: Upper bound of the lexicon, by evidence.
MOST_TERMS = 20_000
#: Letter-run prefixes (bytes, whole letters) that count as terms besides whole
#: runs: stems of a language in which toxic words have many endings.
PREFIXES = (4, 5, 6, 7, 8)
#: Bytes of a run whose reading a worker keeps; longer ones are decoded anew.
CACHED_BYTES = 256
#: Weight of the lexicon's spelling in the character model.
LEXICON_WEIGHT = 0.5

# What a written character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
SEPARATORS = ".-_*~'`,:/"
# Costs (negative log probability) of the channel's arcs.
COST_LEET, COST_SAME_DIGIT, COST_DROP, COST_RUN, COST_PAIR = 1.0, 6.0, 0.7, 0.5, 1.0
#: White space inside a spaced run parts letters or words; several in a row part words.
COST_GAP, COST_WIDE = 0.7, 2.0

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_LEET_BYTE = np.zeros(256, bool)
_LEET_BYTE[[ord(c) for c in LEET if ord(c) < 128]] = True
_LEET_END = _LEET_BYTE.copy()
_LEET_END[[ord("!"), ord("|"), ord("("), ord("+")]] = False
_SEP_BYTE = np.zeros(256, bool)
_SEP_BYTE[[ord(c) for c in SEPARATORS]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

# ------------------------------------------------------- character model
#: Symbols: 0 ends and gaps, 1..26 letters, 27..58 Latin-1 letters, 59 others.
SYMBOLS = 60
_SYMBOL = np.full(0x110000, 59, dtype=np.int32)
_SYMBOL[: 0x80] = 0
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[0xE0:0x100] = _SYMBOL[0xC0:0xE0] = np.arange(27, 59)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``trigram, n`` over every whole text: sums of bounded vectors."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column(0)):
                if not len(data):
                    continue
                s = _SYMBOL[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
                s = np.concatenate([[0, 0], s, [0]])
                # a gap of several characters is one
                s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0)) | (np.arange(len(s)) < 2)]
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["trigram", "n"])

    return docs.select(F.col(text_col).cast("string").alias("t")).where("t is not null").mapInArrow(run, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


def character_model(counts: np.ndarray) -> np.ndarray:
    """``cost[a, b, c]`` of ``c`` after ``ab``: interpolated over the orders."""
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + SYMBOLS)
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    return (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)


def spelling_counts(terms: dict[str, float]) -> np.ndarray:
    out = np.zeros(SYMBOLS**3)
    for term, weight in terms.items():
        s = [0, 0, *(int(_SYMBOL[ord(c)]) for c in term), 0]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            out[(a * SYMBOLS + b) * SYMBOLS + c] += weight
    return out


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted hashes of lexicon terms with their toxic shares, the character
    costs, the share of toxic documents without a term, and the spellings of the
    terms that are whole runs and of those that are prefixes."""

    terms: np.ndarray
    share: np.ndarray
    cost: np.ndarray
    rest: float
    whole: frozenset[str] = frozenset()
    heads: frozenset[str] = frozenset()


# --------------------------------------------------------------- decoding
def decode(run: str, cost: np.ndarray) -> str:
    """Most probable plain text of a noisy run by Viterbi over its lattice.

    States are the last two emitted symbols; an arc reads one character (or one
    run of a repeated character) and emits letters, or reads a separator and
    emits nothing.  White space, which only spaced runs have, emits nothing or a
    word gap.  Runs may have any length: readings are kept as links to the state
    they came from.  Ties go to the reading found first.
    """
    run = run.lower()
    beam: dict[tuple[int, int], tuple[float, int]] = {(0, 0): (0.0, 0)}
    came, emitted = [0], [""]
    i = 0
    while i < len(run):
        c = run[i]
        j = i + 1
        while j < len(run) and run[j] == c:
            j += 1
        n = j - i
        arcs: list[tuple[str, float]] = []
        if c.isspace():
            readings = [("", COST_DROP + (COST_WIDE if n > 1 else 0.0))]
            arcs.append((" ", COST_GAP))
        elif c in LEET:
            readings = [(x, COST_LEET) for x in LEET[c]] + [("", COST_SAME_DIGIT if c.isdigit() else COST_DROP + 1)]
        elif c in SEPARATORS:
            readings = [("", COST_DROP)]
        else:
            readings = [(c, 0.0)]
        for x, k in readings:
            if not x:
                arcs.append(("", k))
            elif n == 1:
                arcs.append((x, k))
            else:
                arcs += [(x, k + COST_RUN * (1 if n > 2 else 2)), (x + x, k + (COST_PAIR if n > 2 else 0.0))]
        nxt: dict[tuple[int, int], tuple[float, int, str]] = {}
        for (a, b), (total, link) in beam.items():
            for x, k in arcs:
                u, v, t = a, b, total + k
                for ch in x:
                    s = int(_SYMBOL[ord(ch)])
                    t += cost[u, v, s]
                    u, v = v, s
                if (u, v) not in nxt or t < nxt[u, v][0]:
                    nxt[u, v] = (t, link, x)
        beam = {}
        for state, (t, link, x) in nxt.items():
            if x:
                came.append(link)
                emitted.append(x)
                link = len(came) - 1
            beam[state] = (t, link)
        i = j
    ends = [(t + cost[a, b, 0], link) for (a, b), (t, link) in beam.items()]
    least = min(t for t, _ in ends)

    def reading(link: int) -> str:
        out = []
        while link:
            out.append(emitted[link])
            link = came[link]
        return "".join(reversed(out))

    return min(reading(link) for t, link in ends if t == least)


def stem(run: str) -> tuple[str, list[int]]:
    """A lower-case run with every repeated letter once and without separators,
    and where a word of it may begin."""
    out: list[str] = []
    begins = [0]
    for c in run:
        if c in SEPARATORS or c.isspace():
            # a letter that the last one before the mark swallows begins there
            begins += [max(len(out) - 1, 0), len(out)]
        elif not out or c != out[-1]:
            out.append(c)
            if not c.isalpha():
                begins.append(len(out))
    # restored() tries every letter of a spaced run
    return "".join(out), list(range(len(out))) if any(map(str.isspace, run)) else begins


def may_hold_term(run: str, stems: dict[int, set[str]]) -> bool:
    """Can a reading of the run hold a term?  Without leetspeak the channel only
    drops separators and repeats, so a reading has the run's stem, and a word of
    it that begins with a term begins with the term's stem: no term is lost."""
    run = run.lower()
    if not LEET.keys().isdisjoint(run):
        return True
    text, begins = stem(run)
    return any(text[i : i + n] in known for i in begins for n, known in stems.items())


def stems_of(words: frozenset[str]) -> dict[int, set[str]]:
    out: dict[int, set[str]] = {}
    for w in words:
        x = stem(w.lower())[0]
        out.setdefault(len(x), set()).add(x)
    return out


def restored(raw: bytes, model: ToxicityModel) -> str:
    """The decoded run.  Every letter of a spaced run may begin a word, whatever
    the character model takes for the likeliest gaps: terms of at least
    ``min(PREFIXES)`` bytes are looked up at each, longest first, and a found one
    is parted from what stands before it (and, if it is a whole run, after it)."""
    out = decode(raw.decode("utf-8", "ignore"), model.cost)
    if not any(c in raw for c in SPACES):
        return out
    parts = out.split(" ")
    letters = "".join(parts)
    gaps = set(np.cumsum([len(x) for x in parts]).tolist())
    sizes = sorted({len(w) for w in model.whole | model.heads if len(w.encode()) >= min(PREFIXES)}, reverse=True)
    i = 0
    while i < len(letters):
        word = next((w for n in sizes if i + n <= len(letters) and ((w := letters[i : i + n]) in model.whole or w in model.heads and i + n < len(letters))), None)
        if word is None:
            i += 1
            continue
        j = i + len(word)
        gaps.difference_update(range(i + 1, j + 1))
        gaps.add(i)
        if word in model.whole:
            gaps.add(j)
        i = j
    cuts = sorted({0, *gaps, len(letters)})
    return " ".join(letters[a:b] for a, b in zip(cuts, cuts[1:], strict=False))


#: One character that is not white space, in UTF-8, and rows of at least four.
_ONE = rb"(?:[^\x20\x09-\x0D\x80-\xff]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})"
SPACED = re.compile(rb"(?<![^\x20\x09-\x0D.,;:])(?:" + _ONE + rb"[\x20\x09]+){3,}" + _ONE + rb"(?![^\x20\x09-\x0D.,;:!?])")


def suspicious(data: np.ndarray, offs: np.ndarray) -> list[tuple[int, bytes]]:
    """``(text, run)`` of the character runs to decode: words with leetspeak
    among letters, letters parted by a mark, or a letter twice in a row, and rows of
    single characters.  Found with byte masks over the whole chunk."""
    starts, ends, woff = word_layout(data, offs)
    if not len(starts):
        return []
    letter, plain = _LETTER[data], _ASCII_LETTER[data]
    nxt = np.append(letter[1:], False)
    prev = np.append(False, letter[:-1])
    mark = _LEET_BYTE[data] & nxt | _LEET_END[data] & prev
    part = _SEP_BYTE[data] & nxt & prev
    fold = _folded(data)
    twice = np.zeros(len(data), bool)
    twice[1:] = plain[1:] & (fold[1:] == fold[:-1])
    # letters of two bytes
    twice[3:] |= (data[3:] >= 0x80) & (data[3:] < 0xC0) & (fold[3:] == fold[1:-2]) & (data[2:-1] >= 0xC2) & (data[2:-1] < 0xE0) & (data[2:-1] == data[:-3])
    def per_word(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return c[ends] - c[starts]

    odd = (per_word(mark) > 0) & (per_word(letter) > 1) | (per_word(part) > 0) | (per_word(twice) > 0)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(woff))
    raw = data.tobytes()
    out = [(int(doc[k]), raw[starts[k] : ends[k]]) for k in np.flatnonzero(odd)]
    single = per_word((data & 0xC0) != 0x80) == 1
    lone = single[:-3] & single[1:-2] & single[2:-1] & single[3:] if len(single) > 3 else np.zeros(0, bool)
    for d in np.unique(doc[:-3][lone]) if len(lone) else ():
        out += [(int(d), m.group()) for m in SPACED.finditer(raw[offs[d] : offs[d + 1]])]
    return out


# ------------------------------------------------------------------ terms
def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters."""
    fold = _FOLD[data]
    if len(data) > 1:
        wide = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        fold[1:][wide] += 32
    return fold


def term_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Letter runs of a chunk: ``(text of each run, hashes of its prefixes and
    then of the whole run, starts, ends, folded bytes)``."""
    fold = _folded(data)
    solid = _LETTER[data]
    masked = np.where(solid, np.uint8(120), np.uint8(32))
    starts, ends, woff = word_layout(masked, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(woff))
    if not len(starts):
        return doc, [np.zeros(0, np.uint64)] * (len(PREFIXES) + 1), starts, ends, fold
    p = powers(max(PREFIXES) + 2)
    h = np.zeros(len(starts), np.uint64)
    heads, last = [], len(data) - 1
    for j in range(max(PREFIXES)):
        at = np.minimum(starts + j, last)
        h += np.where(starts + j < ends, (fold[at].astype(np.uint64) + np.uint64(1)) * p[j + 1], np.uint64(0))
        if j + 1 in PREFIXES:
            ends_letter = (fold[np.minimum(starts + j + 1, last)] & 0xC0) != 0x80
            heads.append(np.where((ends - starts > j + 1) & ends_letter, mix64(h + np.uint64(j + 1 << 40)), np.uint64(0)))
    spans = ends - starts
    body = np.where(solid, fold.astype(np.uint64) + np.uint64(1), np.uint64(0))
    pos = np.arange(len(data) - starts[0]) - np.repeat(starts - starts[0], np.diff(np.append(starts, len(data))))
    whole = np.add.reduceat(body[starts[0] :] * powers(int(pos.max()) + 2)[pos + 1], starts - starts[0])
    heads.append(mix64(whole + spans.astype(np.uint64)))
    return doc, heads, starts, ends, fold


def _copy_keys(batches):
    """Append the smallest shingle hashes of each text under COPY_KEYS orders:
    near copies mostly share one."""
    seeds = mix64(np.arange(1, COPY_KEYS + 1, dtype=np.uint64))
    for batch in batches:
        keys = np.zeros((batch.num_rows, COPY_KEYS), np.uint64)
        for lo, hi, data, offs in text_chunks(batch.column(1)):
            starts, ends, woff = word_layout(data, offs)
            ok = inside(woff, 5)
            if ok.any():
                doc = np.repeat(np.arange(hi - lo), np.diff(woff))[: len(ok)][ok]
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                grams = gram_hashes(word_hashes(data, starts, ends), 5)[ok]
                for k, seed in enumerate(seeds):
                    keys[lo + doc[first], k] = np.minimum.reduceat(mix64(grams ^ seed), first)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), COPY_KEYS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["y", "text", "keys"])


def _once(rows: DataFrame) -> DataFrame:
    """Of the bounded sample ``rows(y, text)``, one of near copies with a label;
    texts without a shingle are told apart by what they are."""
    keyed = rows.mapInArrow(_copy_keys, "y int, text string, keys array<long>")
    plain = F.array(F.xxhash64("text"))
    keyed = staged(keyed.select(F.monotonically_increasing_id().alias("n"), "y", "text", F.when(F.get("keys", F.lit(0)) == 0, plain).otherwise(F.col("keys")).alias("keys")), "keyed")
    each = keyed.select("n", "y", F.explode("keys").alias("key"))
    least = each.groupBy("y", "key").agg(F.min("n").alias("least"))
    later = each.join(least, ["y", "key"]).where("n > least").select("n").distinct()
    out = staged(keyed.join(later, "n", "left_anti").select("y", "text"), "sample")
    discard(keyed)
    return out


def _term_rows(batches, known: np.ndarray):
    """Counts of documents by distinct term, with its spelling; toxic ones with a
    known term are left out, and term 0 counts those that are not."""
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, _, data, offs in text_chunks(batch.column(1)):
            doc, heads, starts, ends, fold = term_hashes(data, offs)
            raw = fold.tobytes()
            hs, at = np.concatenate(heads), np.tile(np.arange(len(doc)), len(heads))
            size = np.concatenate([np.full(len(doc), n) for n in (*PREFIXES, 0)])
            use = hs != 0
            hs, at, size = hs[use], at[use], size[use]
            owner = doc[at]
            order = np.lexsort((hs, owner))
            hs, at, size, owner = hs[order], at[order], size[order], owner[order]
            new = np.ones(len(hs), bool)
            new[1:] = (hs[1:] != hs[:-1]) | (owner[1:] != owner[:-1])
            hs, at, size, owner = hs[new], at[new], size[new], owner[new]
            toxic = y[lo : lo + len(offs) - 1].astype(np.int64)
            explained = np.zeros(len(toxic), bool)
            explained[owner[np.isin(hs, known)]] = True
            explained &= toxic == 1
            left = int((toxic * ~explained).sum())
            if left:
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([None], pa.string()), pa.array([left]), pa.array([left])], names=["term", "spelling", "n", "toxic"])
            use = ~explained[owner]
            hs, at, size, toxic = hs[use], at[use], size[use], toxic[owner[use]]
            order = np.argsort(hs, kind="stable")
            hs, at, size, toxic = hs[order], at[order], size[order], toxic[order]
            first = np.flatnonzero(np.append(True, hs[1:] != hs[:-1])) if len(hs) else np.zeros(0, np.int64)
            if not len(first):
                continue
            n_toxic = np.add.reduceat(toxic, first)
            n = np.diff(np.append(first, len(hs)))
            keep = n_toxic > 0
            # terms of clean texts only matter where a toxic text has them too;
            # all are counted, but only toxic ones carry their spelling
            spell = [raw[starts[a] : min(ends[a], starts[a] + (s or 1 << 20))].decode("utf-8", "ignore") if k else None for a, s, k in zip(at[first], size[first], keep, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hs[first].view(np.int64)), pa.array(spell, pa.string()), pa.array(n.astype(np.int64)), pa.array(n_toxic.astype(np.int64))], names=["term", "spelling", "n", "toxic"]
            )


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """The character model comes from every text; the lexicon from a bounded
    sample of ``labels.toxic`` on the learning fold (``crc32(doc_id) mod 3``
    not 1).  The driver gets symbol counts and at most ``MOST_TERMS`` terms."""
    ids = labels.where((fold_of("doc_id", 3) != 1) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("y")).dropDuplicates(["doc_id"])
    picked = staged(bounded_sample(ids, "doc_id", sample_rows), "picked")
    size = picked.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    base = (size["t"] + 0.5) / (size["n"] + 1)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("y", "text")
    rows = _once(rows)
    lexicon: list = []
    for _ in range(ROUNDS):
        known = np.array([r["term"] for r in lexicon], np.int64).view(np.uint64)
        counted = rows.mapInArrow(lambda b, k=known: _term_rows(b, k), "term long, spelling string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.max("spelling").alias("spelling"))
        counted = staged(counted, "terms")
        left = counted.where("term = 0").agg(F.sum("n")).first()[0] or 0
        tried = counted.where("term <> 0").count()
        if left < LEAST_DOCS or not tried:
            discard(counted)
            break
        rate = (left + 0.5) / (left + size["n"] - size["t"] + 1)
        share = (F.col("toxic") + PRIOR * base) / (F.col("n") + PRIOR)
        evidence = F.col("toxic") * F.log(F.col("share") / rate) + (F.col("n") - F.col("toxic")) * F.log((1 - F.col("share")) / (1 - rate))
        good = counted.where((F.col("term") != 0) & (F.col("toxic") >= LEAST_DOCS)).withColumn("share", share)
        good = good.where((F.col("share") >= LEAST_SHARE) & (evidence >= math.log(tried / CHANCE)))
        found = good.orderBy(F.desc("toxic"), "term").limit(MOST_TERMS - len(lexicon)).collect()
        discard(counted)
        if not found:
            break
        lexicon += found
    discard(rows)
    lexicon.sort(key=lambda r: r["term"] & 0xFFFFFFFFFFFFFFFF)
    terms = np.array([r["term"] for r in lexicon], np.int64).view(np.uint64)
    counts = np.zeros(SYMBOLS**3)
    for r in trigram_counts(docs).collect():  # at most SYMBOLS**3 rows
        counts[r["trigram"]] = r["n"]
    spelled = {r["spelling"]: float(r["toxic"]) for r in lexicon if r["spelling"]}
    model = (1 - LEXICON_WEIGHT) * character_model(counts) + LEXICON_WEIGHT * character_model(spelling_counts(spelled))
    listed = [(r["spelling"], t) for r, t in zip(lexicon, terms, strict=True) if r["spelling"]]
    full = term_hashes(*_joined([w for w, _ in listed]))[1][-1] if listed else ()
    whole = frozenset(w for (w, t), h in zip(listed, full, strict=True) if h == t)
    heads = frozenset(w for (w, t), h in zip(listed, full, strict=True) if h != t)
    return ToxicityModel(terms, np.array([r["share"] for r in lexicon]), -np.log(model), float(min(base, 0.05)), whole, heads)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts, each with a space after it."""
    raw = [x.encode() for x in texts]
    return np.frombuffer(b" ".join(raw) + b" ", np.uint8), np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])])


def score_chunk(data: np.ndarray, offs: np.ndarray, model: ToxicityModel, restore) -> np.ndarray:
    """Noisy-or over the letter runs of each text, as written and as restored;
    a run counts with its surest term."""
    n = len(offs) - 1
    out = np.full(n, math.log1p(-model.rest))
    if not len(model.terms):
        return -np.expm1(out)

    def add(doc: np.ndarray, heads: list[np.ndarray], owners: np.ndarray) -> None:
        best = np.zeros(len(doc))
        for h in heads:
            at = np.minimum(np.searchsorted(model.terms, h), len(model.terms) - 1)
            best = np.maximum(best, np.where(model.terms[at] == h, model.share[at], 0.0))
        hit = np.flatnonzero(best)
        np.add.at(out, owners[doc[hit]], np.log1p(-np.minimum(best[hit], 0.9999)))

    doc, heads, *_ = term_hashes(data, offs)
    add(doc, heads, np.arange(n))
    noisy = suspicious(data, offs)
    if noisy:
        doc, heads, *_ = term_hashes(*_joined([restore(raw) for _, raw in noisy]))
        add(doc, heads, np.array([d for d, _ in noisy]))
    return -np.expm1(out)


def predict(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row from its whole text (null: empty), narrow.

    A text without letters has the score of one without terms; repeated rows
    give repeated rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        stems = stems_of(model.whole | model.heads)
        read = lambda raw: restored(raw, model) if may_hold_term(raw.decode("utf-8", "ignore"), stems) else ""
        kept = lru_cache(1 << 16)(read)
        restore = lambda raw: (kept if len(raw) <= CACHED_BYTES else read)(raw)
        for batch in batches:
            parts = [score_chunk(data, offs, model, restore) for _, _, data, offs in text_chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["__id", "score"])

    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = src.schema["__id"].dataType.simpleString()
    return src.mapInArrow(run, f"__id {kind}, score double").withColumnRenamed("__id", id_col)


def restored_text(text: str, model: ToxicityModel) -> str:
    """The text with every suspicious run replaced by its decoded reading."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    for _, run in suspicious(data, np.array([0, len(raw)])):
        raw = raw.replace(run, restored(run, model).encode())
    return raw.decode("utf-8", "ignore")
