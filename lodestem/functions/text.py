"""Text preprocessing: normalise, tokenise, stop words, lemmas, n-grams.

Two profiles share one shape.  The *full* profile (NFKC, Unicode words, stemmer)
runs in Arrow-batched Python, as Spark has no NFKC.  The *plain* profile (lower
case, ``[a-z0-9]+``) stays in built-in functions.  Both give an array of features
per row, with stop words as gaps that n-grams do not cross.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, replace
from functools import lru_cache, reduce
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadConfig, BadData
from . import stemmer

#: Stands for removed stop words until n-grams are made.
GAP = "\x00"
#: Joins the tokens of an n-gram.
JOINER = "\x1f"

# The English function words.
STOPWORDS = tuple(
    """a about above after again against all am an and any are aren as at be because been before being below between both
    but by can cannot could couldn did didn do does doesn doing don down during each few for from further had hadn has
    hasn have haven having he her here hers herself him himself his how i if in into is isn it its itself just me mightn
    more most mustn my myself no nor not now of off on once only or other ought our ours ourselves out over own same shan
    she should shouldn so some such than that the their theirs them themselves then there these they this those through
    to too under until up very was wasn we were weren what when where which while who whom why will with won would
    wouldn you your yours yourself yourselves""".split()
)
STOPWORDS_SHA256 = hashlib.sha256("\n".join(STOPWORDS).encode()).hexdigest()



@dataclass(frozen=True)
class StopwordSet:
    """An identified, immutable set of words."""

    words: frozenset[str]

    @classmethod
    def of(cls, words: Iterable[str]) -> StopwordSet:
        return cls(frozenset(words))

    def __contains__(self, word: str) -> bool:
        return word in self.words

    def digest(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.words)).encode()).hexdigest()


ENGLISH = StopwordSet.of(STOPWORDS)
NO_STOPWORDS = StopwordSet.of(())


def load_stopwords(path: str, manifest: str | None = None) -> StopwordSet:
    """A word list, one to a line, ``#`` comments; with a manifest of
    ``digest  file name`` lines, the file's SHA-256 must be listed there."""
    with open(path, "rb") as f:
        raw = f.read()
    if manifest is not None:
        with open(manifest, encoding="utf-8") as f:
            listed = {line.split()[-1].rsplit("/", 1)[-1]: line.split()[0] for line in f if line.strip() and not line.startswith("#")}
        name = path.rsplit("/", 1)[-1]
        if listed.get(name) != hashlib.sha256(raw).hexdigest():
            raise BadData(f"{name} is not the file that the manifest lists")
    lines = (line.split("#", 1)[0].strip() for line in raw.decode("utf-8").splitlines())
    return StopwordSet.of(w for w in lines if w)


CONTROL_CATEGORIES = frozenset({"Cc", "Cf", "Co", "Cs"})
WORD = re.compile(r"[^\W_]+")
ASCII_WORD = re.compile(r"[A-Za-z0-9]+")


@dataclass(frozen=True)
class PreprocessingConfig:
    """All options of the preprocessing map; its digest names the map."""

    unicode_form: str = "NFKC"
    lowercase: bool = True
    strip_control: bool = True
    collapse_whitespace: bool = True
    min_len: int = 1
    max_len: int = 64
    ascii_words: bool = False
    stopwords: tuple[str, ...] = STOPWORDS
    insert_gaps: bool = True
    lemmatiser: str = "porter2"
    n_min: int = 1
    n_max: int = 2
    cross_gaps: bool = False

    def __post_init__(self) -> None:
        if self.n_min < 1 or self.n_max < self.n_min:
            raise BadConfig(f"n-gram orders {self.n_min}..{self.n_max}")
        if self.min_len < 1 or self.max_len < self.min_len:
            raise BadConfig(f"token lengths {self.min_len}..{self.max_len}")
        if self.lemmatiser not in ("identity", "porter2", "lookup"):
            raise BadConfig(f"unknown lemmatiser {self.lemmatiser!r}")

    def with_(self, **changes) -> PreprocessingConfig:
        return replace(self, **changes)

    def to_dict(self) -> dict:
        return asdict(self) | {"stopwords": StopwordSet.of(self.stopwords).digest()}

    def digest(self, table: dict[str, str] | None = None) -> str:
        """Names the map; a lookup table is part of it."""
        return hashlib.sha256(json.dumps([self.to_dict(), sorted((table or {}).items())], sort_keys=True).encode()).hexdigest()


# ------------------------------------------------------------ one text
def normalising_passes(cfg: PreprocessingConfig = PreprocessingConfig()) -> tuple[Callable[[str], str], ...]:
    """The normal form as passes over the text, in order.  Lower case and the
    loss of control characters can each undo the compatibility form, so both are
    followed by the passes before them."""
    passes: tuple[Callable[[str], str], ...] = (lambda s: unicodedata.normalize(cfg.unicode_form, s),)
    if cfg.lowercase:
        passes += (str.lower, passes[0])
    if cfg.strip_control:
        passes += (without_controls, *passes)
    if cfg.collapse_whitespace:
        passes += (lambda s: " ".join(s.split()),)
    return passes


def without_controls(text: str) -> str:
    """White space stays, whatever its category."""
    lost = {c for c in set(text) if unicodedata.category(c) in CONTROL_CATEGORIES and not c.isspace()}
    return text.translate(dict.fromkeys(map(ord, lost))) if lost else text


def normalise(text: str, cfg: PreprocessingConfig = PreprocessingConfig()) -> str:
    """Compatibility form, lower case, no control characters, single spaces.
    Applying it again changes nothing."""
    return reduce(lambda s, one: one(s), normalising_passes(cfg), text)


def spans(text: str, cfg: PreprocessingConfig = PreprocessingConfig()) -> list[tuple[str, int, int]]:
    """Words with their offsets; words of other lengths vanish without a gap."""
    pattern = ASCII_WORD if cfg.ascii_words else WORD
    return [(m.group(), m.start(), m.end()) for m in pattern.finditer(text) if cfg.min_len <= m.end() - m.start() <= cfg.max_len]


def tokens_of(text: str, cfg: PreprocessingConfig = PreprocessingConfig()) -> list[str]:
    return [t for t, _, _ in spans(normalise(text, cfg), cfg)]


def gapped(tokens: Iterable[str], stop: frozenset[str], insert_gaps: bool = True) -> list[str]:
    """The stretches between stop words (and gaps that are there already), with
    one gap between two of them, or none if gaps are not wanted."""
    stretches = [list(run) for gone, run in groupby(tokens, lambda t: t == GAP or t in stop) if not gone]
    seam = [GAP] if insert_gaps else []
    return [t for i, run in enumerate(stretches) for t in (*(seam if i else ()), *run)]


def ngrams_of(tokens: list[str], n_min: int = 1, n_max: int = 2, cross_gaps: bool = False) -> list[str]:
    """All orders of each gap-free run in turn."""
    if n_min < 1 or n_max < n_min:
        raise BadConfig(f"n-gram orders {n_min}..{n_max}")
    runs: list[list[str]] = [[]]
    for t in tokens:
        if t != GAP:
            runs[-1].append(t)
        elif not cross_gaps:
            runs.append([])
    return [JOINER.join(run[i : i + n]) for run in runs for n in range(n_min, n_max + 1) for i in range(len(run) - n + 1)]


Lemmatiser = Callable[[str], str]


def lemmatiser_of(cfg: PreprocessingConfig, table: dict[str, str] | None = None, fallback: Lemmatiser | None = None) -> Lemmatiser:
    """The configured token map; ``lookup`` needs its table."""
    if cfg.lemmatiser == "identity":
        return lambda t: t
    if cfg.lemmatiser == "porter2":
        return stemmer.stem
    if table is None:
        raise BadConfig("the lookup lemmatiser needs a table")
    other = fallback or (lambda t: t)
    return lambda t: table.get(t, None) or other(t)


# ------------------------------------------------------------- columns
def preprocess(df: DataFrame, cfg: PreprocessingConfig = PreprocessingConfig(), text_col: str = "text", out: str = "features", table: dict[str, str] | None = None, intermediates: bool = False) -> DataFrame:
    """Append the feature array of the full profile (and with ``intermediates``
    ``raw_tokens`` and ``lemmas``).  A null text has no features.  Narrow."""
    lemma, stop = lemmatiser_of(cfg, table), frozenset(cfg.stopwords)

    def one(text: str | None) -> dict:
        raw = tokens_of(text or "", cfg)
        lemmas = [t if t == GAP else lemma(t) for t in gapped(raw, stop, cfg.insert_gaps)]
        return {"raw_tokens": raw, "lemmas": [t for t in lemmas if t != GAP], "features": ngrams_of(lemmas, cfg.n_min, cfg.n_max, cfg.cross_gaps)}

    @F.pandas_udf("raw_tokens array<string>, lemmas array<string>, features array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["raw_tokens", "lemmas", "features"])

    made = df.withColumn("__p", run(F.col(text_col)))
    if intermediates:
        made = made.withColumn("raw_tokens", F.col("__p.raw_tokens")).withColumn("lemmas", F.col("__p.lemmas"))
    return made.withColumn(out, F.col("__p.features")).drop("__p")


#: Words whose lemma a worker remembers, and rows of counts it sends at a time.
REMEMBERED = 1 << 18
SENT = 1 << 16


def counted(df: DataFrame, cfg: PreprocessingConfig = PreprocessingConfig(), text_col: str = "text", id_col: str = "doc_id", table: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, token, cnt`` of the full profile, a row per document and feature
    of rows that are dealt by id (those that repeat one are one document): one
    document's features are held at a time, and words are rarely stemmed twice."""
    stop = frozenset(cfg.stopwords)

    def run(batches):
        lemma = lru_cache(REMEMBERED)(lemmatiser_of(cfg, table))
        rows = ((i.as_py(), t.as_py()) for b in batches for i, t in zip(b.column(0), b.column(1), strict=True))
        ids, tokens, counts = [], [], []
        for doc, texts in groupby(rows, lambda r: r[0]):
            got = Counter()
            for _, text in texts:
                raw = tokens_of(text or "", cfg)
                got.update(ngrams_of([t if t == GAP else lemma(t) for t in gapped(raw, stop, cfg.insert_gaps)], cfg.n_min, cfg.n_max, cfg.cross_gaps))
            ids += [doc] * len(got)
            tokens += got.keys()
            counts += got.values()
            if len(ids) >= SENT:
                yield _counts(ids, tokens, counts)
                ids, tokens, counts = [], [], []
        yield _counts(ids, tokens, counts)

    rows = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).sortWithinPartitions("doc_id")
    return rows.mapInArrow(run, "doc_id string, token string, cnt long")


def _counts(ids: list, tokens: list, counts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "token", "cnt"])


def looked_up(df: DataFrame, table: DataFrame, tokens: str = "features", fallback: Column | None = None) -> DataFrame:
    """Every token replaced by its lemma in ``table(token, lemma)``, by a join;
    tokens without one go to ``fallback`` (a column over ``token``), or stay.
    Gaps stay; order is kept; a token that is listed twice has its first lemma."""
    key = [c for c in df.columns if c != tokens]
    once = table.groupBy("token").agg(F.min("lemma").alias("__lemma"))
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    each = rows.select("__row", F.posexplode(tokens).alias("__at", "token"))
    kept = F.when(F.col("token") == GAP, F.col("token")).otherwise(F.coalesce("__lemma", fallback if fallback is not None else F.col("token")))
    named = each.join(once, "token", "left").select("__row", F.struct("__at", kept.alias("t")).alias("e"))
    back = named.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["t"]).alias("__tokens"))
    out = rows.join(back, "__row", "left")
    return out.select(*key, F.coalesce("__tokens", F.array().cast("array<string>")).alias(tokens))


def normalised(text: Column, cfg: PreprocessingConfig = PreprocessingConfig()) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else normalise(t, cfg))

    return run(text)


def tokens_with_offsets(text: Column, cfg: PreprocessingConfig = PreprocessingConfig()) -> Column:
    @F.pandas_udf("array<struct<text:string,start:int,end:int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"text": a, "start": b, "end": c} for a, b, c in spans(t or "", cfg)])

    return run(text)


def plain_tokens(text: Column, min_len: int = 1, max_len: int = 64) -> Column:
    """Lower-case ASCII words of bounded length, by built-in functions only;
    words of other lengths vanish without a gap."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", -1), lambda w: F.length(w).between(max(min_len, 1), max_len))


def plain_ngram_rows(df: DataFrame, tokens: str, n: int, stop: tuple[str, ...] = STOPWORDS, out: str = "token") -> DataFrame:
    """The other columns of ``df`` and one row per n-gram of one order that
    holds no stop word: the array beside itself, shifted, is exploded once, and
    what follows is generated code."""
    count = F.size(tokens) - (n - 1)
    shifted = F.arrays_zip(*[F.when(count > 0, F.slice(tokens, i + 1, count)).otherwise(F.array().cast("array<string>")).alias(f"g{i}") for i in range(n)])
    rows = df.select(*[c for c in df.columns if c != tokens], F.explode(shifted).alias("__g"))
    for i in range(n):
        rows = rows.where(~F.col(f"__g.g{i}").isin(*stop) if stop else F.lit(True))
    return rows.select(*[c for c in df.columns if c != tokens], F.concat_ws(JOINER, *[F.col(f"__g.g{i}") for i in range(n)]).alias(out))


def stopped(tokens: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Stop words become gaps; runs of gaps collapse; none at the ends.  Linear:
    the tokens (which must not hold the separator) pass through one string."""
    words = F.array(*[F.lit(w) for w in stop])
    marked = F.transform(tokens, lambda t: F.when(F.array_contains(words, t), F.lit(GAP)).otherwise(t))
    line = F.regexp_replace(F.array_join(marked, "\x1e"), "\\x00(?:\\x1e\\x00)+", GAP)
    line = F.regexp_replace(line, "^\\x00(?:\\x1e|$)|\\x1e\\x00$", "")
    return F.filter(F.split(line, "\x1e", -1), lambda t: t != F.lit(""))


def plain_ngrams(tokens: Column, n: int) -> Column:
    """N-grams of one order of a gapped token array, in built-in functions: runs
    that hold a gap are left out.  The array is zipped with itself, shifted, so
    that no lambda refers to the whole of it."""
    grams = tokens
    for j in range(1, n):
        grams = F.zip_with(grams, F.slice(tokens, j + 1, 1 << 30), lambda a, b: F.concat(a, F.lit(JOINER), b))
    return F.filter(grams, lambda g: g.isNotNull() & ~g.contains(GAP))


def split_ngram(gram: Column) -> Column:
    return F.split(gram, JOINER)


def ngram_order(gram: Column) -> Column:
    return F.size(F.split(gram, JOINER))
