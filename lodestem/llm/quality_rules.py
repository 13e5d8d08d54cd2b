"""Quality rules as learned decision lists, in DataFrame operations only.

Sequential covering over labelled document statistics: each rule is a
conjunction of thresholds, grown by information gain on one part of the labelled
rows, pruned on the other, and the ordered list becomes one conditional
expression.  All counting is Spark aggregation over a bounded, staged sample of
statistics; the driver sees one count per feature and threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, discard, fold_of, staged

#: Labelled rows that learning may read (all, if there are fewer).
SAMPLE_ROWS = 16_000
#: Candidate thresholds per feature.
CUTS = 24
MAX_RULES = 12
MAX_CONDITIONS = 3
#: A rule must be right this often on the rows that it was pruned on, and
#: cover so many of them.
LEAST_PRECISION = 0.9
LEAST_COVER = 5

# Fixed values of the base rules.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

BASE_STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that rules may test.
FEATURES = ("n_words", "mean_word", "symbol_ratio", "upper_ratio", "mark_ratio", "digit_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "words_per_line")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Append the base statistics and the features of every whole text.

    A null text has no words; every ratio of a text without words is 0.  A column
    of ``docs`` that has the name of a statistic gives way to it, others stay as
    they are, repeated rows too; no rows give no rows.  Windows are compared by
    64-bit hashes within one text.  One narrow pass; the sort of window hashes runs
    only for texts in which one repeats.
    """
    t = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    t = t.withColumn("__w", F.filter(F.split("__t", WORD_SPLIT, -1), lambda w: w != F.lit("")))
    t = t.withColumn("n_words", F.size("__w").cast("long"))
    t = t.withColumn("__lines", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(NOT_SPACE)))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("__w") - (WINDOW - 1))), lambda i: F.xxhash64(F.slice("__w", i, WINDOW)))
    t = t.withColumn("__h", F.when(F.col("n_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    t = t.withColumn("__repeats", F.size("__h") > F.size(F.array_distinct("__h")))
    placed = F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    t = t.withColumn("__s", F.when(F.col("__repeats"), F.sort_array(placed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twin = lambda x, i: (
        F.coalesce(F.get("__s", i + 1)["h"] == x["h"], F.lit(False)) | ((i > 0) & F.coalesce(F.get("__s", i - 1)["h"] == x["h"], F.lit(False)))
    )
    t = t.withColumn("__at", F.sort_array(F.transform(F.filter("__s", twin), lambda x: x["i"])))
    # each repeated window covers its words up to the next repeated window
    covered = F.transform("__at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", i + 1) - p, F.lit(WINDOW))))
    t = t.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    t = t.withColumns(
        {
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.regexp_count("__t", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__upper": F.regexp_count("__t", F.lit("[A-Z]{2,}[^a-z]")).cast("long"),
            "__marks": F.regexp_count("__t", F.lit("[!?;:_=~^@]")).cast("long"),
            "__digits": F.regexp_count("__t", F.lit("[0-9]")).cast("long"),
            "__n_lines": F.size("__lines").cast("long"),
            "__n_distinct": F.size(F.array_distinct("__w")).cast("long"),
        }
    )
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    t = t.withColumns(
        {
            "mean_word": per("word_chars", "n_words"),
            "symbol_ratio": per("n_symbols", "word_chars"),
            "upper_ratio": per("__upper", "n_words"),
            "mark_ratio": per("__marks", "word_chars"),
            "digit_ratio": per("__digits", "word_chars"),
            "dup_line_ratio": per("n_dup_lines", "__n_lines"),
            "repeat_ratio": per("n_repeat_words", "n_words"),
            "distinct_ratio": per("__n_distinct", "n_words"),
            "words_per_line": per("n_words", "__n_lines"),
        }
    )
    # a generator of one row: filters on the statistics stay above it instead of
    # being copied, with all they compute, below every step of this chain
    stats = F.inline(F.array(F.struct(*BASE_STATISTICS, *[f for f in FEATURES if f not in BASE_STATISTICS])))
    taken = {c.lower() for c in (*BASE_STATISTICS, *FEATURES)}
    return t.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns if c.lower() not in taken], stats)


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules for the poor class; whoever matches none is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()
    precision: tuple[float, ...] = field(default=())

    def verdict(self) -> Column:
        """Keep (true) unless a rule fires, as one conditional expression."""
        out: Column | None = None
        for rule in self.rules:
            fires = _all(rule)
            out = F.when(fires, F.lit(False)) if out is None else out.when(fires, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _all(rule: tuple[Condition, ...]) -> Column:
    c = F.lit(True)
    for x in rule:
        c = c & x.column()
    return c


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gained by narrowing (p0, n0) to (p, n), weighted by p."""
    if p <= 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn(labelled: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int | None = SAMPLE_ROWS) -> DecisionList:
    """Learn the list from rows with a 0/1 label (0: poor; null rows and rows
    without an id are left out), from at most ``sample_rows`` ids of them (None:
    all; the caller has bounded them).  Without rows of both classes the list is
    empty and keeps all."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("__text_in"), (F.col(label_col) == 0).alias("poor"))
    if sample_rows is not None:
        # drawn from ids alone: no text moves before it is chosen
        picked = staged(bounded_sample(rows.select("id").distinct(), "id", sample_rows), "picked")
        rows = rows.join(F.broadcast(picked), "id", "left_semi")
    sample = statistics(rows.repartition(F.xxhash64("id")), "__text_in")
    sample = sample.where(~base_failed()).select((F.abs(F.xxhash64("id")) % 3 < 2).alias("grow"), "poor", *FEATURES)
    sample = staged(sample, "rules")
    probs = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    # cuts between the values of poor rows and of all rows, so that rare traits have some
    quant = sample.agg(
        *[F.percentile_approx(F.col(f), probs, 2000).alias(f"a_{f}") for f in FEATURES], *[F.percentile_approx(F.when(F.col("poor"), F.col(f)), probs, 2000).alias(f"p_{f}") for f in FEATURES]
    ).first()
    cuts = {f: sorted({*(quant[f"a_{f}"] or ()), *(quant[f"p_{f}"] or ()), 0.0}) for f in FEATURES}
    if not any(quant[f"p_{f}"] for f in FEATURES):
        return DecisionList()
    bins = F.array(*[F.struct(F.lit(f).alias("f"), _bin(f, cuts[f]).alias("b")) for f in FEATURES])
    binned = staged(sample.withColumn("bins", bins), "bins")
    discard(sample)

    rules: list[tuple[Condition, ...]] = []
    precision: list[float] = []
    left = binned
    while len(rules) < MAX_RULES:
        grown = _grow(left.where("grow"), cuts)
        if not grown:
            break
        rule, right = _prune(left.where(~F.col("grow")), grown)
        if not rule:
            break
        rules.append(rule)
        precision.append(right)
        left = left.where(~_all(rule))
    discard(binned)
    return DecisionList(tuple(rules), tuple(precision))


def _bin(feature: str, cuts: list[float]) -> Column:
    """Number of cuts below the value."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(feature)))


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition, ...]:
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        at = rows.where(_all(tuple(rule)))
        table = at.select("poor", F.explode("bins").alias("x")).groupBy("x.f", "x.b").agg(F.count_if("poor").alias("p"), F.count_if(~F.col("poor")).alias("n")).collect()
        per: dict[str, dict[int, tuple[int, int]]] = {}
        for r in table:
            per.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
        if not per:
            break
        some = next(iter(per.values()))
        p0, n0 = sum(p for p, _ in some.values()), sum(n for _, n in some.values())
        if p0 < LEAST_COVER or n0 == 0:
            break
        best, best_gain = None, 1e-9
        for f in FEATURES:
            p = n = 0
            for k, cut in enumerate(cuts[f]):
                dp, dn = per.get(f, {}).get(k, (0, 0))
                p, n = p + dp, n + dn  # rows at or below this cut
                for cond, pp, nn in ((Condition(f, False, cut), p, n), (Condition(f, True, cut), p0 - p, n0 - n)):
                    if pp >= LEAST_COVER and (g := _gain(pp, nn, p0, n0)) > best_gain:
                        best, best_gain = cond, g
        if best is None:
            break
        rule.append(best)
    return tuple(rule)


def _prune(rows: DataFrame, rule: tuple[Condition, ...]) -> tuple[tuple[Condition, ...], float]:
    """The prefix of the rule that is best on rows it was not grown on."""
    aggs = []
    for k in range(1, len(rule) + 1):
        hit = _all(rule[:k])
        aggs += [F.count_if(hit & F.col("poor")).alias(f"p{k}"), F.count_if(hit & ~F.col("poor")).alias(f"n{k}")]
    got = rows.agg(*aggs).first()
    best, worth, right = (), 0.0, 0.0
    for k in range(1, len(rule) + 1):
        p, n = got[f"p{k}"], got[f"n{k}"]
        if p + n >= LEAST_COVER and p / (p + n) >= LEAST_PRECISION and p - n > worth:
            best, worth, right = rule[:k], p - n, p / (p + n)
    return best, right


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """Statistics of every row with ``base_failed`` and ``kept``; columns of
    ``docs`` with those names give way too."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("base_failed", "kept")]
    return statistics(docs.select(*rest), text_col).withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(rules.verdict()))


def learn_from_tables(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learn from the rows of the learning fold (``crc32(doc_id) mod 3`` not 1).
    The sample is drawn from the narrow label table first; its bounded list of
    ids is broadcast to the scan of the texts."""
    ids = labels.where((fold_of("doc_id", 3) != 1) & F.col("quality").isNotNull()).select("doc_id", "quality").dropDuplicates(["doc_id"])
    picked = F.broadcast(staged(bounded_sample(ids, "doc_id", sample_rows), "picked"))
    return learn(docs.select("doc_id", "text").join(picked, "doc_id"), sample_rows=None)


def keep_documents(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with the same columns, whatever their
    names.  Null and empty texts have too few words and go; rows that repeat
    another fare as it does."""
    held = judge(docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__text_in")), rules, "__text_in").where("kept")
    return held.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
