"""Secret scanning over an incremental blob ledger, in DataFrame operations only.

Every version of a text is addressed by its content (SHA-256).  One path stands
for each distinct blob; a blob is scanned only under rule versions that the
ledger does not hold yet; findings are joined back to every path of the blob.
Texts are scanned where they are read, as long as a bitmap can say which.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, parts_of, split_by_ids, staged

#: Stands for a secret in redacted text.
MASK_TEXT = "[secret]"
#: Bits of the bitmap of paths to scan.  It is used up to an eighth of its bits,
#: so that few others are scanned again; beyond, paths are joined exactly.
BITMAP_BITS = 26


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``group`` of a match must have ``least`` characters;
    a match that fails is dropped after it has used up its characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, then those that this scanner adds.  A run of one
# character class with a least length matches the same spans as the open run
# with the short matches dropped, as both take a run whole from its start.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
RULES = (
    *BASE_RULES,
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)


@dataclass(frozen=True)
class Scan:
    """``paths(id, blob, path)``; ``findings(blob, kind, ord, version, start,
    end)`` of all rule versions; ``entries(blob, rule)``: the pairs scanned now,
    to be appended to the ledger with the new findings."""

    paths: DataFrame
    findings: DataFrame
    entries: DataFrame


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _pieces(rule: Rule, ordinal: int) -> Column:
    """``array<struct>`` of all matches of one rule: the number of characters
    between it and the match before, its length, and whether it counts.  The
    second and third pass of the regex run only over texts with a match."""
    m, pat = F.col(f"__m{ordinal}"), F.lit(rule.pattern)
    lead = F.transform(F.split(F.col("__text"), rule.pattern, -1), F.length)
    held = F.transform(F.regexp_extract_all("__text", pat, F.lit(rule.group)), F.length) if rule.group else F.transform(m, F.length)
    both = F.arrays_zip(F.slice(lead, 1, F.size(m)).alias("lead"), F.transform(m, F.length).alias("len"), held.alias("held"))
    named = F.transform(
        both,
        lambda x, i: F.struct(
            F.lit(ordinal).alias("ord"), i.alias("idx"), x["lead"].cast("long").alias("lead"), x["len"].cast("long").alias("len"), (x["held"] >= rule.least).alias("ok")
        ),
    )
    return F.when(F.size(m) > 0, named).otherwise(F.array().cast("array<struct<ord:int,idx:int,lead:bigint,len:bigint,ok:boolean>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, known: DataFrame | None = None, paths: DataFrame | None = None) -> Scan:
    """Scan the unseen pairs of blob and rule version.

    ``ledger(blob, rule)`` holds the pairs scanned before and ``known`` their
    findings; ``paths`` may come from an earlier scan of the same rows.  A null
    text is the empty blob.  Ids may repeat, with the same or another text, and
    may be null; further columns are not read.  Leftmost non-overlapping matches
    per rule; positions in code points, end exclusive.  A table without rows
    gives empty tables.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), _text(text_col).alias("__text")).withColumn("path", F.xxhash64("id", "__text"))
    if paths is None:
        paths = staged(texts.select("id", F.sha2("__text", 256).alias("blob"), "path"), "paths")
    first = paths.groupBy("blob").agg(F.min("path").alias("path"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        first = first.join(seen, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))).drop("seen")
        first = first.where(F.size("todo") > 0)
    else:
        first = first.withColumn("todo", keys)
    first = staged(first, "unseen")

    marked = _marked(texts, first, rules)
    matched = marked.select("__text", *[F.when(F.col(f"__do{i}"), F.regexp_extract_all("__text", F.lit(r.pattern), F.lit(0))).alias(f"__m{i}") for i, r in enumerate(rules)])
    found_any = F.lit(False)
    for i in range(len(rules)):
        found_any = found_any | (F.coalesce(F.size(f"__m{i}"), F.lit(0)) > 0)
    hits = matched.where(found_any).select(F.sha2("__text", 256).alias("blob"), F.explode(F.concat(*[_pieces(r, i) for i, r in enumerate(rules)])).alias("hit")).select("blob", "hit.*")
    # rows that the bitmap let through have hits of pairs that were not asked for
    key = F.element_at(keys, F.col("ord") + 1)
    hits = hits.join(first.select("blob", "todo"), "blob").where(F.array_contains("todo", key)).drop("todo")
    # a path that is listed twice has been scanned twice: its hits are equal
    hits = hits.dropDuplicates(["blob", "ord", "idx"]).repartition(parts_of(spark), "blob", "ord")
    upto = W.partitionBy("blob", "ord").orderBy("idx")
    before = F.coalesce(F.sum("len").over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = F.sum("lead").over(upto.rowsBetween(W.unboundedPreceding, 0)) + before
    names = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("ord") + 1)
    versions = F.element_at(F.array(*[F.lit(r.version) for r in rules]), F.col("ord") + 1)
    found = hits.select("blob", names.alias("kind"), "ord", versions.alias("version"), start.alias("start"), (start + F.col("len")).alias("end"), "ok").where("ok").drop("ok")
    found = staged(found, "findings")
    if known is not None:
        found = found.unionByName(known.select(found.columns))
    entries = first.select("blob", F.explode("todo").alias("rule"))
    return Scan(paths, found, entries)


def _marked(texts: DataFrame, first: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The rows of ``texts`` that may be a path to scan, with a column for each
    rule that says whether to scan it: in place by a broadcast bitmap of bounded
    size, or, with more paths than that can tell apart, by a join."""
    asked = [F.array_contains("todo", r.key) for r in rules]
    if first.count() << 3 > 1 << BITMAP_BITS:
        todo = first.select(F.col("path").alias("__path"), "todo").hint("shuffle_hash")
        return texts.join(todo, F.col("path") == F.col("__path")).select("__text", *[c.alias(f"__do{i}") for i, c in enumerate(asked)])
    slot = F.pmod("path", F.lit(1 << BITMAP_BITS))
    bit = F.expr("shiftleft(1L, cast(__slot & 63 as int))")
    words = first.withColumn("__slot", slot).groupBy(F.shiftright("__slot", 6).alias("__word")).agg(*[F.coalesce(F.bit_or(F.when(c, bit)), F.lit(0).cast("long")).alias(f"__bits{i}") for i, c in enumerate(asked)])
    words = F.broadcast(staged(words, "bitmap"))
    joined_rows = texts.withColumn("__slot", slot).join(words, F.shiftright("__slot", 6) == F.col("__word"))
    does = [F.expr(f"(shiftrightunsigned(__bits{i}, cast(__slot & 63 as int)) & 1L) = 1") for i in range(len(rules))]
    return joined_rows.select("__text", *[c.alias(f"__do{i}") for i, c in enumerate(does)])


def scan_by_version(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: tuple[tuple[Rule, ...], ...] = (BASE_RULES, RULES)) -> Scan:
    """Scan in rounds, as rules come to be known: each round's ledger spares the
    next one every pair of blob and rule version that was scanned."""
    done: Scan | None = None
    ledger: DataFrame | None = None
    for rules in rounds:
        done = scan(docs, id_col, text_col, rules, ledger, done and done.findings, done and done.paths)
        ledger = done.entries if ledger is None else ledger.unionByName(done.entries)
    return done


def spans_by_blob(findings: DataFrame) -> DataFrame:
    """One row per blob with findings: its spans by start, then by rule."""
    span = F.struct("start", "ord", "kind", "end")
    return findings.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_path(scanned: Scan) -> DataFrame:
    """``id, spans`` for every path; blobs without findings have none."""
    spans = staged(spans_by_blob(scanned.findings), "spans")
    none = F.array().cast(spans.schema["spans"].dataType)
    return scanned.paths.join(spans, "blob", "left").select("id", "blob", F.coalesce("spans", none).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced; overlapping spans are replaced once."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(
            s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(MASK_TEXT)).alias("out"))
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, rest)).otherwise(text)


def digest(paths: DataFrame) -> DataFrame:
    """Counts and digests of the base kinds, and all spans, per path."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return paths.select(F.col("id").alias("doc_id"), *[n(r.kind) for r in BASE_RULES], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every secret masked, with the same columns, whatever
    their names.  Texts without findings, null and empty ones among them, stay as
    they are; repeated rows stay repeated."""
    scanned = scan(docs, id_col, text_col, rules)
    spans = staged(spans_by_blob(scanned.findings), "spans")
    held = staged(scanned.paths.join(spans.select("blob"), "blob", "left_semi").select("id"), "held")
    maybe, clean = split_by_ids(docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")), held, "__id")
    maybe = maybe.withColumn("__blob", F.sha2(F.coalesce("__text", F.lit("")), 256)).join(spans, F.col("__blob") == F.col("blob"), "left")
    masked = maybe.select("__row", F.when(F.col("spans").isNotNull(), redacted(F.col("__text"), F.col("spans"))).otherwise(F.col("__text")).alias("__text"))
    discard(scanned.paths, scanned.findings)
    out = masked.unionByName(clean.select("__row", "__text"))
    return out.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
