"""Corpora: JSON lines, Parquet tables, film-rating archives, synthetic text."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import BadConfig, BadData, EmptyCorpus

CORPUS_SCHEMA = "doc_id string, text string, popularity long, rating_sum2 long, rating_count long, engagement long"
INTERACTION_SCHEMA = "user_id string, doc_id string, weight double"


@dataclass(frozen=True)
class Dataset:
    name: str
    documents: DataFrame
    interactions: DataFrame | None = None

    def digest(self) -> str:
        return table_digest(self.documents)


def table_digest(df: DataFrame) -> str:
    """SHA-256 of a table's rows in any order: rows are hashed, then up to 4096
    buckets of hashes, so the driver's share is bounded."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    buckets = df.select(row.alias("h")).groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"))
    return hashlib.sha256("".join(r["d"] for r in buckets.orderBy("b").collect()).encode()).hexdigest()


# ------------------------------------------------------------- JSON lines
def read_jsonl(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_jsonl_corpus(spark: SparkSession, path: str) -> Dataset:
    """A corpus that has documents, each with an id and a text."""
    docs = read_jsonl(spark, path)
    if not docs.head(1):
        raise EmptyCorpus(path)
    if docs.where("doc_id IS NULL OR text IS NULL").head(1):
        raise BadData(f"{path}: every row needs doc_id and text")
    return Dataset(f"jsonl:{path}", docs)


def load_parquet_corpus(spark: SparkSession, path: str) -> Dataset:
    """``documents.parquet`` of a table folder."""
    d = spark.read.parquet(f"{path}/documents.parquet")
    return Dataset(f"parquet:{path}", d.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("n_chars").alias("popularity")))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_corpus(data: Dataset, path: str, spec: dict | None = None) -> dict:
    """Documents, interactions, the spec that made them, and a manifest of their
    digests, as JSON lines; returns the manifest's entries."""
    spark = data.documents.sparkSession
    parts = {"corpus": data.documents} | ({"interactions": data.interactions} if data.interactions is not None else {})
    digests = {}
    for name, df in parts.items():
        write_jsonl(df, f"{path}/{name}")
        digests[name] = table_digest(df)
    spec_text = json.dumps(spec or {}, sort_keys=True)
    digests["spec"] = hashlib.sha256(spec_text.encode()).hexdigest()
    for name, lines in (("spec", [spec_text]), ("MANIFEST", [f"{v}  {k}" for k, v in sorted(digests.items())])):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    return digests


def verify_corpus(spark: SparkSession, path: str) -> Dataset:
    """Read what ``write_corpus`` wrote; tables that the manifest does not list
    with their digest are errors."""
    listed = dict(reversed(r[0].split("  ")) for r in spark.read.text(f"{path}/MANIFEST").collect())
    docs = read_jsonl(spark, f"{path}/corpus")
    inter = read_jsonl(spark, f"{path}/interactions", INTERACTION_SCHEMA) if "interactions" in listed else None
    for name, df in (("corpus", docs), ("interactions", inter)):
        if df is not None and table_digest(df) != listed.get(name):
            raise BadData(f"{path}/{name} is not what the manifest lists")
    return Dataset(f"corpus:{path}", docs, inter)


# ------------------------------------------------------- rating archives
def doubled_rating(text: Column) -> Column:
    """``3.5`` becomes 7 exactly; what is no half raises."""
    twice = text.cast("decimal(6,3)") * 2
    return F.when(twice == F.floor(twice), twice.cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a multiple of one half: "), text)).cast("int"))


def parse_ratings(movies: DataFrame, ratings: DataFrame, tags: DataFrame, min_weight: float = 4.0) -> Dataset:
    """From the three tables (all columns text): documents of title, genres and
    tags, with the number of ratings, twice their sum and their count, and the
    number of tags; interactions are ratings of ``min_weight`` or more.  A film
    nobody rated has a count of 0."""
    r = ratings.select(F.col("userId").alias("user_id"), F.col("movieId").alias("m"), doubled_rating(F.col("rating")).alias("twice"))
    stats = r.groupBy("m").agg(F.count("*").alias("n"), F.sum("twice").alias("s"))
    words = tags.groupBy(F.col("movieId").alias("t")).agg(F.array_join(F.sort_array(F.collect_list("tag")), " ").alias("tags"), F.count("*").alias("n_tags"))
    title = F.translate("title", "()", "  ")
    genres = F.when(F.col("genres") == "(no genres listed)", "").otherwise(F.translate("genres", "|", " "))
    docs = movies.join(stats, F.col("movieId") == F.col("m"), "left").join(words, F.col("movieId") == F.col("t"), "left")
    zero = F.lit(0).cast("long")
    docs = docs.select(
        F.col("movieId").alias("doc_id"),
        F.concat_ws(" ", title, genres, "tags").alias("text"),
        F.coalesce("n", zero).alias("popularity"),
        F.coalesce("s", zero).alias("rating_sum2"),
        F.coalesce("n", zero).alias("rating_count"),
        F.coalesce("n_tags", zero).alias("engagement"),
    ).orderBy(F.col("doc_id").cast("long"))
    liked = r.where(F.col("twice") >= int(2 * min_weight)).select("user_id", F.col("m").alias("doc_id"), (F.col("twice") / 2).cast("double").alias("weight"))
    return Dataset("ratings", docs, liked)


def load_rating_archive(spark: SparkSession, raw: bytes, min_weight: float = 4.0, expect_sha256: str | None = None) -> Dataset:
    """A zip of ``movies.csv``, ``ratings.csv`` and ``tags.csv`` (UTF-8, BOM or
    not), with its digest checked if one is given.  Archives are small by
    definition; at scale, read the three files with ``spark.read.csv``."""
    if expect_sha256 and hashlib.sha256(raw).hexdigest() != expect_sha256:
        raise BadData("the archive is not the pinned one")
    found = {}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for n in z.namelist():
            base = n.rsplit("/", 1)[-1]
            if base in ("movies.csv", "ratings.csv", "tags.csv"):
                lines = z.read(n).decode("utf-8-sig").splitlines()
                rows = spark.createDataFrame([(x,) for x in lines], "value string").select("value")
                found[base] = spark.read.option("header", True).csv(rows.rdd.map(lambda r: r[0]))
    if len(found) != 3:
        raise BadData("the archive lacks one of its three files")
    return parse_ratings(found["movies.csv"], found["ratings.csv"], found["tags.csv"], min_weight)


# --------------------------------------------------------------- synthetic
@dataclass(frozen=True)
class SyntheticSpec:
    n_docs: int = 2000
    vocab_size: int = 4000
    len_min: int = 3
    len_max: int = 40
    n_users: int = 200
    max_interactions: int = 12
    n_duplicates: int = 20
    n_twins: int = 40
    seed: int = 0

    def digest(self) -> str:
        return hashlib.sha256(repr(sorted(asdict(self).items())).encode()).hexdigest()


SMALL, TINY = SyntheticSpec(), SyntheticSpec(120, 300, n_users=20, n_duplicates=4, n_twins=6)


def _pick(n: int, *keys: Column | int | str) -> Column:
    """Uniform integer in 0..n-1 from a hash of the keys."""
    return F.pmod(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys]), F.lit(n))


#: Weight of the first rank of a Zipf law in integers.
ZIPF_SCALE = 1 << 40


def zipf_bounds(spark: SparkSession, n: int) -> DataFrame:
    """``rank, lo, hi``: the integer ranges, half-open and end to end, of ranks
    0 to n - 1 with weight ``ZIPF_SCALE // (rank + 1)`` (1 at least), so that a
    uniform integer below the last ``hi`` falls to a rank exactly by its weight."""
    w = F.greatest(F.lit(1).cast("long"), F.expr(f"{ZIPF_SCALE}L div (id + 1)"))
    upto = F.sum("w").over(W.orderBy("id").rowsBetween(W.unboundedPreceding, 0))  # n is a vocabulary's size
    return spark.range(n).withColumn("w", w).select(F.col("id").cast("int").alias("rank"), (upto - F.col("w")).alias("lo"), upto.alias("hi"))


def zipf_ranks(draws: DataFrame, column: str, n: int, out: str = "rank") -> DataFrame:
    """Append the rank that each hash in ``column`` (uniform over 63 bits) draws:
    whole numbers only, by bisection over a broadcast table of ``n`` bounds."""
    bounds = [r["hi"] for r in zipf_bounds(draws.sparkSession, n).orderBy("rank").collect()]  # n numbers
    table = draws.sparkSession.createDataFrame([(bounds,)], "his array<long>")
    value = F.pmod(F.col(column), F.lit(bounds[-1]))
    steps = max(1, n.bit_length())
    start = F.struct(F.lit(0).alias("lo"), F.lit(n - 1).alias("hi"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(F.col("his"), mid) <= F.col("__v")
        return F.struct(F.when(right & (s["lo"] < s["hi"]), mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.array_repeat(F.lit(0), steps + 1), start, halve, lambda s: s["lo"])
    return draws.withColumn("__v", value).join(F.broadcast(table), F.lit(True)).withColumn(out, found).drop("__v", "his")


def synthetic(spark: SparkSession, spec: SyntheticSpec = SMALL) -> Dataset:
    """Zipf text with exact duplicates and twin pairs (a copy plus one word),
    attributes and heavy-tailed interactions; every value is a hash of its
    coordinates, so any partitioning makes the same corpus."""
    if spec.n_duplicates + spec.n_twins > spec.n_docs:
        raise BadConfig("more copies than documents")
    s = spec.seed
    base = spark.range(spec.n_docs).withColumn("len", F.lit(spec.len_min) + _pick(spec.len_max - spec.len_min + 1, s, "len", F.col("id")))
    toks = base.select("id", F.posexplode(F.sequence(F.lit(1), F.col("len"))).alias("j", "x")).withColumn("draw", F.xxhash64(F.lit(s), F.lit("w"), "id", "j"))
    toks = zipf_ranks(toks, "draw", spec.vocab_size).select("id", "j", F.concat(F.lit("w"), F.lpad(F.col("rank").cast("string"), 5, "0")).alias("t"))
    text = toks.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", "t"))), lambda e: e["t"]), " ").alias("text"))
    name = lambda p, w: F.concat(F.lit(p), F.lpad(F.col("id").cast("string"), w, "0"))
    docs = text.select(name("d", 6).alias("doc_id"), "text")
    docs = docs.union(text.where(F.col("id") < spec.n_duplicates).select(name("dup", 4), "text"))
    src = text.where((F.col("id") >= spec.n_duplicates) & (F.col("id") < spec.n_duplicates + spec.n_twins)).withColumn("id", F.col("id") - spec.n_duplicates)
    docs = docs.union(src.select(F.concat(name("twin", 4), F.lit("a")), "text"))
    docs = docs.union(src.select(F.concat(name("twin", 4), F.lit("b")), F.concat("text", F.lit(" w"), F.lpad((F.col("id") % spec.vocab_size).cast("string"), 5, "0"))))
    d = F.col("doc_id")
    docs = docs.select(
        "doc_id", "text", _pick(501, s, "pop", d).alias("popularity"), ((_pick(9, s, "r", d) + 2) * (_pick(20, s, "rn", d) + 1)).alias("rating_sum2"),
        (_pick(20, s, "rc", d) + 1).alias("rating_count"), _pick(51, s, "eng", d).alias("engagement"),
    )
    users = spark.range(spec.n_users).withColumn("n", F.lit(1) + F.floor(spec.max_interactions * F.pow((_pick(1 << 20, s, "n", F.col("id")) + 0.5) / (1 << 20), 2)).cast("int"))
    inter = users.select("id", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(spec.max_interactions)))).alias("j"))
    inter = inter.select(
        F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("user_id"),
        F.concat(F.lit("d"), F.lpad(_pick(spec.n_docs, s, "i", F.col("id"), F.col("j")).cast("string"), 6, "0")).alias("doc_id"),
        (F.lit(3.0) + _pick(5, s, "wt", F.col("id"), F.col("j")) * 0.5).alias("weight"),
    ).dropDuplicates(["user_id", "doc_id"])
    return Dataset("synthetic", docs, inter)


def load_dataset(spark: SparkSession, name: str, archive: bytes | None = None) -> Dataset:
    """By name: ``synthetic_small``, ``synthetic_tiny``, ``ratings`` (with an
    archive), ``jsonl:<path>`` or ``parquet:<folder>``."""
    if name == "synthetic_small":
        return synthetic(spark, SMALL)
    if name == "synthetic_tiny":
        return synthetic(spark, TINY)
    if name == "ratings":
        if archive is None:
            raise BadConfig("the rating data come from an archive")
        return load_rating_archive(spark, archive)
    kind, _, rest = name.partition(":")
    if kind == "jsonl" and rest:
        return load_jsonl_corpus(spark, rest)
    if kind == "parquet" and rest:
        return load_parquet_corpus(spark, rest)
    raise BadConfig(f"unknown dataset {name!r}")


def near_duplicate_twins(docs: DataFrame) -> DataFrame:
    """Pairs of synthetic twins, by name."""
    key = F.regexp_extract("doc_id", "^(twin[0-9]+)[ab]$", 1)
    w = W.partitionBy("k").orderBy("doc_id")
    return docs.withColumn("k", key).where("k <> ''").withColumn("b", F.lead("doc_id").over(w)).where("b IS NOT NULL").select(F.col("doc_id").alias("a"), "b")
