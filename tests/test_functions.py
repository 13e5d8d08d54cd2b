"""Text and numeric functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestem.errors import BadConfig
from lodestem.functions import numerics as N
from lodestem.functions import text as T
from lodestem.functions.stemmer import stem


@pytest.mark.parametrize(
    "word,want",
    [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("hopping", "hop"), ("hoping", "hope"), ("happy", "happi"), ("by", "by"), ("relational", "relat"),
     ("national", "nation"), ("generously", "generous"), ("skies", "sky"), ("dying", "die"), ("inning", "inning"), ("controlling", "control"), ("adjustment", "adjust"), ("gas", "gas"), ("this", "this"), ("is", "is")],
)
def test_stems(word, want):
    assert stem(word) == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_normalise_is_idempotent(s):
    once = T.normalise(s)
    assert T.normalise(once) == once


def test_zero_width_recomposes():
    assert T.normalise("e​́") == "é"


def test_gaps_and_ngrams():
    toks = T.gapped("king of pop".split(), frozenset(T.STOPWORDS))
    assert toks == ["king", T.GAP, "pop"]
    assert T.JOINER.join(["king", "pop"]) not in T.ngrams_of(toks)
    cfg = T.PreprocessingConfig(min_len=2)
    assert T.JOINER.join(["vitamin", "deficiency"]) in T.ngrams_of(T.tokens_of("vitamin c deficiency", cfg))
    assert len(T.STOPWORDS) == 145 and list(T.STOPWORDS) == sorted(T.STOPWORDS)
    with pytest.raises(BadConfig):
        T.ngrams_of(["a"], 2, 1)


def test_plain_profile_equals_full(spark):
    texts = ["The king of pop and the queen", "of the", "", None, "a b c d", "one two three, the four five"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    g = df.select("id", T.stopped(T.plain_tokens(F.col("text"))).alias("g"))
    got = {r["id"]: (r["g"], r["n"]) for r in g.select("id", "g", T.plain_ngrams(F.col("g"), 2).alias("n")).collect()}
    for i, t in enumerate(texts):
        toks = T.gapped((t or "").lower().replace(",", "").split(), frozenset(T.STOPWORDS))
        assert got[i] == (toks, T.ngrams_of(toks, 2, 2)), t


def test_full_profile(spark):
    df = spark.createDataFrame([("x", "Running RUNNERS ran²"), ("y", None)], "id string, text string")
    rows = {r["id"]: r for r in T.preprocess(df, intermediates=True).collect()}
    assert rows["x"]["raw_tokens"] == ["running", "runners", "ran2"]
    assert rows["x"]["features"][:3] == ["run", "runner", "ran2"]
    assert rows["y"]["features"] == []


def test_sums():
    xs = [10.0**k for k in range(-8, 9)] * 20
    assert N.pairwise(xs[:128]) == N.naive(xs[:128])
    assert N.neumaier([1.0, 1e100, 1.0, -1e100]) == 2.0
    assert abs(N.pairwise(xs) - math.fsum(xs)) <= 1e-6


def test_idf():
    assert N.smoothed_idf(7, 7) == 1.0
    assert N.smoothed_idf(0, 1) == pytest.approx(math.log(2) + 1)
    with pytest.raises(ValueError):
        N.smoothed_idf(8, 7)
    assert N.ulps_between(1.0, math.nextafter(1.0, 2.0)) == 1


def test_ordered_sum_does_not_depend_on_partitions(spark):
    rows = [(i % 3, i, (i * 7919 % 101) * 10.0 ** (i % 17 - 8)) for i in range(400)]
    want = {k: N.naive(x for g, _, x in sorted(rows, key=lambda r: r[1]) if g == k) for k in range(3)}
    for parts in (1, 3, 8):
        df = spark.createDataFrame(rows, "g int, k int, x double").repartition(parts)
        for policy, fn in N.SUMS.items():
            got = {r["g"]: r["s"] for r in df.groupBy("g").agg(N.ordered_sum(F.col("k"), F.col("x"), policy).alias("s")).collect()}
            assert got == {k: fn([x for g, _, x in sorted(rows, key=lambda r: r[1]) if g == k]) for k in range(3)}, policy
    assert want
