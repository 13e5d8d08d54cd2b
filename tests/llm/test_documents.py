"""Operators on documents: brute force on fixtures, edge cases, empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from lodestem.llm import bpe_codec, language_id, ngram_join, packing, quality_classifier, quality_rules, secret_ledger, substring_dedup, toxicity
from lodestem.llm.fm_index import repeated_windows

rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(text, seed, every=40):
    r, w = random.Random(seed), text.split()
    for i in range(0, len(w), every):
        w[min(len(w) - 1, i + r.randrange(every))] = f"new{seed}x{i}"
    return " ".join(w)


BASE = prose(160, 1)
PASSAGE = prose(70, 2)
TEXTS = [
    BASE, BASE, edited(BASE, 3), edited(BASE, 4), None, "", "   \n\t ", "one two", "one two", "one two three",
    prose(30, 5) + " " + PASSAGE + "\n" + prose(20, 6), PASSAGE + " " + prose(15, 7), prose(9, 8), prose(20_000, 9), "é" * 5000, "a " * 300,
    prose(10, 10) + "\x0b" + PASSAGE, "x" * 3000, "a<|endoftext|>b <|startoftext|> <|EndOfText|>", "ünï cödé 日本語 текст", "password = 'abcdefghijklmnop' and AKIA" + "Z9" * 8,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"clash{i}", i) for i, t in enumerate(TEXTS)] + [(None, BASE, "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def words(t):
    return (t or "").encode().split()


# ----------------------------------------------------------------- codecs
def test_bpe_round_trip(docs, nothing):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc, _ = bpe_codec.load_codec(path, P.PATTERN)
    for r in bpe_codec.encode(docs, path, P.PATTERN).collect():
        t = TEXTS[r["doc_id"]] if r["doc_id"] is not None else BASE
        assert r["ids"] == enc.encode_ordinary(t or "") and bytes(r["decoded"]) == (t or "").encode()
        assert r["n_tokens"] == len(r["ids"])
    assert bpe_codec.encode(nothing, path, P.PATTERN, digests_only=True).collect() == []


def test_safe_pieces():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc, _ = bpe_codec.load_codec(path, P.PATTERN)
    for seed in range(30):
        r = random.Random(seed)
        t = "".join(r.choice(["a", "B", " ", "  ", "\n", "7", "'s", "!", "é", " \n "]) for _ in range(400))
        parts = list(bpe_codec.safe_pieces(t, 23))
        assert "".join(parts) == t
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)


# ---------------------------------------------------------------- secrets
KINDS = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def spans(t):
    out = [(m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(KINDS.items()) for m in p.finditer(t or "") if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


SECRETS = [
    "日é password: 'abcdefghijkl' token=secret:abcdefghijklmnop API_KEY==aaaaaaaaaaaa deadbeefdeadbeef0", "AKIAAKIA" + "A" * 12 + " akia AKIA12 " + "0" * 15 + " " + "0" * 16,
    "token=" + "a" * 40 + "\nSecret = " + "f0" * 9, "tokentoken=abcdefghijklmnop", None, "", "plain",
]


@pytest.mark.parametrize("bits", [26, 6, 1])
def test_secrets(spark, docs, nothing, monkeypatch, bits):
    # 6: a crowded bitmap; 1: none, but a join
    monkeypatch.setattr(secret_ledger, "BITMAP_BITS", bits)
    rows = list(enumerate(SECRETS)) + [(100, SECRETS[0]), (0, SECRETS[0]), (None, SECRETS[1] + "!"), (None, SECRETS[1] + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = secret_ledger.scan_by_version(df)
    assert scanned.entries.count() == len({t or "" for _, t in rows}) * 2  # the base rules were in the ledger
    got = secret_ledger.digest(secret_ledger.by_path(scanned)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = SECRETS[1] + "!" if r["doc_id"] is None else SECRETS[r["doc_id"] % 100]
        assert r["base_sha256"] == hashlib.sha256(spans(t).encode()).hexdigest(), (r, spans(t))
    assert secret_ledger.by_path(secret_ledger.scan(nothing)).collect() == []


def test_ledger_scans_only_what_is_new(spark):
    df = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string")
    first = secret_ledger.scan(df, rules=secret_ledger.BASE_RULES)
    more = df.union(spark.createDataFrame([(50, SECRETS[0]), (51, "token=" + "z" * 20)], "doc_id long, text string"))
    second = secret_ledger.scan(more, rules=secret_ledger.BASE_RULES, ledger=first.entries, known=first.findings)
    assert second.entries.count() == 3  # one new blob, three rules
    assert second.findings.count() == first.findings.count() + 1
    got = {r["id"]: r["spans"] for r in secret_ledger.by_path(second).collect()}
    assert got[50] == got[0] and len(got[51]) == 1


def test_redaction(spark):
    df = spark.createDataFrame([(1, SECRETS[2], 5), (2, None, 6), (3, "plain  text", 7)], "doc_id long, text string, spans int")
    out = {r["doc_id"]: r for r in secret_ledger.redact_documents(df).collect()}
    assert out[1]["text"] == "[secret]\n[secret]" and out[2]["text"] is None and out[3]["text"] == "plain  text" and out[3]["spans"] == 7


# ---------------------------------------------------------------- packing
def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.pack(packing.pieces(docs, P.path("word_bpe_49k.json"), keep_ids=True)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    for d, ps in by_doc.items():
        ids = tok.encode((TEXTS[d] if d is not None else BASE) or "", add_special_tokens=False).ids + [1]
        ps.sort(key=lambda r: r["piece"])
        assert np.frombuffer(b"".join(bytes(p["ids"]) for p in ps), "<u4").tolist() == ids, d
        assert all(p["length"] == 4096 for p in ps[:-1])
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert len(by_seq) <= -(-sum(r["length"] for r in rows) // 4096) + 1
    assert packing.pack(packing.pieces(nothing, P.path("word_bpe_49k.json"))).collect() == []


def test_plan_is_tight():
    r = random.Random(2)
    hist = defaultdict(int)
    for _ in range(30_000):
        hist[min(4096, int(r.lognormvariate(6.2, 1.3)) + 1)] += 1
    plan = packing.plan_packing(dict(hist), rounds=40)
    total = sum(k * v for k, v in hist.items())
    assert -(-total // 4096) <= plan.sequences <= total / 4096 * 1.01 + 1
    seen = defaultdict(int)
    for n, c in zip(plan.length, plan.count, strict=True):
        seen[n] += c
    assert seen == hist


def test_program_covers_all_lengths():
    r = np.random.default_rng(3)
    found, n = np.unique(np.minimum(1024, r.lognormal(5, 1.2, 40_000).astype(int) + 1), return_counts=True)
    for sizes, demand in ((found, n * 100), (np.arange(1, 501), r.integers(500, 2000, 500))):
        covered, number = np.zeros(len(sizes)), 0.0
        for x, config in packing.configurations(sizes, demand.astype(float), 1024):
            assert x > 0 and sizes[config].sum() <= 1024
            np.add.at(covered, config, x)
            number += x
        assert len(sizes) >= 500 and np.allclose(covered, demand, rtol=1e-6)
        total, hist = (sizes * demand).sum(), dict(zip(sizes.tolist(), demand.tolist(), strict=True))
        assert number <= total / 1024 * 1.01
        plan = packing.plan_packing(hist, 1024)
        assert plan.sequences <= min(packing.plan_packing(hist, 1024, rounds=0).sequences, total / 1024 * 1.002 + 1)


def test_word_ids_match_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    ids = packing.WordIds(path)
    assert np.frombuffer(ids.of_texts([[b"a<|endoftext|>b"]])[0], "<u4").tolist() == tok.encode("a<|endoftext|>b", add_special_tokens=False).ids == [320, 49407, 321]
    r, pool = random.Random(4), list(tok.get_vocab())
    for _ in range(6000):
        w = "".join(r.choice(pool) for _ in range(r.randint(1, 3))).replace(" ", "").replace("</w>", r.choice(["", "", ",", "'", "A"])) if r.random() < 0.6 else "".join(r.choice("abcxyzÉüß'0123.,!?_%½日") for _ in range(20))
        assert np.frombuffer(ids.of_texts([w.encode().split()])[0], "<u4").tolist() == tok.encode(w, add_special_tokens=False).ids, w


# ------------------------------------------------------------------ rules
def brute_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = defaultdict(list)
    for i in range(len(w) - 4):
        grams[tuple(w[i : i + 5])].append(i)
    rep = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep)


def test_statistics(spark, nothing):
    texts = [*TEXTS, "a b c d e a b c d e f", "x\nx\n\nx\n y", "a a a a a a a", "## 1 | 2\n## 1 | 2", "p q r s t u p q r s t v p q r s t"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clash = df.withColumn("n_words", F.lit("x")).withColumn("__w", F.lit(1)).withColumn("KEPT", F.lit(2))
    judged = quality_rules.judge(clash, quality_rules.DecisionList())
    assert [c.lower() for c in judged.columns].count("n_words") == 1 and "__w" in judged.columns and "KEPT" not in judged.columns and judged.where("doc_id = 0 and kept").count() == 1
    for r in quality_rules.statistics(df).collect():
        assert tuple(r[c] for c in quality_rules.BASE_STATISTICS) == brute_rules(texts[r["doc_id"]]), r["doc_id"]
    assert quality_rules.keep_documents(nothing, quality_rules.DecisionList()).columns == nothing.columns


def test_rules_learn_and_keep(spark, docs):
    rows = [(i, prose(60, i) if i % 4 else prose(20, i).replace(" ", "%%% ### "), int(i % 4 > 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    rules = quality_rules.learn_from_tables(df.drop("quality"), df.select("doc_id", "quality"))
    assert rules.rules
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, rules).collect()}
    assert all(kept[i] == bool(q) for i, _, q in rows)
    assert quality_rules.learn_from_tables(df.limit(0).drop("quality"), df.limit(0).select("doc_id", "quality")) == quality_rules.DecisionList()
    held = quality_rules.keep_documents(docs, rules)
    assert held.columns == docs.columns and 0 in {r["doc_id"] for r in held.collect()}


def test_quality_classifier(spark, docs, nothing):
    rows = [(i, prose(60, i) if i % 4 else prose(20, i).replace(" ", "%%% ### "), int(i % 4 > 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality_classifier.fit(df, df.select("doc_id", "quality"))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.predict(df, model).collect()}
    assert sum((got[i] >= 0.5) == bool(q) for i, _, q in rows) >= 236
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.predict(docs, model).collect())
    assert quality_classifier.predict(nothing, model).collect() == []
    none = quality_classifier.fit(df.limit(0), df.limit(0).select("doc_id", "quality"))
    assert {r["score"] for r in quality_classifier.predict(docs, none).collect()} == {0.5}


# --------------------------------------------------------------- toxicity
@pytest.fixture(scope="module")
def tox(spark):
    bad = ["idiot", "moron", "pathetic", "disgusting"]
    rows = [(i, prose(40, i) + (f" {bad[i % 4]} " if i % 5 == 0 else " ") + prose(10, i + 9999), int(i % 5 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.fit(df, df.select("doc_id", "toxic"))


@pytest.mark.parametrize("noisy,plain", [("1d10t", "idiot"), ("m0r0n", "moron"), ("idiiiiot", "idiot"), ("p@th3tic", "pathetic"), ("m.o.r.o.n", "moron"), ("m o r o n", "moron"), ("d1sgust!ng", "disgusting"), ("moroooon", "moron")])
def test_noise_is_decoded(tox, noisy, plain):
    assert toxicity.decode(noisy, tox.cost) == plain
    assert plain in toxicity.restored_text(f"some words {noisy} and more", tox)


def test_toxicity_scores(spark, tox, docs, nothing):
    texts = {1: "we say m0r0n here", 2: "you m o r o n now", 3: prose(80, 77), 4: None, 5: "", 6: "IDIOT, really"}
    got = {r["doc_id"]: r["score"] for r in toxicity.predict(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tox).collect()}
    assert all(got[i] >= 0.7 for i in (1, 2, 6)) and all(got[i] < 0.5 for i in (3, 4, 5))
    assert toxicity.predict(docs, tox).count() == len(TEXTS) + 1 and toxicity.predict(nothing, tox).collect() == []


def test_spaced_runs_have_words(spark, tox):
    assert toxicity.restored(b"a m o r o n", tox) == "a moron"
    texts = ["y o u a r e s u c h a h o p e l e s s m o r o n", "a m o r o n", "so " + "m o p " * 300 + "i d i o t", "m" + "o" * 90 + "r" + "o" * 90 + "n", "m o p " * 300]
    got = {r["doc_id"]: r["score"] for r in toxicity.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tox).collect()}
    assert [got[i] >= 0.7 for i in range(5)] == [True, True, True, True, False]


def test_lightly_noisy_words(spark, tox):
    texts = ["you mor.on there", "an idi-ot", "a mooron", "IDIIOT!", "so path-ettic", "é è m o r o n", prose(60, 78), "mo.po aa-bb"]
    got = {r["doc_id"]: r["score"] for r in toxicity.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tox).collect()}
    assert [got[i] >= 0.7 for i in range(8)] == [True] * 6 + [False] * 2
    data = np.frombuffer("ä l t e r Ää".encode(), np.uint8)
    assert [r.decode() for _, r in toxicity.suspicious(data, np.array([0, len(data)]))] == ["Ää", "ä l t e r"]


def test_stems_lose_no_term(tox):
    stems, r = toxicity.stems_of(tox.whole | tox.heads), random.Random(5)
    for _ in range(3000):
        word = r.choice(["idiot", "moron", "pathetic", "disgusting", "moist", "panda"])
        run = "".join(c * r.choice([1, 1, 1, 2, 3]) + r.choice(["", "", "", ".", "-", " "]) for c in r.choice(["", "o", "ma"]) + word)
        words = re.findall(r"[a-z]+", toxicity.restored(run.encode(), tox))
        hit = any(w in tox.whole or any(w.startswith(h) and w != h for h in tox.heads) for w in words)
        assert not hit or toxicity.may_hold_term(run, stems), run


# --------------------------------------------------------------- language
def test_language(spark, docs, nothing):
    rows = [(i, prose(30, i) if i % 2 else prose(30, i).translate(str.maketrans("abcdefgh", "éèçàüößñ")), "aa" if i % 2 else "bb") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    odd = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 !?")], "doc_id long, text string"), model).collect()}
    assert set(odd.values()) == {"und"}
    assert language_id.predict(docs, model).count() == len(TEXTS) + 1 and language_id.predict(nothing, model).collect() == []
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(df.limit(0))).collect()} == {"und"}


# ------------------------------------------------------------- near copies
def brute_links(texts):
    sets = {}
    for d, t in texts.items():
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    n, comp = defaultdict(int), {d: d for d in texts}
    ids = sorted(texts)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    for _ in ids:
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {d: (comp[d], n[d], comp[d] == d) for d in ids}


@pytest.mark.parametrize("target", [ngram_join.TARGET_RECALL, 1.0])
def test_ngram_join(spark, docs, nothing, monkeypatch, target):
    texts = dict(enumerate(TEXTS))
    for i in range(30):
        texts[100 + i] = edited(BASE, 200 + i, 60)
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, size int")
    monkeypatch.setattr(ngram_join, "MOST_CHUNK", 7)  # several chunks to a cluster
    monkeypatch.setattr(ngram_join, "TARGET_RECALL", target)  # 1.0: every level down to the least
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["kept"]) for r in ngram_join.join(df).collect()}
    assert got == brute_links(texts)
    if target < 1:
        assert ngram_join.join(nothing).collect() == []
        lone = [r for r in ngram_join.join(docs).collect() if r["doc_id"] is None]
        assert (lone[0]["n_links"], lone[0]["kept"]) == (0, True)


def test_forest(spark, monkeypatch):
    """Every shared prefix of every tree, however ranges part the sorted paths."""
    from lodestem.llm import common

    r = random.Random(8)
    paths = {n: [int.from_bytes(bytes(r.choice([1, 2, 200]) for _ in range(8)), "big", signed=True) for _ in range(3)] for n in range(300)}
    paths |= {n: paths[0] for n in range(300, 400)}
    df = spark.createDataFrame(list(paths.items()), "node long, paths array<long>").repartition(3)
    monkeypatch.setattr(common, "BATCH_ROWS", "7")  # runs go on in the next batch
    rows = ngram_join.forest(df, 2).collect()
    for d in range(2, 9):
        up = {n: n for n in paths}

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for row in rows:
            up[root(row["node"])] = root(row["heads"][d - 2])
        met = defaultdict(set)
        for n, ps in paths.items():
            for k, p in enumerate(ps):
                met[k, p >> 8 * (8 - d)].add(n)
        whole = {n: n for n in paths}
        for group in met.values():
            first, *rest = group
            for x in rest:
                a, b = root(first, whole), root(x, whole)
                whole[a] = b
        assert {frozenset(n for n in paths if root(n) == k) for k in map(root, paths)} == {frozenset(n for n in paths if root(n, whole) == k) for k in {root(n, whole) for n in paths}}, d


def test_depths_and_recall():
    assert ngram_join.least_depth(0.8) == 6 and ngram_join.least_depth(0.8, target=0.99999999) < 6 and ngram_join.least_depth(0.1) == 1
    links = np.zeros(101)
    assert ngram_join.recall(links, 8) == 1.0
    links[80] = 1000
    assert abs(ngram_join.recall(links, 8) - ngram_join.found_share(0.8, 8)) < 1e-12
    links[99] = 1e6
    assert ngram_join.recall(links, 8) > 0.9999 > ngram_join.found_share(0.8, 8)


def thue(n, a, b):
    """The word that collides under every polynomial hash modulo 2**64."""
    return "".join(a if bin(i).count("1") % 2 else b for i in range(n))


def test_long_words_are_told_apart(spark):
    head = prose(49, 3)
    df = spark.createDataFrame([(1, f"{head} {thue(1024, 'a', 'b')}"), (2, f"{head} {thue(1024, 'b', 'a')}")], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.dedup(df).collect()] == [0, 0]
    three = spark.createDataFrame([(1, f"a b c d {thue(1024, 'a', 'b')}"), (2, f"a b c d {thue(1024, 'b', 'a')}")], "doc_id long, text string")
    assert [r["n_links"] for r in ngram_join.join(three).collect()] == [0, 0]
    words = [f"w{i}" for i in (3, 8)]
    a, b = ([words[bin(i).count("1") % 2 ^ f] for i in range(2048)] for f in (0, 1))
    raw = [np.frombuffer(" ".join(x).encode(), np.uint8) for x in (a, b)]
    from lodestem.llm import common

    sums = []
    for data in raw:
        starts, ends, _ = common.word_layout(data, np.array([0, len(data)]))
        h = common.word_hashes(data, starts, ends)
        sums.append(int(common.run_hashes(common.ladder(h, 2048), np.array([0]), np.array([2048]))[0]))
    assert sums[0] != sums[1]


def test_word_hashes_by_brute_force():
    from lodestem.llm import common

    r = random.Random(4)
    words = ["".join(r.choice("ab") for _ in range(n)) for n in [*range(1, 30), 63, 64, 65, 130] for _ in range(4)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = common.word_layout(data, np.array([0, len(data)]))
    for h in common.word_hashes(data, starts, ends, (0, 1)):
        seen = {}
        assert all(seen.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    h = common.word_hashes(data, starts, ends)
    for k in (1, 2, 5, 8, 50):
        runs = common.gram_hashes(h, k)
        assert len(runs) == len(words) - k + 1
        assert len(set(runs.tolist())) == len({tuple(words[i : i + k]) for i in range(len(runs))})


# -------------------------------------------------------------- substrings
def brute_dedup(texts, window=50):
    first, out = {}, {}
    for d in sorted(texts):
        w = words(texts[d])
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if first.setdefault(k, d) < d:
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize("hot", [1000, 0])
def test_repeated_ids(spark, monkeypatch, hot):
    """Rows that repeat an id: with the same text they fare alike, with another
    they are documents of their own of which neither is earlier."""
    monkeypatch.setattr(substring_dedup, "HOT_PASSAGES", hot)
    long, short = prose(20, 31) + " " + PASSAGE + " " + prose(400, 32), PASSAGE
    rows = [(5, long), (5, long), (5, short), (7, prose(9, 33) + " " + PASSAGE), (3, prose(60, 34)), (9, prose(5, 35)), (9, prose(60, 34))]
    got = sorted(tuple(r) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed").collect())
    assert got == sorted([(5, 490, 0), (5, 490, 0), (5, 70, 0), (7, 79, 70), (3, 60, 0), (9, 5, 0), (9, 60, 60)])
    if hot:
        out = ngram_join.join(spark.createDataFrame([*rows, (8, long), (2, short)], "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["n_words"], r["class_id"], r["n_links"], r["kept"]) for r in out) == sorted(
            [(5, 490, 5, 2, True), (5, 490, 5, 2, True), (8, 490, 5, 2, False), (5, 70, 2, 2, False), (2, 70, 2, 2, True), (7, 79, 2, 2, False), (3, 60, 3, 1, True), (9, 5, 9, 0, True), (9, 60, 3, 1, False)]
        )


def test_one_of_each_group_stays(spark):
    near = [(1, BASE, "a"), (2, edited(BASE, 3, 80), "b"), (3, BASE, "c"), (1, BASE, "d"), (1, edited(BASE, 4, 80), "e"), (1, prose(50, 40), "f"), (7, None, "g"), (7, "", "h"), (None, BASE, "i"), (8, prose(40, 41), "j"), (8, prose(40, 41), "k")]
    got = sorted((r["v"] for r in ngram_join.one_of_each(spark.createDataFrame(near, "doc_id long, text string, v string")).collect()), key=str)
    assert len([v for v in got if v in "abcde"]) == 1 and not {"b", "c"} & set(got)
    assert set("fghi") <= set(got) and len({"j", "k"} & set(got)) == 1 and len(got) == 6


@pytest.mark.parametrize("hot", [1000, 0, 3])
def test_substring_dedup(spark, docs, nothing, monkeypatch, hot):
    texts = dict(enumerate(TEXTS))
    for i in range(12):
        texts[100 + i] = prose(25 + i, 300 + i) + " " + PASSAGE + " " + prose(5 * i, 400 + i)
    monkeypatch.setattr(substring_dedup, "HOT_PASSAGES", hot)
    df = spark.createDataFrame([(d, t, 0) for d, t in texts.items()], "doc_id long, text string, n_removed int")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup(df).collect()}
    assert got == brute_dedup(texts)
    if hot == 1000:
        assert substring_dedup.dedup(nothing).collect() == []
        lone = [r for r in substring_dedup.dedup(docs, digests_only=True).collect() if r["doc_id"] is None]
        assert lone[0]["n_removed"] == 0
        left = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_documents(df).collect()}
        want = brute_dedup(texts)
        assert set(left) == {d for d, (n, gone, _) in want.items() if gone < n or not n}
        assert all(left[d] == (texts[d] if not want[d][1] else want[d][2]) for d in left)


def test_fm_index_against_brute_force():
    g = np.random.default_rng(1)
    for _ in range(60):
        w = int(g.integers(2, 6))
        ps = [g.integers(0, 3, g.integers(1, 14)).astype(np.uint64) for _ in range(g.integers(1, 9))]
        own = g.integers(0, 5, len(ps))
        got = {(p, s) for p, a, b in repeated_windows(ps, own, w) for s in range(a, b + 1)}
        want = set()
        for i, x in enumerate(ps):
            for s in range(len(x) - w + 1):
                if any(own[k] < own[i] and any((y[u : u + w] == x[s : s + w]).all() for u in range(len(y) - w + 1)) for k, y in enumerate(ps)):
                    want.add((i, s))
        assert got == want


def test_split_by_ids(spark):
    from lodestem.llm.common import split_by_ids

    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    maybe, clean = split_by_ids(df, df.where("doc_id % 50 = 0"), "doc_id", bits=10)
    assert maybe.count() + clean.count() == 2000 and clean.where("doc_id % 50 = 0").count() == 0 and 40 <= maybe.count() < 400


def test_fold(spark):
    from lodestem.llm.common import fold_of

    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in spark.range(50).withColumn("f", fold_of(F.col("id"), 3)).collect())
