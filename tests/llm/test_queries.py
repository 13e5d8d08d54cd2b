"""The contract queries themselves, on a small folder: columns, held-out flags,
predictions, and every result that brute force can give."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import public_tokenizers as P
from lodestem.llm import language_id, queries, quality_classifier, toxicity
from tests.llm.test_documents import BASE, PASSAGE, brute_dedup, brute_links, brute_rules, edited, prose, spans
from tests.llm.test_embeddings_pipeline import brute

BAD = ["idiot", "moron", "pathetic", "disgusting"]


@pytest.fixture(scope="module")
def texts():
    out = {i: prose(40, i) + (f" {BAD[i // 5 % 4]} " if i % 5 < 2 else " ") + prose(10, i + 9999) for i in range(240)}
    out |= {240 + i: prose(20, 500 + i).replace(" ", "%%% ### ") for i in range(60)}
    out |= {300: BASE, 301: BASE, 302: edited(BASE, 3, 60), 303: prose(30, 5) + " " + PASSAGE, 304: PASSAGE + " " + prose(15, 7), 305: None, 306: "", 307: " \n\t ", 308: "12 !?"}
    out |= {309: "we met a m0r0n there " + prose(20, 600), 310: "password = 'abcdefghijklmnop' AKIA" + "Z9" * 8 + " " + "0a" * 9, 311: "ünï cödé 日本語 a<|endoftext|>b", 312: "x y " * 4000, 313: "a\na\nb c\nb c d"}
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory, texts):
    at = tmp_path_factory.mktemp("tables")
    ids = list(texts)
    turned = {i: t and t.translate(str.maketrans("abcdefgh", "éèçàüößñ")) for i, t in texts.items()}
    lang = ["aa" if i % 3 else None if i % 7 == 0 else "bb" for i in ids]
    own = [texts[i] if i >= 240 or x != "bb" else turned[i] for i, x in zip(ids, lang, strict=True)]
    pq.write_table(pa.table({"doc_id": ids, "text": pa.array(own, pa.string()), "lang": pa.array(lang, pa.string()), "source": ["s"] * len(ids), "n_chars": [len(t or "") for t in own]}), at / "documents.parquet")
    some = [i for i in ids if i < 300]
    pq.write_table(pa.table({"doc_id": some, "quality": [int(i < 240) for i in some], "toxic": [int(i < 240 and i % 5 < 2) for i in some]}), at / "labels.parquet")
    g = np.random.default_rng(7)
    centre = g.normal(size=16)
    vecs = [(centre + g.normal(size=16) * s).tolist() for s in g.choice([0.05, 0.3, 1.0], 60)]
    vecs += [vecs[0], None, [0.0] * 16, [math.nan] * 16]
    labels = [i % 2 for i in range(60)] + [0, 0, 1, None]
    pq.write_table(pa.table({"vec_id": list(range(len(vecs))), "embedding": pa.array(vecs, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}), at / "embeddings.parquet")
    return str(at), dict(zip(ids, own, strict=True))


def rows_of(spark, folder, name, key="doc_id"):
    df = queries.QUERIES[name](spark, folder[0])
    return df, {r[key]: r for r in df.collect()}


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def plain_viterbi(run, cost):
    """Every reading of a run, by exhaustion: the cheapest one's cost."""
    s = toxicity._SYMBOL

    def readings(run):
        if not run:
            return [("", 0.0)]
        c, n = run[0], len(run) - len(run.lstrip(run[0]))
        if c.isspace():
            arcs = [("", toxicity.COST_DROP + (toxicity.COST_WIDE if n > 1 else 0)), (" ", toxicity.COST_GAP)]
        else:
            base = [(x, toxicity.COST_LEET) for x in toxicity.LEET[c]] + [("", toxicity.COST_SAME_DIGIT if c.isdigit() else toxicity.COST_DROP + 1)] if c in toxicity.LEET else [("", toxicity.COST_DROP)] if c in toxicity.SEPARATORS else [(c, 0.0)]
            arcs = []
            for x, k in base:
                arcs += [(x, k)] if not x or n == 1 else [(x, k + toxicity.COST_RUN * (1 if n > 2 else 2)), (2 * x, k + (toxicity.COST_PAIR if n > 2 else 0))]
        return [(x + y, k + m) for x, k in arcs for y, m in readings(run[n:])]

    def total(text, k):
        a = b = 0
        for c in text:
            a, b, k = b, int(s[ord(c)]), k + cost[a, b, int(s[ord(c)])]
        return k + cost[a, b, 0]

    return {t: total(t, k) for t, k in readings(run)}


def test_op1(spark, folder):
    df, got = rows_of(spark, folder, "op1_toxicity")
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and set(got) == set(folder[1])
    assert dict(df.dtypes) | {"predicted": "int", "score": "double", "held_out": "boolean"} == dict(df.dtypes)
    for i, r in got.items():
        assert r["held_out"] == (fold(i, 3) == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
    truth = {i: i < 240 and i % 5 < 2 for i in got if i < 300}
    held = [i for i in truth if got[i]["held_out"]]
    plain = [i for i in held if folder[1][i].isascii()]
    assert sum(got[i]["predicted"] == truth[i] for i in plain) >= 0.97 * len(plain) and got[309]["predicted"] == 1


def test_op1_decodes_like_exhaustion(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder[0]}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    for run in ("1d10t", "m0r0n", "m.o.r.o.n", "mooron", "p@th3", "i d i 0 t", "id  i1ot", "b00kk", "a--b"):
        every = plain_viterbi(run, model.cost)
        assert every[toxicity.decode(run, model.cost)] <= min(every.values()) + 1e-9, run


def test_op2(spark, folder):
    df, got = rows_of(spark, folder, "op2_secret_ledger")
    assert df.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"] and set(got) == set(folder[1])
    for i, t in folder[1].items():
        want = spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [want.count(k) for k in ("assign:", "access:", "hex:")]


def test_op3(spark, folder):
    from tokenizers import Tokenizer

    df = queries.op3_best_fit_packing(spark, folder[0])
    assert df.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    tok, docs, seqs = Tokenizer.from_file(P.path("word_bpe_49k.json")), defaultdict(list), defaultdict(list)
    for r in df.collect():
        docs[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(docs) == set(folder[1])
    for i, t in folder[1].items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, r in enumerate(sorted(docs[i], key=lambda r: r["piece"])):
            part = ids[4096 * k : 4096 * (k + 1)]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (k, 4096 * k, len(part), zlib.crc32(part.tobytes()))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(seqs) <= -(-sum(n for p in seqs.values() for _, n in p) // 4096) + 1


def test_op4(spark, folder):
    df, got = rows_of(spark, folder, "op4_quality_rules")
    assert df.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for i, t in folder[1].items():
        want = brute_rules(t)
        assert tuple(got[i][c] for c in df.columns[1:6]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])
    held = [i for i in got if i < 300 and fold(i, 3) == 1]
    assert sum(got[i]["kept"] == (i < 240) for i in held) >= 0.97 * len(held)


def test_op5(spark, folder):
    df, got = rows_of(spark, folder, "op5_quality_classifier")
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and set(got) == set(folder[1])
    for i, r in got.items():
        assert r["held_out"] == (fold(i, 3) == 1) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
    held = [i for i in got if i < 300 and got[i]["held_out"]]
    assert sum(got[i]["predicted"] == (i < 240) for i in held) >= 0.97 * len(held)
    assert got[305]["score"] == got[306]["score"] == got[307]["score"]  # no words, the same statistics
    docs, labels = (spark.read.parquet(f"{folder[0]}/{n}.parquet") for n in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels)
    g = np.random.default_rng(1)
    x = g.normal(size=(50, model.mean.shape[1]))
    logs = []
    for m, w, o in zip(model.mean, model.whiten, model.offset, strict=True):
        cov = np.linalg.inv(w.T @ w)
        half = 0.5 * np.linalg.slogdet(cov)[1]
        logs.append(np.array([-0.5 * (v - m) @ np.linalg.inv(cov) @ (v - m) for v in x]) + o)
        assert np.isfinite(half)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50))), atol=1e-8)


def test_op6(spark, folder):
    df, got = rows_of(spark, folder, "op6_substring_dedup")
    assert df.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    for i, (n, gone, kept) in brute_dedup(folder[1]).items():
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_op7(spark, folder):
    df, got = rows_of(spark, folder, "op7_embedding_join", "vec_id")
    assert df.columns[:4] == ["vec_id", "n_links", "component_id", "kept"]
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{folder[0]}/embeddings.parquet").collect()]
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == brute(rows)


def test_op8(spark, folder):
    import tiktoken

    df, got = rows_of(spark, folder, "op8_bpe_codec")
    assert df.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    import base64

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in folder[1].items():
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_op9(spark, folder):
    df, got = rows_of(spark, folder, "op9_ngram_jaccard_join")
    assert {i: (r["class_id"], r["n_links"], r["kept"]) for i, r in got.items()} == brute_links(folder[1])


def test_op10(spark, folder):
    df, got = rows_of(spark, folder, "op10_language_id")
    assert df.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and set(got) == set(folder[1])
    for i, r in got.items():
        assert r["held_out"] == (fold(i, 4) == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", folder[1][i] or ""))
    held = [i for i in got if got[i]["held_out"] and i < 240]
    assert all(got[i]["lang_pred"] == ("bb" if not folder[1][i].isascii() else "aa") for i in held)
    # naive Bayes by plain sums over one text's grams
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    model = language_id.fit(docs.where(queries.fold_of("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    for i in (1, 3, 300, 311, 312):
        raw = np.frombuffer(folder[1][i].encode(), np.uint8)
        _, b, _ = language_id.chunk_grams(raw, np.array([0, len(raw)]))
        total = [math.fsum(model.log_prob[b, k].astype(float)) + model.log_prior[k] for k in range(len(model.languages))]
        best = int(np.argmax(total))
        assert got[i]["lang_pred"] == model.languages[best]
        assert got[i]["score"] == pytest.approx(1 / math.fsum(math.exp(t - total[best]) for t in total), abs=1e-6)


def test_one_class_and_no_labels(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(20)
    for labels in ([], [(i, 1, 0) for i in range(20)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        tox = toxicity.predict(docs, toxicity.fit(docs, table)).collect()
        assert len(tox) == 20 and all(r["score"] < 0.7 for r in tox)
        good = quality_classifier.predict(docs, quality_classifier.fit(docs, table)).collect()
        assert len(good) == 20 and all(0 <= r["score"] <= 1 for r in good)


def test_packing_with_clashing_names(spark):
    from lodestem.llm import packing

    df = spark.createDataFrame([(1, "a b", 7, 8, 9), (1, "a b", 7, 8, 9), (2, None, 1, 1, 1)], "doc_id long, text string, length int, piece int, sequence_id int")
    rows = packing.pack(packing.pieces(df, P.path("word_bpe_49k.json"))).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in rows) == [(1, 0, 3), (1, 0, 3), (2, 0, 1)] and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
