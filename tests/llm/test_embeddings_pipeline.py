"""Embedding join against brute force; the pipeline on a small folder."""

import numpy as np
import pytest

from lodestem.llm import embedding_join
from lodestem.llm.graph import components


def brute(rows, threshold=0.93):
    good = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = (np.array(v, float), lab)
    ids = sorted(good)
    n, comp = dict.fromkeys(ids, 0), {i: i for i in ids}
    pairs = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            (u, p), (v, q) = good[a], good[b]
            if p == q and len(u) == len(v) and u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= threshold:
                pairs.append((a, b))
                n[a] += 1
                n[b] += 1
    for _ in ids:
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (n.get(i, 0), comp.get(i, i), comp.get(i, i) == i) for i, _, _ in rows if i is not None}


@pytest.mark.parametrize("chunk", [2048, 16])
def test_embedding_join(spark, monkeypatch, chunk):
    g = np.random.default_rng(3)
    rows, i = [], 0
    for lab in (0, 1, 1, 2):
        centre = g.normal(size=16)
        for _ in range(25):
            rows.append((i, (centre + g.normal(size=16) * g.choice([0.05, 0.3, 1.0])).tolist(), lab))
            i += 1
    rows += [(i + k, rows[3][1], 0) for k in range(5)]  # copies
    i += 5
    rows += [(i, None, 0), (i + 1, [0.0] * 16, 0), (i + 2, [float("nan")] * 16, 1), (i + 3, [float("inf")] + [1.0] * 15, 1), (i + 4, [None] + [1.0] * 15, 1), (i + 5, rows[0][1], None), (i + 6, [1.0, 2.0], 0), (i + 7, [2.0, 4.0], 0), (i + 8, [], 0)]
    rows.append((None, rows[0][1], 0))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    exact = [(r[0], r[1], r[2]) for r in df.collect()]
    monkeypatch.setattr(embedding_join, "CHUNK", chunk)
    monkeypatch.setattr(embedding_join, "LEAF", 64 if chunk == 16 else embedding_join.LEAF)
    monkeypatch.setattr(embedding_join, "VERIFIED", 50)
    got = embedding_join.near_duplicates(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None} == brute(exact)
    assert len(got) == len(rows)
    assert embedding_join.near_duplicates(df.limit(0)).collect() == []


def test_hot_label_of_planted_vectors(spark):
    """Production constants; one label fills many cells, some beyond a chunk."""
    g = np.random.default_rng(9)
    centres = g.normal(size=(40, 64))
    noise = np.concatenate([g.normal(size=(3000, 64)), np.repeat(centres, 60, 0) + g.normal(size=(2400, 64)) * 0.25, centres[0] + g.normal(size=(4500, 64)) * 0.27])
    vecs = np.concatenate([noise, noise[:50], g.normal(size=(300, 64))]).astype(np.float32)
    label = np.where(np.arange(len(vecs)) < len(noise) + 50, 1, 2)
    df = spark.createDataFrame([(i, v.tolist(), int(x)) for i, (v, x) in enumerate(zip(vecs, label, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_join.near_duplicates(df).collect()}
    u = vecs.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    assert link.sum() > 1e6
    assert [got[i]["n_links"] for i in range(len(vecs))] == link.sum(1).tolist()
    comp = embedding_join.spanned(len(vecs), *np.nonzero(link))
    assert [got[i]["component_id"] for i in range(len(vecs))] == comp.tolist()


def test_leaves_hold_every_pair_of_neighbours_once(monkeypatch):
    monkeypatch.setattr(embedding_join, "LEAF", 9)
    g = np.random.default_rng(2)
    cells = g.integers(0, 5, (60, 3))
    near = lambda i, j: bool((abs(cells[i] - cells[j]) <= 1).all())
    for a, b in ((np.arange(60), None), (np.arange(25), np.arange(25, 60))):
        seen = []
        for x, y in embedding_join.leaves(cells, a, b):
            seen += [(i, j) for i in x for j in (x if y is None else y) if y is not None or i < j]
        seen = [tuple(sorted(p)) for p in seen]
        assert len(seen) == len(set(seen))
        assert {p for p in seen if near(*p)} == {(i, j) for i in a for j in (a if b is None else b) if i < j and near(i, j)}


def test_repeated_vector_ids(spark):
    one, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, one, 0), (1, one, 0), (1, other, 0), (2, other, 0), (3, [1e-200, 0.0, 0.0], 0), (4, [0.0, 1e200, 0.0], 0)]
    got = embedding_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 2, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 2, 1, False)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 120), (120, 110), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 110: 100, 120: 100}
    g = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in g.integers(0, 300, (220, 2))]  # several rounds
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = embedding_join.spanned(300, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert got == {n: int(label[n]) for e in edges for n in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.fixture
def folder(spark, tmp_path):
    from tests.llm.test_documents import BASE, PASSAGE, edited, prose

    texts = [BASE, edited(BASE, 5, 60), prose(40, 1), prose(30, 22) + " " + PASSAGE, PASSAGE + " " + prose(30, 3), "too short", "a b c d e " * 40, prose(20, 4) + " password=abcdefghijklmnop1", None, ""]
    rows = [(i, t, "en", "s", len(t or ""), f"x{i}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline(spark, folder):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    cols, seen = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == cols, name
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(seen["quality_rules"]) == {0, 1, 2, 3, 4, 7}
    assert set(seen["ngram_jaccard_join"]) == {0, 2, 3, 4, 7}
    assert seen["substring_dedup"][4]["text"] != seen["ngram_jaccard_join"][4]["text"] and seen["substring_dedup"][4]["n_chars"] == len(seen["substring_dedup"][4]["text"])
    assert seen["secret_scans"][7]["text"].endswith("[secret]") and seen["secret_scans"][2]["text"] == seen["quality_rules"][2]["text"]
    assert {r["doc_id"] for r in cp.run(spark, folder).collect()} == {0, 2, 3, 4, 7}


def test_pipeline_of_nothing(spark, folder, tmp_path):
    import corpus_pipeline as cp

    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "e/documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(str(tmp_path / "e/labels.parquet"))
    assert cp.run(spark, str(tmp_path / "e")).collect() == []
