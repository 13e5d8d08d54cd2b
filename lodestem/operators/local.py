"""Work on whole vectors where they lie: no pair of a query and a document is
shuffled, and folds need no lists.

Rows ``key, token, …`` are dealt by key and sorted by token once; what follows
reads them as Arrow batches of whole vectors and adds in the order they come in,
which is the order that ``ordered_sum`` sorts into.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numerics import PAIRWISE_BLOCK, Reduction, neumaier, pairwise

#: Query entries that are handed to every worker; beyond them, tables are joined.
MOST_ENTRIES = 1 << 20
#: Pairs of documents and queries that are scored at a time.
CELLS = 1 << 20
#: Documents without a term that are held until they get their scores.
BARE = 1 << 14


def arranged(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows dealt by key and sorted by token.  A window asks for just that, and
    unlike a repartition it makes no exchange where rows are dealt so already."""
    at = F.row_number().over(W.partitionBy(key).orderBy("token"))
    return rows.withColumn("__at", at).where("__at > 0").drop("__at")


@dataclass(frozen=True)
class Made:
    """Vectors like ``arranged`` ones that ``make`` makes of batches of ``docs``, in
    the worker that goes on with them; ids of documents without a term are added to
    the list that is its second argument."""

    docs: DataFrame
    make: Callable[[Iterable[pa.RecordBatch], list[str]], Iterator[pa.RecordBatch]]

    def rows(self, schema: str) -> DataFrame:
        return mapped(self, [c.split()[0] for c in schema.split(", ")], lambda batches: batches, schema)


def _session(rows: DataFrame | Made):
    return (rows.docs if isinstance(rows, Made) else rows).sparkSession


def mapped(rows: DataFrame | Made, columns: list[str], run, schema: str) -> DataFrame:
    """``run`` over the batches of whole vectors, whose first column is their key."""
    if not isinstance(rows, Made):
        return rows.where(F.col(columns[0]).isNotNull()).select(*columns).mapInArrow(run, schema)
    make = rows.make
    return rows.docs.mapInArrow(lambda batches: run(b.select(columns) for b in make(batches, [])), schema)


def whole(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The batches, cut so that no key lies in two tables."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        at = pc.index(b.column(key), b.column(key)[-1]).as_py()
        if at:
            yield pa.Table.from_batches([*held, b.slice(0, at)])
            held = [b.slice(at)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def groups(keys: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The place where each run of equal keys begins, and each row's run."""
    new = np.ones(len(keys), bool)
    new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy()
    return np.flatnonzero(new), np.cumsum(new) - 1


def sums(group: np.ndarray, values: np.ndarray, n: int, policy: Reduction = Reduction.NAIVE) -> np.ndarray:
    """Per group ``0 … n - 1``, its values added in the order they come in."""
    plain = np.bincount(group, values, n).astype(float)  # without rows, whole numbers
    if policy is Reduction.NAIVE:
        return plain
    sizes = np.bincount(group, minlength=n)
    v = values[np.argsort(group, kind="stable")]
    starts = np.cumsum(sizes) - sizes
    if policy is Reduction.EXACT:
        xs = v.tolist()
        return np.array([math.fsum(xs[a : a + s]) for a, s in zip(starts.tolist(), sizes.tolist(), strict=True)], float)
    if policy is Reduction.PAIRWISE:  # below a block, it is the plain sum
        for g in np.flatnonzero(sizes >= PAIRWISE_BLOCK):
            plain[g] = pairwise(v[starts[g] : starts[g] + sizes[g]].tolist())
        return plain
    total, lost = np.zeros(n), np.zeros(n)
    live = np.flatnonzero((sizes > 0) & (sizes <= PAIRWISE_BLOCK))
    step = 0
    while len(live):
        x, t = v[starts[live] + step], total[live]
        s = t + x
        lost[live] += np.where(np.abs(t) >= np.abs(x), (t - s) + x, (x - s) + t)
        total[live] = s
        step += 1
        live = live[sizes[live] > step]
    out = total + lost
    for g in np.flatnonzero(sizes > PAIRWISE_BLOCK):
        out[g] = neumaier(v[starts[g] : starts[g] + sizes[g]].tolist())
    return out


def folded_norms(rows: DataFrame | Made, key: str = "doc_id", policy: Reduction = Reduction.NAIVE) -> DataFrame:
    """``key, length, norm`` of ``arranged`` vectors."""

    def run(batches):
        for t in whole(batches, key):
            starts, of = groups(t[key])
            w = t["weight"].to_numpy()
            length = np.add.reduceat(t["cnt"].to_numpy(), starts)
            yield pa.RecordBatch.from_arrays([t[key].take(pa.array(starts)).combine_chunks(), pa.array(length, pa.int64()), pa.array(np.sqrt(sums(of, w * w, len(starts), policy)))], [key, "length", "norm"])

    return mapped(rows, [key, "cnt", "weight"], run, f"{key} string, length long, norm double")


def unit_rows(rows: DataFrame | Made, key: str = "doc_id", policy: Reduction = Reduction.NAIVE) -> DataFrame:
    """``key, token, weight`` of ``arranged`` vectors, each divided by its norm;
    zero vectors have none."""

    def run(batches):
        for t in whole(batches, key):
            starts, of = groups(t[key])
            w = t["weight"].to_numpy()
            norm = np.sqrt(sums(of, w * w, len(starts), policy))[of]
            t = t.set_column(2, "weight", pa.array(np.divide(w, norm, out=np.zeros_like(w), where=norm > 0)))
            yield from t.filter(pa.array(norm > 0)).to_batches()

    return mapped(rows, [key, "token", "weight"], run, f"{key} string, token string, weight double")


@dataclass(frozen=True)
class Postings:
    """The vectors of a bounded number of queries, by token."""

    ids: list[str]
    tokens: list[str]
    starts: np.ndarray
    sizes: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    rows: tuple[np.ndarray, np.ndarray]

    def norms(self, policy: Reduction) -> np.ndarray:
        of, w = self.rows
        return np.sqrt(sums(of, w * w, len(self.ids), policy))


def postings(query_vectors: DataFrame, query_ids: DataFrame | None = None) -> Postings | None:
    """None, if there are too many entries for a worker to hold."""
    got = query_vectors.select("query_id", "token", "weight").where(F.col("query_id").isNotNull()).limit(MOST_ENTRIES + 1).collect()
    if len(got) > MOST_ENTRIES:
        return None
    got.sort(key=lambda r: (r["query_id"].encode(), r["token"].encode()))
    ids = {r["query_id"] for r in got}
    if query_ids is not None:
        more = query_ids.select("query_id").distinct().limit(MOST_ENTRIES + 1).collect()
        if len(more) > MOST_ENTRIES:
            return None
        ids |= {r["query_id"] for r in more}
    names = sorted(ids)
    at = {q: i for i, q in enumerate(names)}
    of = np.array([at[r["query_id"]] for r in got], np.int64)
    w = np.array([r["weight"] for r in got], float)
    tokens = sorted({r["token"] for r in got})
    place = {t: i for i, t in enumerate(tokens)}
    token = np.array([place[r["token"]] for r in got], np.int64)
    order = np.argsort(token, kind="stable")
    sizes = np.bincount(token, minlength=len(tokens)).astype(np.int64)
    return Postings(names, tokens, np.cumsum(sizes) - sizes, sizes, of[order], w[order], (of, w))


def _blocks(table: pa.Table, p: Postings) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Parts of a table of whole vectors with at most ``CELLS`` pairs (or one
    document), each with the places where documents begin and every row's."""
    starts, _ = groups(table["doc_id"])
    ends = np.append(starts[1:], table.num_rows)
    many = max(1, CELLS // max(1, len(p.ids)))
    for lo in range(0, len(starts), many):
        hi = min(lo + many, len(starts))
        part = table.slice(starts[lo], ends[hi - 1] - starts[lo])
        yield part, *groups(part["doc_id"])


def _terms(part: pa.Table, of: np.ndarray, p: Postings, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (document x queries + query) and the products of their common
    terms, in token order within each pair."""
    token = pc.fill_null(pc.index_in(part["token"], value_set=values), -1).to_numpy()
    rows = np.flatnonzero(token >= 0)
    token = token[rows]
    sizes = p.sizes[token]
    upto = np.cumsum(sizes)
    entry = np.arange(upto[-1] if len(upto) else 0) + np.repeat(p.starts[token] - (upto - sizes), sizes)
    pair = np.repeat(of[rows], sizes) * len(p.ids) + p.query[entry]
    return pair, p.weight[entry] * np.repeat(part["weight"].to_numpy()[rows], sizes)


def _dots(part: pa.Table, of: np.ndarray, n: int, p: Postings, values: pa.Array, policy: Reduction, touched: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Documents x queries: the sums of the products of their common terms and,
    where asked, the pairs that have any.  Plain sums are made a token at a time, in
    token order; what a query lacks adds 0, which changes no sum."""
    many = len(p.ids)
    if policy is not Reduction.NAIVE:
        pair, x = _terms(part, of, p, values)
        return sums(pair, x, n * many, policy), np.flatnonzero(np.bincount(pair, minlength=n * many)) if touched else None
    token = pc.fill_null(pc.index_in(part["token"], value_set=values), -1).to_numpy()
    rows = np.flatnonzero(token >= 0)
    rows = rows[np.argsort(token[rows], kind="stable")]
    token, doc, w = token[rows], of[rows], part["weight"].to_numpy()[rows]
    cuts = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token)) if len(token) else np.zeros(1, int)
    dot, seen = np.zeros((n, many)), np.zeros((n, many), bool)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        t = token[lo]
        at = slice(p.starts[t], p.starts[t] + p.sizes[t])
        q, d = p.query[at], doc[lo:hi]
        if len(q) * 16 > many:
            line = np.zeros(many)
            line[q] = p.weight[at]
            dot[d] += w[lo:hi, None] * line
        else:
            dot[d[:, None], q] += w[lo:hi, None] * p.weight[at]
        if touched:
            seen[d[:, None], q] = True
    return dot.ravel(), np.flatnonzero(seen.ravel()) if touched else None


def _cosines(dot: np.ndarray, both: np.ndarray) -> np.ndarray:
    return np.divide(dot, both, out=np.zeros_like(dot), where=both != 0)


def score(weights: DataFrame | Made, p: Postings, policy: Reduction = Reduction.NAIVE, dense: bool = False) -> DataFrame:
    """``query_id, doc_id, score`` of ``arranged`` documents that share a term
    with the query; with ``dense``, of every query and document with a term, and of
    those without one, if the vectors are made of them."""
    held = _session(weights).sparkContext.broadcast(p)

    def run(batches):
        p = held.value
        names, values, qn = pa.array(p.ids, pa.string()), pa.array(p.tokens, pa.string()), p.norms(policy)
        for table in whole(batches, "doc_id"):
            for part, starts, of in _blocks(table, p):
                n, w = len(starts), part["weight"].to_numpy()
                norm = np.sqrt(sums(of, w * w, n, policy))
                dot, cell = _dots(part, of, n, p, values, policy, touched=not dense)
                cell = np.arange(n * len(p.ids)) if dense else cell
                doc, query = np.divmod(cell, max(1, len(p.ids)))
                got = _cosines(dot[cell], qn[query] * norm[doc])
                ids = part["doc_id"].take(pa.array(starts)).combine_chunks()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), ids.take(pa.array(doc)), pa.array(got)], ["query_id", "doc_id", "score"])

    columns, schema = ["doc_id", "token", "weight"], "query_id string, doc_id string, score double"
    if not dense or not isinstance(weights, Made):
        return mapped(weights, columns, run, schema)
    make = weights.make

    def run_all(batches):
        names, bare = pa.array(held.value.ids, pa.string()), []

        def zeros():
            for lo in range(0, len(bare) if len(names) else 0, many := max(1, CELLS // max(1, len(names)))):
                ids = pa.array(bare[lo : lo + many], pa.string())
                doc, query = np.divmod(np.arange(len(ids) * len(names)), len(names))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), ids.take(pa.array(doc)), pa.array(np.zeros(len(doc)))], ["query_id", "doc_id", "score"])
            bare.clear()

        for b in run(b.select(columns) for b in make(batches, bare)):
            yield b
            if len(bare) > BARE:
                yield from zeros()
        yield from zeros()

    return weights.docs.mapInArrow(run_all, schema)


def leading(weights: DataFrame | Made, p: Postings, k: int, slack: float, policy: Reduction = Reduction.NAIVE) -> DataFrame:
    """``query_id, doc_id, score`` of all scores above 0 that are among the best
    ``k`` of their query or less than ``slack`` below them, and some more: every
    part leaves out what it has seen ``k`` better ones of."""
    held = _session(weights).sparkContext.broadcast(p)

    def run(batches):
        p = held.value
        names, values, qn = pa.array(p.ids, pa.string()), pa.array(p.tokens, pa.string()), p.norms(policy)
        best = np.zeros((k, len(p.ids)))
        for table in whole(batches, "doc_id"):
            for part, starts, of in _blocks(table, p):
                n, w = len(starts), part["weight"].to_numpy()
                norm = np.sqrt(sums(of, w * w, n, policy))
                got = _cosines(_dots(part, of, n, p, values, policy)[0], np.tile(qn, n) * np.repeat(norm, len(p.ids))).reshape(n, len(p.ids))
                best = np.partition(np.concatenate([best, got]), n, axis=0)[n:]
                doc, query = np.nonzero((got > 0) & (got >= best.min(axis=0) - slack))
                ids = part["doc_id"].take(pa.array(starts)).combine_chunks()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), ids.take(pa.array(doc)), pa.array(got[doc, query])], ["query_id", "doc_id", "score"])

    return mapped(weights, ["doc_id", "token", "weight"], run, "query_id string, doc_id string, score double")


def disagreements(weights: DataFrame | Made, p: Postings, policies: tuple[Reduction, ...]) -> DataFrame:
    """``policy, n, n_differing, max_abs, max_ulps`` of the scores of each policy
    against exactly rounded sums, a row per part: nothing but these is kept."""
    held = _session(weights).sparkContext.broadcast(p)

    def run(batches):
        p = held.value
        values = pa.array(p.tokens, pa.string())
        every = (Reduction.EXACT, *policies)
        qn = {r: p.norms(r) for r in every}
        found = {r: [0, 0, 0.0, 0] for r in policies}
        for table in whole(batches, "doc_id"):
            for part, starts, of in _blocks(table, p):
                n, w = len(starts), part["weight"].to_numpy()
                pair, x = _terms(part, of, p, values)
                cell, pair = np.unique(pair, return_inverse=True)
                doc, query = np.divmod(cell, max(1, len(p.ids)))
                got = {r: _cosines(sums(pair, x, len(cell), r), qn[r][query] * np.sqrt(sums(of, w * w, n, r))[doc]) for r in every}
                exact = got[Reduction.EXACT]
                for r in policies:
                    gap = np.abs(got[r] - exact)
                    apart = np.abs(got[r].view(np.int64) - exact.view(np.int64))
                    f = found[r]
                    found[r] = [f[0] + len(cell), f[1] + int((gap > 0).sum()), max(f[2], float(gap.max(initial=0.0))), max(f[3], int(apart.max(initial=0)))]
        yield pa.RecordBatch.from_pydict({"policy": [r.value for r in policies], **{c: [found[r][i] for r in policies] for i, c in enumerate(("n", "n_differing", "max_abs", "max_ulps"))}})

    return mapped(weights, ["doc_id", "token", "weight"], run, "policy string, n long, n_differing long, max_abs double, max_ulps long")


# ------------------------------------------------------ two sides of an edit
def paired(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """Both sides' rows ``key, token, side, weight, …``, arranged together."""
    more = [c for c in before.columns if c not in (key, "token", "weight")]
    rows = before.select(key, "token", F.lit(False).alias("side"), "weight", *more).unionByName(after.select(key, "token", F.lit(True).alias("side"), "weight", *more))
    return arranged(rows.where(F.col(key).isNotNull()), key)


def _entries(t: pa.Table, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one document and token, on whichever sides, are one entry: each
    row's entry, and each entry's document."""
    token = t["token"]
    new = np.ones(t.num_rows, bool)
    new[1:] = pc.not_equal(token.slice(1), token.slice(0, t.num_rows - 1)).to_numpy() | (np.diff(of) > 0)
    return np.cumsum(new) - 1, of[new]


def difference(pairs: DataFrame | Made, key: str, policy: Reduction) -> DataFrame:
    """``key, difference``: length of the difference of ``paired`` vectors."""

    def run(batches):
        for t in whole(batches, key):
            starts, of = groups(t[key])
            at, doc = _entries(t, of)
            after, w = t["side"].to_numpy(), t["weight"].to_numpy()
            d = np.bincount(at, np.where(after, w, 0.0)) - np.bincount(at, np.where(after, 0.0, w))
            yield pa.RecordBatch.from_arrays([t[key].take(pa.array(starts)).combine_chunks(), pa.array(np.sqrt(sums(doc, d * d, len(starts), policy)))], [key, "difference"])

    return mapped(pairs, [key, "token", "side", "weight"], run, f"{key} string, difference double")


PARTS = ("observed", "tf", "dtf", "shared_shift", "gained_mass", "lost_mass")


def shift_parts(pairs: DataFrame | Made) -> DataFrame:
    """``doc_id`` and the lengths ``PARTS`` of ``paired`` vectors with ``tf`` and
    ``alone`` (the other side's vocabulary lacks the token)."""

    def run(batches):
        for t in whole(batches, "doc_id"):
            starts, of = groups(t["doc_id"])
            at, doc = _entries(t, of)
            after, alone, w, tf = (t[c].to_numpy() for c in ("side", "alone", "weight", "tf"))
            side = lambda x, second: np.bincount(at, np.where(after == second, x, 0.0))  # noqa: E731, B023
            old, new, tf1 = side(w, False), side(w, True), side(tf, False)
            gained, lost = side(alone, True) > 0, side(alone, False) > 0
            diff = new - old
            cols = (diff, tf1, side(tf, True) - tf1, np.where(gained | lost, 0.0, diff), np.where(gained, new, 0.0), np.where(lost, old, 0.0))
            yield pa.RecordBatch.from_arrays([t["doc_id"].take(pa.array(starts)).combine_chunks(), *[pa.array(np.sqrt(sums(doc, x * x, len(starts)))) for x in cols]], ["doc_id", *PARTS])

    return mapped(pairs, ["doc_id", "token", "side", "alone", "weight", "tf"], run, "doc_id string, " + ", ".join(f"{c} double" for c in PARTS))


def score_both(pairs: DataFrame | Made, p: Postings, q: Postings, policies: tuple[Reduction, Reduction]) -> DataFrame:
    """``query_id, doc_id, score_before, score_after`` of ``paired`` documents
    that share a term with the query on one side.  Both sides' postings hold the
    same queries."""
    held = _session(pairs).sparkContext.broadcast((p, q))

    def run(batches):
        both = held.value
        names = pa.array(both[0].ids, pa.string())
        values, qn = [pa.array(x.tokens, pa.string()) for x in both], [x.norms(r) for x, r in zip(both, policies, strict=True)]
        for table in whole(batches, "doc_id"):
            for part, starts, of in _blocks(table, both[0]):
                n, after = len(starts), part["side"].to_numpy()
                cells = n * len(both[0].ids)
                seen, scores = np.zeros(cells, bool), []
                for second, (x, v, norms, policy) in enumerate(zip(both, values, qn, policies, strict=True)):
                    rows = np.flatnonzero(after == bool(second))
                    one, own = part.take(pa.array(rows)), of[rows]
                    w = one["weight"].to_numpy()
                    dot, pair = _dots(one, own, n, x, v, policy, touched=True)
                    seen[pair] = True
                    norm = np.sqrt(sums(own, w * w, n, policy))
                    scores.append(_cosines(dot, np.tile(norms, n) * np.repeat(norm, len(x.ids))))
                cell = np.flatnonzero(seen)
                doc, query = np.divmod(cell, max(1, len(both[0].ids)))
                ids = part["doc_id"].take(pa.array(starts)).combine_chunks()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), ids.take(pa.array(doc)), pa.array(scores[0][cell]), pa.array(scores[1][cell])], ["query_id", "doc_id", "score_before", "score_after"])

    return mapped(pairs, ["doc_id", "token", "side", "weight"], run, "query_id string, doc_id string, score_before double, score_after double")


# ------------------------------------------------------------- whole rankings
#: Documents whose ranking a worker holds, at about 60 bytes each.
MOST_RANKED = 1 << 23
#: Queries that share a copy of the attributes where they take a score or a bit of
#: each document, and rows of a batch.
TOGETHER, BESIDE, BATCH = 4, 8, 100_000


def _by_query(weights: DataFrame | Made, p: Postings, attributes: DataFrame, names: list[str], together: int, kind: pa.DataType, cells, answer, schema: str, change=None) -> DataFrame:
    """What ``answer`` makes of each query in one worker.  What is shuffled is a row of
    ``cells``, of type ``kind``, for each query and block of documents, and ids and the
    ranks ``names`` of ``attributes`` once for ``together`` queries, so nothing is
    sorted or spilled.  ``cells(p)`` gives a function of a block to such rows;
    ``answer(p, ids, code, n, ranks)``, with the ids and ranks of attributes and each
    one's place among the ``n`` different ids, one of a query and its pairs of places
    and row to batches."""
    spark = _session(weights)
    parts = max(1, -(-len(p.ids) // together))
    # keys that are dealt to a partition each
    dealt = {r[1]: r[0] for r in spark.range(40 * parts).selectExpr("cast(id as int) k", f"pmod(hash(cast(id as int)), {parts}) p").orderBy(F.desc("k")).collect()}
    keys = [dealt.get(i, i) for i in range(parts)]
    held = spark.sparkContext.broadcast(p)
    many = pa.types.is_list(kind)
    sent = f"part int, query int, block string, ids array<string>, cells {'array<double>' if many else 'binary'}, ranks array<int>"
    kinds = pa.schema([("part", pa.int32()), ("query", pa.int32()), ("block", pa.string()), ("ids", pa.list_(pa.string())), ("cells", kind), ("ranks", pa.list_(pa.int32()))])

    def blocks(batches):
        p, at = held.value, TaskContext.get().partitionId()
        make, n_blocks = cells(p), 0
        for table in whole(batches, "doc_id"):
            for part, starts, of in _blocks(table, p):
                block, n_blocks = f"{at}-{n_blocks}", n_blocks + 1
                ids = part["doc_id"].take(pa.array(starts)).to_pylist()
                for k in keys:
                    yield pa.RecordBatch.from_pylist([{"part": k, "query": -1, "block": block, "ids": ids}], kinds)
                for q, row in enumerate(make(part, of, len(starts))):
                    yield pa.RecordBatch.from_arrays([pa.array([keys[q % parts]], pa.int32()), pa.array([q], pa.int32()), pa.array([block]), pa.nulls(1, kinds.field("ids").type), row, pa.nulls(1, kinds.field("ranks").type)], schema=kinds)

    def described(batches):
        at = TaskContext.get().partitionId()
        for i, b in enumerate(batches):
            ids, ranks = b.column("doc_id").to_pylist(), np.stack([b.column(n).to_numpy() for n in names], 1).ravel().tolist() if names else []
            for k in keys:
                yield pa.RecordBatch.from_pylist([{"part": k, "query": -2, "block": f"{at}-{i}", "ids": ids, "ranks": ranks}], kinds)

    def ranked(batches):
        p, said, ids_of, cells_of, mine = held.value, {}, {}, {}, set()
        for b in batches:
            for i in range(b.num_rows):
                q, block = b.column("query")[i].as_py(), b.column("block")[i].as_py()
                if q == -2:
                    mine.add(b.column("part")[i].as_py())
                    said.setdefault(block, (b.column("ids")[i].values, b.column("ranks")[i].values.to_numpy()))
                elif q == -1:
                    ids_of.setdefault(block, b.column("ids")[i].values)
                else:
                    row = b.column("cells")[i]
                    cells_of.setdefault(q, {})[block] = row.values.to_numpy() if many else row.as_py()
        if not said:
            return
        ids = pa.chunked_array([x[0] for x in said.values()]).combine_chunks()
        ranks = np.concatenate([x[1] for x in said.values()]).reshape(len(ids), len(names))
        each = ids.unique()  # an id may have several rows of attributes
        places = {k: pc.fill_null(pc.index_in(x, value_set=each), -1).to_numpy() for k, x in ids_of.items()}
        make = answer(p, ids, pc.index_in(ids, value_set=each).to_numpy(), len(each), ranks)
        for q in (q for i, k in enumerate(keys) if k in mine for q in range(i, len(p.ids), parts)):
            yield from make(q, [(places[block], x) for block, x in cells_of.pop(q, {}).items()])

    rows = mapped(weights, ["doc_id", "token", "weight"], blocks, sent)
    rows = rows if change is None else rows.withColumn("cells", change("cells"))
    more = attributes.where("doc_id is not null").select("doc_id", *[F.col(n).cast("int").alias(n) for n in names]).mapInArrow(described, sent)
    return rows.unionByName(more).repartition(parts, "part").mapInArrow(ranked, schema)


def rank_rows(weights: DataFrame | Made, p: Postings, attributes: DataFrame, operators: dict[str, list[str]], digits: int, policy: Reduction = Reduction.NAIVE) -> DataFrame:
    """``query_id, doc_id, score, rnk_<operator> …`` of every query and document
    with ``attributes(doc_id, ranks …)``.  Lists of scores travel; each query is ranked
    in memory.  Scores are rounded to ``digits`` before."""
    names = sorted({n for o in operators.values() for n in o})

    def cells(p):
        values, qn = pa.array(p.tokens, pa.string()), p.norms(policy)

        def make(part, of, n):
            w = part["weight"].to_numpy()
            norm = np.sqrt(sums(of, w * w, n, policy))
            got = _cosines(_dots(part, of, n, p, values, policy)[0], np.tile(qn, n) * np.repeat(norm, len(p.ids))).reshape(n, len(p.ids))
            for q in range(len(p.ids)):
                yield pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(np.ascontiguousarray(got[:, q])))

        return make

    def answer(p, ids, code, n, ranks):
        by_id = np.empty(len(ids), np.int64)
        by_id[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        orders = {o: np.lexsort((by_id, *[ranks[:, names.index(x)] for x in reversed(cols)])) for o, cols in operators.items()}

        def make(q, got):
            score = np.zeros(n)
            for at, x in got:
                score[at[at >= 0]] = x[at >= 0]
            score, out = score[code], {}
            for o, order in orders.items():
                out[o] = np.empty(len(ids), np.int64)
                out[o][order[np.argsort(-score[order], kind="stable")]] = np.arange(1, len(ids) + 1)
            for lo in range(0, len(ids), BATCH):
                cut = slice(lo, lo + BATCH)
                some = ids[cut]
                yield pa.RecordBatch.from_arrays([pa.array([p.ids[q]]).take(pa.array(np.zeros(len(some), np.int64))), some, pa.array(score[cut]), *[pa.array(x[cut]) for x in out.values()]], ["query_id", "doc_id", "score", *[f"rnk_{o}" for o in out]])

        return make

    schema = "query_id string, doc_id string, score double, " + ", ".join(f"rnk_{o} long" for o in operators)
    return _by_query(weights, p, attributes, names, TOGETHER, pa.list_(pa.float64()), cells, answer, schema, lambda c: F.transform(c, lambda x: F.round(x, digits)))


def subset_rows(weights: DataFrame | Made, p: Postings, attributes: DataFrame, names: list[str]) -> DataFrame:
    """``query_id, doc_id, ranks …`` of the documents that share a term with the query,
    each rank of ``attributes`` dense among those: a bit of each document travels."""
    missing = 2147483647

    def cells(p):
        values = pa.array(p.tokens, pa.string())

        def make(part, of, n):
            seen = np.zeros(n * len(p.ids), bool)
            seen[_dots(part, of, n, p, values, Reduction.NAIVE, touched=True)[1]] = True
            for row in np.packbits(seen.reshape(n, len(p.ids)).T, axis=1):
                yield pa.array([row.tobytes()], pa.binary())

        return make

    def dense(r):
        out, ok = r.copy(), (r >= 0) & (r != missing)
        seen = np.zeros(r[ok].max(initial=-1) + 1, bool)
        seen[r[ok]] = True
        out[ok] = (np.cumsum(seen) - 1)[r[ok]]
        return np.where(r < 0, -1, out).astype(np.int32)

    def answer(p, ids, code, n, ranks):
        def make(q, got):
            among = np.zeros(n, bool)
            for at, x in got:
                at = at[np.unpackbits(np.frombuffer(x, np.uint8), count=len(at)).astype(bool)]
                among[at[at >= 0]] = True
            rows = np.flatnonzero(among[code])
            out = [dense(ranks[rows, i]) for i in range(len(names))]
            for lo in range(0, len(rows), BATCH):
                cut = slice(lo, lo + BATCH)
                some = ids.take(pa.array(rows[cut]))
                yield pa.RecordBatch.from_arrays([pa.array([p.ids[q]]).take(pa.array(np.zeros(len(some), np.int64))), some, *[pa.array(x[cut]) for x in out]], ["query_id", "doc_id", *names])

        return make

    return _by_query(weights, p, attributes, names, BESIDE, pa.binary(), cells, answer, "query_id string, doc_id string, " + ", ".join(f"{n} int" for n in names))
