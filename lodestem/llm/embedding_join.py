"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors whose cosine reaches the threshold are within a squared distance
of ``2 - 2 * threshold``.  Rotated to principal axes and split into blocks whose
shares of that budget follow their shares of the variance, a linked pair keeps
within the budget of at least one block.  So every block is range-joined by
itself: vectors are dealt to the cells of a grid over its leading axes, and to
the neighbouring cells that are within reach; inside a cell, strips as wide as
the reach part the other axes.  A pair that several blocks find belongs to the
first of them, and the union of the candidates is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mix64, parts_of, signed, staged
from .graph import components, runs

THRESHOLD = 0.93
BLOCKS = 4
#: Distinct vectors of one side of a task.  Labels with no more are joined whole.
CHUNK = 2048
#: Axes of a block that make its grid.
GRID_AXES = 3
#: Pairs that are compared at once; larger sets are parted into strips first.
LEAF = 1 << 16
#: Candidate pairs that are verified at once.
VERIFIED = 1 << 14
#: Added to every squared distance that is compared: for the candidates' single
#: precision, and for the coordinates' rounding.
SLACK, ROUNDING = 1e-4, 1e-5


@dataclass(frozen=True)
class Rotation:
    """Principal axes, the axes of each block, the squared reach of each block,
    and the spread of the vectors along each axis."""

    axes: np.ndarray
    blocks: tuple[np.ndarray, ...]
    reach2: np.ndarray
    spread: np.ndarray


def usable(vec: str) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    x = F.col(vec)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column, dim: int, kind=np.float64) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
    if kind is not np.float64 or not len(raw):
        return raw
    # by a power of two, exactly: squares of very large and small numbers stay in range
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(1))[1][:, None])


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw**2).sum(1, keepdims=True))


def rotation(vectors: DataFrame, dim: int, threshold: float = THRESHOLD, blocks: int = BLOCKS) -> Rotation:
    """From the second moments of all unit vectors, summed on the executors
    (``dim * dim`` numbers).  Axes are dealt out to the blocks in turn."""

    def run(batches):
        total = np.zeros((dim, dim))
        n = 0
        for batch in batches:
            u = _unit(_matrix(batch.column(0), dim))
            total += u.T @ u
            n += len(u)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim + 1, dtype=np.int32)), pa.array(np.append(total.ravel(), n))], names=["i", "v"])

    got = vectors.select("vec").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    m = np.zeros(dim * dim + 1)
    m[got.column("i").to_numpy()] = got.column("v").to_numpy()
    value, axes = np.linalg.eigh(m[:-1].reshape(dim, dim) / max(m[-1], 1))
    value, axes = np.maximum(value[::-1], 0) + 1e-12, np.ascontiguousarray(axes[:, ::-1])
    parts = tuple(np.arange(b, dim, min(blocks, dim)) for b in range(min(blocks, dim)))
    share = np.array([value[b].sum() for b in parts])
    return Rotation(axes, parts, max(0.0, 2 - 2 * threshold) * share / share.sum() + ROUNDING, np.sqrt(value))


# ------------------------------------------------------------ inside a task
def leaves(cells: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Pairs of row sets whose cells differ by one at most along every axis that
    was needed to make them small; ``b`` None stands for the pairs inside ``a``.
    Together they hold every pair of neighbours once."""
    stack: list[tuple[np.ndarray, np.ndarray | None, int]] = [(a, b, 0)]
    while stack:
        a, b, axis = stack.pop()
        if not len(a) or b is not None and not len(b):
            continue
        if axis == cells.shape[1] or len(a) * len(a if b is None else b) <= LEAF:
            yield a, b
            continue
        strips = []
        for rows in (a, a if b is None else b):
            key = cells[rows, axis]
            order = np.argsort(key, kind="stable")
            names, first = np.unique(key[order], return_index=True)
            strips.append(dict(zip(names.tolist(), np.split(rows[order], first[1:]), strict=True)))
        for name, rows in strips[0].items():
            if b is None:
                stack.append((rows, None, axis + 1))
                if name + 1 in strips[0]:
                    stack.append((rows, strips[0][name + 1], axis + 1))
            else:
                stack += [(rows, strips[1][k], axis + 1) for k in (name - 1, name, name + 1) if k in strips[1]]


def linked_pairs(raw: np.ndarray, turned: np.ndarray, label: np.ndarray, rot: Rotation, threshold: float, block: int | None, home: np.ndarray, guests: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``(rows, other rows, number of candidates)`` of the pairs that link, among
    ``home`` or between it and ``guests``, and that ``block`` (None: any) is the
    first to have within its reach."""
    norm = np.sqrt((raw**2).sum(1))
    for k in range(len(rot.blocks)) if block is None else (block,):
        axes = rot.blocks[k]
        y = np.ascontiguousarray(turned[:, axes])
        square = (y**2).sum(1)
        cells = np.floor(y.astype(np.float64) / (np.sqrt(rot.reach2[k]) * (1 + 1e-6))).astype(np.int64)
        for a, b in leaves(cells, home, guests):
            c = a if b is None else b
            step = max(1, LEAF // len(c))
            for lo in range(0, len(a), step):
                p = a[lo : lo + step]
                near = square[p][:, None] + square[c][None, :] - 2 * (y[p] @ y[c].T) <= np.float32(rot.reach2[k] + SLACK)
                if b is None:
                    near &= np.arange(lo, lo + len(p))[:, None] < np.arange(len(c))[None, :]
                i, j = np.nonzero(near)
                i, j = p[i], c[j]
                for e in range(0, len(i), VERIFIED):
                    u, v = i[e : e + VERIFIED], j[e : e + VERIFIED]
                    yield *_verified(raw, norm, turned, label, rot, threshold, k, u, v), len(u)


def _verified(raw: np.ndarray, norm: np.ndarray, turned: np.ndarray, label: np.ndarray, rot: Rotation, threshold: float, block: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    link = (np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= threshold) & (label[i] == label[j])
    i, j = i[link], j[link]
    apart = (turned[i].astype(np.float64) - turned[j]) ** 2
    inside = lambda k: np.add.reduce(np.ascontiguousarray(apart[:, rot.blocks[k]].T), axis=0) <= rot.reach2[k]
    own = inside(block)
    for k in range(block):
        own &= ~inside(k)
    return i[own], j[own]


def spanned(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows reaches over the pairs."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row.

    Rows link when their labels are equal and not null, their sizes are equal
    and their cosine reaches the threshold.  Null, zero and non-finite vectors
    link with nothing.  Equal vectors of a label are one class until the end:
    each of its rows counts the others and every row of a linked class.  Rows
    that repeat an id are rows of their own, with one component if they are
    equal.  Rows without an id link with nothing and are kept.  No rows give no
    rows.
    """
    base = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), _numbers(vectors, vec_col).alias("vec"))
    good = base.where(usable("vec") & F.col("label").isNotNull() & F.col("id").isNotNull())
    named = good.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    classes = staged(named.select(F.monotonically_increasing_id().alias("node"), "*", F.size("vec").alias("dim")), "classes")
    found = links_of(classes, threshold)
    links = staged(found.where("node is not null"), "links")
    counted = staged(links.groupBy(F.col("node").alias("counted")).agg(F.sum("links").alias("links")), "counts")
    comp = components(links.where("node <> peer").select("node", "peer"), "node", "peer").withColumnRenamed("node", "member")
    whole = comp.join(classes.select("node", "rep"), F.col("member") == F.col("node"))
    least = staged(whole.groupBy(F.col("component").alias("of")).agg(F.min("rep").alias("c")), "least")
    per_class = (
        classes.join(counted, F.col("node") == F.col("counted"), "left")
        .join(comp, F.col("node") == F.col("member"), "left")
        .join(least, F.col("component") == F.col("of"), "left")
        .select(F.col("label").alias("__label"), F.col("vec").alias("__vec"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("c", "rep").alias("c"))
    )
    per_class = staged(per_class, "perclass")
    discard(classes, links, counted, least)
    out = base.join(per_class, (F.col("label") == F.col("__label")) & (F.col("vec") == F.col("__vec")), "left")
    able = usable("vec") & F.col("id").isNotNull()
    n, c = F.when(able, F.col("n")), F.when(able, F.col("c"))
    return out.select(F.col("id").alias(id_col), F.coalesce(n, F.lit(0)).cast("long").alias("n_links"), F.coalesce(c, "id").cast("long").alias("component_id"), F.coalesce(F.coalesce(c, "id") == F.col("id"), F.lit(True)).alias("kept"))


def _numbers(vectors: DataFrame, vec_col: str) -> Column:
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    return F.col(vec_col) if kind in ("float", "double") else F.col(vec_col).cast("array<double>")


def links_of(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``node, links, peer`` from ``classes(node, label, vec, size, dim)``: per
    task, how many rows each class links with, and a class that it hangs
    together with.  Rows without a node count the candidate pairs."""
    out = classes.sparkSession.createDataFrame([], _LINKS)
    for (dim,) in sorted(classes.select("dim").distinct().collect()):  # sizes of vectors, not rows
        out = out.union(_links(classes.where(F.col("dim") == dim), dim, threshold))
    return out


_LINKS = "node long, links long, peer long"


def _cell_keys(label: np.ndarray, block: int, cells: np.ndarray) -> np.ndarray:
    key = mix64(label.astype(np.int64).view(np.uint64) + np.uint64(block + 1 << 48))
    for x in cells.T:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.int64).view(np.uint64))
    return signed(key)


def _dealt_cells(turned: np.ndarray, label: np.ndarray, n: np.ndarray, rot: Rotation) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """``(block, rows, cell keys, home)``: the cell of each row in each block's
    grid, and the cells after it, in order, that come within reach.

    Cells are as wide as the reach, or wider where a label of ``n`` vectors
    fills fewer of them."""
    per_axis = np.maximum(1, np.ceil((n / CHUNK) ** (1 / GRID_AXES)))
    for k, axes in enumerate(rot.blocks):
        lead = axes[:GRID_AXES]
        reach = np.sqrt(rot.reach2[k]) * (1 + 1e-6)
        width = np.maximum(reach, 4 * rot.spread[lead][None, :] / per_axis[:, None])
        y = turned[:, lead].astype(np.float64)
        cell = np.floor(y / width).astype(np.int64)
        yield k, np.arange(len(y)), _cell_keys(label, k, cell), True
        low = y - cell * width <= reach
        high = (cell + 1) * width - y <= reach
        for step in product((-1, 0, 1), repeat=len(lead)):
            if step <= (0,) * len(lead):
                continue
            ok = np.ones(len(y), bool)
            for x, s in enumerate(step):
                ok &= low[:, x] if s < 0 else high[:, x] if s > 0 else True
            rows = np.flatnonzero(ok)
            yield k, rows, _cell_keys(label[rows], k, cell[rows] + np.array(step)), False


def _links(classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    spark = classes.sparkSession
    rot = spark.sparkContext.broadcast(rotation(classes, dim, threshold))
    kind = classes.schema["vec"].dataType.elementType.simpleString()
    sizes = staged(classes.groupBy(F.col("label").alias("__label")).agg(F.count("*").alias("n")), "labels")
    rows = classes.join(sizes, F.col("label") == F.col("__label")).select("node", F.xxhash64("label").alias("label"), "size", "n", "vec")

    def turn(batches):
        for batch in batches:
            turned = (_unit(_matrix(batch.column(4), dim)) @ rot.value.axes).astype(np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(turned.ravel()), dim).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["node", "label", "size", "n", "vec", "turned"])

    # coordinates are computed once: every task must see the same
    rows = staged(rows.mapInArrow(turn, f"node long, label long, size long, n long, vec array<{kind}>, turned array<float>"), "turned")
    small = rows.where(F.col("n") <= CHUNK).select(F.col("label").alias("task"), F.lit(-1).alias("block"), F.lit(0).alias("side"), F.lit(False).alias("cross"), "node", "label", "size", "vec", "turned")
    large = rows.where(F.col("n") > CHUNK)

    def cells(batches, whole: bool):
        for batch in batches:
            turned = _matrix(batch.column(5), dim, np.float32)
            label, n = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            for k, at, key, home in _dealt_cells(turned, label, n, rot.value):
                if whole:
                    own = [batch.column(i).take(pa.array(at)) for i in (0, 1, 2, 4, 5)]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), home)), *own], names=["cell", "block", "home", "node", "label", "size", "vec", "turned"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(at), home))], names=["cell", "home"])

    # cells without a home have nobody to meet
    filled = large.mapInArrow(lambda b: cells(b, False), "cell long, home boolean").groupBy(F.col("cell").alias("__cell")).agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g")).where("h > 0")
    chunks = lambda c: F.ceil(F.col(c) / CHUNK).cast("int")
    filled = staged(filled.select("__cell", F.when(F.col("h") + F.col("g") <= 2 * CHUNK, 0).otherwise(chunks("h")).alias("hs"), chunks("g").alias("gs")), "cells")
    dealt = large.mapInArrow(lambda b: cells(b, True), f"cell long, block int, home boolean, node long, label long, size long, vec array<{kind}>, turned array<float>")
    dealt = dealt.join(filled, F.col("cell") == F.col("__cell"))
    # a crowded cell is met in pairs of chunks: home with home, home with guests
    mine = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.when(F.col("home"), F.col("hs")).otherwise(F.col("gs")))).cast("int")
    meet = lambda i, j, guests, side, cross: F.struct(F.xxhash64("cell", i, j, guests).alias("task"), side.alias("side"), cross.alias("cross"))
    yes, no, zero, one = F.lit(True), F.lit(False), F.lit(0), F.lit(1)
    upto = lambda n: F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<int>"))
    with_home = F.transform(upto(F.col("hs")), lambda o: meet(F.least(mine, o), F.greatest(mine, o), no, F.when(mine > o, one).otherwise(zero), mine != o))
    with_guests = F.transform(upto(F.col("gs")), lambda o: meet(mine, o, yes, zero, yes))
    as_guest = F.transform(upto(F.col("hs")), lambda o: meet(o, mine, yes, one, yes))
    whole_cell = F.array(meet(zero, zero, no, F.when(F.col("home"), zero).otherwise(one), no))
    tasks = F.when(F.col("hs") == 0, whole_cell).when(F.col("home"), F.concat(with_home, with_guests)).otherwise(as_guest)
    columns = ["task", "block", "side", "cross", "node", "label", "size", "vec", "turned"]
    dealt = dealt.select(F.inline(tasks), *[c for c in columns if c not in ("task", "side", "cross")]).select(columns)
    every = small.select(columns).unionByName(dealt).repartition(parts_of(spark), "task").sortWithinPartitions("task")

    def run(batches):
        for _, t in runs(batches):
            side, node, label, size = (t.column(c).to_numpy() for c in ("side", "node", "label", "size"))
            raw, turned = _matrix(t.column("vec"), dim), _matrix(t.column("turned"), dim, np.float32)
            block = t.column("block")[0].as_py()
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            # side 0 meets side 1, and itself unless this is a pair of chunks
            jobs = [(a, b)] if t.column("cross")[0].as_py() else [(a, None), (a, b)]
            tested, first, second = 0, [], []
            total = np.zeros(len(node), np.int64)
            for home, guests in jobs:
                for i, j, n in linked_pairs(raw, turned, label, rot.value, threshold, None if block < 0 else block, home, guests):
                    tested += n
                    np.add.at(total, i, size[j])
                    np.add.at(total, j, size[i])
                    first.append(i)
                    second.append(j)
                    if sum(map(len, first)) > 1 << 20:
                        first, second = _thinned(len(node), first, second)
            hit = np.flatnonzero(total)
            least = spanned(len(node), np.concatenate(first), np.concatenate(second)) if first else np.arange(len(node))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(node[hit]), pa.nulls(1, pa.int64())]), pa.array(np.append(total[hit], tested)), pa.concat_arrays([pa.array(node[least[hit]]), pa.nulls(1, pa.int64())])], names=["node", "links", "peer"]
            )

    return every.mapInArrow(run, _LINKS)


def _thinned(n: int, first: list[np.ndarray], second: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pairs that hang the same rows together, at most ``n`` of them."""
    label = spanned(n, np.concatenate(first), np.concatenate(second))
    at = np.flatnonzero(label != np.arange(n))
    return [at], [label[at]]
