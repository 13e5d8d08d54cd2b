"""Connected components and pair tasks that the similarity joins share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (smallest node reachable) of every node with an edge.

    Every node hooks to its smallest neighbour, chains of hooks are followed by
    jumping, and the edges between the trees that this makes are the next round's,
    with a tree's smallest node in place of its nodes.  A round at least halves
    the nodes, so there are about log n, on ever fewer edges; what repeats is
    aggregation with map-side combining and equi-joins of written tables, so
    skewed nodes can be split.  No edges: no rows.
    """
    # each pair once, the larger node first
    left = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    left, names = staged(left, "edges"), None
    while True:
        both = left.select("a", "b").union(left.select(F.col("b"), F.col("a")))
        hooks = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "hooks")
        while True:
            once, twice = (hooks.select(F.col("node").alias(f"n{i}"), F.col("label").alias(f"l{i}")) for i in (1, 2))
            jumped = hooks.join(once, F.col("label") == F.col("n1")).join(twice, F.col("l1") == F.col("n2"))
            jumped = staged(jumped.select("node", F.col("label").alias("was"), F.col("l2").alias("label")), "hooks")
            moved = jumped.where("label <> was").limit(1).count()
            discard(hooks)
            hooks = jumped.select("node", "label")
            hooks._staged_path = jumped._staged_path  # noqa: SLF001
            if not moved:
                break
        x, y = (hooks.select(F.col("node").alias(f"n{i}"), F.col("label").alias(f"l{i}")) for i in (1, 2))
        between = left.join(x, F.col("a") == F.col("n1")).join(y, F.col("b") == F.col("n2")).where("l1 <> l2")
        between = staged(between.select(F.greatest("l1", "l2").alias("a"), F.least("l1", "l2").alias("b")).distinct(), "edges")
        if names is None:
            whole = hooks
        else:  # nodes of earlier rounds take the label of their label
            up = hooks.select(F.col("node").alias("n1"), F.col("label").alias("l1"))
            whole = staged(names.join(up, F.col("label") == F.col("n1"), "left").select("node", F.coalesce("l1", "label").alias("label")), "labels")
            discard(names, hooks)
        names = whole
        done = not between.limit(1).count()
        discard(left, *([between] if done else []))
        left = between
        if done:
            return names.select("node", F.col("label").alias("component"))


def runs(batches: Iterator[pa.RecordBatch], key: int = 0, most_rows: int | None = None) -> Iterator[tuple[object, pa.Table]]:
    """Rows with equal keys, which must come together: ``(key, table)``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cut, cut[1:], strict=False):
            if held and k[lo] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = k[lo]
    if held:
        yield last, pa.Table.from_batches(held)


def spanning_peers(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and the columns of a boolean link block: the smallest row
    that each is connected to within the block (itself, for rows without links;
    -1 for columns without)."""
    n, m = link.shape
    row, far = np.arange(n), n
    has = link.any(0)
    while True:
        col = np.where(link, row[:, None], far).min(0) if n else np.full(m, far)
        new = np.minimum(row, np.where(link, col[None, :], far).min(1)) if m else row
        if (new == row).all():
            return row, np.where(has, col, -1)
        row = new
