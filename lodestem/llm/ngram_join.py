"""N-gram Jaccard join of documents by a MinHash LSH forest.

Every text has a path in each of several trees: one short min-hash for each
level, packed into a number, so that sorted numbers are the tree's trie and
the levels that two neighbours share are their common leading bytes.  All trees
are sorted once.  Texts that share a whole path are candidates first; their
clusters are verified exactly on shingle sets, and from the similarities of the
links found follows how many the paths of this length must have missed.  While
that is too many, the matched prefix is shortened in all trees, to the level that
would find them, and clusters that grew are verified again.  Copies are one class
throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, gram_hashes, inside, joint, ladder, mix64, parts_of, run_hashes, signed, split_by_ids, staged, text_chunks, word_hashes, word_layout
from .graph import components, runs, spanning_peers

SHINGLE = 5
#: Jaccard similarity as a fraction, so that it is compared in integers.
THRESHOLD = (4, 5)
#: Trees, and levels of a path: eight at most, a byte each.
TREES, DEPTH = 32, 8
#: Part of all links that must be found.
TARGET_RECALL = 0.9999
#: A cluster is dealt in about CHUNKS chunks, of LEAST_CHUNK to MOST_CHUNK
#: classes and CHUNK_WORDS words; a task holds at most two.
CHUNKS, LEAST_CHUNK, MOST_CHUNK, CHUNK_WORDS = 16, 128, 1024, 400_000
#: Shingle columns that are multiplied at once.
COLUMNS = 4096
#: Steps of similarity in which links are counted.
BINS = 100
SEEDS = (0, 1)


def found_share(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """Probability that a pair shares a prefix of ``depth`` levels in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix that even finds pairs at the threshold often enough:
    shortening never needs to go further."""
    while depth > 1 and found_share(threshold, depth, trees) < target:
        depth -= 1
    return depth


def recall(links: np.ndarray, depth: int, shorter: int | None = None, trees: int = TREES) -> float:
    """Estimated part of all links that paths of ``depth`` levels (or of
    ``shorter`` ones) find, from the links found at ``depth`` by similarity
    (``links[b]``: from ``b / BINS`` on): one that is found with probability p
    stands for 1 / p."""
    at = np.flatnonzero(links)
    if not len(at):
        return 1.0
    total = links[at] / found_share(np.maximum(at, 1) / BINS, depth, trees)
    return float((total * found_share(np.maximum(at, 1) / BINS, shorter or depth, trees)).sum() / total.sum())


def shingles(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text of each shingle, its hash, words of each text, word hashes by two
    seeds)``.  A text of fewer than ``k`` words, but with one, has itself as its
    shingle."""
    starts, ends, woff = word_layout(data, offs)
    n_words = np.diff(woff)
    words = word_hashes(data, starts, ends, SEEDS)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    ok = inside(woff, k)
    d, h = doc[: len(ok)][ok], gram_hashes(words[0], k)[ok]
    few = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(few):
        whole = run_hashes(ladder(words[0], k), woff[few], woff[few + 1])
        d, h = np.concatenate([d, few]), np.concatenate([h, whole])
        order = np.argsort(d, kind="stable")
        d, h = d[order], h[order]
    return d, h, n_words, words


def signatures(docs: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> DataFrame:
    """``id, v, s1, s2, n_words, paths`` of each row of ``docs(id, v, text)``:
    two hashes of the word sequence, and one path per tree."""
    rng = np.random.default_rng(seed)
    k = trees * depth
    mul = rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, k, dtype=np.uint32)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            s, size = np.zeros((2, n), np.uint64), np.zeros(n, np.int64)
            paths = np.zeros((n, trees), np.uint64)
            for lo, hi, data, offs in text_chunks(batch.column(2), 1 << 18):
                d, h, n_words, words = shingles(data, offs)
                size[lo:hi] = n_words
                full = np.flatnonzero(n_words)
                if not len(full):
                    continue
                woff = np.concatenate([[0], np.cumsum(n_words)])
                place = mix64(np.arange(woff[-1]).astype(np.uint64) - np.repeat(woff[:-1], n_words).astype(np.uint64))
                for x, w in zip(s, words, strict=True):
                    x[lo + full] = np.add.reduceat(joint(place, w), woff[:-1][full])
                first = np.searchsorted(d, full)
                low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                path = np.zeros((trees, len(full)), np.uint64)
                for i in range(k):
                    v = low * mul[i]
                    v += add[i]
                    v ^= v >> np.uint32(15)
                    least = np.minimum.reduceat(v, first) * np.uint32(0x9E3779B1) >> np.uint32(24)
                    path[i // depth] = path[i // depth] << np.uint64(8) | least
                paths[lo + full] = path.T
            lists = pa.FixedSizeListArray.from_arrays(pa.array(signed(paths.ravel())), trees).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(signed(mix64(x))) for x in s), pa.array(size), lists], names=["id", "v", "s1", "s2", "n_words", "paths"])

    return docs.mapInArrow(run, "id long, v long, s1 long, s2 long, n_words long, paths array<long>")


def shared_levels(a: np.ndarray, b: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Number of leading levels that two paths have in common."""
    apart = (a ^ b).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
    return np.where(apart.any(1), apart.argmax(1), 8) - (8 - depth)


def forest(paths: DataFrame, least: int, depth: int = DEPTH) -> DataFrame:
    """The tries of all trees, from ``node, paths``: ``node, heads`` with, for
    each number of levels from ``least`` on, a node that stands for those with
    the same prefix (itself, if it does); nodes that share no prefix are left
    out.

    Trees are sorted in ranges that part equal paths by node, so a common path
    does not gather; a run's smallest node stands for it, as far as it has been
    read, and runs that go on in the next batch or range are tied together.
    """
    spark = paths.sparkSession
    rows = paths.select("node", F.posexplode("paths").alias("tree", "path"))
    order = ["tree", "path", "node"]
    ordered = rows.repartitionByRange(parts_of(spark), *order).sortWithinPartitions(*order).select(*order)
    depths = list(range(least, depth + 1))

    def run(batches):
        part = TaskContext.get().partitionId()
        last, first = None, None  # tree, path, heads of the row before; tree, path, node of the first row
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, path, node = (batch.column(i).to_numpy() for i in range(3))
            if first is None:
                first = (int(tree[0]), int(path[0]), int(node[0]))
                last = (-1, 0, [0] * len(depths))
            shared = shared_levels(np.append(last[1], path[:-1]).view(np.uint64), path.view(np.uint64), depth)
            levels = np.where(np.append(last[0], tree[:-1]) == tree, shared, 0)
            heads, more = np.empty((len(depths), len(node)), np.int64), []
            for k, d in enumerate(depths):
                starts = np.flatnonzero((levels < d) | (np.arange(len(node)) == 0))
                least_of = np.minimum.reduceat(node, starts)
                if levels[0] >= d:
                    before, least_of[0] = last[2][k], min(least_of[0], last[2][k])
                    if least_of[0] != before:  # the run has found a smaller one
                        more.append((before, [least_of[0] if i == k else before for i in range(len(depths))]))
                heads[k] = np.repeat(least_of, np.diff(np.append(starts, len(node))))
            last = (int(tree[-1]), int(path[-1]), heads[:, -1].tolist())
            kept = np.flatnonzero((heads != node).any(0))
            if len(kept) or more:
                yield _heads_batch(np.append(node[kept], [x for x, _ in more]), np.concatenate([heads[:, kept].T, *([h] for _, h in more)]), None)
        if first:
            yield _heads_batch(np.array([first[2]]), np.array([last[2]]), (part, *first[:2], *last[:2]))

    found = staged(ordered.mapInArrow(run, "node long, heads array<long>, part int, tree0 int, path0 long, tree1 int, path1 long"), "forest")
    borders = found.where("part is not null").orderBy("part").collect()  # one row per range
    ties = []
    for a, b in zip(borders, borders[1:], strict=False):
        levels = int(shared_levels(np.array([a["path1"]]).view(np.uint64), np.array([b["path0"]]).view(np.uint64), depth)[0])
        if a["tree1"] == b["tree0"] and levels >= least:
            ties.append((b["node"], [h if d <= levels else b["node"] for d, h in zip(depths, a["heads"], strict=True)]))
    inner = found.where("part is null").select("node", "heads")
    out = staged(inner.unionByName(spark.createDataFrame(ties, inner.schema)) if ties else inner, "trie")
    discard(found)
    return out


def _heads_batch(node: np.ndarray, heads: np.ndarray, border: tuple | None) -> pa.RecordBatch:
    n = len(node)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(heads, np.int64).ravel()), heads.shape[1]).cast(pa.list_(pa.int64()))
    cols = [pa.array(node.astype(np.int64)), lists]
    cols += [pa.array([None if border is None else border[i]] * n, t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, names=["node", "heads", "part", "tree0", "path0", "tree1", "path1"])


def verified(docs: list[np.ndarray], others: list[np.ndarray] | None, threshold: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Exact Jaccard test of all pairs of distinct-shingle arrays, by counting
    common shingles as products of incidence blocks: which pairs link, and the
    similarity of each.  Shingles of one text only are in no intersection and
    are left out."""
    rows = docs + (others or [])
    n, m = len(docs), len(rows)
    sizes = np.array([len(x) for x in rows], np.int64)
    who = np.repeat(np.arange(m), sizes)
    keys, col = np.unique(np.concatenate(rows), return_inverse=True)
    common = np.bincount(col, minlength=len(keys)) > 1
    renum = np.cumsum(common) - 1
    pick = common[col]
    who, col = who[pick], renum[col[pick]]
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    width = int(common.sum())
    left, right = (slice(0, n), slice(0, n)) if others is None else (slice(0, n), slice(n, m))
    both = np.zeros((n, n if others is None else m - n), np.float32)
    for lo in range(0, width, COLUMNS):
        a, b = np.searchsorted(col, [lo, lo + COLUMNS])
        block = np.zeros((m, min(COLUMNS, width - lo)), np.float32)
        block[who[a:b], col[a:b] - lo] = 1
        both += block[left] @ block[right].T
    both = both.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return both * threshold[1] >= union * threshold[0], both / union


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD, versions: bool = False) -> DataFrame:
    """``id, n_words, class_id, n_links, kept`` for every row (and with
    ``versions`` its text's ``xxhash64`` as ``v``).

    Shingles are runs of five words, parted by ASCII white space and compared
    unchanged (by 64-bit hashes, word sequences by 128 bits).  Two rows link at a
    Jaccard similarity of the threshold or more; ``class_id`` is the smallest id
    reachable over links, and that row is kept.  Texts of one to four words are
    one shingle; null texts and texts without words link with nothing, and so do
    rows without an id, which are kept.  Rows with equal word sequences count
    each other, repeated rows too.  Ids are integers; rows that repeat an id with
    another text are documents of their own, and each is kept if its class has
    that id.  Other columns are not read.  No rows give no rows.
    """
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("v"), text.alias("text"))
    sig = staged(signatures(src), "signatures")
    worded = sig.where("n_words > 0 and id is not null")
    # texts with the same words have the same paths
    named = worded.groupBy("s1", "s2", "n_words").agg(F.min(F.struct("id", "v")).alias("first"), F.count("*").alias("size"), F.first("paths").alias("paths"))
    # a number for each distinct text, fixed by writing it
    numbered = staged(named.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "n_words", F.col("first.id").alias("rep"), F.col("first.v").alias("rep_v"), "size", "paths"), "classes")
    classes = numbered.drop("paths")
    goal = least_depth(threshold[0] / threshold[1])
    trie = forest(numbered.select("node", "paths"), goal)

    links, settled, depth = None, None, DEPTH
    while True:
        at = depth
        head = F.element_at("heads", F.lit(depth - goal + 1))
        edges = trie.select("node", head.alias("head")).where("node <> head").distinct()
        clusters = components(edges, "node", "head")
        sizes = staged(clusters.groupBy("component").agg(F.count("*").alias("n")), "sizes")
        grown = staged(sizes if settled is None else sizes.join(settled, ["component", "n"], "left_anti"), "grown")
        fresh = _verify(src, clusters, grown, classes, threshold)
        if links is None:
            links = staged(fresh, "links")
        else:
            same = sizes.join(settled, ["component", "n"], "left_semi").select(F.col("component").alias("cluster"))
            both = staged(links.join(same, "cluster", "left_semi").unionByName(fresh), "links")
            discard(links, settled)
            links = both
        discard(grown)
        settled = sizes
        seen = np.zeros(BINS + 1)
        for r in links.where("bin is not null").groupBy("bin").agg(F.sum("links").alias("n")).collect():  # at most BINS + 1 rows
            seen[r["bin"]] = r["n"]
        if depth <= goal or recall(seen, depth) >= TARGET_RECALL:
            break
        # level by level, until what has been seen would be found
        depth -= 1
        while depth > goal and recall(seen, at, depth) < TARGET_RECALL:
            depth -= 1
    discard(trie)

    linked = links.where("node is not null")
    counts = staged(linked.where("links > 0").groupBy(F.col("node").alias("counted")).agg(F.sum("links").alias("links")), "counts")
    comp = components(linked.where("node <> peer").select("node", "peer"), "node", "peer").withColumnRenamed("node", "member")
    whole = comp.join(classes, F.col("member") == F.col("node"))
    least = staged(whole.groupBy("component").agg(F.min("rep").alias("c")), "least")
    per_class = (
        classes.join(counts, F.col("node") == F.col("counted"), "left")
        .join(comp, F.col("node") == F.col("member"), "left")
        .join(least.withColumnRenamed("component", "of"), F.col("component") == F.col("of"), "left")
        .select("s1", "s2", F.col("n_words").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("c", "rep").alias("c"))
    )
    per_class = staged(per_class, "perclass").withColumnsRenamed({"s1": "t1", "s2": "t2"})
    discard(numbered, counts, least, links, settled)
    out = sig.select("id", "v", "s1", "s2", "n_words").join(per_class, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("n_words") == F.col("w")) & F.col("id").isNotNull(), "left")
    c = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), "n_words", c.alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce(c == F.col("id"), F.lit(True)).alias("kept"), *["v"] * versions)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The documents without near copies, with the same columns, whatever their
    names: of every group of linked rows one stays, a row with the smallest id
    (and of several texts under that id, the one with the smallest hash; of
    repeated rows, any one).  Rows that link with nothing all stay."""
    found = join(docs, id_col, text_col, threshold, versions=True).where("n_links > 0")
    linked = staged(found.select(F.col(id_col).alias("i"), "v", "class_id"), "linked")
    first = linked.where("i = class_id").groupBy(F.col("class_id").alias("c")).agg(F.min("v").alias("first"))
    named = linked.join(first, F.col("class_id") == F.col("c")).groupBy("i", "v").agg(F.bool_or((F.col("i") == F.col("c")) & (F.col("v") == F.col("first"))).alias("stays"), (F.count("*") > 1).alias("twice"))
    named = staged(named, "named").withColumnRenamed("v", "w")
    text = F.col(text_col).cast("string")
    maybe, clean = split_by_ids(docs.select(F.struct("*").alias("__row"), F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__v")), named.select("i"), "__id")
    judged = maybe.join(named.hint("shuffle_hash"), (F.col("__id") == F.col("i")) & (F.col("__v") == F.col("w")), "left")
    kept = judged.where(F.coalesce("stays", F.lit(True)))
    repeated = F.coalesce("twice", F.lit(False))
    once = kept.where(repeated).groupBy("__id", "__v").agg(F.first("__row").alias("__row"))
    out = clean.select("__row").unionByName(kept.where(~repeated).select("__row")).unionByName(once.select("__row"))
    discard(linked)
    return out.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def _verify(src: DataFrame, clusters: DataFrame, todo: DataFrame, classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``cluster, node, links, peer, bin`` of each task over pairs of chunks of
    the clusters in ``todo(component, n)``; rows without a node count the linked
    pairs of texts by similarity."""
    spark = src.sparkSession
    member = clusters.join(todo.select("component"), "component", "left_semi").withColumnRenamed("node", "doc")
    member = member.join(classes.select("node", "rep", "rep_v", "size", "n_words"), F.col("doc") == F.col("node")).drop("doc")
    per = F.least(F.lit(MOST_CHUNK), F.greatest(F.lit(LEAST_CHUNK), F.ceil(F.col("n") / CHUNKS)))
    sized = member.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    sized = staged(sized.select("cluster", F.greatest(F.ceil(F.col("n") / per), F.ceil(F.col("w") / CHUNK_WORDS)).cast("int").alias("k")), "sized")
    member = member.join(sized, F.col("component") == F.col("cluster"))
    member = staged(member.select("node", "rep", "rep_v", "size", "cluster", "k", F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("c")), "members")
    maybe, _ = split_by_ids(src, member.select("rep"), "id")
    texts = maybe.join(member.hint("shuffle_hash"), (F.col("id") == F.col("rep")) & (F.col("v") == F.col("rep_v"))).select("node", "size", "cluster", "c", "k", "text")

    def sets_of(batches):
        read: set[int] = set()  # repeated rows are read once
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            fresh = [i for i, x in enumerate(nodes) if not (x in read or read.add(x))]
            if len(fresh) < len(nodes):
                batch = batch.take(pa.array(fresh, pa.int64()))
            for lo, hi, data, offs in text_chunks(batch.column(5)):
                d, h, *_ = shingles(data, offs)
                cut = np.searchsorted(d, np.arange(hi - lo + 1))
                raw = pa.array([np.unique(h[a:b]).tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(x.slice(lo, hi - lo) for x in batch.columns[:5]), raw], names=["node", "size", "cluster", "c", "k", "grams"])

    each = texts.mapInArrow(sets_of, "node long, size long, cluster long, c int, k int, grams binary")
    # chunk c meets every chunk; the task is named by the smaller and the larger
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    task = F.xxhash64("cluster", F.least("c", "o"), F.greatest("c", "o"))
    dealt = each.select(task.alias("task"), (F.col("c") > F.col("o")).alias("second"), (F.col("c") == F.col("o")).alias("own"), "node", "size", "cluster", "grams")
    dealt = dealt.repartition(parts_of(spark), "task").sortWithinPartitions("task")

    def run(batches):
        for _, t in runs(batches):
            nodes = t.column("node").to_numpy()
            once = np.unique(nodes, return_index=True)[1]
            if len(once) < len(nodes):  # a repeated row that was read in two tasks
                t = t.take(pa.array(np.sort(once)))
            own = bool(t.column("own")[0].as_py())
            second = t.column("second").to_numpy()
            nodes, size = t.column("node").to_numpy(), t.column("size").to_numpy()
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("grams")]
            a = np.arange(len(nodes)) if own else np.flatnonzero(~second)
            b = a if own else np.flatnonzero(second)
            if not len(a) or not len(b) or own and len(a) < 2:
                continue
            link, how = verified([sets[i] for i in a], None if own else [sets[i] for i in b], threshold)
            if own:
                np.fill_diagonal(link, False)
            if not link.any():
                continue
            bins = np.bincount((how[np.triu(link) if own else link] * BINS + 1e-9).astype(np.int64), minlength=BINS + 1)
            row, col = spanning_peers(link)
            one, two = np.flatnonzero(link.any(1)), np.flatnonzero(col >= 0)
            # a column's peer is a row; inside one chunk the columns are the rows
            back = np.zeros(len(two), np.int64) if own else size[a] @ link[:, two]
            n, at = np.flatnonzero(bins), len(one) + len(two)
            cols = [np.concatenate([nodes[a][one], nodes[b][two]]), np.concatenate([link[one] @ size[b], back]), np.concatenate([nodes[a][row[one]], nodes[a][col[two]]])]
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(at + len(n), t.column("cluster")[0].as_py())),
                    pa.concat_arrays([pa.array(cols[0]), none]),
                    pa.array(np.concatenate([cols[1], bins[n]]).astype(np.int64)),
                    pa.concat_arrays([pa.array(cols[2]), none]),
                    pa.concat_arrays([pa.nulls(at, pa.int32()), pa.array(n.astype(np.int32))]),
                ],
                names=["cluster", "node", "links", "peer", "bin"],
            )

    return dealt.mapInArrow(run, "cluster long, node long, links long, peer long, bin int")
