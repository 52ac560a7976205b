"""Approximate nearest neighbours: a forest of random-projection trees with one priority queue, and exact reranking.

Fitting. Every tree splits a node by the hyperplane half-way between two random vectors of the node, until a node has at most
``leaf`` vectors. The trees are fitted on at most ``SAMPLE`` different vectors (those with the smallest hash), so they are of
bounded size; every vector of the table is then dropped into its leaf of every tree.

Search. A query keeps one priority queue over the nodes of all trees, ordered by the worst margin on the way from the root.
It pops nodes and visits leaves, of whichever tree, until they hold ``search`` vectors by the leaf
counts of the whole table. The rows of those leaves are its candidates; their exact
Euclidean distances on the original vectors, in double precision, give the result.

Budget. ``search`` is measured unless it is given: for ``TRIED`` queries (smallest hashes) the true neighbours are found by brute force,
their places in the queue say how many vectors must be visited to reach each, and the least budget that reaches ``RECALL`` of
them, but at least ``SEARCH``, holds for all queries. That costs one pass over the table with ``TRIED`` distances a vector. A measured
budget of the size of the table or more means that the forest does not pay: all leaves of one tree are visited then, which is exact.

Equal vectors are one entry: a vector that makes up a third of the table fills one place of a leaf, not a leaf. It stands for its
``k + 1`` smallest ids, and no query can need more of them. A table of at most ``SEARCH / TREES`` vectors is searched whole.

Distribution. Leaves that follow each other along a tree form groups of about ``GROUP`` vectors. A vector goes once per tree to its
group, a query to the groups it visits, with the list of its leaves; each group gives at most k + 1 rows for a query that visits
it, so candidates are never written out as pairs. The final ranking keeps k rows a query inside the map tasks.

Rules for odd input: vectors that are null, all zero, or hold a null or a non-finite component take no part, nor do
vectors whose length differs from the most frequent one, nor rows with a null id; repeated rows (same id) count once for each
different vector; ties go to the smaller id; with no vectors left the result is empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from newsloom.llm.common import small_batches
from newsloom.session import scratch_path

TREES = 12
LEAF = 32
SAMPLE = 60_000
#: Vectors in the visited leaves of a query, at least; larger tables get the measured budget.
SEARCH = 26_000
#: Queries the budget is measured on, and the share of their true neighbours it must reach (0.9 is asked for).
TRIED, RECALL = 100, 0.95
K = 10
GROUP = 4096


@dataclass
class Tree:
    """Nodes in arrays: plane and offset of inner nodes, children (negative: leaf -1 - child)."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of x."""
        at = np.zeros(len(x), np.int64) if len(self.planes) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = np.einsum("ij,ij->i", x[inner], self.planes[node]) > self.offsets[node]
            at[inner] = self.children[node, side.astype(int)]
        return -1 - at


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """A tree over the rows of x. A node that two random vectors fail to split three times is cut by a random half."""
    planes, offsets, children = [], [], []
    leaves = 0
    stack = [(np.arange(len(x)), None, 0)]
    while stack:
        rows, parent, side = stack.pop()
        if len(rows) <= leaf:
            if parent is not None:
                children[parent][side] = -1 - leaves
            leaves += 1
            continue
        for _ in range(3):
            a, b = x[rng.choice(rows, 2, replace=False)]
            plane = b - a
            offset = float(plane @ (a + b) / 2)
            right = x[rows] @ plane > offset
            if 0.05 * len(rows) < right.sum() < 0.95 * len(rows):
                break
        else:
            plane = rng.standard_normal(x.shape[1])
            along = x[rows] @ plane
            offset = float(np.median(along))
            right = along > offset
            if not 0 < right.sum() < len(rows):  # the vectors lie on the plane
                if parent is not None:
                    children[parent][side] = -1 - leaves
                leaves += 1
                continue
        node = len(planes)
        planes.append(plane / max(float(np.linalg.norm(plane)), 1e-300))
        offsets.append(offset / max(float(np.linalg.norm(plane)), 1e-300))
        children.append([0, 0])
        if parent is not None:
            children[parent][side] = node
        stack.append((rows[~right], node, 0))
        stack.append((rows[right], node, 1))
    dim = x.shape[1]
    return Tree(np.array(planes).reshape(-1, dim), np.array(offsets), np.array(children, np.int64).reshape(-1, 2))


def leaves_in_order(query: np.ndarray, forest: list[Tree], counts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(tree, leaf, vectors in the leaves before it) in the order of the shared queue."""
    margins = [tree.planes @ query - tree.offsets for tree in forest]
    queue = [(-np.inf, t, 0 if len(tree.planes) else -1) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    held = 0
    while queue:
        worst, t, node = heapq.heappop(queue)
        if node < 0:
            leaf = -1 - node
            if leaf < len(counts[t]) and counts[t][leaf]:
                yield t, leaf, held
                held += int(counts[t][leaf])
            continue
        margin = margins[t][node]
        near, far = (1, 0) if margin > 0 else (0, 1)
        heapq.heappush(queue, (worst, t, int(forest[t].children[node, near])))
        heapq.heappush(queue, (max(worst, abs(margin)), t, int(forest[t].children[node, far])))


def visit(query: np.ndarray, forest: list[Tree], counts: list[np.ndarray], search: int) -> list[tuple[int, int]]:
    """(tree, leaf) pairs in the order of the shared queue until they hold ``search`` vectors."""
    return [(t, leaf) for t, leaf, _ in takewhile(lambda x: x[2] < search, leaves_in_order(query, forest, counts))]


def measured_budget(heads: DataFrame, tried: np.ndarray, forest: list[Tree], counts: list[np.ndarray], k: int) -> int:
    """The least ``search`` that reaches ``RECALL`` of the true neighbours of the tried queries (rows)."""
    dim, n = tried.shape[1], len(tried)

    def closest(batches: Iterator[pa.RecordBatch]):
        """The k nearest vectors of the partition for every tried query, with their leaves."""
        best, near = np.full((n, k), np.inf), np.zeros((n, k, dim))
        for batch in small_batches(batches, 1024):
            if not batch.num_rows:
                continue
            rows = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
            for q in range(n):
                gap = rows - tried[q]
                score = np.einsum("ij,ij->i", gap, gap)
                score[score == 0] = np.inf  # the query itself
                own = np.flatnonzero(score < best[q, -1])
                if own.size:
                    scores, found = np.append(best[q], score[own]), np.concatenate([near[q], rows[own]])
                    order = np.argsort(scores, kind="stable")[:k]
                    best[q], near[q] = scores[order], found[order]
        real = best.reshape(-1) < np.inf
        rows = near.reshape(-1, dim)[real]
        leaves = np.stack([tree.leaves(rows) for tree in forest], axis=1).tolist() if real.any() else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(n), k)[real], pa.int32()), pa.array(best.reshape(-1)[real], pa.float64()), pa.array(leaves, pa.list_(pa.int32()))],
            names=["q", "score", "leaves"],
        )

    order = Window.partitionBy("q").orderBy("score", "leaves")
    true = heads.select("vector").mapInArrow(closest, "q int, score double, leaves array<int>").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    wanted: dict[int, list[list[int]]] = {}
    for r in true.select("q", "leaves").collect():  # at most k rows a tried query
        wanted.setdefault(r["q"], []).append(r["leaves"])
    needs = []
    for q, neighbours in wanted.items():
        open_ = set(range(len(neighbours)))
        at: dict[tuple[int, int], list[int]] = {}
        for i, leaves in enumerate(neighbours):
            for pair in enumerate(leaves):
                at.setdefault(pair, []).append(i)
        for t, leaf, held in leaves_in_order(tried[q], forest, counts):
            for i in at.get((t, leaf), ()):
                if i in open_:
                    open_.discard(i)
                    needs.append(held + 1)
            if not open_:
                break
    needs.sort()
    return needs[int(np.ceil(len(needs) * RECALL)) - 1] if needs else 0


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as rows of numbers."""
    return np.concatenate([np.asarray(c.flatten()) for c in column.chunks]).reshape(-1, dim)


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, with components as doubles."""
    v = F.col("embedding").cast("array<double>")
    usable = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vector")).where(
        F.col("vec_id").isNotNull()
        & F.col("vector").isNotNull()
        & (F.size("vector") > 0)
        & ~F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        & F.exists("vector", lambda c: c != 0)
    )
    return usable


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, search: int | None = None, seed: int = 1) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest other vectors found for each query. ``search`` None is measured.

    Both frames have vec_id and embedding."""
    spark = vectors.sparkSession

    def saved(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    valid = _valid(vectors)
    sizes = valid.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if not sizes:
        return spark.createDataFrame([], out)
    dim = sizes[0]["dim"]
    # Different vectors, each with its k + 1 smallest ids; -0.0 and 0.0 are one value.
    plain = valid.where(F.size("vector") == dim).withColumn("vector", F.transform("vector", lambda c: F.when(c == 0, 0.0).otherwise(c)))
    keyed = plain.withColumn("key", F.sha2(F.array_join(F.transform("vector", lambda c: c.cast("string")), ","), 256)).select("key", "vec_id", "vector")
    order = Window.partitionBy("key").orderBy("vec_id")
    ranked = keyed.groupBy("key", "vec_id").agg(F.first("vector").alias("vector")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    entries = saved(ranked, "vectors")
    heads = entries.where("place = 1").select(F.col("vec_id").alias("head"), "key", "vector")

    # The sample (at most SAMPLE vectors, a fixed bound) is fitted in one place; the forest goes out with the tasks.
    chosen = heads.orderBy(F.xxhash64("key"), "head").limit(sample).select("vector")
    x = np.array([r["vector"] for r in chosen.toLocalIterator()], dtype=np.float64).reshape(-1, dim)
    total = heads.count()
    forest = [grow(x, leaf, np.random.default_rng([seed, t])) for t in range(trees)]

    def drop(batches: Iterator[pa.RecordBatch]):
        for batch in small_batches(batches, 1024):
            rows = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
            trees = len(forest)
            leaves = np.stack([tree.leaves(rows) for tree in forest], axis=1) if len(rows) else np.empty((0, trees), np.int64)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column(0).to_numpy(), trees), pa.int64()),
                    pa.array(np.tile(np.arange(trees), n), pa.int32()),
                    pa.array(leaves.reshape(-1), pa.int32()),
                    batch.column(1).take(pa.array(np.repeat(np.arange(n), trees))),
                ],
                names=["head", "tree", "leaf", "vector"],
            )

    asked = (
        _valid(queries)
        .where(F.size("vector") == dim)
        .groupBy("vec_id")
        .agg(F.min("vector").alias("query"))
        .select(F.col("vec_id").alias("query_id"), F.transform("query", lambda c: F.when(c == 0, 0.0).otherwise(c)).alias("query"))
    )
    # Neighbouring leaves (they are numbered along the tree) share a group of about GROUP vectors.
    leaves = max(len(tree.planes) + 1 for tree in forest)
    per_group = max(1, GROUP * leaves // max(1, total))

    def indexed() -> DataFrame:
        return heads.select("head", "vector").mapInArrow(drop, "head bigint, tree int, leaf int, vector array<double>").withColumn("grp", F.expr(f"cast(leaf div {per_group} as int)"))

    counts = [np.zeros(len(tree.planes) + 1, np.int64) for tree in forest]
    for r in indexed().groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per leaf of the forest
        counts[r["tree"]][r["leaf"]] = r["n"]
    budget = SEARCH if search is None else search
    if search is None and SEARCH < trees * total:
        tried = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(TRIED).select("query").collect()
        measured = measured_budget(heads, np.array([r["query"] for r in tried], dtype=np.float64).reshape(-1, dim), forest, counts, k)
        budget = max(SEARCH, measured)
        if measured >= total:  # one tree, all leaves
            budget, forest, counts = total, forest[:1], counts[:1]
    index = indexed()

    def walk(batches: Iterator[pa.RecordBatch]):
        for batch in small_batches(batches, 256):
            ids, ts, gs, ls, qs = [], [], [], [], []
            rows = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
            for at, (qid, row) in enumerate(zip(batch.column(0).to_pylist(), rows, strict=True)):
                own: dict[tuple[int, int], list[int]] = {}
                for t, leaf_ in visit(row, forest, counts, budget):
                    own.setdefault((t, leaf_ // per_group), []).append(leaf_)
                for (t, g), group in own.items():
                    ids.append(qid)
                    ts.append(t)
                    gs.append(g)
                    ls.append(group)
                    qs.append(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ts, pa.int32()), pa.array(gs, pa.int32()), pa.array(ls, pa.list_(pa.int32())), batch.column(1).take(pa.array(qs, pa.int64()))],
                names=["query_id", "tree", "grp", "leaves", "query"],
            )

    visits = asked.mapInArrow(walk, "query_id bigint, tree int, grp int, leaves array<int>, query array<double>")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k + 1 nearest of the visited vectors of one group, for each query that visits it."""
        ids, heads_, scores = [], [], []
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            leaf_of = right["leaf"].to_numpy()
            head = right["head"].to_numpy()
            x = _matrix(right["vector"], dim)
            asked_ = _matrix(left["query"], dim)
            for qid, visited, query in zip(left["query_id"].to_pylist(), left["leaves"].to_pylist(), asked_, strict=True):
                own = np.flatnonzero(np.isin(leaf_of, visited))
                gap = x[own] - query
                score = np.sqrt(np.cumsum(gap * gap, axis=1)[:, -1])  # added in order, as SQL does
                if len(own) > k + 1:
                    edge = np.partition(score, k)[k]
                    own, score = own[score <= edge], score[score <= edge]
                    best = np.lexsort((head[own], score))[: k + 1]
                    own, score = own[best], score[best]
                ids += [qid] * len(own)
                heads_ += head[own].tolist()
                scores += score.tolist()
        return pa.table({"query_id": pa.array(ids, pa.int64()), "head": pa.array(heads_, pa.int64()), "score": pa.array(scores, pa.float64())})

    near = (
        visits.groupBy("tree", "grp")
        .cogroup(index.groupBy("tree", "grp"))
        .applyInArrow(rerank, "query_id bigint, head bigint, score double")
        .groupBy("query_id", "head")
        .agg(F.min("score").alias("score"))
    )
    # k + 1 different vectors are enough: one of them may be the query's own alone.
    best = Window.partitionBy("query_id").orderBy("score", "head")
    kept = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    keys = entries.where("place = 1").select(F.col("vec_id").alias("head"), "key")
    members = kept.join(keys, "head").join(entries.select("key", "vec_id"), "key").where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return members.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
