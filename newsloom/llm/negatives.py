"""Hard negatives: for each anchor and each of its nearest rows of the same label, the rows of other labels that score almost as high.

A row's score is its integer inner product with the anchor, on components floor(256 x). Higher scores come first, ties by smaller
vec_id. An anchor's positives are its first ``POSITIVES`` other rows of its label; a positive with score s opens the window of scores
from s/2 to 0.95 s, and the first ``NEGATIVES`` rows of other labels in it are its hard negatives.

Method. Fagin's threshold algorithm. A block of candidates keeps one sorted list per dimension. An anchor reads every list from its
own end: from the largest value where its component is positive, from the smallest where it is negative. A row met for the first time
is scored by random access to its whole vector. The threshold is the score of the last values read; no row that is not met can score
more. Reading goes on, twice as deep each time, until the threshold is strictly below the score of the last place wanted (of the
positives, or of each window; a window with free places is done when the threshold is strictly below its lower end), so ties are settled too.

Distribution. Anchors are a stated query set, searched against all rows in blocks: anchors in blocks of ``ANCHORS``, candidates
in blocks of up to ``BLOCK_VALUES`` components, both by hash of the id, so no label and no id is hot. Each pair of blocks is one group of
a cogroup; it gives at most ``POSITIVES`` rows an anchor, or ``NEGATIVES`` a window, which are ranked over all blocks. Windows
need all positives, so there are two such passes. Tables of few rows get smaller blocks, for more tasks.

Rules for odd input: rows with a null id, label or vector, or with a null or non-finite component, take no part; of rows with one
vec_id one counts, with the smallest label, then vector (repeated rows count once); vectors of different lengths end in zeros; an empty
vector scores 0 with all; components and scores beyond 64 bits are held at its limits; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

POSITIVES = 5
NEGATIVES = 3
SCALE = 256

#: Rows of a block of anchors, and components of a block of candidates (rows times dimensions). Blocks of small tables are a 32nd of the
#: table, but not under LEAST_ROWS rows.
ANCHORS = 8_192
BLOCK_VALUES = 1 << 22
LEAST_ROWS = 4_096

#: Places of each list read in the first step.
FIRST_READ = 16


class SortedLists:
    """Vectors (rows) with one ascending list of rows per dimension."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        columns = np.ascontiguousarray(vectors.T)
        order = np.argsort(columns, axis=1, kind="stable")
        self.order = order.astype(np.int32)
        self.values = np.take_along_axis(columns, order, 1)

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, float | None]]:
        """Steps of sorted access: the rows met for the first time, and the threshold of rows not met (None: there are none)."""
        n = len(self.vectors)
        high, low = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(high) and not len(low):  # all scores are 0
            yield np.arange(n), None
            return
        met = np.zeros(n, bool)
        start, step = 0, FIRST_READ
        while start < n:
            end = min(n, start + step)
            new = np.zeros(n, bool)
            new[self.order[high, n - end : n - start]] = True
            new[self.order[low, start:end]] = True
            new &= ~met
            met |= new
            if met.all():
                yield np.flatnonzero(new), None
                return
            last = anchor[high] @ self.values[high, n - end] + anchor[low] @ self.values[low, end - 1]
            yield np.flatnonzero(new), last
            start, step = end, step * 2


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k by score, then id."""
    if len(ids) > 4 * k:  # fewer to sort; all that tie with the k-th stay
        own = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[own], scores[own]
    order = np.lexsort([ids, -scores])[:k]
    return ids[order], scores[order]


def best(lists: SortedLists, ids: np.ndarray, anchor: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the first k of the ``wanted`` rows."""
    found, scores = ids[:0], lists.vectors[:0] @ anchor
    for met, threshold in lists.read(anchor):
        met = met[wanted[met]]
        found, scores = _first(np.concatenate([found, ids[met]]), np.concatenate([scores, lists.vectors[met] @ anchor]), k)
        if threshold is not None and len(found) == k and threshold < scores[-1]:
            break
    return found, scores


def best_in_windows(
    lists: SortedLists, ids: np.ndarray, anchor: np.ndarray, wanted: np.ndarray, windows: list[tuple[int, int]], k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (lowest and highest score): ids and scores of its first k of the ``wanted`` rows."""
    found = [(ids[:0], lists.vectors[:0] @ anchor) for _ in windows]
    going = [w for w, (low, high) in enumerate(windows) if low <= high]
    for met, threshold in lists.read(anchor) if going else ():
        met = met[wanted[met]]
        scores = lists.vectors[met] @ anchor
        for w in going:
            low, high = windows[w]
            own = np.flatnonzero((scores >= low) & (scores <= high))
            if len(own):
                found[w] = _first(np.concatenate([found[w][0], ids[met[own]]]), np.concatenate([found[w][1], scores[own]]), k)
        if threshold is None:
            break
        going = [w for w in going if threshold >= (found[w][1][-1] if len(found[w][0]) == k else windows[w][0])]
        if not going:
            break
    return found


def window_of(score: int) -> tuple[int, int]:
    """Lowest and highest score s with 50 score <= 100 s <= 95 score."""
    return -(-score // 2), 19 * score // 20


def _rows(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors (with zeros up to ``width``) of different ids, and where they stood in ``table``."""
    ids = table["vec_id"].to_numpy()
    labels = table["label"].to_numpy()
    column = table["vector"].combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    vectors = np.zeros((len(ids), width), np.int64)
    vectors[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    kept, at = np.unique(ids, return_index=True)
    if len(kept) < len(ids):
        first: dict[int, int] = {}
        for k in sorted(range(len(ids)), key=lambda k: (ids[k], labels[k], vectors[k].tolist())):
            first.setdefault(int(ids[k]), k)
        at = np.array(list(first.values()))
    return ids[at], labels[at], vectors[at], at


def _width(*tables: pa.Table) -> int:
    return max((int(np.diff(t["vector"].combine_chunks().offsets.to_numpy()).max()) for t in tables if t.num_rows), default=0)


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where every sum of products is a whole number below 2^53; as whole numbers of any size otherwise."""
    most = [float(np.abs(x.astype(float)).max()) if x.size else 0.0 for x in (a, b)]
    kind = float if most[0] * most[1] * a.shape[1] < 2**52 else object
    return a.astype(kind), b.astype(kind)


def _long(score: float | int) -> int:
    return max(-(2**63), min(2**63 - 1, int(score)))


def _result(columns: dict[str, list[int]]) -> pa.Table:
    return pa.table({name: pa.array(values, pa.int64()) for name, values in columns.items()})


def _positives_of(k: int):
    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list[int]] = {"anchor_id": [], "positive_id": [], "positive_score": []}
        if anchors.num_rows and rows.num_rows:
            width = _width(anchors, rows)
            a_ids, a_labels, a_vectors, _ = _rows(anchors, width)
            ids, labels, vectors, _ = _rows(rows, width)
            a_vectors, vectors = _exact(a_vectors, vectors)
            lists = SortedLists(vectors)
            for anchor, label, vector in zip(a_ids.tolist(), a_labels, a_vectors, strict=True):
                found, scores = best(lists, ids, vector, (labels == label) & (ids != anchor), k)
                out["anchor_id"] += [anchor] * len(found)
                out["positive_id"] += found.tolist()
                out["positive_score"] += map(_long, scores)
        return _result(out)

    return work


def _negatives_of(k: int):
    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list[int]] = {c: [] for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")}
        if anchors.num_rows and rows.num_rows:
            width = _width(anchors, rows)
            a_ids, a_labels, a_vectors, at = _rows(anchors, width)
            ids, labels, vectors, _ = _rows(rows, width)
            a_vectors, vectors = _exact(a_vectors, vectors)
            lists = SortedLists(vectors)
            positives = anchors["positives"].take(pa.array(at)).to_pylist()
            for anchor, label, vector, own in zip(a_ids.tolist(), a_labels, a_vectors, positives, strict=True):
                found = best_in_windows(lists, ids, vector, labels != label, [window_of(p["positive_score"]) for p in own], k)
                for positive, (near, scores) in zip(own, found, strict=True):
                    out["anchor_id"] += [anchor] * len(near)
                    out["positive_id"] += [positive["positive_id"]] * len(near)
                    out["positive_score"] += [positive["positive_score"]] * len(near)
                    out["negative_id"] += near.tolist()
                    out["negative_score"] += map(_long, scores)
        return _result(out)

    return work


def whole_vectors(rows: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """vec_id, label and whole-number vector of the rows that take part."""
    value = F.col(vector).cast("array<double>")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col(label).isNotNull() & sound)
    return kept.select(
        F.col("vec_id").cast("long"), F.col(label).cast("long").alias("label"), F.transform(value, lambda x: F.floor(x * SCALE)).alias("vector")
    )


def hard_negatives(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``rows`` as whole_vectors gives them; ``is_anchor`` is a condition on vec_id. Per anchor and positive, up to ``negatives`` rows:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    counts = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("vector")).alias("width")).first()
    block = min(BLOCK_VALUES // max(1, counts["width"] or 1), max(LEAST_ROWS, counts["n"] // 32))
    row_blocks, anchor_blocks = -(-counts["n"] // max(1, block)) or 1, -(-counts["anchors"] // ANCHORS) or 1

    def part(name: str, n: int):
        return F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    candidates = rows.withColumns({"row_block": part("row", row_blocks), "anchor_block": every(anchor_blocks)})
    anchors = rows.where(is_anchor).select(*(F.col(c).alias(c) for c in rows.columns))  # columns apart from the candidates'

    def searched(queries: DataFrame, work, schema: str) -> DataFrame:
        dealt = queries.withColumns({"anchor_block": part("anchor", anchor_blocks), "row_block": every(row_blocks)})
        keys = ("anchor_block", "row_block")
        return dealt.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(work, schema)

    def ranked(found: DataFrame, keys: list[str], score: str, row: str, k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), row)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = searched(anchors, _positives_of(positives), "anchor_id long, positive_id long, positive_score long")
    first = ranked(first, ["anchor_id"], "positive_score", "positive_id", positives)
    opened = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    second = searched(
        anchors.join(opened, "vec_id"),
        _negatives_of(negatives),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    second = ranked(second, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return second.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(embeddings: DataFrame) -> DataFrame:
    """The registered mining: labels of every seventh id are moved on by one, anchors are the ids divisible by 50."""
    moved = embeddings.select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding"
    )
    return hard_negatives(whole_vectors(moved), F.col("vec_id") % 50 == 0)
