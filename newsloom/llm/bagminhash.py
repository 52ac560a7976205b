"""Near-duplicate detection with BagMinHash over weighted word shingles.

A text is the multiset of its five-word shingles (weights are counts; a shorter text is one shingle of all its
words). Two texts are linked if the weighted Jaccard similarity of their multisets is at least ``threshold``; a class
is a connected component of links. Equal texts are always in one class.

Signature (BagMinHash). The weight axis is discretised at the whole numbers. Every shingle owns a Poisson process
over (time, weight level); a point also names one of ``m`` registers. Register i of a text holds the first time of a
point in it whose level lies below the weight of its shingle, so two texts agree on a register with probability equal
to their weighted Jaccard similarity. The levels form a hierarchy: the intervals [0,1), [1,2), [2,4), [4,8) … each have a
process of their own, those above the weight are never looked at, and the one that holds the weight is thinned by
halving: a point of the interval goes to its lower or upper half by a fair hash bit until its unit level is known. Work
stops at the largest register: a process whose next point is later is finished. All texts of a batch
advance together, one point per live process and step, with numpy.

Search. ``m = bands * rows`` registers are cut in bands; texts that agree on a band share a bucket. Two rounds compare every
text with the pivot of each of its buckets (unless they are in one class already), exactly, on the multisets themselves; that takes
linear work and joins most of every family. Then the buckets that still hold several classes are finished: their texts outside the
largest class are compared with all of their texts, in blocks, so that every two texts of a bucket are in one class or were
compared. No link between texts of one bucket is lost, and a family that is one class by then costs nothing.

Distribution. Equal texts meet as (digest, smallest id) by partial aggregation first, so a text that makes up a third
of the table is one row afterwards. Pairs whose pivot is shared by many texts are salted by the text.

Rules for odd input: null text counts as empty; empty texts are equal texts; rows with a null id join their text's
class but never name it unless the class has no other id, and then the class id is null; repeated rows share their class; an
empty table gives an empty result; white space only separates words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from newsloom.llm.common import small_batches
from newsloom.session import scratch_path

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
#: Rounds of one pivot for each bucket; texts of a block when the rest is compared.
ROUNDS, BLOCK = 2, 256
_LAST = (1 << 63) - 1

_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """64-bit hashes of all shingles of each text, in order, repeats included; empty for a text without words."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = split.flatten().dictionary_encode()
    vocabulary = flat.dictionary.to_numpy(zero_copy_only=False)
    known = pd.util.hash_array(vocabulary, categorize=False)
    real = vocabulary != ""
    codes = flat.indices.to_numpy()
    counts = pc.list_value_length(split).to_numpy().astype(np.int64)
    if not len(codes):
        return [np.empty(0, np.uint64) for _ in range(len(counts))]
    kept = real[codes]  # white space at the ends of a text gives empty words
    ends = np.concatenate([[0], np.cumsum(kept)])[np.cumsum(counts)]
    h = known[codes[kept]]
    rolled = np.full(len(h), np.uint64(words))
    with np.errstate(over="ignore"):
        for k in range(words):
            left = max(0, len(h) - k)
            rolled[:left] = _mix(rolled[:left] * _GOLD + h[k:])
        out, start = [], 0
        for end in ends.tolist():
            if end - start >= words:
                out.append(rolled[start : end - words + 1])
            elif end == start:
                out.append(np.empty(0, np.uint64))
            else:  # a short text is one shingle of all its words
                whole = np.array([end - start], np.uint64)
                for k in range(start, end):
                    whole = _mix(whole * _GOLD + h[k])
                out.append(whole)
            start = end
    return out


def weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order and their counts."""
    return np.unique(hashes, return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; two empty ones are equal."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    small, large = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not len(small[0]):
        return 0.0
    at = np.minimum(np.searchsorted(large[0], small[0]), len(large[0]) - 1)
    shared = int(np.minimum(large[1][at], small[1])[large[0][at] == small[0]].sum())
    return shared / (total - shared)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``m`` register values for each multiset (infinite where the multiset is empty)."""
    registers = np.full((len(bags), m), np.inf)
    if not len(bags):
        return registers
    lengths = np.array([len(b[0]) for b in bags])
    doc = np.repeat(np.arange(len(bags)), lengths)
    key = np.concatenate([b[0] for b in bags])
    weight = np.concatenate([b[1] for b in bags]).astype(np.int64)
    # One process for each interval [0,1), [1,2), [2,4) … that starts below the weight.
    pieces = [(doc, key, weight, np.zeros(len(doc), np.int64), np.ones(len(doc), np.int64))]
    low = 1
    while (more := weight > low).any():
        pieces.append((doc[more], key[more], weight[more], np.full(more.sum(), low), np.full(more.sum(), low)))
        low *= 2
    doc, key, weight, start, width = (np.concatenate(x) for x in zip(*pieces, strict=True))
    flat = registers.reshape(-1)
    with np.errstate(over="ignore"):
        state = _mix(key ^ _mix(start.astype(np.uint64) + _GOLD))
        time = np.zeros(len(doc))
        limit = np.full(len(registers), np.inf)
        while len(doc):
            state = state + _GOLD
            draw = _mix(state)
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
            live = time <= limit[doc]
            if not live.all():
                doc, weight, start, width, state, time = (x[live] for x in (doc, weight, start, width, state, time))
            pick = _mix(state ^ _B)
            register = (pick >> np.uint64(32)) % np.uint64(m)
            # Halve the interval until the point's unit level is known; low bits of another draw are the halves.
            level = start + (_mix(pick) & (width - 1).astype(np.uint64)).astype(np.int64)
            inside = level < weight
            np.minimum.at(flat, (doc * m + register.astype(np.int64))[inside], time[inside])
            own = slice(None) if len(doc) > len(registers) else np.unique(doc)
            limit[own] = registers[own].max(axis=1)
    return registers


def band_keys(registers: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band, different bands never mixed."""
    if not len(registers):
        return np.empty((0, bands), np.int64)
    bits = registers.view(np.uint64).reshape(len(registers), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64)[None, :], bits.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(bits.shape[2]):
            key = _mix(key * _GOLD + bits[:, :, r])
    return key.astype(np.int64)


def _buckets(texts: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(node, band key) of every text with words."""

    def run(batches):
        for batch in small_batches(batches, 512):
            nodes = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            bags = [weighted(x) for x in shingles(batch.column(1), words)]
            full = np.array([len(b[0]) > 0 for b in bags], dtype=bool)
            keys = band_keys(signatures([b for b, f in zip(bags, full, strict=True) if f], bands * rows), bands)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(nodes[full], bands), pa.int64()),
                    pa.array(keys.reshape(-1), pa.int64()),
                ],
                names=["node", "bucket"],
            )

    return texts.select("node", "text").mapInArrow(run, "node bigint, bucket bigint")


def _similarity(words: int):
    @pandas_udf("double")
    def similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in parts:
            last_text, last_bag, out = None, None, []
            for start in range(0, len(left), 256):
                own = shingles(pa.array(left[start : start + 256], pa.large_string()), words)
                for a, b in zip(own, right[start : start + 256], strict=True):
                    if b != last_text:  # rows of one pivot come together
                        last_text, last_bag = b, weighted(shingles(pa.array([b], pa.large_string()), words)[0])
                    out.append(overlap(weighted(a), last_bag))
            yield pd.Series(out, dtype="float64")

    return similarity


def _verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (node, pivot) whose multisets overlap enough. A pivot's text is sent once per salt."""
    left = pairs.join(texts.select("node", F.col("text").alias("own")), "node")
    salts = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / 256).cast("int"))
    right = (
        salts.join(texts.select(F.col("node").alias("pivot"), "text"), "pivot")
        .select("pivot", "salts", "text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        .drop("salts")
    )
    sized = left.join(salts.drop("n"), "pivot").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    both = sized.join(right, ["pivot", "salt"])
    return both.select("node", "pivot", _similarity(words)("own", "text").alias("s")).where(F.col("s") >= threshold).select("node", "pivot")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link: the smallest node of its component. Rounds of the two star steps, in
    which each node's links shrink to stars; written to the shared folder after each round; ends when all are stars."""
    spark = links.sparkSession
    edges = links.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).where("a <> b")
    while True:
        # Large star: every neighbour above a node links to the smallest in the neighbourhood.
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: the neighbours below a node, and the node, link to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        path = scratch_path(spark, "links")
        small.where("a <> b").distinct().write.parquet(path)
        edges = spark.read.parquet(path)
        # Stars: a node that links to another links to one only, and none links to it.
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        uneven = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
        if not uneven.head(1):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _pivot_rounds(members: DataFrame, texts: DataFrame, words: int, threshold: float, saved) -> DataFrame:
    """(node, root) of the texts linked through the pivots of their buckets. members: (bucket, node); texts: (node, text)."""
    roots = texts.select("node", F.col("node").alias("root")).limit(0)
    for turn in range(ROUNDS):
        now = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")) if turn else members.withColumn("root", F.col("node"))
        # The first pivots are the same text in all buckets it is in (few pairs); later ones differ by bucket.
        luck = F.xxhash64(F.lit(turn), F.col("node")) if not turn else F.xxhash64(F.lit(turn), "bucket", "node")
        chosen = (
            now.groupBy("bucket")
            .agg(F.min(F.struct(luck.alias("luck"), "node", "root")).alias("p"), F.min("root").alias("low"), F.max("root").alias("high"))
            .where("low < high")
            .select("bucket", F.col("p.node").alias("pivot"), F.col("p.root").alias("pivot_root"))
        )
        pairs = saved(now.join(chosen, "bucket").where("root <> pivot_root").select("node", "pivot").distinct(), "pairs")
        if not pairs.head(1):
            break  # every bucket is of one class
        found = saved(_verified(pairs, texts, words, threshold), "found")
        if found.head(1):
            roots = components(found.union(roots.select("node", F.col("root").alias("pivot"))))
    return roots


def _items(hashes: np.ndarray) -> np.ndarray:
    """One item per occurrence, (shingle, how many before it) hashed: the overlap of two multisets is that of two sets of items."""
    ordered = np.sort(hashes)
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
    turn = np.arange(len(ordered)) - np.maximum.accumulate(np.where(fresh, np.arange(len(ordered)), 0))
    with np.errstate(over="ignore"):
        return _mix(ordered ^ _mix(turn.astype(np.uint64) + _GOLD))


def overlaps(bags: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of the texts ``left`` with the texts ``right`` (places in ``bags``, lists of shingles), by
    products of 0/1 matrices, some thousand items at a time. Of different places only: what one text alone has is left out."""
    items = [_items(x) for x in bags]
    lengths = np.array([len(x) for x in items])
    _, item, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    text = np.repeat(np.arange(len(items)), lengths)
    common = count[item] > 1  # others are in one text only
    text, item = text[common], (np.cumsum(count > 1) - 1)[item[common]]
    order = np.argsort(item, kind="stable")
    text, item = text[order], item[order]
    shared = np.zeros((len(left), len(right)))
    for low in range(0, int(item[-1]) + 1 if len(item) else 0, 4096):
        part = slice(*np.searchsorted(item, [low, low + 4096]))
        has = np.zeros((len(items), 4096), np.float32)
        has[text[part], item[part] - low] = 1
        shared += has[left] @ has[right].T
    return shared / np.maximum(lengths[left][:, None] + lengths[right][None, :] - shared, 1)


def _links_in_cells(cells: DataFrame, words: int, threshold: float) -> DataFrame:
    """(node, pivot) linked texts of one cell. cells: (bucket, r, c, node, root, in_row, in_col, text), a cell's rows together."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        nodes, roots, in_row, in_col, texts = zip(*rows, strict=True)
        left, right, root = np.flatnonzero(in_row), np.flatnonzero(in_col), np.array(roots)
        if not len(left) or not len(right) or len(set(roots)) == 1:
            return []
        close = overlaps(shingles(pa.array(texts, pa.large_string()), words), left, right) >= threshold
        close &= root[left][:, None] != root[right][None, :]
        return [(nodes[left[i]], nodes[right[j]]) for i, j in zip(*np.nonzero(close), strict=True)]

    def run(batches):
        cell, rows = None, []
        for batch in small_batches(batches, 512):
            out: list[tuple[int, int]] = []
            for bucket, r, c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (bucket, r, c) != cell:
                    out += links(rows) if rows else []
                    cell, rows = (bucket, r, c), []
                rows.append(tuple(row))
            yield pa.RecordBatch.from_pydict({"node": pa.array([x for x, _ in out], pa.int64()), "pivot": pa.array([y for _, y in out], pa.int64())})
        out = links(rows) if rows else []
        yield pa.RecordBatch.from_pydict({"node": pa.array([x for x, _ in out], pa.int64()), "pivot": pa.array([y for _, y in out], pa.int64())})

    return cells.mapInArrow(run, "node bigint, pivot bigint")


def _finished(members: DataFrame, texts: DataFrame, roots: DataFrame, words: int, threshold: float, saved) -> DataFrame:
    """``roots`` with the links that pivots missed: afterwards the texts of a bucket are in one class or were compared.

    In a bucket of several classes the texts outside its largest class are compared with all of its texts. Both sides are dealt
    to blocks of about BLOCK texts; a cell is a pair of blocks, and a text travels once per cell. Buckets of equal texts count once."""
    now = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (1, 2)]
    classes = now.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), *marks)
    several = (
        classes.groupBy("bucket")
        .agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
        .where("k > 1")
    )
    open_ = several.groupBy("all", "x1", "x2").agg(F.min(F.struct("bucket", "most")).alias("b"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sized = open_.select(
        F.col("b.bucket").alias("bucket"), F.col("b.most.root").alias("largest"), blocks(F.col("all") - F.col("b.most.n")).alias("rows"), blocks(F.col("all")).alias("cols")
    )
    own = (
        now.join(sized, "bucket")
        .withColumn("row", F.when(F.col("root") != F.col("largest"), F.pmod(F.xxhash64(F.lit(1), "node"), F.col("rows")).cast("int")))
        .withColumn("col", F.pmod(F.xxhash64(F.lit(2), "node"), F.col("cols")).cast("int"))
    )
    down = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.struct(r.alias("r"), F.col("col").alias("c")))
    along = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda c: F.struct(F.col("row").alias("r"), c.alias("c")))
    cells = own.withColumn("cell", F.explode(F.array_distinct(F.when(F.col("row").isNull(), down).otherwise(F.concat(down, along)))))
    placed = cells.select(
        "bucket", "cell.r", "cell.c", "node", "root", F.coalesce(F.col("row") == F.col("cell.r"), F.lit(False)).alias("in_row"), (F.col("col") == F.col("cell.c")).alias("in_col")
    )
    sorted_cells = placed.join(texts, "node").select(*placed.columns, "text").repartition("bucket", "r", "c").sortWithinPartitions("bucket", "r", "c")
    found = saved(_links_in_cells(sorted_cells, words, threshold).distinct(), "found")
    return components(found.union(roots.select("node", F.col("root").alias("pivot")))) if found.head(1) else roots


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with __text (never null), __node (hash of the text) and __rid (doc_id, largest where null)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"__node": F.xxhash64(text), "__rid": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST))})


def _classes(docs: DataFrame, words: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """(__node, class_rid, class_node): the first row of the class, for every text that has company in its class."""
    spark = docs.sparkSession

    def saved(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    keyed = _keyed(docs.select("doc_id", "text"))
    nodes = saved(keyed.groupBy("__node").agg(F.min("__rid").alias("rid"), F.count(F.lit(1)).alias("n")), "nodes")
    buckets = saved(_buckets(keyed.select(F.col("__node").alias("node"), "text"), words, bands, rows).distinct(), "buckets")
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = saved(buckets.join(shared, "bucket"), "members")
    # Texts of the members, each once: by (text hash, first id), so copies of one text never meet in one task.
    wanted = members.select(F.col("node").alias("__node")).distinct().join(nodes, "__node").select("__node", F.col("rid").alias("__rid"))
    texts = saved(
        keyed.join(wanted, ["__node", "__rid"], "left_semi")
        .groupBy("__node", "__rid")
        .agg(F.first("text").alias("text"))
        .select(F.col("__node").alias("node"), F.coalesce("text", F.lit("")).alias("text")),
        "texts",
    )
    roots = _finished(members, texts, _pivot_rounds(members, texts, words, threshold, saved), words, threshold, saved)
    own = nodes.withColumnRenamed("__node", "node")
    rooted = own.join(roots, "node", "left").where(F.col("root").isNotNull() | (F.col("n") > 1)).withColumn("root", F.coalesce("root", "node"))
    head = rooted.groupBy("root").agg(F.min(F.struct("rid", "node")).alias("h"))
    return saved(
        rooted.join(head, "root").select(
            F.col("node").alias("__node"), F.col("h.rid").alias("class_rid"), F.col("h.node").alias("class_node")
        ),
        "classes",
    )


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) for every row: class_id is the smallest doc_id of its class, its own if it is alone."""
    classes = _classes(docs, words, threshold, bands, rows)
    return (
        _keyed(docs.select("doc_id", "text"))
        .select("doc_id", "__node")
        .join(classes, "__node", "left")
        .select(
            "doc_id",
            F.when(F.col("class_rid") == _LAST, F.lit(None)).otherwise(F.coalesce("class_rid", "doc_id")).cast("bigint").alias("class_id"),
        )
    )


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The first row (by doc_id, then text) of every class, with all columns; a repeated row counts once."""
    classes = _classes(docs, words, threshold, bands, rows)
    first = classes.select(F.col("class_node").alias("__node"), F.col("class_rid").alias("__rid")).distinct()
    # The whole row travels as one column, so names of its columns cannot meet those used here.
    keyed = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")).select("row", "__node", "__rid")
    marked = keyed.join(first.withColumn("__first", F.lit(True)), ["__node", "__rid"], "left").join(
        classes.select("__node").withColumn("__classed", F.lit(True)), "__node", "left"
    )
    kept = marked.where(F.col("__first") | F.col("__classed").isNull())
    order = Window.partitionBy("__node", "__rid").orderBy(F.lit(1))
    return kept.withColumn("__turn", F.row_number().over(order)).where("__turn = 1").select("row.*")
