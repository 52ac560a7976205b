"""Per-group ranking that stays distributed when one group holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Spark prunes groups before the shuffle (WindowGroupLimit) for limits up to this setting.
_GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"

# Rows of a chunk of a large group, sampled rows that set its bounds, and the most chunks per task.
CHUNK_ROWS = 10_000
SAMPLES = 64
CHUNKS_PER_TASK = 8


def newest_first(*ties: str) -> list[Column]:
    """Newest first, undated last, ties in document order."""
    return [F.col("ts").desc_nulls_last(), *[F.col(t) for t in ties or ("pos",)]]


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str | None = None,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """The first ``n`` rows of each group.

    Small ``n`` is pruned inside each map task before the shuffle, so a group of any size sends at
    most ``n`` rows per task. For an ``n`` above Spark's pruning limit the groups are first cut in
    hashed slices of ``spread_by``, which needs one more shuffle but never puts a whole group in
    one task.
    """
    limit = int(df.sparkSession.conf.get(_GROUP_LIMIT_CONF, "1000"))
    name = rank or "_rank"
    if n > limit and spread_by:
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*spread_by), F.lit(64)))
        within = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            sliced.withColumn("_slice_rank", F.row_number().over(within))
            .where(F.col("_slice_rank") <= n)
            .drop("_slice", "_slice_rank")
        )
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_per_group(df, keys, order, 1)


def with_chunks(
    df: DataFrame, keys: Sequence[str], rank: Sequence[Column], chunk_rows: int = CHUNK_ROWS
) -> tuple[DataFrame, bool]:
    """``df`` with ``_chunk``, which cuts every large group into stretches of about equal row counts.

    Numbers rise along ``rank`` (columns that order a group's rows totally, ascending). A chunk holds
    about ``chunk_rows`` rows, more in tables that would otherwise have over ``CHUNKS_PER_TASK``
    chunks per shuffle task; smaller groups are chunk 0. The bounds are quantiles of a sample taken by
    hash, ``SAMPLES`` rows a chunk, so they follow the rows however these lie in time. Also tells
    whether any group was cut: that is known before, from one count per group.
    """
    keys = list(keys)
    spark = df.sparkSession
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    sizes = counts.agg(F.sum("_n").alias("rows"), F.max("_n").alias("most")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    target = max(chunk_rows, (sizes["rows"] or 0) // (CHUNKS_PER_TASK * tasks))
    if (sizes["most"] or 0) <= target:
        return df.withColumn("_chunk", F.lit(0).cast("bigint")), False
    at = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)])
    every = max(1, target // SAMPLES)
    # Groups over the target, and so the bounds of all of them, are few: rows / target.
    hot = F.broadcast(counts.where(F.col("_n") > target).drop("_n"))
    ranked = df.withColumn("_at", at)
    sample = ranked.select(*keys, "_at").where(F.pmod(F.xxhash64(*keys, "_at"), F.lit(every)) == 0).join(hot, keys)
    along = Window.partitionBy(*keys).orderBy("_at")
    step = max(1, target // every)
    bounds = (
        sample.withColumn("_k", F.row_number().over(along))
        .where(F.col("_k") % step == 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_at")).alias("_bounds"))
    )
    most = sizes["most"] // target * 4 + 1

    def chunk(bounds_of: Column, own: Column) -> Column:
        """How many bounds are not above the row, by bisection."""
        halves = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
        return F.aggregate(
            halves,
            F.lit(0),
            lambda below, half: F.when(
                F.coalesce(F.get(bounds_of, below + half - 1) <= own, F.lit(False)), below + half
            ).otherwise(below),
        )

    cut = ranked.join(F.broadcast(bounds), keys, "left").withColumn(
        "_chunk",
        F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(chunk(F.col("_bounds"), F.col("_at"))).cast("bigint"),
    )
    return cut.drop("_at", "_bounds"), True


def position_in_group(
    df: DataFrame,
    keys: Sequence[str],
    rank: Sequence[Column],
    name: str = "position",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """1-based position of every row in its group along ``rank``, for groups of any size.

    Rows are numbered inside (group, chunk); the chunks of a group are few, so their running counts
    are cheap; the two add up to the exact position. Without large groups there is one shuffle.
    """
    keys = list(keys)
    chunked, is_cut = with_chunks(df, keys, rank, chunk_rows)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*rank)
    if not is_cut:
        inside = Window.partitionBy(*keys).orderBy(*rank)
        return chunked.withColumn(name, F.row_number().over(inside).cast("bigint")).drop("_chunk")
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*keys, "_chunk")
        .count()
        .withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    numbered = chunked.withColumn("_inside", F.row_number().over(inside))
    return (
        numbered.join(offsets, [*keys, "_chunk"], "left")  # rows without a key are one uncut group
        .withColumn(name, (F.col("_inside") + F.coalesce("_offset", F.lit(0))).cast("bigint"))
        .drop("_inside", "_offset", "_chunk")
    )
