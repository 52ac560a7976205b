"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Every source is cut in blocks of ``block_rows`` rows and has a whole-number weight: its share of every full round is
``weight`` blocks out of the sum of the weights of all sources (a *round*). Block j = 0, 1, … of a source with m of the M
blocks of a round is released at slot floor(j * M / m) and due before slot ceil((j + 1) * M / m); in each slot the released
block with the earliest deadline goes first (ties: larger weight, then source name). These windows make the schedule Pfair:
after any number of slots each source is less than one block away from its target, and every round ends exactly on it.

All rounds with the same shares have the same schedule. Shares change only when a source runs out: sources with fewer
blocks left than their weight give what they have, and the others' targets are the same weights over a smaller sum.
So the schedule of a whole corpus is one small table (kind of round, source, block in the round, slot), worked out once
per kind of round by folding over its slots, and every row finds its slot by a join: no row is dropped, repeated or
looked at in sequence. There are at most two kinds of round per source, each as long as the sum of the weights; they are
dealt over the tasks, and a fold keeps the waiting blocks as plain numbers that order them by deadline and rank.

Rows of a source are taken in the order of a hash of doc_id (a fixed shuffle). Their numbers come from counts per
(source, hash range) and running sums over the ranges, so a source that holds most rows is spread over
16 ** ``RANGE_DIGITS`` tasks.

Rules for odd input: a null source is a source of its own; null doc_ids and repeated rows are rows like any other, in
an order fixed by doc_id and text hash (equal rows are interchangeable); an empty table gives an empty result;
sources without a given weight have weight 1, and weights of sources without rows do not matter; weights must be positive.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_ROWS = 16
ROUND, PER_SOURCE = 200, 4
RANGE_DIGITS = 3
EXPONENT = 0.5


def tempered_weights(sizes: DataFrame, exponent: float = EXPONENT, round_blocks: int = ROUND) -> DataFrame:
    """sizes (source, rows) with column weight: whole numbers in proportion to rows ** exponent that add up to about
    ``round_blocks`` or PER_SOURCE blocks per source, whichever is more; at least 1. (Exponent 1 is proportional, 0 is uniform.)"""
    power = F.pow(F.col("rows").cast("double"), F.lit(exponent))
    everyone = Window.partitionBy(F.lit(0))  # one row per source
    length = F.greatest(F.lit(round_blocks), PER_SOURCE * F.count(F.lit(1)).over(everyone))
    return sizes.withColumn("weight", F.greatest(F.lit(1), F.round(power / F.sum(power).over(everyone) * length)).cast("bigint"))


def given_weights(sizes: DataFrame, weights: Mapping[str, int]) -> DataFrame:
    """sizes (source, rows) with column weight from a mapping; sources it does not name have weight 1."""
    for source, value in weights.items():
        if value < 1:
            raise ValueError(f"weight of {source!r} must be a positive whole number")
    given = [F.lit(x) for pair in weights.items() for x in pair]
    weight = F.coalesce(F.try_element_at(F.create_map(*given), F.col("source")), F.lit(1)) if given else F.lit(1)
    return sizes.withColumn("weight", weight.cast("bigint"))


def per_source(weighted: DataFrame, block_rows: int) -> DataFrame:
    """From (source, rows, weight): also blocks, full (its rounds with all of its weight), place (its rank among equal
    deadlines) and sources (their number). All sources meet in one task here: one row per source."""
    blocks = F.ceil(F.col("rows") / block_rows).cast("bigint")
    everyone = Window.partitionBy(F.lit(0))
    return (
        weighted.select("source", "weight", blocks.alias("blocks"))
        .withColumn("full", F.expr("blocks div weight"))
        .withColumn("place", F.row_number().over(everyone.orderBy(F.desc("weight"), F.asc_nulls_first("source"))).cast("bigint") - 1)
        .withColumn("sources", F.count(F.lit(1)).over(everyone))
    )


def earliest_deadlines(entries: Column, slots: Column) -> Column:
    """Keys in the order of their slots. ``entries``: struct(release, keys) by release; keys ascend with the deadline, then
    the rank. In every slot the keys released there join those that wait, and the least one goes."""

    def step(state: Column, slot: Column) -> Column:
        entry = F.get(entries, state["at"])
        now = entry["release"] == slot
        waiting = F.when(now, F.concat(state["waiting"], entry["keys"])).otherwise(state["waiting"])
        least = F.array_min(waiting)
        return F.struct(
            (state["at"] + F.when(now, 1).otherwise(0)).alias("at"),
            F.array_remove(waiting, least).alias("waiting"),
            F.concat(state["out"], F.array(least)).alias("out"),
        )

    nothing = F.array().cast("array<bigint>")
    first = F.struct(F.lit(0).alias("at"), nothing.alias("waiting"), nothing.alias("out"))
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), slots - 1), first, step, lambda s: s["out"])


def kind_bounds(sources: DataFrame) -> DataFrame:
    """One row: the first rounds of all kinds of round, ascending; at most two per source and 0."""
    each = sources.select(F.explode(F.array(F.lit(0).cast("bigint"), "full", F.col("full") + 1)).alias("first")).distinct()
    return each.agg(F.array_sort(F.collect_list("first")).alias("bounds"))


def schedules(sources: DataFrame) -> DataFrame:
    """(first, slots, base, place, block, slot): for every kind of round its first round, its slots, the slots before it,
    and the slot of every block of every source in such a round. Kinds are dealt over the tasks."""
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = F.least("weight", F.col("blocks") - F.col("first") * F.col("weight"))
    shares = (
        sources.withColumn("bounds", kind_bounds(sources).scalar())
        .select("place", "sources", "weight", "blocks", F.explode(F.filter("bounds", lambda b: b <= F.col("full"))).alias("first"))
        .withColumn("m", m)
        .where("m > 0")
        .repartition(tasks, "first")
        .withColumn("slots", F.sum("m").over(Window.partitionBy("first")))
    )
    order = Window.partitionBy(F.lit(0)).orderBy("first")  # a row for each kind: at most two per source
    bases = (
        shares.groupBy("first")
        .agg(F.first("slots").alias("slots"))
        .withColumn("n", F.coalesce(F.lead("first").over(order) - F.col("first"), F.lit(1)))
        .withColumn("base", F.coalesce(F.sum(F.col("n") * F.col("slots")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("first", "base")
    )
    windows = shares.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1))).select(
        "first",
        "slots",
        "sources",
        F.expr("block * slots div m").alias("release"),
        (((F.expr("((block + 1) * slots + m - 1) div m") * F.col("sources") + F.col("place")) * F.col("slots")) + F.col("block")).alias("key"),
    )
    dealt = (
        windows.groupBy("first", "slots", "sources", "release")
        .agg(F.collect_list("key").alias("keys"))
        .groupBy("first", "slots", "sources")
        .agg(F.array_sort(F.collect_list(F.struct("release", "keys"))).alias("entries"))
        .select("first", "slots", "sources", F.posexplode(earliest_deadlines(F.col("entries"), F.col("slots"))).alias("slot", "key"))
    )
    return dealt.select(
        "first", "slots", F.expr("key div slots % sources").alias("place"), F.expr("key % slots").alias("block"), F.col("slot").cast("bigint").alias("slot")
    ).join(bases, "first")


def last_at_most(bounds: Column, value: Column) -> Column:
    """The last entry of ascending ``bounds`` that is not above ``value``, by bisection (up to 2^20 entries)."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(20))])
    at = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step) <= value, at + step).otherwise(at))
    return F.get(bounds, at)


def mix(docs: DataFrame, weights: Mapping[str, int] | None = None, block_rows: int = BLOCK_ROWS, exponent: float = EXPONENT, round_blocks: int = ROUND) -> DataFrame:
    """``docs`` with (new) mix_slot (the slot of the row's block in the interleaved corpus) and mix_at (its place in the
    block): ordering by both gives the mixture. Targets come from ``weights``, or from the sizes by ``exponent``."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    text = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("bigint")
    docs = docs.drop("mix_slot", "mix_at")
    # The whole row travels as one column, so names of its columns cannot meet those used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "source", order.alias("__hash"), text.alias("__text")).withColumn(
        "__range", F.substring("__hash", 1, RANGE_DIGITS)
    )
    counts = rows.groupBy("source", "__range").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("source").agg(F.sum("n").alias("rows"))
    weighted = tempered_weights(sizes, exponent, round_blocks) if weights is None else given_weights(sizes, weights)
    sources = per_source(weighted, block_rows)

    # Small side: per source and hash range, the rows before it and the source's weight and rank.
    before = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).select(
        F.col("source").alias("__source"), F.col("__range").alias("__r"), "start", "weight", "place"
    )
    within = Window.partitionBy("source", "__range").orderBy("__hash", "doc_id", "__text")
    numbered = rows.withColumn("__at", F.row_number().over(within) - 1).join(
        starts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__range") == F.col("__r"))
    )
    number = F.col("start") + F.col("__at")
    placed = (
        numbered.withColumn("__block", F.floor(number / block_rows).cast("bigint"))
        .withColumn("mix_at", (number - F.col("__block") * block_rows).cast("int"))
        .withColumn("__round", F.expr("__block div weight"))
        .withColumn("__j", F.col("__block") - F.col("__round") * F.col("weight"))
        .withColumn("__bounds", kind_bounds(sources).scalar())
        .withColumn("__kind", last_at_most(F.col("__bounds"), F.col("__round")))
        .drop("__bounds")
    )
    slots = schedules(sources).select(
        F.col("first").alias("__kind"), F.col("place"), F.col("block").alias("__j"), "slots", "base", F.col("slot").alias("__slot")
    )
    joined = placed.join(slots, ["place", "__kind", "__j"])
    slot = F.col("base") + (F.col("__round") - F.col("__kind")) * F.col("slots") + F.col("__slot")
    return joined.select("__row.*", slot.alias("mix_slot"), "mix_at")


def in_mix_order(mixed: DataFrame) -> DataFrame:
    """Rows range-sorted by their place in the mixture."""
    return mixed.repartitionByRange("mix_slot", "mix_at").sortWithinPartitions("mix_slot", "mix_at")
