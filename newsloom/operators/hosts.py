"""Per-host throttle analysis of fetch logs, exact for hosts of any size.

A streak of throttled responses depends on everything before it, which would put a whole host in
one window. Instead a large host's log is cut in chunks of about equal row counts: rows are counted
inside (host, chunk), the few chunks of a host are scanned for what they carry over, and the carry is
added back.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.functions.dates import retry_after_seconds
from newsloom.functions.urls import authority
from newsloom.functions.values import error_object, wait_details
from newsloom.operators.ranking import CHUNK_ROWS, position_in_group, with_chunks
from newsloom.operators.snapshots import is_throttled

# Pacing defaults in seconds.
BASE_COOLDOWN = 2
MAX_COOLDOWN = 60
SPACING = 1
WARM_WINDOW = 120
MAX_WAIT = 60
# Doubling stops mattering long before this exponent.
MAX_DOUBLINGS = 30

HOST_STATE = (
    "authority string, streak bigint, next_allowed timestamp, warm_until timestamp, last_ts timestamp, "
    "last_id bigint"
)

_FIRST_CHUNK = -(1 << 62)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    """A timestamp moved by a possibly fractional number of seconds."""
    return F.timestamp_micros(F.unix_micros(ts) + F.round(seconds * 1_000_000).cast("bigint"))


def throttle_streaks(
    log: DataFrame,
    order: Sequence[str] = ("ts", "log_id"),
    chunk_rows: int = CHUNK_ROWS,
    state: DataFrame | None = None,
) -> DataFrame:
    """The log with ``streak``: consecutive throttled responses of the host up to each row.

    Any other response resets it (and has streak 0). ``order`` must start with ``ts`` and order a
    host's rows totally. ``state`` (``HOST_STATE``) carries the streaks of earlier logs over.
    """
    rank = [F.unix_micros(order[0]), *[F.col(c) for c in order[1:]]]
    chunked, is_cut = with_chunks(log, ["authority"], rank, chunk_rows)
    along_rows = Window.partitionBy("authority", *(["_chunk"] if is_cut else [])).orderBy(*rank)
    inside = along_rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    throttled = is_throttled(F.col("http_status"))
    local = chunked.withColumn("_n", F.row_number().over(along_rows)).withColumn(
        "_last_reset", F.max(F.when(~throttled, F.col("_n"))).over(inside)
    )
    if is_cut or state is not None:
        local = local.join(_carries(local, state), ["authority", "_chunk"], "left")
    else:
        local = local.withColumn("_carry", F.lit(0))
    streak = (
        F.when(~throttled, F.lit(0))
        .when(F.col("_last_reset").isNull(), F.col("_n") + F.coalesce("_carry", F.lit(0)))
        .otherwise(F.col("_n") - F.col("_last_reset"))
    )
    return local.withColumn("streak", streak.cast("bigint")).drop("_chunk", "_n", "_last_reset", "_carry")


def _carries(local: DataFrame, state: DataFrame | None) -> DataFrame:
    """``(authority, _chunk, _carry)``: the streak that reaches into each chunk from those before it.

    A chunk is summed up by its last streak and whether it holds a reset; such summaries add up in
    any grouping, so a host's few chunks are scanned instead of its rows.
    """
    chunks = local.groupBy("authority", "_chunk").agg(
        (F.max("_n") - F.coalesce(F.max("_last_reset"), F.lit(0))).cast("bigint").alias("_tail"),
        F.max("_last_reset").isNotNull().alias("_resets"),
    )
    if state is not None:
        chunks = chunks.unionByName(
            state.select(
                "authority",
                F.lit(_FIRST_CHUNK).alias("_chunk"),
                F.col("streak").alias("_tail"),
                F.lit(True).alias("_resets"),
            )
        )
    along = Window.partitionBy("authority").orderBy("_chunk")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        chunks.withColumn("_sum", F.sum("_tail").over(upto))
        .withColumn("_base", F.max(F.when(F.col("_resets"), F.col("_sum") - F.col("_tail"))).over(upto))
        .withColumn("_carry", F.lag(F.col("_sum") - F.coalesce("_base", F.lit(0)), 1, 0).over(along))
        .select("authority", "_chunk", "_carry")
    )


def cooldown_seconds(streak: Column, retry_after: Column) -> Column:
    """The server's wait if it gave one, else doubling from the base; both up to the maximum."""
    doubled = F.lit(BASE_COOLDOWN) * F.pow(
        F.lit(2.0), F.least(F.greatest(streak - 1, F.lit(0)), F.lit(MAX_DOUBLINGS))
    )
    return F.least(F.coalesce(retry_after, doubled), F.lit(float(MAX_COOLDOWN)))


def host_cooldowns(
    log: DataFrame,
    order: Sequence[str] = ("ts", "log_id"),
    chunk_rows: int = CHUNK_ROWS,
    state: DataFrame | None = None,
) -> DataFrame:
    """``HOST_STATE`` after the log: streak, earliest next request, end of the warm period.

    Both times only move forward, so they are plain maxima over the throttled rows. ``order`` is the
    time and a whole-number id that tells rows of equal times apart.
    """
    rows = throttle_streaks(log, order, chunk_rows, state)
    wait = cooldown_seconds(F.col("streak"), retry_after_seconds("retry_after", "ts"))
    hit = F.col("streak") > 0
    after = rows.groupBy("authority").agg(
        F.max_by("streak", F.struct(*order)).alias("streak"),
        F.max(F.when(hit, plus_seconds(F.col("ts"), wait))).alias("next_allowed"),
        F.max(F.when(hit, plus_seconds(F.col("ts"), F.lit(WARM_WINDOW)))).alias("warm_until"),
        F.max(F.struct(*order)).alias("_last"),
    ).select(
        "authority",
        "streak",
        "next_allowed",
        "warm_until",
        F.col("_last")[order[0]].alias("last_ts"),
        F.col("_last")[order[1]].cast("bigint").alias("last_id"),
    )
    if state is None:
        return after
    return (
        after.unionByName(state)
        .groupBy("authority")
        .agg(
            F.max_by("streak", F.struct("last_ts", "last_id")).alias("streak"),
            F.max("next_allowed").alias("next_allowed"),
            F.max("warm_until").alias("warm_until"),
            F.max(F.struct("last_ts", "last_id")).alias("_last"),
        )
        .select("authority", "streak", "next_allowed", "warm_until", "_last.last_ts", "_last.last_id")
    )


def polite_schedule(
    pending: DataFrame,
    state: DataFrame,
    as_of: datetime | Column,
    position: str = "request_pos",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """When each pending URL may be sent: ``wait_ms`` from ``as_of``, or a ``RATE_LIMITED`` error.

    Assumes one request at a time per host and instant answers. The first request of a host waits
    for its cooldown; later ones are spaced while the host is warm. A cooldown beyond the maximum
    wait sheds all of the host's requests; queueing behind siblings does not count against it.
    """
    now = F.unix_micros(as_of if isinstance(as_of, Column) else F.lit(as_of))
    queued = position_in_group(
        pending.withColumn("authority", authority("feed_url")),
        ["authority"],
        [F.col(position)],
        "_turn",
        chunk_rows,
    )
    joined = queued.join(state.select("authority", "next_allowed", "warm_until"), "authority", "left")

    def ms_from_now(ts: str) -> Column:
        left = (F.unix_micros(ts) - now) / 1000
        return F.greatest(F.coalesce(F.ceil(left), F.lit(0)), F.lit(0)).cast("bigint")

    timed = joined.withColumn("_base", ms_from_now("next_allowed")).withColumn(
        "_warm", ms_from_now("warm_until")
    )
    base = F.col("_base")
    # Sends are spaced until the first one that finds the host cold again.
    spaced = F.ceil(F.greatest(F.col("_warm") - base, F.lit(0)) / (SPACING * 1000)).cast("bigint")
    wait = base + F.least(F.col("_turn") - 1, spaced) * (SPACING * 1000)
    shed = base > MAX_WAIT * 1000
    message = F.concat(
        F.lit("rate limited: "),
        F.col("feed_url"),
        F.lit(" (retry after ~"),
        F.floor(base / 1000).cast("string"),
        F.lit("s)"),
    )
    return timed.select(
        *pending.columns,
        "authority",
        F.col("_turn").alias("turn"),
        F.when(~shed, wait).alias("wait_ms"),
        F.when(
            shed, error_object("RATE_LIMITED", message, "feed_url", wait_details(base))
        ).alias("error"),
    )
