"""Streaming forms. Stateless steps are the batch code; state is kept per (feed, id) or per host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsloom.operators.hosts import HOST_STATE, host_cooldowns
from newsloom.params import FeedParams
from newsloom.plans.fetch import FeedRun, fetch
from newsloom.sinks.tables import ChangeTable, KeyedTable, SnapshotTable
from newsloom.sources.tables import FEED_DOCUMENTS, FETCH_LOG, RESPONSES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Bounds what one micro-batch can hold, also when a stream catches up on a backlog.
FILES_PER_BATCH = 64


def use_rocksdb(spark: SparkSession) -> None:
    """Keep operator state on disk rather than in memory, for ``stream_unseen`` over many ids."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _stream(spark: SparkSession, path: str, schema: str, files_per_batch: int) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def document_stream(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    return _stream(spark, path, FEED_DOCUMENTS, files_per_batch)


def response_stream(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    return _stream(spark, path, RESPONSES, files_per_batch)


def fetch_log_stream(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    return _stream(spark, path, FETCH_LOG, files_per_batch)


def stream_items(documents: DataFrame, params: FeedParams = FeedParams()) -> DataFrame:
    """Items of landed documents; the limit applies per document. No state, no shuffle."""
    return FeedRun(fetch(documents, params).rows, params).items()


def stream_unseen(items: DataFrame, horizon: str = "30 days") -> DataFrame:
    """Each (feed, id) once. Ids are forgotten ``horizon`` after their ``fetched_at``.

    The event time is when the document was fetched; publication dates may be missing.
    """
    return items.withWatermark("fetched_at", horizon).dropDuplicatesWithinWatermark(
        ["feed_url", "id"]
    )


def update_changes(table: ChangeTable, items: DataFrame, version: int, tie: str = "request_pos") -> None:
    """Fold a batch of item versions into the table: what is new or has another hash than the version before.

    Only the last versions of items in the batch take part, so the work after reading the table follows
    the batch. The changes are written before the last versions: a batch that is repeated starts from the
    same table and writes the same rows.
    """
    versions = items.select(
        "feed_url",
        "id",
        F.unix_micros("fetched_at").alias("at_us"),
        F.col(tie).cast("bigint").alias("tie"),
        F.coalesce("content_hash", F.lit("")).alias("content_hash"),
    )
    at = F.struct("at_us", "tie", "content_hash")
    known = table.last.read(before=version)
    if known is None:
        rows = versions.withColumn("_known", F.lit(False))
    else:
        own = known.join(versions.select("feed_url", "id").distinct(), ["feed_url", "id"], "left_semi")
        # Versions that do not come after the last one are late; equal times are told apart by the
        # tie-breaker, and equal tie-breakers by the hash.
        seen = own.select("feed_url", "id", at.alias("_seen"))
        later = versions.join(seen, ["feed_url", "id"], "left").where(F.col("_seen").isNull() | (at > F.col("_seen")))
        rows = later.drop("_seen").withColumn("_known", F.lit(False)).unionByName(own.withColumn("_known", F.lit(True)))
    along = Window.partitionBy("feed_url", "id").orderBy("at_us", "tie", "content_hash")
    before = F.lag("content_hash").over(along)
    change = F.when(before.isNull(), F.lit("added")).when(before != F.col("content_hash"), F.lit("changed"))
    changed = rows.withColumn("change", change).where(~F.col("_known") & F.col("change").isNotNull())
    changed.select(
        "feed_url", "id", F.timestamp_micros("at_us").alias("fetched_at"), "change", F.nullif("content_hash", F.lit("")).alias("content_hash")
    ).write.mode("overwrite").parquet(table.directory(version))
    newest = rows.where(~F.col("_known")).groupBy("feed_url", "id").agg(F.max(at).alias("_last"))
    table.last.write(newest.select("feed_url", "id", "_last.*"), version)


def stream_changes(items: DataFrame, table: ChangeTable, tie: str = "request_pos"):
    """A stream writer of ``added`` / ``changed`` per (feed, id) by content hash, in the order of ``fetched_at``.

    Versions of one time follow each other by the whole number ``tie``. Versions before the last one
    seen are ignored.
    """
    return items.writeStream.foreachBatch(lambda batch, batch_id: update_changes(table, batch, batch_id + 1, tie))


def stream_snapshots(responses: DataFrame, table: SnapshotTable, compact_every: int = 20):
    """A stream writer that keeps the latest body per feed, one delta per micro-batch.

    Every ``compact_every`` batches the deltas are folded, so a read meets a bounded number of them.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        table.append(batch, version)
        if version % compact_every == 0:
            table.compact(version)

    return responses.writeStream.foreachBatch(keep)


def host_state_table(spark: SparkSession, path: str, compact_every: int = 20) -> KeyedTable:
    return KeyedTable(spark, path, HOST_STATE, ["authority"], ["last_ts", "last_id"], compact_every)


def update_host_state(
    table: KeyedTable, log: DataFrame, version: int, order: tuple[str, str] = ("ts", "log_id")
) -> None:
    """Fold a batch of fetch-log rows into the host table with the batch operator.

    Only the hosts of the batch are worked out and written. Rows that come before a host's last seen
    row, by time and then id, are ignored. One host may hold most of a batch: the operator works in chunks
    and never puts a host in one task.
    """
    state = table.read(before=version)
    if state is not None:
        state = state.join(log.select("authority").distinct(), "authority", "left_semi")
        seen = state.select("authority", F.struct("last_ts", "last_id").alias("_seen"))
        at, tie = order
        later = F.struct(F.col(at).alias("last_ts"), F.col(tie).cast("bigint").alias("last_id")) > F.col("_seen")
        log = (
            log.join(seen, "authority", "left")
            .where(F.col("_seen").isNull() | later)
            .drop("_seen")
        )
    table.write(host_cooldowns(log, order, state=state), version)


def stream_host_state(log: DataFrame, table: KeyedTable, order: tuple[str, str] = ("ts", "log_id")):
    """A stream writer that keeps cooldown, warm period and streak per host."""
    return log.writeStream.foreachBatch(
        lambda batch, batch_id: update_host_state(table, batch, batch_id + 1, order)
    )


def run_available(writer, checkpoint: str) -> None:
    """Process what is there, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
