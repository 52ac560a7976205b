"""Streams over several small batches give what the batch operators give."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.operators import hosts, snapshots
from newsloom.params import FeedParams
from newsloom.plans.fetch import fetch
from newsloom.sinks.tables import ChangeTable, SnapshotTable
from newsloom.sources import tables
from newsloom.streaming import pipelines

T0 = datetime(2026, 1, 1)


def land(spark, rows, schema, path, parts=4):
    """Write rows as several files that a stream reads one after the other."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = rows[i * size : (i + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def finish(df, path):
    pipelines.run_available(df.writeStream.format("parquet").option("path", f"{path}/out"), f"{path}/check")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")


def documents(n=12):
    rows = []
    for i in range(n):
        items = "".join(
            f"<item><title>t{j}</title><link>/p/{j}</link><pubDate>{j + 1:02d} Jan 2026 00:00:00 GMT</pubDate>"
            f"<description>body {j} v{i // 4 if j == 3 else 0}</description></item>"
            for j in range(5)
        )
        body = f"<rss><channel><title>f</title>{items}</channel></rss>"
        rows.append((i, f"https://f{i % 4}.example/feed", body, "text/xml", T0 + timedelta(hours=i)))
    return rows


def test_items_unseen_and_changes(spark, tmp_path):
    path = land(spark, documents(), tables.FEED_DOCUMENTS, str(tmp_path / "in"))
    params = FeedParams(limit=3)
    stream = pipelines.document_stream(spark, path, files_per_batch=1)
    items = pipelines.stream_items(stream, params)
    got = finish(items.select("feed_url", "id", "title", "content", "fetched_at"), str(tmp_path / "items"))
    want = fetch(tables.read_feed_documents(spark, path), params).items()
    key = ["feed_url", "id", "title", "content", "fetched_at"]
    assert sorted(got.select(*key).collect()) == sorted(want.select(*key).collect())

    unseen = finish(pipelines.stream_unseen(items).select("feed_url", "id"), str(tmp_path / "unseen"))
    assert sorted(unseen.collect()) == sorted(want.select("feed_url", "id").distinct().collect())

    table = ChangeTable(spark, str(tmp_path / "changes"))
    pipelines.run_available(pipelines.stream_changes(items, table), str(tmp_path / "changes-check"))
    changes = table.changes()
    counts = {(r.change): r["count"] for r in changes.groupBy("change").count().collect()}
    # 4 feeds with 3 items each appear; item t3 of each changes in the second and third round.
    assert counts == {"added": 12, "changed": 8}


def test_snapshots_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(80):
        code = rng.choice([200, 304, 304, 429, 500])
        rows.append((f"f{rng.randrange(6)}", code, f"b{i}" if code == 200 else None, f"e{i}", None, "x", None, T0 + timedelta(minutes=i)))
    path = land(spark, rows, tables.RESPONSES, str(tmp_path / "in"))
    table = SnapshotTable(spark, str(tmp_path / "table"))
    stream = pipelines.response_stream(spark, path, files_per_batch=1)
    pipelines.run_available(pipelines.stream_snapshots(stream, table, compact_every=2), str(tmp_path / "check"))
    assert not (tmp_path / "table" / "delta000000000001").exists() and (tmp_path / "table" / "base000000000004").exists()
    want = sorted(snapshots.upsert_snapshots(None, spark.createDataFrame(rows, tables.RESPONSES)).collect(), key=str)
    assert sorted(table.read().collect(), key=str) == want
    # Compaction changes nothing, and a repeated batch changes nothing.
    table.compact(4)
    assert sorted(table.read().collect(), key=str) == want
    table.append(tables.read_responses(spark, path).where(F.col("etag") == "none"), 5)
    assert sorted(table.read().collect(), key=str) == want
    assert SnapshotTable(spark, str(tmp_path / "nothing")).read() is None


def test_host_state_stream(spark, tmp_path):
    rng = random.Random(4)
    rows, t = [], 0
    for _ in range(200):
        t += rng.randrange(0, 3) * 300  # equal times are common, also across batches
        rows.append((len(rows), rng.choice(["hot:443", "hot:443", "b:80"]), T0 + timedelta(seconds=t), rng.choice([200, 429, 429, 403]), rng.choice([None, "7"])))
    path = land(spark, rows, tables.FETCH_LOG, str(tmp_path / "in"))
    table = pipelines.host_state_table(spark, str(tmp_path / "table"), compact_every=2)
    stream = pipelines.fetch_log_stream(spark, path, files_per_batch=1)
    pipelines.run_available(pipelines.stream_host_state(stream, table), str(tmp_path / "check"))
    assert table.versions() == [2, 3, 4] and not (tmp_path / "table" / "delta000000000002").exists()
    want = hosts.host_cooldowns(spark.createDataFrame(rows, tables.FETCH_LOG))
    assert sorted(table.read().collect()) == sorted(want.collect())
    # Running a batch again replaces its version and gives the same state.
    last = table.versions()[-1]
    pipelines.update_host_state(table, spark.createDataFrame(rows[150:], tables.FETCH_LOG), last)
    assert sorted(table.read().collect()) == sorted(want.collect())


def test_changes_of_equal_times_across_batches(spark, tmp_path):
    schema = "request_pos bigint, feed_url string, id string, fetched_at timestamp, content_hash string"
    rows = [(0, "f", "i", T0, "a"), (1, "f", "i", T0 + timedelta(seconds=1), "c"), (2, "f", "i", T0 + timedelta(seconds=1), "b"), (3, "f", "i", T0 + timedelta(seconds=1), "a")]
    for parts in (4, 2, 1):
        path = land(spark, rows, schema, str(tmp_path / f"in{parts}"), parts=parts)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        table = ChangeTable(spark, str(tmp_path / f"out{parts}"))
        assert table.changes().collect() == []
        pipelines.run_available(pipelines.stream_changes(stream, table), str(tmp_path / f"check{parts}"))
        got = table.changes()
        assert sorted((r.change, r.content_hash) for r in got.collect()) == [("added", "a"), ("changed", "a"), ("changed", "b"), ("changed", "c")]


def test_changes_and_hosts_write_what_a_batch_brings(spark, tmp_path):
    schema = "request_pos bigint, feed_url string, id string, fetched_at timestamp, content_hash string"
    first = [(n, f"f{n}", "i", T0, "a") for n in range(300)]
    table = ChangeTable(spark, str(tmp_path / "changes"))
    pipelines.update_changes(table, spark.createDataFrame(first, schema), 1)
    late = [(301, "f1", "i", T0 - timedelta(hours=1), "z"), (302, "f2", "i", T0 + timedelta(hours=1), None), (303, "new", "i", T0, "a"), (303, "new", "i", T0, "a")]
    batch = spark.createDataFrame(late, schema)
    for _ in range(2):  # repeating a batch changes nothing
        pipelines.update_changes(table, batch, 2)
        got = {(r.feed_url, r.change, r.content_hash) for r in table.changes().collect()}
        assert got == {(f"f{n}", "added", "a") for n in range(300)} | {("f2", "changed", None), ("new", "added", "a")}
        assert spark.read.parquet(str(tmp_path / "changes" / "last" / "delta000000000002")).count() == 2
    assert table.last.read().count() == 301 and table.last.read(before=2).count() == 300

    state = pipelines.host_state_table(spark, str(tmp_path / "hosts"))
    rows = [(n, f"h{n}:80", T0, 429, None) for n in range(200)]
    pipelines.update_host_state(state, spark.createDataFrame(rows, tables.FETCH_LOG), 1)
    more = [(1000, "h7:80", T0 + timedelta(minutes=1), 429, None)]
    pipelines.update_host_state(state, spark.createDataFrame(more, tables.FETCH_LOG), 2)
    assert spark.read.parquet(str(tmp_path / "hosts" / "delta000000000002")).count() == 1
    assert {r.authority: r.streak for r in state.read().collect()} == {f"h{n}:80": 2 if n == 7 else 1 for n in range(200)}
