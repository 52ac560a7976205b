"""Operators against brute force on small generated inputs, hot groups included."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.errors import UsageError
from newsloom.operators import discovery, hosts, items, seeds, snapshots
from newsloom.operators.ranking import top_per_group, with_chunks
from newsloom.sources import tables

T0 = datetime(2026, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 items over 8 feeds, most of them in one; one in ten undated."""
    rng = random.Random(5)
    rows = []
    for pos in range(2000):
        feed = "hot" if rng.random() < 0.7 else f"f{rng.randrange(7)}"
        ts = None if rng.random() < 0.1 else at(rng.randrange(5 * 86_400))
        rows.append((feed, pos, ts))
    return rows, spark.createDataFrame(rows, "feed_url string, pos bigint, ts timestamp").repartition(6)


def newest_first(rows):
    return sorted(rows, key=lambda r: (r[2] is None, -(r[2] or T0).timestamp(), r[1]))


def by_feed(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    return groups


@pytest.mark.parametrize("n", [0, 3, 1500])
def test_newest_n(skewed, n):
    rows, df = skewed
    want = {(r[0], r[1]) for g in by_feed(rows).values() for r in newest_first(g)[:n]}
    kept = items.newest_n(df, n)
    assert {(r.feed_url, r.pos) for r in kept.collect()} == want
    assert items.newest_n(df, None) is df


def test_newest_n_prunes_before_the_shuffle(skewed):
    plan = items.newest_n(skewed[1], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")
    # Beyond the pruning limit no single task ranks a whole group first.
    big = items.newest_n(skewed[1], 1500)._jdf.queryExecution().executedPlan().toString()
    assert "_slice" in big


def test_item_positions(skewed):
    rows, df = skewed
    want = {(r[0], r[1]): i + 1 for g in by_feed(rows).values() for i, r in enumerate(newest_first(g))}
    got = items.item_positions(df, chunk_rows=100).collect()
    assert {(r.feed_url, r.pos): r.item_pos for r in got} == want


def test_top_per_group_rank(skewed):
    rows, df = skewed
    got = top_per_group(df, ["feed_url"], [F.col("pos")], 2, rank="k").collect()
    assert all(r.k in (1, 2) for r in got) and len(got) == 2 * len(by_feed(rows))


def test_since_keeps_undated(skewed):
    rows, df = skewed
    bound = at(2 * 86_400)
    want = {r[1] for r in rows if r[2] is None or r[2] >= bound}
    assert {r.pos for r in items.since_filter(df, bound).collect()} == want


ITEM = "feed_url string, pos bigint, ts timestamp, id string, guid string, url string, content_hash string"


def test_find_items_first_match_wins(spark):
    rows = [
        ("f", 1, at(1), "i1", "g", "u1", "h"),
        ("f", 2, at(9), "i2", "g", "u2", "h"),
        ("f", 3, None, "i3", None, "i1", "h"),
        ("other", 1, at(99), "i1", "g", "u1", "h"),
    ]
    keys = [("f", "g"), ("f", "i1"), ("f", "u2"), ("f", "none"), ("f", "g")]
    df = spark.createDataFrame(rows, ITEM)
    found = items.find_items(df, spark.createDataFrame(keys, "feed_url string, key string")).collect()
    assert {r.key: r.pos for r in found} == {"g": 2, "i1": 1, "u2": 2, "none": None}
    missing = next(r for r in found if r.key == "none")
    assert missing.error.code == "NOT_FOUND" and missing.error.message == "item 'none' not found in f"
    plan = items.find_items(df, spark.createDataFrame(keys, "feed_url string, key string"))
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_diff_and_unseen_with_repeated_ids(spark):
    old = [("f", p, None, "dup", None, None, "a") for p in range(50)] + [("f", 99, None, "gone", None, None, None)]
    new = [("f", p, None, "dup", None, None, "a" if p == 0 else "z") for p in range(50)]
    new += [("f", 60, None, "new", None, None, "n")]
    a, b = spark.createDataFrame(old, ITEM), spark.createDataFrame(new, ITEM)
    got = {r.id: r.change for r in items.diff_snapshots(a, b).collect()}
    assert got == {"dup": "unchanged", "gone": "removed", "new": "added"}
    assert {r.id for r in items.unseen_items(b, a).collect()} == {"new"}


def test_diff_is_null_safe(spark):
    rows = [("f", 1, None, "x", None, None, None)]
    df = spark.createDataFrame(rows, ITEM)
    full = df.withColumn("content_hash", F.lit("h"))
    assert [r.change for r in items.diff_snapshots(df, df).collect()] == ["unchanged"]
    assert [r.change for r in items.diff_snapshots(df, full).collect()] == ["changed"]


def test_cross_feed(spark):
    rows = [("a", 1, None, "1", "g", None, "h"), ("a", 2, None, "0", "g", None, "h"), ("b", 1, None, "2", "g", None, "h"),
            ("b", 2, None, "3", "solo", None, "h"), ("b", 3, None, "4", None, None, "h"), ("a", 3, None, "5", None, None, "h")]
    got = items.cross_feed_matches(spark.createDataFrame(rows, ITEM)).collect()
    assert sorted((r.guid, r.n_feeds, r.feed_url, r.id) for r in got) == [("g", 2, "a", "0"), ("g", 2, "b", "2")]


# --- hosts ---------------------------------------------------------------------------------------


def simulate(log):
    """Host state by walking each host's log in order."""
    out, streaks = {}, {}
    for host, ts, code, retry, n in sorted(log, key=lambda r: (r[1], r[4])):
        s = out.setdefault(host, {"streak": 0, "next": None, "warm": None})
        if code in (403, 429):
            s["streak"] += 1
            wait = float(retry) if retry is not None else min(2 * 2 ** min(s["streak"] - 1, 30), 60)
            s["next"] = max(s["next"] or T0, ts + timedelta(seconds=min(wait, 60)))
            s["warm"] = max(s["warm"] or T0, ts + timedelta(seconds=120))
        else:
            s["streak"] = 0
        streaks[(host, n)] = s["streak"]
    return out, streaks


LOG = "authority string, ts timestamp, http_status int, retry_after string, n bigint"


@pytest.fixture(scope="module")
def fetch_log():
    rng = random.Random(9)
    log, t = [], 0
    for n in range(1500):
        t += rng.randrange(1, 400)
        host = "hot:443" if rng.random() < 0.7 else f"h{rng.randrange(5)}:443"
        code = rng.choice([429, 403, 429, 200] if (t // 40_000) % 2 else [200, 500, 429, 304])
        retry = rng.choice([None, None, "5", "900"]) if code in (403, 429) else None
        log.append((host, at(t), code, retry, n))
    return log


def test_streaks_and_cooldowns(spark, fetch_log):
    state, streaks = simulate(fetch_log)
    df = spark.createDataFrame(fetch_log, LOG)
    got = hosts.throttle_streaks(df, ("ts", "n"), chunk_rows=50).collect()
    assert {(r.authority, r.n): r.streak for r in got} == streaks
    assert max(streaks.values()) > 10  # streaks do run across chunks
    cooled = {r.authority: r for r in hosts.host_cooldowns(df, ("ts", "n"), chunk_rows=50).collect()}
    for host, want in state.items():
        r = cooled[host]
        assert (r.streak, r.next_allowed, r.warm_until) == (want["streak"], want["next"], want["warm"]), host


@pytest.mark.parametrize("spread_over", [1, 60, 40 * 86_400])
def test_chunks_of_one_host_hold_about_equal_row_counts(spark, spread_over):
    """All rows in one second, in one minute, or most of them in the last of forty days."""
    rng = random.Random(3)
    rows = [("one:443", at(int(spread_over * rng.random() ** 0.02)), rng.choice([429, 200]), None, n) for n in range(8000)]
    rows += [(f"h{n % 50}:443", at(n), 429, None, n) for n in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, LOG).repartition(5)
    chunked, is_cut = with_chunks(df, ["authority"], [F.unix_micros("ts"), F.col("n")], 400)
    sizes = sorted(r["count"] for r in chunked.where("authority = 'one:443'").groupBy("_chunk").count().collect())
    assert is_cut and 14 <= len(sizes) <= 30 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    small = chunked.where("authority <> 'one:443'").select("_chunk").distinct().collect()
    assert [r._chunk for r in small] == [0]
    last, first = F.max(F.struct("ts", "n")).alias("last"), F.min(F.struct("ts", "n")).alias("first")
    ends = chunked.where("authority = 'one:443'").groupBy("_chunk").agg(first, last).orderBy("_chunk").collect()
    assert all(a["last"] < b["first"] for a, b in zip(ends, ends[1:]))
    got = hosts.throttle_streaks(df, ("ts", "n"), chunk_rows=400).collect()
    _, streaks = simulate(sorted(rows, key=lambda r: (r[1], r[4])))
    assert {(r.authority, r.n): r.streak for r in got} == streaks


def test_small_groups_take_one_shuffle_and_null_keys_stay(spark):
    rows = [(None if n % 3 == 0 else f"h{n % 2}", at(n), 429, None, n) for n in range(60)]
    df = spark.createDataFrame(rows, LOG)
    got = hosts.throttle_streaks(df, ("ts", "n"))
    assert got.count() == 60 and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    cut = hosts.throttle_streaks(df, ("ts", "n"), chunk_rows=8)
    assert sorted((r.n, r.streak) for r in cut.collect()) == sorted((r.n, r.streak) for r in got.collect())


def test_cooldowns_resume_from_state(spark, fetch_log):
    df = spark.createDataFrame(fetch_log, LOG)
    whole = sorted(hosts.host_cooldowns(df, ("ts", "n")).collect())
    state = hosts.host_cooldowns(df.where(F.col("n") < 700), ("ts", "n"))
    resumed = sorted(hosts.host_cooldowns(df.where(F.col("n") >= 700), ("ts", "n"), state=state).collect())
    assert resumed == whole


def test_default_cooldowns_double_up_to_the_maximum(evaluate):
    rows = [(n,) for n in range(1, 8)] + [(40,)]
    waits = evaluate(rows, "n bigint", hosts.cooldown_seconds(F.col("n"), F.lit(None).cast("double")))
    assert waits == [2, 4, 8, 16, 32, 60, 60, 60]


def test_polite_schedule(spark):
    state = spark.createDataFrame(
        [("warm:443", 1, at(10), at(13), T0, 0), ("far:443", 1, at(61), at(200), T0, 0), ("long:443", 1, at(0), at(120), T0, 0)],
        hosts.HOST_STATE,
    )
    pending = [(i, f"https://{h}/{i}") for i, h in enumerate(["warm", "cold", "warm", "far", "warm", "cold", "warm", "warm", "warm", "long", "long"])]
    plan = hosts.polite_schedule(spark.createDataFrame(pending, "request_pos bigint, feed_url string"), state, T0, chunk_rows=2)
    rows = {r.request_pos: r for r in plan.collect()}
    # Waits 10 s, then a second apart until the host is cold at 13 s.
    assert [rows[i].wait_ms for i in (0, 2, 4, 6, 7, 8)] == [10000, 11000, 12000, 13000, 13000, 13000]
    assert rows[1].wait_ms == rows[5].wait_ms == 0
    assert rows[9].wait_ms == 0 and rows[10].wait_ms == 1000
    assert rows[3].wait_ms is None and rows[3].error.code == "RATE_LIMITED"
    assert rows[3].error.details == '{"retry_after_seconds":61,"retry_after_ms":61000}'
    assert rows[3].error.message == "rate limited: https://far/3 (retry after ~61s)"


# --- snapshots -----------------------------------------------------------------------------------


def response(feed, code, body, t, etag=None):
    return (feed, code, body, etag, None, "text/xml", "30" if code == 429 else None, at(t))


@pytest.fixture(scope="module")
def stored(spark):
    return snapshots.upsert_snapshots(
        None,
        spark.createDataFrame([response("a", 200, "A1", 0, "ea"), response("b", 200, "B1", 50, "eb")], tables.RESPONSES),
    )


@pytest.mark.parametrize(
    ("policy", "want"),
    [
        ("revalidate", {"a": ("A1", "not_modified"), "b": ("B2", "ok"), "c": (None, "NETWORK_ERROR"), "d": (None, "FEED_FETCH_FAILED"), "e": (None, "NETWORK_ERROR")}),
        ("no_cache", {"a": (None, "FEED_FETCH_FAILED"), "b": ("B2", "ok"), "c": (None, "FEED_FETCH_FAILED"), "d": (None, "FEED_FETCH_FAILED"), "e": (None, "NETWORK_ERROR")}),
        ("cache_first", {"a": ("A1", "not_modified"), "b": ("B1", "not_modified"), "c": (None, "NETWORK_ERROR"), "d": (None, "FEED_FETCH_FAILED"), "e": (None, "NETWORK_ERROR")}),
        ("max_age", {"a": ("A1", "not_modified"), "b": ("B1", "not_modified"), "c": (None, "NETWORK_ERROR"), "d": (None, "FEED_FETCH_FAILED"), "e": (None, "NETWORK_ERROR")}),
    ],
)
def test_resolve_fetch(spark, stored, policy, want):
    answers = [response("a", 304, None, 100), response("b", 200, "B2", 100), response("c", 304, None, 100), response("d", 429, None, 100)]
    requests = spark.createDataFrame([(i, f) for i, f in enumerate("abcde")], "request_pos bigint, feed_url string")
    out = snapshots.resolve_fetch(
        requests, spark.createDataFrame(answers, tables.RESPONSES), stored, policy, timedelta(seconds=60), at(100)
    )
    got = {r.feed_url: (r.body, r.status if r.fetch_error is None else r.fetch_error.code) for r in out.collect()}
    assert got == want
    assert all(r.from_cache == (r.status == "not_modified") for r in out.collect())
    d = next(r for r in out.collect() if r.feed_url == "d")
    assert d.fetch_error.details == '{"http_status":429,"retry_after":"30"}' and d.fetch_error.message == "HTTP status 429: d"


def test_freshness_is_strict(spark, stored):
    fresh = {r.feed_url for r in snapshots.fresh(stored, timedelta(seconds=50), at(100)).collect()}
    assert fresh == set()
    assert {r.feed_url for r in snapshots.fresh(stored, timedelta(seconds=51), at(100)).collect()} == {"b"}


def test_upsert(spark, stored):
    batch = [
        response("a", 304, None, 70), response("a", 500, "x", 90),
        response("b", 200, "B2", 60, "e2"), response("b", 304, None, 65), response("b", 200, "old", 10),
        response("n", 304, None, 1), response("m", 304, None, 1), response("m", 200, "M", 5), response("m", 403, None, 9),
    ]
    merged = {r.feed_url: (r.body, r.etag, r.fetched_at) for r in snapshots.upsert_snapshots(stored, spark.createDataFrame(batch, tables.RESPONSES)).collect()}
    assert merged == {"a": ("A1", "ea", at(70)), "b": ("B2", "e2", at(65)), "m": ("M", None, at(5))}


def test_list_snapshots(spark):
    rows = [("a", "e", None, at(0), None, "né"), ("b", None, None, at(1), None, None), ("c", None, None, None, None, "x")]
    got = {r.feed_url: r.size_bytes for r in snapshots.list_snapshots(spark.createDataFrame(rows, tables.SNAPSHOTS)).collect()}
    assert got == {"a": 3, "b": 0}


# --- discovery and seeds -------------------------------------------------------------------------


PAGE = """<html><head><!-- <link rel="alternate" type="application/rss+xml" href="/no"> -->
<link rel="alternate" type="application/rss+xml" title="All &amp; more" href="/rss">
<LINK REL='x ALTERNATE' TYPE='application/atom+xml' HREF='atom.xml'/>
<link rel=alternate type="application/feed+json; charset=utf-8" href=//json.example/f>
<link rel="alternate" type="application/rss+xml" href="https://site.example/rss">
<link rel="stylesheet" type="application/rss+xml" href="/css"><link rel="alternate" type="text/html" href="/x.rss">
<link rel="alternate" href="/bare.ATOM#x"><link rel="alternate" type="application/rss+xml" href=" ">
<link rel="alternate" type="application/rss+xml" href="http://bad host/">
<link title="rel='no' href='no'" data-href="/d" rel="alternate" type="application/rss+xml" href="/last"></head></html>"""


def test_discover(spark):
    pages = spark.createDataFrame([("https://site.example/blog/", PAGE), ("https://none.example/", "<p>x</p>")], "url string, html string")
    got = [(r.pos, r.url, r.feed_type, r.title) for r in discovery.discover_feeds(pages).orderBy("pos").collect()]
    assert got == [
        (0, "https://site.example/rss", "rss", "All & more"),
        (1, "https://site.example/blog/atom.xml", "atom", None),
        (2, "https://json.example/f", "json", None),
        (3, "https://site.example/bare.ATOM#x", "unknown", None),
        (4, "https://site.example/last", "rss", "rel='no' href='no'"),
    ]


def test_url_lists_and_opml(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# feeds\n\n https://a.example/ \r\nhttps://b.example/\n", encoding="utf8")
    (tmp_path / "subs.opml").write_text(
        '<opml><body><outline text="x"><outline text="a > b" xmlUrl="https://c.example/?x=1&amp;y=2"/>'
        "<!-- <outline xmlUrl='https://no.example/'/> --></outline><outline xmlUrl='https://a.example/'/><outline text=\"n\"/></body></opml>",
        encoding="utf8",
    )
    listed = tables.read_url_list(spark, str(tmp_path / "list.txt"))
    assert [(r.pos, r.url) for r in listed.orderBy("pos").collect()] == [(2, "https://a.example/"), (3, "https://b.example/")]
    opml = tables.read_opml(spark, str(tmp_path / "subs.opml"))
    assert [r.url for r in opml.orderBy("pos").collect()] == ["https://c.example/?x=1&y=2", "https://a.example/"]
    direct = spark.createDataFrame([(0, "https://b.example/"), (1, "#x")], "pos bigint, url string")
    merged = seeds.merge_sources(direct, listed, opml)
    order = [r.url for r in merged.orderBy("source_rank", "pos").collect()]
    assert order == ["https://b.example/", "https://a.example/", "https://c.example/?x=1&y=2"]
    requests = seeds.as_requests(merged).orderBy("request_pos").collect()
    assert [r.feed_url for r in requests] == order
    with pytest.raises(UsageError):
        seeds.require_any(merged.limit(0))


def test_body_files_decode_leniently(spark, tmp_path):
    (tmp_path / "f.xml").write_bytes(b"\xef\xbb\xbf<rss>caf\xc3\xa9 \xff</rss>")
    (row,) = tables.read_body_files(spark, str(tmp_path / "f.xml")).collect()
    assert row.body == "<rss>café �</rss>"
