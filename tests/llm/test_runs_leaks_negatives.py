"""Periodic runs, decontamination and hard negatives against plain versions, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import decontamination, negatives, runs
from newsloom.llm.common import ship_package

DOCS = "doc_id bigint, text string, runs string, same string, n_words int, words string, best int"


@pytest.fixture(scope="module", autouse=True)
def _shipped(spark):
    ship_package(spark)


def documents(spark, texts, ids=None):
    """A documents table with extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "r", "s", 1, "w", 2) for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)


# --- periodic runs


def plain_runs(words, least=12):
    """Every period from one up, every stretch of words that equal those a period on; of equal stretches the smallest period."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_row(doc_id, text, edit=True):
    """The contract of the registered query, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = (zlib.crc32(str(doc_id).encode()), len(words)) if doc_id is not None else (1, len(words))
    if edit and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def periodic_words(rng, n):
    words = [f"w{rng.randrange(rng.choice([1, 2, 4, 300]))}" for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            b = min(n, a + p * rng.randrange(1, 6))
            words[a:b] = [words[a + (i - a) % p] for i in range(a, b)]
    return words


def test_runs_of_random_words_equal_the_plain_version():
    rng = random.Random(1)
    for _ in range(150):
        texts = [periodic_words(rng, rng.randrange(120)) for _ in range(rng.randrange(1, 6))]
        known: dict[str, int] = {}
        codes = [np.array([known.setdefault(w, len(known)) for w in t], np.int64) for t in texts]
        least = rng.choice([2, 12])
        got = runs.runs_of_many(codes, least).tolist()
        assert got == [[k, *r] for k, t in enumerate(texts) for r in sorted(plain_runs(t, least), key=lambda r: (r[0], r[2]))]


def test_common_extensions_equal_comparing_word_by_word():
    rng = random.Random(2)
    for _ in range(40):
        codes = np.array([rng.randrange(1, 3) for _ in range(rng.randrange(2, 200))] + [3], np.int64)
        right = runs.CommonExtension(codes)
        i, j = np.array([(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes))]).T
        want = [next(k for k in range(len(codes)) if codes[a + k] != codes[b + k]) for a, b in zip(i, j, strict=True)]
        assert right(i, j).tolist() == want and right(j, i).tolist() == want


def test_cover_reaches_samples_from_every_pair_of_places():
    assert runs._SHIFT.max() < runs.V
    assert {(a - b) % runs.V for a in runs.COVER for b in runs.COVER} == set(range(runs.V))


def test_run_query_equals_the_plain_version(spark):
    rng = random.Random(3)
    texts = [" ".join(periodic_words(rng, rng.randrange(150))) for _ in range(60)]
    texts += [None, "", " \t\n", "one", "a " * 12, "a " * 11, "x y " * 20, "  é " * 30, "ab\x0bcd\x0c" * 20, texts[0], texts[0]]
    got = sorted(tuple(r) for r in runs.run_digests(documents(spark, texts)).collect())
    assert got == sorted(plain_row(k, t) for k, t in enumerate(texts))
    assert sum(r[1] for r in got) > 20


def test_runs_on_odd_tables(spark, monkeypatch):
    text = "a b c " * 8
    odd = documents(spark, [text, text, None, text], [None, 7, None, 7])
    got = sorted((tuple(r) for r in runs.run_digests(odd).collect()), key=repr)
    assert got == sorted([plain_row(None, text), plain_row(7, text), plain_row(None, None), plain_row(7, text)], key=repr)
    empty = runs.run_digests(odd.where("false"))
    assert empty.collect() == [] and empty.columns[:2] == ["doc_id", "n_runs"]
    monkeypatch.setattr(runs, "BLOCK_PAIRS", 7)  # blocks smaller than one period's pairs
    words = periodic_words(random.Random(4), 400) + ["p", "q"] * 90
    codes = {w: k for k, w in enumerate(dict.fromkeys(words))}
    assert [tuple(r[1:]) for r in runs.runs_of_many([np.array([codes[w] for w in words])]).tolist()] == sorted(
        plain_runs(words), key=lambda r: (r[0], r[2])
    )


def test_a_very_long_text_of_runs(spark):
    rng = random.Random(5)
    unit = [f"w{rng.randrange(5000)}" for _ in range(7_000)]
    words = [f"v{k}" for k in range(50_000)] + unit * 20 + ["z"] * 60_000
    row = runs.find_runs(documents(spark, [" ".join(words)])).first()
    found = {(r.start, r.length, r.period) for r in row.runs}
    assert row.n_words == 250_000 and {(50_000, 140_000, 7_000), (190_000, 60_000, 1)} <= found
    assert row.collapsed.split() == words[:57_000] + ["z"]


# --- decontamination


def plain_leaks(texts, items, size=10):
    """(words, hit word numbers, items) of every text, window by window."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows = []
    for item, text in items:
        own = word.findall((text or "").translate(lower))
        n = min(size, len(own))
        windows += [(item, own[k : k + n]) for k in range(len(own) - n + 1) if n]
    out = []
    for text in texts:
        own = word.findall((text or "").translate(lower))
        hit, names = set(), set()
        for item, window in windows:
            for k in range(len(own) - len(window) + 1):
                if own[k : k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    names |= set() if item is None else {str(item)}
        out.append((len(own), hit, names))
    return out


def leaking(rng):
    """Texts that hold whole, cut and changed passages of items, in other case and punctuation."""
    vocabulary = [f"w{k}" for k in range(25)] + ["Ünï", "漢字", "x²", "9"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.choice([0, 1, 3, 9, 10, 11, 40]))) for k in range(12)] + [(3, say(15)), (20, None), (None, say(12)), (21, say(8) + " " + "L" * 300)]
    texts = [None, "", "..!"]
    for _ in range(50):
        parts = [say(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            words = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(words) + 1)
            passage = rng.choice([" ", ", ", "-\n", "…"]).join(words[a - a // 2 :]) if rng.random() < 0.9 else ""
            parts += [rng.choice([str.upper, str.title, str])(passage) if passage.isascii() else passage, say(rng.randrange(5))]
        texts.append("? ".join(parts))
    return texts, items


@pytest.mark.parametrize("shard_bytes", [1 << 21, 150])
def test_leaks_equal_the_plain_version(spark, shard_bytes):
    texts, items = leaking(random.Random(6))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.find_contamination(documents(spark, texts), bench, shard_bytes=shard_bytes)
    got = {r.doc_id: r for r in found.collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # with A-Z, as in the original
    for k, (n, hit, names) in enumerate(plain_leaks(texts, items)):
        row = got[k]
        assert row.n_words == n and row["items"] == sorted(names)
        assert {i for w in row.words for i in range(w.start, w.end)} == hit
        assert all(a.end < b.start for a, b in zip(row.words, row.words[1:]))
        places = [m.span() for m in word.finditer(texts[k] or "")]
        assert [(s.start, s.end) for s in row.spans] == [(places[w.start][0], places[w.end - 1][1]) for w in row.words]
    assert sum(bool(r.words) for r in got.values()) > 20


def test_several_automata_share_pieces_of_long_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 20)
    rng = random.Random(7)
    words = [f"u{rng.randrange(900)}" for _ in range(300)]
    bench = spark.createDataFrame([("long", " ".join(words)), ("other", "nothing of this")], "item_id string, text string")
    texts = [" ".join(words[a : a + 37]) for a in range(0, 260, 13)] * 2
    rows = decontamination.find_contamination(documents(spark, texts, [k // 2 for k in range(len(texts))]), bench, shard_bytes=400).collect()
    assert len(rows) == len(texts)
    assert all([(w.start, w.end) for w in r.words] == [(0, r.n_words)] and r["items"] == ["long"] for r in rows)


def test_leak_digests_and_odd_tables(spark):
    passage = "what is the boiling point of water at sea level in celsius"
    bench = spark.createDataFrame([(2, passage), (10, passage), (7, "a b")], "item_id bigint, text string").withColumn("words", F.lit("x"))
    docs = documents(spark, [passage.upper(), "A, b!", None, "clean", passage.upper()], [1, 2, None, 4, 1])
    got = sorted((tuple(r) for r in decontamination.contamination_digests(docs, bench).collect()), key=repr)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    both = (1, 12, 12, 2, digest("10,2"), True)
    assert got == sorted([both, both, (2, 2, 2, 1, digest("7"), True), (None, 0, 0, 0, digest(""), False), (4, 1, 0, 0, digest(""), False)], key=repr)
    none = decontamination.contamination_digests(docs, bench.where("false")).collect()
    assert len(none) == 5 and not any(r.contaminated for r in none)
    assert decontamination.contamination_digests(docs.where("false"), bench).collect() == []


def test_a_very_long_text_of_leaks(spark):
    item = " ".join(f"k{i}" for i in range(30))
    text = ("filler " * 50 + item + " ") * 3000
    row = decontamination.find_contamination(documents(spark, [text]), spark.createDataFrame([(1, item)], "item_id int, text string")).first()
    assert row.n_words == 240_000 and len(row.words) == 3000 and text[row.spans[2999].start : row.spans[2999].end] == item


# --- hard negatives


def plain_negatives(rows, positives=5, count=3, every=50):
    """rows: (vec_id, label, whole-number vector) of different ids."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  a shorter vector ends in zeros
    out = []
    for anchor, label, vector in rows:
        if anchor % every:
            continue
        scored = sorted(((dot(vector, v), i, lab) for i, lab, v in rows if i != anchor), key=lambda s: (-s[0], s[1]))
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            own = [s for s in scored if s[2] != label and 50 * score <= 100 * s[0] <= 95 * score][:count]
            out += [(anchor, positive, k + 1, i, score, s) for k, (s, i, _) in enumerate(own)]
    return sorted(out)


def embeddings(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, label int, embedding array<float>, vector string, rank int").repartition(3)


def mined(frame, every):
    return sorted(tuple(r) for r in negatives.hard_negatives(negatives.whole_vectors(frame), F.col("vec_id") % every == 0).collect())


@pytest.mark.parametrize(("values", "dims"), [([0.0, 0.25, 0.5, -0.5], 3), (None, 16)])
def test_negatives_equal_the_plain_version(spark, monkeypatch, values, dims):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), [rng.choice(values) if values else rng.gauss(0, 0.3) for _ in range(dims)]) for i in range(260)]
    whole = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows]
    want = plain_negatives(whole, every=5)
    assert len(want) > 200 and mined(embeddings(spark, rows), 5) == want
    monkeypatch.setattr(negatives, "LEAST_ROWS", 30)  # several blocks of both sides
    monkeypatch.setattr(negatives, "ANCHORS", 20)
    assert mined(embeddings(spark, rows), 5) == want


def test_sorted_access_stops_early_and_strictly():
    vectors = np.stack([np.arange(1000.0), np.zeros(1000)], 1)
    lists = negatives.SortedLists(vectors)
    anchor = np.array([1.0, 0.0])
    read = list(zip(range(3), lists.read(anchor)))
    assert [len(met) for _, (met, _) in read] == [16, 32, 64] and [t for _, (_, t) in read] == [984, 952, 888]
    ids, scores = negatives.best(lists, np.arange(1000), anchor, np.ones(1000, bool), 5)
    assert ids.tolist() == [999, 998, 997, 996, 995] and scores[0] == 999
    even = negatives.SortedLists(np.ones((200, 2)))  # all tie: every row must be met
    assert negatives.best(even, np.arange(200)[::-1], np.ones(2), np.ones(200, bool), 3)[0].tolist() == [0, 1, 2]
    found = negatives.best_in_windows(lists, np.arange(1000), anchor, np.ones(1000, bool), [(400, 500), (5, 4), (2000, 3000)], 2)
    assert [f[0].tolist() for f in found] == [[500, 499], [], []]


def test_windows_of_scores():
    for score in range(-50, 200):
        low, high = negatives.window_of(score)
        assert [s for s in range(-300, 300) if 50 * score <= 100 * s <= 95 * score] == list(range(low, high + 1))


def test_negatives_on_odd_tables(spark):
    rng = random.Random(9)
    vector = lambda n=4: [rng.random() for _ in range(n)]
    rows = [(i, i % 3, vector(2 if i % 4 == 0 else 4)) for i in range(0, 60)]
    whole = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows]
    bad = [(100, None, vector()), (150, 1, None), (None, 1, vector()), (200, 1, [0.1, None]), (250, 2, [float("nan")]), (300, 0, [float("inf")])]
    want = plain_negatives(whole, every=10)
    assert mined(embeddings(spark, rows + bad + rows[:20]), 10) == want and want
    again = (20, 2, [9.0, 9.0])  # another row of an id: the smallest by label and vector counts
    assert mined(embeddings(spark, [*rows, again]), 10) == mined(embeddings(spark, [r for r in [*rows, again] if r[:2] != (20, 2) or r[2] == min(rows[20][2], again[2])]), 10)
    assert mined(embeddings(spark, [(0, 1, []), (1, 1, []), (2, 0, [])]), 10) == [(0, 1, 1, 2, 0, 0)]
    assert mined(embeddings(spark, rows).where("false"), 10) == []
    assert mined(embeddings(spark, [(1, 1, vector())]), 10) == []


def test_large_components_are_scored_exactly(spark):
    rows = [(0, 0, [1e6, 1.0]), (1, 0, [1e7, 0.0]), (2, 1, [5e6, 1.0]), (3, 1, [5e6, 2.0]), (4, 1, [9.6e6, 0.0])]
    whole = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows]
    assert mined(embeddings(spark, rows), 10) == plain_negatives(whole, every=10)
