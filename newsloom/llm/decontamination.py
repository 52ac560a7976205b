"""Benchmark decontamination: test questions and answers found in documents, with their places in the original text.

Normal form: A-Z lower-cased, words are stretches of digits, ASCII letters and characters beyond ASCII. A window is ``WINDOW``
consecutive words of an item; an item of fewer words, but not none, is one window. A document word inside any occurrence of
a window is hit.

Method. All windows are the patterns of one Aho-Corasick automaton. Each different word of the benchmark is one character of
its alphabet (words that no item has are one more), so a document becomes a string with one character a word, is scanned
once, and a match ends at a word, whose place in the original text is known. Word starts are only worked out for documents
with matches.

Distribution. Documents are scanned where they are read; nothing is shuffled. What goes to every task is the text of the
benchmark, cut into pieces of ``PIECE_WORDS`` words that overlap by a window less one word. Its size is measured first: beyond ``SHARD_BYTES``
pieces are dealt to several automata, each within that bound, every document is scanned by each, and the hits of a document are put
together by (doc_id, hash of its text).

Rules for odd input: null and empty texts have no words; an item without words, or a null item, matches nothing; equal item ids are
one item; an item with a null id hits words but is not named; repeated documents each get their row; empty tables give empty tables, or
documents without hits; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from newsloom.llm.common import small_batches
from newsloom.session import scratch_path

WINDOW = 10

#: Words of a piece of an item, and the most bytes of normalised item text behind one automaton. An automaton takes some 100 times the
#: bytes of its text.
PIECE_WORDS = 2_000
SHARD_BYTES = 1 << 21

# Bytes of word characters, lower-cased; all others are blanks.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_OTHER = "\0"

#: Words of more bytes stand as a digest of 128 bits, so that a piece has a bound.
LONG_WORD = 64

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_HITS = [T.StructField("words", T.ArrayType(SPAN)), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]


def _letter(k: int) -> str:
    """The character of the k-th word: all but NUL and the surrogates."""
    return chr(k + 1 if k + 1 < 0xD800 else k + 1 + 0x800)


class Matcher:
    """The automaton over the windows of pieces: (item id or None, normalised words in bytes)."""

    def __init__(self, pieces: Iterable[tuple[str | None, bytes]], window: int = WINDOW):
        self.letters: dict[bytes, str] = {}
        windows: dict[str, set[str]] = {}
        for item, text in pieces:
            coded = "".join(self.letters.setdefault(w, _letter(len(self.letters))) for w in text.split())
            for at in range(max(1, len(coded) - window + 1) if coded else 0):
                windows.setdefault(coded[at : at + window], set()).update([] if item is None else [item])
        self.items = list(windows.values())
        self.automaton = ahocorasick.Automaton()
        for k, key in enumerate(windows):
            self.automaton.add_word(key, (len(key), k))
        self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Stretches of hit words (first, one past the last), apart and in order, and the items found, sorted."""
        if not self.items:
            return [], []
        ends: dict[int, int] = {}
        found: set[int] = set()
        for last, (size, k) in self.automaton.iter("".join(map(self.letters.get, words, repeat(_OTHER)))):
            ends[last + 1] = max(size, ends.get(last + 1, 0))
            found.add(k)
        hit: list[tuple[int, int]] = []
        for end, size in ends.items():  # in the order of ends
            start = end - size
            while hit and start <= hit[-1][1]:
                start = min(start, hit.pop()[0])
            hit.append((start, end))
        return hit, sorted(set().union(*(self.items[k] for k in found)))


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of a text in UTF-8."""
    words = text.translate(_NORMAL).split()
    if max(map(len, words), default=0) <= LONG_WORD:
        return words
    return [w if len(w) <= LONG_WORD else b"=" + hashlib.blake2b(w, digest_size=16).hexdigest().encode() for w in words]


def original_spans(text: bytes, hit: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of words as stretches of code points of the original text."""
    if not hit:
        return []
    inside = np.frombuffer(b" " + text.translate(_NORMAL) + b" ", np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # starts and ends of words, in turn
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    first, last = np.array(hit).T
    return list(zip(before[edges[2 * first]].tolist(), before[edges[2 * last - 1]].tolist(), strict=True))


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """Different normalised pieces of the items: item (string), piece (binary), size."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 100):
            items, made = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text or b"")
                for at in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WORDS):
                    items.append(item)
                    made.append(b" ".join(words[at : at + PIECE_WORDS + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(made, pa.binary())], names=["item", "piece"])

    cut_up = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(cut, "item string, piece binary").distinct()
    return cut_up.withColumn("size", F.octet_length("piece") + F.coalesce(F.octet_length("item"), F.lit(0)))


def _shards(pieces: DataFrame, shard_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The pieces in lists of at most ``shard_bytes`` (or of one piece): one list if they fit, else dealt by hash; a list that got
    too much is dealt again."""

    def parts(n: int, salt: int, within: DataFrame) -> Iterator[list[tuple[str | None, bytes]]]:
        dealt = within.withColumn("shard", F.pmod(F.xxhash64("piece", "item", F.lit(salt)), F.lit(n)))
        sizes = dealt.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        for shard, size, rows in sorted(tuple(r) for r in sizes):
            own = dealt.where(F.col("shard") == shard).drop("shard")
            if size > shard_bytes and rows > 1:
                yield from parts(2, salt + 1, own)
            else:
                yield [(r["item"], bytes(r["piece"])) for r in own.collect()]

    total = pieces.agg(F.sum("size").alias("bytes")).first()["bytes"] or 0
    if total:
        yield from parts(1 if total <= shard_bytes else -(-2 * total // shard_bytes), 0, pieces)


#: The automaton that this Python worker built last.
_BUILT: dict[str, Matcher] = {}


def _matcher(token: str, shard: Broadcast, window: int) -> Matcher:
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Matcher(shard.value, window)
    return _BUILT[token]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(lists: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in own] for own in lists], _SPANS)


def _scan(docs: DataFrame, pieces: list[tuple[str | None, bytes]], window: int) -> DataFrame:
    """Per row of ``docs``: its columns but the text, n_words, and the hit words, spans and items by one automaton."""
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != "text"), T.StructField("n_words", T.LongType()), *_HITS])
    at = docs.columns.index("text")
    token, shard = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(pieces)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            matcher = _matcher(token, shard, window)
            sizes, hits, spans, items = [], [], [], []
            for text in batch.column(at).cast(pa.binary()):
                text = text.as_py() or b""
                words = words_of(text)
                hit, found = matcher.scan(words)
                sizes.append(len(words))
                hits.append(hit)
                spans.append(original_spans(text, hit))
                items.append(found)
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            made = [pa.array(sizes, pa.int64()), _spans(hits), _spans(spans), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*rest, *made], names=schema.names)

    return docs.mapInArrow(work, schema)


def _joined(rows: DataFrame) -> DataFrame:
    """Rows whose words, spans and items are lists of those of several automata, with one list each."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            hits, spans, items = [], [], []
            for row in batch.select(["words", "spans", "items"]).to_pylist():
                parts = [(*w.values(), *s.values()) for ws, ss in zip(row["words"] or [], row["spans"] or [], strict=True) for w, s in zip(ws, ss, strict=True)]
                whole: list[tuple[int, int, int, int]] = []
                for a, b, x, y in sorted(parts):
                    if whole and a <= whole[-1][1]:
                        a, x, b, y = whole[-1][0], whole[-1][2], max(b, whole[-1][1]), max(y, whole[-1][3])
                        whole.pop()
                    whole.append((a, b, x, y))
                hits.append([h[:2] for h in whole])
                spans.append([h[2:] for h in whole])
                items.append(sorted({i for own in row["items"] or [] for i in own}))
            made = [batch.column("doc_id"), batch.column("n_words"), _spans(hits), _spans(spans), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n_words", "words", "spans", "items"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), *_HITS])
    return rows.select("doc_id", "n_words", "words", "spans", "items").mapInArrow(work, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text): doc_id, n_words, words (stretches of hit words:
    first, one past the last), spans (the same in code points of the original text) and items (ids found, sorted)."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    # The size needs one pass over the benchmark and the rows another, so its pieces are kept in the shared folder.
    kept = scratch_path(spark, "benchmark")
    _pieces(benchmark, window).write.parquet(kept)
    shards = _shards(spark.read.parquet(kept), shard_bytes)
    first, second = next(shards, []), next(shards, None)
    if second is None:
        return _scan(docs, first, window)
    same = F.sha2(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"), 256)
    keyed, folder = docs.withColumn("same", same), scratch_path(spark, "hits")
    for k, pieces in enumerate(chain([first, second], shards)):
        hits = _scan(keyed, pieces, window).where(F.size("words") > 0)
        hits.dropDuplicates(["same"]).drop("doc_id", "n_words").write.parquet(f"{folder}/{k}")
    found = spark.read.parquet(f"{folder}/*").groupBy("same").agg(*(F.collect_list(c).alias(c) for c in ("words", "spans", "items")))
    sizes = _scan(keyed, [], window).select("doc_id", "same", "n_words")
    return _joined(sizes.join(found, "same", "left"))


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, the digest of the items' ids, and whether any word is hit."""
    hit = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + w["end"] - w["start"])
    return find_contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("words") > 0).alias("contaminated"),
    )
