"""Periodic runs of words in texts, and texts with the repeats taken out.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
``max(least, 2q)`` words that no neighbouring word extends keeping period q.

Method. How far two places of a text agree (their longest common extension) is answered by a difference cover: of every
``V`` places those whose number modulo ``V`` is in ``COVER`` are samples, and only the suffixes at samples are sorted (by
their first ``V`` words, then by doubling). Any two places reach samples of the same shift in at most ``V - 1`` words, so a
question compares those few words and then takes a range minimum, by a sparse table, over the common prefixes of
neighbouring sorted samples. The same is built over the reversed text for extensions to the left. Runs are found on a
harmonic grid: a run of period p holds two neighbours of the grid 0, p, 2p, …, so for every p the pairs of neighbours are
extended both ways; over all periods these are n·ln n pairs. Of equal stretches the smallest period counts.

Every document is worked out where it is read; nothing is shuffled. A task concatenates documents up to ``BATCH_WORDS``
words (a longer document is a batch of its own), with a different stop word after each, so numpy works on long arrays
whatever the lengths of the documents are. Pairs are extended in blocks of ``BLOCK_PAIRS``.

Rules for odd input: words are stretches of bytes that are not ASCII white space; a null or empty text has no words, no runs
and an empty collapsed text; repeated rows each get their row; a null doc_id is an id like any other; an empty table gives an
empty table; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

LEAST = 12

#: Every difference modulo V is one of two members of COVER.
V, COVER = 13, (0, 1, 3, 9)

BATCH_WORDS = 1 << 17
BLOCK_PAIRS = 1 << 20

_SAMPLED = np.isin(np.arange(V), COVER)
#: Words to go from places with these remainders until both are samples.
_SHIFT = np.array([[next(d for d in range(V) if _SAMPLED[(i + d) % V] and _SAMPLED[(j + d) % V]) for j in range(V)] for i in range(V)])

Edit = Callable[[int | None, list[bytes]], list[bytes]]

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


class CommonExtension:
    """Longest common extensions to the right in an array of positive codes that ends with a code found nowhere else."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.codes = np.concatenate([codes, np.zeros(V, codes.dtype)])
        at = np.flatnonzero(_SAMPLED[np.arange(n) % V])
        slot = np.zeros(n + 1, np.int64)
        slot[at] = np.arange(len(at))
        ranks = [self._first_ranks(at)]
        step = V
        while ranks[-1].max() + 1 < len(at):  # twice as many words each time, until all suffixes differ
            nxt = np.where(at + step < n, ranks[-1][slot[np.minimum(at + step, n)]] + 1, 0)
            ranks.append(np.unique(ranks[-1] * (len(at) + 1) + nxt, return_inverse=True)[1].reshape(-1))
            step *= 2
        self.slot, self.rank = slot, ranks[-1]
        order = np.empty(len(at), np.int64)
        order[self.rank] = np.arange(len(at))
        self.table = self._minima(self._neighbours(at[order[:-1]], at[order[1:]], ranks))

    def _first_ranks(self, at: np.ndarray) -> np.ndarray:
        """Ranks of the samples by their first V words, several words packed in one key."""
        bits = int(self.codes.max()).bit_length()
        per = max(1, 63 // bits)
        keys = []
        for first in range(0, V, per):
            key = np.zeros(len(at), np.int64)
            for k in range(first, min(first + per, V)):
                key = (key << bits) | self.codes[at + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), np.int64)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def _neighbours(self, a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of pairs of samples, from the ranks of every length down to single words."""
        common = np.zeros(len(a), np.int64)
        for level in range(len(ranks) - 2, -1, -1):
            same = ranks[level][self.slot[a + common]] == ranks[level][self.slot[b + common]]
            common[same] += V << level
        going = np.arange(len(a))
        for _ in range(V - 1):
            x = common[going]
            going = going[self.codes[a[going] + x] == self.codes[b[going] + x]]
            common[going] += 1
        return common

    @staticmethod
    def _minima(common: np.ndarray) -> list[np.ndarray]:
        table = [common.astype(np.int32)]
        while 2 << (len(table) - 1) <= len(common):
            last, half = table[-1], 1 << (len(table) - 1)
            table.append(np.minimum(last[:-half], last[half:]))
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For different places i and j: how many words from there on are the same."""
        shift = _SHIFT[i % V, j % V]
        length = shift.copy()
        going, arrived = np.arange(len(i)), []
        for d in range(V):
            there = shift[going] == d
            arrived.append(going[there])
            going = going[~there]
            same = self.codes[i[going] + d] == self.codes[j[going] + d]
            length[going[~same]] = d
            going = going[same]
        met = np.concatenate(arrived)
        a = self.rank[self.slot[i[met] + shift[met]]]
        b = self.rank[self.slot[j[met] + shift[met]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        levels = np.frexp(high - low)[1] - 1
        for level in np.unique(levels):
            own = levels == level
            row = self.table[level]
            length[met[own]] += np.minimum(row[low[own]], row[high[own] - (1 << int(level))])
        return length


def _grid(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (place, period): the places 0, p, 2p, … of each document that have a neighbour p on, for all p up to half of it."""
    half = sizes // 2
    doc = np.repeat(np.arange(len(sizes)), half)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(half) - half, half) + 1
    pairs = (sizes[doc] - 1) // period
    ends = np.cumsum(pairs)
    first = 0
    while first < len(doc):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK_PAIRS, "right")))
        count = pairs[first:last]
        p = np.repeat(period[first:last], count)
        k = np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)
        yield np.repeat(starts[doc[first:last]], count) + k * p, p
        first = last


def runs_of_many(texts: list[np.ndarray], least: int = LEAST) -> np.ndarray:
    """Runs of several arrays of codes from 0: rows (which array, start, length, period), by these."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if not (sizes >= max(2, least)).any():
        return np.zeros((0, 4), np.int64)
    top = max(int(t.max()) for t in texts if len(t)) + 2
    stops = np.arange(top, top + len(texts) + 1)
    parts = [stops[:1]]
    for text, stop in zip(texts, stops[1:], strict=True):
        parts += [text + 1, [stop]]
    codes = np.concatenate(parts).astype(np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    right, left = CommonExtension(codes), CommonExtension(codes[::-1].copy())
    found = [np.zeros((0, 3), np.int64)]
    for at, p in _grid(sizes, starts):
        own = np.flatnonzero(codes[at] == codes[at + p])
        at, p = at[own], p[own]
        on = right(at, at + p)
        new = np.ones(len(at), bool)  # pairs that the one before does not reach
        new[1:] = (p[1:] != p[:-1]) | (at[1:] - at[:-1] != p[1:]) | (on[:-1] < p[1:])
        at, p, on = at[new], p[new], on[new]
        back = left(len(codes) - at, len(codes) - at - p)
        own = on + back + p >= np.maximum(least, 2 * p)
        stretch = np.stack([at - back, on + back + p, p], 1)[own]
        found.append(np.unique(stretch, axis=0) if len(stretch) else stretch)
    start, length, period = np.unique(np.concatenate(found), axis=0).T
    first = np.ones(len(start), bool)  # of one stretch, the smallest period
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    doc = np.searchsorted(starts, start, "right") - 1
    order = np.lexsort([period, start, doc])
    return np.stack([doc, start - starts[doc], length, period], 1)[order]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those that a run holds after its first ``period`` words."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return np.cumsum(edges[:-1]) == 0


def _batch(words: list[list[bytes]], least: int) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and collapsed text of each list of words."""
    known: dict[bytes, int] = {}
    codes = [np.array([known.setdefault(w, len(known)) for w in ws], np.int64) for ws in words]
    table = runs_of_many(codes, least)
    bounds = np.searchsorted(table[:, 0], np.arange(len(words) + 1))
    runs, texts = [], []
    for k, ws in enumerate(words):
        own = table[bounds[k] : bounds[k + 1], 1:]
        runs.append([{"start": s, "length": n, "period": p} for s, n, p in own.tolist()])
        texts.append(b" ".join(ws if not len(own) else [ws[i] for i in np.flatnonzero(kept_words(len(ws), *own.T))]))
    return runs, texts


def find_runs(docs: DataFrame, least: int = LEAST, edit: Edit | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, runs (start, length and period in words, by start, then period)
    and collapsed (the words without what repeats, joined by one space). ``edit`` may change a document's words first."""
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    )
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))

    def made(ids: list, words: list[list[bytes]], id_type: pa.DataType) -> pa.RecordBatch:
        runs, texts = _batch(words, least)
        columns = [
            pa.array(ids, id_type),
            pa.array([len(ws) for ws in words], pa.int64()),
            pa.array(runs, run_type),
            pa.array(texts, pa.binary()).cast(pa.string(), safe=False),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, held, id_type = [], [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                doc_id, own = doc_id.as_py(), (text.as_py() or b"").split()
                ids.append(doc_id)
                words.append(edit(doc_id, own) if edit else own)
                held += len(own)
                if held >= BATCH_WORDS:
                    yield made(ids, words, id_type)
                    ids, words, held = [], [], 0
        if ids:
            yield made(ids, words, id_type)

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents from some word on repeat a stretch of themselves; the others stay."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def run_digests(docs: DataFrame, least: int = LEAST, edit: Edit | None = planted) -> DataFrame:
    """Per document: doc_id, n_runs, its longest run (start, length, period, exponent_milli), and SHA-256 digests of all runs and
    of the collapsed text."""
    best = F.element_at(
        F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1
    )
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = find_runs(docs, least, edit).withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(-1000L * best.less) div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
