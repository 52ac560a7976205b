"""Toxicity scores on text restored from disguises by a noisy-channel decoder.

1. Character language model: trigram counts over all texts of the corpus (letters of a fixed alphabet, everything
   else is a word end), gathered with one vector of counts per partition and added; the model has at most 59³ counts.
2. Restoring: a token that mixes letters with digits or signs, repeats a letter three times or more, or is a run of spaced letters
   (``s t u p i d``), becomes a lattice: each sign stands for the letters it imitates, each run of one letter for one or two of
   them, each separator inside for nothing, and in spaced letters a word may end anywhere. Signs at the ends may also be plain
   marks; three of a kind always are. Viterbi finds the most likely reading under the model and the cost of
   each imitation. Plain tokens stay as they are, and no token is too long.
3. Scoring: the words of the restored text and their beginnings of 4 to 7 letters are the features; logistic regression over the features that separate
   toxic from clean texts beyond chance (log-likelihood ratio) gives the score.

Only the text enters a score. The classifier is fitted on at most ``SAMPLE`` labelled rows (those with the smallest
hash of the id, so the choice does not depend on order or partitions), and never on rows whose crc32(doc_id) mod 5 is 0.

Rules for odd input: null text counts as empty, and empty texts get the score of a text without features; null ids are not
held out and cannot be labelled; labels that are null are left out, and the largest label of an id counts; without
any labels of both kinds every score is the share of toxic labels (0 if there are none); repeated rows get equal scores; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from newsloom.llm.common import small_batches

#: The model's letters: a-z and the lower-case letters of Latin-1. Code 0 is a word end.
LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
K = len(LETTERS) + 1
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}

#: Letters that a sign imitates, fixed values.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "%": "o", "&": "a",
}
SEPARATORS = frozenset(".-_*~'’`,;:/\\=^")
LOOK_COST, DROP_COST, MARK_COST, SPLIT_COST = 1.0, 0.3, 14.0, 1.0
READINGS, MARGIN = 12, 6.0  # of spaced letters
#: Cost of a sign at the start or end of a token that stands for nothing: low where writers put it as a plain mark.
LEAD_DROPS = {"@": 1.0, "#": 1.0, "(": 0.3, "<": 0.3, "¡": 0.0, "€": 1.0, "£": 1.0, "%": 3.0, "&": 3.0, "$": MARK_COST, "!": MARK_COST, "|": 3.0, "+": 3.0}
TAIL_DROPS = {"!": 0.3, "%": 1.0, "€": 1.0, "£": 1.0, "<": 1.0, "(": 1.0, "&": 3.0, "|": 3.0, "#": MARK_COST, "$": MARK_COST, "@": MARK_COST, "+": MARK_COST}

SAMPLE = 12_000
MIN_TOXIC, MIN_RATIO, MAX_FEATURES = 4, 30.0, 2000

_SPACED = re.compile(r"(?<!\S)(?:[^\W_] ){2,}[^\W_](?!\w)")
_TRIPLE = re.compile(r"(.)\1\1+")
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "¡¿«»“”„’‘…–—·"
# Marks around a token: signs that imitate nothing, any sign three times or more, and repeated exclamation marks.
_MARKS = "".join(map(re.escape, (c for c in _EDGES if c not in LOOKS)))
_LEAD = re.compile(rf"^(?:([^\w\s])\1\1+|[{_MARKS}])+")
_TAIL = re.compile(rf"(?:([^\w\s])\1\1+|!!|[{_MARKS}])+$")


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams (word ends included) over all texts, as a K x K x K array."""

    def run(batches):
        table = np.zeros(0x100, np.int64)
        for letter, code in CODE.items():
            table[ord(letter)] = code
        total = np.zeros(K**3, np.int64)
        for batch in small_batches(batches, 500):
            text = "\n\n".join(t for t in batch.column(0).to_pylist() if t)
            points = np.frombuffer(f"\n\n{text}\n\n".lower().encode("utf-32-le", "replace"), np.uint32)
            codes = np.where(points < 0x100, table[np.minimum(points, 0xFF)], 0)
            total += np.bincount((codes[:-2] * K + codes[1:-1]) * K + codes[2:], minlength=K**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["gram", "n"])

    sums = docs.select("text").mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(K**3)
    for gram, n in sums.collect():  # at most K**3 rows, whatever the corpus
        counts[gram] = n
    return counts.reshape(K, K, K)


def letter_costs(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """-log P(c | a, b), interpolated with shorter contexts."""
    one = counts.sum((0, 1)) + 0.5
    one /= one.sum()
    two = counts.sum(0)
    two = (two + weight * one) / (two.sum(1, keepdims=True) + weight)
    three = (counts + weight * two[None]) / (counts.sum(2, keepdims=True) + weight)
    return -np.log(three)


class Decoder:
    """Restores disguised words; plain words pass unchanged."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.known: dict[str, tuple[str, ...]] = {}

    def words(self, token: str, joined: bool = False) -> tuple[str, ...]:
        """The restored form of a lower-case token without white space, () if nothing of it is a word. ``joined`` tokens
        may hold several words."""
        body = _TAIL.sub("", _LEAD.sub("", token))
        if body.isalpha() and not joined and not _TRIPLE.search(body):
            return (body,)
        body = _TRIPLE.sub(r"\1\1\1", body)
        key = f" {body}" if joined else body
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self._restored(body, joined)
            if len(body) <= 64:  # longer tokens seldom come twice
                self.known[key] = got
        return got

    def _restored(self, body: str, joined: bool) -> tuple[str, ...]:
        plain = body.strip(_EDGES)
        readings = self.decode(body, joined) if any(c.isalpha() for c in body) else []
        return tuple(dict.fromkeys(word for reading in readings or [plain] for word in reading.split()))

    def decode(self, token: str, joined: bool = False) -> list[str]:
        """The most likely reading; if the token is ``joined``, all readings about as likely (``MARGIN``), with blanks between
        words, as three letters of context seldom settle where a word ends. Empty if a sign has no reading."""
        keep = READINGS if joined else 1
        # State: the last two letters, a word end being 0. Value: the best costs, with the pieces so far, last first.
        beams: dict[tuple[int, int], list[tuple[float, tuple | None]]] = {(0, 0): [(0.0, None)]}
        i, n = 0, len(token)
        while i < n:
            c, j = token[i], i + 1
            while j < n and token[j] == c:
                j += 1
            options: list[tuple[str, float]]
            if c in CODE:
                options = [(c, 0.0 if j - i == 1 else 2.0 if j - i == 2 else 0.5)]
                if j - i > 1:
                    options.append((c + c, 0.0 if j - i == 2 else 0.5))
            elif c in LOOKS:
                # Two equal signs are two letters, but no word starts with a letter twice.
                options = [(x, LOOK_COST + (MARK_COST if j - i == 2 and i else 0.0)) for x in LOOKS[c]]
                if j - i > 1:
                    options += [(x + x, LOOK_COST + (0.0 if i else MARK_COST)) for x in LOOKS[c]]
                if i == 0 and c in LEAD_DROPS:
                    options.append(("", LEAD_DROPS[c]))
                elif j == n and c in TAIL_DROPS:
                    options.append(("", TAIL_DROPS[c]))
                elif c in "!+|#%&$":
                    options.append(("", MARK_COST))
            elif c in SEPARATORS:
                options = [("", DROP_COST)]
            else:
                return []
            if joined:
                options += [(f"{x} {x}", price + SPLIT_COST) for x, y, price in ((p[0], p[1:], cost) for p, cost in options if p) if x == y]
                options += [(" " + piece, price + SPLIT_COST) for piece, price in options if piece]
            following: dict[tuple[int, int], list[tuple[float, tuple | None]]] = {}
            for (a, b), entries in beams.items():
                for piece, price in options:
                    x, y, added = a, b, price
                    for letter in piece:
                        z = CODE.get(letter, 0)
                        added += self.costs[x, y, z]
                        x, y = y, z
                    here = following.setdefault((x, y), [])
                    for cost, out in entries:
                        if len(here) < keep or cost + added < here[-1][0]:
                            here.append((cost + added, (piece, out) if piece else out))
                            here.sort(key=_cost)
                            del here[keep:]
            beams, i = following, j
        ended = sorted(((cost + self.costs[a, b, 0], out) for (a, b), entries in beams.items() for cost, out in entries), key=_cost)
        return [_text(out) for cost, out in ended[:keep] if cost <= ended[0][0] + MARGIN]


def _cost(entry: tuple) -> float:
    return entry[0]


def _text(pieces: tuple | None) -> str:
    found = []
    while pieces is not None:
        piece, pieces = pieces
        found.append(piece)
    return "".join(reversed(found))


def tokens_of(low: str) -> set[tuple[str, bool]]:
    """The distinct tokens of a lower-case text, and its runs of spaced letters, joined (True)."""
    return {(t, False) for t in low.split()} | {(s.replace(" ", ""), True) for s in _SPACED.findall(low)}


def restored_words(text: str | None, decoder: Decoder) -> set[str]:
    """The distinct words of the restored text."""
    if not text:
        return set()
    return {word for token in tokens_of(text.lower()) for word in decoder.words(*token)}


def word_features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [f"={word}", *(f"^{word[:n]}" for n in range(4, 8) if len(word) >= n)]


class Model:
    """Decoder, feature weights and bias; scores texts."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float], bias: float):
        self.costs, self.weights, self.bias = costs, weights, bias

    def scorer(self):
        decoder, weights, bias = Decoder(self.costs), self.weights, self.bias
        known: dict[tuple[str, bool], tuple[str, ...]] = {}

        def features(token: tuple[str, bool]) -> tuple[str, ...]:
            return tuple(f for word in decoder.words(*token) for f in word_features(word) if f in weights)

        def score(text: str | None) -> float:
            present: set[str] = set()
            if text:
                if len(known) > 400_000:
                    known.clear()
                for token in tokens_of(text.lower()):
                    got = known.get(token)
                    if got is None:
                        got = known[token] = features(token)
                    if got:
                        present.update(got)
            total = bias + sum(sorted(weights[f] for f in present))
            return float(1.0 / (1.0 + np.exp(-np.clip(total, -500, 500))))

        return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled documents that are not held out."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # At most ``sample`` rows of 12 bytes: the bound that makes the broadcast safe.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Language model from all texts; features and weights from the labelled sample."""
    costs = letter_costs(trigram_counts(docs))

    def extract(batches):
        decoder = Decoder(costs)
        for batch in small_batches(batches, 500):
            words = [sorted(restored_words(t, decoder)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), batch.column(1)], names=["words", "toxic"])

    # Copies of a text count once, or the words of a text with many copies would look like evidence.
    rows = labelled_sample(docs, labels, sample).distinct().mapInArrow(extract, "words array<string>, toxic int").persist()
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        rows.unpersist()
        share = toxic / (clean + toxic) if clean + toxic else 0.0
        return Model(costs, {}, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    features = F.array_distinct(
        F.flatten(
            F.transform(
                "words",
                lambda w: F.concat(
                    F.array(F.concat(F.lit("="), w)),
                    F.transform(F.filter(F.array(*map(F.lit, range(4, 8))), lambda n: F.length(w) >= n), lambda n: F.concat(F.lit("^"), F.substring(w, F.lit(1), n))),
                ),
            )
        )
    )
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    n = float(clean + toxic)
    absent = F.lit(n) - a - b
    ratio = 2 * (
        term(a, (a + b) * toxic / n)
        + term(b, (a + b) * clean / n)
        + term(F.lit(float(toxic)) - a, absent * toxic / n)
        + term(F.lit(float(clean)) - b, absent * clean / n)
    )
    picked = (
        rows.select("toxic", F.explode(features).alias("f"))
        .groupBy("f")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .where((a >= MIN_TOXIC) & (a * clean > b * toxic))
        .withColumn("ratio", ratio)
        .where(F.col("ratio") >= MIN_RATIO)
        .orderBy(F.desc("ratio"), "f")
        .limit(MAX_FEATURES)
        .select("f")
    )
    names = [r["f"] for r in picked.collect()]  # at most MAX_FEATURES
    at = {f: i for i, f in enumerate(names)}

    def mark(batches):
        for batch in batches:
            hits = [sorted({at[f] for w in words for f in word_features(w) if f in at}) for words in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), batch.column(1)], names=["hits", "toxic"])

    marked = rows.mapInArrow(mark, "hits array<int>, toxic int").groupBy("hits", "toxic").agg(F.count(F.lit(1)).cast("double").alias("n"))
    cases = sorted((tuple(r["hits"]), r["toxic"], r["n"]) for r in marked.collect())  # at most one row per sampled text
    rows.unpersist()
    weights, bias = logistic(cases, len(names))
    return Model(costs, {f: float(w) for f, w in zip(names, weights, strict=True)}, bias)


def logistic(cases: list[tuple[tuple[int, ...], int, float]], size: int, penalty: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with weights of at least zero (all features speak for toxic texts), by accelerated gradient."""
    x = np.zeros((len(cases), size + 1), np.float32)
    x[:, size] = 1.0
    y = np.array([c[1] for c in cases], np.float32)
    n = np.array([c[2] for c in cases], np.float32)
    for i, case in enumerate(cases):
        x[i, list(case[0])] = 1.0
    reach = float((n[:, None] * x * x.sum(1, keepdims=True)).sum(0).max()) / 4 + penalty
    now = np.zeros(size + 1, np.float32)
    ahead, turn = now.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        gradient = x.T @ (n * (p - y)) + penalty * np.append(ahead[:-1], 0)
        new = ahead - gradient / reach
        new[:-1] = np.maximum(new[:-1], 0)
        following = (1 + (1 + 4 * turn * turn) ** 0.5) / 2
        ahead, now, turn = new + (turn - 1) / following * (new - now), new, following
    return now[:-1], float(now[-1])


def score_column(model: Model, text: str = "text") -> Column:
    """The score (0 to 1) of a text column."""

    @pandas_udf("double")
    def toxicity(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for part in parts:
            yield pd.Series([score(t) for t in part], dtype="float64")

    return toxicity(F.col(text))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5, with all columns."""
    return docs.where(score_column(fit(docs, labels)) < 0.5)
