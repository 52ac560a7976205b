"""URL filter: rules first, then word segmentation and naive Bayes.

A rule names a host, with all its subdomains, and a path prefix; the longest fitting rule decides (longest host,
then longest path). Other urls are scored:

1. Host labels and path parts are cut at everything but letters; what is left may be several words run together
   (``cheappillsonline``). A unigram Viterbi pass splits it into words. The unigram model is made of the words that
   stand alone in the urls of the table (one count per url, from all urls) and of a seed list of words.
2. Multinomial naive Bayes scores host and path words (kept apart by a prefix). It is trained on the urls of the table: a
   url with a seed word of the unwanted list among its words counts as unwanted, any other as wanted. Host words
   weigh once per host and not once per page, so a large site cannot outvote the others.

Both models are sums over all urls, gathered with partial sums per (word); the driver takes only words seen on at
least ``MIN_HOSTS`` hosts, or in at least ``MIN_URLS`` urls, and of those the ``MAX_WORDS`` most frequent: a bound
on the model, not on the rows scored. Every row is scored.

Rules for odd input: a null url, or one without ``://``, has an empty host and path and no rule; it has no words, and
its score is the prior, so it is allowed. Repeated rows get equal verdicts. Ports and user names stay in the host.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import small_batches

#: (verdict, host, path), fixed values.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Words that mark an unwanted site, fixed values: gambling, adult, drugs, tracking, fraud.
UNWANTED = (
    "casino bet bets betting poker slots jackpot lottery gamble gambling adult porn sex xxx nude escort webcam "
    "pills viagra cialis pharma drugs steroids ads advert banner popup track tracker tracking clicks affiliate "
    "spam scam fraud phishing malware virus warez crack keygen torrent cheap discount replica fake loan loans "
    "payday credit debt winner prize giveaway"
).split()

#: Ordinary words of hosts and paths, fixed values.
ORDINARY = (
    "www blog news shop store mail web site page home about contact help info docs wiki forum media images video "
    "free win farm online best top world daily post times press journal science health travel sport music food "
    "school university library research open data code tech cloud app mobile index article archive category tag "
    "search login user example"
).split()

MIN_HOSTS, MIN_URLS, MAX_WORDS = 2, 3, 50_000
MAX_PART = 64  # a longer run of letters is not a name; its first split is by this many letters
_LETTERS = re.compile(r"[a-z]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters in lower case) and path of a url, by the text after the first ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.lit(2147483647))
    whole = F.when(at > 0, rest)
    host = F.regexp_extract(whole, r"^([^/?#]*)", 1)
    path = F.regexp_extract(whole, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host, then path) as text, and its verdict; nulls if none fits."""
    rule = verdict = None
    for kind, name, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, name + prefix) if rule is None else rule.when(fits, name + prefix)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


class Segmenter:
    """Unigram Viterbi: the most likely words of a run of letters. Unknown words cost by their length."""

    def __init__(self, counts: dict[str, float]):
        total = sum(counts.values()) or 1.0
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.unknown = math.log(total) + 2.0
        self.longest = max(map(len, counts), default=1)
        self.known: dict[str, tuple[str, ...]] = {}

    def words(self, run: str) -> tuple[str, ...]:
        got = self.known.get(run)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[run] = self._split(run)
        return got

    def _split(self, run: str) -> tuple[str, ...]:
        n = len(run)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - max(self.longest, MAX_PART)), end):
                word = run[start:end]
                # An unknown word costs a fixed price and something for each letter: one unknown word beats several.
                cost = best[start] + self.cost.get(word, self.unknown + 1.2 * len(word))
                if cost < best[end]:
                    best[end], back[end] = cost, start
        out, end = [], n
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return tuple(reversed(out))


def url_words(host: str, path: str, segmenter: Segmenter) -> tuple[list[str], list[str]]:
    """Words of the host and of the path."""
    return tuple([w for run in _LETTERS.findall(part.lower()) for w in segmenter.words(run)] for part in (host, path))


def _runs(parts: DataFrame) -> DataFrame:
    """Letter runs of hosts and paths with the number of urls and of hosts (up to 2) they occur in."""
    cut = lambda c: F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: w != "")
    each = parts.select("host", F.explode(F.array_distinct(F.concat(cut("host"), cut("path")))).alias("run"))
    return each.groupBy("run").agg(
        F.count(F.lit(1)).alias("urls"), F.min("host").alias("low"), F.max("host").alias("high")
    )


def unigram_counts(parts: DataFrame) -> dict[str, float]:
    """Counts of the words that stand alone, and of the seed lists."""
    frequent = (
        _runs(parts)
        .where((F.col("low") != F.col("high")) | (F.col("urls") >= MIN_URLS))
        .where(F.length("run") <= 20)
        .orderBy(F.desc("urls"), "run")
        .limit(MAX_WORDS)
    )
    # A run of letters that holds seed words is what we want to split, so it counts little as a word of its own.
    counts = {r["run"]: math.log1p(r["urls"]) for r in frequent.collect()}
    for word in (*ORDINARY, *UNWANTED):
        counts[word] = max(counts.get(word, 0.0), 20.0)
    return counts


class Bayes:
    """Multinomial naive Bayes over prefixed words; scores are log odds of unwanted."""

    def __init__(self, counts: dict[str, tuple[float, float]], prior: float, seeds: tuple[str, ...] = (), smooth: float = 0.5):
        bad, good = (sum(c[i] for c in counts.values()) + smooth * (len(counts) + 1) for i in (0, 1))
        self.prior = prior
        weight = lambda b, g: math.log((b + smooth) / bad) - math.log((g + smooth) / good)
        # A seed word that no url has weighs as one that a single unwanted url has.
        self.weight = {w: weight(1.0, 0.0) for w in seeds} | {w: weight(b, g) for w, (b, g) in counts.items()}

    def score(self, host: list[str], path: list[str]) -> float:
        words = [f"h:{w}" for w in host] + [f"p:{w}" for w in path]
        return self.prior + sum(self.weight.get(w, 0.0) for w in words)


def train(parts: DataFrame, counts: dict[str, float]) -> Bayes:
    """Word counts of wanted and unwanted urls; host words once per host, path words once per distinct path."""
    seeds = frozenset(UNWANTED)

    def run(batches):
        segmenter = Segmenter(counts)
        for batch in small_batches(batches):
            words, marks = [], []
            for host, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = url_words(host, path, segmenter)
                marks.append(int(any(w in seeds for part in own for w in part)))
                words.append([f"h:{w}" for w in own[0]] + [f"p:{w}" for w in own[1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array(marks, pa.int32())],
                names=["host", "words", "bad"],
            )

    # One row per host and first path part: pages of one site differ in numbers, not in words.
    shapes = parts.select("host", F.regexp_replace("path", "[^A-Za-z/]+", "").alias("path")).distinct()
    marked = shapes.mapInArrow(run, "host string, words array<string>, bad int")
    each = marked.select("host", "bad", F.explode("words").alias("word")).distinct()
    sums = (
        each.groupBy("word")
        .agg(F.sum("bad").cast("double").alias("bad"), F.sum(1 - F.col("bad")).cast("double").alias("good"))
        .orderBy(F.desc(F.col("bad") + F.col("good")), "word")
        .limit(MAX_WORDS)
    )
    table = {r["word"]: (r["bad"], r["good"]) for r in sums.collect()}
    return Bayes(table, math.log(0.1 / 0.9), tuple(f"{part}:{word}" for word in UNWANTED for part in "hp"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule (or null), verdict, and score (log odds of unwanted, whatever the rule)."""
    host, path = host_and_path(F.col("url").cast("string"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    distinct = parts.select("host", "path")
    counts = unigram_counts(distinct)
    model = train(distinct, counts)

    def run(batches: Iterator[pa.RecordBatch]):
        segmenter = Segmenter(counts)
        for batch in small_batches(batches):
            scores = [
                model.score(*url_words(h, p, segmenter)) for h, p in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=["page_id", "host", "path", "score"])

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, score double"
    scored = parts.mapInArrow(run, schema)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score")
