"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

The fixed patterns (``assign``, ``access``, ``hex``) are found exactly. Beside them every run of 20 or more token
characters that no fixed span covers is tested:

1. its encoding is the smallest alphabet that holds all its characters;
2. three tests of uniform randomness over that alphabet: chi-squared, runs about the middle symbol, lag-1 serial
   correlation; their p-values are combined by Fisher's method, and a run they reject is not a key;
3. the chance that text would look this uniform at this length: the chi-squared statistic of text is non-central,
   with a non-centrality that grows with the length and with how uneven the corpus's own characters are in the
   alphabet. That makes the value length-aware: short runs cannot reach a small one;
4. Benjamini-Hochberg over all runs of the corpus at ``fdr``; what passes is a span of kind ``random``.

The corpus enters twice, as sums of bounded size: characters per code (128) and runs per p-value bin (401). Bins
are counted at their upper edge, so the level holds.

Rules for odd input: null text is empty; empty texts have no spans; repeated rows and null ids are scanned like any
other row; spans that start together are ordered as the kinds are listed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsloom.llm.common import small_batches
from newsloom.session import scratch_path

KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets from small to large; a run takes the first that holds all its characters.
ALPHABETS = (
    _DIGITS,
    _DIGITS + _LOWER[:6],
    _DIGITS + _UPPER[:6],
    _LOWER,
    _UPPER,
    _UPPER + "234567",
    _DIGITS + _LOWER,
    _DIGITS + _UPPER,
    _UPPER + _LOWER + _DIGITS,
    _UPPER + _LOWER + _DIGITS + "+/",
    _UPPER + _LOWER + _DIGITS + "-_",
    _UPPER + _LOWER + _DIGITS + "+/_.=-",
)
_INDEX = [{c: i for i, c in enumerate(a)} for a in ALPHABETS]
_SETS = [frozenset(a) for a in ALPHABETS]

FDR = 0.01
RANDOM_P = 0.001
_BINS = 400  # tenths of a decade of the p-value

_CANDIDATE = "array<struct<start:int,end:int,enc:int,n:int,x:double>>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, by start and kind."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in RUN.finditer(text):
        at, body = run.start(), run[0]
        if "AKIA" in body:
            found += [(at + m.start(), at + m.end(), "access") for m in ACCESS.finditer(body) if len(m[0]) >= 20]
        found += [(at + m.start(), at + m.end(), "hex") for m in HEX.finditer(body)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(run: str) -> tuple[int, float, float] | None:
    """(encoding, chi-squared, combined p-value of the randomness tests); None for runs of one repeated symbol."""
    chars = set(run)
    enc = next(i for i, s in enumerate(_SETS) if chars <= s)
    k, n = len(ALPHABETS[enc]), len(run)
    index = np.fromiter((_INDEX[enc][c] for c in run), dtype=float, count=n)
    counts = np.bincount(index.astype(int), minlength=k)
    x = float(k / n * (counts * counts).sum() - n)
    z_chi = (x - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    high = index >= k / 2
    n1 = int(high.sum())
    n2 = n - n1
    spread = index.std()
    if spread == 0:
        return None
    if n1 and n2:
        mean = 1 + 2 * n1 * n2 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((high[1:] != high[:-1]).sum())
        p_runs = _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    centred = (index - index.mean()) / spread
    p_serial = _two_sided(float((centred[1:] * centred[:-1]).sum()) / math.sqrt(n - 1))
    p_chi = 0.5 * math.erfc(z_chi / math.sqrt(2))
    half = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return enc, x, math.exp(-half) * (1 + half + half * half / 2)  # upper tail of chi-squared, 6 degrees


def scan_text(text: str | None) -> tuple[list[tuple[int, int, str]], list[dict]]:
    """Fixed spans, and the runs beside them that the randomness tests do not reject."""
    if not text:
        return [], []
    base = base_spans(text)
    candidates = []
    for m in RUN.finditer(text):
        start, end = m.span()
        if any(s < end and start < e for s, e, _ in base):
            continue
        tested = battery(m[0])
        if tested and tested[2] >= RANDOM_P:
            candidates.append({"start": start, "end": end, "enc": tested[0], "n": end - start, "x": tested[1]})
    return base, candidates


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) plus base_spans (string), candidates, and chars (counts of the ASCII codes)."""
    keep = df.columns if keep is None else keep
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__scanned"))
    fields = [source.schema[c] for c in keep]
    schema = T.StructType(
        [
            *fields,
            T.StructField("__base", T.StringType()),
            T.StructField("__candidates", T._parse_datatype_string(_CANDIDATE)),
        ]
    )
    candidate_type = pa.list_(
        pa.struct([("start", pa.int32()), ("end", pa.int32()), ("enc", pa.int32()), ("n", pa.int32()), ("x", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in small_batches(batches):
            base, candidates = [], []
            for value in batch.column(len(fields)).to_pylist():
                spans, tested = scan_text(value)
                base.append(joined(spans))
                candidates.append(tested)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(fields)], pa.array(base, pa.string()), pa.array(candidates, candidate_type)],
                names=[*keep, "__base", "__candidates"],
            )

    return source.mapInArrow(run, schema)


def character_counts(df: DataFrame, text: str = "text") -> list[int]:
    """How often each ASCII code occurs in all texts: one row of 128 sums per partition, then added."""

    def run(batches):
        total = np.zeros(256, dtype=np.int64)
        for batch in batches:
            for part in batch.column(0):
                if part.is_valid:
                    total += np.bincount(np.frombuffer(part.as_buffer(), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(128), pa.int32()), pa.array(total[:128], pa.int64())], names=["code", "n"]
        )

    sums = df.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    counts = [0] * 128
    for row in sums.collect():  # 128 rows at most
        counts[row["code"]] = int(row["n"])
    return counts


def unevenness(counts: list[int]) -> list[float]:
    """Per alphabet: the chi-squared distance of the corpus's characters from uniform, per character. It is kept within
    what text has (at most that of 26 letters, unevenly used, in the alphabet), so that a corpus with a flood of one
    character does not make every word look random."""
    out = []
    for alphabet in ALPHABETS:
        own = np.array([counts[ord(c)] for c in alphabet], dtype=float)
        share = own / own.sum() if own.sum() else np.full(len(own), 1 / len(own))
        most = max(1.0, len(own) / 26 * 1.7 - 1)
        out.append(float(min(max(len(own) * (share * share).sum() - 1, 0.05), most)))
    return out


def _text_p(candidate: Column, uneven: list[float]) -> Column:
    """Chance that text of this length looks at least this uniform (normal form of the non-central chi-squared)."""
    delta = F.element_at(F.array(*[F.lit(u) for u in uneven]), candidate["enc"] + 1)
    df = F.element_at(F.array(*[F.lit(float(len(a) - 1)) for a in ALPHABETS]), candidate["enc"] + 1)
    extra = candidate["n"] * delta
    z = (candidate["x"] - df - extra) / F.sqrt(2 * (df + 2 * extra))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(z * 1.5976 + z * z * z * 0.07056)))


def _bin(p: Column) -> Column:
    """Bin 0 holds the largest p-values; higher bins the smaller ones, ten to a decade."""
    return F.least(F.greatest(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * 10), F.lit(0)), F.lit(_BINS)).cast("int")


def threshold_bin(binned: DataFrame, fdr: float = FDR) -> int:
    """First bin whose runs pass Benjamini-Hochberg; above the last bin if none does. ``binned``: bin, n."""
    counts = {r["bin"]: r["n"] for r in binned.collect()}  # 401 rows at most
    total, seen, best = sum(counts.values()), 0, _BINS + 1
    for b in range(_BINS, -1, -1):
        seen += counts.get(b, 0)
        if counts.get(b, 0) and 10 ** (-b / 10) <= fdr * seen / total:
            best = b
    return best


def _accepted(uneven: list[float], cut: int) -> Column:
    return F.filter("__candidates", lambda c: _bin(_text_p(c, uneven)) >= cut)


def _cut(scanned: DataFrame, uneven: list[float], fdr: float) -> int:
    runs = scanned.select(F.explode("__candidates").alias("c")).select(_bin(_text_p(F.col("c"), uneven)).alias("bin"))
    return threshold_bin(runs.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), fdr)


def _spans(uneven: list[float], cut: int) -> Column:
    """All spans as structs (start, rank of the kind, end), by start and kind."""
    base = F.transform(
        F.filter(F.split("__base", ","), lambda s: s != ""),
        lambda s: F.struct(
            F.split(s, ":")[1].cast("int").alias("start"),
            (F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.split(s, ":")[0]) - 1).cast("int").alias("kind"),
            F.split(s, ":")[2].cast("int").alias("end"),
        ),
    )
    more = F.transform(
        _accepted(uneven, cut), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"))
    )
    return F.array_sort(F.concat(base, more))


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans. Texts are scanned once; the scan's small
    result is written to the shared folder, since the false-discovery level needs all of it first."""
    path = scratch_path(docs.sparkSession, "secrets")
    scan(docs, keep=["doc_id"]).write.parquet(path)
    scanned = docs.sparkSession.read.parquet(path)
    uneven = unevenness(character_counts(docs))
    cut = _cut(scanned, uneven, fdr)
    kinds = F.transform(F.split("__base", ","), lambda s: F.split(s, ":")[0])
    count = lambda kind: F.size(F.filter(kinds, lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")
    name = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(
        _spans(uneven, cut), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    )
    return scanned.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2("__base", 256).alias("base_sha256"),
        F.array_join(text, ",").alias("spans"),
    )


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every span of ``text`` (overlapping ones joined) replaced by ``mask``; ``n_chars``, if it is
    there, counts the new text where it changed. All rows and columns stay."""
    uneven = unevenness(character_counts(docs))
    cut = _cut(scan(docs, keep=[]), uneven, fdr)
    scanned = scan(docs).withColumn("__spans", _spans(uneven, cut))
    # Walk the spans in order; "at" is how far the text has been copied. A span that starts before it extends the
    # span before instead of adding a second mask.
    walk = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.when(
                    (s["start"] >= acc["at"]) | (acc["at"] == 0),
                    F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)),
                )
                .otherwise(acc["out"])
                .alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.lit(2147483647))),
    )
    hit = F.size("__spans") > 0
    masked = scanned.withColumn("text", F.when(hit, walk).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])


def sha256_of(spans: list[tuple[int, int, str]]) -> str:
    """Digest of spans as ``base_sha256`` gives it."""
    return hashlib.sha256(joined(spans).encode()).hexdigest()
