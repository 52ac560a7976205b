"""Document fingerprints by consistent weighted sampling, in SQL functions only.

A text is a bag of weighted terms: its shingles of five words (a shorter text is one shingle of all its words) with
their counts as weights. A weight is cut in cells of one: a term that occurs n times fills its cells 0 to n - 1, so the cells that two
bags share weigh what the terms' smaller weights add up to. Each cell draws, from its hash alone, r and c from Gamma(2, 1)
and b from U(0, 1); with the weight w that fills it

    t = floor(ln w / r + b)      ln a = ln c - r (t - b + 1)

and the cell with the smallest a is a sample of the bag: two bags choose the same one with probability equal to
their generalised Jaccard similarity. Counts fill their cells (w = 1, t = 0). To take ``BINS`` samples in one pass over the cells, a
hash of the cell first deals it to one of ``BINS`` bins and each bin samples its own cells. As a term's weight
is dealt out cell by cell, every bin holds its share of it, and the expected share of equal bins stays the generalised
Jaccard similarity however often a term is repeated. Bins that are empty in both texts say nothing and leave the comparison:
likeness = equal bins / bins that hold a cell in either text.

ln a with 47 fractional bits stands for the cell, so a bag is an array of longs ``bin · 2^54 + ln a``, sorted
once, whose first entry of each bin is the sample. Everything happens inside the row: no shuffle, no Python.

Rules for odd input: null text counts as empty; texts without words have an empty fingerprint, alike (1.0) to each other
and unlike (0.0) to all others; equal texts have equal fingerprints; white space only separates words; repeated rows follow each
other as rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

WORDS = 5
BINS = 256
IDS_PER_BUCKET = 1024

_LOW = 0xFFFFFFFF
_LN2_64 = 44.3614195558365


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """64-bit hashes of the word shingles of a text, repeats included."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def hashes(ws: Column) -> Column:
        rolled = F.transform(
            F.sequence(F.lit(0), F.size(ws) - words), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(words)])
        )
        return (
            F.when(F.size(ws) >= words, rolled)
            .when(F.size(ws) > 0, F.array(F.xxhash64(F.concat_ws(" ", ws))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return _let(parts, hashes)


def _draw(cell: Column, bins: int) -> Column:
    """bin · 2^54 + (ln a + 100) · 2^47 of one full cell."""

    def gamma(h: Column) -> Column:  # -ln(u v), u and v from the halves of a hash
        u = F.shiftrightunsigned(h, 32).cast("double") + 0.5
        v = h.bitwiseAND(F.lit(_LOW)).cast("double") + 0.5
        return F.lit(_LN2_64) - F.log(u * v)

    b = (F.shiftrightunsigned(cell, 32).cast("double") + 0.5) * 2.0**-32
    bin_ = F.pmod(cell.bitwiseAND(F.lit(_LOW)), F.lit(bins))
    log_c = F.log(gamma(F.xxhash64(cell, F.lit(1))))
    log_a = log_c - gamma(F.xxhash64(cell, F.lit(2))) * (1.0 - b)
    return F.shiftleft(bin_, 54) + ((log_a + 100.0) * float(1 << 47)).cast("bigint")


def sample_array(text: Column, words: int = WORDS, bins: int = BINS) -> Column:
    """The fingerprint as an array of integers, bin · 2^16 + 16 bits of the bin's sample, by bin."""

    def samples(s: Column) -> Column:
        def cells(_: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

            def of_term(at: Column) -> Column:
                last = lambda j: F.coalesce(F.get(at, j + 1), F.size(s)) - 1
                return F.flatten(
                    F.transform(
                        at,
                        lambda i, j: F.transform(
                            F.sequence(i, last(j)),
                            lambda k: F.when(k == i, F.get(s, i)).otherwise(F.xxhash64(F.get(s, i), k - i)),
                        ),
                    )
                )

            return _let(starts, of_term)

        repeated = F.size(F.array_distinct(s)) < F.size(s)
        return F.transform(F.when(repeated, cells(s)).otherwise(s), lambda cell: _draw(cell, bins))

    def first_of_bins(c: Column) -> Column:
        own = F.filter(c, lambda x, i: (i == 0) | (F.shiftright(x, 54) != F.shiftright(F.get(c, i - 1), 54)))
        return F.transform(
            own,
            lambda x: (F.shiftleft(F.shiftright(x, 54), 16) + F.xxhash64(x).bitwiseAND(F.lit(0xFFFF))).cast("int"),
        )

    return _let(F.sort_array(_let(F.sort_array(shingle_hashes(text, words)), samples)), first_of_bins)


def fingerprint_text(samples: Column) -> Column:
    """A fingerprint as text: six hex digits for each bin that holds a term."""
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.hex(x), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated generalised Jaccard similarity of the texts of two fingerprints (arrays)."""
    bins = lambda c: F.transform(c, lambda x: F.shiftright(x, 16))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / either)


def with_next(rows: DataFrame, derived: dict[str, Column] | None = None, ids_per_bucket: int = IDS_PER_BUCKET) -> DataFrame:
    """``rows`` (doc_id, text) and the ``derived`` columns, with next_<column> of the following row by (doc_id, text) for the
    text and each derived column; after the last row comes the first.

    Rows are dealt into ranges of doc_id and follow each other inside a range; the last of a range takes the first of
    the next range that has rows, which is found among the ranges alone, in two steps. No task sees more than a range
    of rows, or a 1024th of the ranges."""
    bounds = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("doc_id").alias("n")).first()
    low, high, n = bounds["lo"] or 0, bounds["hi"] or 0, bounds["n"]
    width = max(1, -(-(high - low + 1) // max(1, -(-n // ids_per_bucket))))
    bucketed = rows.withColumn("__b", F.coalesce(F.expr(f"(doc_id - {low}L) div {width}L"), F.lit(-1).cast("bigint")))

    order = Window.partitionBy("__b").orderBy("doc_id", F.xxhash64("text"))
    derived = derived or {}
    columns = ["text", *derived]
    led = bucketed.withColumns(derived).withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).withColumns(
        {"__last": F.lead(F.lit(True)).over(order).isNull()}
    )
    # The first rows are picked before anything is derived, in the map tasks, so only they are worked out twice.
    firsts = bucketed.withColumn("__turn", F.row_number().over(order)).where("__turn = 1").withColumns(derived)
    firsts = firsts.select(F.col("__b").alias("__next_b"), *[F.col(c).alias(f"__first_{c}") for c in columns])

    ranges = bucketed.select("__b").distinct().withColumn("__s", F.expr("__b div 1024"))
    groups = ranges.groupBy("__s").agg(F.min("__b").alias("m"))
    over = Window.partitionBy(F.lit(0)).orderBy("__s")
    ahead = groups.select(
        F.col("__s"), F.coalesce(F.lead("m").over(over), F.first("m").over(over)).alias("m")
    )
    following = ranges.join(ahead, "__s").select(
        F.col("__b").alias("__own_b"), F.coalesce(F.lead("__b").over(Window.partitionBy("__s").orderBy("__b")), "m").alias("__next_b")
    )
    edge = following.join(firsts, "__next_b").drop("__next_b")
    joined = led.join(edge, (F.col("__b") == F.col("__own_b")) & F.col("__last"), "left")
    return joined.select(
        *rows.columns, *derived, *[F.when(F.col("__last"), F.col(f"__first_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in columns]
    )


def fingerprint_documents(docs: DataFrame, words: int = WORDS, bins: int = BINS) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited
    text has its second half (rounded down) replaced by the start of the next document."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(own, {"samples": sample_array(F.col("text"), words, bins)})
    n = F.length("text")
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    done = rows.select("doc_id", "samples", "next_samples", n.cast("bigint").alias("n_chars"), edited.alias("edited")).select(
        "doc_id", "samples", "next_samples", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sample_array(F.col("edited"), words, bins).alias("edited_samples")
    )
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.col("samples")).alias("fingerprint"),
        fingerprint_text(F.col("edited_samples")).alias("edited_fingerprint"),
        likeness(F.col("samples"), F.col("edited_samples")).alias("near_edited"),
        likeness(F.col("samples"), F.col("next_samples")).alias("near_next"),
    )
