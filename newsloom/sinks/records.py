"""Line outputs: NDJSON items, tagged records, text summaries, discovery listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.dates import rfc3339
from newsloom.operators.discovery import discover_feeds, page_feeds
from newsloom.operators.items import ITEM_COLUMNS, contract_items
from newsloom.operators.totals import FALLBACK_TEXT, UNDATED_TEXT, truncation_struct
from newsloom.plans.fetch import FeedRun
from newsloom.schemas import SCHEMA_VERSION

_KEEP_NULLS = {"ignoreNullFields": "false"}


def write_ndjson(items: DataFrame, path: str) -> None:
    """One contract item per line."""
    contract_items(items).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def ndjson_lines(items: DataFrame) -> DataFrame:
    """``(feed_url, id, line)`` with the same JSON text, for further processing."""
    line = F.to_json(F.struct(*ITEM_COLUMNS), _KEEP_NULLS)
    return contract_items(items).select("feed_url", "id", line.alias("line"))


def _tagged(kind: str, fields: dict[str, Column]) -> Column:
    named = {**fields, "type": F.lit(kind)}
    return F.to_json(F.struct(*[named[k].alias(k) for k in sorted(named)]), _KEEP_NULLS)


# What records carry along to be summed up, by name.
_SUMS = ("feeds", "errors", "items", "tokens", "cut", "warnings")


def _record(keys: dict[str, Column], line: Column | None, **sums: Column | int) -> Column:
    """One output record: its sort keys, its line, and its part of the totals."""
    values = {name: (v if isinstance(v, Column) else F.lit(v)).cast("bigint") for name, v in sums.items()}
    zero = F.lit(0).cast("bigint")
    return F.struct(
        *[v.alias(k) for k, v in keys.items()],
        (F.lit(None).cast("string") if line is None else line).alias("line"),
        *[values.get(name, zero).alias(name) for name in _SUMS],
    )


def _summed(
    rows: DataFrame, records: list[Column], carried: tuple[str, ...] = (), *aggregates: Column, always: Column | None = None
) -> DataFrame:
    """All records of all rows in one pass over them: rows explode to their records, and those that share
    all keys and have no line become one total, in the one shuffle there is. Tasks add up totals first,
    so that group is no larger than the number of tasks. ``always`` is a record there is without rows too."""
    made = rows.select(*carried, F.inline(F.array_compact(F.array(*records))))
    if always is not None:
        made = made.unionByName(rows.sparkSession.range(1).select(F.inline(F.array(always))), allowMissingColumns=True)
    keys = [c for c in made.columns if c not in (*_SUMS, *carried)]
    return made.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in _SUMS], *aggregates)


def _keys(kind: str, rank: int, *more: tuple[str, Column], whole_run: bool = False, pos: Column | None = None) -> dict[str, Column]:
    zero = F.lit(0).cast("bigint")
    return {
        kind: F.lit(rank),
        "request_pos": zero if whole_run else F.col("request_pos"),
        **dict(more),
        "ts": F.lit(None).cast("timestamp") if pos is None else F.col("ts"),
        "pos": zero if pos is None else pos,
    }


def _shown(run: FeedRun, name: str) -> Column:
    is_time = run.rows.schema[name].dataType.typeName().startswith("timestamp")
    return rfc3339(name) if is_time else F.col(name)


def tagged_records(run: FeedRun, fetched_at: Column, warning_lines: bool | None = None) -> DataFrame:
    """``(kind_rank, request_pos, ts, pos, line)``: item and error records, then one summary record.

    With ``warning_lines`` each warning is a record of its own and the summary counts them; without, the
    summary lists them, at most two per feed. Such a list grows with the number of feeds, so it is only
    the default of runs with a limit. The documents are read and parsed once.
    """
    if warning_lines is None:
        warning_lines = run.params.limit is None
    is_item = F.col("pos") > 0
    failed = ~is_item & F.col("error").isNotNull()
    undated = ~is_item & (F.col("n_items") > 0) & (F.col("n_dated") == 0)
    fell_back = ~is_item & (F.col("n_fell_back") > 0)
    error = F.col("error")
    # Error details are already JSON, so they are spliced in rather than quoted.
    error_line = F.regexp_replace(
        _tagged("error", {**{c: error[c] for c in ("feed_url", "code", "message")}, "details": F.lit("@details@")}),
        F.lit('"@details@"'),
        F.replace(F.replace(error["details"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")),
    )
    warnings = [
        ("CONTENT_EXTRACTION_FALLBACK", fell_back, F.format_string(FALLBACK_TEXT, F.col("n_fell_back"))),
        ("UNDATED_ITEMS", undated, F.format_string(UNDATED_TEXT, F.col("n_items"))),
    ]
    item_line = _tagged("item", {c: _shown(run, c) for c in ITEM_COLUMNS})
    records = [
        F.when(is_item, _record(_keys("kind_rank", 0, pos=F.col("pos")), item_line)),
        F.when(failed, _record(_keys("kind_rank", 1), error_line)),
        F.when(
            ~is_item,
            _record(
                _keys("kind_rank", 3, whole_run=True),
                None,
                feeds=1,
                errors=failed.cast("int"),
                items=F.col("n_items"),
                tokens=F.col("n_tokens"),
                cut=F.col("n_cut"),
                warnings=fell_back.cast("int") + undated.cast("int"),
            ),
        ),
    ]
    summary = {
        "schema_version": F.lit(SCHEMA_VERSION),
        "fetched_at": fetched_at,
        "truncation": truncation_struct(F.col("cut"), F.lit(None), F.lit(None), F.lit(None)),
        "warnings": F.col("warnings") if warning_lines else F.lit("@warnings@"),
        "total_items": F.col("items"),
        "total_content_tokens_est": F.col("tokens"),
        **{c: F.col(c) for c in ("feeds", "errors")},
    }
    summary_line = _tagged("summary", summary)
    nothing = _record(_keys("kind_rank", 3, whole_run=True), None)
    if warning_lines:
        for k, (code, applies, message) in enumerate(warnings):
            keys = _keys("kind_rank", 2) | {"pos": F.lit(k).cast("bigint")}
            line = _tagged("warning", {"feed_url": F.col("feed_url"), "code": F.lit(code), "message": message})
            records.append(F.when(applies, _record(keys, line)))
        grouped = _summed(run.rows, records, always=nothing)
    else:
        listed = F.array_compact(
            F.array(
                *[
                    F.when(
                        applies,
                        F.struct(
                            "request_pos",
                            F.lit(k).alias("k"),
                            F.to_json(F.struct(F.lit(code).alias("code"), "feed_url", message.alias("message")), _KEEP_NULLS).alias("json"),
                        ),
                    )
                    for k, (code, applies, message) in enumerate(warnings)
                ]
            )
        )
        rows = run.rows.withColumn("_listed", listed)
        total = F.col("line").isNull()
        gathered = F.collect_list(F.when(total & (F.size("_listed") > 0), F.col("_listed"))).alias("_listed")
        grouped = _summed(rows, records, ("_listed",), gathered, always=nothing)
        texts = F.transform(F.array_sort(F.flatten("_listed")), lambda w: w["json"])
        summary_line = F.replace(summary_line, F.lit('"@warnings@"'), F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")))
    line = F.coalesce("line", summary_line)
    return grouped.select("kind_rank", "request_pos", "ts", "pos", line.alias("line"))


def write_tagged_records(run: FeedRun, fetched_at: Column, path: str, warning_lines: bool | None = None) -> None:
    order = ["kind_rank", "request_pos", F.col("ts").desc_nulls_last(), "pos"]
    lines = tagged_records(run, fetched_at, warning_lines).orderBy(*order)
    lines.select("line").write.mode("overwrite").text(path)


def text_summary(run: FeedRun) -> DataFrame:
    """``(part, request_pos, row, ts, pos, line)``: a readable listing, ordered by its key columns.

    The documents are read and parsed once.
    """
    is_item = F.col("pos") > 0
    failed = ~is_item & F.col("error").isNotNull()
    header = F.concat(
        F.coalesce("title", "feed_url"),
        F.lit("  ["),
        F.col("status"),
        F.lit("]"),
        F.when(F.col("from_cache"), F.lit(" (cached)")).otherwise(F.lit("")),
        F.format_string("  %d item(s)", "n_items"),
    )
    dash = F.lit("-")
    item_line = F.concat(
        F.lit("  - "), F.coalesce(rfc3339("published"), dash),
        F.lit("  "), F.coalesce("title", dash),
        F.lit("  "), F.coalesce("url", dash),
    )
    error = F.col("error")
    inline = F.concat(F.lit("  ! "), error["code"], F.lit(": "), error["message"])
    listed = F.concat(
        F.lit("  ! ["), error["code"], F.lit("] "),
        F.coalesce(F.concat(error["feed_url"], F.lit(": ")), F.lit("")), error["message"],
    )

    def record(part: int, row: int, line: Column | None, pos: Column | None = None, **sums: int) -> Column:
        return _record(_keys("part", part, ("row", F.lit(row)), whole_run=line is None, pos=pos), line, **sums)

    records = [
        F.when(~is_item, record(0, 0, header)),
        F.when(is_item, record(0, 1, item_line, F.col("pos"))),
        F.when(failed, record(0, 2, inline)),
        F.when(failed, record(1, 0, None, errors=1)),
        F.when(failed, record(1, 1, listed)),
    ]
    line = F.coalesce("line", F.format_string("%d error(s):", "errors"))
    return _summed(run.rows, records).select("part", "request_pos", "row", "ts", "pos", line.alias("line"))


def write_text_summary(run: FeedRun, path: str) -> None:
    order = ["part", "request_pos", "row", F.col("ts").desc_nulls_last(), "pos"]
    text_summary(run).orderBy(*order).select("line").write.mode("overwrite").text(path)


def discovery_reports(pages: DataFrame) -> DataFrame:
    """``(site_url, document)``: the discovery document of each page, empty lists included."""
    document = F.to_json(
        F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "site_url", "feeds"), _KEEP_NULLS
    )
    return page_feeds(pages).select("site_url", document.alias("document"))


def discovery_ndjson(pages: DataFrame) -> DataFrame:
    """``(site_url, pos, line)``: one discovered feed per line."""
    line = F.to_json(F.struct("url", "feed_type", "title"), _KEEP_NULLS)
    return discover_feeds(pages).select("site_url", "pos", line.alias("line"))


def discovery_text(pages: DataFrame) -> DataFrame:
    """``(site_url, pos, line)``: a header per page at position -1, then its feeds."""
    header = F.format_string("%s  %d feed(s)", F.col("site_url"), F.size("feeds"))
    lines = F.transform(
        "feeds",
        lambda f: F.format_string(
            "  %s  [%s]  %s", f["url"], f["feed_type"], F.coalesce(f["title"], F.lit("-"))
        ),
    )
    listed = page_feeds(pages).select(
        "site_url", F.posexplode(F.concat(F.array(header), lines)).alias("_i", "line")
    )
    return listed.select("site_url", (F.col("_i") - 1).cast("bigint").alias("pos"), "line")
