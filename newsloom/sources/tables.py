"""Readers of the captured-document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.functions.base import is_blank, trim_space
from newsloom.operators.ranking import position_in_group

# Schemas of the input tables, as DDL text so that they need no running session.
FEED_DOCUMENTS = (
    "request_pos bigint, feed_url string, body string, content_type string, fetched_at timestamp"
)
RESPONSES = (
    "feed_url string, http_status int, body string, etag string, last_modified string, "
    "content_type string, retry_after string, fetched_at timestamp"
)
SNAPSHOTS = (
    "feed_url string, etag string, last_modified string, fetched_at timestamp, "
    "content_type string, body string"
)
FETCH_LOG = "log_id bigint, authority string, ts timestamp, http_status int, retry_after string"
PAGES = "url string, html string"


def column_names(ddl: str) -> list[str]:
    """Names of a flat DDL schema."""
    return [field.split()[0] for field in ddl.split(",")]


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """One of the tables above from Parquet, ORC or JSON files, with a fixed schema (no inference)."""
    return spark.read.format(fmt).schema(schema).load(path)


def read_feed_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(request_pos, feed_url, body, content_type, fetched_at)``, one row per document."""
    return read_table(spark, path, FEED_DOCUMENTS, fmt)


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, RESPONSES, fmt)


def read_fetch_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, FETCH_LOG, fmt)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(url, html)``; ``url`` is the one the page was finally served from."""
    return read_table(spark, path, PAGES, fmt)


def read_body_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw files as feed documents: the file path stands for the URL, bytes are read as UTF-8.

    Files are numbered from 0 in the order of their paths. The numbering reads paths only; the files are
    read once. Invalid bytes become replacement characters rather than failing the job.
    """
    files = spark.read.format("binaryFile").load(path)
    whole = files.select("path").withColumn("_all", F.lit(0))
    numbers = position_in_group(whole, ["_all"], [F.col("path")], "_n").select("path", (F.col("_n") - 1).alias("request_pos"))
    return files.join(numbers, "path").select(
        "request_pos",
        F.col("path").alias("feed_url"),
        decode_utf8("content").alias("body"),
        F.lit(None).cast("string").alias("content_type"),
        F.col("modificationTime").alias("fetched_at"),
    )


def decode_utf8(column: str):
    """Lenient UTF-8: a byte-order mark is dropped, malformed bytes are replaced."""
    text = F.make_valid_utf8(F.col(column).cast("string"))
    return F.regexp_replace(text, "^\\x{feff}", "")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """``(file, pos, url)`` of plain URL lists, one file per list, blanks and ``#`` lines dropped.

    Line numbers come from splitting each list as a whole, so they do not depend on file splits.
    """
    lists = spark.read.format("binaryFile").load(path)
    lines = lists.select(
        F.col("path").alias("file"),
        F.posexplode(F.split(decode_utf8("content"), "\n")).alias("pos", "line"),
    )
    return seeds(lines.select("file", "pos", F.col("line").alias("url")))


def seeds(urls: DataFrame) -> DataFrame:
    """Trim the ``url`` column and drop blank and comment entries."""
    trimmed = urls.withColumn("url", trim_space("url"))
    return trimmed.where(~is_blank("url") & ~F.col("url").startswith("#"))


def read_opml(spark: SparkSession, path: str) -> DataFrame:
    """``(file, pos, url)``: every outline's ``xmlUrl`` in pre-order, nested outlines included."""
    files = spark.read.format("binaryFile").load(path)
    return opml_urls(files.select(F.col("path").alias("file"), decode_utf8("content").alias("body")))


def opml_urls(documents: DataFrame) -> DataFrame:
    """Feed URLs of OPML text in ``body``; pre-order is the order of the outline tags in the text."""
    from newsloom.functions.text import unescape_entities

    bare = F.regexp_replace("body", r"(?s)<!--.*?-->", "")
    tags = F.regexp_extract_all(bare, F.lit(r"(?s)<outline\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>"), F.lit(0))
    value = r"""(?s)\sxmlUrl\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    keep = [c for c in documents.columns if c != "body"]
    outlines = documents.select(*keep, F.posexplode(tags).alias("pos", "tag"))
    urls = outlines.where(F.col("tag").rlike(value)).select(
        *keep,
        "pos",
        unescape_entities(
            F.concat(F.regexp_extract("tag", value, 1), F.regexp_extract("tag", value, 2))
        ).alias("url"),
    )
    return seeds(urls)
