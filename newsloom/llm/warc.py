"""WARC archives: a deterministic sharded writer and a reader.

Writing. Pages are cut into ranges of page_id (the rule uses only the ids: first id, ids per shard), each range is
one shard, and one task writes a shard in page_id order. A shard rolls to its next file when the compressed size
reaches ``roll_bytes``. Headers are made anew for every record; ids, digests and dates follow from the row alone, so
the same table gives the same bytes in the same files, whichever executor writes them and however often. A file is
written under a temporary name of its own task attempt and renamed when it is whole; the manifest (one line per
file: name, records, bytes, SHA-256) is written by Spark last and commits the archive. Readers open only files of
the manifest, and check their digest, so what a lost executor leaves behind is never read.

Equal payloads of at least ``MIN_REVISIT`` bytes are stored once, with the smallest page_id; the others are revisit
records that refer to it. Payloads are grouped by digest with partial sums; no group meets in one task.

Rules for odd input: null html is an empty payload; null url is written as an empty target; null page_ids form a
shard of their own, and are responses if their payload has no other id; repeated rows each get a record, and all rows with
the smallest page_id of their payload are responses; an empty table gives an archive without files. Columns besides
page_id, url and html are not archived.

The folder is reached through ``pyarrow.fs`` (file, s3, gs, hdfs, abfs addresses).
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm.common import small_batches
from newsloom.session import scratch_path

MIN_REVISIT = 100
PAGES_PER_SHARD = 2048
ROLL_BYTES = 64 << 20
LEVEL = 3
#: Date of the records where pages carry none: fixed, so that archives of equal tables are equal.
RECORD_DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "file string, shard string, records bigint, bytes bigint, sha256 string"
_RECORDS = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _open(folder: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pa.fs.LocalFileSystem(), folder
    scheme, _, rest = folder.partition(":")
    if scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pa.fs.FileSystem.from_uri(folder)


def record_uri(page_id: int | None, digest: str) -> str:
    """Record id that follows from the row: a name-based UUID."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def _line(value: str) -> str:
    """A header value on one line, reversible for any text."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has an empty block; its digest and length are those of the full payload."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_uri(page_id, digest)}>",
        f"WARC-Date: {RECORD_DATE}",
        *([] if url is None else [f"WARC-Target-URI: {_line(url)}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest() if revisit else digest}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        f"X-Payload-Length: {len(payload)}",
        *(
            [
                f"WARC-Profile: {REVISIT_PROFILE}",
                f"WARC-Refers-To: <{record_uri(refers_to, digest)}>",
                f"X-Refers-To-Page-ID: {refers_to}",
            ]
            if revisit
            else []
        ),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed WARC stream."""
    while True:
        first = stream.readline()
        if not first:
            return
        if not first.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if len(block) != int(headers["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut off")
        yield headers, block


class _Roller:
    """The files of one shard, one after another; gives manifest rows."""

    def __init__(self, folder: str, shard: str, roll_bytes: int):
        self.fs, self.root = _open(folder)
        self.shard, self.roll_bytes = shard, roll_bytes
        self.seq, self.sink, self.rows = 0, None, []

    def add(self, record: bytes) -> None:
        member = gzip.compress(record, LEVEL, mtime=0)
        if self.sink is not None and self.size + len(member) > self.roll_bytes:
            self.close()
        if self.sink is None:
            self.name = f"shard-{self.shard}-{self.seq:05d}.warc.gz"
            self.temporary = f"{self.root}/_writing-{uuid.uuid4().hex}"
            self.sink = self.fs.open_output_stream(self.temporary, compression=None)
            self.size, self.count, self.digest = 0, 0, hashlib.sha256()
        self.sink.write(member)
        self.digest.update(member)
        self.size += len(member)
        self.count += 1

    def close(self) -> None:
        if self.sink is None:
            return
        self.sink.close()
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        self.rows.append((self.name, self.shard, self.count, self.size, self.digest.hexdigest()))
        self.sink, self.seq = None, self.seq + 1


def _manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "shard", "records", "bytes", "sha256"]
    )


def _payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest."""
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of every page whose payload an earlier page has. Only ids and digests are shuffled."""
    large = _payloads(pages).where(F.octet_length("payload") >= MIN_REVISIT).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("refers_to").isNotNull()).drop("n")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to"))
    return large.join(first, "digest").where(later).select("page_id", "digest", "refers_to").distinct()


def write_archive(pages: DataFrame, folder: str, pages_per_shard: int = PAGES_PER_SHARD, roll_bytes: int = ROLL_BYTES) -> str:
    """Write the archive of ``pages`` below ``folder`` (new); returns ``folder``. The manifest is in ``manifest``."""
    spark = pages.sparkSession
    bounds = pages.select(F.col("page_id").cast("bigint").alias("page_id")).agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), F.count("page_id").alias("n")).first()
    low, span = bounds["lo"] or 0, 1
    shards = 1
    if bounds["n"]:
        shards = max(1, -(-bounds["n"] // pages_per_shard))
        span = max(1, -(-(bounds["hi"] - low + 1) // shards))
    shard = F.coalesce(F.lpad(F.expr(f"cast((page_id - {low}L) div {span}L as string)"), 8, "0"), F.lit("null"))
    tasks = max(1, min(shards + 1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)

    # A revisit's mark travels beside the pages and sorts just before them, so payloads are shuffled once.
    marks = revisits(pages).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to")
    marked = (
        _payloads(pages)
        .withColumn("refers_to", F.lit(None).cast("bigint"))
        .union(marks)
        .select(shard.alias("shard"), "page_id", "url", "payload", "digest", "refers_to")
        .repartition(tasks, "shard")
        .sortWithinPartitions("shard", "page_id", "digest", F.col("refers_to").asc_nulls_last(), "url")
    )

    def run(batches):
        current, mark = None, None
        for batch in small_batches(batches, 256):
            for row in batch.to_pylist():
                if row["refers_to"] is not None:
                    mark = (row["page_id"], row["digest"], row["refers_to"])
                    continue
                refers_to = mark[2] if mark and mark[:2] == (row["page_id"], row["digest"]) else None
                if current is None or current.shard != row["shard"]:
                    if current is not None:
                        current.close()
                        yield _manifest_batch(current.rows)
                    current = _Roller(folder, row["shard"], roll_bytes)
                current.add(record_bytes(row["page_id"], row["url"], row["payload"], row["digest"], refers_to))
        if current is not None:
            current.close()
            yield _manifest_batch(current.rows)

    marked.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a committed archive: page_id, url, payload (null for revisits), payload_bytes, payload_digest,
    record_type, refers_to. Digests of files and payloads are checked on the way."""
    files = spark.read.parquet(f"{folder}/manifest")

    def run(batches):
        fs, root = _open(folder)
        for batch in batches:
            for entry in batch.to_pylist():
                out = []
                size = 0
                with fs.open_input_stream(f"{root}/{entry['file']}", compression=None) as raw, gzip.GzipFile(fileobj=_Hashing(raw)) as stream:
                    for headers, block in read_records(stream):
                        out.append(_row(headers, block))
                        size += len(block)
                        if size >= 4 << 20:
                            yield _record_batch(out)
                            out, size = [], 0
                    if stream.fileobj.digest.hexdigest() != entry["sha256"]:
                        raise ValueError(f"{entry['file']} does not match the manifest")
                if out:
                    yield _record_batch(out)

    parts = max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("file", "sha256").repartition(parts, "file").mapInArrow(run, _RECORDS)


class _Hashing(io.RawIOBase):
    """A readable stream that digests what is read."""

    def __init__(self, raw):
        self.raw, self.digest = raw, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        data = self.raw.read(None if size is None or size < 0 else size)
        self.digest.update(data)
        return data


def _row(headers: dict[str, str], block: bytes) -> tuple:
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = headers["WARC-Type"] == "revisit"
    if hashlib.sha256(block).hexdigest() != headers["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"{headers['WARC-Record-ID']}: the block does not match its digest")
    page, refers, url = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID"), headers.get("WARC-Target-URI")
    return (
        None if page is None else int(page),
        None if url is None else _unline(url),
        None if revisit else block,
        int(headers["X-Payload-Length"]) if revisit else len(block),
        digest,
        headers["WARC-Type"],
        None if refers is None else int(refers),
    )


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages (to a new place in the shared folder unless one is given) and read the archive back."""
    spark = pages.sparkSession
    return read_archive(spark, write_archive(pages, folder or scratch_path(spark, "warc")))
