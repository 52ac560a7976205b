"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Ids are kept as bytes: one little-endian unsigned 32-bit integer per token. That is a quarter of the size of an
array of longs, hashes directly, and is read back with ``numpy.frombuffer(ids, "<u4")``.

Rules for odd input: a null or empty text has no tokens (zero bytes) and decodes to zero bytes; rows with null or
repeated ids pass like any other; other columns are kept, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from newsloom.llm.common import free_name, small_batches

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: Characters handed to the library at once; longer texts are cut at the next safe boundary.
SEGMENT_CHARS = 1 << 15

# A place no match of the splitting pattern spans: after a non-space before a blank or line feed, or between an
# ASCII letter and an ASCII digit. (Every alternative that holds a non-space ends before white space, and none
# joins letters with digits; look-aheads only see what follows white space, which stays in one segment with it.)
_SAFE_END = re.compile(r"\S(?=[ \n])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")


@lru_cache(maxsize=4)
def encoding(ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once per Python worker."""
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """Pieces of a text, cut only where encoding the pieces apart gives the ids of the whole."""
    start = 0
    while len(text) - start > size:
        found = _SAFE_END.search(text, start + size - 1)
        if found is None:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:] if start else text


def encode_text(text: str | None, enc: tiktoken.Encoding) -> bytes:
    """Ids of one text as bytes; special-token strings in it are ordinary text."""
    if not text:
        return b""
    return b"".join(
        np.asarray(enc.encode_to_numpy(part, disallowed_special=()), dtype="<u4").tobytes() for part in segments(text)
    )


def decode_ids(ids: bytes | None, enc: tiktoken.Encoding) -> bytes:
    """Raw bytes of the tokens; joined before any UTF-8 decoding, since a character may span tokens."""
    return enc.decode_bytes(np.frombuffer(ids, "<u4").tolist()) if ids else b""


def _mapped(df: DataFrame, column: str, out: list[str], one) -> DataFrame:
    """``df`` with binary columns ``out`` worked out from ``column`` by ``one(value)`` in Arrow batches."""
    names = [*df.columns, *out]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.BinaryType()) for n in out)])
    at = df.columns.index(column)

    def run(batches):
        for batch in small_batches(batches):
            rows = [one(v) for v in batch.column(at).to_pylist()]
            made = [pa.array([r[i] for r in rows], pa.binary()) for i in range(len(out))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """``df`` with the ids of ``text`` in the new binary column ``ids``."""
    return _mapped(df, text, [ids], lambda value: (encode_text(value, encoding(ranks)),))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """``df`` with the raw bytes of the tokens in ``ids`` in the new binary column ``out``."""
    return _mapped(df, ids, [out], lambda value: (decode_ids(value, encoding(ranks)),))


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", out: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """Encode and decode in one pass over the rows: both new columns."""

    def one(value):
        enc = encoding(ranks)
        made = encode_text(value, enc)
        return made, decode_ids(made, enc)

    return _mapped(df, text, [ids, out], one)


def token_digests(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes."""
    narrow = docs.select("doc_id", "text")
    ids, out = free_name(narrow, "ids"), free_name(narrow, "decoded")
    return round_trip(narrow, ids=ids, out=out, ranks=ranks).select(
        "doc_id",
        F.expr(f"cast(octet_length({ids}) div 4 as bigint)").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(out, 256).alias("decoded_sha256"),
    )
