"""The corpus pipeline: toxic documents go, one document of each near-duplicate class stays, secrets are masked, the
sources are interleaved to their target weights, and every document is encoded and decoded.

Each stage takes (spark, docs, sf_dir) and all rows its predecessor kept; ``run`` writes every stage's result as Parquet
in the shared folder and reads it back for the next, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm import bagminhash, bpe, mixing, secrets, toxicity
from newsloom.llm.common import free_name, ship_package, table
from newsloom.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity score does not reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every near-duplicate class."""
    ship_package(spark)
    return bagminhash.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    ship_package(spark)
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in mixture order, with their place in it (mix_slot, mix_at)."""
    return mixing.in_mix_order(mixing.mix(docs))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, source, its place in the mixture, ids (bytes), their number and SHA-256, and the SHA-256
    of the decoded bytes."""
    ship_package(spark)
    place = [c for c in ("mix_slot", "mix_at") if c in docs.columns]
    narrow = docs.select("doc_id", "source", *place, "text")
    decoded = free_name(narrow, "decoded")
    return bpe.round_trip(narrow, ids="ids", out=decoded).select(
        "doc_id",
        "source",
        *place,
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_and_decode),
]

#: SQL cannot express the fitted and hashed stages; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
