"""Session settings the jobs rely on, and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from newsloom.errors import UsageError

# Runtime settings every job assumes. UTC keeps RFC 3339 text and timestamps in step;
# the adaptive settings let Spark split hot join keys and size shuffles from real statistics.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Options that can only be given when the session starts. Plans here hold thousands of small
# expressions; recording a Python call site for each would double the time to build a plan.
STATIC_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime options on an existing session (all of them are changeable at run time)."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "newsloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the options above plus ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **STATIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    return apply_runtime_conf(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``; without it a job there fails at once. Only in
    single-process runs (such as the tests) a local temporary folder stands in, once per session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise UsageError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Enough tasks for CPU-heavy row work when the input comes in fewer pieces than there are cores.

    Large inputs have more splits than cores and pass unchanged, without a shuffle; a few big files
    that cannot be split are dealt out evenly first. Inputs that are shuffled anyway, cached, or
    streaming pass unchanged too: asking those for their partitions would run them.
    """
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution().executedPlan().toString()
    if any(node in plan for node in ("Exchange", "InMemoryTableScan", "Subquery")):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
