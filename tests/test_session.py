"""Session helpers."""

from pyspark.sql import functions as F

from newsloom.functions.base import per_session
from newsloom.session import scratch_path, shared_dir, spread


def jobs_run(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_spread_only_deals_out_unsplittable_input(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(100).coalesce(1).write.parquet(path)
    before = jobs_run(spark)
    one = spark.read.schema("id bigint").parquet(path)
    dealt = spread(one)
    many = spark.range(0, 1000, 1, 64)
    assert spread(many) is many
    # A shuffled input is neither run nor shuffled again.
    grouped = one.groupBy("id").count()
    assert spread(grouped) is grouped
    joined = one.join(spark.range(5), "id")
    assert spread(joined) is joined
    assert jobs_run(spark) == before
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_columns_are_built_once_per_session(spark):
    calls = []

    @per_session
    def made(name):
        calls.append(name)
        return F.upper(name)

    assert made("a") is made("a") and calls == ["a"]
    made(F.col("b"))
    made(F.col("b"))
    assert len(calls) == 3
