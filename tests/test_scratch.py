import pytest
from pyspark.sql import functions as F

from panelwright import scratch


def test_pinned_tables_live_below_the_checkpoint_folder(spark):
    frame = spark.range(5).withColumn("x", F.col("id") * 2)
    pinned = scratch.pin(frame, "numbers")
    base = spark.conf.get("spark.checkpoint.dir")
    assert all(f.startswith(f"file://{base}/panelwright/") for f in pinned.inputFiles())
    assert pinned.dtypes == frame.dtypes
    assert pinned.exceptAll(frame).count() == 0


def test_a_small_pinned_side_is_broadcast_without_a_hint(spark):
    small = scratch.pin(spark.range(5).withColumnRenamed("id", "k"), "small")
    joined = spark.range(100_000).selectExpr("id % 5 AS k", "id").join(small, "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_a_run_is_released_alone(spark):
    with scratch.Run(spark) as first:
        a = scratch.pin(spark.range(3))
    with scratch.Run(spark) as second:
        b = scratch.pin(spark.range(4))
    c = scratch.pin(spark.range(5))
    first.release()
    with pytest.raises(Exception, match="(?i)not_exist|does not exist|no such"):
        spark.read.parquet(a.inputFiles()[0]).count()
    assert (b.count(), c.count()) == (4, 5)
    second.release()
    assert c.count() == 5


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Session())
