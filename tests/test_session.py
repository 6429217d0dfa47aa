import os

import pytest
from pyspark.sql import functions as F

from repoloom.session import checkpoint_dir, cut, materialise, once, release, spread


def test_spread_moves_only_what_has_too_few_splits(spark):
    few, many = spark.range(1000).coalesce(1), spark.range(1000).repartition(64)
    assert spread(few, "id").rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in spread(many, "id").collect()) == list(range(1000))
    scan = spark.range(0, 1000, 1, 16)
    assert spread(scan, "id") is scan


def test_spread_runs_nothing(spark):
    grouped = spark.range(100).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    spread(grouped, "k")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before


def test_written_steps_keep_their_rows(spark):
    df = spark.range(10).withColumn("x", F.rand())
    for step in (cut(df), materialise(df, "t")):
        assert step.collect() == step.collect()


def test_columns_named_like_steps_move_nothing(spark):
    scan = spark.range(0, 1000, 1, 16).select(F.col("id").alias("Sort"), F.lit("Join").alias("Window"))
    assert spread(scan, "Sort") is scan
    few = spark.range(0, 10, 1, 1).repartition(2)
    assert spread(few, "id").rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_one_row_for_each_key_and_all_of_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, None), (2, None)], "k bigint, v string")
    assert sorted(map(str, once(df, "k").collect())) == sorted(map(str, [df.collect()[i] for i in (0, 2, 3, 4)]))
    assert once(df, "k", "v").count() == 5


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_written_tables_are_released(spark):
    before = release(spark)
    step = materialise(spark.range(3), "t")
    path = step.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    assert before >= 0 and os.path.isdir(path) and release(spark) == 1 and not os.path.exists(path)
