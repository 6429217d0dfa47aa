"""Session, table access and lineage helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "repoloom", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``; a folder of our own is set only where that setting is absent,
    which is the case in local tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = sc.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "repoloom-checkpoint")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of an iterative plan with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate once to the shared folder and read it back, so that several consumers share one pass."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.parquet(path)


#: Tables that :func:`materialise` has written in this process.
_written: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the tables that this process has materialised; results that still read them can no longer be computed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_written)
    while _written:
        folder = jvm.org.apache.hadoop.fs.Path(_written.pop())
        folder.getFileSystem(conf).delete(folder, True)
    return n


#: Steps of a logical plan that move rows between partitions.
_MOVES = frozenset("Aggregate Join Repartition RepartitionByExpression RebalancePartitions Window WindowGroupLimit Sort Distinct Deduplicate Intersect Except GlobalLimit CoGroup FlatMapGroupsInPandas FlatMapGroupsInArrow FlatMapCoGroupsInPandas FlatMapCoGroupsInArrow".split())
#: Bytes that adaptive execution gives a partition by default.
_PARTITION_BYTES = 64 << 20


def _moves(plan) -> bool:  # noqa: ANN001 - a logical plan of the JVM
    """Whether a plan has a step that moves rows, by the kinds of its nodes."""
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() in _MOVES:
            return True
        below = node.children()
        todo += [below.apply(i) for i in range(below.size())]
    return False


def spread(df: DataFrame, *keys: str, per_core: int = 2) -> DataFrame:
    """Give a CPU-bound step enough tasks, without running anything to find out.

    A scan that already has as many splits as the cluster has cores is left alone, and so is a plan with a shuffle whose
    estimated size fills that many partitions: at scale nothing is moved. What is smaller is hash-partitioned over
    ``keys``.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if _moves(plan):  # asking such a plan for its partitions would execute its shuffles
        enough = int(str(plan.stats().sizeInBytes())) >= want * _PARTITION_BYTES
    else:
        enough = df.rdd.getNumPartitions() >= want
    return df if enough else df.repartition(want * per_core, *keys)


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key; rows of which a part of the key is null are no duplicates of each other and all stay."""
    unknown = F.lit(False)
    for key in keys:
        unknown = unknown | F.col(key).isNull()
    marked = df.withColumn("_apart", F.when(unknown, F.monotonically_increasing_id()))
    return marked.dropDuplicates([*keys, "_apart"]).drop("_apart")


def numbered(df: DataFrame, group: str, *order: str, out: str = "position") -> DataFrame:
    """Number the rows of each group from 0 in an order, without a window over a whole group.

    Rows are sorted by range partitions and written once with their number inside the partition; the sizes of the
    partitions (one row each) give the offsets, and the first number of each group is taken off.
    """
    n = max(2, df.sparkSession.sparkContext.defaultParallelism)
    low = (1 << 33) - 1
    ranged = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_id", F.monotonically_increasing_id())
    kept = materialise(ranged, "numbered")
    sizes = kept.groupBy(F.shiftright("_id", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    offsets, total = {}, 0
    for row in sizes:
        offsets[row.p], total = total, total + row.n
    if not offsets:
        return kept.withColumn(out, F.col("_id")).drop("_id")
    table_ = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    placed = kept.withColumn("_at", table_[F.shiftright("_id", 33)] + F.col("_id").bitwiseAND(F.lit(low)))
    first = placed.groupBy(group).agg(F.min("_at").alias("_first"))
    return placed.join(first, group).withColumn(out, F.col("_at") - F.col("_first")).drop("_id", "_at", "_first")
