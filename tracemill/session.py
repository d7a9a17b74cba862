"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracemill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """Keep the shared folder the cluster names in spark.checkpoint.dir; only where none is set (local
    mode, tests) take a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracemill-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder and read from there."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by a hash of ``key``, or all where there are fewer. A hash threshold comes before
    the order, so that no task sends more than about its share of ``n`` rows."""
    count = df.count()
    h = F.xxhash64(F.col(key).cast("string"))
    if count > 2 * n:
        df = df.where(F.pmod(h, F.lit(1_000_000)) < int(1_000_000 * 1.5 * n / count) + 1)
    return df.orderBy(h, key).limit(n)


def dense_positions(df: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """``df`` with dense positions from 0 in the order of a unique column, without one task for all rows:
    ranges are sorted and counted, and each range starts where those before it end."""
    ranged = cut_lineage(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    starts = counts.withColumn("_start", F.sum("n").over(Window.orderBy("_part")) - F.col("n")).select("_part", "_start")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.withColumn("_in", inside).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_start", "_in")
