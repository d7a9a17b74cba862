"""Reward variance of a growing dump."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DUMP = "stage string, source_id string, score double"


def read_dump(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream over a folder of appended JSON lines (stage, source_id, score)."""
    return spark.readStream.schema(DUMP).option("maxFilesPerTrigger", files_per_trigger).json(path)


def running_groups(dump: DataFrame) -> DataFrame:
    """(stage, source_id, sample_count, score_min, score_max, score_range) so far; run it in update mode. The
    state is one row a group, however many samples it had."""
    groups = dump.where("source_id is not null and trim(source_id) != ''").groupBy("stage", "source_id")
    return groups.agg(F.count("*").alias("sample_count"), F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.round(F.max("score") - F.min("score"), 6).alias("score_range"))
