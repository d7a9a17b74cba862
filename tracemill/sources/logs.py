"""Trainer logs: steps, metrics, markers, reward curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import text

# Markers of fatal errors and of warnings at shutdown (fixed values).
FATAL = {
    "called_process_error": ("CalledProcessError",),
    "error_executing_job": ("Error executing job",),
    "cuda_oom": ("CUDA out of memory", "OutOfMemory"),
    "kv_cache_or_model_len": ("ValueError: To serve", "available KV cache memory"),
}
SHUTDOWN = ("DataLoader worker", "Engine core proc", "resource_tracker", "KeyError: '/psm_")
REWARD_DROP = 0.25


def lines(logs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line_no, line) without colour codes; line numbers from 0 inside each log."""
    split = F.split(F.regexp_replace(text.text(body), "\r\n?", "\n"), "\n")
    rows = logs.select(key, F.posexplode(split).alias("line_no", "raw"))
    return rows.select(key, F.col("line_no").cast("long").alias("line_no"), text.strip(F.regexp_replace("raw", "\x1b\\[[0-9;]*m", "")).alias("line"))


def metrics(log_lines: DataFrame, key: str) -> DataFrame:
    """(key, step, metric, value): of a step that is logged again, the last line counts; of a metric that is
    repeated in a line, the last value. Values that are no numbers are left out."""
    pattern = r"\bstep:(\d+)\s+-\s+(.*)"
    steps = log_lines.select(key, "line_no", F.regexp_extract("line", pattern, 1).alias("step"), F.regexp_extract("line", pattern, 2).alias("tail")).where("step != ''")
    last = steps.groupBy(key, F.col("step").cast("long").alias("step")).agg(F.max_by("tail", "line_no").alias("tail"))
    parts = last.select(key, "step", F.posexplode(F.split("tail", " - ")).alias("i", "part")).where(F.col("part").contains(":"))
    value = F.regexp_replace(text.strip(F.regexp_extract("part", "^(.*):([^:]*)$", 2)), ",+$", "")
    rows = parts.select(key, "step", "i", text.strip(F.regexp_extract("part", "^(.*):([^:]*)$", 1)).alias("metric"), value.try_cast("double").alias("value")).where("value is not null")
    return rows.groupBy(key, "step", "metric").agg(F.max_by("value", "i").alias("value"))


def overview(log_lines: DataFrame, key: str) -> DataFrame:
    """One row a log: start, finish, fatal markers, warnings, whether it was completed."""
    has = lambda marks: F.greatest(*[F.col("line").contains(m) for m in marks], F.lit(False))
    stamp = lambda name: F.max_by(F.when(F.col("line").startswith(name + "="), text.strip(F.substring("line", len(name) + 2, 10_000))), F.when(F.col("line").startswith(name + "="), F.col("line_no")))
    fatal = sum((F.count_if(has(m)) for m in FATAL.values()), F.lit(0))
    rows = log_lines.groupBy(key).agg(
        stamp("started_at").alias("started_at"),
        stamp("finished_at").alias("finished_at"),
        F.coalesce(F.max(F.col("line").contains("Training Progress: 100%")), F.lit(False)).alias("progress_100"),
        fatal.cast("long").alias("fatal_marker_count"),
        F.count_if(has(SHUTDOWN)).alias("shutdown_warning_count"),
    )
    done = F.coalesce(F.col("finished_at") != "", F.lit(False)) & F.col("progress_100") & (F.col("fatal_marker_count") == 0)
    return rows.withColumn("completed", done)


def step_kinds(step_metrics: DataFrame, key: str) -> DataFrame:
    """(key, step, is_train, is_validation)."""
    return step_metrics.groupBy(key, "step").agg(F.max(F.col("metric").startswith("critic/") | (F.col("metric") == "training/global_step")).alias("is_train"), F.max(F.col("metric").startswith("val-")).alias("is_validation"))


def reward_curve(step_metrics: DataFrame, key: str) -> DataFrame:
    """(key, step, rewards_mean, score_mean) of the training steps that log one of them."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    rows = step_metrics.groupBy(key, "step").agg(pick("critic/rewards/mean").alias("rewards_mean"), pick("critic/score/mean").alias("score_mean"))
    return rows.where("rewards_mean is not null or score_mean is not null")


def reward_drops(curve: DataFrame, key: str, value: str = "rewards_mean", drop: float = REWARD_DROP) -> DataFrame:
    """Steps whose reward fell by at least ``drop`` against the step before; a step without the reward between
    two others hides the fall."""
    w = Window.partitionBy(key).orderBy("step")
    rows = curve.select(key, "step", F.lag("step").over(w).alias("previous_step"), F.lag(value).over(w).alias("previous"), F.col(value).alias("reward"))
    return rows.withColumn("delta", F.round(F.col("reward") - F.col("previous"), 6)).where(F.col("delta") <= -drop)
