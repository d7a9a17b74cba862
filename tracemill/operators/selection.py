"""Selection of training rows: reward variance, candidate dedup, preference pairs, caps and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import cut_lineage


def variable_groups(dump: DataFrame, stages: Sequence[str] = (), min_range: float = 1e-9, min_samples: int = 2) -> DataFrame:
    """(stage, source_id, sample_count, score_min, score_max, score_range) of the groups whose raw range is
    strictly above ``min_range``. Blank sources take no part; partial minima and maxima meet, not rows."""
    rows = dump.where(F.coalesce(F.length(F.trim("source_id")), F.lit(0)) > 0)
    if stages:
        rows = rows.where(F.col("stage").isin(*stages))
    groups = rows.groupBy("stage", "source_id").agg(F.count("*").alias("sample_count"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    kept = groups.where((F.col("sample_count") >= min_samples) & (F.col("hi") - F.col("lo") > min_range))
    return kept.select("stage", "source_id", "sample_count", F.round("lo", 6).alias("score_min"), F.round("hi", 6).alias("score_max"), F.round(F.col("hi") - F.col("lo"), 6).alias("score_range"))


def ranked_sources(groups: DataFrame, n: int | None = None) -> DataFrame:
    """(source_id, score_range, stage): sources in the order of their best group, the first ``n`` if given."""
    best = groups.groupBy("source_id").agg(F.min(F.struct((-F.col("score_range")).alias("k"), "stage")).alias("b"))
    rows = best.select("source_id", (-F.col("b.k")).alias("score_range"), F.col("b.stage").alias("stage"))
    return rows if n is None else rows.orderBy(F.desc("score_range"), "stage", "source_id").limit(n)


def keep_sources(transitions: DataFrame, sources: DataFrame, source: str = "source_id") -> DataFrame:
    return transitions.join(sources.select(source).distinct(), source, "left_semi")


def group_score_variance(dump: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, group_count, variable_group_count, variable_group_rate, avg_score_range) over the sources with
    more than one sample; here the rounded range decides."""
    groups = dump.where(F.coalesce(F.length(F.trim("source_id")), F.lit(0)) > 0).groupBy(*by, "source_id").agg(F.count("*").alias("n"), F.round(F.max("score") - F.min("score"), 6).alias("r")).where("n > 1")
    variable = F.count_if(F.col("r") > 1e-9)
    return groups.groupBy(*by).agg(F.count("*").alias("group_count"), variable.alias("variable_group_count"), F.coalesce(F.round(variable / F.count("*"), 6), F.lit(0.0)).alias("variable_group_rate"), F.coalesce(F.round(F.avg("r"), 6), F.lit(0.0)).alias("avg_score_range"))


def attach_rewards(generations: DataFrame, dump: DataFrame) -> DataFrame:
    """Generations with the score of the reward dump where its four-part key is there (the last row of a key
    counts, by pos), else with their own."""
    last = dump.groupBy("request_index", "sample_index", "id", "stage").agg(F.max_by("score", "pos").alias("dumped"))
    joined = generations.join(last, ["request_index", "sample_index", "id", "stage"], "left")
    return joined.withColumn("score", F.round(F.coalesce("dumped", "score", F.lit(0.0)), 6)).drop("dumped")


def best_per_action(generations: DataFrame, key: Sequence[str] = ("request_index",)) -> DataFrame:
    """Of the generations of a group that do the same, the one with the highest score, then the smallest
    sample index. A struct minimum, so that copies fold before the shuffle."""
    rest = [c for c in generations.columns if c not in {*key, "action_key", "score", "sample_index"}]
    best = generations.groupBy(*key, "action_key").agg(F.min(F.struct((-F.col("score")).alias("k"), "sample_index", *rest)).alias("b"))
    return best.select(*key, "action_key", (-F.col("b.k")).alias("score"), "b.sample_index", *[F.col("b." + c).alias(c) for c in rest])


def pairs(candidates: DataFrame, min_gap: float, per_group: int, min_samples: int = 2, key: str = "request_index") -> DataFrame:
    """(key, chosen struct c, rejected struct r, score_gap, place): the best pairs of each group.

    Pairs are ordered by gap, chosen score (both falling), rejected score and sample indexes. A pair among the
    first n can only join one of the n + 1 best with one of the n + 1 worst candidates of its group, so only
    these meet: a group of a third of all rows emits (n + 1) squared pairs, not all. The ranks keep n + 1 rows
    a task and group before anything is shuffled.
    """
    values = [c for c in candidates.columns if c != key]
    n = per_group + 1
    part = Window.partitionBy(key)
    up = F.row_number().over(part.orderBy(F.desc("score"), "sample_index"))
    down = F.row_number().over(part.orderBy("score", "sample_index"))
    enough = candidates.groupBy(key).count().where(F.col("count") >= min_samples).select(key)
    best = candidates.withColumn("_n", up).where(F.col("_n") <= n).select(key, F.struct(*values).alias("c"))
    worst = candidates.withColumn("_n", down).where(F.col("_n") <= n).select(key, F.struct(*values).alias("r"))
    met = best.join(enough, key).join(worst, key).where("c.sample_index != r.sample_index")
    met = met.withColumn("score_gap", F.round(F.col("c.score") - F.col("r.score"), 6)).where(F.col("score_gap") >= min_gap)
    order = [F.desc("score_gap"), F.desc("c.score"), F.col("r.score"), F.col("c.sample_index"), F.col("r.sample_index")]
    return met.withColumn("place", F.row_number().over(part.orderBy(*order)).cast("long")).where(F.col("place") <= per_group)


def pair_category(chosen_type: Column, rejected_type: Column) -> Column:
    return F.concat(chosen_type, F.lit("_vs_"), rejected_type)


def stage_caps(rows: DataFrame, caps: dict[str, int], order: Sequence[str], stage: str = "stage") -> DataFrame:
    """The first rows of each capped stage in the given order; other stages whole and without a window."""
    if not caps:
        return rows
    capped = rows.where(F.col(stage).isin(*caps))
    limit = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col(stage)]
    w = Window.partitionBy(stage).orderBy(*order)
    most = max(caps.values())
    first = capped.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).where(F.col("_n") <= limit).drop("_n")
    return rows.where(~F.coalesce(F.col(stage).isin(*caps), F.lit(False))).unionByName(first)


def hash_split(rows: DataFrame, key: str, fraction: float, seed: int = 0, most: int = 100_000) -> DataFrame:
    """``rows`` with is_val: rint(n * fraction) of the n distinct keys (fewer than all), those first by md5(seed, key);
    all rows of a key are on one side, null keys in none of the counts and never in validation.

    The driver counts starts of the hash (4096 a round) and goes on below the start at the border, three more digits a
    round, until at most ``most`` keys share it; only those are ranked.
    """
    digest = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    keys = cut_lineage(digest.where("_h is not null").select("_h", F.col(key).cast("string").alias("_k")).distinct())
    count = keys.count()
    left = min(max(count - 1, 0), round(count * fraction))
    border, inside = "", count
    while inside > most and len(border) < 32:
        at = F.substring("_h", 1, len(border) + 3)
        counts = sorted((r["p"], r["count"]) for r in keys.where(F.col("_h").startswith(border)).groupBy(at.alias("p")).count().collect())
        for border, inside in counts:
            if inside > left:
                break
            left -= inside
    ranked = keys.where(F.col("_h").startswith(border)).orderBy("_h", "_k").limit(left + 1).collect()
    # the first key that isn't in validation; all before it are
    end = (ranked[left]["_h"], ranked[left]["_k"]) if len(ranked) > left else ("~", "")
    before = (F.col("_h") < end[0]) | ((F.col("_h") == end[0]) & (F.col(key).cast("string") < end[1]))
    return digest.withColumn("is_val", F.coalesce(before, F.lit(False))).drop("_h")
