"""Summaries: batches, roll-ups, answers, generations, policies and tensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import actions, text

# Words of a question that tell the kind of answer it asks for, the first kind that fits (fixed values).
KEYWORDS = {
    "institute": ("institute", "center", "centre", "lab", "laboratory"),
    "journal": ("journal",),
    "university": ("university", "college"),
    "award": ("award", "prize", "medal"),
}


def batches(rows: DataFrame, value: str, size: int, low: float) -> DataFrame:
    """Contiguous batches of rows with dense positions ``pos``: range, count, summary and low rows."""
    if size <= 0:
        raise ValueError("the batch size must be positive")
    v = F.col(value)
    grouped = rows.groupBy(F.floor(F.col("pos") / size).cast("long").alias("batch_index"))
    return grouped.agg(F.min("pos").alias("row_start"), (F.max("pos") + 1).alias("row_end_exclusive"), F.count("*").alias("n_rows"), F.round(F.min(v), 6).alias("min_reward"), F.round(F.max(v), 6).alias("max_reward"), F.round(F.avg(v), 6).alias("mean_reward"), F.count_if(v < low).alias("low_rows"))


def align_steps(steps: DataFrame, batch_rows: DataFrame) -> DataFrame:
    """Each step with its batch: batch (step - 1) modulo the number of batches."""
    n = batch_rows.agg(F.count("*").alias("n"))
    keyed = steps.crossJoin(F.broadcast(n)).where("n > 0").withColumn("batch_index", F.pmod(F.col("step") - 1, F.col("n")).cast("long"))
    return keyed.drop("n").join(batch_rows, "batch_index")


def rollup_summary(rows: DataFrame, by: str, value: str, low: float) -> DataFrame:
    """Count, low rows, least, greatest and mean value by group and over all (group ``overall``)."""
    v = F.col(value)
    made = rows.rollup(by).agg(F.count("*").alias("n_rows"), F.count_if(v < low).alias("low_rows"), F.round(F.min(v), 6).alias("min_score"), F.round(F.max(v), 6).alias("max_score"), F.round(F.avg(v), 6).alias("mean_score"))
    return made.withColumn(by, F.coalesce(by, F.lit("overall")))


def expected_type(question: Column) -> Column:
    tokens = text.answer_tokens(question)
    out = F.lit(None).cast("string")
    for kind, words in reversed(KEYWORDS.items()):
        out = F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), kind).otherwise(out)
    return out


def fits_type(answer: Column, kind: Column) -> Column:
    tokens = text.answer_tokens(answer)
    out = F.lit(False)
    for name, words in KEYWORDS.items():
        out = F.when(kind == name, F.arrays_overlap(tokens, F.array(*map(F.lit, words)))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def answer_diagnostics(rows: DataFrame) -> DataFrame:
    """``rows`` (question, prediction, gold, titles) with exact_match, expected_answer_type and the reasons
    for which a wrong answer is suspicious: it is a title it was shown, or the gold answer misses the kind
    that the question asks for while the prediction has it."""
    one = rows.withColumn("exact_match", text.answer_scores(F.col("prediction"), F.col("gold"))["exact_match"]).withColumn("expected_answer_type", expected_type(F.col("question")))
    wrong = ~F.col("exact_match")
    titled = F.array_contains(F.transform("titles", lambda t: text.normalize_answer(t)), text.normalize_answer(F.col("prediction")))
    kind = F.col("expected_answer_type")
    mismatch = wrong & kind.isin("institute", "journal", "university") & ~fits_type(F.col("gold"), kind) & fits_type(F.col("prediction"), kind)
    reasons = F.array(F.when(wrong & titled, "prediction_matches_observation_title"), F.when(F.coalesce(mismatch, F.lit(False)), "question_gold_type_mismatch"))
    return one.withColumn("reasons", F.array_compact(reasons))


def generation_summary(rows: DataFrame) -> DataFrame:
    """Rates over all generations (mode ``overall``) and by mode; ``rows``: mode, generated, gold, new_tokens."""
    g = F.col("generated")
    one = rows.withColumn("a", actions.parse_agent_action(g))
    gold = F.lower(text.strip(F.col("gold")))
    cols = [
        F.count("*").alias("examples"),
        text.rate(g.contains("<search>") & g.contains("</search>")).alias("search_tag_rate"),
        text.rate(g.contains("<answer>") & g.contains("</answer>")).alias("answer_tag_rate"),
        text.rate(g.contains("<observation>") | g.contains("</observation>")).alias("observation_tag_rate"),
        text.rate(F.col("a.valid")).alias("single_action_rate"),
        text.rate(F.col("a.type") == "answer").alias("valid_answer_action_rate"),
        text.rate((gold != "") & F.lower(g).contains(gold)).alias("gold_answer_mention_rate"),
        text.average(F.col("new_tokens")).alias("avg_new_tokens"),
    ]
    made = one.rollup("mode").agg(*cols).where("mode is null or mode != ''")
    return made.withColumn("mode", F.coalesce("mode", F.lit("overall")))


def compare_logprobs(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """By stage: mean change of the log probability, how many rows rose, fell and stayed, means per token."""
    met = base.alias("b").join(candidate.alias("c"), ["id", "stage"])
    b, c = F.col("b.total"), F.col("c.total")
    return met.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg(F.round(c - b, 6)), 6).alias("mean_delta"), F.count_if(c > b).alias("improved"), F.count_if(c < b).alias("regressed"), F.count_if(c == b).alias("unchanged"), F.round(F.sum(b) / F.sum("b.tokens"), 6).alias("base_mean"), F.round(F.sum(c) / F.sum("c.tokens"), 6).alias("candidate_mean"))


def compare_policies(base: DataFrame, candidate: DataFrame) -> DataFrame:
    met = base.alias("b").join(candidate.alias("c"), "id")
    b, c = F.col("b.exact_match"), F.col("c.exact_match")
    one = lambda x: F.when(x, 1.0).otherwise(0.0)
    return met.agg(F.count("*").alias("n"), F.round(F.avg(one(c)) - F.avg(one(b)), 6).alias("exact_match_delta"), F.round(F.avg("c.score") - F.avg("b.score"), 6).alias("score_delta"), F.count_if(c != b).alias("changed"), F.count_if(c & ~b).alias("improved"), F.count_if(b & ~c).alias("regressed"))


def tensor_diff(base: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Per tensor of both sides: L2 and relative L2 distance, greatest and mean change, changed values. Tensors
    of different lengths fail."""
    met = base.alias("b").join(candidate.select(key, F.col("values").alias("other")), key)
    checked = met.withColumn("_ok", F.assert_true(F.size("values") == F.size("other"), "tensor shapes differ")).where("_ok is null")
    d = F.zip_with("values", "other", lambda x, y: y - x)
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, z: acc + f(z))
    rows = checked.withColumn("d", d).select(key, F.sqrt(total(F.col("d"), lambda z: z * z)).alias("l2"), F.sqrt(total(F.col("values"), lambda z: z * z)).alias("norm"), F.array_max(F.transform("d", F.abs)).alias("mx"), (total(F.col("d"), F.abs) / F.size("d")).alias("mean"), F.size(F.filter("d", lambda z: z != 0)).cast("long").alias("changed"))
    return rows.select(key, F.round("l2", 6).alias("l2"), F.round(F.when(F.col("norm") > 0, F.col("l2") / F.col("norm")).otherwise(0.0), 6).alias("relative_l2"), F.round("mx", 6).alias("max_abs"), F.round("mean", 6).alias("mean_abs"), "changed")


def only_one_side(base: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: missing from the candidate, or extra in it."""
    met = base.select(F.col(key).alias("x")).join(candidate.select(F.col(key).alias("y")), F.col("x") == F.col("y"), "full_outer").where("x is null or y is null")
    return met.select(F.coalesce("x", "y").alias(key), F.when(F.col("y").isNull(), "missing").otherwise("extra").alias("side"))
