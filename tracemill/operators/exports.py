"""Rows for supervised and reinforcement trainers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import actions, text

# Prompts of the exports (fixed values).
AGENT_PROMPT = "You are a search agent. Use <think>, <search>, <observation>, and <answer> tags to answer the question with retrieved evidence."
TURN_PROMPT = "You are a search agent for multi-hop QA. Output exactly one action per turn: <search>...</search> or <answer>...</answer>. Never output <observation>; observations are provided by the environment. Do not put <answer> inside <search>. Use only provided observations when answering."
PROBE_PROMPT = "Search-probe mode: output exactly one <search>...</search> action. Do not output <answer>. Use a concise evidence-seeking query with useful entities, relation words, or constraints from the question. Avoid copying a previous obvious query verbatim when another plausible retrieval query is possible."
FIRST_THOUGHT = "<think>I should search for evidence.</think>"
LAST_THOUGHT = "<think>The retrieved evidence supports the answer.</think>"

STAGES = ("search", "answer")


def normalize_stages(stages: str | Sequence[str]) -> tuple[str, ...]:
    """Stage names from a list or a comma-separated text; unknown or no stages are an error."""
    names = tuple(s.strip() for s in (stages.split(",") if isinstance(stages, str) else stages) if s.strip())
    if unknown := sorted(set(names) - set(STAGES)):
        raise ValueError(f"unsupported prompt stages: {unknown}")
    if not names:
        raise ValueError("at least one prompt stage is needed")
    return names


def gold_answer(answers: Column) -> Column:
    """The first answer that isn't blank, as it is; empty if there is none."""
    return F.coalesce(F.try_element_at(F.filter(answers, lambda a: F.length(text.strip(text.text(a))) > 0), F.lit(1)), F.lit(""))


def gold_evidence(gold: Column, corpus: Column) -> Column:
    """Passages of the gold ids, in their order; ids without a passage are left out."""
    found = F.transform(F.coalesce(gold, F.array().cast("array<string>")), lambda g: F.try_element_at(F.filter(corpus, lambda p: p["doc_id"] == g), F.lit(1)))
    return F.filter(found, lambda p: p.isNotNull())


def joined_evidence(examples: DataFrame, index: DataFrame) -> DataFrame:
    """(id, evidence): the same against a shared index (doc_id, title, text), by a join on the document id."""
    asked = examples.select("id", F.posexplode("gold_doc_ids").alias("pos", "doc_id")).where("doc_id is not null")
    met = asked.join(index.select("doc_id", "title", "text"), "doc_id")
    return met.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id", "title", "text"))), lambda p: F.struct(p["doc_id"].alias("doc_id"), p["title"].alias("title"), p["text"].alias("text"))).alias("evidence"))


def answer_in_evidence(answer: Column, evidence: Column) -> Column:
    """Whether the evidence holds the answer; a blank answer is never missing."""
    body = F.array_join(F.transform(evidence, lambda p: text.text(p["text"])), " ")
    return (text.folded(answer) == "") | text.folded(body).contains(text.folded(answer))


def assistant_trace(query: Column, observation: Column, answer: Column) -> Column:
    parts = [F.lit(FIRST_THOUGHT), F.concat(F.lit("<search>"), query, F.lit("</search>")), actions.observation_text(observation), F.lit(LAST_THOUGHT), F.concat(F.lit("<answer>"), answer, F.lit("</answer>"))]
    return F.concat_ws("\n", *parts)


def with_evidence(examples: DataFrame) -> DataFrame:
    """Examples with evidence, gold answer and whether the evidence holds it (those without it are rejects)."""
    one = examples.withColumn("evidence", gold_evidence(F.col("gold_doc_ids"), F.col("corpus"))).withColumn("answer", gold_answer(F.col("answers")))
    return one.withColumn("supported", answer_in_evidence(F.col("answer"), F.col("evidence")))


def warmup_messages(examples: DataFrame) -> Column:
    """Three messages: system, question, whole trace over the gold evidence."""
    question = text.text("question")
    return F.array(actions.message("system", F.lit(AGENT_PROMPT)), actions.message("user", question), actions.message("assistant", assistant_trace(question, F.col("evidence"), F.col("answer"))))


def turn_messages(examples: DataFrame) -> Column:
    """Five messages: system, question, search, observation, answer."""
    question = text.text("question")
    return F.array(
        actions.message("system", F.lit(TURN_PROMPT)),
        actions.message("user", question),
        actions.message("assistant", F.concat(F.lit("<search>"), question, F.lit("</search>"))),
        actions.message("user", actions.observation_text(F.col("evidence"))),
        actions.message("assistant", F.concat(F.lit("<answer>"), F.col("answer"), F.lit("</answer>"))),
    )


def stage_prompts(turns: DataFrame, stages: Sequence[str] = STAGES, messages: str = "messages") -> DataFrame:
    """A row for each stage: the first two messages for search, the first four for answer. Rows with fewer
    than five messages fail."""
    part = {"search": 2, "answer": 4}
    checked = turns.withColumn("_ok", F.assert_true(F.size(messages) >= 5, "a turn row needs at least five messages"))
    options = F.array(*[F.struct(F.lit(s).alias("stage"), F.slice(messages, 1, part[s]).alias("prompt"), F.element_at(messages, part[s] + 1)["content"].alias("expected_action")) for s in normalize_stages(stages)])
    return checked.where("_ok is null").withColumn("s", F.explode(options)).select("*", "s.stage", "s.prompt", "s.expected_action").drop("s", "_ok")


def probe_prompt(messages: Column) -> Column:
    """The prompt with the instruction for search probes: appended to a system message, or before all."""
    first = messages[0]
    extended = F.array(F.struct(first["role"].alias("role"), F.concat(F.rtrim(first["content"]), F.lit("\n\n" + PROBE_PROMPT)).alias("content")))
    rest = F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))
    return F.when(first["role"] == "system", F.concat(extended, rest)).otherwise(F.concat(F.array(actions.message("system", F.lit(PROBE_PROMPT))), messages))


def prefix_split(rows: DataFrame, order: str, n_train: int, n_val: int) -> DataFrame:
    """The first ``n_train`` rows in order as train, the next ``n_val`` as val; too few rows are an error."""
    if (have := rows.count()) < n_train + n_val:
        raise ValueError(f"requested {n_train + n_val} samples but only found {have} rows")
    first = rows.orderBy(order).limit(n_train + n_val)
    border = first.orderBy(order).limit(n_train).agg(F.max(order)).first()[0]
    return first.withColumn("split", F.when(F.col(order) <= F.lit(border), "train").otherwise("val")) if n_train else first.withColumn("split", F.lit("val"))
