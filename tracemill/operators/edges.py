"""Edges to models: tasks, generated rows, and generators that are handed in as functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tasks(spark: SparkSession, count: int, topics: Sequence[str], seed: int = 0, start: int = 0) -> DataFrame:
    """(id, topic): syn-<seed + i> for i from ``start``, topics in rotation."""
    if count < 0 or not topics:
        raise ValueError("count must not be negative and topics must not be empty")
    i = spark.range(start, start + count)
    topic = F.element_at(F.array(*[F.lit(t) for t in topics]), (F.col("id") % len(topics) + 1).cast("int"))
    return i.select(F.format_string("syn-%06d", F.col("id") + seed).alias("new"), topic.alias("topic")).withColumnRenamed("new", "id")


def pending(wanted: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Tasks whose id isn't there yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def mock_rows(wanted: DataFrame) -> DataFrame:
    """A deterministic two-hop row for each task, for tests of what follows a generator."""
    slug = F.trim(F.regexp_replace("topic", "[^A-Za-z0-9]+", " "))
    slug = F.when(slug == "", "General Topic").otherwise(slug)
    first, second, answer = F.concat(slug, F.lit(" Researcher")), F.concat(slug, F.lit(" Institute")), F.concat(slug, F.lit(" Archive"))
    third = F.concat(slug, F.lit(" Distractor"))
    entry = lambda title, *texts: F.struct(title.alias("title"), F.array(*texts).alias("sentences"))
    context = F.array(
        entry(first, F.concat(first, F.lit(" collaborated with "), second, F.lit(" during the pilot study."))),
        entry(second, F.concat(second, F.lit(" keeps its experiment notes in "), answer, F.lit(".")), F.concat(second, F.lit(" also maintains an unrelated reading room."))),
        entry(third, F.concat(third, F.lit(" describes an unrelated venue."))),
    )
    fact = lambda title: F.struct(title.alias("title"), F.lit(0).alias("sent_id"))
    return wanted.select("id", "topic", F.concat(F.lit("Which archive stores the institute associated with "), first, F.lit("?")).alias("question"), answer.alias("answer"), context.alias("context"), F.array(fact(first), fact(second)).alias("supporting_facts"))


Generator = Callable[[list[str]], list[str]]


def generate(prompts: DataFrame, generator: Generator, prompt: str = "prompt", batch_size: int = 64) -> DataFrame:
    """``prompts`` with the column generated: the generator is called with lists of at most ``batch_size``
    prompts, inside Arrow batches on the executors."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [p if isinstance(p, str) else "" for p in pdf[prompt]]
            made = [g for i in range(0, len(texts), batch_size) for g in generator(texts[i : i + batch_size])]
            yield pdf.assign(generated=made)

    from pyspark.sql.types import StringType, StructType

    schema = StructType([*prompts.schema.fields]).add("generated", StringType())
    return prompts.mapInPandas(run, schema)


def synthesize_until(spark: SparkSession, target: int, topics: Sequence[str], make: Callable[[DataFrame], DataFrame], validate: Callable[[DataFrame], DataFrame], batch: int = 50, max_attempts: int = 500, seed: int = 0) -> tuple[list[DataFrame], int, int]:
    """Batches of tasks are made and validated (column reason, null for valid rows) until ``target`` rows are
    valid or ``max_attempts`` tasks were tried. Returns the checked batches, valid rows and attempts."""
    if target < 0 or batch < 1 or max_attempts < 1:
        raise ValueError("target must not be negative, batch and max_attempts must be positive")
    from tracemill.session import cut_lineage

    done, valid, parts = 0, 0, []
    while valid < target and done < max_attempts:
        n = min(batch, max_attempts - done, max(target - valid, 1))
        part = cut_lineage(validate(make(tasks(spark, n, topics, seed, done))))
        valid += part.where("reason is null").count()
        done += n
        parts.append(part)
    return parts, valid, done


def probe(requests: DataFrame, generator: Generator, samples: int = 4, batch_size: int = 64) -> DataFrame:
    """``requests`` (request_index, stage, prompt, ground_truth) sampled ``samples`` times and scored.

    Adds sample_index, generated and score: the soft reward of the extracted answer or a flat 1 for a valid
    search, 0.1 for the format, minus 0.03 for a search.
    """
    from tracemill.functions import actions, text

    if samples < 1:
        raise ValueError("samples must be at least 1")
    many = requests.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    made = generate(many, generator, batch_size=batch_size).withColumn("_a", actions.extract_answer(F.col("generated"))).withColumn("_s", actions.parse_agent_action(F.col("generated")))
    soft = text.soft_answer_reward(text.answer_scores(text.text("_a"), F.col("ground_truth")))["answer_reward"]
    answered = F.when(F.col("_a").isNotNull(), soft + 0.1).otherwise(0.0)
    searched = F.when(F.col("_s.type") == "search", 1.1).otherwise(0.0) - 0.03
    return made.withColumn("score", F.round(F.when(F.col("stage") == "search", searched).otherwise(answered), 6)).drop("_a", "_s")


def environment_rollouts(rows: DataFrame, pool: DataFrame, search: Generator, answer: Generator, top_k: int = 2) -> DataFrame:
    """Two generated turns over each row's own pool of passages.

    ``rows``: id, question, gold (ids), answer; ``pool``: id, pos, doc_id, title, text. The first generator gets
    the question; a valid search ranks the pool, whose best passages are the observation that the second
    generator gets after the question. Returns the turns, their actions, the observed ids and final_answer.
    """
    from tracemill.functions import actions, text
    from tracemill.operators import lexical

    first = generate(rows.withColumn("prompt", text.text("question")), search).withColumnRenamed("generated", "search_generated").drop("prompt")
    first = first.withColumn("search_action", actions.parse_agent_action(F.col("search_generated")))
    asked = first.where("search_action.type = 'search'").select("id", F.lit(0).alias("q"), F.col("search_action.query").alias("query"))
    hits = lexical.rank(asked, pool, top_k, "q", F.col("query"), "pos", lexical.passage_text(F.col("title"), F.col("text")), ["id"])
    seen = hits.join(pool, ["id", "pos"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "title", "text"))).alias("o"))
    met = first.join(seen, "id", "left").withColumn("observation", actions.observation_text(F.transform("o", lambda p: F.struct(p["title"].alias("title"), p["text"].alias("text")))))
    met = met.withColumn("observation_doc_ids", F.coalesce(F.transform("o", lambda p: p["doc_id"]), F.array().cast("array<string>"))).drop("o")
    second = generate(met.withColumn("prompt", F.concat_ws("\n", text.text("question"), "observation")), answer).withColumnRenamed("generated", "answer_generated").drop("prompt")
    second = second.withColumn("answer_action", actions.parse_agent_action(F.col("answer_generated")))
    return second.withColumn("final_answer", F.coalesce("answer_action.answer", F.lit("")))
