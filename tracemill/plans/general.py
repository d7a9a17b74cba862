"""Queries of the general operators for training data."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import edges, ingest, shred, validation
from tracemill.plans import nestedsql
from tracemill.session import table
from tracemill.sources import drift


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.resolved_references(table(spark, d, "qa_examples"), table(spark, d, "rollouts_for_grpo"), table(spark, d, "raw_records"))


def p5_corpus(spark: SparkSession, d: str) -> DataFrame:
    nodes = shred.shred_columns(table(spark, d, "qa_examples"), "id", ["corpus"])
    flat = shred.parent_child(nodes, "corpus", ["doc_id", "title", "text"])
    return flat.select(F.col("record").alias("id"), F.col("ordinal").cast("long").alias("child_no"), "doc_id", "title", "text")


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    return shred.shred_columns(table(spark, d, "rollouts_for_grpo"), "rollout_id", ["metadata"])


def p5_metadata(spark: SparkSession, d: str) -> DataFrame:
    flat = shred.parent_child(_metadata(spark, d), "metadata", ["answer", "final_answer", "search_count", "candidate_pool", "reward"])
    kinds = {"search_count": "int", "reward": "double"}
    return flat.select(F.col("record").cast("long").alias("rollout_id"), *[F.col(c).cast(kinds.get(c, "string")) for c in flat.columns[3:]])


def p5_metadata_lists(spark: SparkSession, d: str) -> DataFrame:
    nodes, parts = _metadata(spark, d), []
    for field in ("gold_doc_ids", "retrieved_doc_ids", "candidate_doc_ids", "quality_flags", "quality_notes"):
        parts.append(shred.child_values(nodes, f"metadata.{field}").withColumn("field", F.lit(field)))
    flat = functools.reduce(DataFrame.unionByName, parts)
    return flat.select(F.col("record").cast("long").alias("rollout_id"), "field", F.col("ordinal").cast("long").alias("child_no"), "value")


def p5_candidates(spark: SparkSession, d: str) -> DataFrame:
    flat = shred.parent_child(_metadata(spark, d), "metadata.candidate_passages", ["doc_id", "title", "text"])
    return flat.select(F.col("record").cast("long").alias("rollout_id"), F.col("ordinal").cast("long").alias("child_no"), "doc_id", "title", "text")


def _raw_nodes(spark: SparkSession, d: str) -> DataFrame:
    return shred.shred_json(table(spark, d, "raw_records"), "raw_id", "record", ["context", "supporting_facts"])


def p5_context(spark: SparkSession, d: str) -> DataFrame:
    return shred.context_entries(_raw_nodes(spark, d)).select(F.col("record").cast("long").alias("raw_id"), F.col("child_no").cast("long"), "title", "url_slug")


def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    flat = shred.context_entries(_raw_nodes(spark, d)).select("record", "child_no", F.explode("sentences").alias("s"))
    return flat.select(F.col("record").cast("long").alias("raw_id"), F.col("child_no").cast("long"), F.col("s.sub_no").cast("long"), "s.text")


def p5_facts(spark: SparkSession, d: str) -> DataFrame:
    facts, _ = shred.context_entities(_raw_nodes(spark, d).withColumn("tab", F.lit("raw_records")))
    return facts.select(F.col("record").cast("long").alias("raw_id"), F.col("ref_no").cast("long"), F.col("name").alias("title"), F.col("sub_no").cast("long"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.layout_changes(table(spark, d, "raw_records"))


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "raw_records"))


def _normal(spark: SparkSession, d: str) -> DataFrame:
    return ingest.normalize(table(spark, d, "raw_records").select("raw_id", "source", "record"))


def qa_ingest_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.passages(_normal(spark, d), F.col("source"))
    return rows.groupBy("doc_id").agg(F.min(F.struct("row_id", "pos", "title", "text")).alias("p")).select("doc_id", "p.title", "p.text")


def qa_ingest_examples(spark: SparkSession, d: str) -> DataFrame:
    return ingest.examples(_normal(spark, d), F.col("source")).distinct()


def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    return validation.validate(_normal(spark, d)).select("raw_id", "row_id", F.coalesce("reason", F.lit("valid")).alias("reason"))


def reject_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.split_part("reason", F.lit(":"), F.lit(1))
    return validate_rows(spark, d).groupBy(kind.alias("reason")).agg(F.count("*").alias("n"))


def mock_validation(spark: SparkSession, d: str) -> DataFrame:
    """Generated rows against the ladder: tasks, mock rows (five of six damaged, each in its way), validation."""
    made = edges.mock_rows(edges.tasks(spark, 1_000, ["river locks", "glass lenses", "salt trade"]))
    way = F.substring("id", 5, 6).cast("int") % 6
    facts = F.transform("supporting_facts", lambda x: F.struct(x["title"].alias("title"), x["sent_id"].alias("sent")))
    question = F.when(way == 1, "  ").when(way == 4, F.concat_ws(" ", "question", "answer")).when(way == 5, F.concat("question", F.lit(" ¿"))).otherwise(F.col("question"))
    rows = made.select(
        F.col("id").alias("row_id"), question.alias("question"), F.array(F.when(way == 2, " ").otherwise(F.col("answer"))).alias("answers"),
        F.col("context").alias("entries"), F.when(way == 3, F.array_repeat(facts[0], 2)).otherwise(facts).alias("facts"),
    )
    return validation.validate(rows).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def generated_actions(spark: SparkSession, d: str) -> DataFrame:
    """Prompts through an injected generator (here a stub that searches for the prompt's capitalised words)."""
    prompts = table(spark, d, "rollouts_for_grpo").select("rollout_id", "prompt")
    return edges.generate(prompts, _stub_generator)


def _stub_generator(prompts: list[str]) -> list[str]:
    return ["<search>" + " ".join(w for w in p.split() if w[:1].isupper()) + "</search>" for p in prompts]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p5_found": p5_found, "p5_corpus": p5_corpus, **{f.__name__: f for f in (p5_metadata, p5_metadata_lists, p5_candidates, p5_context, p5_sentences, p5_facts)}, "p7_found": p7_found, "p7_table": p7_table, **{f.__name__: f for f in (qa_ingest_passages, qa_ingest_examples, validate_rows, reject_reason_counts, mock_validation, generated_actions)}}


def oracle_sql() -> dict[str, str]:
    return {
        "mock_validation": nestedsql.MOCK_VALIDATION,
        "p5_found": nestedsql.P5_FOUND,
        "p7_found": nestedsql.P7_FOUND,
        "validate_rows": nestedsql.VALIDATE_ROWS,
        "reject_reason_counts": nestedsql.REJECT_REASON_COUNTS,
        "qa_ingest_passages": nestedsql.QA_INGEST_PASSAGES,
        "qa_ingest_examples": nestedsql.QA_INGEST_EXAMPLES,
        "generated_actions": nestedsql.GENERATED_ACTIONS,
        "p5_corpus": """
            SELECT DISTINCT id, CAST(i - 1 AS BIGINT) AS child_no, corpus[i].doc_id AS doc_id, corpus[i].title AS title, corpus[i].text AS text
            FROM (SELECT id, corpus, unnest(range(1, len(corpus) + 1)) AS i FROM qa_examples WHERE id IS NOT NULL)
            WHERE corpus[i] IS NOT NULL""",
    }
