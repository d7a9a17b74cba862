"""Queries and SQL of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import defects, format_copies, grouped_split, leakage, reading_level, split_overlap, tokens, truncation
from tracemill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_pairs(table(spark, d, "qa_examples"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(table(spark, d, "qa_examples"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.copies_found(table(spark, d, "passages"))


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.kept_records(table(spark, d, "passages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = grouped_split.linked_sources(table(spark, d, "transitions"))
    return found.select(F.col("first").alias("first_source"), F.col("other").alias("other_source"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split.assign_splits(table(spark, d, "transitions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defects(table(spark, d, "rollouts_for_grpo"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return defects.defect_counts(table(spark, d, "rollouts_for_grpo"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    scored = truncation.cut_fields(table(spark, d, "rollouts_for_grpo"), table(spark, d, "episode_traces"))
    return scored.where("cut").select("field", "record_id")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(truncation.cut_fields(table(spark, d, "rollouts_for_grpo"), table(spark, d, "episode_traces")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p2_kept": p2_kept, "p3_found": p3_found, "p3_splits": p3_splits, "p4_found": p4_found, "p4_counts": p4_counts, "p6_found": p6_found, "p6_rates": p6_rates, "p8_ids": p8_ids, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found}


_CANON = "regexp_replace(nfc_normalize(lower(coalesce({}, ''))), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g')".format
_COPIES = f"""(SELECT passage_id, min(passage_id) OVER w AS keep, count(*) OVER w AS copies FROM (
    SELECT passage_id, {_CANON("title")} AS t, {_CANON("body")} AS b FROM (
        SELECT passage_id, CASE WHEN raw THEN json_extract_string(j, '$.title') ELSE title END AS title, CASE WHEN raw THEN json_extract_string(j, '$.text') ELSE text END AS body
        FROM (SELECT *, title IS NULL AND text IS NULL AND record IS NOT NULL AS raw, TRY_CAST(record AS JSON) AS j FROM passages)))
    WHERE b <> '' WINDOW w AS (PARTITION BY t, b))"""
_KEYS = "(SELECT DISTINCT lower(trim(source_id)) AS s, lower(trim(question_id)) AS q FROM transitions WHERE trim(source_id) <> '' AND trim(question_id) <> '')"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"SELECT DISTINCT keep AS keep_id, passage_id AS copy_id FROM {_COPIES} WHERE passage_id <> keep",
        "p2_kept": f"SELECT DISTINCT keep AS keep_id, copies FROM {_COPIES}",
        "p3_found": f"""WITH RECURSIVE e AS {_KEYS}, r(s, t) AS (SELECT s, s FROM e UNION SELECT r.s, b.s FROM r JOIN e a ON r.t = a.s JOIN e b ON a.q = b.q)
            SELECT first_source, s AS other_source FROM (SELECT s, min(t) AS first_source FROM r GROUP BY s) WHERE s <> first_source""",
    }
