"""Environment rollouts: rewards of the two steps, transitions, quality flags, candidate pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import actions, text
from tracemill.session import dense_positions

SEARCH_COST = 0.03


def rollout_parts(rollouts: DataFrame) -> DataFrame:
    """Rollouts with the generated search and answer, their parsed actions, answer scores and evidence."""
    search = F.regexp_extract(text.text("response"), r"(?s)(<search>.*?</search>)", 1)
    answer = F.regexp_extract(text.text("response"), r"(?s)(<answer>.*?</answer>)", 1)
    ids = lambda c: F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))
    rows = rollouts.withColumn("search_generated", search).withColumn("answer_generated", answer)
    rows = rows.withColumn("search_action", actions.parse_agent_action(F.col("search_generated"))).withColumn("answer_action", actions.parse_agent_action(F.col("answer_generated")))
    gold, seen = ids("metadata.gold_doc_ids"), ids("metadata.retrieved_doc_ids")
    recall = F.when(F.size(gold) > 0, F.round(F.size(F.array_intersect(gold, seen)) / F.size(gold), 6)).otherwise(0.0)
    return rows.withColumn("gold_evidence_recall", recall).withColumn("scores", text.answer_scores(F.col("final_answer"), F.col("metadata.answer")))


def reward_records(parts: DataFrame) -> DataFrame:
    """``parts`` with search and answer credit: each is rounded, then summed."""
    searched = F.col("search_action.type") == "search"
    answered = F.col("answer_action.type") == "answer"
    soft = text.soft_answer_reward(F.col("scores"))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    rows = parts.withColumn("soft", soft).withColumn("valid_search_action", searched).withColumn("valid_answer_action", answered)
    rows = rows.withColumn("answer_reward", F.col("soft.answer_reward")).withColumn("answer_reward_type", F.col("soft.answer_reward_type"))
    rows = rows.withColumn("format_reward", flag(searched & answered)).withColumn("tool_validity_reward", flag(searched)).withColumn("search_count", F.when(searched, 1).otherwise(0).cast("long"))
    rows = rows.withColumn("search_cost", F.round(SEARCH_COST * F.col("search_count"), 6))
    rows = rows.withColumn("search_credit", F.round(0.2 * F.col("gold_evidence_recall") + 0.1 * F.col("tool_validity_reward") - F.col("search_cost"), 6))
    rows = rows.withColumn("answer_credit", F.round(F.col("answer_reward") + 0.1 * F.col("format_reward"), 6))
    return rows.withColumn("total", F.round(F.col("search_credit") + F.col("answer_credit"), 6)).drop("soft")


def transitions(records: DataFrame, key: str) -> DataFrame:
    """One row for the search step, and one for the answer step where an answer was generated."""
    has_answer = F.length(text.strip(F.col("answer_generated"))) > 0
    step = lambda i, a, terminal, reward, action: F.struct(F.lit(i).cast("long").alias("step_index"), F.concat_ws(":", F.col(key).cast("string"), F.lit(str(i)), a["type"]).alias("transition_id"), a["type"].alias("action_type"), terminal.alias("terminal"), reward.alias("reward"), action.alias("action"))
    first = step(0, F.col("search_action"), ~has_answer, F.col("search_credit"), F.col("search_generated"))
    second = step(1, F.col("answer_action"), F.lit(True), F.col("answer_credit"), F.col("answer_generated"))
    return records.select(key, F.explode(F.when(has_answer, F.array(first, second)).otherwise(F.array(first))).alias("s")).select(key, "s.*")


def manifest(rows: DataFrame, key: str, flags: Column, notes: Column) -> DataFrame:
    """(key, flags, notes): quality entries with sorted different flags; blank ones are left out."""
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: text.strip(text.text(x))), lambda x: x != "")
    return rows.select(key, F.array_sort(F.array_distinct(clean(flags))).alias("flags"), clean(notes).alias("notes"))


def with_quality(rows: DataFrame, entries: DataFrame, key: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with flags and notes (empty where there is no entry) and whether they are excluded."""
    joined = rows.join(entries, key, "left")
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    out = joined.withColumn("flags", flags).withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))
    return out.withColumn("excluded", F.arrays_overlap("flags", F.array(*map(F.lit, excluded))) if excluded else F.lit(False))


def backfill(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key, passages): the row's own candidate passages, or, where it has none, those that its candidate ids
    name in ``index`` (doc_id, title, text), in order; ids that aren't there are left out."""
    own = F.coalesce(F.size("passages"), F.lit(0)) > 0
    asked = rows.where(~own).select(key, F.posexplode("doc_ids").alias("pos", "doc_id")).where("doc_id is not null")
    met = asked.join(index, "doc_id").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id", "title", "text"))), lambda p: F.struct(p["doc_id"].alias("doc_id"), p["title"].alias("title"), p["text"].alias("text"))).alias("found"))
    return rows.join(met, key, "left").select(key, F.when(own, F.col("passages")).otherwise(F.col("found")).alias("passages"))


def candidate_pool(rows: DataFrame, corpus: DataFrame, count: int) -> DataFrame:
    """(id, place, doc_id, gold): the gold passages of a row in their order, then ``count`` distractors.

    ``rows``: id, gold (array of ids); ``corpus``: doc_id in the order of ``pos``. Distractors are the passages
    that aren't gold, from the place given by the code points of the id on, going round. Every row asks for
    exactly its places, by a join on the position; the corpus is never multiplied by the rows.
    """
    ids = dense_positions(corpus, "pos", "p").select("doc_id", "p")
    n = ids.agg(F.count("*").alias("n"))
    asked = rows.select("id", F.posexplode("gold").alias("place", "doc_id")).join(ids, "doc_id")
    own = asked.groupBy("id").agg(F.array_sort(F.collect_set("p")).alias("taken"))
    start = F.aggregate(F.transform(F.split("id", ""), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a + x)
    based = rows.select("id", start.alias("s")).join(own, "id", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<bigint>"))).crossJoin(F.broadcast(n))
    based = based.withColumn("m", F.col("n") - F.size("taken")).where("m > 0")
    j = based.select("id", "taken", "s", "m", F.explode(F.sequence(F.lit(0), F.least(F.lit(count), F.col("m").cast("int")) - 1)).alias("i"))
    # the j-th passage that isn't gold stands behind the gold ones at or before it
    at = F.aggregate("taken", F.pmod(F.col("s") + F.col("i"), F.col("m")).cast("long"), lambda acc, g: F.when(g <= acc, acc + 1).otherwise(acc))
    far = j.select("id", "i", at.alias("p")).join(ids, "p").select("id", (F.lit(1_000_000) + F.col("i")).alias("place"), "doc_id", F.lit(False).alias("gold"))
    return asked.select("id", "place", "doc_id", F.lit(True).alias("gold")).unionByName(far)
