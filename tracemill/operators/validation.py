"""Validation ladders of synthetic rows: the first failure names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text

ASCII = r"^[\x00-\x7F]*$"
CHAIN_FIELDS = ("hop1_title", "hop1_sentence_index", "intermediate_entity", "hop2_title", "hop2_sentence_index", "answer_type", "final_answer")
#: The reasons that a chain can be repaired from.
REPAIRABLE = ("intermediate entity missing from hop1", "intermediate entity missing from hop2")


def sentence_at(entries: Column, title: Column, number: Column) -> Column:
    """The sentence of a title (the last entry of that title counts), null where it is missing or blank."""
    found = F.filter(entries, lambda e: (e["title"] == title) & (F.size(e["sentences"]) > number) & (number >= 0))
    s = F.try_element_at(F.transform(found, lambda e: F.get(e["sentences"], number)), F.lit(-1))
    return text.filled(s)


def _evidence(rows: DataFrame) -> DataFrame:
    pairs = F.transform("facts", lambda x: sentence_at(F.col("entries"), x["title"], x["sent"]))
    return rows.withColumn("_ev", pairs).withColumn("_answers", F.transform(F.filter("answers", lambda a: F.length(text.strip(text.text(a))) > 0), lambda a: text.folded(a)))


def _chain(chain: Column) -> Column:
    """First failure of a chain schema, null if there is none."""
    facts, entries, answers = F.col("facts"), F.col("entries"), F.col("_answers")
    blank = [F.when(text.filled(text.text(chain[f])).isNull(), f"chain_schema missing {f}") for f in CHAIN_FIELDS]
    one, two = chain["hop1_sentence_index"].try_cast("int"), chain["hop2_sentence_index"].try_cast("int")
    pair = F.array(F.struct(chain["hop1_title"].alias("title"), one.alias("sent")), F.struct(chain["hop2_title"].alias("title"), two.alias("sent")))
    s1, s2 = text.folded(text.text(sentence_at(entries, chain["hop1_title"], one))), text.folded(text.text(sentence_at(entries, chain["hop2_title"], two)))
    middle = text.folded(chain["intermediate_entity"])
    return F.coalesce(
        F.when(chain.isNull(), "missing chain_schema"),
        *blank,
        F.when(one.isNull() | two.isNull(), "chain_schema sentence indexes must be integers"),
        F.when(F.slice(facts, 1, 2) != pair, "chain_schema does not match supporting_facts"),
        F.when(~s1.contains(middle), REPAIRABLE[0]),
        F.when(~s2.contains(middle), REPAIRABLE[1]),
        F.when(F.exists(answers, lambda a: s1.contains(a)), "final answer leaks in hop1"),
        F.when(~F.array_contains(answers, text.folded(chain["final_answer"])), "chain_schema final_answer does not match answer"),
        F.when(~F.exists(answers, lambda a: s2.contains(a)), "final answer missing from hop2"),
    )


def validate(rows: DataFrame, chain: str | None = None) -> DataFrame:
    """``rows`` (row_id, question, answers, entries, facts) with ``reason``, null for valid rows.

    In this order: id, question, ASCII, answer, context, number and titles of the facts, facts that the context
    lacks, the chain (column ``chain``, if given), answers in the question or as a title, answers in several or
    in none of the supporting sentences.
    """
    one = _evidence(rows)
    q = text.folded(text.text("question"))
    spelled = F.concat_ws("\n", "row_id", "question", F.array_join("answers", "\n"), F.to_json("entries"), F.to_json("facts"))
    titles = F.transform("entries", lambda e: text.folded(text.text(e["title"])))
    nth = F.array_position(F.transform("_ev", lambda s: s.isNull()), True)
    lost = F.try_element_at("facts", nth.cast("int"))
    hits = F.size(F.filter("_ev", lambda s: F.exists("_answers", lambda a: text.folded(s).contains(a))))
    all_evidence = text.folded(F.array_join("_ev", " "))
    sentences = F.exists("entries", lambda e: F.exists(e["sentences"], lambda s: text.filled(s).isNotNull()))
    reason = F.coalesce(
        F.when(text.filled(text.text("row_id")).isNull(), "missing id"),
        F.when(text.filled(text.text("question")).isNull(), "missing question"),
        F.when(~F.regexp_like(spelled, F.lit(r"(?s)" + ASCII)), "non-ascii text detected"),
        F.when(F.size("answers") == 0, "missing answer, answers, or final_answer"),
        F.when(F.size("_answers") == 0, "missing answer text"),
        F.when(~sentences, "context has no sentences"),
        F.when(F.size("facts") < 2, "supporting_facts must contain at least two facts"),
        F.when(F.size(F.array_distinct(F.transform("facts", lambda x: x["title"]))) < 2, "supporting_facts must cover at least two titles"),
        F.when(nth > 0, F.concat(F.lit("supporting fact missing from context: "), lost["title"], F.lit(":"), lost["sent"].cast("string"))),
        _chain(F.col(chain)) if chain else F.lit(None).cast("string"),
        F.when(F.exists("_answers", lambda a: q.contains(a)), "answer appears in question"),
        F.when(F.arrays_overlap("_answers", titles), "answer equals context title"),
        F.when(hits > 1, "answer appears in multiple supporting sentences"),
        F.when(~F.exists("_answers", lambda a: all_evidence.contains(a)), "answer not found in supporting evidence"),
    )
    return one.withColumn("reason", reason).drop("_ev", "_answers")


def repair(rows: DataFrame, chain: str) -> DataFrame:
    """``rows`` with a repaired chain where that makes them valid (the intermediate entity becomes the second
    title), ``repaired`` and the reason before (null if the row was valid)."""
    before = validate(rows, chain).withColumnRenamed("reason", "reason_before")
    c = F.col(chain)
    one, two = text.strip(text.text(c["hop1_title"])), text.strip(text.text(c["hop2_title"]))
    tried = before.withColumn("_old", c).withColumn(chain, F.when(F.col("reason_before").isin(*REPAIRABLE) & (one != "") & (two != "") & (one != two), c.withField("intermediate_entity", two)).otherwise(c))
    after = validate(tried, chain)
    fixed = F.col("reason_before").isin(*REPAIRABLE) & F.col("reason").isNull()
    return after.withColumn("repaired", F.coalesce(fixed, F.lit(False))).withColumn(chain, F.when(F.coalesce(fixed, F.lit(False)), F.col(chain)).otherwise(F.col("_old"))).drop("_old", "reason")
