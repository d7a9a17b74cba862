"""Raw multi-hop rows of any layout, as a shared corpus and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text

ENTRY = "array<struct<title:string,sentences:array<string>>>"


def _sentences(raw: Column) -> Column:
    """Sentences of a context entry: a JSON array, or plain text, which is one sentence; null has none."""
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))


def _entry(raw: Column) -> Column:
    pair = F.from_json(raw, "array<string>")
    fields = F.from_json(raw, "map<string,string>")
    # sentences or text: an empty list or text gives way to the other
    own = F.coalesce(F.nullif(F.nullif(fields["sentences"], F.lit("[]")), F.lit("")), fields["text"])
    return F.when(raw.startswith("["), F.struct(pair[0].alias("title"), _sentences(F.try_element_at(pair, F.lit(2))).alias("sentences"))).otherwise(F.struct(text.strip(text.text(fields["title"])).alias("title"), _sentences(own).alias("sentences")))


def context_entries(raw: Column) -> Column:
    """Context as an array of (title, sentences), in the order it was written: a mapping title -> sentences, or
    a list of pairs or of objects."""
    listed = F.transform(F.from_json(raw, "array<string>"), _entry)
    mapped = F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(e["key"].alias("title"), _sentences(e["value"]).alias("sentences")))
    return F.when(raw.startswith("{"), mapped).otherwise(F.coalesce(listed, F.array().cast(ENTRY)))


def fact_pairs(raw: Column) -> Column:
    """Supporting facts as an array of (title, sentence number); a missing number is 0."""
    def fact(x: Column) -> Column:
        pair, fields = F.from_json(x, "array<string>"), F.from_json(x, "map<string,string>")
        number = F.when(x.startswith("["), F.try_element_at(pair, F.lit(2))).otherwise(F.coalesce(fields["sent_id"], fields["sent_idx"]))
        title = F.when(x.startswith("["), pair[0]).otherwise(fields["title"])
        return F.struct(title.alias("title"), F.coalesce(number.try_cast("int"), F.lit(0)).alias("sent"))

    return F.coalesce(F.transform(F.from_json(raw, "array<string>"), fact), F.array().cast("array<struct<title:string,sent:int>>"))


def normalize(rows: DataFrame, record: str = "record") -> DataFrame:
    """``rows`` with row_id, question, answers, entries and facts of their JSON; broken JSON has no row.

    The row id is ``_id``, then ``id``, then ``uid``; answers come from ``answers``, ``answer`` or
    ``final_answer``, whichever is there first, as a list. All of it inside the JVM.
    """
    parsed = rows.withColumn("_f", F.from_json(record, "map<string,string>")).where(f"_f is not null and try_parse_json({record}) is not null")
    f = F.col("_f")
    given = F.coalesce(f["answers"], f["answer"], f["final_answer"])
    answers = F.when(given.isNull(), F.array().cast("array<string>")).when(given.startswith("["), F.from_json(given, "array<string>")).otherwise(F.array(given))
    ids = F.coalesce(F.nullif(f["_id"], F.lit("")), F.nullif(f["id"], F.lit("")), f["uid"])
    out = parsed.withColumn("row_id", ids).withColumn("question", F.coalesce(f["question"], f["query_text"])).withColumn("answers", answers)
    out = out.withColumn("entries", context_entries(F.ltrim(text.text(f["context"])))).withColumn("facts", fact_pairs(f["supporting_facts"]))
    return out.drop("_f")


def doc_id(prefix: Column, row: Column, title: Column, sentence: Column) -> Column:
    return F.concat_ws("::", prefix, row, title, sentence.cast("string"))


def passages(normal: DataFrame, prefix: Column) -> DataFrame:
    """(row_id, pos, doc_id, title, text): each sentence is a passage, ids are scoped by their row."""
    entries = normal.select("row_id", prefix.alias("prefix"), F.posexplode("entries").alias("i", "e"))
    sentences = entries.select("row_id", "prefix", "i", F.col("e.title").alias("title"), F.posexplode("e.sentences").alias("j", "text"))
    return sentences.select("row_id", (F.col("i") * 1_000_000 + F.col("j")).cast("long").alias("pos"), doc_id(F.col("prefix"), F.col("row_id"), F.col("title"), F.col("j")).alias("doc_id"), "title", "text")


def examples(normal: DataFrame, prefix: Column) -> DataFrame:
    """(id, question, answers, gold_doc_ids, corpus_doc_ids) of the normalized rows."""
    gold = F.transform("facts", lambda x: doc_id(prefix, F.col("row_id"), x["title"], x["sent"]))
    own = F.flatten(F.transform("entries", lambda e: F.transform(e["sentences"], lambda s, j: doc_id(prefix, F.col("row_id"), e["title"], j))))
    return normal.select(F.col("row_id").alias("id"), "question", "answers", gold.alias("gold_doc_ids"), own.alias("corpus_doc_ids"))
