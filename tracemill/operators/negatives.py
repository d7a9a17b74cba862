"""Synthetic search negatives: corrupted queries, scored against the row's own passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import lexical
from tracemill.session import cut_lineage

# Corruptions in the order in which they are tried, and the query that fits anything (fixed values).
KINDS = ("generic", "distractor_title", "gold_title_only", "gold_title_only", "answer_only", "entity_dropout", "relation_dropout", "question_keywords")
GENERIC = "related evidence"


def drop_phrase(query: Column, phrases: Column) -> Column:
    """The query without the longest phrase that it holds, in any case (each time it stands there); without
    its last two words if it holds none and has more than two."""
    ranked = F.array_sort(F.transform(F.filter(phrases, lambda p: text.text(p) != ""), lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p"))))
    plain = text.plain(query)
    shorter = F.aggregate(ranked, query, lambda acc, x: F.when(text.plain(acc) != plain, acc).otherwise(F.regexp_replace(acc, F.concat(F.lit("(?i)\\Q"), F.replace(x["p"], F.lit("\\E"), F.lit("")), F.lit("\\E")), F.lit(" "))))
    words = F.split(text.squeeze(query), " ")
    fallback = F.when(F.size(words) > 2, F.array_join(F.slice(words, F.lit(1), F.size(words) - 2), " ")).otherwise(query)
    return text.squeeze(F.when(text.plain(shorter) != plain, shorter).otherwise(fallback))


def entity_like(query: Column) -> Column:
    """Capitalised, numeric and long words; the first half of all words if these are fewer than two."""
    words = text.words(query)
    kept = F.filter(words, lambda w: F.regexp_like(w, F.lit("^[A-Z]")) | F.regexp_like(w, F.lit("^[0-9]+$")) | (F.length(w) > 8))
    half = F.slice(words, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int")))
    return F.when(F.size(kept) >= 2, F.array_join(kept, " ")).otherwise(F.array_join(half, " "))


def question_keywords(question: Column) -> Column:
    return F.array_join(F.slice(F.filter(text.words(question), lambda w: ~F.lower(w).isin(*text.QUESTION_STOP)), 1, 4), " ")


def negative_queries(rows: DataFrame) -> DataFrame:
    """(id, candidate_index, corruption_type, query) with the chosen query as candidate 0.

    ``rows``: id, query, question, answer, gold (ids), passages. A corruption that equals the chosen query, an
    earlier one or nothing is left out; the others are numbered from 1 in their order.
    """
    is_gold = lambda p: F.coalesce(F.array_contains("gold", p["doc_id"]), F.lit(False))
    titled = lambda p: F.length(text.strip(text.text(p["title"]))) > 0
    titles = F.transform(F.filter("passages", lambda p: is_gold(p) & titled(p)), lambda p: text.strip(p["title"]))
    other = F.try_element_at(F.transform(F.filter("passages", lambda p: ~is_gold(p) & titled(p)), lambda p: text.strip(p["title"])), F.lit(1))
    rows = rows.withColumn("query", text.squeeze(text.text("query"))).withColumn("answer", text.strip(text.text("answer"))).withColumn("titles", titles).withColumn("other", F.coalesce(other, F.lit("")))
    nth = lambda i: F.coalesce(F.try_element_at("titles", F.lit(i)), F.lit(""))
    made = [F.lit(GENERIC), F.col("other"), nth(1), nth(2), F.col("answer"), drop_phrase(F.col("query"), F.concat("titles", F.array("answer"))), entity_like(F.col("query")), question_keywords(text.text("question"))]
    tried = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(k).alias("corruption_type"), m.alias("query")) for i, (k, m) in enumerate(zip(KINDS, made))])
    # each text is made and compared in one form only, as columns of their own: lambdas would redo them
    rows = rows.withColumn("_tried", tried).withColumn("_plain", text.plain(F.col("query")))
    rows = rows.withColumn("_fresh", F.transform("_tried", lambda t: F.struct(t["i"].alias("i"), t["corruption_type"].alias("corruption_type"), text.squeeze(t["query"]).alias("query"), text.plain(t["query"]).alias("p"))))
    rows = rows.withColumn("_fresh", F.filter("_fresh", lambda t: (t["p"] != "") & (t["p"] != F.col("_plain"))))
    # first wins: a try is kept if no earlier one reads the same
    first = F.filter("_fresh", lambda t: ~F.exists("_fresh", lambda u: (u["i"] < t["i"]) & (u["p"] == t["p"])))
    first = F.transform(first, lambda t: F.struct(t["i"].alias("i"), t["corruption_type"].alias("corruption_type"), t["query"].alias("query")))
    chosen = F.array(F.struct(F.lit(0).alias("i"), F.lit("chosen").alias("corruption_type"), F.col("query").alias("query")))
    out = rows.where("query != ''").select("id", F.posexplode(F.concat(chosen, first)).alias("candidate_index", "c"))
    return out.select("id", "candidate_index", "c.corruption_type", "c.query")


def scored_candidates(rows: DataFrame, top_k: int = 8) -> DataFrame:
    """Candidates with their search-stage score: mean rank reward of the different gold ids among the row's
    own passages, 0.1 for a valid action, minus 0.03. Rows without passages or gold ids score a flat 1."""
    candidates = cut_lineage(negative_queries(rows))  # used to ask and to keep those that found nothing
    pool = rows.select("id", F.posexplode("passages").alias("pos", "p")).where("p.doc_id is not null").select("id", "pos", F.col("p.doc_id").alias("doc_id"), lexical.passage_text(F.col("p.title"), F.col("p.text")).alias("body"))
    hits = lexical.rank(candidates, pool, top_k, "candidate_index", F.col("query"), "pos", F.col("body"), ["id"]).join(pool.select("id", "pos", "doc_id"), ["id", "pos"])
    gold = rows.select("id", F.explode(F.array_distinct("gold")).alias("doc_id")).where("doc_id is not null")
    n_gold = gold.groupBy("id").agg(F.count("*").alias("n_gold"))
    best = hits.groupBy("id", "candidate_index", "doc_id").agg(F.max("rank").alias("rank")).join(gold, ["id", "doc_id"])
    got = best.groupBy("id", "candidate_index").agg(F.sum(lexical.rank_reward(F.col("rank"))).alias("got"))
    has_pool = pool.select("id").distinct().withColumn("pooled", F.lit(True))
    joined = candidates.join(n_gold, "id", "left").join(has_pool, "id", "left").join(got, ["id", "candidate_index"], "left")
    ranked = F.col("n_gold").isNotNull() & F.col("pooled").isNotNull()
    reward = F.when(ranked, F.round(F.coalesce("got", F.lit(0.0)) / F.col("n_gold"), 6)).otherwise(1.0)
    return joined.select("id", "candidate_index", "corruption_type", "query", F.round(reward + 0.1 - 0.03, 6).alias("score"))


def negative_pairs(rows: DataFrame, min_chosen: float = 0.5, min_gap: float = 0.05, per_row: int = 4, top_k: int = 8) -> DataFrame:
    """(id, candidate_index, corruption_type, rejected_query, chosen_score, rejected_score, score_gap): up to
    ``per_row`` negatives of each row whose chosen query scores enough."""
    scored = cut_lineage(scored_candidates(rows, top_k))
    chosen = scored.where("candidate_index = 0 and score >= %r" % min_chosen).select("id", F.col("score").alias("chosen_score"))
    met = scored.where("candidate_index > 0").join(chosen, "id").withColumn("score_gap", F.round(F.col("chosen_score") - F.col("score"), 6)).where(F.col("score_gap") >= min_gap)
    w = Window.partitionBy("id").orderBy(F.desc("score_gap"), "score", "corruption_type", "candidate_index")
    kept = met.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_row)
    return kept.select("id", F.col("candidate_index").cast("long").alias("candidate_index"), "corruption_type", F.col("query").alias("rejected_query"), "chosen_score", F.col("score").alias("rejected_score"), "score_gap")
