"""Queries on environment rollouts, negatives, logs, batches and comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import actions, text
from tracemill.operators import environment, negatives, report
from tracemill.plans import sqltext as q
from tracemill.plans.retrieval import _FIRST_QA, _examples
from tracemill.session import dense_positions, table
from tracemill.sources import logs

BATCH, LOW = 32, 0.5


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return environment.reward_records(environment.rollout_parts(table(spark, d, "rollouts_for_grpo")))


def env_reward_records(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select("rollout_id", "answer_reward", "answer_reward_type", F.col("gold_evidence_recall").alias("evidence_reward"), "format_reward", "tool_validity_reward", "search_count", "search_cost", "search_credit", "answer_credit", "total")


def env_transitions(spark: SparkSession, d: str) -> DataFrame:
    return environment.transitions(_parts(spark, d), "rollout_id")


def _quality(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rollouts_for_grpo")
    entries = environment.manifest(rows.where("metadata.quality_flags is not null"), "rollout_id", F.col("metadata.quality_flags"), F.col("metadata.quality_notes"))
    return environment.with_quality(_parts(spark, d), entries, "rollout_id", ("weak_evidence",))


def env_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _quality(spark, d)
    keep = lambda c: F.when(~F.col("excluded"), c)
    mean = lambda c, n: F.coalesce(F.round(F.avg(keep(F.col(c))), 6), F.lit(0.0)).alias(n)
    share = lambda c, n: F.coalesce(F.round(F.avg(keep(F.when(F.coalesce(F.col(c), F.lit(False)), 1.0).otherwise(0.0))), 6), F.lit(0.0)).alias(n)
    return rows.agg(
        F.count("*").alias("input_examples"),
        F.count_if(F.col("excluded")).alias("excluded_examples"),
        mean("total", "avg_total_reward"),
        mean("search_credit", "avg_search_credit"),
        mean("answer_credit", "avg_answer_credit"),
        share("valid_search_action", "valid_search_action_rate"),
        share("valid_answer_action", "valid_answer_action_rate"),
        share("scores.exact_match", "answer_exact_match_rate"),
        share("scores.containment_match", "answer_containment_match_rate"),
        mean("scores.token_f1", "answer_token_f1"),
        mean("gold_evidence_recall", "gold_evidence_recall"),
    )


def rollout_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = environment.rollout_parts(table(spark, d, "rollouts_for_grpo"))
    gold = F.size(F.coalesce("metadata.gold_doc_ids", F.array().cast("array<string>")))
    return rows.agg(
        F.count("*").alias("examples"),
        text.rate(F.col("search_action.valid")).alias("valid_search_action_rate"),
        text.rate(F.col("answer_action.valid")).alias("valid_answer_action_rate"),
        text.rate(F.col("scores.exact_match")).alias("answer_exact_match_rate"),
        text.average(F.col("scores.token_f1")).alias("answer_token_f1"),
        text.average(F.col("gold_evidence_recall")).alias("gold_evidence_recall"),
        text.rate((gold > 0) & (F.col("gold_evidence_recall") == 1.0)).alias("all_gold_evidence_retrieved_rate"),
        text.average(F.size(F.coalesce("metadata.retrieved_doc_ids", F.array().cast("array<string>")))).alias("avg_observation_doc_count"),
    )


def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).select("rollout_id", F.array_join("flags", "|").alias("flags"), F.coalesce("excluded", F.lit(False)).alias("excluded"))


def quality_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _quality(spark, d).select("excluded", F.explode("flags").alias("flag"))
    return rows.groupBy("flag").agg(F.count("*").alias("n"), F.count_if(F.col("excluded")).alias("n_excluded"))


def candidate_backfill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rollouts_for_grpo").select("rollout_id", F.col("metadata.candidate_doc_ids").alias("doc_ids"), F.col("metadata.candidate_passages").alias("passages"))
    stripped = rows.withColumn("passages", F.when(F.col("rollout_id") % 3 != 0, F.col("passages")))
    index = rows.select("rollout_id", F.explode("passages").alias("p")).where("p.doc_id is not null").groupBy(F.col("p.doc_id").alias("doc_id")).agg(F.min(F.struct("rollout_id", "p.title", "p.text")).alias("r")).select("doc_id", "r.title", "r.text")
    filled = environment.backfill(stripped, index, "rollout_id")
    return filled.select("rollout_id", F.coalesce(F.size("passages"), F.lit(0)).cast("long").alias("n_passages"), F.coalesce(F.array_join(F.transform("passages", lambda p: p["doc_id"]), "|"), F.lit("")).alias("doc_ids"))


def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    e = _examples(spark, d)
    corpus = e.select("id", F.posexplode("corpus").alias("i", "p")).where("p.doc_id is not null").groupBy(F.col("p.doc_id").alias("doc_id")).agg(F.min(F.struct("id", "i")).alias("k")).select("doc_id", F.concat_ws("/", "k.id", F.format_string("%06d", F.col("k.i"))).alias("pos"))
    pool = environment.candidate_pool(e.select("id", F.col("gold_doc_ids").alias("gold")), corpus, 6)
    return pool.select("id", F.col("place").cast("long").alias("place"), "doc_id", "gold")


def _search_rows(spark: SparkSession, d: str) -> DataFrame:
    parts = environment.rollout_parts(table(spark, d, "rollouts_for_grpo")).where("search_action.type = 'search'")
    none = F.array().cast("array<string>")
    return parts.select(F.col("rollout_id").alias("id"), F.col("search_action.query").alias("query"), F.col("prompt").alias("question"), F.col("metadata.answer").alias("answer"), F.coalesce("metadata.gold_doc_ids", none).alias("gold"), F.coalesce("metadata.candidate_passages", F.array().cast(parts.select("metadata.candidate_passages").schema[0].dataType)).alias("passages"))


def synthetic_negatives(spark: SparkSession, d: str) -> DataFrame:
    return negatives.scored_candidates(_search_rows(spark, d)).withColumn("candidate_index", F.col("candidate_index").cast("long"))


def negative_pairs(spark: SparkSession, d: str) -> DataFrame:
    return negatives.negative_pairs(_search_rows(spark, d))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return logs.lines(table(spark, d, "documents").where("source = 'trainer_log' and text is not null"), "doc_id", "text")


def log_parse(spark: SparkSession, d: str) -> DataFrame:
    return logs.overview(_logs(spark, d), "doc_id")


def log_metrics(spark: SparkSession, d: str) -> DataFrame:
    return logs.metrics(_logs(spark, d), "doc_id")


def log_steps(spark: SparkSession, d: str) -> DataFrame:
    kinds = logs.step_kinds(logs.metrics(_logs(spark, d), "doc_id"), "doc_id")
    return kinds.groupBy("doc_id").agg(F.max("step").alias("last_step"), F.max(F.when(F.col("is_train"), F.col("step"))).alias("final_train_step"), F.min(F.when(F.col("is_validation"), F.col("step"))).alias("first_validation_step"), F.count_if(F.col("is_train")).alias("train_steps"))


def reward_curve(spark: SparkSession, d: str) -> DataFrame:
    return logs.reward_curve(logs.metrics(_logs(spark, d), "doc_id"), "doc_id")


def reward_drop_alerts(spark: SparkSession, d: str) -> DataFrame:
    return logs.reward_drops(reward_curve(spark, d), "doc_id", "score_mean")


def _batches(spark: SparkSession, d: str) -> DataFrame:
    rows = dense_positions(table(spark, d, "rollouts_for_grpo").select("rollout_id", F.coalesce("reward", F.lit(0.0)).alias("reward")), "rollout_id")
    return report.batches(rows, "reward", BATCH, LOW)


def batch_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _batches(spark, d)


def step_alignment(spark: SparkSession, d: str) -> DataFrame:
    return report.align_steps(spark.range(1, 201).toDF("step"), _batches(spark, d)).select("step", "batch_index", "row_start", "row_end_exclusive", "mean_reward", "low_rows")


def reward_dump_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.coalesce("value", F.lit(0.0)).alias("score"))
    return report.rollup_summary(e, "stage", "score", LOW * 100)


def low_score_examples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value < 5").select("event_id", "event_type", "user_id", "value")
    return e.orderBy("event_id").limit(20)


def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.lower(text.strip(text.text("action_type")))
    return table(spark, d, "transitions").select("row_id", F.when(kind == "", "unknown").otherwise(kind).alias("stage")).distinct().groupBy("stage").agg(F.count("*").alias("n"))


def candidate_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.coalesce("metadata.candidate_passages", F.array().cast(table(spark, d, "rollouts_for_grpo").select("metadata.candidate_passages").schema[0].dataType)))
    return table(spark, d, "rollouts_for_grpo").agg(F.count("*").alias("n_rows"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), F.round(F.avg(n), 6).alias("mean"))


def rollout_answer_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rollouts_for_grpo").select("rollout_id", F.col("prompt").alias("question"), text.strip(text.text("final_answer")).alias("prediction"), text.strip(text.text("metadata.answer")).alias("gold"), actions.observation_titles(F.col("response")).alias("titles"))
    return report.answer_diagnostics(rows).select("rollout_id", "exact_match", "expected_answer_type", F.array_join("reasons", "|").alias("reasons"))


def answer_diagnostics_summary(spark: SparkSession, d: str) -> DataFrame:
    r = rollout_answer_diagnostics(spark, d)
    fine = F.col("reasons") == ""
    return r.agg(F.count("*").alias("examples"), text.rate(F.col("exact_match")).alias("exact_match_rate"), F.count_if(~fine).alias("suspicious"), F.coalesce(F.round(F.avg(F.when(fine, F.when(F.col("exact_match"), 1.0).otherwise(0.0))), 6), F.lit(0.0)).alias("adjusted_exact_match_rate"))


def generation_summary(spark: SparkSession, d: str) -> DataFrame:
    part = F.regexp_extract(text.text("response"), r"(?s)(<answer>.*)$", 1)
    rows = table(spark, d, "rollouts_for_grpo").select(F.coalesce("source", F.lit("")).alias("mode"), part.alias("generated"), text.text("metadata.answer").alias("gold"), F.size(text.tokenize(part)).alias("new_tokens"))
    return report.generation_summary(rows)


def logprob_comparison(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("stage"), (-F.col("value") / 10).alias("logprob"), (F.col("event_id") % 2).alias("half"))
    side = lambda h: e.where(F.col("half") == h).groupBy("id", "stage").agg(F.round(F.sum("logprob"), 6).alias("total"), F.count("*").alias("tokens"))
    return report.compare_logprobs(side(0), side(1))


def policy_comparison(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    side = lambda h: e.where(F.col("event_id") % 2 == h).groupBy(F.col("user_id").alias("id")).agg((F.max("value") > 95).alias("exact_match"), F.round(F.avg("value"), 6).alias("score"))
    return report.compare_policies(side(0), side(1))


def tensor_diff(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("values"))
    return report.tensor_diff(v, v.select((F.col("vec_id") - 1).alias("vec_id"), "values"), "vec_id")


def tensor_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that only one side has (full outer join)."""
    v = table(spark, d, "embeddings").select("vec_id")
    return report.only_one_side(v.where("vec_id % 10 != 3"), v.where("vec_id % 10 != 7"), "vec_id")


def dataset_report(spark: SparkSession, d: str) -> DataFrame:
    e = _examples(spark, d)
    answer = text.strip(text.text(F.try_element_at("answers", F.lit(1))))
    rows = e.select(text.folded(answer).alias("a"), F.size(F.filter(F.split(text.squeeze(answer), " "), lambda w: w != "")).alias("n"), text.folded(text.text("question")).alias("q"), F.transform("corpus", lambda p: text.folded(text.text(p["title"]))).alias("titles"))
    return rows.agg(F.count("*").alias("n_rows"), F.min("n").cast("long").alias("shortest"), F.max("n").cast("long").alias("longest"), F.round(F.avg("n"), 6).alias("mean_words"), F.count_if(F.coalesce(F.array_contains("titles", F.col("a")), F.lit(False))).alias("answer_equals_title"), F.count_if((F.col("a") != "") & F.col("q").contains(F.col("a"))).alias("answer_in_question"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [env_reward_records, env_transitions, env_summary, rollout_summary, quality_filter, quality_flag_counts, candidate_backfill, candidate_pool, synthetic_negatives, negative_pairs, log_parse, log_metrics, log_steps, reward_curve, reward_drop_alerts, batch_diagnostics, step_alignment, reward_dump_rollup, low_score_examples, stage_counts, candidate_sizes, rollout_answer_diagnostics, answer_diagnostics_summary, generation_summary, logprob_comparison, policy_comparison, tensor_diff, tensor_names, dataset_report]
    return {f.__name__: f for f in own}


_GENERATED = "(SELECT *, regexp_extract(coalesce(response, ''), '(?s)(<search>.*?</search>)', 1) AS sg, regexp_extract(coalesce(response, ''), '(?s)(<answer>.*?</answer>)', 1) AS ag FROM rollouts_for_grpo)"
_REWARDS = f"""(SELECT *, round(round(0.2 * evidence_reward + 0.1 * tool_validity_reward - search_cost, 6) + answer_credit, 6) AS total, round(0.2 * evidence_reward + 0.1 * tool_validity_reward - search_cost, 6) AS search_credit FROM (
    SELECT s.rollout_id, s.kind AS s_kind, a.kind AS a_kind, s.kind = 'search' AS valid_search, a.kind = 'answer' AS valid_answer, length({q.strip('a.raw')}) > 0 AS has_answer, s.raw AS sg, a.raw AS ag,
        exact, containment, CAST(f1 AS DOUBLE) AS f1, CAST(round(CAST({q.LADDER} AS DOUBLE), 6) AS DOUBLE) AS answer_reward, {q.LADDER_KIND} AS answer_reward_type, evidence_reward,
        CASE WHEN s.kind = 'search' AND a.kind = 'answer' THEN CAST(1 AS DOUBLE) ELSE 0 END AS format_reward, CASE WHEN s.kind = 'search' THEN CAST(1 AS DOUBLE) ELSE 0 END AS tool_validity_reward,
        CAST(s.kind = 'search' AS BIGINT) AS search_count, CASE WHEN s.kind = 'search' THEN CAST(0.03 AS DOUBLE) ELSE 0 END AS search_cost,
        round(round(CAST({q.LADDER} AS DOUBLE), 6) + 0.1 * CASE WHEN s.kind = 'search' AND a.kind = 'answer' THEN CAST(1 AS DOUBLE) ELSE 0 END, 6) AS answer_credit, n_gold, n_seen
    FROM {q.agent_action('sg', _GENERATED, 'rollout_id')} s JOIN {q.agent_action('ag', _GENERATED, 'rollout_id')} a USING (rollout_id) JOIN {q.scored('final_answer', 'metadata.answer', 'rollouts_for_grpo', 'rollout_id')} x USING (rollout_id)
    JOIN (SELECT rollout_id, len(gold) AS n_gold, n_seen, CASE WHEN len(gold) > 0 THEN round(len(list_intersect(gold, seen)) / len(gold), 6) ELSE CAST(0 AS DOUBLE) END AS evidence_reward
        FROM (SELECT rollout_id, list_distinct(coalesce(metadata.gold_doc_ids, [])) AS gold, coalesce(metadata.retrieved_doc_ids, []) AS seen, len(coalesce(metadata.retrieved_doc_ids, [])) AS n_seen FROM rollouts_for_grpo)) v USING (rollout_id)))"""
_FLAGS = f"(SELECT rollout_id, list_sort(list_distinct(list_filter(list_transform(coalesce(metadata.quality_flags, []), lambda f: {q.strip(chr(102))}), lambda f: f <> ''))) AS flags FROM rollouts_for_grpo)"
_LINES = f"(SELECT doc_id, i - 1 AS line_no, {q.strip('regexp_replace(parts[i], chr(27) || {}, {}, {})'.format(repr(chr(92) + '[[0-9;]*m'), repr(''), repr('g')))} AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10)) AS parts FROM documents WHERE source = 'trainer_log' AND text IS NOT NULL)))"
_METRICS = f"""(SELECT doc_id, step, metric, arg_max(value, i) AS value FROM (
    SELECT doc_id, step, i, {q.strip("regexp_extract(part, '^(.*):([^:]*)$', 1)")} AS metric, TRY_CAST(regexp_replace({q.strip("regexp_extract(part, '^(.*):([^:]*)$', 2)")}, ',+$', '') AS DOUBLE) AS value
    FROM (SELECT doc_id, step, unnest(string_split(tail, ' - ')) AS part, unnest(range(1, len(string_split(tail, ' - ')) + 1)) AS i FROM (
        SELECT doc_id, CAST(step AS BIGINT) AS step, arg_max(tail, line_no) AS tail FROM (SELECT doc_id, line_no, regexp_extract(line, '\\bstep:(\\d+)\\s+-\\s+(.*)', 1) AS step, regexp_extract(line, '\\bstep:(\\d+)\\s+-\\s+(.*)', 2) AS tail FROM {_LINES}) WHERE step <> '' GROUP BY ALL))
    WHERE contains(part, ':')) WHERE value IS NOT NULL GROUP BY ALL)"""
_CURVE = f"(SELECT doc_id, step, max(value) FILTER (metric = 'critic/rewards/mean') AS rewards_mean, max(value) FILTER (metric = 'critic/score/mean') AS score_mean FROM {_METRICS} GROUP BY ALL HAVING rewards_mean IS NOT NULL OR score_mean IS NOT NULL)"
_BATCHES = f"(SELECT (p // {BATCH}) AS batch_index, min(p) AS row_start, max(p) + 1 AS row_end_exclusive, count(*) AS n_rows, round(min(reward), 6) AS min_reward, round(max(reward), 6) AS max_reward, round(avg(reward), 6) AS mean_reward, count(*) FILTER (reward < {LOW}) AS low_rows FROM (SELECT coalesce(reward, 0.0) AS reward, row_number() OVER (ORDER BY rollout_id) - 1 AS p FROM rollouts_for_grpo) GROUP BY 1)"


def oracle_sql() -> dict[str, str]:
    r6 = lambda x, n: f"coalesce(round(avg({x}), 6), 0.0) AS {n}"
    b = lambda x: f"CASE WHEN {x} THEN 1.0 ELSE 0.0 END"
    any_of = lambda marks: "(" + " OR ".join("contains(line, '{}')".format(m.replace("'", "''")) for m in marks) + ")"
    half = lambda h: f"(SELECT user_id AS id, event_type AS stage, round(sum(-value / 10), 6) AS total, count(*) AS tokens FROM events WHERE event_id % 2 = {h} GROUP BY ALL)"
    side = lambda h: f"(SELECT user_id AS id, max(value) > 95 AS exact_match, round(avg(value), 6) AS score FROM events WHERE event_id % 2 = {h} GROUP BY ALL)"
    kept = f"(SELECT r.*, list_contains(f.flags, 'weak_evidence') AS excluded FROM {_REWARDS} r JOIN {_FLAGS} f USING (rollout_id))"
    titles = f"list_transform(regexp_extract_all(coalesce(response, ''), '(?m)^[ \\t]*\\[\\d+\\][ \\t]+([^:\\n]+):', 1), lambda t: {q.strip('t')})"
    joined = lambda x: f"array_to_string({q.answer_tokens(x)}, ' ')"
    has = lambda toks, words: "(" + " OR ".join(f"list_contains({toks}, '{w}')" for w in words) + ")"
    kinds = report.KEYWORDS
    expected = "CASE " + " ".join(f"WHEN {has('qt', w)} THEN '{k}'" for k, w in kinds.items()) + " END"
    matches = lambda toks: "CASE et " + " ".join(f"WHEN '{k}' THEN {has(toks, w)}" for k, w in kinds.items()) + " ELSE false END"
    diagnosed = f"""(SELECT rollout_id, exact AS exact_match, et AS expected_answer_type, array_to_string(list_filter([CASE WHEN NOT exact AND in_titles THEN 'prediction_matches_observation_title' END,
            CASE WHEN NOT exact AND et IN ('institute', 'journal', 'university') AND NOT {matches('gt')} AND {matches('pt')} THEN 'question_gold_type_mismatch' END], lambda x: x IS NOT NULL), '|') AS reasons
        FROM (SELECT x.*, {expected} AS et, list_contains(tn, pn) AS in_titles FROM (SELECT s.*, {q.answer_tokens('r.prompt')} AS qt, list_transform({titles}, lambda t: {joined('t')}) AS tn FROM
            {q.scored(q.strip("coalesce(final_answer, '')"), q.strip("coalesce(metadata.answer, '')"), 'rollouts_for_grpo', 'rollout_id')} s JOIN rollouts_for_grpo r USING (rollout_id)) x))"""
    gen = q.agent_action("g", "(SELECT rollout_id, coalesce(source, '') AS mode, regexp_extract(coalesce(response, ''), '(?s)(<answer>.*)$', 1) AS g, coalesce(metadata.answer, '') AS gold FROM rollouts_for_grpo)", "rollout_id, mode, gold, g")
    gen_cols = f"""count(*) AS examples, {r6(b("contains(g, '<search>') AND contains(g, '</search>')"), 'search_tag_rate')}, {r6(b("contains(g, '<answer>') AND contains(g, '</answer>')"), 'answer_tag_rate')},
        {r6(b("contains(g, '<observation>') OR contains(g, '</observation>')"), 'observation_tag_rate')}, {r6(b('valid'), 'single_action_rate')}, {r6(b("kind = 'answer'"), 'valid_answer_action_rate')},
        {r6(b(f"{q.strip('gold')} <> '' AND contains(lower(g), lower({q.strip('gold')}))"), 'gold_answer_mention_rate')}, {r6("len(regexp_extract_all(lower(g), '[a-z0-9]+'))", 'avg_new_tokens')}"""
    zipped = "(SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
    return {
        "env_reward_records": f"SELECT rollout_id, answer_reward, answer_reward_type, evidence_reward, format_reward, tool_validity_reward, search_count, search_cost, search_credit, answer_credit, total FROM {_REWARDS}",
        "env_transitions": f"""SELECT rollout_id, CAST(0 AS BIGINT) AS step_index, rollout_id || ':0:' || s_kind AS transition_id, s_kind AS action_type, NOT has_answer AS terminal, search_credit AS reward, sg AS action FROM {_REWARDS}
            UNION ALL SELECT rollout_id, 1, rollout_id || ':1:' || a_kind, a_kind, true, answer_credit, ag FROM {_REWARDS} WHERE has_answer""",
        "env_summary": f"""SELECT (SELECT count(*) FROM {kept}) AS input_examples, (SELECT count(*) FROM {kept} WHERE excluded) AS excluded_examples, {r6('total', 'avg_total_reward')}, {r6('search_credit', 'avg_search_credit')}, {r6('answer_credit', 'avg_answer_credit')},
            {r6(b('valid_search'), 'valid_search_action_rate')}, {r6(b('valid_answer'), 'valid_answer_action_rate')}, {r6(b('exact'), 'answer_exact_match_rate')}, {r6(b('containment'), 'answer_containment_match_rate')}, {r6('f1', 'answer_token_f1')}, {r6('evidence_reward', 'gold_evidence_recall')}
            FROM {kept} WHERE NOT excluded""",
        "rollout_summary": f"""SELECT count(*) AS examples, {r6(b('valid_search'), 'valid_search_action_rate')}, {r6(b('valid_answer'), 'valid_answer_action_rate')}, {r6(b('exact'), 'answer_exact_match_rate')}, {r6('f1', 'answer_token_f1')}, {r6('evidence_reward', 'gold_evidence_recall')},
            {r6(b('n_gold > 0 AND evidence_reward = 1'), 'all_gold_evidence_retrieved_rate')}, {r6('n_seen', 'avg_observation_doc_count')} FROM {_REWARDS}""",
        "quality_filter": f"SELECT rollout_id, array_to_string(flags, '|') AS flags, list_contains(flags, 'weak_evidence') AS excluded FROM {_FLAGS}",
        "quality_flag_counts": f"SELECT flag, count(*) AS n, count(*) FILTER (excluded) AS n_excluded FROM (SELECT list_contains(flags, 'weak_evidence') AS excluded, unnest(flags) AS flag FROM {_FLAGS}) GROUP BY flag",
        "candidate_backfill": """WITH ix AS (SELECT DISTINCT p.doc_id AS doc_id FROM (SELECT unnest(metadata.candidate_passages) AS p FROM rollouts_for_grpo) WHERE p.doc_id IS NOT NULL),
            own AS (SELECT rollout_id, CASE WHEN rollout_id % 3 <> 0 AND len(coalesce(metadata.candidate_passages, [])) > 0 THEN list_transform(metadata.candidate_passages, lambda p: p.doc_id) END AS ids, metadata.candidate_doc_ids AS asked FROM rollouts_for_grpo),
            f AS (SELECT rollout_id, list(d ORDER BY i) AS ids FROM (SELECT rollout_id, unnest(asked) AS d, unnest(range(len(asked))) AS i FROM own WHERE ids IS NULL) WHERE d IN (SELECT doc_id FROM ix) GROUP BY rollout_id)
            SELECT own.rollout_id, CAST(coalesce(len(coalesce(own.ids, f.ids)), 0) AS BIGINT) AS n_passages, coalesce(array_to_string(coalesce(own.ids, f.ids), '|'), '') AS doc_ids FROM own LEFT JOIN f ON own.rollout_id = f.rollout_id""",
        "candidate_pool": f"""WITH qa AS {_FIRST_QA}, c0 AS (SELECT p.doc_id AS doc_id, min({{'id': id, 'i': i}}) AS k FROM (SELECT id, unnest(corpus) AS p, unnest(range(len(corpus))) AS i FROM qa) WHERE p.doc_id IS NOT NULL GROUP BY 1),
            c AS (SELECT doc_id, row_number() OVER (ORDER BY k.id || '/' || lpad(CAST(k.i AS VARCHAR), 6, '0')) - 1 AS p FROM c0), g AS (SELECT id, unnest(gold_doc_ids) AS doc_id, unnest(range(len(gold_doc_ids))) AS place FROM qa),
            gg AS (SELECT g.id, g.place, g.doc_id FROM g JOIN c USING (doc_id)), s AS (SELECT id, list_sum(list_transform(string_split(id, ''), lambda x: unicode(x))) AS s FROM qa),
            far AS (SELECT qa.id, c.doc_id, row_number() OVER (PARTITION BY qa.id ORDER BY p) - 1 AS j, count(*) OVER (PARTITION BY qa.id) AS m FROM qa, c WHERE NOT EXISTS (SELECT 1 FROM gg WHERE gg.id = qa.id AND gg.doc_id = c.doc_id))
            SELECT id, CAST(place AS BIGINT) AS place, doc_id, true AS gold FROM gg UNION ALL SELECT far.id, CAST(1000000 + (j - s % m + m) % m AS BIGINT), doc_id, false FROM far JOIN s USING (id) WHERE (j - s % m + m) % m < 6""",
        "log_parse": f"""SELECT doc_id, started_at, finished_at, progress_100, fatal_marker_count, shutdown_warning_count, coalesce(finished_at <> '', false) AND progress_100 AND fatal_marker_count = 0 AS completed FROM (
            SELECT doc_id, arg_max({q.strip("line[12:]")}, line_no) FILTER (starts_with(line, 'started_at=')) AS started_at, arg_max({q.strip("line[13:]")}, line_no) FILTER (starts_with(line, 'finished_at=')) AS finished_at,
            bool_or(contains(line, 'Training Progress: 100%')) AS progress_100, CAST({' + '.join(f'count(*) FILTER ({any_of(m)})' for m in logs.FATAL.values())} AS BIGINT) AS fatal_marker_count, count(*) FILTER ({any_of(logs.SHUTDOWN)}) AS shutdown_warning_count FROM {_LINES} GROUP BY doc_id)""",
        "log_metrics": f"SELECT doc_id, step, metric, value FROM {_METRICS}",
        "log_steps": f"""SELECT doc_id, max(step) AS last_step, max(step) FILTER (is_train) AS final_train_step, min(step) FILTER (is_val) AS first_validation_step, count(*) FILTER (is_train) AS train_steps FROM (
            SELECT doc_id, step, bool_or(starts_with(metric, 'critic/') OR metric = 'training/global_step') AS is_train, bool_or(starts_with(metric, 'val-')) AS is_val FROM {_METRICS} GROUP BY ALL) GROUP BY doc_id""",
        "reward_curve": f"SELECT * FROM {_CURVE}",
        "reward_drop_alerts": f"SELECT * FROM (SELECT doc_id, step, lag(step) OVER w AS previous_step, lag(score_mean) OVER w AS previous, score_mean AS reward, round(score_mean - lag(score_mean) OVER w, 6) AS delta FROM {_CURVE} WINDOW w AS (PARTITION BY doc_id ORDER BY step)) WHERE delta <= -0.25",
        "batch_diagnostics": f"SELECT * FROM {_BATCHES}",
        "step_alignment": f"SELECT step, batch_index, row_start, row_end_exclusive, mean_reward, low_rows FROM range(1, 201) t(step) JOIN {_BATCHES} b ON (step - 1) % (SELECT count(*) FROM {_BATCHES}) = b.batch_index",
        "reward_dump_rollup": f"SELECT coalesce(event_type, 'overall') AS stage, count(*) AS n_rows, count(*) FILTER (s < {LOW * 100}) AS low_rows, round(min(s), 6) AS min_score, round(max(s), 6) AS max_score, round(avg(s), 6) AS mean_score FROM (SELECT event_type, coalesce(value, 0.0) AS s FROM events) GROUP BY ROLLUP (event_type)",
        "low_score_examples": "SELECT event_id, event_type, user_id, value FROM events WHERE value < 5 ORDER BY event_id LIMIT 20",
        "stage_counts": f"SELECT stage, count(*) AS n FROM (SELECT DISTINCT row_id, CASE WHEN k = '' THEN 'unknown' ELSE k END AS stage FROM (SELECT row_id, lower({q.strip(chr(99) + 'oalesce(action_type, ' + repr('') + ')')}) AS k FROM transitions)) GROUP BY stage",
        "candidate_sizes": "SELECT count(*) AS n_rows, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, round(avg(n), 6) AS mean FROM (SELECT len(coalesce(metadata.candidate_passages, [])) AS n FROM rollouts_for_grpo)",
        "rollout_answer_diagnostics": f"SELECT * FROM {diagnosed}",
        "answer_diagnostics_summary": f"SELECT count(*) AS examples, {r6(b('exact_match'), 'exact_match_rate')}, count(*) FILTER (reasons <> '') AS suspicious, coalesce(round(avg({b('exact_match')}) FILTER (reasons = ''), 6), 0.0) AS adjusted_exact_match_rate FROM {diagnosed}",
        "generation_summary": f"SELECT 'overall' AS mode, {gen_cols} FROM {gen} UNION ALL SELECT mode, {gen_cols} FROM {gen} WHERE mode <> '' GROUP BY mode",
        "logprob_comparison": f"""SELECT stage, count(*) AS n, round(avg(round(c.total - b.total, 6)), 6) AS mean_delta, count(*) FILTER (c.total > b.total) AS improved, count(*) FILTER (c.total < b.total) AS regressed, count(*) FILTER (c.total = b.total) AS unchanged,
            round(sum(b.total) / sum(b.tokens), 6) AS base_mean, round(sum(c.total) / sum(c.tokens), 6) AS candidate_mean FROM {half(0)} b JOIN {half(1)} c USING (id, stage) GROUP BY stage""",
        "policy_comparison": f"""SELECT count(*) AS n, round(avg({b('c.exact_match')}) - avg({b('b.exact_match')}), 6) AS exact_match_delta, round(avg(c.score) - avg(b.score), 6) AS score_delta, count(*) FILTER (c.exact_match <> b.exact_match) AS changed,
            count(*) FILTER (c.exact_match AND NOT b.exact_match) AS improved, count(*) FILTER (b.exact_match AND NOT c.exact_match) AS regressed FROM {side(0)} b JOIN {side(1)} c USING (id)""",
        "tensor_diff": f"""SELECT vec_id, round(sqrt(l2), 6) AS l2, round(CASE WHEN n2 > 0 THEN sqrt(l2) / sqrt(n2) ELSE 0.0 END, 6) AS relative_l2, round(mx, 6) AS max_abs, round(mean, 6) AS mean_abs, changed FROM (
            SELECT vec_id, list_sum(list_transform(d, lambda z: z * z)) AS l2, list_sum(list_transform(x, lambda z: z * z)) AS n2, list_max(list_transform(d, lambda z: abs(z))) AS mx, list_sum(list_transform(d, lambda z: abs(z))) / len(d) AS mean, CAST(len(list_filter(d, lambda z: z <> 0)) AS BIGINT) AS changed
            FROM (SELECT vec_id, x, list_transform(x, lambda z, i: y[i] - z) AS d FROM {zipped}))""",
        "tensor_names": "SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, CASE WHEN b.vec_id IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT vec_id FROM embeddings WHERE vec_id % 10 <> 3) a FULL JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 10 <> 7) b ON a.vec_id = b.vec_id WHERE a.vec_id IS NULL OR b.vec_id IS NULL",
        "dataset_report": f"""SELECT count(*) AS n_rows, CAST(min(n) AS BIGINT) AS shortest, CAST(max(n) AS BIGINT) AS longest, round(avg(n), 6) AS mean_words, count(*) FILTER (coalesce(list_contains(titles, a), false)) AS answer_equals_title, count(*) FILTER (a <> '' AND contains(qq, a)) AS answer_in_question FROM (
            SELECT {q.folded('s')} AS a, len(list_filter(string_split({q.squeeze('s')}, ' '), lambda w: w <> '')) AS n, qq, titles FROM (SELECT {q.strip("coalesce(answers[1], '')")} AS s, {q.folded("coalesce(question, '')")} AS qq, list_transform(corpus, lambda p: {q.folded("coalesce(p.title, '')")}) AS titles FROM {_FIRST_QA}))""",
    }
