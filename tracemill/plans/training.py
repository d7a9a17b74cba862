"""Queries on exports, variance selection, preference pairs and splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import actions, text
from tracemill.operators import exports, selection
from tracemill.plans import sqltext as q
from tracemill.plans.retrieval import _EPISODES, _FIRST_QA, _examples, rule_episodes
from tracemill.session import dense_positions, table

MIN_RANGE, MIN_GAP, PER_GROUP = 100.0, 50.0, 2


def _supported(spark: SparkSession, d: str) -> DataFrame:
    return exports.with_evidence(_examples(spark, d)).where("supported")


def sft_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of rule-based episodes: system, question, trace."""
    e = rule_episodes(spark, d)
    trace = exports.assistant_trace(F.col("query"), F.col("observation"), F.col("final_answer"))
    messages = F.array(actions.message("system", F.lit(exports.AGENT_PROMPT)), actions.message("user", text.text("question")), actions.message("assistant", trace))
    return e.select("id", actions.messages_text(messages).alias("messages"), "search_count", F.array_join(F.transform("observation", lambda p: p["doc_id"]), "|").alias("retrieved_doc_ids"))


def grpo_rollouts(spark: SparkSession, d: str) -> DataFrame:
    e = rule_episodes(spark, d)
    return e.select("id", text.text("question").alias("prompt"), exports.assistant_trace(F.col("query"), F.col("observation"), F.col("final_answer")).alias("response"), F.col("total").alias("reward"), exports.gold_answer(F.col("answers")).alias("answer"))


def sft_warmup(spark: SparkSession, d: str) -> DataFrame:
    rows = _supported(spark, d)
    return rows.select("id", actions.messages_text(exports.warmup_messages(rows)).alias("messages"), "answer", F.size("evidence").cast("long").alias("n_evidence"))


def sft_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = _supported(spark, d)
    return rows.select("id", actions.messages_text(exports.turn_messages(rows)).alias("messages"), "answer", F.array_join(F.transform("evidence", lambda p: p["doc_id"]), "|").alias("gold_evidence_doc_ids"))


def sft_turn_rates(spark: SparkSession, d: str) -> DataFrame:
    all_rows = exports.with_evidence(_examples(spark, d))
    gold = F.coalesce(F.size("gold_doc_ids"), F.lit(0))
    return all_rows.agg(
        F.count("*").alias("examples"),
        F.count_if(F.col("supported")).alias("sft_rows"),
        text.rate(F.col("answer") != "").alias("non_empty_answer_rate"),
        text.rate((gold > 0) & (F.size("evidence") == gold)).alias("gold_evidence_coverage"),
        text.average(F.size("evidence")).alias("avg_gold_evidence_count"),
    )


def gold_evidence_join(spark: SparkSession, d: str) -> DataFrame:
    """Gold evidence against the shared index of all passages (first wins)."""
    index = table(spark, d, "passages").where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct("title", "text"), "passage_id").alias("p")).select("doc_id", "p.title", "p.text")
    met = exports.joined_evidence(_examples(spark, d), index)
    own = _examples(spark, d).select("id", F.size("gold_doc_ids").alias("n_gold"))
    return own.join(met, "id", "left").select("id", F.coalesce("n_gold", F.lit(0)).cast("long").alias("n_gold"), F.coalesce(F.size("evidence"), F.lit(0)).cast("long").alias("n_found"))


def sft_stage_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = _supported(spark, d)
    staged = exports.stage_prompts(rows.select("id", "answer", exports.turn_messages(rows).alias("messages")))
    return staged.select("id", "stage", actions.messages_text(F.col("prompt")).alias("prompt"), "expected_action")


def trainer_rows(spark: SparkSession, d: str) -> DataFrame:
    """One trainer row a stage; ground truth only for answers, a search costs only in the search stage."""
    rows = _supported(spark, d)
    staged = exports.stage_prompts(rows.select("id", "answer", exports.turn_messages(rows).alias("messages")))
    is_search = F.col("stage") == "search"
    return staged.select(F.concat_ws("::", "id", "stage").alias("row_id"), F.col("id").alias("source_id"), F.col("stage").alias("reward_stage"), F.size("prompt").cast("long").alias("n_messages"), F.when(is_search, "").otherwise(F.col("answer")).alias("ground_truth"), F.when(is_search, 1).otherwise(0).cast("long").alias("search_count"))


def rollout_trainer_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rollouts_for_grpo")
    messages = F.array(actions.message("system", F.lit(exports.AGENT_PROMPT)), actions.message("user", F.col("prompt")))
    return rows.select("rollout_id", actions.messages_text(messages).alias("prompt"), text.text("metadata.answer").alias("ground_truth"), F.coalesce("reward", F.lit(0.0)).alias("reward"), F.coalesce("metadata.search_count", F.lit(0)).cast("long").alias("search_count"))


def _stage(c: str = "action_type"):
    kind = F.lower(text.strip(text.text(c)))
    return F.when(kind.isin("search", "answer"), kind).otherwise("answer")


def transition_trainer_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "transitions").select("row_id", "transition_id", "question_id", "state", "action_type", "reward").distinct()
    return rows.select("row_id", text.text("transition_id").alias("id"), F.split_part(text.text("transition_id"), F.lit(":"), F.lit(1)).alias("source_id"), _stage().alias("reward_stage"), F.coalesce("reward", F.lit(0.0)).alias("reward"), F.when(_stage() == "search", 1).otherwise(0).cast("long").alias("search_count"))


def probe_requests(spark: SparkSession, d: str) -> DataFrame:
    """Probe requests of the search transitions, with the probe instruction before their state."""
    rows = table(spark, d, "transitions").select("row_id", "state", "action_type").distinct().where(_stage() == "search")
    messages = F.array(actions.message("user", F.col("state")))
    return rows.select("row_id", actions.messages_text(exports.probe_prompt(messages)).alias("prompt"))


def train_val_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rollouts_for_grpo").select("rollout_id", "id")
    return exports.prefix_split(rows, "rollout_id", 100, 20).select("rollout_id", "split")


# -- reward dumps: stage = event_type, source = user, score = value, sample = event ----------------------------


def _dump(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("user_id").cast("string").alias("source_id"), F.coalesce("value", F.lit(0.0)).alias("score"), F.col("event_id").alias("sample_index"))


def reward_variance_groups(spark: SparkSession, d: str) -> DataFrame:
    return selection.variable_groups(_dump(spark, d), min_range=MIN_RANGE)


def variance_selected_sources(spark: SparkSession, d: str) -> DataFrame:
    return selection.ranked_sources(selection.variable_groups(_dump(spark, d), min_range=MIN_RANGE), 20)


def variance_filter(spark: SparkSession, d: str) -> DataFrame:
    chosen = selection.ranked_sources(selection.variable_groups(_dump(spark, d), min_range=MIN_RANGE), 20)
    return selection.keep_sources(_dump(spark, d), chosen).groupBy("source_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score_sum"))


def unmatched_sources(spark: SparkSession, d: str) -> DataFrame:
    """Question ids of rollouts and traces: in transitions or not (anti-join)."""
    known = table(spark, d, "transitions").select("question_id").where("question_id is not null").distinct()
    return table(spark, d, "episode_traces").select("question_id").where("question_id is not null").distinct().join(known, "question_id", "left_anti")


def group_score_variance(spark: SparkSession, d: str) -> DataFrame:
    overall = selection.group_score_variance(_dump(spark, d)).withColumn("stage", F.lit("overall"))
    return selection.group_score_variance(_dump(spark, d), ["stage"]).unionByName(overall)


def _generations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    solution = F.concat(F.when(F.col("event_type").isin("click", "view"), "<search>").otherwise("<answer>"), F.lit("k "), (F.col("event_id") % 11).cast("string"), F.when(F.col("event_type") == "error", "").when(F.col("event_type").isin("click", "view"), "</search>").otherwise("</answer>"))
    return e.select(F.col("user_id").alias("request_index"), F.col("event_id").alias("sample_index"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.when(F.col("user_id") % 2 == 0, "search").otherwise("answer").alias("stage"), solution.alias("solution"), (F.col("value") / 2).alias("score"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    dump = table(spark, d, "events").where("event_id % 5 != 0").select(F.col("user_id").alias("request_index"), F.col("event_id").alias("sample_index"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.when(F.col("user_id") % 2 == 0, "search").otherwise("answer").alias("stage"), F.col("value").alias("score"), F.col("event_id").alias("pos"))
    requests = table(spark, d, "events").where("user_id % 7 != 0").select(F.col("user_id").alias("request_index")).distinct()
    scored = selection.attach_rewards(_generations(spark, d).join(requests, "request_index"), dump)
    a = actions.parse_agent_action(F.col("solution"))
    scored = scored.withColumn("a", a).withColumn("action_key", actions.action_key(F.col("solution"), F.col("a"))).withColumn("action_type", F.col("a.type")).drop("a")
    return selection.best_per_action(scored)


def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("request_index", "action_key", "sample_index", "score", "action_type")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = selection.pairs(_candidates(spark, d), MIN_GAP, PER_GROUP)
    pair_id = F.concat(F.col("c.id"), F.lit(":"), F.col("c.stage"), F.lit(":"), F.col("request_index").cast("string"), F.lit(":"), F.col("c.sample_index").cast("string"), F.lit(">"), F.col("r.sample_index").cast("string"))
    return p.select(pair_id.alias("pair_id"), "request_index", F.col("c.stage").alias("stage"), "place", F.col("c.score").alias("chosen_score"), F.col("r.score").alias("rejected_score"), "score_gap", selection.pair_category(F.col("c.action_type"), F.col("r.action_type")).alias("pair_category"))


def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def pair_category_counts(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).groupBy("pair_category").agg(F.count("*").alias("n"))


def stage_caps(spark: SparkSession, d: str) -> DataFrame:
    return selection.stage_caps(_pairs(spark, d), {"search": 10}, ["request_index", "place"]).select("pair_id", "stage")


def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    return selection.hash_split(_pairs(spark, d).select("pair_id"), "pair_id", 0.05, 3)


def filtered_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where(F.col("pair_category").isin("search_vs_search", "answer_vs_invalid")).select("pair_id", "pair_category")


def resume_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Synthesis tasks that no event id has answered yet: syn-000000, syn-000001, ... with rotating topics."""
    from tracemill.operators import edges

    done = table(spark, d, "events").where("event_id % 3 = 0").select(F.format_string("syn-%06d", F.col("event_id")).alias("id"))
    return edges.pending(edges.tasks(spark, 500, ["river locks", "glass lenses", "salt trade"]), done)


def position_slice(spark: SparkSession, d: str) -> DataFrame:
    """Rows 10 to 29 by position, of the rollouts that have a search (the filter comes before the slice)."""
    rows = table(spark, d, "rollouts_for_grpo").where("contains(response, '<search>')").select("rollout_id")
    return dense_positions(rows, "rollout_id").where("pos >= 10 and pos < 30")


def task_generation(spark: SparkSession, d: str) -> DataFrame:
    from tracemill.operators import edges

    return edges.mock_rows(edges.tasks(spark, 50, ["river locks", "glass-lenses", "salt trade"], seed=7)).select("id", "question", "answer", "topic")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [sft_rows, grpo_rollouts, sft_warmup, sft_turns, sft_turn_rates, gold_evidence_join, sft_stage_prompts, trainer_rows, rollout_trainer_rows, transition_trainer_rows, probe_requests, train_val_prefix, reward_variance_groups, variance_selected_sources, variance_filter, unmatched_sources, group_score_variance, best_candidates, preference_pairs, pair_category_counts, stage_caps, train_val_split, filtered_pairs, resume_by_id, position_slice, task_generation]
    return {f.__name__: f for f in own}


_OBSERVED = "'<observation>' || chr(10) || coalesce((SELECT string_agg('[' || i || '] ' || CASE WHEN coalesce(p.title, '') <> '' THEN p.title || ': ' ELSE '' END || coalesce(p.text, ''), chr(10) ORDER BY i) FROM (SELECT unnest(ev) AS p, unnest(range(1, len(ev) + 1)) AS i)) || chr(10), '') || '</observation>'"
_SUPPORTED = f"""WITH g AS (SELECT id, coalesce(question, '') AS question, coalesce(list_filter(answers, lambda a: length({q.strip("coalesce(a, '')")}) > 0)[1], '') AS answer, coalesce(len(gold_doc_ids), 0) AS n_gold,
        list_filter(list_transform(coalesce(gold_doc_ids, []), lambda g: list_filter(corpus, lambda p: p.doc_id = g)[1]), lambda p: p IS NOT NULL) AS ev FROM {_FIRST_QA}),
    w AS (SELECT *, {q.folded('answer')} = '' OR contains({q.folded("coalesce(array_to_string(list_transform(ev, lambda p: coalesce(p.text, '')), ' '), '')")}, {q.folded('answer')}) AS supported, {_OBSERVED} AS obs FROM g)"""
_DUMP = "(SELECT event_type AS stage, CAST(user_id AS VARCHAR) AS source_id, coalesce(value, 0.0) AS score, event_id FROM events)"
_GROUPS = f"(SELECT stage, source_id, count(*) AS sample_count, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max, round(max(score) - min(score), 6) AS score_range FROM {_DUMP} GROUP BY ALL HAVING count(*) >= 2 AND max(score) - min(score) > {MIN_RANGE})"
_CHOSEN = f"(SELECT source_id, -b.k AS score_range, b.stage AS stage FROM (SELECT source_id, min({{'k': -score_range, 'stage': stage}}) AS b FROM {_GROUPS} GROUP BY source_id) ORDER BY score_range DESC, stage, source_id LIMIT 20)"
_SOLUTION = "CASE WHEN event_type IN ('click', 'view') THEN '<search>' ELSE '<answer>' END || 'k ' || (event_id % 11) || CASE WHEN event_type = 'error' THEN '' WHEN event_type IN ('click', 'view') THEN '</search>' ELSE '</answer>' END"
_ACTED = q.agent_action("solution", f"(SELECT *, {_SOLUTION} AS solution FROM events WHERE user_id % 7 <> 0)", "event_id, user_id, value, event_type")
_BEST = f"""(SELECT * FROM (SELECT user_id AS request_index, event_id AS sample_index, CASE WHEN user_id % 2 = 0 THEN 'search' ELSE 'answer' END AS stage, kind AS action_type, round(CASE WHEN event_id % 5 <> 0 THEN value ELSE value / 2 END, 6) AS score,
        CASE kind WHEN 'search' THEN 'search:' || {q.plain('query')} WHEN 'answer' THEN 'answer:' || {q.plain('answer')} ELSE 'invalid:' || {q.plain('raw')} END AS action_key FROM {_ACTED})
    QUALIFY row_number() OVER (PARTITION BY request_index, action_key ORDER BY score DESC, sample_index) = 1)"""
_PAIRS = f"""(SELECT 'u' || c.request_index || ':' || c.stage || ':' || c.request_index || ':' || c.sample_index || '>' || r.sample_index AS pair_id, c.request_index, c.stage, c.score AS chosen_score, r.score AS rejected_score,
        round(c.score - r.score, 6) AS score_gap, c.action_type || '_vs_' || r.action_type AS pair_category,
        row_number() OVER (PARTITION BY c.request_index ORDER BY round(c.score - r.score, 6) DESC, c.score DESC, r.score, c.sample_index, r.sample_index) AS place
    FROM {_BEST} c JOIN {_BEST} r ON c.request_index = r.request_index AND c.sample_index <> r.sample_index AND round(c.score - r.score, 6) >= {MIN_GAP} QUALIFY place <= {PER_GROUP})"""


def oracle_sql() -> dict[str, str]:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    nl = " || chr(10) || "
    seen = "'<observation>' || chr(10) || coalesce(o || chr(10), '') || '</observation>'"
    trace = nl.join([quoted(exports.FIRST_THOUGHT), "'<search>' || query || '</search>'", seen, quoted(exports.LAST_THOUGHT), "'<answer>' || final_answer || '</answer>'"])
    episodes = f"""{_EPISODES}, o AS (SELECT id, string_agg('[' || rank || '] ' || CASE WHEN coalesce(title, '') <> '' THEN title || ': ' ELSE '' END || coalesce(body, ''), chr(10) ORDER BY rank) AS o FROM hits GROUP BY id),
        t AS (SELECT e.*, {trace} AS trace FROM e LEFT JOIN o ON e.id = o.id)"""
    warm = nl.join([quoted(exports.FIRST_THOUGHT), "'<search>' || question || '</search>'", "obs", quoted(exports.LAST_THOUGHT), "'<answer>' || answer || '</answer>'"])
    two = f"'system: ' || {quoted(exports.TURN_PROMPT)} || chr(10) || 'user: ' || question"
    four = f"{two} || chr(10) || 'assistant: <search>' || question || '</search>' || chr(10) || 'user: ' || obs"
    inner = "coalesce(a, '')"
    gold = f"coalesce(list_filter(answers, lambda a: length({q.strip(inner)}) > 0)[1], '')"
    stage = "CASE WHEN lower({s}) IN ('search', 'answer') THEN lower({s}) ELSE 'answer' END".format(s=q.strip("coalesce(action_type, '')"))
    variance = "count(*) AS group_count, count(*) FILTER (r > 1e-9) AS variable_group_count, round(count(*) FILTER (r > 1e-9) / count(*), 6) AS variable_group_rate, round(avg(r), 6) AS avg_score_range"
    ranged = lambda by: f"(SELECT {by} source_id, round(max(score) - min(score), 6) AS r FROM {_DUMP} GROUP BY ALL HAVING count(*) > 1)"
    slug = lambda x: f"trim(regexp_replace({x}, '[^A-Za-z0-9]+', ' ', 'g'))"
    return {
        "sft_rows": f"{episodes} SELECT id, 'system: ' || {quoted(exports.AGENT_PROMPT)} || chr(10) || 'user: ' || coalesce(question, '') || chr(10) || 'assistant: ' || trace AS messages, search_count, array_to_string(docs, '|') AS retrieved_doc_ids FROM t",
        "grpo_rollouts": f"{episodes} SELECT id, coalesce(question, '') AS prompt, trace AS response, CAST(total AS DOUBLE) AS reward, {gold} AS answer FROM t",
        "sft_warmup": f"{_SUPPORTED} SELECT id, 'system: ' || {quoted(exports.AGENT_PROMPT)} || chr(10) || 'user: ' || question || chr(10) || 'assistant: ' || {warm} AS messages, answer, CAST(len(ev) AS BIGINT) AS n_evidence FROM w WHERE supported",
        "sft_turns": f"{_SUPPORTED} SELECT id, {four} || chr(10) || 'assistant: <answer>' || answer || '</answer>' AS messages, answer, array_to_string(list_transform(ev, lambda p: p.doc_id), '|') AS gold_evidence_doc_ids FROM w WHERE supported",
        "sft_turn_rates": f"{_SUPPORTED} SELECT count(*) AS examples, count(*) FILTER (supported) AS sft_rows, round(avg(CASE WHEN answer <> '' THEN 1.0 ELSE 0.0 END), 6) AS non_empty_answer_rate, round(avg(CASE WHEN n_gold > 0 AND len(ev) = n_gold THEN 1.0 ELSE 0.0 END), 6) AS gold_evidence_coverage, round(avg(len(ev)), 6) AS avg_gold_evidence_count FROM w",
        "gold_evidence_join": f"""WITH qa AS {_FIRST_QA}, ix AS (SELECT DISTINCT doc_id FROM passages WHERE doc_id IS NOT NULL)
            SELECT qa.id, CAST(coalesce(len(gold_doc_ids), 0) AS BIGINT) AS n_gold, CAST(coalesce(n, 0) AS BIGINT) AS n_found FROM qa LEFT JOIN
            (SELECT id, count(*) AS n FROM (SELECT id, unnest(gold_doc_ids) AS doc_id FROM qa) g JOIN ix USING (doc_id) GROUP BY id) f ON qa.id = f.id""",
        "sft_stage_prompts": f"""{_SUPPORTED} SELECT id, 'search' AS stage, {two} AS prompt, '<search>' || question || '</search>' AS expected_action FROM w WHERE supported
            UNION ALL SELECT id, 'answer', {four}, '<answer>' || answer || '</answer>' FROM w WHERE supported""",
        "trainer_rows": f"""{_SUPPORTED} SELECT id || '::search' AS row_id, id AS source_id, 'search' AS reward_stage, CAST(2 AS BIGINT) AS n_messages, '' AS ground_truth, CAST(1 AS BIGINT) AS search_count FROM w WHERE supported
            UNION ALL SELECT id || '::answer', id, 'answer', 4, answer, 0 FROM w WHERE supported""",
        "rollout_trainer_rows": f"SELECT rollout_id, 'system: ' || {quoted(exports.AGENT_PROMPT)} || chr(10) || 'user: ' || coalesce(prompt, '') AS prompt, coalesce(metadata.answer, '') AS ground_truth, coalesce(reward, 0.0) AS reward, CAST(coalesce(metadata.search_count, 0) AS BIGINT) AS search_count FROM rollouts_for_grpo",
        "transition_trainer_rows": f"SELECT row_id, coalesce(transition_id, '') AS id, split_part(coalesce(transition_id, ''), ':', 1) AS source_id, {stage} AS reward_stage, coalesce(reward, 0.0) AS reward, CAST(CASE WHEN {stage} = 'search' THEN 1 ELSE 0 END AS BIGINT) AS search_count FROM (SELECT DISTINCT row_id, transition_id, question_id, state, action_type, reward FROM transitions)",
        "probe_requests": f"SELECT row_id, 'system: ' || {quoted(exports.PROBE_PROMPT)} || chr(10) || 'user: ' || coalesce(state, '') AS prompt FROM (SELECT DISTINCT row_id, state, action_type FROM transitions) WHERE {stage} = 'search'",
        "train_val_prefix": "SELECT rollout_id, CASE WHEN n <= 100 THEN 'train' ELSE 'val' END AS split FROM (SELECT rollout_id, row_number() OVER (ORDER BY rollout_id) AS n FROM rollouts_for_grpo) WHERE n <= 120",
        "reward_variance_groups": f"SELECT * FROM {_GROUPS}",
        "variance_selected_sources": f"SELECT * FROM {_CHOSEN}",
        "variance_filter": f"SELECT source_id, count(*) AS n, round(sum(score), 6) AS score_sum FROM {_DUMP} WHERE source_id IN (SELECT source_id FROM {_CHOSEN}) GROUP BY source_id",
        "unmatched_sources": "SELECT DISTINCT question_id FROM episode_traces WHERE question_id IS NOT NULL AND question_id NOT IN (SELECT question_id FROM transitions WHERE question_id IS NOT NULL)",
        "group_score_variance": f"SELECT stage, {variance} FROM {ranged('stage,')} GROUP BY stage UNION ALL SELECT 'overall', {variance} FROM {ranged('')}",
        "best_candidates": f"SELECT request_index, action_key, sample_index, score, action_type FROM {_BEST}",
        "preference_pairs": f"SELECT pair_id, request_index, stage, place, chosen_score, rejected_score, score_gap, pair_category FROM {_PAIRS}",
        "pair_category_counts": f"SELECT pair_category, count(*) AS n FROM {_PAIRS} GROUP BY pair_category",
        "stage_caps": f"SELECT pair_id, stage FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY request_index, place) AS n FROM {_PAIRS}) WHERE stage <> 'search' OR n <= 10",
        "train_val_split": f"""WITH p AS MATERIALIZED (SELECT pair_id FROM {_PAIRS}), n AS (SELECT CAST(least(count(*) - 1, round_even(count(*) * 0.05, 0)) AS BIGINT) AS n_val FROM p),
            r AS (SELECT pair_id, row_number() OVER (ORDER BY md5('3:' || pair_id), pair_id) AS i FROM p) SELECT pair_id, i <= n_val AS is_val FROM r, n""",
        "filtered_pairs": f"SELECT pair_id, pair_category FROM {_PAIRS} WHERE pair_category IN ('search_vs_search', 'answer_vs_invalid')",
        "resume_by_id": "SELECT id, topic FROM (SELECT 'syn-' || lpad(CAST(i AS VARCHAR), 6, '0') AS id, ['river locks', 'glass lenses', 'salt trade'][i % 3 + 1] AS topic FROM range(500) t(i)) WHERE id NOT IN (SELECT 'syn-' || lpad(CAST(event_id AS VARCHAR), CAST(greatest(6, length(CAST(event_id AS VARCHAR))) AS INTEGER), '0') FROM events WHERE event_id % 3 = 0)",
        "position_slice": "SELECT rollout_id, pos FROM (SELECT rollout_id, row_number() OVER (ORDER BY rollout_id) - 1 AS pos FROM rollouts_for_grpo WHERE contains(response, '<search>')) WHERE pos >= 10 AND pos < 30",
        "task_generation": f"""SELECT id, 'Which archive stores the institute associated with ' || {slug('topic')} || ' Researcher?' AS question, {slug('topic')} || ' Archive' AS answer, topic
            FROM (SELECT 'syn-' || lpad(CAST(i + 7 AS VARCHAR), 6, '0') AS id, ['river locks', 'glass-lenses', 'salt trade'][i % 3 + 1] AS topic FROM range(50) t(i))""",
    }
