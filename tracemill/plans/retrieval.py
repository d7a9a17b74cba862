"""Queries on texts, actions, answers and lexical ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import actions, text
from tracemill.operators import lexical
from tracemill.plans import sqltext as q
from tracemill.session import table

TOP_K = 5
#: Searches ask with every row whose id is divisible by this, against all rows.
QUERY_STEP = 100


def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").select("doc_id", text.tokenize(text.text("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.try_element_at("t", F.lit(1)).alias("first_token"))


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return lexical.document_frequency(lexical.postings(docs, ["doc_id"], F.col("text")))


def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    corpus = table(spark, d, "passages").select("passage_id", "title", "text")
    asked = corpus.where(F.col("passage_id") % QUERY_STEP == 0).select(F.col("passage_id").alias("query_id"), "title")
    return lexical.rank(asked, corpus, TOP_K, "query_id", text.text("title"), "passage_id", lexical.passage_text(F.col("title"), F.col("text")))


def _examples(spark: SparkSession, d: str) -> DataFrame:
    """One row for each example id: repeated deliveries have the same content, the first one counts."""
    rows = table(spark, d, "qa_examples").select("id", "question", "answers", "gold_doc_ids", "corpus", "created_at")
    first = rows.groupBy("id").agg(F.min_by(F.struct("question", "answers", "gold_doc_ids", "corpus"), "created_at").alias("r"))
    return first.select("id", "r.*")


def _own_hits(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(examples, hits): each question ranked against the passages of its own corpus."""
    examples = _examples(spark, d)
    pool = examples.select("id", F.posexplode("corpus").alias("pos", "p")).where("p is not null").select("id", "pos", F.col("p.doc_id").alias("doc_id"), F.col("p.title").alias("title"), F.col("p.text").alias("body"))
    asked = examples.select("id", F.lit(0).alias("query_id"), "question")
    hits = lexical.rank(asked, pool, k, "query_id", actions.rewrite_query(text.text("question")), "pos", lexical.passage_text(F.col("title"), F.col("body")), ["id"])
    return examples, hits.join(pool, ["id", "pos"]).select("id", "rank", "pos", "doc_id", "title", "body", "score")


_FIRST_QA = "(SELECT * FROM qa_examples QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)"
_QA_QUERIES = "(SELECT id, 0 AS qid, CASE WHEN contains(lower(coalesce(question, '')), 'birthplace') THEN question || ' born city' ELSE coalesce(question, '') END AS qtext FROM qa)"
_QA_POOL = "(SELECT id, did, p.doc_id AS doc_id, concat_ws(' ', coalesce(p.title, ''), coalesce(p.text, '')) AS dtext, p.title AS title, p.text AS body FROM (SELECT id, unnest(corpus) AS p, unnest(range(0, len(corpus))) AS did FROM qa) WHERE p IS NOT NULL)"


def _qa_hits_sql(k: int) -> str:
    return f"WITH qa AS {_FIRST_QA}, hits AS (SELECT h.id, h.rank, h.did AS pos, p.doc_id, p.title, p.body, h.score FROM ({q.lexical(_QA_QUERIES, _QA_POOL, k, 'id')}) h JOIN {_QA_POOL} p ON h.id = p.id AND h.did = p.did)"


def rule_retrieval(spark: SparkSession, d: str) -> DataFrame:
    _, hits = _own_hits(spark, d, 2)
    return hits.select("id", "rank", "doc_id", "score")


def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    examples, hits = _own_hits(spark, d, 2)
    got = hits.groupBy("id").agg(F.collect_set("doc_id").alias("got"), F.count("*").alias("n"))
    per = examples.join(got, "id", "left").select(
        F.array_distinct(F.coalesce("gold_doc_ids", F.array().cast("array<string>"))).alias("gold"), F.coalesce("got", F.array().cast("array<string>")).alias("got"), F.coalesce("n", F.lit(0)).alias("n")
    )
    hit = F.size(F.array_intersect("gold", "got"))
    recall = F.when(F.size("gold") > 0, hit / F.size("gold")).otherwise(0.0)
    return per.agg(F.count("*").alias("examples"), F.round(F.avg(F.when(hit > 0, 1.0).otherwise(0.0)), 6).alias("hit_rate_at_2"), F.round(F.avg(recall), 6).alias("recall_at_2"), F.round(F.avg("n"), 6).alias("avg_retrieved"))


def evidence_rank_reward(spark: SparkSession, d: str) -> DataFrame:
    examples, hits = _own_hits(spark, d, 8)
    gold = examples.select("id", F.explode(F.array_distinct("gold_doc_ids")).alias("doc_id")).where("doc_id is not null")
    best = hits.groupBy("id", "doc_id").agg(F.max("rank").alias("rank"))
    per = gold.join(best, ["id", "doc_id"], "left")
    reward = F.coalesce(lexical.rank_reward(F.col("rank")), F.lit(0.0))
    return per.groupBy("id").agg(F.round(F.avg(reward), 6).alias("evidence_rank_reward"), F.coalesce(F.min("rank"), F.lit(0)).cast("double").alias("gold_top_rank"), F.count("rank").cast("double").alias("retrieved_gold_count"))


def rule_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episode, reward parts and total of each example by the rule-based agent."""
    return episode_rewards(*_own_hits(spark, d, TOP_K))


def episode_rewards(examples: DataFrame, hits: DataFrame) -> DataFrame:
    """The two-step episode of each example (search, then the first listed answer that the passages hold) with
    its reward: answer + 0.2 evidence + 0.1 format + 0.1 tool - 0.03 a search."""
    seen = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "title", "body"))).alias("o"))
    one = examples.join(seen, "id", "left").withColumn("o", F.coalesce("o", F.array().cast("array<struct<rank:bigint,doc_id:string,title:string,body:string>>")))
    evidence_text = F.lower(F.array_join(F.transform("o", lambda p: text.text(p["body"])), " "))
    found = F.filter(F.coalesce("answers", F.array().cast("array<string>")), lambda a: a.isNotNull() & F.col("evidence_text").contains(F.lower(a)))
    query = actions.rewrite_query(text.text("question"))
    one = one.withColumn("evidence_text", evidence_text).withColumn("final_answer", F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))).withColumn("query", query)
    gold = F.coalesce("gold_doc_ids", F.array().cast("array<string>"))
    answers = F.transform(F.coalesce("answers", F.array().cast("array<string>")), lambda a: text.plain(text.text(a)))
    answer = F.when(F.array_contains(answers, text.plain(F.col("final_answer"))), 1.0).otherwise(0.0)
    # set hits over the length of the list: repeated gold ids lower the share
    evidence = F.when(F.size(gold) > 0, F.size(F.array_intersect(gold, F.transform("o", lambda p: p["doc_id"]))) / F.size(gold)).otherwise(0.0)
    tool = F.when(F.length(text.strip(F.col("query"))) > 0, 1.0).otherwise(0.0)
    total = F.round(F.col("answer_reward") + 0.2 * F.col("evidence_reward") + 0.1 * F.lit(1.0) + 0.1 * F.col("tool_validity_reward") - 0.03 * F.col("search_count"), 6)
    wide = one.select("id", "question", "query", "answers", "gold_doc_ids", "final_answer", F.transform("o", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["title"].alias("title"), p["body"].alias("text"))).alias("observation"), answer.alias("answer_reward"), evidence.alias("evidence_reward"), F.lit(1.0).alias("format_reward"), tool.alias("tool_validity_reward"), F.lit(1).cast("long").alias("search_count"))
    return wide.withColumn("total", total)


def episode_reward(spark: SparkSession, d: str) -> DataFrame:
    return rule_episodes(spark, d).select("id", "final_answer", "answer_reward", F.round("evidence_reward", 6).alias("evidence_reward"), "tool_validity_reward", "search_count", "total")


def trace_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = rule_episodes(spark, d)
    mean = lambda c, n: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n)
    return e.agg(mean("answer_reward", "answer_em"), mean("evidence_reward", "evidence_recall"), mean("search_count", "avg_search_calls"), mean("total", "avg_reward"))


def episode_transitions(spark: SparkSession, d: str) -> DataFrame:
    """The steps of the episodes; only the last one has the reward."""
    e = rule_episodes(spark, d)
    step = lambda i, kind, action, terminal, reward: F.struct(F.lit(i).alias("step_index"), action.alias("action"), F.lit(kind).alias("action_type"), F.lit(terminal).alias("terminal"), reward.alias("reward"))
    steps = F.array(
        step(0, "search", F.concat(F.lit("<search>"), "query", F.lit("</search>")), False, F.lit(None).cast("double")),
        step(1, "answer", F.concat(F.lit("<answer>"), "final_answer", F.lit("</answer>")), True, F.col("total")),
    )
    return e.select("id", F.explode(steps).alias("s")).select("id", F.concat_ws(":", "id", F.col("s.step_index").cast("string"), "s.action_type").alias("transition_id"), F.col("s.step_index").cast("long").alias("step_index"), "s.action", "s.action_type", "s.terminal", "s.reward")


_EPISODES = f"""{_qa_hits_sql(TOP_K)},
    seen AS (SELECT id, list(doc_id ORDER BY rank) AS docs, lower(string_agg(coalesce(body, ''), ' ' ORDER BY rank)) AS body FROM hits GROUP BY id),
    e0 AS (SELECT qa.id, qa.question, coalesce(answers, []) AS answers, coalesce(gold_doc_ids, []) AS gold, coalesce(docs, []) AS docs,
        coalesce(list_filter(coalesce(answers, []), lambda a: a IS NOT NULL AND contains(coalesce(body, ''), lower(a)))[1], '') AS final_answer,
        CASE WHEN contains(lower(coalesce(question, '')), 'birthplace') THEN question || ' born city' ELSE coalesce(question, '') END AS query
        FROM qa LEFT JOIN seen ON qa.id = seen.id),
    e1 AS (SELECT *, CASE WHEN list_contains(list_transform(answers, lambda a: {q.plain("coalesce(a, '')")}), {q.plain('final_answer')}) THEN 1.0 ELSE 0.0 END AS answer_reward,
        CASE WHEN len(gold) > 0 THEN len(list_intersect(gold, docs)) / len(gold) ELSE 0.0 END AS evidence_reward,
        CASE WHEN length({q.strip('query')}) > 0 THEN 1.0 ELSE 0.0 END AS tool_validity_reward, CAST(1 AS BIGINT) AS search_count FROM e0),
    e AS (SELECT *, round(answer_reward + 0.2 * evidence_reward + 0.1 + 0.1 * tool_validity_reward - 0.03 * search_count, 6) AS total FROM e1)"""


def query_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return _examples(spark, d).select("id", actions.rewrite_query(text.text("question")).alias("query"))


def corpus_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """The first passage of each document id; a hot id is folded by partial minima before the shuffle."""
    rows = table(spark, d, "passages").where("doc_id is not null")
    first = rows.groupBy("doc_id").agg(F.min(F.struct("passage_id", "title", "source")).alias("r"))
    return first.select("doc_id", "r.passage_id", "r.title", "r.source")


def last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each transition id."""
    rows = table(spark, d, "transitions").where("transition_id is not null")
    last = rows.groupBy("transition_id").agg(F.max(F.struct("ingested_at", "row_id", "action_type", "reward")).alias("r"))
    return last.select("transition_id", "r.row_id", "r.action_type", "r.reward")


def duplicate_excess(spark: SparkSession, d: str) -> DataFrame:
    """By how many rows the different questions, answers and titles are exceeded."""
    e = _examples(spark, d)
    question = e.select(F.lit("question").alias("what"), text.folded(text.text("question")).alias("v"))
    answer = e.select(F.lit("answer").alias("what"), text.folded(text.text(F.try_element_at("answers", F.lit(1)))).alias("v"))
    title = e.select(F.lit("title").alias("what"), F.explode("corpus.title").alias("t")).select("what", text.folded(text.text("t")).alias("v"))
    counts = question.union(answer).union(title).groupBy("what", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("what").agg(F.sum(F.col("n") - 1).alias("excess"))


def _actions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transitions").select("row_id", "action").distinct()


def parse_action_strict(spark: SparkSession, d: str) -> DataFrame:
    a = actions.parse_action(F.col("action"))
    return _actions(spark, d).withColumn("a", a).select("row_id", F.col("a.type").alias("action_type"), "a.content", "a.valid")


def parse_agent_action(spark: SparkSession, d: str) -> DataFrame:
    a = actions.parse_agent_action(F.col("action"))
    return _actions(spark, d).withColumn("a", a).select("row_id", F.col("a.type").alias("action_type"), "a.valid", "a.query", "a.answer", "a.reason", actions.action_key(F.col("action"), F.col("a")).alias("action_key"))


def extract_answer_ci(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rollouts_for_grpo").select("rollout_id", actions.extract_answer(F.col("response")).alias("answer"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rollouts_for_grpo").select("rollout_id", "source", "final_answer", F.col("metadata.answer").alias("gold"))
    return rows.withColumn("s", text.answer_scores(F.col("final_answer"), F.col("gold")))


def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("rollout_id", text.normalize_answer(F.col("final_answer")).alias("normalized"), "s.exact_match", "s.token_f1", "s.containment_match")


def soft_answer_reward(spark: SparkSession, d: str) -> DataFrame:
    r = _answers(spark, d).withColumn("r", text.soft_answer_reward(F.col("s")))
    return r.select("rollout_id", "r.answer_reward", "r.answer_reward_type")


def stage_scores(spark: SparkSession, d: str) -> DataFrame:
    """Answer-stage score: soft reward of the extracted answer, 0.1 for the format, minus 0.03 a search."""
    rows = table(spark, d, "rollouts_for_grpo").select("rollout_id", actions.extract_answer(F.col("response")).alias("a"), F.col("metadata.answer").alias("gold"), F.coalesce(F.col("metadata.search_count"), F.lit(0)).alias("n"))
    s = rows.withColumn("r", text.soft_answer_reward(text.answer_scores(text.text("a"), F.col("gold"))))
    reward = F.when(F.col("a").isNotNull(), F.col("r.answer_reward")).otherwise(0.0)
    shape = F.when(F.col("a").isNotNull(), 1.0).otherwise(0.0)
    return s.select("rollout_id", reward.alias("answer_reward"), shape.alias("format_reward"), F.round(0.03 * F.col("n"), 6).alias("search_cost"), F.round(reward + 0.1 * shape - 0.03 * F.col("n"), 6).alias("score"))


def format_observation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transitions").select("row_id", "observation").where("observation is not null").distinct().select("row_id", actions.observation_text(F.col("observation")).alias("observation_text"))


def observation_titles(spark: SparkSession, d: str) -> DataFrame:
    titles = actions.observation_titles(F.col("response"))
    return table(spark, d, "rollouts_for_grpo").select("rollout_id", F.size(titles).cast("long").alias("n_titles"), F.array_join(titles, "|").alias("titles"))


def array_set_ops(spark: SparkSession, d: str) -> DataFrame:
    a, b = text.tokenize(text.text("prompt")), text.tokenize(text.text("final_answer"))
    rows = table(spark, d, "rollouts_for_grpo").select("rollout_id", a.alias("a"), b.alias("b"))
    size = lambda c: F.size(c).cast("long")
    return rows.select("rollout_id", size(F.array_intersect("a", "b")).alias("both"), size(F.array_except("a", "b")).alias("only_prompt"), size(F.array_union("a", "b")).alias("either"), text.overlap(F.col("a"), F.col("b")).cast("long").alias("multiset"), F.array_join(F.array_distinct("a"), " ").alias("ordered"))


def retrieved_doc_ids(spark: SparkSession, d: str) -> DataFrame:
    """Document ids seen in the search steps of a trace, in order (nested steps flattened)."""
    steps = F.filter("steps", lambda s: s["action_type"] == "search")
    ids = F.flatten(F.transform(steps, lambda s: F.coalesce(F.transform(s["observation"], lambda p: p["doc_id"]), F.array().cast("array<string>"))))
    rows = table(spark, d, "episode_traces").select("trace_id", ids.alias("ids")).distinct()
    return rows.select("trace_id", F.coalesce(F.array_join("ids", "|"), F.lit("")).alias("doc_ids"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [tokenize_stats, document_frequency, lexical_topk, rule_retrieval, retrieval_eval, evidence_rank_reward, episode_reward, trace_metrics, episode_transitions, query_rewrite, corpus_first_wins, last_wins, duplicate_excess, parse_action_strict, parse_agent_action, extract_answer_ci, answer_scores, soft_answer_reward, stage_scores, format_observation, observation_titles, array_set_ops, retrieved_doc_ids]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    tok = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')".format
    scored = q.scored("final_answer", "metadata.answer", "rollouts_for_grpo", "rollout_id")
    first = "regexp_extract(response, '(?is)<answer>(.*?)</answer>', 1)"
    extracted = f"(SELECT rollout_id, metadata.answer AS gold, coalesce(metadata.search_count, 0) AS n, CASE WHEN regexp_matches(coalesce(response, ''), '(?is)<answer>(.*?)</answer>') THEN {q.strip(first)} END AS a FROM rollouts_for_grpo)"
    acts = q.agent_action("action", "(SELECT DISTINCT row_id, action FROM transitions)", "row_id, action")
    obs = "string_agg('[' || i || '] ' || CASE WHEN coalesce(p.title, '') <> '' THEN p.title || ': ' ELSE '' END || coalesce(p.text, ''), chr(10) ORDER BY i)"
    return {
        "tokenize_stats": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms, t[1] AS first_token FROM (SELECT doc_id, {tok('text')} AS t FROM documents)",
        "document_frequency": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({tok('text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term",
        "lexical_topk": "SELECT qid AS query_id, did AS passage_id, score, rank FROM ("
        + q.lexical("(SELECT passage_id AS qid, coalesce(title, '') AS qtext FROM passages WHERE passage_id % 100 = 0)", "(SELECT passage_id AS did, concat_ws(' ', coalesce(title, ''), coalesce(text, '')) AS dtext FROM passages)", TOP_K)
        + ")",
        "rule_retrieval": f"{_qa_hits_sql(2)} SELECT id, rank, doc_id, score FROM hits",
        "retrieval_eval": f"""{_qa_hits_sql(2)}, per AS (SELECT list_distinct(coalesce(gold_doc_ids, [])) AS gold, coalesce(got, []) AS got, coalesce(n, 0) AS n
            FROM qa LEFT JOIN (SELECT id, list(DISTINCT doc_id) AS got, count(*) AS n FROM hits GROUP BY id) h ON qa.id = h.id)
            SELECT count(*) AS examples, round(avg(CASE WHEN len(list_intersect(gold, got)) > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at_2,
            round(avg(CASE WHEN len(gold) > 0 THEN len(list_intersect(gold, got)) / len(gold) ELSE 0.0 END), 6) AS recall_at_2, round(avg(n), 6) AS avg_retrieved FROM per""",
        "evidence_rank_reward": f"""{_qa_hits_sql(8)}, g AS (SELECT id, unnest(list_distinct(gold_doc_ids)) AS doc_id FROM qa), b AS (SELECT id, doc_id, max(rank) AS rank FROM hits GROUP BY ALL)
            SELECT g.id, round(avg(CASE WHEN rank IS NULL THEN 0.0 WHEN rank <= 1 THEN 1.0 WHEN rank <= 3 THEN 0.8 WHEN rank <= 8 THEN 0.5 ELSE 0.0 END), 6) AS evidence_rank_reward,
            CAST(coalesce(min(rank), 0) AS DOUBLE) AS gold_top_rank, CAST(count(rank) AS DOUBLE) AS retrieved_gold_count
            FROM g LEFT JOIN b ON g.id = b.id AND g.doc_id = b.doc_id WHERE g.doc_id IS NOT NULL GROUP BY g.id""",
        "episode_reward": f"{_EPISODES} SELECT id, final_answer, CAST(answer_reward AS DOUBLE) AS answer_reward, round(CAST(evidence_reward AS DOUBLE), 6) AS evidence_reward, CAST(tool_validity_reward AS DOUBLE) AS tool_validity_reward, search_count, CAST(total AS DOUBLE) AS total FROM e",
        "trace_metrics": f"{_EPISODES} SELECT round(avg(answer_reward), 6) AS answer_em, round(avg(evidence_reward), 6) AS evidence_recall, round(avg(search_count), 6) AS avg_search_calls, round(avg(total), 6) AS avg_reward FROM e",
        "episode_transitions": f"""{_EPISODES} SELECT id, id || ':0:search' AS transition_id, CAST(0 AS BIGINT) AS step_index, '<search>' || query || '</search>' AS action, 'search' AS action_type, false AS terminal, CAST(NULL AS DOUBLE) AS reward FROM e
            UNION ALL SELECT id, id || ':1:answer', 1, '<answer>' || final_answer || '</answer>', 'answer', true, CAST(total AS DOUBLE) FROM e""",
        "query_rewrite": f"SELECT id, CASE WHEN contains(lower(coalesce(question, '')), 'birthplace') THEN question || ' born city' ELSE coalesce(question, '') END AS query FROM {_FIRST_QA}",
        "corpus_first_wins": "SELECT doc_id, passage_id, title, source FROM passages WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY passage_id) = 1",
        "last_wins": "SELECT transition_id, row_id, action_type, reward FROM (SELECT DISTINCT transition_id, row_id, action_type, reward, ingested_at FROM transitions) WHERE transition_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY transition_id ORDER BY ingested_at DESC, row_id DESC) = 1",
        "duplicate_excess": f"""WITH qa AS {_FIRST_QA}, v AS (SELECT 'question' AS what, {q.folded("coalesce(question, '')")} AS v FROM qa UNION ALL SELECT 'answer', {q.folded("coalesce(answers[1], '')")} FROM qa
            UNION ALL SELECT 'title', {q.folded("coalesce(p.title, '')")} FROM (SELECT unnest(corpus) AS p FROM qa))
            SELECT what, CAST(sum(n - 1) AS BIGINT) AS excess FROM (SELECT what, v, count(*) AS n FROM v GROUP BY ALL) GROUP BY what""",
        "parse_action_strict": f"""SELECT row_id, coalesce(kind, 'invalid') AS action_type, CASE WHEN kind IS NULL THEN '' ELSE content END AS content, kind IS NOT NULL AND content <> '' AS valid FROM (
            SELECT row_id, CASE {' '.join(f"WHEN regexp_full_match(raw, '(?s){q.SPACE}*<{k}>(.*?)</{k}>{q.SPACE}*') THEN '{k}'" for k in ('think', 'search', 'answer'))} END AS kind,
            {q.strip("regexp_extract(raw, '(?s)^" + q.SPACE + "*<(?:think|search|answer)>(.*)</(?:think|search|answer)>" + q.SPACE + "*$', 1)")} AS content
            FROM (SELECT DISTINCT row_id, coalesce(action, '') AS raw FROM transitions))""",
        "parse_agent_action": f"""SELECT row_id, kind AS action_type, valid, query, answer, reason,
            CASE kind WHEN 'search' THEN 'search:' || {q.plain('query')} WHEN 'answer' THEN 'answer:' || {q.plain('answer')} ELSE 'invalid:' || {q.plain('raw')} END AS action_key FROM {acts}""",
        "extract_answer_ci": f"SELECT rollout_id, a AS answer FROM {extracted}",
        "answer_scores": f"SELECT rollout_id, pn AS normalized, exact AS exact_match, CAST(f1 AS DOUBLE) AS token_f1, containment AS containment_match FROM {scored}",
        "soft_answer_reward": f"SELECT rollout_id, round(CAST({q.LADDER} AS DOUBLE), 6) AS answer_reward, {q.LADDER_KIND} AS answer_reward_type FROM {scored}",
        "stage_scores": f"""SELECT rollout_id, CAST(r AS DOUBLE) AS answer_reward, CAST(f AS DOUBLE) AS format_reward, CAST(round(0.03 * n, 6) AS DOUBLE) AS search_cost, CAST(round(r + 0.1 * f - 0.03 * n, 6) AS DOUBLE) AS score
            FROM (SELECT rollout_id, n, CASE WHEN a IS NULL THEN 0.0 ELSE {q.LADDER} END AS r, CASE WHEN a IS NULL THEN 0.0 ELSE 1.0 END AS f FROM {q.scored('a', 'gold', extracted, 'rollout_id, n, a')})""",
        "format_observation": f"""SELECT row_id, '<observation>' || chr(10) || coalesce(body || chr(10), '') || '</observation>' AS observation_text FROM (
            SELECT DISTINCT row_id, (SELECT {obs} FROM (SELECT unnest(observation) AS p, unnest(range(1, len(observation) + 1)) AS i)) AS body FROM transitions WHERE observation IS NOT NULL)""",
        "observation_titles": f"""SELECT rollout_id, CAST(len(t) AS BIGINT) AS n_titles, array_to_string(t, '|') AS titles FROM (SELECT rollout_id,
            list_transform(regexp_extract_all(coalesce(response, ''), '(?m)^[ \\t]*\\[\\d+\\][ \\t]+([^:\\n]+):', 1), lambda t: {q.strip('t')}) AS t FROM rollouts_for_grpo)""",
        "array_set_ops": f"""SELECT rollout_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS both, CAST(len(list_filter(list_distinct(a), lambda t: NOT list_contains(b, t))) AS BIGINT) AS only_prompt,
            CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS either, CAST({q.overlap('a', 'b')} AS BIGINT) AS multiset,
            array_to_string(list_filter(a, lambda t, i: list_position(a, t) = i), ' ') AS ordered FROM (SELECT rollout_id, {tok('prompt')} AS a, {tok('final_answer')} AS b FROM rollouts_for_grpo)""",
        "retrieved_doc_ids": """SELECT trace_id, array_to_string(ids, '|') AS doc_ids, CAST(len(ids) AS BIGINT) AS n FROM (SELECT DISTINCT trace_id,
            coalesce(flatten(list_transform(list_filter(steps, lambda s: s.action_type = 'search'), lambda s: coalesce(list_transform(s.observation, lambda p: p.doc_id), []))), []) AS ids FROM episode_traces)""",
    }
