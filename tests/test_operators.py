import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.functions import actions
from tracemill.operators import edges, environment, exports, lexical, negatives, report, selection, validation
from tracemill.session import bounded_sample, dense_positions


def test_rank_of_the_example(spark):
    docs = [(0, "Example Book", "written by Alice Smith"), (1, "Alice Smith", "Alice Smith was born in Example City"), (2, "Noise", "nothing here")]
    corpus = spark.createDataFrame(docs, "pos int, title string, body string")
    asked = spark.createDataFrame([(7, "Alice Smith born city")], "q int, question string")
    got = lexical.rank(asked, corpus, 2, "q", F.col("question"), "pos", lexical.passage_text(F.col("title"), F.col("body"))).orderBy("rank").collect()
    assert [r["pos"] for r in got] == [1, 0]


def test_rank_against_brute_force(spark):
    rng = random.Random(1)
    words = ["a1", "b2", "c3", "d4", "e5"]
    docs = [(p, i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for p in range(3) for i in range(12)]
    asked = [(p, 100 + i, " ".join(rng.choice(words) for _ in range(4))) for p in range(3) for i in range(2)]
    got = lexical.rank(spark.createDataFrame(asked, "pool int, q int, t string"), spark.createDataFrame(docs, "pool int, pos int, t string"), 4, "q", F.col("t"), "pos", F.col("t"), ["pool"]).collect()
    want = set()
    for p, q, t in asked:
        own = [(i, d.split()) for pp, i, d in docs if pp == p]
        df = {w: sum(w in d for _, d in own) for w in words}
        scores = sorted((-round(sum((math.log((len(own) + 1) / (df[w] + 1)) + 1) * d.count(w) / len(d) for w in t.split()), 6), i) for i, d in own)
        want |= {(p, q, i, r) for r, (s, i) in enumerate(scores[:4], 1) if s < 0}
    assert {(r["pool"], r["q"], r["pos"], r["rank"]) for r in got} == want


def test_rank_over_one_corpus_in_many_blocks(spark):
    """Common words, copies (ties go to the smaller position), titles alone, nulls and a repeated query."""
    rng = random.Random(3)
    rare = [f"r{i}" for i in range(60)]
    line = lambda: " ".join(rng.choices(["the", "of", "falls", rng.choice(rare)], [6, 4, 2, 2], k=rng.randrange(1, 12)))
    docs = list(enumerate([line() for _ in range(300)] * 3 + ["the falls", "the", "", None, "?!"]))
    rng.shuffle(docs)
    asked = [(i, " ".join(rng.choices(rare + ["the", "of", "falls", "none"] * 9, k=rng.randrange(1, 6)))) for i in range(40)] + [(90, "the falls"), (91, "falls the"), (92, "the the falls"), (93, "none"), (94, ""), (95, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = lexical.rank(spark.createDataFrame(asked, "q int, t string"), spark.createDataFrame(docs, "pos int, t string"), 5, "q", F.col("t"), "pos", F.col("t")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = [(i, re.findall("[a-z0-9]+", d or "")) for i, d in docs]
    df = {w: sum(w in d for _, d in own) for w in [*rare, "the", "of", "falls", "none"]}
    want = set()
    for q, t in asked:
        scores = sorted((-round(sum((math.log((len(own) + 1) / (df[w] + 1)) + 1) * d.count(w) / len(d) for w in (t or "").split()), 6), i) for i, d in own if d)
        want |= {(q, i, r, -s) for r, (s, i) in enumerate(scores[:5], 1) if s < 0}
    assert {(r["q"], r["pos"], r["rank"], r["score"]) for r in got} == want


def test_rank_scores_few_of_the_documents_that_share_a_word():
    """A word of every document makes no pairs of all queries with all documents, and none of the k best is passed over."""
    rng = random.Random(4)
    names = [f"n{i}" for i in range(1000)]
    docs = [["the", *rng.sample(names, 3), *["x"] * rng.randrange(5, 15)] for _ in range(5000)]
    bags = sorted({" ".join(sorted(["the", *rng.sample(names, 2)])) for _ in range(50)})
    terms = sorted({t for bag in bags for t in bag.split(" ")})
    block = lexical.Block(pa.array(docs), pa.array(terms))
    df = np.array([sum(t in d for d in docs) for t in terms])
    kth = np.array([sorted((d.count(t) / len(d) for d in docs if t in d), reverse=True)[:5][-1] for t in terms])
    asked = lexical.Asked(bags, terms, np.log((len(docs) + 1.0) / (df + 1.0)) + 1.0, df, kth, 5)
    query, document = asked.candidates(block, asked.bound)
    assert len(query) < len(bags) * len(docs) / 50
    every = asked.scores(block, np.repeat(np.arange(len(bags)), len(docs)), np.tile(np.arange(len(docs)), len(bags))).reshape(len(bags), len(docs))
    few = np.zeros_like(every)
    few[query, document] = asked.scores(block, query, document)
    assert np.array_equal(np.sort(few, axis=1)[:, -5:], np.sort(every, axis=1)[:, -5:])


def test_pairs_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(g, i, round(rng.choice([0.0, 0.25, 0.5, 0.75, 1.0]), 2)) for g in range(6) for i in range(rng.randrange(1, 12))]
    got = selection.pairs(spark.createDataFrame(rows, "request_index int, sample_index int, score double"), 0.25, 3).collect()
    want = set()
    for g in range(6):
        own = [(s, i) for gg, i, s in rows if gg == g]
        if len(own) >= 2:
            met = [(-round(a - b, 6), -a, b, i, j) for (a, i), (b, j) in itertools.permutations(own, 2) if round(a - b, 6) >= 0.25]
            want |= {(g, i, j) for _, _, _, i, j in sorted(met)[:3]}
    assert {(r["request_index"], r["c"]["sample_index"], r["r"]["sample_index"]) for r in got} == want


def test_equal_actions_collapse(spark):
    rows = [(0, 0, "<search>a  b</search>", 0.1), (0, 1, "<search>A b </search>", 1.0), (0, 2, "<answer>x</answer>", 0.1)]
    df = spark.createDataFrame(rows, "request_index int, sample_index int, solution string, score double")
    df = df.withColumn("action_key", actions.action_key(F.col("solution"), actions.parse_agent_action(F.col("solution"))))
    got = selection.pairs(selection.best_per_action(df), 0.25, 5).collect()
    assert [(r["c"]["sample_index"], r["r"]["sample_index"], r["score_gap"]) for r in got] == [(1, 2, 0.9)]


def test_variance_groups(spark):
    rows = [("answer", "a", 0.1), ("answer", "a", 1.0), ("search", "b", 0.5), ("search", "b", 0.5), ("search", "c", 0.0), ("search", "c", 0.4), ("answer", "d", 1.0), ("answer", None, 3.0), ("answer", " ", 3.0)]
    df = spark.createDataFrame(rows, "stage string, source_id string, score double")
    groups = selection.variable_groups(df)
    assert {r["source_id"] for r in groups.collect()} == {"a", "c"}
    assert [r["source_id"] for r in selection.ranked_sources(groups, 1).collect()] == ["a"]
    rate = selection.group_score_variance(df).first()
    assert (rate["group_count"], rate["variable_group_count"], rate["variable_group_rate"]) == (3, 2, 0.666667)


def test_hash_split_counts(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    for fraction, n in ((0.05, 50), (0.0, 0), (1.0, 999), (0.0025, 2)):
        assert selection.hash_split(df, "k", fraction).where("is_val").count() == n
    assert selection.hash_split(df, "k", 0.05, most=3).where("is_val").exceptAll(selection.hash_split(df, "k", 0.05).where("is_val")).count() == 0
    assert selection.hash_split(df.limit(0), "k", 0.5).count() == 0


def test_hash_split_keeps_the_rows_of_a_key_together(spark):
    df = spark.range(300).select((F.col("id") % 40).cast("string").alias("k")).unionByName(spark.sql("select cast(null as string) as k"))
    sides = selection.hash_split(df, "k", 0.3).groupBy("k").agg(F.collect_set("is_val").alias("s"), F.count("*").alias("n")).collect()
    assert sum(r["s"] == [True] for r in sides) == 12 and all(len(r["s"]) == 1 for r in sides) and sum(r["n"] for r in sides) == 301


def test_stage_caps(spark):
    df = spark.createDataFrame([("search", i) for i in range(5)] + [("answer", i) for i in range(4)] + [(None, 9)], "stage string, i int")
    assert selection.stage_caps(df, {"answer": 1}, ["i"]).count() == 7
    assert selection.stage_caps(df, {}, ["i"]).count() == 10


def test_negatives_of_a_row(spark):
    row = [("r1", "Alice Smith born city", "Where was Alice Smith born in the city?", "Example City", ["d1"], [("d1", "Alice Smith", "Alice Smith was born in Example City"), ("d2", "Noise Title", "nothing at all"), ("d3", "Other", "more related evidence")])]
    df = spark.createDataFrame(row, "id string, query string, question string, answer string, gold array<string>, passages array<struct<doc_id:string,title:string,text:string>>")
    tried = {r["corruption_type"]: r["query"] for r in negatives.negative_queries(df).collect()}
    assert tried["chosen"] == "Alice Smith born city" and tried["distractor_title"] == "Noise Title" and tried["gold_title_only"] == "Alice Smith"
    assert tried["answer_only"] == "Example City" and tried["entity_dropout"] == "born city" and tried["question_keywords"] == "was Alice Smith born"
    pairs = negatives.negative_pairs(df).collect()
    assert all(r["chosen_score"] == 1.07 and r["score_gap"] >= 0.05 for r in pairs) and {r["corruption_type"] for r in pairs} >= {"generic", "distractor_title"}


def test_drop_phrase_without_a_match(spark):
    got = spark.range(1).select(negatives.drop_phrase(F.lit("one two three four"), F.array(F.lit("x.*"), F.lit(""))).alias("a"), negatives.drop_phrase(F.lit("Tide of Y (b)"), F.array(F.lit("y (B)"))).alias("b"), negatives.entity_like(F.lit("what about it")).alias("c")).first()
    assert tuple(got) == ("one two", "Tide of", "what")


def test_candidate_pool_against_brute_force(spark):
    docs = [f"d{i:02d}" for i in range(17)]
    rows = [("ab", ["d03", "d16", "zz"]), ("zzz", []), ("q", ["d00", "d01", "d00"]), ("all", docs)]
    corpus = spark.createDataFrame([(x, i * 10) for i, x in enumerate(docs)], "doc_id string, pos int")
    got = environment.candidate_pool(spark.createDataFrame(rows, "id string, gold array<string>"), corpus, 5).collect()
    for key, gold in rows:
        rest = [x for x in docs if x not in gold]
        start = sum(map(ord, key)) % len(rest) if rest else 0
        want = [x for x in gold if x in docs] + (rest[start:] + rest[:start])[:5]
        assert [r["doc_id"] for r in sorted((r for r in got if r["id"] == key), key=lambda r: r["place"])] == want


def test_positions_and_samples(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = sorted((r["k"], r["pos"]) for r in dense_positions(df, "k").collect())
    assert [p for _, p in got] == list(range(5000))
    assert bounded_sample(df, "k", 100).count() == 100 and bounded_sample(df, "k", 10_000).count() == 5000


def test_batches_align_with_steps(spark):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate([0.1, 0.5, 0.9, 0.3, 0.2])], "pos long, reward double")
    b = report.batches(rows, "reward", 2, 0.2)
    got = {r["step"]: (r["batch_index"], r["row_start"], r["row_end_exclusive"], r["mean_reward"]) for r in report.align_steps(spark.range(1, 6).toDF("step"), b).collect()}
    assert got[1] == (0, 0, 2, 0.3) and got[3] == (2, 4, 5, 0.2) and got[4][0] == 0
    with pytest.raises(ValueError):
        report.batches(rows, "reward", 0, 0.2)


def test_suspicious_answers(spark):
    rows = [("Which institute did it?", "Alpha Institute", "Beta", ["Gamma"]), ("Who?", "Gamma", "Beta", ["gamma"]), ("Who?", "Beta", "Beta", ["Beta"])]
    got = report.answer_diagnostics(spark.createDataFrame(rows, "question string, prediction string, gold string, titles array<string>")).collect()
    assert [r["reasons"] for r in got] == [["question_gold_type_mismatch"], ["prediction_matches_observation_title"], []]


def test_tensors(spark):
    a = spark.createDataFrame([("same", [1.0, 2.0]), ("changed", [3.0, 4.0])], "name string, values array<double>")
    b = spark.createDataFrame([("same", [1.0, 2.0]), ("changed", [3.0, 5.0])], "name string, values array<double>")
    got = {r["name"]: r for r in report.tensor_diff(a, b, "name").collect()}
    assert got["same"]["changed"] == 0 and (got["changed"]["l2"], got["changed"]["relative_l2"], got["changed"]["max_abs"]) == (1.0, 0.2, 1.0)


VALID = ("syn-1", "Which archive keeps the notes of the first?", ["Archive X"], [("A One", ["A One worked with B Two."]), ("B Two", ["B Two keeps notes in Archive X.", "More."])], [("A One", 0), ("B Two", 0)], ("A One", "0", "B Two", "B Two", "0", "archive", "Archive X"))
SYNTHETIC = "row_id string, question string, answers array<string>, entries array<struct<title:string,sentences:array<string>>>, facts array<struct<title:string,sent:int>>, chain struct<hop1_title:string,hop1_sentence_index:string,intermediate_entity:string,hop2_title:string,hop2_sentence_index:string,answer_type:string,final_answer:string>"


def changed(**values):
    names = ["row_id", "question", "answers", "entries", "facts", "chain"]
    return tuple(values.get(n, v) for n, v in zip(names, VALID))


@pytest.mark.parametrize(
    "row,reason",
    [
        (VALID, None),
        (changed(row_id=" "), "missing id"),
        (changed(question=None), "missing question"),
        (changed(question="Où ?"), "non-ascii text detected"),
        (changed(answers=[" "]), "missing answer text"),
        (changed(entries=[]), "context has no sentences"),
        (changed(facts=[("A One", 0)]), "supporting_facts must contain at least two facts"),
        (changed(facts=[("A One", 0), ("A One", 0)]), "supporting_facts must cover at least two titles"),
        (changed(facts=[("A One", 0), ("B Two", 7)]), "supporting fact missing from context: B Two:7"),
        (changed(chain=None), "missing chain_schema"),
        (changed(chain=("A One", "0", "B Two", "B Two", "0", "", "Archive X")), "chain_schema missing answer_type"),
        (changed(chain=("A One", "x", "B Two", "B Two", "0", "t", "Archive X")), "chain_schema sentence indexes must be integers"),
        (changed(chain=("B Two", "0", "B Two", "A One", "0", "t", "Archive X")), "chain_schema does not match supporting_facts"),
        (changed(chain=("A One", "0", "Nobody", "B Two", "0", "t", "Archive X")), "intermediate entity missing from hop1"),
        (changed(chain=("A One", "0", "B Two", "B Two", "0", "t", "Other")), "chain_schema final_answer does not match answer"),
        (changed(question="Is it Archive X?"), "answer appears in question"),
    ],
)
def test_validation_ladder(spark, row, reason):
    assert validation.validate(spark.createDataFrame([row], SYNTHETIC), "chain").first()["reason"] == reason


def test_chain_repair(spark):
    bad = changed(chain=("A One", "0", "Nobody", "B Two", "0", "t", "Archive X"))
    other = changed(row_id="syn-2", question=None)
    got = {r["row_id"]: r for r in validation.repair(spark.createDataFrame([bad, other, changed(row_id="syn-3")], SYNTHETIC), "chain").collect()}
    assert got["syn-1"]["repaired"] and got["syn-1"]["chain"]["intermediate_entity"] == "B Two"
    assert not got["syn-2"]["repaired"] and got["syn-2"]["reason_before"] == "missing question" and got["syn-3"]["reason_before"] is None


def test_tasks_generation_and_resume(spark):
    made = edges.tasks(spark, 5, ["a", "b"], seed=3)
    assert [(r["id"], r["topic"]) for r in made.orderBy("id").collect()][:2] == [("syn-000003", "a"), ("syn-000004", "b")]
    assert edges.pending(made, made.limit(5).where("topic = 'a'")).count() == 2
    with pytest.raises(ValueError):
        edges.tasks(spark, -1, ["a"])

    def check(rows):
        return rows.withColumn("reason", F.when(F.col("topic") == "b", "bad"))

    parts, valid, tries = edges.synthesize_until(spark, 3, ["a", "b"], edges.mock_rows, check, batch=2, max_attempts=20)
    assert valid >= 3 and tries == 5 and len(parts) == 3


def test_generator_is_called_in_batches(spark):
    def shout(prompts):
        assert len(prompts) <= 2
        return [p.upper() for p in prompts]

    got = edges.generate(spark.createDataFrame([("a",), ("b",), (None,)], "prompt string"), shout, batch_size=2).collect()
    assert sorted(r["generated"] for r in got) == ["", "A", "B"]


def test_export_pieces(spark):
    assert exports.normalize_stages("search, answer") == ("search", "answer")
    for bad in ("", "plan"):
        with pytest.raises(ValueError):
            exports.normalize_stages(bad)
    rows = spark.range(5).toDF("k")
    assert {r["k"]: r["split"] for r in exports.prefix_split(rows, "k", 2, 1).collect()} == {0: "train", 1: "train", 2: "val"}
    with pytest.raises(ValueError):
        exports.prefix_split(rows, "k", 5, 1)
    system = F.array(actions.message("system", F.lit("S ")), actions.message("user", F.lit("U")))
    user = F.array(actions.message("user", F.lit("U")))
    a, b = spark.range(1).select(actions.messages_text(exports.probe_prompt(system)), actions.messages_text(exports.probe_prompt(user))).first()
    assert re.match(r"system: S\n\nSearch-probe mode.*\nuser: U$", a, re.S) and b.startswith("system: Search-probe mode") and b.endswith("user: U")
