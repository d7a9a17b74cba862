import pytest
from pyspark.sql import functions as F

from tracemill.functions import actions, text


@pytest.fixture(scope="module")
def one(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first()["x"]


def test_answer_scores(one):
    score = lambda p, g: one(text.answer_scores(F.lit(p), F.lit(g)))
    assert tuple(score("Golden Quill Award", "Golden Quill")) == (False, 0.8, True)
    assert tuple(score("The Example City", "example city!")) == (True, 1.0, True)
    assert tuple(score("", "x")) == (False, 0.0, False)
    assert tuple(score("Straße", "STRASSE")) == (True, 1.0, True)


def test_soft_rewards(one):
    reward = lambda p, g, t=0.75: tuple(one(text.soft_answer_reward(text.answer_scores(F.lit(p), F.lit(g)), t)))
    assert reward("Vienna", "vienna") == (1.0, "exact")
    assert reward("Golden Quill Award", "Golden Quill") == (0.8, "containment")
    assert reward("Vienna Conference Center", "Vienna") == (0.5, "containment")
    assert reward("alpha beta gamma", "gamma beta alpha delta") == (0.857143, "token_f1")
    assert reward("Paris", "Vienna") == (0.0, "none")
    assert reward("a b c", "c x b", 0.5)[1] == "token_f1"


def test_strict_actions(one):
    parse = lambda s: tuple(one(actions.parse_action(F.lit(s))))
    assert parse(" <search> a\nb </search>\n") == ("search", "a\nb", True)
    assert parse("<answer> </answer>") == ("answer", "", False)
    assert parse("<search>x</answer>") == ("invalid", "", False)
    assert parse("<SEARCH>x</SEARCH>")[0] == "invalid"
    assert parse(None) == ("invalid", "", False)


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("hm <search> alice </search>", ("search", True, "alice", None, None)),
        ("<answer>x</answer>", ("answer", True, None, "x", None)),
        ("<observation>y</observation><answer>x</answer>", ("invalid", False, None, None, "model_generated_observation")),
        ("<search>a</search><answer>b</answer>", ("invalid", False, None, None, "multiple_actions")),
        ("<search>a <answer>b</answer></search>", ("invalid", False, None, None, "nested_answer_in_search")),
        ("<search>a </answer></search>", ("invalid", False, None, None, "nested_answer_in_search")),
        ("<search> </search>", ("invalid", False, None, None, "empty_search")),
        ("<answer> </answer>", ("invalid", False, None, None, "empty_answer")),
        ("nothing", ("invalid", False, None, None, "no_valid_action")),
    ],
)
def test_agent_actions(one, raw, expected):
    assert tuple(one(actions.parse_agent_action(F.lit(raw)))) == expected


def test_extracted_answers(one):
    assert one(actions.extract_answer(F.lit("x <ANSWER> b </answer>"))) == "b"
    assert one(actions.extract_answer(F.lit("<answer> </answer>"))) == ""
    assert one(actions.extract_answer(F.lit("none"))) is None


def test_observations_and_queries(one):
    passages = F.array(F.struct(F.lit("T").alias("title"), F.lit("a").alias("text")), F.struct(F.lit("").alias("title"), F.lit("b").alias("text")))
    assert one(actions.observation_text(passages)) == "<observation>\n[1] T: a\n[2] b\n</observation>"
    assert one(actions.observation_titles(F.lit("<observation>\n[1] One: x\n [2] Two: y: z\nno"))) == ["One", "Two"]
    assert one(actions.rewrite_query(F.lit("Birthplace of X?"))) == "Birthplace of X? born city"


def test_numbers_and_secrets(one):
    assert one(text.number(F.lit("abc"))) == 0.0 and one(text.number(F.lit("1.5"))) == 1.5
    assert one(text.redact(F.lit("Bearer abc'x k9"), "k9")) == "Bearer [REDACTED]'x [REDACTED]"
    assert one(text.preview(F.lit("abcdef"), 3)) == "abc"
