"""Tagged agent actions as struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.text import plain, squeeze, strip, text


def parse_action(raw: Column) -> Column:
    """struct(type, content, valid): the whole text is one think, search or answer element; blank content is
    invalid, but keeps its type. A null text is invalid."""
    pattern = r"(?s)^[\t-\r\x85\p{Z}]*<(think|search|answer)>(.*?)</\1>[\t-\r\x85\p{Z}]*$"
    raw = text(raw)
    kind = F.regexp_extract(raw, pattern, 1)
    content = strip(F.regexp_extract(raw, pattern, 2))
    return F.struct(F.when(kind == "", "invalid").otherwise(kind).alias("type"), content.alias("content"), ((kind != "") & (content != "")).alias("valid"))


def parse_agent_action(raw: Column) -> Column:
    """struct(type, valid, query, answer, reason): exactly one search or answer element, wherever it stands.

    In this order: a generated observation, more than one action (nested answers have their own reason), an
    answer tag inside a search, an empty search, an empty answer, nothing at all. Tags are case-sensitive.
    """
    raw = text(raw)
    searches = F.regexp_extract_all(raw, F.lit(r"(?s)<search>(.*?)</search>"), F.lit(1))
    answers = F.regexp_extract_all(raw, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    first = F.coalesce(F.try_element_at(searches, F.lit(1)), F.lit(""))
    query, answer = strip(first), strip(F.coalesce(F.try_element_at(answers, F.lit(1)), F.lit("")))
    n_search, n_answer = F.size(searches), F.size(answers)
    reason = (
        F.when(raw.contains("<observation>") | raw.contains("</observation>"), "model_generated_observation")
        .when((n_search + n_answer > 1) & first.contains("<answer>"), "nested_answer_in_search")
        .when(n_search + n_answer > 1, "multiple_actions")
        .when((n_search == 1) & (first.contains("<answer>") | first.contains("</answer>")), "nested_answer_in_search")
        .when((n_search == 1) & (query == ""), "empty_search")
        .when((n_search == 0) & (n_answer == 1) & (answer == ""), "empty_answer")
        .when(n_search + n_answer == 0, "no_valid_action")
    )
    kind = F.when(reason.isNotNull(), "invalid").when(n_search == 1, "search").otherwise("answer")
    return F.struct(kind.alias("type"), reason.isNull().alias("valid"), F.when(kind == "search", query).alias("query"), F.when(kind == "answer", answer).alias("answer"), reason.alias("reason"))


def extract_answer(raw: Column) -> Column:
    """Content of the first answer element in any case; empty if it is blank, null if there is none."""
    raw = text(raw)
    pattern = r"(?is)<answer>(.*?)</answer>"
    return F.when(F.regexp_like(raw, F.lit(pattern)), strip(F.regexp_extract(raw, pattern, 1)))


def action_key(raw: Column, action: Column) -> Column:
    """What two generations have in common if they do the same."""
    return (
        F.when(action["type"] == "search", F.concat(F.lit("search:"), plain(action["query"])))
        .when(action["type"] == "answer", F.concat(F.lit("answer:"), plain(action["answer"])))
        .otherwise(F.concat(F.lit("invalid:"), plain(text(raw))))
    )


def search_action(query: Column) -> Column:
    return F.concat(F.lit("<search>"), squeeze(query), F.lit("</search>"))


def rewrite_query(question: Column) -> Column:
    """Questions for a birthplace also ask for the city."""
    return F.when(F.lower(question).contains("birthplace"), F.concat(question, F.lit(" born city"))).otherwise(question)


def observation_text(passages: Column) -> Column:
    """Passages as an observation element, numbered from 1; a blank title is left out."""
    line = lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.when(text(p["title"]) != "", F.concat(p["title"], F.lit(": "))).otherwise(""), text(p["text"]))
    lines = F.transform(F.coalesce(passages, F.array()), line)
    return F.array_join(F.concat(F.array(F.lit("<observation>")), lines, F.array(F.lit("</observation>"))), "\n")


def observation_titles(observation: Column) -> Column:
    """Titles of the numbered lines of an observation."""
    found = F.regexp_extract_all(text(observation), F.lit(r"(?m)^[ \t]*\[\d+\][ \t]+([^:\n]+):"), F.lit(1))
    return F.transform(found, lambda t: strip(t))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text(content).alias("content"))


def messages_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(text(m["role"]), F.lit(": "), text(m["content"]))), "\n")
