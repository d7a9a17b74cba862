"""Text functions as Column -> Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, the same class in Java and RE2 spelling.
SPACE = r"[\t-\r\x85\p{Z}]"

# Articles that answers are compared without (fixed values).
ARTICLES = ("a", "an", "the")
# Words that carry no topic of a question (fixed values).
QUESTION_STOP = ("which", "what", "when", "where", "who", "did", "the", "by", "in", "of", "a", "an")


def text(c: Column | str) -> Column:
    """A string that is never null."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def fold(c: Column) -> Column:
    """Lower case with the sharp s spelled out."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def plain(c: Column) -> Column:
    """Lower case and single blanks: how texts are compared."""
    return squeeze(F.lower(c))


def folded(c: Column) -> Column:
    return squeeze(fold(c))


def filled(c: Column) -> Column:
    """The string, or null where it is blank."""
    return F.when(F.length(strip(c)) > 0, c)


def tokenize(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def words(c: Column) -> Column:
    """Runs of ASCII letters and digits as they are."""
    return F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)"), F.lit(1))


def answer_tokens(c: Column) -> Column:
    """Tokens of an answer in folded case, without articles."""
    parts = F.split(F.regexp_replace(fold(text(c)), "[^0-9a-zA-Z]+", " "), " ")
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*ARTICLES))


def normalize_answer(c: Column) -> Column:
    return F.array_join(answer_tokens(c), " ")


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    count = lambda xs, t: F.size(F.filter(xs, lambda z: z == t))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, t: acc + F.least(count(a, t), count(b, t)))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays, to six digits; 0 if either is empty or nothing is shared."""
    hits = overlap(a, b).cast("double")
    precision, recall = hits / F.size(a), hits / F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (hits == 0), F.lit(0.0)).otherwise(F.round(2 * precision * recall / (precision + recall), 6))


def contains_either(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def answer_scores(prediction: Column, gold: Column) -> Column:
    """struct(exact_match, token_f1, containment_match) of two answers."""
    p, g = answer_tokens(prediction), answer_tokens(gold)
    pn, gn = F.array_join(p, " "), F.array_join(g, " ")
    return F.struct(((pn != "") & (pn == gn)).alias("exact_match"), token_f1(p, g).alias("token_f1"), contains_either(pn, gn).alias("containment_match"))


def reward_ladder(exact: Column, containment: Column, f1: Column, threshold: float = 0.75) -> tuple[Column, Column]:
    """(reward, its kind): exact 1, containment at least a half, F1 from the threshold on, else nothing."""
    kind = F.when(exact, "exact").when(containment, "containment").when(f1 >= threshold, "token_f1").otherwise("none")
    reward = F.when(exact, 1.0).when(containment, F.greatest(F.lit(0.5), f1)).when(f1 >= threshold, f1).otherwise(0.0)
    return F.round(reward, 6), kind


def soft_answer_reward(scores: Column, threshold: float = 0.75) -> Column:
    """struct(answer_reward, answer_reward_type) of an ``answer_scores`` struct."""
    reward, kind = reward_ladder(scores["exact_match"], scores["containment_match"], scores["token_f1"], threshold)
    return F.struct(reward.alias("answer_reward"), kind.alias("answer_reward_type"))


def rate(condition: Column) -> Column:
    """Share of true values among all rows, to six digits; 0 without rows."""
    return F.coalesce(F.round(F.avg(F.when(F.coalesce(condition, F.lit(False)), 1.0).otherwise(0.0)), 6), F.lit(0.0))


def average(c: Column) -> Column:
    return F.coalesce(F.round(F.avg(c), 6), F.lit(0.0))


def number(c: Column) -> Column:
    """A number, 0 where it can't be read."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def redact(c: Column, key: str = "") -> Column:
    """Bearer tokens, and the key if one is given, taken out of a message."""
    out = F.regexp_replace(c, r"Bearer\s+[^'\"\s]+", "Bearer [REDACTED]")
    return F.replace(out, F.lit(key), F.lit("[REDACTED]")) if key.strip() else out


def preview(c: Column, n: int = 2048) -> Column:
    return F.substring(c, 1, max(1, n))
