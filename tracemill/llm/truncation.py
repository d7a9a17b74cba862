"""Text cut off by field limits.

Intact values are cut artificially to make positives; a hashed logistic regression on closing characters,
punctuation, the last words and the distance to the length limit of the source learns to tell the two
apart and scores every record.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.session import bounded_sample

#: Size of the hashed feature space and values of a field that the fit takes at most (by a hash of the key).
BITS, MAX_TRAIN = 16, 8_000

_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*|[.,;:!?…。、「」“”„«»()<>/]|\S")
_PLAIN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_TAGS = re.compile(r"<(/?)(\w+)>")
_LABEL = re.compile(r"(?:^|\n)[ \t]*([A-Z][a-z]{2,12}):")
_MARK = re.compile(r"(…|\.\.\.|\[truncated\]|\[\.\.\.\]|�)\s*$")
_LINK = {"of", "for", "and", "the"}
_OPEN_CLOSE = {"“": "”", "„": "“", "«": "»", "(": ")", "[": "]", "「": "」"}


def norm_tokens(words: list[str], names: set[str]) -> list[str]:
    """Words in lower case, numbers as #, runs of names as one N."""
    out: list[str] = []
    for i, w in enumerate(words):
        if w[0].isdigit():
            t = "#"
        elif w[0].isupper() and (i > 0 or (len(w) > 3 and w in names)):
            t = "N"
        else:
            t = w.lower()
        if t != "N" or not out or out[-1] != "N":
            out.append(t)
    return out


def name_state(last: list[str], context: list[str], places: dict[str, list[int]]) -> str:
    """What the context says of the last word: partial (only the start of its words), broken (every time it
    is followed by the rest of a name), whole, or unknown."""
    w = last[-1]
    at = places.get(w)
    if at is None:
        if len(w) >= 1 and any(x.startswith(w) for x in places if len(x) > len(w)):
            return "partial"
        return "unknown"
    if len(last) > 1 and (both := [i for i in at if i and context[i - 1] == last[-2]]):
        at = both
    if w[0].isupper() or (w in _LINK and len(last) > 1 and last[-2][0].isupper()):
        def goes_on(i: int) -> bool:
            j = i + 1
            while j < len(context) and j < i + 3 and context[j] in _LINK:
                j += 1
            return j < len(context) and context[j][0].isupper() and context[j] not in {"The", "A", "An"}

        return "broken" if all(goes_on(i) for i in at) else "whole"
    return "whole"


class Context:
    """Words of the texts that belong to a value: its prompt, the passages it was made from, other fields."""

    def __init__(self, *texts: str | None) -> None:
        # a full stop is kept as a word, so that a name at the end of a sentence isn't followed by the next
        self.words = [w for t in texts if t for w in [*re.findall(r"[^\W_]+(?:[-'’][^\W_]+)*|[.,;:!?”“\n]", t), "."]]
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            self.places.setdefault(w, []).append(i)
        self.names = {w for w in self.places if w[0].isupper()}


def tail_features(value: str, context: Context, known: set[str], limit: int | None, longer: str | None = None) -> list[str]:
    """Features of the end of a value, as strings to be hashed."""
    f = ["bias"]
    body = value.rstrip()
    last_char = body[-1:] or " "
    if _MARK.search(value):
        f += ["mark", "mark2"]
        body = _MARK.sub("", value).rstrip()
    kind = "letter" if last_char.isalpha() else "digit" if last_char.isdigit() else last_char
    f.append("last=" + kind)
    if body != value:
        f.append("space")
    if limit is not None:
        d = limit - len(value)
        f.append("limit=" + ("at" if d == 0 else "near" if 0 < d <= 1 else "over" if d < 0 else "far"))
        if d == 0:
            f.append("at+" + kind)
    if longer is not None:
        f.append("other=" + ("longer" if len(longer) > len(body) and longer.startswith(body) else "open" if longer == "\0" else "same" if longer.strip() == value.strip() else "different"))
    tags = _TAGS.findall(value)
    if tags:
        opened = Counter(name for slash, name in tags if not slash)
        opened.subtract(name for slash, name in tags if slash)
        shut = value.rstrip().endswith(f"</{tags[-1][1]}>")
        f.append(f"tags={'open' if any(n > 0 for n in opened.values()) else 'even'},{'shut' if shut else 'loose'},{tags[-1][0]}{tags[-1][1]}")
        if not shut:
            f.append("loose")
    labels = _LABEL.findall(value)
    if labels and not tags and (len(labels) > 1 or value.lstrip().startswith(labels[0] + ":")):
        f.append("label=" + labels[0] + ">" + labels[-1])
        body = body[body.rfind(labels[-1] + ":") + len(labels[-1]) + 1 :].strip()
    # the last sentence, and how the one before it began
    cuts = [m.end() for m in re.finditer(r"(?<=[^\W\d_])[.!?。][”\"»]?(?:\s+|$)", body)]
    ended = bool(cuts) and cuts[-1] == len(body)
    start = cuts[-2] if ended and len(cuts) > 1 else 0 if ended else cuts[-1] if cuts else 0
    sentence = body[start:]
    words = _WORD.findall(sentence)
    plain = _PLAIN.findall(sentence)
    tokens = ["<s>", *norm_tokens(words, context.names)]
    for opening, closing in _OPEN_CLOSE.items():
        if sentence.count(opening) > sentence.count(closing) and opening != closing:
            f += ["unclosed", "unclosed" + opening]
    state = "none"
    if plain and last_char.isalnum():
        state = name_state(plain[-2:], context.words, context.places)
        if state == "unknown" and plain[-1].lower() not in known:
            state = "newname" if plain[-1][0].isupper() else "new"
            f.append(f"{state},{min(len(plain[-1]), 8)}")
        if state == "partial" and plain[-1].lower() in known and plain[-1].islower():
            state = "partial-known"
    f += ["state=" + state, f"ended={ended}", f"ended={ended},{state}", f"words={min(len(plain), 6)},{ended},{state}"]
    run = 0
    while run < len(words) and words[-1 - run][0].isupper():
        run += 1
    if run:
        f.append(f"run={min(run, 4)},{state}," + " ".join(tokens[-3:]))
    for n in (1, 2, 3, 4):
        tail = tokens[-n:] if state not in ("new", "partial") else [*tokens[-n:-1], "?"]
        f.append(f"tail{n}=" + " ".join(tail))
        f.append(f"tail{n}={state}," + " ".join(tail))
    f.append(f"head={' '.join(tokens[:4])},{ended}")
    f.append(f"head={' '.join(tokens[:3])},tail={' '.join(tokens[-2:])}")
    return f


def hashed(features: Iterable[str]) -> np.ndarray:
    return np.array([zlib.crc32(x.encode("utf-8", "replace")) & ((1 << BITS) - 1) for x in features], np.int64)


_HOLLOW = re.compile(r"(?s)^(.*\nAnswer:)?[\W_]*$")


def is_hollow(value: str) -> bool:
    """Nothing but signs where the text should stand: an empty value, not a cut one."""
    return bool(_HOLLOW.match(value)) and not value.rstrip().endswith(("<", "</"))


def is_open_tagged(value: str) -> bool:
    """Tagged from its start, but without a closing tag at its end: such a value never counts as intact."""
    return bool(re.match(r"\s*<\w+>", value)) and not re.search(r"</\w+>\s*$", value)


class HashedLogit:
    """Logistic regression on hashed binary features, fitted with AdaGrad in a fixed order."""

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 0.3, decay: float = 1e-6) -> HashedLogit:
        self.weights = np.zeros(1 << BITS)
        squares = np.full(1 << BITS, 1e-3)
        order = np.random.RandomState(0)
        for _ in range(epochs):
            for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 64)):
                flat = np.concatenate([rows[i] for i in part])
                owner = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
                z = np.bincount(owner, weights=self.weights[flat], minlength=len(part))
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]
                unique, place = np.unique(flat, return_inverse=True)
                g = np.bincount(place, weights=error[owner]) + decay * self.weights[unique]
                squares[unique] += g * g
                self.weights[unique] -= rate * g / np.sqrt(squares[unique])
        return self

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([1 / (1 + np.exp(-np.clip(self.weights[r].sum(), -30, 30))) for r in rows])


_CLOSED = re.compile(r"([.!?。][”\"»)]?|</\w+>)\s*$")


def looks_intact(value: str, limit: int | None) -> bool:
    """Good enough to learn from: closed, or a short answer without punctuation, and not at the limit."""
    if not value.strip() or (limit is not None and len(value) >= limit - 1) or _MARK.search(value):
        return False
    tagged = _TAGS.search(value)
    if tagged:
        return bool(re.search(r"</\w+>\s*$", value))
    labels = _LABEL.findall(value)
    if len(labels) > 1 and labels[-1] != "Answer":
        return False
    if _CLOSED.search(value) or len(_PLAIN.findall(value.rpartition(":")[2])) <= 4:
        return True
    last = _PLAIN.findall(re.split(r"[.!?。]\s+", value)[-1])  # a name after a sentence is a whole answer
    return len(last) <= 4 and all(w[0].isupper() or w[0].isdigit() for w in last)


def goes_on_elsewhere(value: str, longer: str | None) -> bool:
    """The same text is open-ended or longer in its other place."""
    return longer == "\0" or (longer is not None and len(longer) > len(value.rstrip()) and longer.startswith(value.rstrip()))


def cut(value: str, rng: random.Random) -> str:
    """An artificial cut: anywhere, at the end of a word, inside or after a closing tag, or between sentences."""
    body = value.rstrip()
    how = rng.random()
    tail = body[-12:].find("</") if body.endswith(">") else -1
    if tail >= 0 and how < 0.15:
        return body[: len(body) - rng.randint(1, 12 - tail)]
    low = max(1, int(len(body) * 0.15))
    at = rng.randint(low, max(low, len(body) - 2))
    if how < 0.5:
        spaces = [m.start() for m in re.finditer(r"\s", body[low:])]
        if spaces:
            at = low + rng.choice(spaces) + rng.randint(0, 1)
    elif how < 0.56:
        ends = [m.end() for m in re.finditer(r"[.!?]\s", body[:-1])]
        if ends:
            at = rng.choice(ends)
    elif how < 0.6:
        return body[:at] + rng.choice(["…", "...", " [truncated]"])
    return body[:at]


class CutModel:
    """The classifier of one field with the words it knows and the limits of the sources."""

    def __init__(self, limits: dict[str | None, int]) -> None:
        self.limits = limits

    def fit(self, rows: list[tuple[str | None, str, tuple, str | None]], seed: int = 7) -> CutModel:
        """rows: source, value, texts of its context, the same text elsewhere (or None)."""
        rng = random.Random(seed)
        intact = [r for r in rows if looks_intact(r[1], self.limits.get(r[0])) and not goes_on_elsewhere(r[1], r[3])]
        often = Counter(w.lower() for _, v, _, _ in intact for w in set(_PLAIN.findall(v)))
        self.known = {w for w, n in often.items() if n >= 3}
        limits = sorted(set(self.limits.values()))
        data, labels = [], []
        for source, value, texts, longer in intact:
            context, limit = Context(*texts), self.limits.get(source)
            data.append(hashed(tail_features(value, context, self.known, limit, longer)))
            labels.append(0)
            bare = value.rstrip()
            if bare[-1] in ".。" and rng.random() < 0.5:
                bare = bare[:-1]
                same = longer if longer is None or longer == "\0" else bare
                data.append(hashed(tail_features(bare, context, self.known, rng.choice([limit, len(bare)]) if rng.random() < 0.1 else limit, same)))
                labels.append(0)
            # a part of a short answer reads like another short answer: only longer values teach what a cut is
            for _ in range(2 if len(_PLAIN.findall(value)) >= 6 else 0):
                part, short = cut(value, rng), limit
                fits = [x for x in limits if len(value) > x]
                if fits and rng.random() < 0.25:
                    short = rng.choice(fits)
                    part = value[:short]
                if part.strip() and part.strip() != value.strip():
                    other = longer
                    if longer is not None and rng.random() < 0.6:
                        other = rng.choice(["\0", None])  # the same text elsewhere is often cut as well
                    data.append(hashed(tail_features(part, context, self.known, short, other)))
                    labels.append(1)
        self.model = HashedLogit().fit(data, np.array(labels, float))
        return self

    def scores(self, rows: list[tuple[str | None, str, tuple, str | None]]) -> np.ndarray:
        found = self.model.score([hashed(tail_features(v, Context(*texts), self.known, self.limits.get(s), longer)) for s, v, texts, longer in rows])
        found = np.where([is_open_tagged(v) for _, v, _, _ in rows], 1.0, found)
        return np.where([is_hollow(v) for _, v, _, _ in rows], 0.0, found)


def source_limits(values: DataFrame, share: float = 0.3) -> dict[str | None, int]:
    """(source, value) -> the length limit of each source that has one: its greatest length, if more than
    ``share`` of the values of nearly that length (the last tenth), and at least 5, have just that one and don't
    end like a complete text. Counted over all values; the driver gets one row a source."""
    open_end = F.count_if(~F.regexp_like("value", F.lit(r"[.!?。”\"»>)]\s*$"))).alias("open")
    lengths = values.where("value is not null").groupBy("source", F.length("value").alias("n")).agg(F.count("*").alias("count"), open_end)
    top = lengths.groupBy("source").agg(F.max("n").alias("top"))
    on = F.col("b.source").eqNullSafe(F.col("top.source"))
    near = lengths.alias("b").join(top.alias("top"), on).where("n > top * 0.9").groupBy(F.col("top.source").alias("source"), "top")
    rows = near.agg(F.sum("count").alias("all"), F.sum(F.when(F.col("n") == F.col("top"), F.col("open")).otherwise(0)).alias("at"))
    return {r["source"]: int(r["top"]) for r in rows.where((F.col("at") >= 5) & (F.col("at") > share * F.col("all"))).collect()}


def cut_values(rows: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(id, source, cut): whether each value ends before its text was complete.

    ``rows``: id, source, value, context (array of texts that belong to the value), other (the same text
    elsewhere in the record, "\\0" if that place is open-ended, or null). Null and blank values are no case
    and have cut = false; a complete text that only lacks its full stop is none either. Repeated rows get the
    same answer; a null id has no row. The fit sees at most ``max_train`` values, the first by a hash of the id; an empty table
    gives no rows, and a table without any intact value gives false throughout.
    """
    filled = rows.where(r"value rlike '(?U)\\S'")
    limits = source_limits(filled)
    sample = bounded_sample(filled, "id", max_train)
    train = sorted(((r["source"], r["value"], tuple(r["context"]), r["other"]) for r in sample.collect()), key=repr)
    usable = any(looks_intact(v, limits.get(s)) for s, v, _, _ in train)
    shared = rows.sparkSession.sparkContext.broadcast(CutModel(limits).fit(train) if usable else None)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            found = np.zeros(len(pdf), bool)
            at = [i for i, v in enumerate(pdf["value"]) if isinstance(v, str) and v.strip()]
            if model is not None and at:
                part = [(pdf["source"].iat[i], pdf["value"].iat[i], tuple(pdf["context"].iat[i]), pdf["other"].iat[i]) for i in at]
                found[at] = model.scores(part) > 0.5
            yield pd.DataFrame({"id": pdf["id"], "source": pdf["source"], "cut": found})

    return rows.where("id is not null").select("id", "source", "value", "context", "other").mapInPandas(score, "id long, source string, cut boolean")


def response_rows(rollouts: DataFrame) -> DataFrame:
    """Responses with their prompt, gold answer and own passages as context."""
    return rollouts.select(
        F.col("rollout_id").alias("id"),
        "source",
        F.col("response").alias("value"),
        F.array(F.coalesce("prompt", F.lit("")), F.coalesce(F.col("metadata.answer"), F.lit("")), passages_of("response")).alias("context"),
        F.lit(None).cast("string").alias("other"),
    )


def passages_of(column: str) -> Column:
    """The part of a response before its answer: passages and thoughts."""
    c = F.coalesce(F.col(column), F.lit(""))
    tag, line = F.instr(c, "<answer>"), F.instr(c, "\nAnswer:")
    return F.when(tag > 0, F.substring(c, F.lit(1), tag - 1)).when(line > 0, F.substring(c, F.lit(1), line)).otherwise(F.regexp_extract(c, r"(?s)^(.*[.!?])\s+\S", 1))


def final_answer_rows(traces: DataFrame) -> DataFrame:
    """Final answers, one row a trace, with question and observations as context and the answer of the last
    step as the same text elsewhere."""
    action = F.col("a")
    answer = F.regexp_extract(action, r"(?s)<answer>(.*?)</answer>", 1)
    other = F.when(action.isNull(), None).when(F.instr(action, "</answer>") == 0, F.lit("\0")).otherwise(answer)
    passages = F.flatten(F.transform("steps", lambda s: F.coalesce(F.transform(s["observation"], lambda p: F.concat_ws(" ", p["title"], p["text"])), F.array(F.lit("")))))
    last = F.element_at(F.filter(F.transform("steps", lambda s: s["action"]), lambda x: F.coalesce(F.instr(x, "<answer>") > 0, F.lit(False))), -1)
    wide = traces.select(
        F.col("trace_id").alias("id"),
        "source",
        F.col("final_answer").alias("value"),
        F.coalesce("question", F.lit("")).alias("q"),
        F.coalesce(F.array_join(passages, "\n"), F.lit("")).alias("p"),
        F.when(F.exists("steps", lambda s: F.coalesce(F.instr(s["action"], "<answer>") > 0, F.lit(False))), last).alias("a"),
    ).dropDuplicates(["id"])
    return wide.select("id", "source", "value", F.array("q", "p").alias("context"), other.alias("other"))


def cut_fields(rollouts: DataFrame, traces: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(field, record_id, source, cut) of every response and every final answer (one row a trace)."""
    response = cut_values(response_rows(rollouts), max_train).select(F.lit("response").alias("field"), F.col("id").alias("record_id"), "source", "cut")
    final = cut_values(final_answer_rows(traces), max_train).select(F.lit("final_answer").alias("field"), F.col("id").alias("record_id"), "source", "cut")
    return response.unionByName(final)


def cut_rates(scored: DataFrame) -> DataFrame:
    """(field, source, n_values, n_cut, rate): how often each source truncates."""
    n_cut = F.sum(F.col("cut").cast("long"))
    return scored.groupBy("field", "source").agg(F.count("*").alias("n_values"), n_cut.alias("n_cut"), F.round(n_cut / F.count("*"), 6).alias("rate"))
