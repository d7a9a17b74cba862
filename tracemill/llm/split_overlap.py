"""Same or near-same questions across splits.

Questions equal but for case, spacing and punctuation are one form. Candidates are found by keys of which any two forms
that ``same_question`` accepts share at least one; it alone decides. The first segment of a key holds the numbers and the
names of a form, which both questions must have. Forms with less than two of them meet by the words that their own
capitals show to be names, or by all content words but for slips of the pen. Where a key is crowded, words are demanded
besides that stand among the first k + j words of both, from rare to common in one order, where k bounds the words that
may be edited, misspelt or added at the ends. What meets is verified by banded dynamic programming: over the letters of
words for slips of the pen, over the words of both questions for their order. Segments cut by length alone would be
shared by all questions of one pattern ("who taught the").
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.session import cut_lineage

#: Half the band, in words, in which the order of two questions is compared.
MOST = 8
#: Of names that a question itself writes small, more than so many don't go into segments.
DOUBTFUL = 4
#: Forms of more content words than this seek names by single words instead of pairs.
LONG = 40
#: Words whose rank in the order of words is broadcast; rarer words go before them by their letters. Any number gives
#: the same pairs, since every order of words does.
RANKED = 10_000
#: A key under which more than this many pairs meet is replaced by keys of one word more, up to LEVELS words.
CROWDED, LEVELS = 10_000, 4
EVALUATION = ("validation", "dev", "test")

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_START = re.compile(r"[.?!:;)\]][\s\"'“”«»¿¡(]*$")

_SIGNS = ",;:.?!"

# Words that ask (fixed values), with those that ask alike under one name.
ASKING = {"who": "who", "whom": "who", "whose": "whose", "which": "what", "what": "what", "where": "where", "when": "when", "why": "why", "how": "how"}
# Words without content (fixed values).
EMPTY = frozenset(
    "a an the this that these those it its and or of in on at to for from by with into as about during before after until since "
    "is was are were be been being am do does did has have had will would can could me us you your i we please there".split()
)


def budget(n: int) -> int:
    """Content words of n that may be edited or misspelt."""
    return max(1, (2 * n + 2) // 5)


def one_slip(a: str, b: str) -> bool:
    """One letter added, dropped or replaced, or two neighbours swapped: the edit distance in a band of one."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def same_letters(a: str, b: str) -> bool:
    """Two neighbours swapped or a letter doubled: a slip that makes no other word of its own."""
    return sorted(a) == sorted(b) or set(a) == set(b)


def less_one(w: str) -> set[str]:
    """A word and all that is left of it without one letter; two words one slip apart share such a key."""
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


#: Keys of the words that stand a slip away from words without content.
ALMOST_EMPTY = frozenset(k for w in {*EMPTY, *ASKING} if len(w) >= 3 for k in less_one(w))


def one_case(question: str) -> bool:
    return question.upper() == question or question.lower() == question


class Form:
    """The words of a question: all in order, numbers, content words, and what case tells of them.

    ``ordinary`` tells of a word whether other questions write it in lower case (or None where none tells). In a
    question of mixed case a capitalised word inside a sentence is a name, whatever other questions say."""

    def __init__(self, question: str, ordinary) -> None:
        mixed = not one_case(question)
        self.all: list[str] = []
        self.role: dict[str, str] = {}
        self.low: Counter = Counter()
        #: how many words stand before each sign
        self.parted: set[int] = set()
        end = 0
        for m in _WORD.finditer(question):
            shown, gap = m[0], question[end : m.start()]
            start = not end
            if gap != " " and gap:
                if any(c in _SIGNS for c in gap):
                    self.parted.add(len(self.all))
                start = start or _START.search(gap) is not None
            end = m.end()
            w = shown.lower().replace("’", "'")
            self.all.append(w)
            lower = mixed and shown[0].islower()
            if lower:
                self.low[w] += 1
            if w in EMPTY or w in ASKING:
                self.role.setdefault(w, "empty")
            elif not w.isalpha() and any(c.isdigit() for c in w):
                self.role[w] = "number"
            elif lower:
                self.role.setdefault(w, "ordinary")
            elif mixed and not start:
                self.role[w] = "name"
            elif w not in self.role:
                known = ordinary(w)
                self.role[w] = "ordinary?" if known else "unknown" if known is None else "name?"
        self.numbers = sorted(w for w in self.all if self.role[w] == "number")
        self.content = {w for w, r in self.role.items() if r not in ("number", "empty")}
        #: what other questions take for names, in whatever case it is written here
        self.names = {w for w in self.content if ordinary(w) is False}
        self.asks = {ASKING[w] for w in self.all if w in ASKING}

    def sure(self, w: str) -> str | None:
        """What this question itself tells of a word."""
        r = self.role.get(w)
        return r if r in ("name", "ordinary") else None


def leads(form: Form) -> list[tuple[int, int]]:
    """(first, last) of what may be left of a form's words without a lead-in and an appendix, whatever the other
    question is: ``_without_lead`` takes no others away."""
    words, out = form.all, []
    for step in (1, -1):
        sizes = [0]
        for n in range(1, min(4, len(words)) + 1):
            w = words[n - 1] if step == 1 else words[-n]
            if w in ASKING or form.role[w] in ("name", "number"):
                break
            if (n if step == 1 else len(words) - n) in form.parted or step == 1 and n > 1:
                sizes.append(n)
        out.append(sizes)
    return [(i, max(i, len(words) - j)) for i in out[0] for j in out[1]]


def _further(form: Form, names: set[str], order, words: int) -> list[str]:
    """The words demanded besides the first segment of a crowded key.

    At most k words of a question have no equal in the other one, edited, misspelt or in a lead-in, but for those a slip
    away from words without content: so the ``words`` first that two questions share stand among the first
    k + ``words`` of both. Questions that may share less meet by as many as they share."""
    if not words:
        return [""]
    rest = sorted((w for w in form.content - names if len(w) < 3 or not less_one(w) & ALMOST_EMPTY), key=order)
    k = budget(sum(form.role[w] != "empty" for w in form.all)) + max(len(form.all) - (j - i) for i, j in leads(form))
    sure = max(0, len(rest) - k)
    return [f"{n}:" + " ".join(c) for n in range(min(sure, words), words + 1) for c in combinations(rest[: k + n], n)]


def _heads(form: Form, names: set[str]) -> tuple[list[str], bool]:
    """(first segments of two or more numbers and names, whether there may be less). ``names`` are those that other
    questions tell; both questions have them but for those that one of them writes small."""
    doubtful = [w for w in names if form.role[w] == "ordinary"]
    sets = [sorted(names.difference(x)) for n in range(len(doubtful) + 1) for x in combinations(doubtful, n)]
    enough = [" ".join([*form.numbers, "|", *x]) for x in sets if len(form.numbers) + len(x) >= 2]
    return enough, len(enough) < len(sets)


def join_keys(form: Form, question: str, order, words: int, near: dict | None = None, vague: frozenset = frozenset()) -> list[int]:
    """The segments of a form, hashed; two forms that are the same question share one of them or of ``name_keys``.

    ``near`` has the content words that stand a slip away from others, with the keys that they share with these, after
    "~" where a word without content is among them; ``vague`` are names left out of segments. With two or more numbers and
    names these are the first segment, in a crowded one (``words`` > 0) with further words. With less, where nothing is
    edited, all content words are equal, but for one with a neighbour, which has a key in common.
    """
    near = near or {}
    names = form.names - vague
    heads, few = _heads(form, names)
    out = {h + "|" + x for h in heads for x in _further(form, names, order, words)} if heads else set()
    for first, last in leads(form) if few else []:
        own = [w for w in form.all[first:last] if form.role[w] not in ("empty", "number")]
        head = " ".join([*form.numbers, "|", *sorted(w for w in own if w not in near)]) + "~"
        # a word a slip away from one without content may stand for that, so it needs no equal
        firm = sorted(w for w in own if w in near and "~" not in near[w])
        out.add(head + " ".join(firm))
        for w in {w for w in own if w in near}:
            at = firm.index(w) if "~" not in near[w] else len(firm)
            rest = head + " ".join(firm[:at] + firm[at + 1 :]) + "~"
            out.update(rest + k for k in near[w] if k != "~")
    return [_hashed(x) for x in out]


def name_keys(form: Form, order, words: int, vague: frozenset = frozenset()) -> tuple[list[int], list[int]]:
    """The keys, hashed, of a form with less than two numbers and names that others tell: (as a training question, as
    an evaluation question).

    What a question's own capitals show to be a name stands in the other one too. A question with two of these, or a
    number and one, meets all that have its two rarest; questions with one each meet by both."""
    names = form.names - vague
    if not _heads(form, names)[1]:
        return [], []
    further = _further(form, names, order, words)
    own = sorted((w for w in form.content if form.role[w] in ("name", "name?")), key=order)
    content = sorted(form.content, key=order)
    number = " ".join(form.numbers)
    if number:
        holds, seeks = [f"n {number} {w}" for w in own[:1]], [f"n {number} {w}" for w in content]
    else:
        holds = [f"2 {own[0]} {own[1]}", f"1 {own[0]}"] if len(own) > 1 else []
        seeks = [f"1 {w}" for w in content] if len(content) > LONG else [f"2 {x} {y}" for x, y in combinations(content, 2)]
    sides = []
    for mine, other in (("t", "e"), ("e", "t")):
        heads = [f"{mine}{x}" for x in holds] + [f"{other}{x}" for x in seeks]
        if not number and len(own) == 1:
            heads += [f"b {own[0]} {w}" if mine == "t" else f"b {w} {own[0]}" for w in content if w != own[0]]
        sides.append([_hashed(f"{h}|{x}") for h in heads for x in further])
    return sides[0], sides[1]


def _hashed(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


def _longest(a: list[str], b: list[str], same: set[tuple[str, str]], band: int) -> int:
    """Most words that can be matched in order, by dynamic programming in a band around the diagonal."""
    band = max(band, abs(len(a) - len(b)) + 1)
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        low, high = max(0, i - band), min(len(b), i + band + 1)
        before = row[low]
        for j in range(low, high):
            here = row[j + 1]
            best = before + 1 if x == b[j] or (x, b[j]) in same else max(here, row[j])
            before = here
            row[j + 1] = best
        for j in range(high, len(b)):  # right of the band nothing is matched any more
            row[j + 1] = max(row[j + 1], row[high])
    return row[len(b)]


def _in_order(a: list[str], b: list[str], same: set[tuple[str, str]]) -> int:
    """Most words in one order when a clause may have moved from the one end to the other."""
    turns = {0} | {i for i, w in enumerate(b) if a and (w == a[0] or (a[0], w) in same)}
    back = {i for i, w in enumerate(a) if b and (w == b[0] or (w, b[0]) in same)}
    ways = [(a, b[i:] + b[:i]) for i in sorted(turns)[:8]] + [(a[i:] + a[:i], b) for i in sorted(back)[:8] if i]
    return max(_longest(x, y, same, 2 * MOST) for x, y in ways)


def _asks(w: str, few: bool) -> bool:
    return w in ASKING or few and w.partition("'")[0] in ASKING


def _without_lead(f: Form, other: Form, kind, few: bool) -> list[str]:
    """The words of a question without a lead-in or an appendix: one to four words at an end that the other question
    doesn't have, or not so often, none of which asks, is a number or a name. What might be a name, since nothing
    tells, is none if a sign parts it from the rest. Where ``few`` names hold the questions together, "what's" asks."""
    own, first, last = f.all, 0, len(f.all)
    for step in (1, -1):
        left, n = Counter(own) - Counter(other.all), 0
        words = own if step == 1 else own[::-1]
        while n < len(own) and left[words[n]] > 0:
            left[words[n]] -= 1
            n += 1
        parted = (n if step == 1 else len(own) - n) in f.parted
        kinds = {kind(w) for w in words[:n]}
        if 1 <= n <= 4 and not kinds & {"name", "number"} and not any(_asks(w, few) for w in words[:n]) and (parted or n > 1 and step == 1 and "unknown" not in kinds):
            first, last = (n, last) if step == 1 else (first, len(own) - n)
    return own[first:last]


def same_question(a: Form, b: Form) -> bool:
    """Whether two questions ask for the same fact about the same things.

    Numbers are equal and no name is without its equal; words that ask don't contradict. Other words may be one slip
    apart, with those edited two fifths of the content words, and one only where less than two names or numbers hold the
    questions together; slips of words without content don't count. Words may be added, dropped or replaced in no more
    places than there are other ordinary words in common, and at most a third of the content words, and only if two
    names or numbers hold the questions together. But for a clause that moved from one end to the other, all but two
    words stand in the same order.
    """
    if a.numbers != b.numbers or (a.asks and b.asks and not a.asks & b.asks):
        return False

    def kind(w: str, own: Form | None = None) -> str:
        # of a word that is a name and an ordinary word in one question, what the other lacks may be the latter
        if own is not None and own.low[w] and (b if own is a else a).all.count(w) >= own.all.count(w) - own.low[w]:
            return "ordinary"
        sure = {a.sure(w), b.sure(w)} - {None}
        if sure:
            return "name" if "name" in sure else "ordinary"
        return (a.role.get(w) or b.role.get(w)).rstrip("?")

    few = sum(kind(w) in ("name", "number") for w in set(a.all) & set(b.all)) < 2
    wa, wb = _without_lead(a, b, kind, few), _without_lead(b, a, kind, few)
    more, less = list((Counter(wa) - Counter(wb)).elements()), list((Counter(wb) - Counter(wa)).elements())
    slips: set[tuple[str, str]] = set()
    misspelt = 0
    for w in list(more):
        for x in less:
            if len(w) >= 3 and len(x) >= 3 and one_slip(w, x):
                kinds = {kind(w, a), kind(x, b)}
                if "name" not in kinds and ("ordinary" in kinds or "empty" in kinds or same_letters(w, x)):
                    slips.add((w, x))
                    misspelt += "empty" not in kinds
                    more.remove(w)
                    less.remove(x)
                    break
    lost = [[w for w in side if kind(w) != "empty"] for side in (more, less)]
    if any(kind(w, f) in ("name", "unknown", "number") for side, f in zip(lost, (a, b)) for w in side):
        return False
    both = (Counter(wa) & Counter(wb)).keys()
    anchors = sum(kind(w) in ("name", "number") for w in both)
    common = sum(kind(w) in ("ordinary", "unknown") for w in both) + sum(1 for w, _ in slips if kind(w) != "empty")
    edited = max(len(side) for side in lost)
    if edited + misspelt > budget(anchors + common + edited) or few and misspelt > 1:
        return False
    if edited:
        places = 0
        for ws, side in ((wa, lost[0]), (wb, lost[1])):
            here, inside = 0, False
            for w in ws:
                if kind(w) != "empty":
                    here += w in side and not inside
                    inside = w in side
            places = max(places, here)
        if anchors < 2 or places > common or 3 * edited > anchors + common + edited:
            return False
    full = lambda ws: [w for w in ws if kind(w) != "empty"]
    fa, fb = full(wa), full(wb)
    matched = sum((Counter(fa) & Counter(fb)).values()) + sum(1 for w, x in slips if w in fa and x in fb)
    return matched - _in_order(fa, fb, slips) <= (0 if edited else 2 if anchors + common >= 8 else 1 if anchors + common >= 5 else 0)


def _side(split: str) -> Column:
    return F.lower(F.regexp_replace(F.col(split), r"(?U)^\s+|\s+$", ""))


def word_statistics(forms: DataFrame) -> DataFrame:
    """(word, n, ordinary): in how many forms a content word stands, and whether it is written in lower case more
    often than capitalised inside a sentence (null where no question of mixed case tells). Counted over all forms."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["word", "n", "low", "high"]
        seen: dict[str, list[int]] = {}
        for pdf in batches:
            for q in pdf["question"]:
                for w, r in Form(q, lambda w: None).role.items():
                    if r not in ("number", "empty"):
                        c = seen.setdefault(w, [0, 0, 0])
                        c[0] += 1
                        c[1] += r == "ordinary"
                        c[2] += r == "name"
            if len(seen) > 200_000:
                yield pd.DataFrame([(w, *c) for w, c in seen.items()], columns=columns)
                seen = {}
        yield pd.DataFrame([(w, *c) for w, c in seen.items()], columns=columns)

    parts = forms.select("question").mapInPandas(count, "word string, n long, low long, high long")
    told = F.when(F.col("low") + F.col("high") > 0, F.col("low") > F.col("high"))
    return parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "low", "high")]).select("word", "n", told.alias("ordinary"))


def _told(forms: DataFrame, stats: DataFrame, shared) -> DataFrame:
    """(form, told): what all questions tell of the rarer content words of a form, each behind o (ordinary) or n (a
    name). Only words outside the broadcast ranks are joined, so no key of the join is hot."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = shared.value
        for pdf in batches:
            rows = [
                (form, w)
                for form, q in zip(pdf["form"], pdf["question"])
                for w, r in Form(q, lambda w: None).role.items()
                if r not in ("number", "empty") and w not in ranks
            ]
            yield pd.DataFrame(rows, columns=["form", "word"])

    asked = forms.select("form", "question").mapInPandas(ask, "form long, word string")
    known = asked.join(stats.where("ordinary is not null"), "word")
    return known.groupBy("form").agg(F.array_join(F.collect_set(F.concat(F.when(F.col("ordinary"), "o").otherwise("n"), "word")), " ").alias("told"))


def _knows(ranks: dict, told: object):
    """What is known of a word: from the ranks, else from what was joined."""
    own = {x[1:]: x[0] == "o" for x in told.split()} if isinstance(told, str) else {}
    return lambda w: ranks[w][1] if w in ranks else own.get(w)


def _marked(forms: DataFrame, shared, vague: frozenset) -> DataFrame:
    """(form, word, vague): the content words of forms that may have less than two numbers and names, and the names, if
    more than ``DOUBTFUL``, that a form itself writes small, as vague."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = shared.value
        for pdf in batches:
            out = []
            for id_, q, told in zip(pdf["form"], pdf["question"], pdf["told"]):
                form = Form(q, _knows(ranks, told))
                names = form.names - vague
                small = [w for w in names if form.role[w] == "ordinary"]
                if len(small) > DOUBTFUL:
                    out += [(id_, w, True) for w in small]
                elif _heads(form, names)[1]:
                    out += [(id_, w, False) for w in form.content if len(w) >= 3]
            yield pd.DataFrame(out, columns=["form", "word", "vague"])

    return cut_lineage(forms.select("form", "question", "told").mapInPandas(run, "form long, word string, vague boolean"))


def _near(words: DataFrame) -> DataFrame:
    """(form, near): which of the (form, word) share a key of ``less_one`` with other words, as ``_neighbours`` reads it."""
    empty = words.sparkSession.createDataFrame([(w,) for w in sorted({*EMPTY, *ASKING}) if len(w) >= 3], "word string").withColumn("empty", F.lit(True))
    every = words.select("word").distinct().withColumn("empty", F.lit(False)).unionByName(empty)
    less = F.array_distinct(F.concat(F.array("word"), F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))))
    keys = every.withColumn("key", F.explode(less))
    live = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("empty").alias("loose")).where("n > 1").drop("n")
    told = keys.where("not empty").select("key", "word").join(live, "key").groupBy("word").agg(F.array_join(F.collect_list("key"), ",").alias("keys"), F.max("loose").alias("loose"))
    told = told.select("word", F.concat("word", F.lit("="), "word", F.lit(","), "keys", F.when(F.col("loose"), ",~").otherwise("")).alias("near"))
    return words.join(told, "word").groupBy("form").agg(F.array_join(F.collect_list("near"), " ").alias("near"))


def _neighbours(near: object) -> dict[str, set[str]]:
    return {w: set(ks.split(",")) for w, _, ks in (x.partition("=") for x in near.split())} if isinstance(near, str) else {}


def overlaps(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of forms, membership): (form_a, form_b) of a training and an evaluation form that ask for the same,
    and (id, form, side, split, source) of every delivered example.

    Whether two questions are a pair depends on these two, and on how all questions write their words; not on how
    many there are. Forms meet once, however often they recur. Null questions, questions without a letter or digit,
    null ids and rows with another or a null split take no part; repeated ids stand once for each question; very long
    questions are compared whole; other columns are ignored; an empty table gives no rows.
    """
    spark = examples.sparkSession
    kind = _side("split")
    side = F.when(kind == "train", "train").when(kind.isin(*EVALUATION), "evaluation")
    # letters and digits in lower case, words apart by a blank
    norm = F.trim(F.regexp_replace(F.lower("question"), r"[^\p{L}\p{N}]+", " "))
    member = examples.select("id", F.col("question").cast("string").alias("question"), side.alias("side"), kind.alias("split"), "source")
    member = member.where("side is not null and id is not null and question is not null").withColumn("norm", norm).where("norm != ''")
    single = (F.upper("question") == F.col("question")) | (F.lower("question") == F.col("question"))
    forms = member.groupBy("norm").agg(
        F.min(F.struct(single.alias("single"), F.col("question").alias("question"))).alias("r"), F.max(F.col("side") == "train").alias("train"), F.max(F.col("side") == "evaluation").alias("evaluation")
    )
    forms = cut_lineage(forms.select(F.xxhash64("norm").alias("form"), F.col("r.question").alias("question"), "train", "evaluation"))
    stats = cut_lineage(word_statistics(forms))
    top = stats.orderBy(F.desc("n"), "word").limit(RANKED).collect()
    shared = spark.sparkContext.broadcast({r["word"]: (i, r["ordinary"]) for i, r in enumerate(reversed(top))})
    forms = cut_lineage(forms.join(_told(forms, stats, shared), "form", "left"))

    marked, left_out = _marked(forms, shared, frozenset()), frozenset()
    if small := marked.where("vague").select("word").distinct().collect():
        left_out = frozenset(r["word"] for r in small)
        marked = _marked(forms, shared, left_out)
    vague = spark.sparkContext.broadcast(left_out)
    forms = forms.withColumn("near", F.lit(None).cast("string")) if marked.isEmpty() else cut_lineage(forms.join(_near(marked), "form", "left"))

    def keyed(rows: DataFrame, words: int) -> DataFrame:
        """The keys of all forms with ``words`` ordinary words in the first segment."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ranks, left_out = shared.value, vague.value
            order = lambda w: (ranks[w][0] + 1 if w in ranks else 0, w)
            for pdf in batches:
                for at in range(0, len(pdf), 200):
                    part = pdf.iloc[at : at + 200]
                    found = []
                    for id_, q, told, near, t, e in part[["form", "question", "told", "near", "train", "evaluation"]].itertuples(index=False, name=None):
                        form, own = Form(q, _knows(ranks, told)), _neighbours(near)
                        found += [(k, id_, t, e) for k in join_keys(form, q, order, words, own, left_out)]
                        as_train, as_evaluation = name_keys(form, order, words, left_out)
                        found += [(k, id_, True, False) for k in as_train if t] + [(k, id_, False, True) for k in as_evaluation if e]
                    yield pd.DataFrame(found, columns=["key", "form", "train", "evaluation"])

        return rows.select("form", "question", "told", "near", "train", "evaluation").mapInPandas(run, "key long, form long, train boolean, evaluation boolean")

    live, met = forms, None
    for words in range(LEVELS + 1):
        keys = cut_lineage(keyed(live, words).repartition("key"))
        load = keys.groupBy("key").agg((F.count_if("train") * F.count_if("evaluation")).alias("pairs")).where("pairs > 0")
        crowded = load.where(F.col("pairs") > CROWDED).select("key") if words < LEVELS else None
        if crowded is not None and crowded.isEmpty():
            crowded = None
        calm = keys if crowded is None else keys.join(crowded, "key", "left_anti")
        a, b = calm.where("train").select("key", F.col("form").alias("a")), calm.where("evaluation").select("key", F.col("form").alias("b"))
        found = a.join(b, "key").select("a", "b").where("a != b")
        met = found if met is None else met.unionByName(found)
        if crowded is None:
            break
        # whoever stands in a crowded key may have a partner there: both get the keys of one word more
        live = live.join(keys.join(crowded, "key", "left_semi").select("form").distinct(), "form", "left_semi")
    met = met.distinct()
    text = forms.select("form", "question", "told")
    pairs = met.join(text.toDF("a", "question_a", "told_a"), "a").join(text.toDF("b", "question_b", "told_b"), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = shared.value
        for pdf in batches:
            kept = [
                same_question(Form(x, _knows(ranks, tx)), Form(y, _knows(ranks, ty)))
                for x, tx, y, ty in zip(pdf["question_a"], pdf["told_a"], pdf["question_b"], pdf["told_b"])
            ]
            yield pdf.loc[kept, ["a", "b"]].rename(columns={"a": "form_a", "b": "form_b"})

    near = pairs.mapInPandas(verify, "form_a long, form_b long")
    equal = forms.where("train and evaluation").select(F.col("form").alias("form_a"), F.col("form").alias("form_b"))
    return near.unionByName(equal), member.select("id", F.xxhash64("norm").alias("form"), "side", "split", "source").distinct()


def overlap_pairs(examples: DataFrame) -> DataFrame:
    """(id_a, id_b), the smaller id first: every training example with every evaluation example that asks
    for the same. An id that was delivered in both splits makes no pair with itself."""
    pairs, member = overlaps(examples)
    a = member.where("side = 'train'").select(F.col("form").alias("form_a"), F.col("id").alias("x")).distinct()
    b = member.where("side = 'evaluation'").select(F.col("form").alias("form_b"), F.col("id").alias("y")).distinct()
    found = pairs.join(a, "form_a").join(b, "form_b").where("x != y")
    return found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def overlap_report(examples: DataFrame) -> DataFrame:
    """(split, source, n_examples, n_overlapping) of the evaluation splits."""
    pairs, member = overlaps(examples)
    hit = pairs.select(F.col("form_b").alias("form")).distinct().withColumn("hit", F.lit(1))
    own = member.where("side = 'evaluation'").join(hit, "form", "left")
    return own.groupBy("split", "source").agg(F.count_distinct("id").alias("n_examples"), F.count_distinct(F.when(F.col("hit") == 1, F.col("id"))).alias("n_overlapping"))
