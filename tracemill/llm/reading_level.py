"""Reading level of every document.

One interpolated n-gram model a level is trained on a bounded set of graded documents; sentences that read
like another level than their document are moved to that level's model in a few rounds, because documents
hold remarks and quotations of other levels. A document's surprisal distribution under the models gives
every sentence a difficulty, the weighted median of which is mapped to the grades by isotonic regression.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the fit takes at most (the first by a hash of their id).
MAX_LABELS = 5_000

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,60}>")
_QUOTE = re.compile(r"[“«][^“”«»]{0,300}[”»]|\"[^\"\n]{0,300}\"")
_BLOCK = re.compile(r"\n\s*\n|\n(?=[#|>*\[-])")
_HEAD = re.compile(r"\s*(#|\||Q:|-{2,}|\[\d+\]|>)")
_STOP = re.compile(r"(?<=[.!?])\s+")
# of texts without underscores
_TOKEN, _RUN = re.compile(r"\w+(?:['’]\w+)?|[.,;!?]"), re.compile(r"\w+")
_LOWER = re.compile(r"[^\W\d_]+")

# Frequent function words of the languages that the corpus may hold (fixed values).
ENGLISH = frozenset("the of and to in is that it was which for with as by at on this from or not are be has had its we can they who were when an one you will look two too no now".split())
OTHERS = {
    "de": frozenset("der die das und ist von im nach den dem des ein eine zu mit auf für nicht es war sich wurde wer als auch wie beide dort ich weil später lange danach kam".split()),
    "fr": frozenset("le la les est des une qui du en dans et il sur pour pas au ce par à été y se je que avec sont ou mais car venait où".split()),
    "es": frozenset("el los las del que en fue por una se y para con su como pero al lo es un no más porque allí antes durante venía donde sobre dice".split()),
    "it": frozenset("il lo gli della che di è una per con nel si come ma del non sono anche".split()),
    "nl": frozenset("het een van is op te dat en niet voor met zijn was aan ook er maar om".split()),
    "pt": frozenset("o os as do da que em não uma para com por mais como foi ao dos no na".split()),
}


#: Each function word with its languages.
_FUNCTION: dict[str, list[str]] = {}
for _name, _words in [("en", ENGLISH), *OTHERS.items()]:
    for _w in _words:
        _FUNCTION.setdefault(_w, []).append(_name)

#: Tokens inside a sentence with what they count as; emptied when it is full.
_SHAPES: dict[str, str] = {}


def _shape(w: str) -> str:
    """A name, a number, or the word in lower case."""
    if len(_SHAPES) > 200_000:
        _SHAPES.clear()
    made = _SHAPES[w] = "#" if w.isdigit() else "N" if w[0].isupper() else w.lower()
    return made


def is_english(text: str) -> bool:
    """English function words outweigh those of each other language. Words between two capitalised ones
    don't count, since names and titles keep their language."""
    words = _RUN.findall(text.replace("_", " ") if "_" in text else text)
    if not all(map(str.isalpha, words)):
        words = [x for w in words for x in ((w,) if w.isalpha() else _LOWER.findall(w))]
    last, get = len(words) - 1, _FUNCTION.get
    own, seen = 0, Counter()
    for i, w in enumerate(words):
        small = w[0].islower()
        if (languages := get(w if small else w.lower())) is None:
            continue
        if small and 0 < i < last and not words[i - 1][0].islower() and not (words[i + 1][0].islower() and (i + 2 > last or words[i + 2][0].islower())):
            continue
        for name in languages:
            if name == "en":
                own += 1
            else:
                seen[name] += 1
    if not own and not seen:  # no function word at all: the letters decide
        letters = [c for c in text if c.isalpha()]
        return bool(letters) and sum(c < "ɐ" for c in letters) > 0.9 * len(letters)
    return own >= max(seen.values(), default=0)


def sentences(text: str) -> list[list[str]]:
    """Tokens of the sentences; headings, table rows, markup and quotations are left out unless the text
    holds nothing else. Names count as one word, so do numbers."""
    out: list[list[str]] = []
    known = _SHAPES.get
    for keep_all in (False, True):
        for block in _BLOCK.split(_TAG.sub(" ", text).replace("_", " ")):
            if not keep_all:
                if _HEAD.match(block) and not block.lstrip().startswith(("Q:", "[")):
                    block = block.partition("\n")[2]
                block = _QUOTE.sub(" ", block)
            for s in _STOP.split(block):
                ws = _TOKEN.findall(s)
                if len(ws) - sum(map(ws.count, ".,;!?")) >= (1 if keep_all else 3):
                    out.append([known(w) or _shape(w) for w in ws])
                    out[-1][0] = "#" if ws[0].isdigit() else ws[0].lower()
        if out:
            break
    return out


class LevelModels:
    """Interpolated trigram models of all levels, with their counts side by side in numpy arrays."""

    def __init__(self, levels: int = 3, rounds: int = 4) -> None:
        self.levels, self.rounds = levels, rounds

    def _ids(self, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all sentences, each between two starts and an end, and the sentence of each word."""
        get, flat, owner = self.vocabulary.get, [], []
        rare = lambda w: get(f"?{min(len(w) // 3, 5)}", 2)
        for k, s in enumerate(sents):
            flat += [0, 0]
            flat += [get(w) or rare(w) for w in s]
            flat.append(1)
            owner.append(len(s) + 3)
        return np.array(flat, np.int64), np.repeat(np.arange(len(sents)), owner)

    def _keys(self, ids: np.ndarray) -> list[np.ndarray]:
        v = len(self.vocabulary) + 8
        before = np.concatenate([[0], ids[:-1]]) if len(ids) else ids
        two = np.concatenate([[0, 0], ids[:-2]])[: len(ids)]
        return [ids, before * v + ids, (two * v + before) * v + ids]

    def _count(self, ids: np.ndarray, owner: np.ndarray, weight: np.ndarray) -> None:
        real = ids != 0
        self.total = np.zeros(self.levels)
        np.add.at(self.total, np.arange(self.levels), weight[owner[real]].sum(axis=0))
        self.tables = []
        v = len(self.vocabulary) + 8
        for keys in self._keys(ids):
            pairs = []
            for k in (keys[real], keys[real] // v):  # the n-gram, its history
                unique, place = np.unique(k, return_inverse=True)
                counts = np.zeros((len(unique) + 1, self.levels))
                np.add.at(counts, place, weight[owner[real]])
                pairs.append((unique, counts))
            self.tables.append(pairs)

    @staticmethod
    def _lookup(pair: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        unique, counts = pair
        at = np.searchsorted(unique, keys)
        at[at >= len(unique)] = 0
        return counts[np.where(unique[at] == keys, at, len(unique))]

    def surprisal(self, sents: list[list[str]]) -> np.ndarray:
        """Mean surprisal a token of each sentence under each level."""
        if not sents:
            return np.zeros((0, self.levels))
        ids, owner = self._ids(sents)
        keys, v = self._keys(ids), len(self.vocabulary) + 8
        real = ids != 0
        p = (self._lookup(self.tables[0][0], keys[0][real]) + 0.1) / (self.total + 2_000)
        for order in (1, 2):
            k = keys[order][real]
            seen, history = self._lookup(self.tables[order][0], k), self._lookup(self.tables[order][1], k // v)
            p = (p + seen) / (1 + history)
        cost, tokens = np.zeros((len(sents), self.levels)), np.zeros(len(sents))
        surprise, mine = -np.log(p), owner[real]
        for level in range(self.levels):
            cost[:, level] = np.bincount(mine, surprise[:, level], len(sents))
        tokens += np.bincount(mine, minlength=len(sents))
        return cost / tokens[:, None]

    def difficulty(self, sents: list[list[str]]) -> float:
        """Weighted median over the sentences of the expected level; a sentence weighs the root of its length."""
        return float(self._medians(sents, np.zeros(len(sents), np.int64), 1)[0])

    def _medians(self, sents: list[list[str]], document: np.ndarray, n: int) -> np.ndarray:
        cost = self.surprisal(sents)
        lengths = np.array([len(s) + 1 for s in sents], float)
        p = np.exp(-(cost - cost.min(axis=1, keepdims=True)) * lengths[:, None])
        expected = (p / p.sum(axis=1, keepdims=True)) @ np.arange(1, self.levels + 1)
        out = np.full(n, (1 + self.levels) / 2)
        order = np.lexsort((expected, document))
        sums = np.cumsum(np.sqrt(lengths)[order])
        ends = np.cumsum(np.bincount(document, minlength=n))
        before = np.concatenate([[0.0], sums])[np.concatenate([[0], ends[:-1]])]
        some = np.diff(ends, prepend=0) > 0
        half = (before + sums[np.maximum(ends - 1, 0)]) / 2 if len(sums) else before
        at = np.clip(np.searchsorted(sums, half * (1 - 1e-12)), 0, np.maximum(ends - 1, 0))
        out[some] = expected[order[at[some]]]
        return out

    def levels_of(self, texts: list[str]) -> np.ndarray:
        split = [sentences(t) for t in texts]
        document = np.repeat(np.arange(len(split)), [len(s) for s in split])
        scores = self._medians([s for ss in split for s in ss], document, len(split))
        return np.clip(np.rint(np.interp(scores, self.knots, self.grades)), 1, self.levels).astype(np.int64)

    def fit(self, labelled: list[tuple[str, int]]) -> LevelModels:
        split = [(sentences(t), level) for t, level in labelled]
        sents = [s for ss, _ in split for s in ss]
        grade = np.array([level - 1 for ss, level in split for _ in ss], np.int64)
        often = Counter(w for s in sents for w in s)
        self.vocabulary: dict[str, int] = {}
        for w in [*sorted(w for w, n in often.items() if n > 1), *(f"?{k}" for k in range(6))]:
            self.vocabulary[w] = len(self.vocabulary) + 3
        ids, owner = self._ids(sents)
        given, assigned = np.eye(self.levels)[grade], grade
        for _ in range(self.rounds):
            self._count(ids, owner, np.eye(self.levels)[assigned])
            moved = (self.surprisal(sents) - 0.15 * given).argmin(axis=1)
            if (moved == assigned).all():
                break
            assigned = moved
        document = np.repeat(np.arange(len(split)), [len(ss) for ss, _ in split])
        scores = self._medians(sents, document, len(split))
        self.knots, self.grades = isotonic(scores, np.array([level for _, level in split], float))
        return self


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing function nearest to y (pool adjacent violators)."""
    xs, place = np.unique(x, return_inverse=True)
    n = np.bincount(place).astype(float)
    means = np.bincount(place, weights=y) / n
    pools: list[list[float]] = []
    for i, (m, w) in enumerate(zip(means, n)):
        pools.append([m, w, i, i])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    knots = [xs[i] for p in pools for i in ((p[2], p[3]) if p[2] != p[3] else (p[2],))]
    return np.array(knots), np.array([p[0] for p in pools for _ in range(1 if p[2] == p[3] else 2)])


def reading_levels(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, level): the level, 1 to 3, of every document of English prose.

    Documents of the source trainer_log, null or blank texts and texts in other languages have no row; the
    column lang isn't trusted. Repeated rows are graded each. The fit takes at most ``max_labels`` graded
    documents (by a hash of their id); labels without a text are left out; without any graded
    document (or any document) there is nothing to learn from and the result is empty. Null ids have no row.
    """
    few = labels.select("doc_id", "level").where("doc_id is not null and level is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    graded = documents.select("doc_id", "text").join(F.broadcast(few), "doc_id").where("text is not null").select("text", "level").distinct()
    rows = sorted((r["text"], r["level"]) for r in graded.collect())
    if not rows:
        return documents.sparkSession.createDataFrame([], "doc_id long, level int")
    shared = documents.sparkSession.sparkContext.broadcast(LevelModels().fit(rows))

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = shared.value
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                part = part[[is_english(t) for t in part["text"]]]
                if len(part):
                    yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "level": models.levels_of(list(part["text"]))})

    prose = documents.select("doc_id", "text", "source").where(r"doc_id is not null and text is not null and (source is null or source != 'trainer_log') and text rlike '(?U)\\S'")
    return prose.select("doc_id", "text").mapInPandas(grade, "doc_id long, level int")
