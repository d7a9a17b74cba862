"""Evaluation texts leaking into training text.

One Aho-Corasick automaton over pieces of three words of all normalised evaluation items scans every
normalised document once. Hits are extended along their diagonal to runs of words that stand in both, and
the run is mapped back to offsets of the original text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import cut_lineage

#: Words of a piece; words a leak has at least, changed ones included; share of changed words in a run at most.
PIECE, RUN_WORDS, CHANGED = 3, 12, 0.25
#: An instruction: twelve words in a row that stand in that many items; a word of few items is its own. Items of
#: equal words count once for both.
INSTRUCTION_WORDS, INSTRUCTION_ITEMS, OWN_ITEMS, OWN_SHARE = 12, 3, 3, 0.02

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,60}>")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[tuple[str, int, int]]:
    """Words of a text in lower case with their offsets; markup tags hold no words."""
    plain = _TAG.sub(lambda m: " " * len(m[0]), text) if "<" in text else text
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(plain)]


def item_texts(items: DataFrame) -> DataFrame:
    """(text_no, words, item_ids): the distinct word sequences of the items, each with all items that have it."""
    pieces = F.udf(lambda t: " ".join(w for w, _, _ in words(t)), "string")
    named = items.where("item_id is not null and text is not null").select("item_id", pieces("text").alias("words")).where("words != ''")
    return named.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")).withColumn("text_no", F.xxhash64("words"))


def marked_texts(texts: DataFrame) -> DataFrame:
    """(text_no, words, item_ids, kinds): ``kinds`` tells of each word whether it belongs to an instruction (0), to the
    text (1), or is one of the text's own words (2). Counted over all distinct texts, before any part is scanned.

    A dozen words in a row are an instruction if they stand in at least INSTRUCTION_ITEMS texts. A word is own if
    it stands in at most OWN_SHARE of the texts, or in OWN_ITEMS of few, and is no number: a share, so that a set a
    hundred times as large, made of texts of the same kind, has the same own words."""
    ws = F.split("words", " ")
    few = max(OWN_ITEMS, OWN_SHARE * texts.count())
    placed = texts.select("text_no", F.posexplode(ws).alias("at", "word"))
    spread = placed.groupBy("word").agg(F.count_distinct("text_no").alias("n"))
    # a word of nearly all texts would be a hot key of the join back: only own words, which are in few texts, go back
    own = spread.where((F.col("n") <= few) & ~F.col("word").rlike(r"^\d+$")).select("word")
    own_at = placed.join(own, "word").groupBy("text_no").agg(F.collect_set("at").alias("own"))
    starts = F.when(F.size(ws) >= INSTRUCTION_WORDS, F.sequence(F.lit(0), F.size(ws) - INSTRUCTION_WORDS))
    runs = texts.select("text_no", ws.alias("ws"), F.explode(starts).alias("at"))
    runs = runs.select("text_no", "at", F.xxhash64(F.array_join(F.slice("ws", F.col("at") + 1, INSTRUCTION_WORDS), " ")).alias("run"))
    often = runs.groupBy("run").agg(F.count_distinct("text_no").alias("n")).where(F.col("n") >= INSTRUCTION_ITEMS)
    told = runs.join(often, "run").groupBy("text_no").agg(F.collect_set("at").alias("told"))
    wide = texts.join(own_at, "text_no", "left").join(told, "text_no", "left")

    def mark(n, own, told):
        kinds = ["1"] * n
        for k in own if own is not None else ():
            kinds[k] = "2"
        for k in told if told is not None else ():
            kinds[k : k + INSTRUCTION_WORDS] = "0" * INSTRUCTION_WORDS
        return "".join(kinds)

    return wide.select("text_no", "words", "item_ids", F.udf(mark, "string")(F.size(ws), "own", "told").alias("kinds"))


class Items:
    """Some texts of evaluation items, ready to be looked for."""

    def __init__(self, rows: list[tuple[int, str, str]]) -> None:
        import ahocorasick

        self.words = {i: ws.split(" ") for i, ws, _ in rows}
        #: per item and position: 0 instruction, 1 text, 2 a word of its own
        self.kind = {i: [int(c) for c in kinds] for i, _, kinds in rows}
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, ws in self.words.items():
            for k in range(len(ws) - PIECE + 1):
                if any(self.kind[i][k : k + PIECE]):
                    pieces[" " + " ".join(ws[k : k + PIECE]) + " "].append((i, k))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        self.empty = not pieces
        if pieces:
            self.automaton.make_automaton()

    def _run(self, item: int, ws: list[str], k: int, p: int) -> tuple[int, int, int, int, int, int]:
        """The run through doc word k and item word p: first and last doc word, words equal outside of
        instructions, own words equal, changed words, longest stretch of equal words outside of instructions.
        A changed word stands alone between equal ones."""
        iw, kind = self.words[item], self.kind[item]
        ends = []
        same = own = changed = 0
        for step in (-1, 1):
            a, b = (k, p) if step == 1 else (k - 1, p - 1)
            last = a - step
            while 0 <= a < len(ws) and 0 <= b < len(iw):
                if ws[a] == iw[b]:
                    same += kind[b] > 0
                    own += kind[b] == 2
                    last = a
                elif 0 <= a + step < len(ws) and 0 <= b + step < len(iw) and ws[a + step] == iw[b + step] and kind[b]:
                    changed += 1
                else:
                    break
                a, b = a + step, b + step
            ends.append(last)
        exact = stretch = 0
        for a in range(ends[0], ends[1] + 1):
            b = a - k + p
            stretch = stretch + 1 if ws[a] == iw[b] and kind[b] else 0
            exact = max(exact, stretch)
        return ends[0], ends[1], same, own, changed, exact

    def leaks(self, text: str) -> list[tuple[int, int, int, int, int, int, int]]:
        """(item, start, end, words equal, own words equal, changed words, longest equal stretch) of every run
        that is a leak."""
        found = words(text)
        ws = [w for w, _, _ in found]
        if self.empty or len(ws) < PIECE:
            return []
        joined = " " + " ".join(ws) + " "
        at, pos = {}, 0
        for k, w in enumerate(ws):
            at[pos] = k
            pos += len(w) + 1
        hits: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for end, places in self.automaton.iter(joined):
            k = at[joined.rfind(" ", 0, joined.rfind(" ", 0, joined.rfind(" ", 0, end)))]
            for item, p in places:
                hits[item][k - p].append((k, p))
        out = []
        for item, diagonals in hits.items():
            for places in diagonals.values():
                done = -1
                for k, p in places:
                    if k <= done:
                        continue
                    first, done, same, own, changed, exact = self._run(item, ws, k, p)
                    if is_leak(same, own, changed, exact):
                        out.append((item, found[first][1], found[done][2], same, own, changed, exact))
        return out


def is_leak(same: int, own: int, changed: int, exact: int) -> bool:
    """A dozen equal words in a row outside of instructions are a leak whatever the words; with changed words
    between, two own words must tell the passage from another text of the same pattern."""
    return exact >= RUN_WORDS or same + changed >= RUN_WORDS and own >= 2 and changed <= CHANGED * (same + changed)


#: The automata of this process, by the broadcast they were built from: built once, not for each task.
_BUILT: dict[int, Items] = {}


def _items(shared) -> Items:
    known = _BUILT.get(shared._bid) if hasattr(shared, "_bid") else None
    if known is None:
        _BUILT.clear()  # one part is scanned at a time
        known = Items(shared.value)
        if hasattr(shared, "_bid"):
            _BUILT[shared._bid] = known
    return known


def leaked_passages(documents: DataFrame, items: DataFrame, part_mb: int = 64) -> DataFrame:
    """(doc_id, item_id, start_char, end_char, words): every passage of an item in a document.

    A passage has at least RUN_WORDS words in a row of the item's own text, apart from case, punctuation,
    spacing, markup and single changed words. A passage in which every dozen words hold a changed one counts
    only with two own words (in at most OWN_SHARE of the items, or OWN_ITEMS of few, and no numbers), since items of
    one pattern differ in such words. Instructions that stand in many items are no own text.
    Null ids and null or empty texts and items match nothing; items with equal text are one text for all counts and are
    all reported; a repeated document row is reported for each row. A part of ``part_mb`` of the distinct item texts goes
    to every task as one automaton; larger sets are scanned part by part, with the counts of the whole set.
    """
    spark = documents.sparkSession
    marked = cut_lineage(marked_texts(cut_lineage(item_texts(items))))
    size = marked.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = int(size // (part_mb * 1_000_000)) + 1
    docs = documents.select("doc_id", "text").where("text is not null and doc_id is not null")
    found = None
    for part in range(parts):
        own = marked if parts == 1 else marked.where(F.pmod("text_no", F.lit(parts)) == part)
        rows = [tuple(r) for r in own.select("text_no", "words", "kinds").collect()]
        here = docs.mapInPandas(_scanner(spark.sparkContext.broadcast(rows)), "doc_id long, text_no long, start_char int, end_char int, words int")
        found = here if found is None else found.unionByName(here)
    return found.join(marked.select("text_no", F.explode("item_ids").alias("item_id")), "text_no").select("doc_id", "item_id", "start_char", "end_char", "words")


def _scanner(shared):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _items(shared)
        for pdf in batches:
            out = [
                (doc, item, start, end, same)
                for doc, text in zip(pdf["doc_id"], pdf["text"])
                if isinstance(text, str)
                for item, start, end, same, *_ in known.leaks(text)
            ]
            yield pd.DataFrame(out, columns=["doc_id", "text_no", "start_char", "end_char", "words"])

    return scan


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, n_documents): which items leaked, and into how many documents."""
    return leaked_passages(documents, items).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"))
