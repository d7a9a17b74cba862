"""Broken prompt and response pairs.

The answer is taken out of its response, whatever the layout. Copies of the question are found by
compressing the answer with its prompt as a zstandard dictionary; refusals, missing values and languages by
dictionaries; truncated answers by the terminal-context model that is trained on artificially cut answers.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import truncation
from tracemill.llm.reading_level import ENGLISH, OTHERS
from tracemill.session import bounded_sample

#: Words for a missing value (fixed values).
MISSING = frozenset("none null nil nan na n/a n.a. n.a #n/a undefined unknown missing empty blank tbd tba void keine leer unbekannt aucun aucune néant vide inconnu ninguno ninguna nada vacío desconocido".split()) | {"not available", "no answer", "no response", "not applicable", "keine angabe", "keine antwort", "k. a", "k.a", "sans réponse", "non disponible", "pas de réponse", "sin respuesta", "sin datos", "no disponible"}

# Phrases by which an answer declines, by language; each is a regular expression on lower-case text.
REFUSALS = {
    "en": [
        r"\b(?:i|we)(?: (?:am|are)|['’]m|['’]re) (?:\w+ )?(?:unable|not able|not allowed|not permitted|not in a position|not at liberty|afraid i|forbidden|prohibited)",
        r"\b(?:i|we) (?:\w+ )?(?:can ?not|can['’]t|could ?n['’]t|won['’]t|will not|must not|may not|mustn['’]t|shouldn['’]t|do not|don['’]t|would not|wouldn['’]t) (?:\w+ ){0,3}(?:answer|help|assist|provide|share|discuss|comply|respond|comment|say|tell|give|fulfil|fulfill|support|offer|reply|disclose|engage|talk|speak|feel comfortable|be able)",
        r"\b(?:i|we)(?:['’]d| would) (?:rather|prefer)(?: \w+){0,2} not\b",
        r"\b(?:must|have to|need to|has to|i|we|politely|respectfully) (?:respectfully |politely )?(?:decline|refuse|pass on)\b",
        r"\b(?:request|question|query|answer) (?:is |was |has been )?(?:declined|refused|denied|rejected)\b",
        r"\b(?:falls|lies|is|goes) (?:outside|beyond) (?:of )?(?:what|my|the scope|our)\b",
        r"\b(?:not|never) (?:allowed|permitted|able|authori[sz]ed|willing|going|comfortable) (?:to|with|giving|answering|sharing|discussing)\b",
        r"\bmy (?:guidelines|rules|policy|policies|instructions|principles|training) (?:keep|prevent|forbid|do not|don['’]t|prohibit|stop|bar|won['’]t)",
        r"\bagainst (?:my|our|the) (?:guidelines|rules|polic)",
        r"\b(?:talk|speak|chat) about (?:another|something else|a different)\b|\b(?:change|another) (?:of )?(?:the )?(?:subject|topic) (?:instead|please)",
        r"^(?:sorry|apologies|unfortunately)[,.! ]+(?:but )?(?:no\b|i\b|we\b|that\b|this\b|can)",
        r"\bas an? (?:\w+ ){0,3}(?:assistant|model|agent|ai)\b.*\b(?:decline|not|can['’]t|unable|refuse)",
        r"\bno can do\b|\bno comment\b",
        r"\bask me (?:something|anything) else\b",
    ],
    "de": [
        r"\b(?:kann|darf|möchte|will|werde|könnte|würde)\b(?: \w+){0,7} (?:nicht|nichts|kein\w*)\b",
        r"\bich (?:kann|darf|möchte|will|werde)\b(?: \w+){0,6} (?:ablehnen|verzichten|schweigen)",
        r"\b(?:leider|tut mir leid)\b.*\b(?:nicht|kein\w*|ablehnen|verweigern)\b|^es tut mir leid",
        r"\blehne (?:ich )?(?:\w+ ){0,4}ab\b|\bnicht (?:gestattet|erlaubt|befugt|möglich|in der lage)\b|\b(?:untersagt|verboten|verwehrt)\b",
        r"\b(?:anderes thema|etwas anderes)\b",
    ],
    "fr": [
        r"\b(?:je|nous) (?:ne |n['’])(?:\w+ ){0,3}(?:peux|puis|pouvons|veux|dois|souhaite|suis|saurais|vais)\b",
        r"\bpréfère (?:ne|m['’]abstenir|éviter|plutôt)\b|\bpréférerais\b",
        r"\b(?:désolée?|regrette|malheureusement)\b.*\b(?:pas|impossible|refus\w*|ne)\b|^(?:désolée?|je regrette)",
        r"\b(?:interdit|impossible|défendu|pas autorisée?|pas permis|pas en mesure)\b.*\b(?:de|d['’])\b",
        r"\b(?:refuse|décline|m['’]abstiens)\b|\b(?:autre sujet|autre chose)\b",
    ],
    "es": [
        r"\bno (?:\w+ ){0,2}(?:puedo|podemos|debo|quiero|deseo|está permitido|estoy autorizad\w|es posible|voy a|estoy en condiciones)\b",
        r"\bprefiero (?:no|\w+ no)\b|\bpreferiría\b",
        r"\b(?:lo siento|lamento|lamentablemente|desgraciadamente|por desgracia)\b",
        r"\b(?:prohibido|me niego|declino|rechazo|tengo que rechazar|debo rechazar|debo declinar)\b|\b(?:otro tema|otra cosa)\b",
    ],
}
_REFUSALS = [re.compile(p) for ps in REFUSALS.values() for p in ps]

# Words that only one of the languages uses often, and letters of other scripts (fixed values).
LANGUAGES = {"en": ENGLISH | frozenset("according passage evidence points nothing else because named there answer source".split()), **{k: v for k, v in OTHERS.items()}}
LANGUAGES["es"] |= frozenset("la de qué quién a después persona ciudad segundo texto textos respuesta según trata porque allí".split())
LANGUAGES["fr"] |= frozenset("de a quel quelle après personne ville texte textes trouvés réponse passage agit nommé c'était".split())
LANGUAGES["de"] |= frozenset("welcher welchen welche in person stadt antwort lautet gefundenen texten handelt denn steht bekam hinter".split())
LANGUAGES["it"] |= frozenset("secondo testi trovati tratta proprio risposta legge secondo brano".split())
LANGUAGES["nl"] |= frozenset("volgens gevonden teksten gewoon antwoord want staat tweede".split())
LANGUAGES["pt"] |= frozenset("segundo textos encontrados resposta trecho sobre".split())
_SCRIPTS = ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "CYRILLIC", "ARABIC", "GREEK", "HEBREW", "DEVANAGARI", "THAI")

_ANSWER = re.compile(r"(?s)<answer>(.*?)(</answer\s*>|$)")
_LINE = re.compile(r"(?s)(?:^|\n)[ \t]*(?:final )?answer[ \t]*:(?!.*\n[ \t]*(?:final )?answer[ \t]*:)(.*)$", re.IGNORECASE)
_LEAD = re.compile(r"^(?:the |your |my )?(?:question|prompt|q|query|frage|la question|pregunta|la pregunta|you asked?|asked)(?: is| was| lautet| est| es)?\s*[:\-–]\s*", re.IGNORECASE)
_QUOTED = re.compile(r"[“„«][^“”„«»]*(?:[”“»]|$)|\"[^\"]*(?:\"|$)")


def letters(text: str) -> str:
    """Letters and digits in folded case, words apart by a blank."""
    return " ".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).casefold()))


def answer_of(response: str, final_answer: str | None) -> tuple[str | None, bool]:
    """The answer inside a response, and whether its place is whole: in tagged responses between closed
    tags, after the last answer label, in plain ones the final answer at the end (or all of it)."""
    body = response.strip()
    if re.match(r"<\w+>", body):
        found = list(_ANSWER.finditer(body))
        if not found:
            return None, False
        return found[-1][1], found[-1][2] != "" and body.endswith(">")
    if (m := _LINE.search(response)) is not None:
        return m[1], True
    if re.match(r"(?:Search|Found|Observation|Thought)\s*:", body):
        return None, False
    if final_answer is not None and final_answer.strip() and body.endswith(final_answer.strip()):
        return final_answer, True
    return response, True


def is_missing(answer: str) -> bool:
    """Only blanks, signs, or a word for a missing value."""
    core = answer.strip().strip("\"'“”‘’()[]{}<>*_.,;:!?…-–—  ​").casefold()
    return not any(c.isalnum() for c in core) or core in MISSING


def copy_ratio(answer: str, prompt: str) -> float:
    """Compressed size of the answer with the prompt as dictionary, over its size without: near 0 for a copy."""
    a, p = letters(answer).encode(), letters(prompt).encode()
    if len(p) < 8 or not a:
        return 1.0
    given = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(p, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(given.compress(a)) / (len(a) + 1)


def is_copy(answer: str, prompt: str) -> bool:
    """Only the prompt again, perhaps after a short lead-in. Compression with the prompt finds the candidates,
    the exact check follows: without lead-in the letters are equal."""
    if copy_ratio(answer, prompt) > 0.5:
        return False
    a, p = letters(answer), letters(prompt)
    if a == p or letters(_LEAD.sub("", answer.strip(" \t\n\"'“”«»"))) == p:
        return True
    return a.endswith(" " + p) and len(a) - len(p) <= 40 and len(a[: len(a) - len(p)].split()) <= 5


def is_refusal(answer: str, prompt: str) -> bool:
    # quoted words aren't the answer's own; without ZZ names that begin with No, Sorry or Unable are no refusal
    own = _QUOTED.sub(" ", answer).strip().casefold().replace("’", "'")
    return any(p.search(own) for p in _REFUSALS)


def language(text: str, names: set[str] | None = None) -> str | None:
    """The language of a sentence by its function words or its script; None if it can't be told."""
    scripts = Counter(s for c in text if ord(c) > 0x2FF and c.isalpha() for s in _SCRIPTS if unicodedata.name(c, "").startswith(s))
    if scripts and scripts.most_common(1)[0][1] >= 4:
        return scripts.most_common(1)[0][0]
    words = [w for i, w in enumerate(re.findall(r"[^\W\d_]+", text)) if w[0].islower() or i == 0]
    seen = Counter({k: sum(w.lower() in known for w in words) for k, known in LANGUAGES.items()})
    (first, n), (_, m) = seen.most_common(2)
    return first if n >= 2 and n > m else None


def is_wrong_language(answer: str, prompt: str) -> bool:
    """The answer is a sentence in another language than the prompt; names and quotations don't count."""
    own = _QUOTED.sub(" ", answer)
    mine, asked = language(own), language(prompt)
    return mine is not None and asked is not None and mine != asked


def defects(rollouts: DataFrame, max_train: int = truncation.MAX_TRAIN) -> DataFrame:
    """(rollout_id, defect) of every defective pair, at most one defect each.

    In this order: truncated (the response or the answer in it stops early), empty (null or blank response, or
    blanks, punctuation or a word for a missing value as answer), refusal, copies_question, wrong_language.
    A null rollout_id has no row; a null prompt copies nothing and has no language; a null final_answer says nothing; repeated rows are
    judged each; an empty table gives no rows; other columns are ignored. Names that begin with words like
    No, Sorry or Unable are no refusals; quotations have no say in language or refusal.
    """
    limits_of = rollouts.select("source", F.col("response").alias("value"))
    limits = truncation.source_limits(limits_of)
    gold = F.col("metadata.answer") if "metadata" in rollouts.columns else F.lit(None).cast("string")
    wide = rollouts.select("rollout_id", "source", "prompt", "response", "final_answer", gold.alias("gold"))
    sample = bounded_sample(wide.where("response is not null"), "rollout_id", max_train)

    def parts(r) -> tuple[str | None, bool, tuple]:
        answer, whole = answer_of(r[3], r[4])
        before = r[3][: r[3].rfind(answer)] if answer else r[3]
        return answer, whole, (r[2] or "", r[5] or "", before)

    train = []
    for r in sorted((tuple(x) for x in sample.collect()), key=repr):
        answer, whole, texts = parts(r)
        if answer is not None and whole and not is_missing(answer):
            train.append((None, answer.strip(), texts, None))
    usable = any(truncation.looks_intact(v, None) for _, v, _, _ in train)
    shared = rollouts.sparkSession.sparkContext.broadcast(truncation.CutModel({}).fit(train) if usable else None)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            ids, kinds, unsure = [], [], []
            for row in pdf.itertuples(index=False):
                r = tuple(x if isinstance(x, str) else None for x in row)
                prompt, response = r[2] or "", r[3]
                if response is None or not response.strip():
                    ids.append(row[0])
                    kinds.append("empty")
                    continue
                answer, whole, texts = parts(r)
                at_limit = limits.get(r[1]) == len(response)
                if answer is None or not whole:
                    ids.append(row[0])
                    kinds.append("truncated")
                    continue
                kind = "empty" if is_missing(answer) else "copies_question" if is_copy(answer, prompt) else "refusal" if is_refusal(answer, prompt) else "wrong_language" if is_wrong_language(answer, prompt) else None
                ids.append(row[0])
                kinds.append(kind)
                # a copy of the whole question and a missing value are complete as they are
                if kind not in ("empty", "copies_question"):
                    unsure.append((len(ids) - 1, answer.strip(), texts, at_limit))
            if model is not None and unsure:
                scores = model.scores([(None, a, texts, None) for _, a, texts, _ in unsure])
                for (i, _, _, at_limit), score in zip(unsure, scores):
                    if score > (0.2 if at_limit else 0.5):
                        kinds[i] = "truncated"
            yield pd.DataFrame([(i, k) for i, k in zip(ids, kinds) if k], columns=["rollout_id", "defect"])

    return wide.where("rollout_id is not null").mapInPandas(judge, "rollout_id long, defect string")


def defect_counts(rollouts: DataFrame) -> DataFrame:
    """(source, defect, n): how often each source has each defect."""
    found = defects(rollouts).join(rollouts.select("rollout_id", "source"), "rollout_id")
    return found.groupBy("source", "defect").agg(F.count("*").alias("n"))
