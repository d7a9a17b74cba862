import random
import re

import numpy as np
import pytest

from tracemill.llm import defects, leakage, reading_level, split_overlap, tokens, truncation

# -- questions across splits ---------------------------------------------------------------------------------


def test_edited_questions_meet_in_a_key_at_every_level():
    """However crowded a segment is, two questions with k edits of ordinary words share a key of each level."""
    rng = random.Random(2)
    names = {"foo", "bar", "baz", "qux"}
    form = lambda q: split_overlap.Form(q, lambda w: w not in names)
    for _ in range(200):
        words = rng.sample("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split(), 8)
        a = words + rng.sample(sorted(names), 3)
        b = list(a)
        for i in rng.sample(range(8), rng.randrange(0, 4)):
            b[i] = f"new{chr(97 + i)}"
        rng.shuffle(b)
        order = lambda w: (len(w), w)
        for level in range(4):
            x, y = (set(split_overlap.join_keys(form(q), q, order, level)) for q in (" ".join(a), " ".join(b)))
            assert x & y, (a, b, level)


def _longest_common(a, b):
    row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
    return row[-1][-1]


def test_banded_matching_equals_the_whole_table():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.choice("abcde") for _ in range(rng.randrange(0, 12))]
        b = [rng.choice("abcde") for _ in range(rng.randrange(0, 12))]
        assert split_overlap._longest(a, b, set(), 16) == _longest_common(a, b)


EXAMPLES = "id string, question string, split string, source string, names string, k int"


def examples(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], EXAMPLES)


def test_overlaps_of_questions(spark):
    base = "Which prize did the editor of Tidrikiwi and the River receive in Brediwigre Hollow after the journal appeared in 1790?"
    rows = [
        ("t1", base, "train", "a"),
        ("t1", base, " Train ", "a"),
        ("t2", "Who taught the painter of the mural Velvet Savilemir during the years spent in Kostowiapia Heath?", "train", "a"),
        ("t3", "At which academy in Rofiathawiasberg did the author of the novel The Kugiahepal Clock study before 1972?", "train", "b"),
        ("t4", None, "train", "a"),
        ("t5", base, None, "a"),
        ("e1", base.upper(), "validation", "b"),
        ("e2", base.replace("prize", "award").replace("receive", "get"), "TEST", "b"),
        ("e3", base.replace("1790", "1791"), "test", "b"),
        ("e4", base.replace("Brediwigre", "Cezugifom"), "test", "b"),
        ("e5", "Question: Before 1972, at which academmy in Rofiathawiasberg did the author of the novel The Kugiahepal Clock study??", "dev", "b"),
        ("e6", "Who taught the painter of the mural Velvet Savilemir during the years spent in Wiathizavel?", "dev", "b"),
        ("e7", None, "dev", "b"),
        ("e8", "", "dev", "b"),
        ("e9", "?!", "dev", None),
    ]
    filler = [(f"f{i}", f"Which academy did the author study before the journal appeared? Number {i}", "train", "c") for i in range(3)]
    got = {tuple(r) for r in split_overlap.overlap_pairs(examples(spark, rows + filler)).collect()}
    assert got == {("e1", "t1"), ("e2", "t1"), ("e5", "t3")}
    report = {(r["split"], r["source"]): (r["n_examples"], r["n_overlapping"]) for r in split_overlap.overlap_report(examples(spark, rows + filler)).collect()}
    assert report[("validation", "b")] == (1, 1) and report[("test", "b")] == (3, 1) and report[("dev", "b")] == (2, 1)


def test_overlaps_of_an_empty_table_and_long_questions(spark):
    assert split_overlap.overlap_pairs(examples(spark, [])).collect() == []
    long = "Where is " + " ".join(f"Name{chr(97 + i % 26)}{i}" for i in range(400)) + "?"
    got = split_overlap.overlap_pairs(examples(spark, [("a", long, "train", "s"), ("b", long.lower(), "test", "s")])).collect()
    assert [tuple(r) for r in got] == [("a", "b")]


def pairs_of(spark, rows):
    return {tuple(r) for r in split_overlap.overlap_pairs(examples(spark, rows)).collect()}


def test_overlaps_do_not_depend_on_the_size_of_the_table(spark):
    rows = [
        ("t1", "Which zymurgy did Tidrikiwi study quixotically in 1790?", "train", "a"),
        ("e1", "WHICH ZYMURGY DID TIDRIKIWI STUDY QUIXOTICALLY IN 1790?", "test", "b"),
        ("e2", "which zymurgi did tidrikiwi study quixotcally in 1790?", "test", "b"),
        ("e3", "WHICH ZYMURGY DID TIDRIKAWO STUDY QUIXOTICALLY IN 1790?", "test", "b"),
        ("t2", "Who met Zymurgist in 1791?", "train", "a"),
        ("t3", "Where did Tidrikawo live?", "train", "a"),
    ]
    for n in (10, 20_000):
        filler = [(f"f{i}", f"What is {i} and 7?", "train", "c") for i in range(10_000, 10_000 + n)]
        assert pairs_of(spark, rows + filler) == {("e1", "t1"), ("e2", "t1")}


def test_other_facts_about_the_same_things_are_no_overlap(spark):
    rows = [
        ("a1", "Who directed Titanic in Boston?", "train", "s"),
        ("b1", "When was Titanic released in Boston?", "test", "s"),
        ("b2", "Who produced Titanic in Boston?", "test", "s"),
        ("b3", "who directed titanic, in boston", "test", "s"),
        ("a2", "What is the capital of the largest country?", "train", "s"),
        ("b4", "What is the population of the smallest country?", "test", "s"),
        ("b5", "What is the captial of the largest country?", "test", "s"),
        ("b6", "Please tell me: what's the capital of the largest country?", "test", "s"),
        ("a3", "Where did Anna Berg meet the painter Carl Dorn before 1920?", "train", "s"),
        ("b7", "Before 1920, where did Anna Berg meet the painter Carl Dorn?", "test", "s"),
        ("b8", "Where did Anna Berg meet the writer Carl Dorn before 1921?", "test", "s"),
        ("b9", "Where did Carl Dorn meet the painter Anna Berg before 1920?", "test", "s"),
    ]
    assert pairs_of(spark, rows) == {("a1", "b3"), ("a2", "b5"), ("a3", "b7")}


def test_questions_without_names_meet_only_their_like(spark):
    """Linear: two thousand questions a side of one pattern, each with one partner."""
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:05d}")
    text = [f"what is the colour of the {word(i)} {word(i + 40_000)} in winter" for i in range(2_000)]
    rows = [(f"t{i}", t, "train", "s") for i, t in enumerate(text)] + [(f"e{i}", t.capitalize() + "?", "test", "s") for i, t in enumerate(text)]
    assert pairs_of(spark, rows) == {(f"e{i}", f"t{i}") for i in range(2_000)}


def test_a_crowded_name_is_split_by_further_words(spark):
    """Three hundred facts about the same two names a side: only equal facts are pairs."""
    word = lambda i: "".join("bcdfghklmn"[int(d)] + "ao"[int(d) % 2] for d in f"{i:03d}")
    text = [f"Who {word(i)} and {word(i + 300)} the {word(i + 600)} of Anna Berg?" for i in range(300)]
    rows = [(f"t{i}", t, "train", "s") for i, t in enumerate(text)] + [(f"e{i}", t.upper(), "test", "s") for i, t in enumerate(text)]
    assert pairs_of(spark, rows) == {(f"e{i}", f"t{i}") for i in range(300)}


def test_no_pair_that_is_the_same_question_is_left_out(spark):
    """Names told by capitals alone or written small, several slips without names, lead-ins: all pairs are compared."""
    rows = [
        ("a1", "Who painted the Great Wall before the storm reached Harbour Street?", "train"),
        ("b1", "Who painted the Great Wall before the gale reached Harbour Street?", "test"),
        ("f1", "was a great wall built in the street by the harbour", "none"),
        ("f2", "Is a great wall in every street or harbour", "train"),
        ("a2", "Where did polish traders from Oslo meet Anna Berg in Turkey?", "train"),
        ("b2", "Where did traders from Oslo meet Anna Berg in Turkey?", "test"),
        ("f3", "Who speaks Polish, and where is Polish taught?", "train"),
        ("f4", "Is the Polish language old?", "train"),
        ("a3", "what is the capital of the largest country", "train"),
        ("b3", "what is the captial of the largest country", "test"),
        ("b4", "what is teh capital of the largest country", "test"),
        ("b5", "i wonder what is the capital of the largest country", "test"),
        ("b6", "Quick one: the capital of the largest country", "test"),
        ("a4", "was it there", "train"),
        ("b7", "is it there", "test"),
        ("a5", "Where did Oslo keep the lantern harvest meadow copper violin orchard?", "train"),
        ("b8", "Where did Oslo keep a lantern, harvest meadow copper violin orchard now?", "test"),
        ("b9", "Where did Oslo keep the harvest meadow copper violin orchard?", "test"),
        *((f"g{i}", f"Which Lantern Harvest Meadow Copper Violin Orchard in {i} is it?", "train") for i in range(5)),
    ]
    rng = random.Random(6)
    words = "river castle novel teacher garden Anna Berg Oslo Wall Great Turkey Polish street march May 1790 the of".split()
    for i in range(120):
        q = rng.sample(words, rng.randrange(2, 8))
        for n in range(2):
            p = list(q)
            for _ in range(rng.randrange(3)):
                j = rng.randrange(len(p))
                w = p[j]
                c = rng.randrange(len(w))
                p[j] = rng.choice([w[:c] + w[c + 1 :], w[:c] + w[c] + w[c:], w.lower(), w.capitalize(), rng.choice(words)])
            lead = rng.choice(["", "", "please say now ", "well, ", "I wonder "])
            text = lead + "Which " + " ".join(w for w in p if w)
            rows.append((f"r{i}.{n}", rng.choice([str, str, str.lower, str.upper])(text + rng.choice(["?", "", ", please"])), ("train", "test")[n]))
    norm = lambda q: re.sub(r"[\W_]+", " ", q.lower()).strip()
    asked = {}
    for _, q, split in rows:
        if split != "none":
            asked[norm(q)] = min(asked.get(norm(q), (True, "~")), (split_overlap.one_case(q), q))
    told = {}
    for _, q in asked.values():
        for w, r in split_overlap.Form(q, lambda w: None).role.items():
            told[w] = told.get(w, 0) + {"ordinary": 1, "name": -1}.get(r, 0)
            told.setdefault((w, "told"), False)
            told[w, "told"] |= r in ("ordinary", "name")
    form = {n: split_overlap.Form(q, lambda w: told[w] > 0 if told.get((w, "told")) else None) for n, (_, q) in asked.items()}
    want = {
        (min(x, y), max(x, y))
        for x, p, s in rows
        for y, q, t in rows
        if s == "train" and t == "test" and (norm(p) == norm(q) or split_overlap.same_question(form[norm(p)], form[norm(q)]))
    }
    assert {("a1", "b1"), ("a2", "b2"), ("a3", "b3"), ("a3", "b4"), ("a3", "b5"), ("a4", "b7")} <= want
    got = pairs_of(spark, [(i, q, s, "s") for i, q, s in rows])
    assert got == want


def test_pairs_of_crowded_segments_are_not_left_out(spark, monkeypatch):
    """With further words demanded of every segment, questions with lead-ins, slips and edits still meet."""
    monkeypatch.setattr(split_overlap, "CROWDED", 0)
    rows = [
        ("a1", "Who taught the famous painter of the large mural about Anna Berg?", "train", "s"),
        ("b1", "Well now, who taught the famos paintr of the large murall about Anna Berg?", "test", "s"),
        ("b2", "Who taught the painter of the mural about Anna Berg?", "test", "s"),
        ("b3", "Who about Anna Berg?", "test", "s"),
        ("a2", "Who met Anna Berg?", "train", "s"),
        ("b4", "Who saw Anna Berg?", "test", "s"),
        ("b5", "Who met Anna Berg, please?", "test", "s"),
    ]
    assert pairs_of(spark, rows) >= {("a1", "b1"), ("a1", "b2"), ("a2", "b5")}


# -- tokenizer --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder.from_file(tokens.tokenizer_path())


ODD = ["", None, "a" * 3000, "=" * 700 + " x", "<|endoftext|> hi", " \n\n  x 　é", "é́ﬁ", "\U0001f600" * 90, "x" * 200 + "\x00" * 300, "0123456789" * 50, "it's we'LL", "ein Stück Straße", "二つ目の文章", "ab " * 5000]


def test_ids_equal_the_reference_library(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    plain = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("abcdeé ,.\n'二9-") for _ in range(rng.randrange(200))) for _ in range(300)]
    offsets, ids = encoder.encode_batch(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == plain.encode_ordinary(t or "")


def test_heap_and_matrix_agree(encoder):
    rng = random.Random(5)
    pieces = ["".join(rng.choice("abcth eion") for _ in range(rng.randrange(1, 120))).encode() for _ in range(200)]
    assert [a.tolist() for a in encoder._matrix(pieces)] == [encoder._heap(p).tolist() for p in pieces]


def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5), (None, "a", 5), (1, "hello world", 5)], "doc_id long, text string, ids int")
    got = tokens.encode_corpus(df).collect()
    assert sorted((r["doc_id"] or 0, tuple(r["ids"])) for r in got) == [(0, (64,)), (1, (31373, 995)), (1, (31373, 995)), (2, ()), (3, ())]
    assert tokens.encode_corpus(df.limit(0)).collect() == []


# -- leaked evaluation texts ------------------------------------------------------------------------------------

ITEM = "Children of Biawostiajim know Nustel Guvugusten less for The Tazograbos Garden than for the 354 lamps along the quay of Nibitaprur Heath."
NOTE = "Read the evidence below, answer in one short phrase, and name the passage that supports every step you take. "


def test_leaks(spark):
    items = spark.createDataFrame([(i, NOTE + f"Item {i} has Own{i}word and Other{i}name, Third{i}thing with Fourth{i}part in Fifth{i}place.", 1) for i in range(4)] + [(9, ITEM, 1), (10, None, 1), (11, "", 1)], "item_id long, text string, words int")
    changed = ITEM.replace("less", "more").replace("lamps", "lights")
    docs = [
        (1, "start " + ITEM.upper().replace(" ", "\n") + " end"),
        (2, "x <b>" + changed.replace("quay", "**quay**").replace("than", "</i>than") + "</b>"),
        (3, NOTE * 3),
        (4, "They know Nustel Guvugusten less for The Tazograbos Garden"),
        (5, "Children of Elsewhere know Somebody Different for less, and the 12 lamps along the quay of Third Bay."),
        (6, None),
        (7, ""),
        (8, "word " * 60_000 + ITEM),
        (1, "start " + ITEM),
        (None, ITEM),
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    rows = leakage.leaked_passages(df, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(1, 9), (1, 9), (2, 9), (8, 9)]
    whole = dict(docs[:1])[1]
    place = next(r for r in rows if r["doc_id"] == 1 and whole[r["start_char"] :].startswith("CHILDREN"))
    assert whole[place["start_char"] : place["end_char"]].endswith("HEATH")
    assert [tuple(r) for r in leakage.leaked_items(df, items).collect()] == [(9, 3)]
    assert leakage.leaked_passages(df.limit(0), items).collect() == []
    assert leakage.leaked_passages(df, items.limit(0)).collect() == []


def test_a_dozen_verbatim_words_are_a_leak_without_rare_words(spark):
    """Pattern words of many items and numbers, in an order that stands in one item only."""
    pattern = "the {} had stood unfinished for {} weeks and an inventory from {} lists the {} among other things"
    names = ["tower", "river", "clock", "garden"]
    items = spark.createDataFrame([(10 * i + j, pattern.format(a, 700 + 10 * i + j, 1800 + 10 * i + j, b)) for i, a in enumerate(names) for j, b in enumerate(names)], "item_id long, text string")
    docs = [
        (1, "> Tower had stood unfinished for 702 weeks and\n> an <b>inventory</b> from 1802 lists"),
        (2, "tower had stood unfinished for 702 weeks and an inventory"),  # ten words
        (3, "tower had stood unfinished for 999 weeks and an inventory from 1666 lists the"),  # numbers of no item
        (4, "tower had stood unfinished for 702 weeks and an inventory from 1802 lists the"),
    ]
    rows = leakage.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert [tuple(r) for r in rows.select("doc_id", "item_id").collect()] == [(1, 2), (4, 2)]


def as_items(text):
    words = " ".join(w for w, _, _ in leakage.words(text))
    return leakage.Items([(9, words, "2" * len(words.split()))])


def test_every_passage_is_reported():
    weeks = "which had stood unfinished for many weeks when the jury came and asked for a list of all that was left"
    got = as_items(ITEM + " " + weeks).leaks(f"{ITEM}. Then: {weeks}")
    assert len(got) == 2 and {x[0] for x in got} == {9}
    # the longer run has too many changed words, the shorter one is verbatim
    swapped = " ".join("xyz" if k % 2 else w for k, w in enumerate((ITEM + " " + weeks).split() + ["end"] * 9))
    short = " ".join(weeks.split()[:12])
    runs = as_items(ITEM + " " + weeks).leaks(f"{swapped} Then: {short}")
    assert [x[6] for x in runs] == [12]


def test_leaks_depend_neither_on_the_count_of_items_nor_on_the_parts(spark):
    """Copies of an item, a hundred times as many items, and parts of the set: the passage is found each time."""
    changed = ITEM.replace("less", "more").replace("lamps", "lights").replace("Garden", "Park")
    docs = spark.createDataFrame([(1, ITEM), (2, changed), (3, "nothing of that kind stands here")], "doc_id long, text string")
    other = lambda i: " ".join(f"{w}{i % 97}" if k % 3 else w for k, w in enumerate(ITEM.split())) + f" Number{i}."
    for copies, more in ((1, 0), (4, 40), (4, 4_000)):
        items = spark.createDataFrame([(i, ITEM) for i in range(copies)] + [(100 + i, other(i)) for i in range(more)], "item_id long, text string")
        want = sorted((d, i) for d in (1, 2) for i in range(copies))
        whole = leakage.leaked_passages(docs, items).select("doc_id", "item_id").distinct().collect()
        assert sorted(map(tuple, whole)) == want, (copies, more)
        parts = leakage.leaked_passages(docs, items, part_mb=0.002 if more < 100 else 0.2).select("doc_id", "item_id").distinct().collect()
        assert sorted(map(tuple, parts)) == want, (copies, more)


# -- reading level ----------------------------------------------------------------------------------------------

EASY = ["The cat is big.", "We see the red bell.", "Look at the map!", "It is on the hat.", "Tom has a dog."]
MIDDLE = ["When the search fails, the agent stores the query and tries again.", "We kept twenty examples for each table, and the score was usual.", "It helps to read the second passage twice before the next step.", "Our notes say that the early version improves the working set."]
HARD = ["Whereas stochasticity attenuates local consistency, its interaction introduces irreducible ambiguities.", "Such considerations imply that normalization constitutes the principal determinant of degradation.", "Assuming asymptotic identifiability, variance attributable to calibration diminishes proportionally."]


def document(rng, level, n=12):
    pools = [EASY, MIDDLE, HARD]
    return " ".join(rng.choice(pools[level - 1] if rng.random() > 0.2 else rng.choice(pools)) for _ in range(n))


def test_levels_on_held_out_documents(spark):
    rng = random.Random(6)
    docs = [(i, document(rng, i % 3 + 1), "en", "note") for i in range(90)]
    odd = [(200, None, "en", "note"), (201, "  ", "en", "note"), (202, docs[0][1], "en", "trainer_log"), (203, "Der Abschnitt über die Stadt liefert das fehlende Glied, und wir lesen ihn nach der Pause noch einmal.", "en", "note"), (204, docs[0][1] * 400, None, None), (205, docs[0][1], "de", "note"), (None, docs[0][1], "en", "note")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 3 + 1) for i in range(45)] + [(999, 2), (None, 1), (3, None)], "doc_id long, level int")
    got = {r["doc_id"]: r["level"] for r in reading_level.reading_levels(df, labels).collect()}
    assert set(got) == {*range(90), 204, 205}
    assert sum(got[i] == i % 3 + 1 for i in range(45, 90)) >= 43 and got[204] == got[205] == 1
    assert reading_level.reading_levels(df.limit(0), labels).collect() == []
    assert reading_level.reading_levels(df, labels.limit(0)).collect() == []


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.RandomState(0)
    x, y = rng.rand(60), rng.rand(60) + np.linspace(0, 1, 60)
    knots, values = reading_level.isotonic(x, y)
    assert (np.diff(values) >= 0).all()
    fit = np.interp(x, knots, values)
    assert ((fit - y) ** 2).sum() <= ((np.clip(x, 0, 1) + 0.5 - y) ** 2).sum() and abs(fit.mean() - y.mean()) < 1e-9


# -- defects and truncation --------------------------------------------------------------------------------------

NAMES = ["Nustel Guvugusten", "Ciaca Breredski", "Tovis Stunirerir", "Lofim Dicedrihia", "Vogrir Tebamige", "Pecu Brikibrebir", "Sefu Statheski", "Jiro Dodokuski"]
PLACES = ["Nibitaprur Heath", "Wawiabuzoberg", "Brediwigre Hollow", "Rofiathawiasberg", "Cezugifom Bay"]


def rollouts(n=400):
    rng = random.Random(8)
    out = []
    for i in range(n):
        who, place, year = rng.choice(NAMES), rng.choice(PLACES), rng.randrange(1700, 2000)
        prompt = f"Who taught the painter of the mural in {place} before {year}?"
        answer = rng.choice(["It was {w}, because {w} is named there as the teacher of the painter.", "According to the second passage it was {w}.", "{w}", "The evidence about {p} points to {w} and to nothing else."]).format(w=who, p=place)
        body = f"<search>{place} painter</search>\n<observation>\n[1] {place}: {who} lived in {place} until {year}.\n</observation>\n<answer>{answer}</answer>" if i % 4 else f"I compare both passages before I answer. {answer}"
        out.append((i, prompt, body, answer, rng.choice(["a", "b"]), (who,)))
    return out


SCHEMA = "rollout_id long, prompt string, response string, final_answer string, source string, metadata struct<answer:string>, value string, defect string"


def test_defects(spark):
    good = rollouts()
    prompt = "Who taught the painter of the mural in Wawiabuzoberg before 1801?"
    tagged = "<search>x</search>\n<observation>\n[1] Wawiabuzoberg: Sefu Statheski lived in Wawiabuzoberg until 1801.\n</observation>\n<answer>{}</answer>"
    cases = [
        (1001, None, "empty"),
        (1002, "  ", "empty"),
        (1003, tagged.format("  "), "empty"),
        (1004, tagged.format("N/A"), "empty"),
        (1005, tagged.format("—"), "empty"),
        (1006, tagged.format(prompt.upper()), "copies_question"),
        (1007, tagged.format("The question is: " + prompt), "copies_question"),
        (1008, tagged.format("I'm sorry, but I can't help with that request."), "refusal"),
        (1009, tagged.format("Sorry Statheski"), None),
        (1010, tagged.format("Nach den gefundenen Texten war es Sefu Statheski."), "wrong_language"),
        (1011, tagged.format("It was Sefu Statheski; the source calls it “Sefu Statheski a terminé la tour en 1801 et a vécu longtemps à Nantes.”"), None),
        (1012, tagged.format("Sefu Statheski")[:-20], "truncated"),
        (1013, tagged.format("The evidence about Wawiabuzoberg points to Sefu Statheski and to no"), "truncated"),
        (1014, tagged.format("According to the second passage it was Sefu Statheski"), None),
        (1015, "<search>x</search>\n<observation>\n[1] Wawia", "truncated"),
        (1016, tagged.format("According to the second passage it was Sefu Statheski. " * 3000), None),
    ]
    rows = [(*r, "x", "y") for r in good] + [(i, prompt, t, None, "a", ("Sefu Statheski",), "x", "y") for i, t, _ in cases] + [(None, prompt, None, None, "a", None, "x", "y"), (1017, None, tagged.format("Sefu Statheski"), None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = defects.defects(df).collect()
    got = {r["rollout_id"]: r["defect"] for r in found}
    assert len(got) == len(found)
    assert {i: got.get(i) for i, _, _ in cases} == {i: d for i, _, d in cases}
    assert sum(i in got for i in range(400)) <= 4 and 1017 not in got
    assert defects.defects(df.limit(0)).collect() == []


def test_truncation_on_held_out_cuts(spark):
    rows, cut, rng = [], set(), random.Random(9)
    for i, prompt, body, _, source, (who,) in rollouts(600):
        if i % 5 == 0:
            body = body[: rng.randrange(len(body) // 3, len(body) - 4)]
            cut.add(i)
        elif i % 7 == 0 and body.endswith("."):
            body = body[:-1]
        rows.append((i, prompt, body, "", source, (who,), "x", "y"))
    rows += [(5000, None, None, None, None, None, None, None), (5001, None, " ", None, None, None, None, None), (None, None, "x", None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = truncation.cut_values(truncation.response_rows(df)).collect()
    found = {r["id"] for r in got if r["cut"]}
    assert len(got) == len(rows) - 1 and not found & {5000, 5001}
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.02 * len(rows)
    rates = {r["source"]: r for r in truncation.cut_rates(truncation.cut_values(truncation.response_rows(df)).withColumn("field", truncation.F.lit("response"))).collect()}
    assert 0.1 < rates["a"]["rate"] < 0.3
    assert truncation.cut_values(truncation.response_rows(df.limit(0))).collect() == []


def test_traces_use_the_action_of_the_last_step(spark):
    steps = "array<struct<action:string,observation:array<struct<doc_id:string,title:string,text:string>>>>"
    full = "It was Nustel Guvugusten, because Nustel Guvugusten is named there."
    rows = [(i, "Who?", full if i % 4 else full[: 20 + i % 40], [(f"<answer>{full}</answer>", None)], "s") for i in range(200)]
    rows += [(900, None, None, None, "s"), (901, "Who?", "Nustel Guvugusten", [None, (None, None)], None), (0, "Who?", full[:20], [(f"<answer>{full}</answer>", None)], "s")]
    df = spark.createDataFrame(rows, f"trace_id long, question string, final_answer string, steps {steps}, source string")
    got = truncation.cut_values(truncation.final_answer_rows(df)).collect()
    assert len(got) == 202 and {r["id"] for r in got if r["cut"]} == {i for i in range(200) if i % 4 == 0}


def test_source_limits(spark):
    rows = [("a", "x" * 40)] * 30 + [("a", "x" * n) for n in range(1, 40)] + [("b", "x" * n) for n in range(1, 60)] + [(None, "x" * 9)] * 8 + [("c", None)]
    df = spark.createDataFrame(rows, "source string, value string")
    assert truncation.source_limits(df) == {"a": 40, None: 9}
