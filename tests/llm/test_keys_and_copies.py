import json
import random

from pyspark.sql import functions as F

from tracemill.llm import format_copies, grouped_split


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, q in pairs:
        if s and s.strip() and q and q.strip():
            parent[find("s" + s.strip().lower())] = find("q" + q.strip().lower())
    groups = {}
    for x in list(parent):
        if x[0] == "s":
            groups.setdefault(find(x), set()).add(x[1:])
    return {(min(g), o) for g in groups.values() for o in g if o != min(g)}


def test_linked_sources_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["A%d", " a%d ", "b%d"]) % rng.randrange(40), "q%d" % rng.randrange(45)) for _ in range(70)]
    rows += [(None, "q1"), ("a1", None), ("", "q1"), ("  ", "q1"), ("a1", " "), ("hot", "q1"), ("hot", "q1")]
    df = spark.createDataFrame([(s, q, 1, "x") for s, q in rows], "source_id string, question_id string, hub int, u string")
    for bound in (1_000_000, 3):  # one merging task, and the rounds of stars
        got = [tuple(r) for r in grouped_split.linked_sources(df, merge_edges=bound).collect()]
        assert len(got) == len(set(got)) and set(got) == components(rows)


def test_chain_of_links_becomes_one_group(spark):
    rows = [(f"s{i:03d}", f"q{j}") for i in range(60) for j in (i, i + 1)]
    df = spark.createDataFrame(rows, "source_id string, question_id string")
    for bound in (1_000_000, 5):
        got = grouped_split.linked_sources(df, merge_edges=bound).collect()
        assert len(got) == 59 and {r["first"] for r in got} == {"s000"}


def test_splits_keep_groups_whole_and_near_their_shares(spark):
    rng = random.Random(5)
    rows = [(f"s{rng.randrange(300)}", f"q{rng.randrange(4000)}") for _ in range(5000)]
    df = spark.createDataFrame(rows, "source_id string, question_id string")
    got = grouped_split.assign_splits(df).collect()
    assert len({r["member"] for r in got}) == len(got) == len({s for s, _ in rows})
    by = {}
    for r in got:
        by.setdefault(r["group"], set()).add(r["split"])
    assert all(len(v) == 1 for v in by.values())
    few = spark.createDataFrame([(f"s{i}", f"q{i}") for i in range(1000)], df.schema)
    counts = {r["split"]: r["n"] for r in grouped_split.assign_splits(few).groupBy("split").agg(F.sum("rows").alias("n")).collect()}
    assert counts == {"train": 800, "validation": 100, "test": 100}


def test_keys_of_empty_tables(spark):
    none = spark.createDataFrame([], "source_id string, question_id string")
    assert grouped_split.linked_sources(none).collect() == []
    assert grouped_split.assign_splits(none).collect() == []


def test_dealing_is_greedy():
    def slow(sizes, shares):
        lack = [s * sum(a * b for a, b in sizes) for s in shares]
        out = {}
        for size, n in sorted(sizes, reverse=True):
            for _ in range(n):
                i = max(range(len(lack)), key=lambda k: (lack[k], -k))
                lack[i] -= size
                out.setdefault(size, [0] * len(lack))[i] += 1
        return out

    for sizes in ([(5, 3), (1, 40)], [(1, 1000)], [(9, 1), (4, 7), (2, 11)]):
        shares = (0.8, 0.1, 0.1)
        dealt = {size: got for size, _, got in grouped_split._deal(sizes, shares)}
        exact = slow(sizes, shares)
        assert {s: sum(g) for s, g in dealt.items()} == dict(sizes)
        assert all(abs(a - b) <= 1 for s in exact for a, b in zip(exact[s], dealt[s]))


def brute_copies(rows):
    groups = {}
    for i, title, text, record in rows:
        key = format_copies.canonical_bytes(title, text, record)
        if key is not None and i is not None:
            groups.setdefault(key, []).append(i)
    return {(min(g), i) for g in groups.values() for i in set(g) if i != min(g)}


SCHEMA = "passage_id long, title string, text string, record string, rep long, bucket string, keep int"


def test_copies_against_brute_force(spark):
    rng = random.Random(1)
    long = "lorem ipsum " * 20_000
    texts = ["Café au lait, 3 cups.", "CAFÉ  AU LAIT 3 CUPS", "Cafe au lait 3 cups", "x", "", "  ", "!!!", None, "Straße 5", "STRASSE 5", long, long.upper(), "café au lait 3 cups"]
    rows = []
    for i in range(1, 200):
        title, text = rng.choice(["T", "t!", None, "", "U"]), rng.choice(texts)
        if rng.random() < 0.3:
            fields = [("text", text), ("title", title), ("n", 1)]
            rng.shuffle(fields)
            rows.append((i, None, None, json.dumps(dict(fields))))
        else:
            rows.append((i, title, text, None))
    rows += [(900, None, None, "{broken"), (901, None, None, "[1]"), (902, None, None, None), (None, "T", "x", None), (903, "A", "b c", None), (904, "Ab", "c", None)]
    df = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], SCHEMA)
    got = [tuple(r) for r in format_copies.copies_found(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_copies(rows)
    kept = format_copies.kept_records(df).collect()
    assert len(kept) == len({r["keep_id"] for r in kept})
    assert sum(r["copies"] for r in kept) == sum(format_copies.canonical_bytes(*r[1:]) is not None and r[0] is not None for r in rows)


def test_oversized_buckets_are_split_exactly(spark):
    common = "a" * 900
    rows = [(f"{common}{i % 37:03d}".encode(), i, 1, i) for i in range(300)] + [(f"b{i}".encode(), 1000 + i, 1, 1000 + i) for i in range(50)]
    reps = spark.createDataFrame(rows, "canon binary, rep long, copies long, low long")
    for limit in (2_000, 10_000, 10**9):
        buckets = format_copies.radix_buckets(reps, limit).collect()
        place, size = {}, {}
        for r in buckets:
            place.setdefault(bytes(r["canon"]), set()).add(bytes(r["bucket"]))
            size.setdefault(bytes(r["bucket"]), {}).setdefault(bytes(r["canon"]), []).append(len(r["canon"]))
        assert len(buckets) == 350 and all(len(v) == 1 for v in place.values())
        # a bucket fits, or holds one text only
        assert all(len(texts) == 1 or sum(map(sum, texts.values())) <= limit for texts in size.values())


def test_repeated_ids_are_one_row_a_record(spark):
    df = spark.createDataFrame([(1, "t", "A b")] * 2 + [(1, "t", "c d"), (2, "T", "a-b")], "passage_id long, title string, text string").repartition(3)
    assert sorted(tuple(r) for r in format_copies.format_copies(df).collect()) == [(1, 1, 1), (1, 1, 3), (1, 1, 3), (2, 1, 3)]


def test_a_task_folds_in_bounded_memory(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(format_copies, "FOLD_BYTES", 1_000)
    rows = pd.DataFrame([(i, "t", f"text {i % 7}", None) for i in range(50)], columns=["id", "title", "text", "record"])
    made = pd.concat(list(format_copies._fold_task(iter([rows[k : k + 5] for k in range(0, 50, 5)]))))
    reps = made[made["canon"].notna()]
    assert len(reps) > 7 and reps["rep"].is_unique and reps["copies"].sum() == 50
    assert set(made[made["canon"].isna()]["rep"]) == set(reps["rep"])


def test_trie_counts_prefixes_apart():
    trie = format_copies.Trie()
    keys = [b"", b"a", b"a" * 16, b"a" * 17, b"a" * 32, b"a" * 33]
    for k in keys * 2:
        trie.add(k, len(k), 1)
    assert [trie.add(k, 99, 1) for k in keys] == [[len(k), 3] for k in keys]


def test_copies_of_an_empty_table_and_without_records(spark):
    assert format_copies.copies_found(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "t", "A b"), (2, "T", "a-b"), (2, "T", "a-b")], "passage_id long, title string, text string")
    assert {tuple(r) for r in format_copies.copies_found(df).collect()} == {(1, 2)}
