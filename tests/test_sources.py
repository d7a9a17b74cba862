import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import ingest, shred
from tracemill.sources import drift, files, logs
from tracemill.streaming import variance


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_record_files(spark, tmp_path):
    lines = put(tmp_path / "a.jsonl", '{"id": 1}\n\n{"id": 2}\n')
    array = put(tmp_path / "b.json", '[{"id": 1, "x": [1, {"y": "é"}]}, {"id": 2}]')
    single = put(tmp_path / "c.json", '{"id": 1}')
    assert files.read_records(spark, lines).count() == 2
    assert [json.loads(r["record"])["id"] for r in files.read_records(spark, array).collect()] == [1, 2]
    assert files.read_records(spark, single, single=True).count() == 1
    with pytest.raises(ValueError):
        files.read_records(spark, single)


def test_examples_get_their_defaults(spark, tmp_path):
    path = put(tmp_path / "e.jsonl", '{"id": "1", "question": "q", "answers": ["a"], "corpus": [{"doc_id": "d", "text": "t"}]}\n')
    row = files.read_examples(spark, path).first()
    assert row["corpus"][0]["title"] == "" and row["gold_doc_ids"] == [] and row["corpus_doc_ids"] == ["d"]
    with pytest.raises(Exception, match="needs id"):
        files.read_examples(spark, put(tmp_path / "f.jsonl", '{"id": "1"}\n')).collect()


def test_index_round_trip(spark, tmp_path):
    corpus = spark.createDataFrame([(0, "a", "T", "alpha beta"), (1, "a", "U", "later"), (2, "b", "V", "beta")], "pos int, doc_id string, title string, text string")
    files.save_index(corpus, str(tmp_path / "ix"))
    index = files.load_index(spark, str(tmp_path / "ix"))
    assert index["passages"].count() == 2 and {r["term"]: r["df"] for r in index["terms"].collect()}["beta"] == 2
    spark.range(1).select(F.lit(2).alias("version")).write.mode("overwrite").parquet(str(tmp_path / "ix/version"))
    with pytest.raises(ValueError):
        files.load_index(spark, str(tmp_path / "ix"))


def test_sinks_and_roots(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    files.write_lines(df, str(tmp_path / "out"))
    files.append_lines(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert files.write_parquet(df, str(tmp_path / "p")) and not files.write_parquet(df.limit(0), str(tmp_path / "q"))
    files.write_report(df, str(tmp_path / "r"))
    assert files.check_root("/data/x/y", ["/data"]) == "/data/x/y"
    for bad in ("/data/../etc", "/database"):
        with pytest.raises(ValueError):
            files.check_root(bad, ["/data"])


def test_manifest_shapes(spark, tmp_path):
    entry = {"id": "a", "flags": ["y", "x", "x"], "notes": "n", "reason": "r"}
    shapes = {"m.jsonl": json.dumps(entry) + "\n", "list.json": json.dumps([entry]), "rows.json": json.dumps({"rows": [entry]}), "map.json": json.dumps({"a": entry, "b": "flagged"})}
    for name, body in shapes.items():
        got = {r["id"]: (r["flags"], r["notes"]) for r in files.read_manifest(spark, put(tmp_path / name, body)).collect()}
        assert got["a"] == (["x", "y"], ["n", "r"]), name
    assert got["b"] == (["flagged"], [])


RAW = [
    {"_id": "h1", "question": "Q?", "answer": "A", "context": [["T1", ["s0", "s1"]], {"title": "T2", "text": "only"}], "supporting_facts": [["T1", 1], {"title": "T2"}, ["T1", "0"], ["T9", 0], ["T1", 5]]},
    {"id": "h2", "query_text": "Q?", "answers": ["A", "B"], "context": {"b.x[0]": ["s"], "a": "plain"}, "supporting_facts": [{"title": "a", "sent_id": 0}, {"title": "b.x[0]", "sent_idx": 0}]},
    {"uid": "h3", "question": None, "final_answer": "", "context": None, "supporting_facts": None},
]


def raw(spark):
    rows = [(i, "hotpot", json.dumps(r)) for i, r in enumerate(RAW)] + [(7, "hotpot", '{"_id": "x", "question": '), (8, "hotpot", None), (0, "hotpot", json.dumps(RAW[0]))]
    return spark.createDataFrame([(*r, "clash") for r in rows], "raw_id long, source string, record string, node string")


def test_ingest_of_mixed_layouts(spark):
    normal = ingest.normalize(raw(spark))
    got = {r["doc_id"]: (r["title"], r["text"]) for r in ingest.passages(normal, F.lit("hotpot")).collect()}
    assert got["hotpot::h1::T1::1"] == ("T1", "s1") and got["hotpot::h1::T2::0"] == ("T2", "only") and got["hotpot::h2::a::0"] == ("a", "plain") and len(got) == 5
    examples = {r["id"]: r for r in ingest.examples(normal, F.lit("p")).collect()}
    assert examples["h1"]["gold_doc_ids"][:2] == ["p::h1::T1::1", "p::h1::T2::0"] and examples["h1"]["corpus_doc_ids"] == ["p::h1::T1::0", "p::h1::T1::1", "p::h1::T2::0"]
    assert examples["h2"]["answers"] == ["A", "B"] and set(examples) == {"h1", "h2", "h3"}


def test_resolved_references(spark):
    passage = "struct<doc_id:string,title:string,text:string>"
    qa = spark.createDataFrame([("q", ["d2", None, "zz", "d2"], [("d1", None, None), None, ("d2", "t", "x")]), ("q", ["d2", None, "zz", "d2"], [("d1", None, None), None, ("d2", "t", "x")]), (None, ["d1"], [("d1", "", "")]), ("e", None, None)], f"id string, gold_doc_ids array<string>, corpus array<{passage}>")
    ro = spark.createDataFrame([(5, (["a"], [("a", "", ""), ("a", "", "")])), (6, None)], f"rollout_id long, metadata struct<gold_doc_ids:array<string>,candidate_passages:array<{passage}>>")
    got = {tuple(r) for r in shred.resolved_references(qa, ro, raw(spark)).collect()}
    assert got == {
        ("qa_examples", "q", 0, 2, 0), ("qa_examples", "q", 3, 2, 0), ("rollouts_for_grpo", "5", 0, 0, 0), ("rollouts_for_grpo", "5", 0, 1, 0),
        ("raw_records", "0", 0, 0, 1), ("raw_records", "0", 1, 1, 0), ("raw_records", "0", 2, 0, 0), ("raw_records", "1", 0, 1, 0), ("raw_records", "1", 1, 0, 0),
    }
    assert shred.resolved_references(qa.limit(0), ro.limit(0), raw(spark).limit(0)).collect() == []


def test_shredded_json_is_whole(spark):
    doc = {"a": [1, {"b": None, "c": [True, "x"]}], "d": {"e": 2.5}}
    rows = {(r["node"], r["parent"], r["label"], r["ordinal"], r["kind"], r["scalar"]) for r in shred.shred_json(spark.createDataFrame([(1, json.dumps(doc))], "k int, t string"), "k", "t").collect()}
    assert ("$.a[1].c[0]", "$.a[1].c", None, 0, "scalar", "true") in rows and ("$.a[1].b", "$.a[1]", "b", 0, "null", None) in rows and ("$.d.e", "$.d", "e", 0, "scalar", "2.5") in rows
    assert len(rows) == 10
    deep = "[" * 100_000 + "]" * 100_000
    assert shred.shred_json(spark.createDataFrame([(1, deep), (2, "")], "k int, t string"), "k", "t").collect() == []


def test_shredded_columns_and_entities(spark):
    rows = spark.createDataFrame([("r", [("d", "T"), ("e", None)], {"x": 1})], "id string, corpus array<struct<doc_id:string,title:string>>, other map<string,int>")
    nodes = shred.shred_columns(rows, "id", ["corpus"])
    assert {(r["node"], r["kind"]) for r in nodes.collect()} == {("$.corpus", "array"), ("$.corpus[0]", "object"), ("$.corpus[0].doc_id", "scalar"), ("$.corpus[0].title", "scalar"), ("$.corpus[1]", "object"), ("$.corpus[1].doc_id", "scalar"), ("$.corpus[1].title", "null")}
    assert {(r["ordinal"], r["doc_id"], r["title"]) for r in shred.parent_child(nodes, "corpus", ["doc_id", "title"]).collect()} == {(0, "d", "T"), (1, "e", None)}


def test_objects_and_values_at_any_depth(spark):
    doc = {"turns": [{"calls": [{"name": "a", "tags": ["x", None]}, None, {"name": "b"}]}, {"calls": [{"name": "c"}]}], "meta": {"name": "m"}}
    nodes = shred.shred_json(spark.createDataFrame([(1, json.dumps(doc))], "k int, t string"), "k", "t")
    calls = {tuple(r)[1:] for r in shred.parent_child(nodes, "turns[].calls", ["name"]).collect()}
    assert calls == {("$.turns[0].calls", 0, "a"), ("$.turns[0].calls", 2, "b"), ("$.turns[1].calls", 0, "c")}
    assert [tuple(r) for r in shred.parent_child(nodes, "meta", ["name"]).collect()] == [("1", "$", 1, "m")]
    assert {tuple(r)[1:] for r in shred.child_values(nodes, "turns[].calls[].tags").collect()} == {("$.turns[0].calls[0].tags", 0, "x"), ("$.turns[0].calls[0].tags", 1, None)}


def test_context_entries_in_every_form(spark):
    contexts = [
        [["T", ["a", "b"]], ["U", "c"], {"title": "V", "sentences": ["d"], "url_slug": "v"}, {"title": "W", "text": "e"}, {"title": "X", "text": "all", "sentences": ["f", "g"]}, ["Y", []]],
        {"A. [0]": ["h", None, "i"], "B": "j"},
    ]
    rows = spark.createDataFrame([(i, json.dumps({"context": c, "supporting_facts": [["A", 0]]})) for i, c in enumerate(contexts)] + [(9, "{")], "k int, t string")
    got = {(r["record"], r["child_no"], r["title"], r["url_slug"], tuple(tuple(s) for s in r["sentences"])) for r in shred.context_entries(shred.shred_json(rows, "k", "t")).collect()}
    assert got == {
        ("0", 0, "T", None, ((0, "a"), (1, "b"))), ("0", 1, "U", None, ((0, "c"),)), ("0", 2, "V", "v", ((0, "d"),)), ("0", 3, "W", None, ((0, "e"),)),
        ("0", 4, "X", None, ((0, "f"), (1, "g"))), ("0", 5, "Y", None, ()), ("1", 0, "A. [0]", None, ((0, "h"), (1, None), (2, "i"))), ("1", 1, "B", None, ((0, "j"),)),
    }


def drifting(spark):
    def file(feed, name, day, records):
        return [(feed, name, f"2030-01-{day:02d} 00:00:00", r if isinstance(r, str) or r is None else json.dumps(r), "x") for r in records]

    rows = file("f", "f/9.jsonl", 1, [{"uid": "1", "answer": "a", "score": 1, "note": None}] * 4 + ['{"bro', None, "[1]"])
    rows += file("f", "f/2.jsonl", 2, [{"uid": "1", "answers": ["a"], "score": "1", "level": 2}] * 3 + [{"uid": "1", "answer": "a", "rare": 1}])
    rows += file("f", "f/5.jsonl", 3, [{"uid": 7, "answers": ["a"], "difficulty": 2}] * 4)
    rows += file("g", "g/1.jsonl", 1, [{"x": True}])
    return spark.createDataFrame(rows, "feed string, file_name string, at string, record string, field string").withColumn("delivered_at", F.col("at").cast("timestamp")).withColumn("raw_id", F.lit(1)).withColumn("line_no", F.lit(1))


def test_layout_changes(spark):
    got = {tuple(r) for r in drift.layout_changes(drifting(spark)).collect()}
    assert got == {
        ("f/2.jsonl", "renamed", "answer", "answers"), ("f/2.jsonl", "type_changed", "answer", "answers"), ("f/2.jsonl", "type_changed", "score", "score"), ("f/2.jsonl", "added", "", "level"),
        ("f/5.jsonl", "renamed", "level", "difficulty"), ("f/5.jsonl", "type_changed", "uid", "uid"), ("f/5.jsonl", "removed", "score", ""),
    }
    assert drift.layout_changes(drifting(spark).limit(0)).collect() == []


def test_consistent_table(spark):
    made = drift.consistent_table(drifting(spark))
    kinds = dict(made.dtypes)
    assert kinds["f_level"] == "bigint" and kinds["f_score"] == "string" and kinds["f_record_id"] == "string" and kinds["f_x"] == "boolean"
    assert made.count() == 13 and {r["f_record_id"] for r in made.collect()} == {"1", "7", None}


def test_reports_have_one_row_and_stay_under_their_roots(spark, tmp_path):
    with pytest.raises(ValueError, match="one row"):
        files.write_report(spark.range(2), str(tmp_path / "r"))
    with pytest.raises(ValueError, match="outside"):
        files.write_report(spark.range(1), str(tmp_path / "r"), [str(tmp_path / "other")])
    files.write_report(spark.range(1), str(tmp_path / "r"), [str(tmp_path)])
    assert spark.read.json(str(tmp_path / "r")).collect()[0]["id"] == 0


def raw_records(spark, *files):
    rows = [(i, "f", f"f/{n}", i, json.dumps(r), f"2030-01-{n + 1:02d} 00:00:00") for n, records in enumerate(files) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "raw_id int, feed string, file_name string, line_no int, record string, at string").withColumn("delivered_at", F.col("at").cast("timestamp"))


def test_fields_that_change_only_case_or_signs_are_renamed(spark):
    raw = raw_records(spark, [{"answer": "a", "ownField": 1}] * 3, [{"Answer": "b", "own_fields": 2.5}] * 3, [{"ANSWERS": "c", "Own-Field": 3, "answer": None}])
    assert {tuple(r) for r in drift.layout_changes(raw).collect()} == {
        ("f/1", "renamed", "answer", "Answer"), ("f/1", "renamed", "ownField", "own_fields"), ("f/2", "renamed", "Answer", "ANSWERS"), ("f/2", "renamed", "own_fields", "Own-Field"),
    }
    made = drift.consistent_table(raw)
    assert made.dtypes[-2:] == [("f_answer", "string"), ("f_ownfield", "double")]
    assert sorted((r["f_answer"], r["f_ownfield"]) for r in made.collect()) == [("a", 1.0)] * 3 + [("b", 2.5)] * 3 + [("c", 3.0)]


def test_ten_thousand_spellings_are_one_column(spark):
    word = "abcdefghijklmn"
    spell = lambda n: "".join(c.upper() if n >> i & 1 else c for i, c in enumerate(word))
    raw = raw_records(spark, [{spell(50 * k + j): None if j < 49 else k for j in range(50)} for k in range(200)])
    made = drift.consistent_table(raw)
    assert made.columns[4:] == ["f_" + word] and sorted(r["f_" + word] for r in made.collect()) == list(range(200))


def test_odd_names_of_fields(spark):
    raw = raw_records(spark, [{"": 1, "it's": "q", "a\\b": 2, "?": True, "!": 3, "]": 4, "ä": 5}])
    made = drift.consistent_table(raw)
    assert len(set(made.columns)) == len(made.columns)
    assert made.collect()[0]["f_it"] == "q"


def test_promotion_is_the_least_upper_bound():
    assert drift.promote(["long", "double", "null"]) == "double" and drift.promote(["long"]) == "long" and drift.promote(["boolean", "long"]) == "string"
    assert drift.promote([]) == "string" and drift.promote(["array"]) == "string" and drift.promote(["timestamp", "timestamp"]) == "timestamp"


def test_files_that_drift_are_read_by_their_footers(spark, tmp_path):
    parts = [spark.sql("select 1 as id, 'a' as answer"), spark.sql("select 2.5D as ID, array('b') as answers, true as checked"), spark.sql("select 'x' as Answer")]
    paths = []
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(str(tmp_path / str(i)))
        paths += [str(f) for f in (tmp_path / str(i)).glob("*.parquet")]
    assert drift.file_schemas(spark, paths).count() == 6
    got = drift.read_drifting(spark, paths)
    assert got.dtypes == [("f_answer", "string"), ("f_record_id", "double"), ("f_reviewed", "boolean")]
    assert sorted(map(str, got.collect())) == sorted(map(str, [("a", 1.0, None), ('["b"]', 2.5, True), ("x", None, None)])) or {tuple(r) for r in got.collect()} == {("a", 1.0, None), ('["b"]', 2.5, True), ("x", None, None)}


LOG = "started_at=2030-01-01\n\x1b[36m(x)\x1b[0m step:1 - critic/rewards/mean:1.1 - bad:x - a:b:2.5,\nstep:2 - critic/rewards/mean:1.08\nstep:3 - critic/rewards/mean:0.59\nstep:3 - val-x:1 - critic/rewards/mean:0.6\nTraining Progress: 100%|#\nDataLoader worker exited\nfinished_at=2030-01-02\n"


def test_trainer_log(spark):
    lines = logs.lines(spark.createDataFrame([("l", LOG), ("m", "CUDA out of memory\nTraining Progress: 100%\nfinished_at=1"), ("n", None), ("o", "")], "k string, t string"), "k", "t")
    over = {r["k"]: r for r in logs.overview(lines, "k").collect()}
    assert over["l"]["completed"] and over["l"]["started_at"] == "2030-01-01" and over["l"]["shutdown_warning_count"] == 1
    assert not over["m"]["completed"] and over["m"]["fatal_marker_count"] == 1
    metrics = logs.metrics(lines, "k")
    got = {(r["step"], r["metric"]): r["value"] for r in metrics.collect()}
    assert got[(1, "a:b")] == 2.5 and got[(3, "critic/rewards/mean")] == 0.6 and (1, "bad") not in got
    drops = logs.reward_drops(logs.reward_curve(metrics, "k"), "k").collect()
    assert [(r["step"], r["previous_step"], r["delta"]) for r in drops] == [(3, 2, -0.48)]


def test_running_variance_of_a_growing_dump(spark, tmp_path):
    folder = tmp_path / "dump"
    folder.mkdir()
    put(folder / "1.json", '{"stage": "a", "source_id": "s", "score": 0.1}\n{"stage": "a", "source_id": " ", "score": 9}\n')
    query = variance.running_groups(variance.read_dump(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("running").start()
    try:
        query.processAllAvailable()
        put(folder / "2.json", '{"stage": "a", "source_id": "s", "score": 0.9}\n')
        query.processAllAvailable()
        row = spark.sql("select * from running").first()
        assert (row["sample_count"], row["score_range"]) == (2, 0.8)
    finally:
        query.stop()
