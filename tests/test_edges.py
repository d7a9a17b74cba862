import json

import pytest

from tracemill.operators import edges
from tracemill.sources import config


def test_probe_scores(spark):
    requests = spark.createDataFrame([(0, "answer", "p", "Example City"), (1, "search", "p", ""), (2, "answer", "none", "x")], "request_index int, stage string, prompt string, ground_truth string")

    def generator(prompts):
        return ["<search>a</search> <answer>Example City</answer>" if p == "p" else "hm" for p in prompts]

    got = {(r["request_index"], r["sample_index"]): r["score"] for r in edges.probe(requests, generator, 2).collect()}
    # two actions at once are no valid search, but the answer in them counts
    assert got == {(0, 0): 1.1, (0, 1): 1.1, (1, 0): -0.03, (1, 1): -0.03, (2, 0): 0.0, (2, 1): 0.0}
    with pytest.raises(ValueError):
        edges.probe(requests, generator, 0)


def test_two_turns(spark):
    rows = spark.createDataFrame([("a", "Where was Alice born?", ["d1"], "Example City"), ("b", "Who?", [], "x")], "id string, question string, gold array<string>, answer string")
    pool = spark.createDataFrame([("a", 0, "d0", "Noise", "nothing"), ("a", 1, "d1", "Alice", "Alice was born in Example City"), ("b", 0, "d2", "T", "t")], "id string, pos int, doc_id string, title string, text string")

    def search(prompts):
        return ["<search>alice born</search>" if "Alice" in p else "no action" for p in prompts]

    def answer(prompts):
        return ["<answer>Example City</answer>" if "[1] Alice: " in p else "<answer></answer>" for p in prompts]

    got = {r["id"]: r for r in edges.environment_rollouts(rows, pool, search, answer).collect()}
    assert got["a"]["observation_doc_ids"] == ["d1"] and got["a"]["final_answer"] == "Example City"
    assert got["b"]["observation_doc_ids"] == [] and got["b"]["final_answer"] == "" and not got["b"]["search_action"]["valid"]


def test_config(tmp_path):
    good = tmp_path / "c.json"
    good.write_text(json.dumps({"train_samples": 1}))
    assert config.load_config(str(good), ["train_samples"]) == {"train_samples": 1}
    for body, keys in (("[1]", []), ('{"a": 1}', ["b"])):
        good.write_text(body)
        with pytest.raises(ValueError):
            config.load_config(str(good), keys)
