import json

import pytest
from pyspark.sql import functions as F

from roentgrid.operators import labelling

FULL = {"reason": " r ", "mentions_abnormalities": "yes", "mentions_devices": "no"}


def check(spark, schema, *replies):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    return [r["reason"] for r in labelling.validate_reply(df, schema).orderBy("i").collect()]


def test_validate(spark):
    replies = [
        json.dumps(FULL),
        f"Sure: {json.dumps(FULL)} bye",
        "no braces",
        "} {",
        "{'a': 1}",
        json.dumps({**FULL, "reason": "  "}),
        json.dumps({**FULL, "mentions_devices": "maybe"}),
        json.dumps({k: v for k, v in FULL.items() if k != "mentions_devices"}),
        json.dumps({**FULL, "mentions_devices": None}),
        json.dumps({**FULL, "extra": {"nested": "{}"}}),
        None,
    ]
    got = check(spark, "abnormality_device_flags", *replies)
    assert got[:2] == [None, None] and got[9] is None
    assert got[2] == got[3] == got[10] == "no JSON object"
    assert got[4] in ("malformed JSON", "missing reason")
    assert got[5:9] == ["blank reason", "invalid mentions_devices", "missing mentions_devices", "invalid mentions_devices"]


def test_other_schemas(spark):
    mini = {"reasoning": "", "mini-report": " x "}
    assert check(spark, "anatomy_mini_report", json.dumps(mini), json.dumps({"reasoning": ""}), json.dumps({**mini, "reasoning": None})) == [
        None, "missing mini-report", "invalid reasoning",
    ]
    df = spark.createDataFrame([(json.dumps(mini),)], "reply string")
    assert labelling.validate_reply(df, "anatomy_mini_report").first()["parsed"]["mini-report"] == "x"
    t = {"reason": "r", "has_abnormalities": "no", "supports_pneumonia": "probably no"}
    assert check(spark, "pneumonia_triage", json.dumps(t), json.dumps({**t, "supports_pneumonia": "x"})) == [None, "invalid supports_pneumonia"]
    labelling.register_reply_schema("mine", {"k": ["a"]})
    assert check(spark, "mine", '{"k": "a"}', '{"k": "b"}') == [None, "invalid k"]


def test_requests(spark):
    q = spark.createDataFrame([('say "hi"',), ("",)], "query string")
    r = json.loads(labelling.to_requests(q, "openai", "gpt-4o", "sys", 9).first()["request"])
    assert r["messages"][1] == {"role": "user", "content": 'say "hi"'} and r["frequency_penalty"] == 0 and r["metadata"]["query"] == 'say "hi"'
    g = json.loads(labelling.to_requests(q, "gemini", "gemini-2.0-pro", "sys", None).first()["request"])
    assert "frequency_penalty" not in g and "max_tokens" not in g
    b = labelling.to_requests(q, "openai", "gpt-4o", "sys", 9, batch=True).collect()
    assert len(b) == 1 and json.loads(b[0]["request"])["custom_id"] == b[0]["key"]
    for provider, model in (("openai", "gemini-2.0-pro"), ("other", "x")):
        with pytest.raises(ValueError):
            labelling.to_requests(q, provider, model, "sys", 9)


def test_tokens(spark):
    requests = [
        {"messages": [{"role": "user", "content": "abcde"}, {"role": "system", "content": ""}], "max_tokens": 3},
        {"messages": [{"role": "user", "content": "a", "name": "bob12"}], "n": 2, "max_tokens": 3},
        {"prompt": "abcde"},
        {"prompt": ["abcde", ""], "n": 2, "max_tokens": 1},
        {"input": ["a", "b", ""]},
        {"input": "x" * 9},
        {"other": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(requests)], "i int, request string")
    got = labelling.estimate_tokens(df).orderBy("i").collect()
    # role user = 1, system = 2
    assert [r["tokens"] for r in got] == [1 + 2 + 2 + 0 + 3, 1 + 1 + 2 + 6, 2 + 15, 2 + 4, 2, 3, None]
    assert [r["endpoint"] for r in got] == ["chat/completions"] * 2 + ["completions"] * 2 + ["embeddings"] * 2 + [None]


def test_rate_plan_keeps_caps(spark):
    df = spark.createDataFrame([(i, i % 7 + 1) for i in range(100)], "k int, tokens int")
    per = labelling.rate_plan(df, "k", "tokens", 10, 30).groupBy("minute").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()
    assert sum(r["n"] for r in per) == 100 and max(r["n"] for r in per) <= 10
    assert max(r["t"] for r in per) <= 30


def test_rate_plan_with_uneven_requests(spark):
    sizes = [10_000] * 20 + [1] * 3000 + [3333] * 50 + [10_001, 0] + list(range(1, 2000, 7))
    df = spark.createDataFrame(list(enumerate(sizes)), "k int, tokens int")
    plan = labelling.rate_plan(df, "k", "tokens", 50, 10_000)
    per = plan.where("reason is null").groupBy("minute").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()
    assert sum(r["n"] for r in per) == len(sizes) - 1
    assert max(r["n"] for r in per) <= 50 and max(r["t"] for r in per) <= 10_000
    needed = sum(max(1 / 50, t / 10_000) for t in sizes if t <= 10_000)
    assert max(r["minute"] for r in per) + 1 <= 2 * needed + 14
    assert [r["tokens"] for r in plan.where("reason is not null").collect()] == [10_001]


def test_queries(spark):
    df = spark.createDataFrame([("gt", "Description: x"), (None, "Description: x"), ("gt", "no"), ("gt", "description")], "gt_report string, prediction string")
    got = labelling.build_queries(df, "description").collect()
    assert [r["reason"] for r in got] == [None, "no report", "no description", "malformed description"]
    assert got[0]["query"] == "[GT]: gt\n\n[GEN]: x" and got[1]["query"] is None
    tagged = labelling.build_queries(df.withColumn("raw_prediction", F.lit("<a>x</a> y ")), "tagged").first()
    assert tagged["query"] == "[GT]: gt\n\n[GEN]: x y"
    with pytest.raises(ValueError):
        labelling.build_queries(df, "x")


def test_resume_is_idempotent(spark):
    q = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("c",)], "query string")
    done = spark.createDataFrame([("b",)], "query string")
    left = labelling.pending_queries(q, done)
    assert sorted(r["query"] for r in left.collect()) == ["a", "c"]
    assert labelling.pending_queries(q, done.unionByName(left.select("query"))).count() == 0
    assert labelling.pending_queries(q, done, 1).count() == 1


def test_ingest_and_retry(spark):
    ok = ([(({"content": json.dumps(FULL)}),)],)
    schema = "request string, response struct<choices: array<struct<message: struct<content: string>>>>, metadata struct<query: string>, errors array<string>"
    rows = [("r", ok, ("q1",), []), ("r", None, ("q2",), ["e"]), ("r", ok, ("q3",), ["e"]), ("r", ([],), ("q4",), None)]
    got = {r["query"]: r["reason"] for r in labelling.ingest_responses(spark.createDataFrame(rows, schema), "abnormality_device_flags").collect()}
    assert got == {"q1": None, "q2": "request failed", "q3": "request failed", "q4": "no content"}
    a = spark.createDataFrame([("x", 1, "e1"), ("x", 2, None), ("y", 1, "e"), ("z", 1, "e1"), ("z", 2, "e2")], "key string, attempt int, error string")
    assert {r["key"]: r["status"] for r in labelling.retry_set(a, 2).collect()} == {"x": "done", "y": "retry", "z": "exhausted"}
    assert [(r["key"], r["errors"]) for r in labelling.exhausted_errors(a, 2).collect()] == [("z", ["e1", "e2"])]
