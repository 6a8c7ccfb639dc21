"""Adapters, validators, sampling quotas, dedup rules, sources, sinks and streams on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from parleylake.functions import stats, text
from parleylake.operators import adapters, annotation, dedup, metrics, mixture, outputs, preferences, sampling, validators
from parleylake.sources import readers, writers
from parleylake.streaming import incremental

TOOL = {"name": "lookup", "parameters": {"type": "object", "properties": {"q": {"type": "string"}}, "required": ["q"]}}

RAW = {
    "xlam": {"id": "1", "query": "find x", "tools": json.dumps([TOOL]), "answers": json.dumps([{"name": "lookup", "arguments": {"q": "x"}}])},
    "when2call": {"id": "2", "tools": [TOOL], "conversation": '<TOOLCALL>{"name":"lookup","arguments":{"q":"x"}}</TOOLCALL>'},
    "toolace": {"id": "3", "tools": [TOOL], "system": "s", "conversations": [{"from": "user", "value": "u"}, {"from": "assistant", "value": "[lookup(q='x')]"}, {"from": "tool", "value": "r"}, {"from": "assistant", "value": "done"}]},
    "button": {"id": "4", "tools": [TOOL], "messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": '<call>{"name":"lookup","arguments":{"q":"x"}}</call>'}]},
    "looptool": {"id": "5", "tools": [TOOL], "instruction": "i", "input": [{"role": "user", "content": "u"}], "output": '<tool_call>{"name":"lookup","arguments":{"q":"x"}}</tool_call>'},
    "glaive": {"id": "6", "tools": [TOOL], "system": "s", "chat": "USER: u\n\nASSISTANT: <functioncall> {\"name\": \"lookup\", \"arguments\": '{\"q\": \"x\"}'} <|endoftext|>\n\nFUNCTION RESPONSE: r\n\nASSISTANT: done <|endoftext|>"},
}


@pytest.mark.parametrize("source", sorted(RAW))
def test_adapters(source):
    row = adapters.normalize_one(adapters.ADAPTERS[source], json.dumps(RAW[source]), "train")
    assert row["status"] == "VALID", row["reason"]
    calls = [c for m in json.loads(row["messages"]) for c in m.get("tool_calls") or []]
    assert [(c["id"], c["name"], c["arguments"]) for c in calls] == [("call_0000", "lookup", {"q": "x"})]


def test_rejects_and_ledger(spark):
    raws = [json.dumps(RAW["xlam"]), json.dumps(RAW["xlam"] | {"id": "9"}), "{", None, json.dumps({"id": "7", "query": "u", "tools": "[]", "answers": "[]"})]
    rows = adapters.normalize(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "row long, raw string"), "xlam")
    counts = {(r["status"], r["reason"]): r["n"] for r in adapters.ledger(rows).collect()}
    assert counts == {("VALID", None): 1, ("DUPLICATE", None): 1, ("REJECTED", "BAD_JSON"): 1, ("REJECTED", "BAD_ROW"): 1, ("REJECTED", "NO_CALL"): 1}
    assert adapters.normalize_one(adapters.ADAPTERS["xlam"], raws[0], "mcq")["reason"].startswith("EVALUATION_SPLIT")


def test_trajectories():
    user, call, result, end = {"role": "user", "content": "u"}, {"role": "assistant", "tool_calls": [{"id": "a", "name": "lookup", "arguments": {"q": "x"}}]}, {"role": "tool", "content": "r", "tool_call_id": "a"}, {"role": "assistant", "content": "e"}
    assert validators.trajectory_problems([user, call, result, end], [TOOL]) == []
    assert validators.trajectory_problems([user, call], [TOOL]) == ["OPEN_FINAL_CALL"]
    assert validators.trajectory_problems([user, call], [TOOL], "CALL_PREDICTION") == []
    assert "CALL_WITHOUT_RESULT: 2" in validators.trajectory_problems([user, call, end], [TOOL])
    assert validators.argument_problems({"q": True}, {"type": "object", **TOOL["parameters"]}) == ["ARG_TYPE: $.q"]
    assert validators.argument_problems(True, {"type": "integer"}) == ["ARG_TYPE: $"]
    assert validators.schema_problems({"type": "object", "properties": {"a": {"type": "text"}}}) == ["SCH_TYPE: $.a"]


def test_output_parser():
    parse = outputs.parse_output
    read = lambda raw: [(c["name"], json.loads(c["arguments"])) for c in parse(raw)["calls"]]
    assert parse("<tool_call><function=f><parameter=q>1</parameter></function></tool_call>")["calls"] == [{"name": "f", "arguments": '{"q":"1"}', "id": None}]
    two = "<tool_call>\n<function=a>\n<parameter=x>\n1, 2\n3\n</parameter>\n</function>\n</tool_call>"
    assert read(two + two.replace("=a", "=b")) == [("a", {"x": "1, 2\n3"}), ("b", {"x": "1, 2\n3"})]
    assert read("<TOOL_CALL><Function=get_time></function></tool_call>") == [("get_time", {})]
    assert read('<tool_call>[{"name":"a","arguments":"{\\"x\\":1}","id":"7"},{"name":"b"}]</tool_call>') == [("a", {"x": 1}), ("b", {})]
    around = parse(f"Let me look.<think>hm <b> ok</think> {two}<|end|>")
    assert (around["decision"], around["status"], around["content"]) == ("CALL", "RAW_VALID", "Let me look. <|end|>")
    wrong = {
        "<tool_call>{": "UNCLOSED_TOOL_CALL", "a </tool_call>": "UNCLOSED_TOOL_CALL", "<tool_call>[]</tool_call>": "EMPTY_TOOL_CALL",
        "<tool_call>no call</tool_call>": "MALFORMED_TOOL_CALL[0]", "<tool_call>{\"name\":</tool_call>": "MALFORMED_TOOL_CALL[0]",
        "<tool_call><function=a><parameter=x>1</function></tool_call>": "MALFORMED_ARGUMENTS[0]", two + "<tool_call><function=a></tool_call>": "MALFORMED_TOOL_CALL[1]",
        '<tool_call>{"arguments":{}}</tool_call>': "INVALID_TOOL_CALL[0]", '<tool_call>{"name":"a","arguments":[]}</tool_call>': "INVALID_ARGUMENTS[0]",
        '<tool_call>{"name":"a","arguments":"{"}</tool_call>': "MALFORMED_ARGUMENTS[0]",
    }
    for raw, code in wrong.items():
        got = parse(raw)
        assert (got["status"], got["decision"], got["calls"]) == ("FORMAT_ERROR", "ANSWER", []) and got["errors"][0].startswith(code), raw
    assert parse("", True)["errors"] == ["EOS_WITHOUT_OUTPUT"] and parse(None)["status"] == "RAW_VALID"
    assert [parse(t)["decision"] for t in ("I am unable to.", "Which?", "Please provide it", "Yes.")] == ["UNSUPPORTED", "CLARIFY", "CLARIFY", "ANSWER"]


def test_packing(spark):
    rows = [(i, (i * 37) % 900 + (2000 if i == 5 else 0)) for i in range(300)] + [(300, None), (7, 30)]
    for most in (None, 3):
        got = sampling.pack(spark.createDataFrame(rows, "item long, size long"), "s", "item", "size", 1000, 64, most).collect()
        batches = {}
        for r in got:
            batches.setdefault((r["window"], r["batch"]), []).append(r["size"] or 0)
        assert len(got) == len(rows)
        assert all(sum(b) <= 1000 or len(b) == 1 for b in batches.values()) and all(most is None or len(b) <= most for b in batches.values())
        for (window, number), own in batches.items():  # no batch was closed too soon
            after = batches.get((window, number + 1))
            assert after is None or sum(own) + min(after) > 1000 or len(own) == most


def test_paths(spark):
    row = spark.createDataFrame([('{"a":{"b":[1,{"c":"x"},[5,6]]}}',)], "j string")
    paths = ["a.b.0", "a.b.-2.c", "a.b.-1.-1", "a.b.-4", "a.z", "a.b.1.c"]
    got = row.select(*(text.get_path("j", p).alias(str(n)) for n, p in enumerate(paths))).first()
    assert list(got) == ["1", "x", "6", None, None, "x"]


def test_quotas():
    assert sampling.allocate_remainder({"glaive": 14205, "toolace": 867, "when2call": 3979}, 100) == {"glaive": 75, "toolace": 4, "when2call": 21}
    assert sampling.allocate_remainder({"glaive": 14205, "toolace": 867, "when2call": 3979}, 100, {"toolace": 20}) == {"glaive": 59, "toolace": 20, "when2call": 21}
    assert sampling.allocate_filling({"a": 2, "b": 50, "c": 50}, 30) == {"a": 2, "b": 14, "c": 14}
    assert sum(sampling.allocate_proportional({"a": 3, "b": 3, "c": 1}, 10).values()) == 10


def test_routing_fixture(spark):
    pairs = [("CALL", "CALL"), ("CALL", "ANSWER"), ("ANSWER", "CALL"), ("CLARIFY", "CLARIFY"), ("UNSUPPORTED", "UNSUPPORTED")]
    row = metrics.routing(spark.createDataFrame(pairs, "actual string, predicted string")).first()
    assert row["under_call_rate"] == 0.5 and row["over_call_rate"] == pytest.approx(1 / 3)


def test_intervals(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(80, 95), (0, 0)], "k long, n long").select(low.alias("l"), high.alias("h"), *(c.alias(f"c{i}") for i, c in enumerate(stats.wilson_clamped(F.col("k"), F.col("n"))))).collect()
    assert rows[1]["l"] is None and (rows[1]["c0"], rows[1]["c1"]) == (0.0, 1.0) and 0.75 < rows[0]["l"] < rows[0]["h"] < 0.91
    half = spark.range(1).select(*(stats.worst_half_width(F.lit(n)).alias(str(n)) for n in (1277, 453, 601))).first()
    assert [round(100 * x, 2) for x in half] == [2.74, 4.60, 4.00]


def test_greedy_dedup(spark):
    # 2 goes by 1's first key; 3 shares only 2's second key, so it stays
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, None, "x")], "id long, k1 string, k2 string")
    assert sorted(r["id"] for r in dedup.greedy(rows, "id", ["id"], ["k1", "k2"]).collect()) == [1, 3]
    assert sorted(r["id"] for r in dedup.greedy(rows, "id", ["id"], ["k1", "k2"], rounds=1).collect()) == [1, 3]


def test_exact_text(spark):
    row = spark.createDataFrame([("Straße  X", '{"b":1.0,"a":"é"}', "abcd", "abxd")], "t string, j string, a string, b string").select(text.normalize_exact("t"), text.stable_json("j"), text.edit_similarity("a", "b")).first()
    assert list(row) == ["strasse x", '{"a":"é","b":1.0}', 0.75]


def test_chain(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n long, v string")
    first = spark.range(1).select(annotation.chain_hash(F.lit(None).cast("string"), F.lit("a"))).first()[0]
    second = spark.range(1).select(annotation.chain_hash(F.lit(first), F.lit("b"))).first()[0]
    good = rows.withColumn("g", F.lit(0)).withColumn("prev_hash", F.when(F.col("n") == 2, F.lit(first))).withColumn("hash", F.when(F.col("n") == 1, F.lit(first)).otherwise(F.lit(second)))
    assert annotation.verify_chain(good, "n", ["v"], ["g"]).first()["broken"] == 0
    assert annotation.verify_chain(good.withColumn("v", F.lit("z")), "n", ["v"], ["g"]).first()["broken"] == 2


def test_gates(spark):
    def rows(**m):
        return spark.createDataFrame([(k, float(v)) for k, v in m.items()], "metric string, value double")

    checks = mixture.promotion(rows(f1=0.8), rows(f1=0.9), {"f1": 0.5, "absent": 0.1}, {}, {"f1": 0.9})
    assert {(r["gate"], r["dimension"]): r["code"] for r in checks.collect()} == {("floor", "f1"): "PASS", ("floor", "absent"): "NOT_EVALUABLE", ("retention", "f1"): "FAIL"}
    assert mixture.verdict(checks).first()["verdict"] == "FAIL" and mixture.verdict(checks.where("false")).first()["verdict"] == "FAIL"


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, "s%d" % (i % 2), json.dumps({"a": i})) for i in range(10)], "id long, source string, messages string")
    manifest = writers.shards(rows, f"{tmp_path}/p", rows_per_file=2)
    assert writers.verify(spark, f"{tmp_path}/p", manifest).count() == 0
    assert writers.verify(spark, f"{tmp_path}/p", manifest.withColumn("rows", F.lit(99))).count() == manifest.count()
    a, b = writers.jsonl(rows, f"{tmp_path}/j.jsonl", ["id"]).first(), writers.fingerprint(rows.select("id", F.to_json(F.struct("id", "messages", "source")).alias("value")), F.col("value")).first()
    assert a == b and readers.any_rows(spark, f"{tmp_path}/j.jsonl").count() == 10
    permitted = spark.createDataFrame([("s0", "mit", True), ("s1", "none", False)], "source string, license string, permitted boolean")
    kept, out = writers.release(rows, permitted, f"{tmp_path}/r")
    assert kept.first()["rows"] == 5 and out.first()["source"] == "s1"
    assert readers.restore(rows).schema["messages"].dataType.typeName() == "variant"
    with pytest.raises(ValueError):
        readers.checked(rows.unionByName(rows), "id")
    merged = readers.evaluation_examples({"a": rows.withColumnRenamed("id", "example_id"), "b": rows.withColumnRenamed("id", "example_id").where("example_id < 3")})
    assert merged.count() == 10 and merged.where("size(splits) = 2").count() == 3


def test_incremental(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "1.jsonl").write_text(json.dumps(RAW["xlam"]) + "\n\n{\n")

    def run():
        incremental.materialize(spark, str(raw), f"{tmp_path}/out", f"{tmp_path}/ck", "xlam").awaitTermination()
        return incremental.materialized(spark, f"{tmp_path}/out").count()

    assert run() == 1
    (raw / "2.jsonl").write_text(json.dumps(RAW["xlam"]) + "\n" + json.dumps(RAW["xlam"] | {"id": "8", "query": "other"}) + "\n")
    assert run() == 2
    assert run() == 2


def test_preferences(spark):
    rows = spark.createDataFrame([("p", "good", 2.0), ("p", "bad", 0.0), ("q", "x", 1.0), ("q", "y", 0.5)], "prompt string, text string, score double")
    assert [(r["prompt"], r["chosen"]) for r in preferences.judged_pairs(rows).collect()] == [("p", "good")]
