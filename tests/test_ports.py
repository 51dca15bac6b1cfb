"""Ports with stubs, JSON in and out, resume, and the incremental extension."""

from __future__ import annotations

import json

from recallforge import ports
from recallforge.sources import jsonio
from recallforge.streaming.incremental import run_available


def test_retries_forget_errors():
    answers = iter([RuntimeError("down"), "", "fine"])

    def call():
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert ports.call_with_retries(call, sleep=lambda _: None) == ("fine", True, "")
    text, ok, error = ports.call_with_retries(lambda: "", tries=2, sleep=lambda _: None)
    assert (text, ok) == ("", False) and error


def test_chat_embed_compress(spark):
    rows = spark.createDataFrame([(1, "hello there"), (2, "")], "id int, prompt string")
    got = {r["id"]: r for r in ports.chat(rows, lambda: ports.EchoChat("yes")).collect()}
    assert got[1]["response"] == "yes" and got[1]["ok"] and got[1]["prompt_key"] != got[2]["prompt_key"]
    vec = {r["id"]: r["embedding"] for r in ports.embed(rows, lambda: ports.HashEmbedder(8), "prompt").collect()}
    assert abs(sum(v * v for v in vec[1]) - 1) < 1e-5 and not any(vec[2])
    short = {r["id"]: r["compressed"] for r in ports.compress(rows, lambda: lambda t, rate: "", "prompt").collect()}
    assert short == {1: "hello there", 2: ""}


def test_json_sources(spark, tmp_path):
    (tmp_path / "bank").mkdir()
    (tmp_path / "bank" / "a.json").write_text(json.dumps({"memories": [{"content": " x ", "window_index": 0, "dimension": {"memory_type": "fact", "keywords": ["k"]}}]}))
    (tmp_path / "list").mkdir()
    (tmp_path / "list" / "b.json").write_text(json.dumps([{"content": "y", "dimension": {}}]))
    got = {r["bank"]: r for r in jsonio.read_memories(spark, str(tmp_path)).collect()}
    assert got["bank"]["boundary_id"] == "0_0000" and got["bank"]["content"] == "x" and got["bank"]["memory_type"] == "fact"
    assert got["list"]["boundary_id"] == "all_memories_0000" and got["list"]["memory_type"] == "other"
    f = tmp_path / "in__multi.json"
    f.write_text(json.dumps([{"question_id": "q", "answer": 7, "haystack_sessions": [[{"role": "user", "content": "a"}]], "haystack_dates": ["2023/06/25 (Sun) 13:22"]}]))
    row = jsonio.read_histories(spark, str(f)).first()
    assert (row["question_type"], row["answer"]) == ("multi", "7")


def test_write_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, False), (3, True)], "id int, ok boolean")
    jsonio.write_json(df, str(tmp_path / "out"))
    done = spark.read.json(str(tmp_path / "out"))
    todo = spark.createDataFrame([(1,), (2,), (4,)], "id long")
    assert sorted(r["id"] for r in jsonio.to_do(todo, done, ["id"], done["ok"]).collect()) == [2, 4]
    jsonio.append_manifest(spark, str(tmp_path / "runs"), "r1", "segment", {"rows": 3})
    assert spark.read.parquet(str(tmp_path / "runs")).first()["counts"] == {"rows": 3}
    c = spark.createDataFrame([("k", 1, "b"), ("k", 0, "a"), ("k", 0, "z")], "key string, level int, path string")
    assert jsonio.newest(c, ["key"]).first()["path"] == "z"


def test_incremental(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    go = lambda: run_available(spark, src, "id long", str(tmp_path / "ck"), lambda df, i: df.write.mode("append").parquet(out))
    spark.range(3).write.mode("append").parquet(src)
    go()
    spark.range(3, 5).write.mode("append").parquet(src)
    go()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_http_chat_sends_one_message_and_reads_the_first_choice():
    import io
    import json

    from recallforge.ports import HttpChat

    seen = []

    def open_url(request, timeout):
        seen.append((request.full_url, json.loads(request.data), request.get_header("Authorization"), timeout))
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": "hello"}}], "usage": {"total_tokens": 5}}).encode())

    port = HttpChat("http://host/v1/", "m", "k", 9.0, open_url=open_url, max_tokens=3)
    assert port("hi") == "hello" and port.usage == {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 5}
    assert seen == [("http://host/v1/chat/completions", {"model": "m", "temperature": 0.0, "max_tokens": 3, "messages": [{"role": "user", "content": "hi"}]}, "Bearer k", 9.0)]
    assert HttpChat("http://host", "m", open_url=lambda r, timeout: io.BytesIO(b"{}"))("x") == ""


def test_onnx_embedder_averages_under_the_mask():
    from types import SimpleNamespace

    import numpy as np

    from recallforge.ports import OnnxEmbedder

    class Session:
        def get_inputs(self):
            return [SimpleNamespace(name="input_ids"), SimpleNamespace(name="attention_mask")]

        def run(self, _, given):
            assert set(given) == {"input_ids", "attention_mask"}
            return [np.stack([given["input_ids"], 2 * given["input_ids"]], axis=-1).astype(np.float32)]

    port = OnnxEmbedder("", "", batch=2, session=Session(), encode=lambda texts: [([len(t), 9], [1, 0]) if t else ([0, 9], [0, 0]) for t in texts])
    got = port(["abc", "", "x"])
    assert np.allclose(got, [[1 / 5**0.5, 2 / 5**0.5], [0, 0], [1 / 5**0.5, 2 / 5**0.5]])
