"""Ledgers against a counting server, memory files in pieces, updates with observed counts."""

from __future__ import annotations

import io
import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from recallforge import quickstart
from recallforge import report as report_cli
from recallforge.operators import segment as G
from recallforge.operators import upkeep as U
from recallforge.plans import jobs, prompts
from recallforge.ports import EchoChat, HttpChat, chat, deal
from recallforge.plans import edges
from recallforge.sources import jsonio, memory_files
from recallforge.sources.ledger import Ledger, config_hash
from recallforge.sources.shared import numbered


@pytest.fixture
def server():
    seen, state, lock = [], {"now": 0, "peak": 0, "down": set()}, threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
            with lock:
                seen.append(prompt)
                state["now"] += 1
                state["peak"] = max(state["peak"], state["now"])
            time.sleep(0.05)
            with lock:
                state["now"] -= 1
            body = json.dumps({"choices": [{"message": {"content": prompt.upper()}}], "usage": {"prompt_tokens": len(prompt), "total_tokens": len(prompt) + 1}}).encode()
            self.send_response(500 if prompt in state["down"] else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen, state
    s.shutdown()


def test_calls_are_bounded_and_equal_prompts_asked_once(spark, tmp_path, server):
    url, seen, state = server
    state["down"] = {"p3", "p5"}
    rows = spark.createDataFrame([(i, f"p{i % 20}") for i in range(60)] + [(99, None)], "id int, prompt string").repartition(3)
    opened = deal([lambda: HttpChat(url, "m"), lambda: HttpChat(url + "/", "m")])
    ledger = Ledger(spark, str(tmp_path / "ledger"), "r1", {"m": 1})
    how = {"tries": 2, "pause": lambda a: 0.0, "parallel": 4}
    got = {r["id"]: r for r in ledger.ask(rows.coalesce(1), "s", opened, **how).collect()}
    assert len(seen) == 18 + 2 * 2 and 1 < state["peak"] <= 4 * 4  # one partition of prompts at most a core
    assert got[4]["response"] == "P4" and got[4]["total_tokens"] == 3 and got[44]["ok"] and not got[3]["ok"] and "HTTPError" in got[3]["error"]
    assert (got[99]["ok"], got[99]["error"], got[99]["response"]) == (False, "no prompt", None)
    assert [tuple(r) for r in ledger.status().collect()] == [("s", 20, 18, 2, 20, sum(len(f"p{i}") + 1 for i in range(20) if i not in (3, 5)))]
    assert {r["attempt"] for r in ledger.failures("s").collect()} == {1}
    state["down"] = set()
    seen.clear()
    again = Ledger(spark, str(tmp_path / "ledger"), "r2", {"m": 1})
    assert all(r["ok"] for r in again.ask(rows, "s", opened, **how).collect() if r["id"] != 99) and sorted(seen) == ["p3", "p5"]
    seen.clear()
    assert again.ask(rows, "s", opened, **how).where("not ok").count() == 1 and not seen
    Ledger(spark, str(tmp_path / "ledger"), "r3", {"m": 2}).ask(rows.limit(1), "s", opened, **how)
    assert len(seen) <= 1 and config_hash({"a": 1, "b": 2}) == config_hash({"b": 2, "a": 1})


def test_a_repeated_append_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    ledger = Ledger(spark, path, "r", {})
    first = sorted(map(str, ledger.ask(rows, "s", lambda: EchoChat("x")).collect()))
    ledger.rows().write.mode("append").parquet(path)
    assert sorted(map(str, ledger.ask(rows, "s", lambda: EchoChat("other")).collect())) == first and ledger.status().first()["ok"] == 2


def test_peak_of_one_port(spark, server):
    url, seen, state = server
    rows = spark.createDataFrame([(f"q{i}",) for i in range(24)], "prompt string").coalesce(1)
    assert chat(rows, lambda: HttpChat(url, "m"), parallel=6).where("ok").count() == 24 and 1 < state["peak"] <= 6 and len(seen) == 24


def parse(data: bytes, step: int) -> list:
    f = io.BytesIO(data)
    return list(memory_files.records(lambda n: f.read(min(n, step)), step))


def test_records_in_pieces():
    rng = random.Random(1)
    recs = [{"content": "é€😀" * rng.randint(0, 9) + '"\\', "n": rng.choice([1, 12.5, None, True]), "deep": {"memories": [1, [2]]}} for _ in range(12)]
    for step in (1, 2, 3, 7, 4096):
        bare, whole = json.dumps(recs, ensure_ascii=False).encode(), json.dumps({"a": [1, {"b": 2}], "memories": recs, "z": 3}, indent=1, ensure_ascii=False).encode()
        assert parse(bare, step) == recs == parse(whole, step)
        assert parse(b" [ ] ", step) == [] == parse(b"{}", step) == parse(b'{"memories": null}', step) == parse(b"[1, 2]", step)
        for bad in (b"", b"[", bare[:-1], whole[:-1], whole[: len(whole) // 2], bare + b"x", b'{"memories": [1 2]}', b"7", b'{"a" 1}', b"[\xff]"):
            with pytest.raises(memory_files.Corrupt):
                parse(bad, step)


def test_memory_files_tell_of_broken_ones(spark, tmp_path):
    for name, text in (("x/all.json", '{"memories": [{"content": "a"}, {"content": "b"}]}'), ("x/w1/m.json", '[{"content": "c"}]'), ("y/bad.json", '[{"content": "d"}, {'), ("skip.json", "[1]"), ("y/note.txt", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    memory_files.register(spark)
    got = spark.read.format("memory_files").option("chunk", 3).load(str(tmp_path))
    assert sorted((r["bank"], r["window"], r["at"] if r["at"] is not None else -1, r["record"] or "", r["corrupt"]) for r in got.collect()) == [("x", "all_memories", 0, '{"content": "a"}', False), ("x", "all_memories", 1, '{"content": "b"}', False), ("x", "w1", 0, '{"content": "c"}', False), ("y", "all_memories", -1, "", True)]


def test_update_with_observed_counts(spark, tmp_path):
    rows = [("b", 0, "likes red tea", ["red", "tea"], "2023-01-01"), ("b", 1, "likes red tea much", ["red", "tea", "much"], "2023-01-02"), ("b", 2, "has a dog", ["dog"], "2023-01-03"), ("one", 0, "alone", ["a"], "2023-01-01"), ("none", 0, "x", ["p"], "2023-01-01"), ("none", 1, "y", ["q"], "2023-01-01")]
    m = spark.createDataFrame(rows, "bank string, idx long, content string, keywords array<string>, t string").select("bank", "idx", "content", "keywords", F.lit("fact").alias("memory_type"), *[F.lit("").alias(c) for c in ("time", "location", "reason", "purpose")], F.to_timestamp("t").cast("timestamp_ntz").alias("source_time"))
    seen = '{"decision": "SUPERSEDE", "merged_content": "", "merged_dimension": {"location": "Rome", "keywords": []}}'
    pairs = spark.createDataFrame([("b", 1, 0)], "bank string, idx_new long, idx_old long")
    told = jobs.run_update(m, lambda: EchoChat(lambda p: seen if "keywords: red, tea, much" in p and "kind fact" in p else "?"), str(tmp_path), method="dimension", pairs=pairs)
    assert (told["pairs"], told["errors"], told["memories"], told["added"]) == (1, 0, 5, 1) and told["total_tokens"] > 0
    added = spark.read.parquet(str(tmp_path / "memories")).where("origin = 'added'").first()
    assert (added["content"], added["location"], added["keywords"]) == ("likes red tea much", "Rome", ["red", "tea", "much"])
    report = {r["bank"]: r for r in spark.read.parquet(str(tmp_path / "report")).collect()}
    assert (report["one"]["status"], report["one"]["pair_count"], report["none"]["status"], report["none"]["pair_count"], report["none"]["updated_content_tokens"]) == ("skipped", None, "no_pairs", 0, None)
    assert (report["b"]["status"], report["b"]["superseded"], report["b"]["updated_count"]) == ("updated", 1, 2)
    idle = jobs.run_update(m, lambda: EchoChat("never asked"), str(tmp_path / "two"), pairs=pairs.limit(0))
    assert idle["pairs"] == 0 and idle["memories"] == 6


def test_prompts_of_pairs_are_made_where_both_memories_are(spark, tmp_path):
    """The same decisions as with a row a prompt, also for texts with names of the template in them, and no prompt in the plan."""
    rows = [("b", i, f" text {i} {{OLD}} ", f"fact{i % 2}" if i else None, "2024" if i % 2 else "", "", "why {TYPE}", "", ["alpha", "beta"] if i < 4 else None) for i in range(6)]
    m = spark.createDataFrame(rows, "bank string, idx long, content string, memory_type string, time string, location string, reason string, purpose string, keywords array<string>").withColumn("source_time", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    pairs = spark.createDataFrame([("b", j, i) for j in range(6) for i in range(j)], "bank string, idx_new long, idx_old long")
    answer = lambda p: json.dumps({"decision": "MERGE", "merged_content": p})
    for method in ("content", "dimension"):
        read = lambda x: sorted(tuple(map(str, r)) for r in x.drop("merged_dimension").collect())
        own = jobs.decide(m, lambda: EchoChat(answer), method=method, pairs=pairs)
        want = read(jobs.decide(m, lambda: EchoChat(answer), method=method, pairs=pairs, ledger=Ledger(spark, str(tmp_path / method), "r")))
        assert len(want) == 15 and read(own) == want
    asked = U.ask_of_both(pairs.select("bank", F.col("idx_new").alias("i"), F.col("idx_old").alias("j")), m, [F.col("content")], "{NEW}", {"NEW": ("i", 0)}, lambda: EchoChat(answer))
    assert asked.count() == 15 and "prompt" not in asked.columns


def test_extraction_resumes(spark, tmp_path):
    item = [("q1", [[("user", "likes pizza"), ("assistant", "ok"), ("user", "works at night")]], ["2023/06/25 (Sun) 13:22"], ["s1"])]
    df = spark.createDataFrame(item, "question_id string, haystack_sessions array<array<struct<role:string,content:string>>>, haystack_dates array<string>, haystack_session_ids array<string>")
    windows = G.sliding_windows(G.number_messages(G.flatten_histories(df)), 5, 1)
    ledger = Ledger(spark, str(tmp_path / "l"), "r1", {"model": "x"})
    assert not jobs.ask_for_memories(windows, lambda: EchoChat(""), tries=1, ledger=ledger).first()["ok"]
    answer = '{"memories": [{"source_id": 1, "content": "pizza"}]}'
    got = jobs.ask_for_memories(windows, lambda: EchoChat(answer), tries=1, ledger=Ledger(spark, str(tmp_path / "l"), "r2", {"model": "x"}))
    assert [r["content"] for r in jobs.memories_of(got, windows).collect()] == ["pizza"]


def test_top_records_and_presence(spark):
    keys = spark.createDataFrame([(i,) for i in range(6)], "k int")
    lists = spark.createDataFrame([(0, '[{"a": 1}, {"a": 2}, {"a": 3}]'), (1, '[{"a": 1}'), (2, '{"a": 1}'), (3, "[]"), (4, None)], "k int, value string")
    got = sorted((r["k"], r["rank"] or 0, r["record"]["a"] if r["record"] else None, r["corrupt"]) for r in jsonio.top_records(keys, lists, ["k"], 2, "struct<a:int>").collect())
    assert got == [(0, 1, 1, False), (0, 2, 2, False), (1, 0, None, True), (2, 0, None, True), (3, 0, None, False), (4, 0, None, True), (5, 0, None, None)]
    assert sorted(r["k"] for r in jsonio.present(keys, lists.unionByName(lists), ["k"]).collect()) == [0, 1, 2, 3, 4]


def test_quick_start_report_and_judge_run(spark, tmp_path, capsys):
    got = quickstart.run(spark, quickstart.CHAT, quickstart.QUESTION, quickstart.ANSWER)
    row = got.first()
    assert (row["label"], row["gold"], row["memories"]) == ("CORRECT", "Lisbon", 2) and "Lisbon" in row["answer"]
    answers = spark.createDataFrame([("c", "q1", "Lisbon", "1"), ("c", "q2", "Rome", "2"), ("c", "q3", "x", "1")], "conv string, question string, answer string, category string")
    gold = spark.createDataFrame([("c", 0, "q1", "Lisbon"), ("c", 1, "Q2", "Paris")], "conv string, pos long, question string, gold string")
    folder = str(tmp_path / "out")
    report = jobs.run_judge(answers, gold, quickstart.scripted, folder, "r1", {"category": F.col("category")})
    assert {(r["dimension"], r["value"], r["total"], r["correct"], r["missing"]) for r in report.collect()} == {("overall", "", 3, 1, 1), ("category", "1", 2, 1, 1), ("category", "2", 1, 0, 0)}
    counts = spark.read.parquet(f"{folder}/runs").first()["counts"]
    assert (counts["answers"], counts["missing_gold"], counts["unlabelled"]) == (3, 1, 0) and counts["total_tokens"] > 0
    assert spark.read.json(f"{folder}/report").count() == 3 and "| overall |" in "\n".join(r["value"] for r in spark.read.text(f"{folder}/markdown").collect())
    report_cli.main([f"{folder}/judged", "conv"])
    assert "| conv | c | 3 | 1 | 33.33 |" in capsys.readouterr().out


def test_numbers_and_templates(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.random(), i) for i in range(300)]
    got = numbered(spark.createDataFrame(rows, "k string, x double, i int").repartition(5), ["k"], ["x"], "n")
    want = {i: 1 + sum(k2 == k and x2 < x for k2, x2, _ in rows) for k, x, i in rows}
    assert {r["i"]: r["n"] for r in got.collect()} == want
    (tmp_path / "t.txt").write_text("Ask {QUESTION}\nnow")
    (tmp_path / "blank.txt").write_text(" ")
    assert prompts.load(spark, str(tmp_path / "t.txt"), "d") == "Ask {QUESTION}\nnow" and prompts.load(spark, None, "d") == "d" == prompts.load(spark, str(tmp_path / "blank.txt"), "d")


def test_memories_of_files_of_several_lines(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "all_memories.json").write_text(json.dumps({"memories": [{"content": "x", "dimension": {"memory_type": "fact"}}, {"content": "y"}]}, indent=2))
    assert sorted((r["record_idx"], r["content"], r["memory_type"]) for r in jsonio.read_memories(spark, str(tmp_path)).collect()) == [(0, "x", "fact"), (1, "y", "other")]


def test_files_of_a_folder_are_one_list(spark, tmp_path, monkeypatch):
    """Several files of a bank or window are numbered on in the order of their names; the query writes no file of more than so many ids."""
    for name, texts in (("part-1.json", ["c"]), ("part-0.json", ["a", "b"])):
        for folder in ("own", "windows/window_2"):
            (tmp_path / folder).mkdir(parents=True, exist_ok=True)
            (tmp_path / folder / name).write_text(json.dumps({"memories": [{"content": t} for t in texts]}))
    got = sorted((r["bank"], r["record_idx"], r["boundary_id"], r["content"]) for r in jsonio.read_memories(spark, str(tmp_path)).collect())
    assert got == [(b, i, f"{w}_000{i}", t) for b, w in (("own", "all_memories"), ("windows", "window_2")) for i, t in enumerate("abc")]
    d = "/root/testdata/sf0.001"
    want, folders = sorted(edges.load_records(spark, d).collect()), []
    monkeypatch.setattr(edges, "IDS_A_FILE", 100)
    monkeypatch.setattr(edges, "scratch", lambda s: folders.append(str(tmp_path / "run")) or folders[-1])
    assert sorted(edges.load_records(spark, d).collect()) == want
    sizes = [len(json.loads(f.read_text())["memories"]) for f in tmp_path.glob("run/**/*.json")]
    assert len(sizes) > 20 and max(sizes) <= 100
