"""The jobs end to end with a scripted model."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from recallforge.operators import judge as J
from recallforge.operators import segment as G
from recallforge.operators import upkeep as U
from recallforge.plans import jobs
from recallforge.ports import EchoChat
from recallforge.sources import jsonio


def test_from_chats_to_a_report(spark):
    def extractor():
        def reply(prompt):
            found = re.findall(r"(\d+)\.User: (.*)", prompt)
            return "```json\n" + json.dumps({"memories": [{"source_id": int(i), "content": t, "dimension": {"memory_type": "fact", "keywords": t.split()}} for i, t in found] + [{"source_id": "x", "content": "lost"}]}) + "\n```"

        return EchoChat(reply)

    item = [("q1", [[("user", "likes pizza Rome"), ("assistant", "ok"), ("user", "works at night")]], ["2023/06/25 (Sun) 13:22"], ["s1"])]
    df = spark.createDataFrame(item, "question_id string, haystack_sessions array<array<struct<role:string,content:string>>>, haystack_dates array<string>, haystack_session_ids array<string>")
    windows = G.sliding_windows(G.number_messages(G.flatten_histories(df)), 5, 1)
    asked = jobs.ask_for_memories(windows, extractor)
    got = jobs.memories_of(asked, windows)
    assert jobs.extraction_summary(asked, got).first().asDict() == {"sample": "q1", "ok_count": 1, "error_count": 0, "memory_count": 2}
    mem = got.select(F.col("sample").alias("bank"), F.col("memory_index").cast("long").alias("record_idx"), "content", F.lit("").alias("reason"), F.lit("").alias("purpose"), F.lit("").alias("location"), F.lit("").alias("time"), "memory_type", "keywords", F.to_timestamp("source_time").cast("timestamp_ntz").alias("source_time"))
    q = spark.createDataFrame([(1, "q1", "What food?", None)], "query_id long, bank string, question string, question_date string")
    parsed = jobs.analyse(q, lambda: EchoChat('{"query_anchor": "pizza", "dimension": {"keywords": ["pizza"], "target_memory_type": ["fact"]}}'))
    fused = jobs.retrieve(mem, parsed, k=2)
    assert fused.orderBy("position").first()["record_idx"] == 0
    answers = jobs.answer(q, fused, mem, lambda: EchoChat(lambda p: "Reasoning: seen\nAnswer: " + ("pizza" if "likes pizza Rome" in p and "[unknown]" in p else "?")))
    a = answers.first()
    assert (a["answer"], a["reasoning"]) == ("pizza", "seen")
    gold = spark.createDataFrame([("q1", 0, "what  FOOD ?", "pizza")], "conv string, pos long, question string, gold string")
    judged = jobs.judge(answers.withColumn("conv", F.col("bank")), gold, lambda: EchoChat('{"label": "CORRECT"}'))
    report = J.accuracy(judged, {"conv": F.col("conv")})
    assert {(r["dimension"], r["accuracy"]) for r in report.collect()} == {("overall", 100.0), ("conv", 100.0)} and "| overall |" in J.markdown(report)


def test_upkeep_of_a_bank(spark):
    rows = [("b", 0, "likes red tea", "fact", ["red", "tea"], "2023-01-01 00:00:00"), ("b", 1, "likes red tea much", "fact", ["red", "tea", "much"], "2023-01-02 00:00:00"), ("b", 2, "has a dog", "fact", ["dog"], "2023-01-03 00:00:00")]
    mem = spark.createDataFrame(rows, "bank string, idx long, content string, memory_type string, keywords array<string>, t string").withColumn("source_time", F.to_timestamp("t").cast("timestamp_ntz")).drop("t")
    d = jobs.decide(mem, lambda: EchoChat('{"decision": "MERGE", "merged_content": "likes red tea a lot"}'))
    assert [(r["idx_new"], r["idx_old"], r["decision"]) for r in d.collect()] == [(1, 0, "MERGE")]
    after = U.apply_decisions(mem, d)
    assert sorted(r["content"] for r in after.collect()) == ["has a dog", "likes red tea a lot"]
    assert U.update_report(mem, after).first()["reduced"] == 1


def test_question_sources(spark):
    items = spark.createDataFrame([("s", [("a", "1", 1), ("b", "2", 5), ("c", "3", None)])], "sample string, qa array<struct<question:string,answer:string,category:int>>")
    assert [(r["pos"], r["question"]) for r in jsonio.questions_of(items, (5,)).orderBy("pos").collect()] == [(0, "a"), (2, "c")]
    assert jsonio.questions_of(items, per_item=2).count() == 2
    banks = spark.createDataFrame([("x",), ("MERGED",), ("README.md",)], "bank string")
    assert [r["bank"] for r in jsonio.banks_of(banks).collect()] == ["x"]
    parts = [spark.createDataFrame([(1, v)], "uid int, v string") for v in ("old", "new")]
    assert jsonio.last_wins(parts, ["uid"]).first()["v"] == "new"
