"""Quick start: one chat from turns to a judged answer, ``python -m recallforge.quickstart``.

The model is scripted, so that it runs offline; give ``run`` the opener of a real port instead.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.operators import judge as J
from recallforge.operators import segment as G
from recallforge.plans import jobs
from recallforge.ports import ChatPort, EchoChat

CHAT = [("user", "I moved to Lisbon in May for the new job."), ("assistant", "Congratulations!"), ("user", "My sister Ana visits in August.")]
QUESTION, ANSWER = "Where did I move?", "Lisbon"


def scripted() -> ChatPort:
    """Takes every message as a memory, looks for the words of the question and answers from the first memory."""

    def reply(p: str) -> str:
        if p.startswith("You keep a memory"):
            return json.dumps({"memories": [{"source_id": int(i), "content": t, "dimension": {"memory_type": "fact", "keywords": re.findall("[A-Z][a-z]+", t)}} for i, t in re.findall(r"(\d+)\.User: (.*)", p)]})
        if p.startswith("Describe what"):
            return json.dumps({"query_anchor": "moved Lisbon job", "dimension": {"keywords": ["Lisbon"], "target_memory_type": ["fact"]}})
        if p.startswith("Question:"):
            return json.dumps({"label": "CORRECT" if re.search(r"Expected: (.*)", p)[1] in re.search(r"Given: (.*)", p)[1] else "WRONG"})
        return "Reasoning: the first memory\nAnswer: " + (re.search(r"content: (.*)", p) or ["", "unknown"])[1]

    return EchoChat(reply)


def run(spark: SparkSession, chat: list[tuple[str, str]], question: str, gold: str, open_port: Callable[[], ChatPort] = scripted, when: str = "2023/06/25 (Sun) 13:22") -> DataFrame:
    """(question, memories, answer, reasoning, gold, label) of one chat."""
    item = spark.createDataFrame([("demo", [chat], [when], ["s1"])], "question_id string, haystack_sessions array<array<struct<role:string,content:string>>>, haystack_dates array<string>, haystack_session_ids array<string>")
    windows = G.sliding_windows(G.number_messages(G.flatten_histories(item)), 15, 3)
    got = jobs.memories_of(jobs.ask_for_memories(windows, open_port), windows)
    own = lambda c: F.coalesce(c, F.lit("")).alias(c)
    memories = got.select(F.col("sample").alias("bank"), F.col("memory_index").cast("long").alias("record_idx"), "content", own("reason"), own("purpose"), own("location"), own("time"), "memory_type", "keywords", F.to_timestamp("source_time").cast("timestamp_ntz").alias("source_time"))
    asked = spark.createDataFrame([(1, "demo", question, when)], "query_id long, bank string, question string, question_date string")
    fused = jobs.retrieve(memories, jobs.analyse(asked, open_port), k=5)
    answers = jobs.answer(asked, fused, memories, open_port).withColumn("conv", F.col("bank"))
    truth = spark.createDataFrame([("demo", 0, question, gold)], "conv string, pos long, question string, gold string")
    judged = jobs.judge(answers, truth, open_port)
    return judged.withColumn("memories", F.lit(fused.count())).select("question", "memories", "answer", "reasoning", "gold", "status", "label", "conv")


def main() -> None:
    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    got = run(spark, CHAT, QUESTION, ANSWER)
    print(json.dumps(got.drop("conv").first().asDict(), indent=2))
    print(J.markdown(J.accuracy(got, {"conv": F.col("conv")})))


if __name__ == "__main__":
    main()
