"""End-to-end jobs: chats to memories, questions to answers, answers to labels, banks to smaller banks.

A model is a port that the caller opens. With a ``Ledger`` its answers are stored as they come and a job that
is run again asks only for what has no answer yet; without one they should be stored before they are used again: Spark may repeat a call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from recallforge.functions import parsing as P
from recallforge.operators import judge as J
from recallforge.operators import retrieve as R
from recallforge.operators import segment as G
from recallforge.operators import upkeep as U
from recallforge.plans import prompts
from recallforge.ports import USAGE, ChatPort, CompressPort, chat
from recallforge.sources.ledger import Ledger
from recallforge.sources.jsonio import append_manifest, write_json, write_texts
from recallforge.sources.shared import numbered, stash

_RESULT = ("prompt", "response", "ok", "error", "prompt_key", *USAGE)


def _ask(rows: DataFrame, open_port: Callable[[], ChatPort], ledger: Ledger | None, step: str, **how) -> DataFrame:
    return chat(rows, open_port, **how) if ledger is None else ledger.ask(rows, step, open_port, **how)


_ENTRY = "array<struct<source_id:string,content:string,dimension:struct<memory_type:string,time:string,location:string,reason:string,purpose:string,keywords:array<string>>>>"


def ask_for_memories(windows: DataFrame, open_port: Callable[[], ChatPort], template: str = prompts.EXTRACT, rule: str = prompts.OVERLAP_RULE, speaker: bool = False, tries: int = 5, ledger: Ledger | None = None) -> DataFrame:
    """One row a window, with prompt, response, ok and error. The overlap is the window's own."""
    w = G.window_texts(windows, speaker)
    prompt = P.build_prompt(F.lit(template), F.col("text"), F.col("message_count"), F.col("overlap_count"), rule)
    return _ask(w.select("sample", "window_index", prompt.alias("prompt")), open_port, ledger, "extract", tries=tries)


def memories_of(responses: DataFrame, windows: DataFrame, keep_any_source: bool = False) -> DataFrame:
    """Normalised memories of stored responses: (sample, window_index, memory_index, content, source_time, session, dimension parts)."""
    read = responses.where("ok").select("sample", "window_index", P.json_strict(F.col("response")).alias("body"))
    listed = F.when(F.col("body").startswith("["), F.col("body")).otherwise(F.get_json_object("body", "$.memories"))
    e = read.select("sample", "window_index", F.posexplode(F.from_json(listed, _ENTRY)).alias("memory_index", "e"))
    d = F.col("e.dimension")
    flat = e.select("sample", "window_index", "memory_index", F.col("e.source_id").alias("source_id"), F.col("e.content").alias("content"), d["memory_type"].alias("memory_type"), d["time"].alias("time"), d["location"].alias("location"), d["reason"].alias("reason"), d["purpose"].alias("purpose"), F.coalesce(d["keywords"], F.array().cast("array<string>")).alias("keywords"))
    return G.normalize_memories(flat, windows, keep_any_source)


def extraction_summary(responses: DataFrame, memories: DataFrame) -> DataFrame:
    n = memories.groupBy("sample").agg(F.count(F.lit(1)).alias("memory_count"))
    return responses.groupBy("sample").agg(F.count_if("ok").alias("ok_count"), F.count_if(~F.col("ok")).alias("error_count")).join(n, "sample", "left").withColumn("memory_count", F.coalesce("memory_count", F.lit(0)))


def analyse(questions: DataFrame, open_port: Callable[[], ChatPort], template: str = prompts.QUERY, tries: int = 5, ledger: Ledger | None = None) -> DataFrame:
    """Questions (query_id, bank, question, question_date) with their parsed query: anchor, types, time, location, keywords, mode."""
    asked = _ask(questions.withColumn("prompt", prompts.fill(template, DATE=F.col("question_date"), QUESTION=F.col("question"))), open_port, ledger, "analyse", tries=tries)
    p = asked.withColumn("body", F.coalesce(P.json_strict(F.col("response")), F.lit("{}"))).withColumn("p", P.parsed_query(F.col("body")))
    return p.select("query_id", "bank", "question", "question_date", "ok", "error", "p.*")


def retrieve(memories: DataFrame, parsed: DataFrame, vectors: DataFrame | None = None, k: int = 15, order: tuple[str, ...] = ("bm25", "structured", "dense"), cap: int = 0) -> DataFrame:
    """Fused rows of the routes in ``order``; the dense one needs ``vectors`` (bank, record_idx, embedding) and parsed queries with ``vector``."""
    lists = {"bm25": R.search_bm25(memories, parsed, k), "structured": R.search_structured(memories, parsed, k)}
    if vectors is not None:
        lists["dense"] = R.search_dense(vectors, parsed.select("query_id", "bank", "vector"), k)
    rows = None
    for name in [n for n in order if n in lists]:
        part = lists[name].select("query_id", "bank", F.lit(name).alias("route"), "rank", "score", "record_idx")
        rows = part if rows is None else rows.unionByName(part)
    return R.fuse(rows.join(memories.select("bank", "record_idx", "content"), ["bank", "record_idx"]), list(order), cap=cap)


def answer(questions: DataFrame, fused: DataFrame, memories: DataFrame, open_port: Callable[[], ChatPort], template: str = prompts.ANSWER, thinking: bool = False, tries: int = 3, ledger: Ledger | None = None) -> DataFrame:
    """Questions with prompt, response, answer and reasoning; a question without memories is asked too."""
    fields = memories.select("bank", "record_idx", "content", "reason", "purpose", F.date_format("source_time", "yyyy-MM-dd'T'HH:mm:ss").alias("source_time"))
    ranked = fused.select("query_id", "bank", "record_idx", F.col("position").alias("rank")).join(fields, ["bank", "record_idx"])
    blocks = R.format_memories(questions.select("query_id", "bank").join(ranked, ["query_id", "bank"], "left"), ["query_id", "bank"])
    asked = questions.join(blocks, ["query_id", "bank"]).withColumn("prompt", prompts.fill(template, MEMORIES=F.col("memories"), DATE=F.col("question_date"), QUESTION=F.col("question")))
    got = _ask(asked.drop("memories"), open_port, ledger, "answer", tries=tries)
    parse = P.parse_thinking_answer if thinking else P.parse_answer
    return got.withColumn("a", parse(F.col("response"))).select("*", "a.answer", "a.reasoning").drop("a")


def judge(answers: DataFrame, gold: DataFrame, open_port: Callable[[], ChatPort], template: str = prompts.JUDGE, tries: int = 3, ledger: Ledger | None = None) -> DataFrame:
    """Answers (conv, question, answer, ...) with gold, status and label; answers without a label are asked for again, those without gold never."""
    met = J.gold_join(answers, gold)
    prompt = prompts.fill(template, QUESTION=F.col("question"), GOLD=F.col("gold"), ANSWER=F.col("answer"))
    known = met.where("status = 'ok'").drop(*_RESULT).withColumn("prompt", prompt)
    labelled = _ask(known, open_port, ledger, "judge", tries=tries, accept=lambda t: "CORRECT" in t.upper() or "WRONG" in t.upper()).withColumn("label", P.parse_judge_label(F.col("response")))
    lost = met.where("status <> 'ok'").drop(*_RESULT)
    for c, kind in (("prompt", "string"), ("response", "string"), ("ok", "boolean"), ("error", "string"), ("prompt_key", "string"), *((u, "int") for u in USAGE)):
        lost = lost.withColumn(c, F.lit(None).cast(kind))
    return labelled.unionByName(lost.withColumn("label", F.lit("")))


def run_judge(answers: DataFrame, gold: DataFrame, open_port: Callable[[], ChatPort], folder: str, run: str, sets: dict[str, Column], ledger: Ledger | None = None, **how) -> DataFrame:
    """Judge ``answers`` and write, below ``folder``, ``judged`` (a row an answer), ``report`` as JSON, ``markdown`` as text, and a row of the ``runs`` manifest with counts observed on the way. Returns the report."""
    spark, seen = answers.sparkSession, Observation("judged")
    judged = judge(answers, gold, open_port, ledger=ledger, **how)
    counts = [F.count(F.lit(1)).alias("answers"), F.count_if(F.col("status") == "missing_gold").alias("missing_gold"), F.count_if((F.col("status") == "ok") & (F.col("label") == "")).alias("unlabelled"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens")]
    judged.observe(seen, *counts).write.mode("overwrite").parquet(f"{folder}/judged")
    report = J.accuracy(spark.read.parquet(f"{folder}/judged"), sets)
    write_json(report, f"{folder}/report")
    write_texts(spark.createDataFrame([(run, J.markdown(report))], "run string, text string"), f"{folder}/markdown", "text", ["run"])
    append_manifest(spark, f"{folder}/runs", run, "judge", seen.get)
    return report


#: Parts of a dimension as a model gives them.
_DIMENSION = "struct<memory_type:string,time:string,location:string,reason:string,purpose:string,keywords:array<string>>"


def _ask_by_prompt(ends: DataFrame, memories: DataFrame, fields: dict[str, Column], template: str, places: dict[str, tuple[str, int]], open_port: Callable[[], ChatPort], ledger: Ledger, step: str, tries: int) -> DataFrame:
    """Answers of a ledger on pairs (bank, i, j), with a row a prompt, as the ledger tells prompts by their text."""
    met = U.with_both(ends, memories, list(fields.values()))
    prompt = prompts.fill(template, **{name: F.get(f"of_{end}", F.lit(at)) for name, (end, at) in places.items()})
    return _ask(met.select("bank", F.col("i").alias("idx_new"), F.col("j").alias("idx_old"), prompt.alias("prompt")), open_port, ledger, step, tries=tries)


def decide(memories: DataFrame, open_port: Callable[[], ChatPort], least: float = 0.3, similar: float = 0.7, method: str = "content", template: str | None = None, tries: int = 3, ledger: Ledger | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Decisions (bank, ord, idx_new, idx_old, decision, merged_content, merged_dimension, reasoning, error and token counts) on the conflict pairs of banks; an error keeps both.

    ``method``: ``content`` shows the model contents and times; ``dimension`` shows type, time, keywords, reason and purpose too and reads the
    merged dimension of its answer (null where it gives none). ``pairs`` (bank, idx_new, idx_old) in place of the blocked ones.
    """
    pairs = U.blocked_pairs(memories, least, similar) if pairs is None else pairs
    fields = {"TIME": F.col("source_time").cast("string"), "C": F.col("content")}
    if method == "dimension":
        fields |= {"TYPE": F.col("memory_type"), "WHEN": F.col("time"), "KEYWORDS": F.array_join("keywords", ", "), "REASON": F.col("reason"), "PURPOSE": F.col("purpose")}
    names = list(fields)
    ends = pairs.select("bank", F.col("idx_new").alias("i"), F.col("idx_old").alias("j"))
    places = {"NEW": ("i", names.index("C")), "OLD": ("j", names.index("C"))} | {f"{f}_{n.upper()}": ("i" if n == "new" else "j", at) for at, f in enumerate(names) if f not in ("C", "TYPE") for n in ("new", "old")}
    if method == "dimension":
        places["TYPE"] = ("i", names.index("TYPE"))
    template = template or (prompts.DECIDE_DIMENSION if method == "dimension" else prompts.DECIDE)
    if ledger is None:
        got = U.ask_of_both(ends, memories, list(fields.values()), template, places, open_port, tries).select("bank", F.col("i").alias("idx_new"), F.col("j").alias("idx_old"), "response", "ok", "error", *USAGE)
    else:
        got = _ask_by_prompt(ends, memories, fields, template, places, open_port, ledger, f"decide-{method}", tries)
    body = P.json_strict(F.col("response"))
    given = F.when(F.col("ok"), F.from_json(F.get_json_object(body, "$.merged_dimension"), _DIMENSION)) if method == "dimension" else F.lit(None).cast(_DIMENSION)
    text = lambda p: F.coalesce(F.get_json_object(body, p), F.lit(""))
    read = got.select("bank", "idx_new", "idx_old", F.when(F.col("ok"), P.parse_decision(F.col("response"))).otherwise("KEEP_BOTH").alias("decision"), text("$.merged_content").alias("merged_content"), given.alias("merged_dimension"), text("$.reasoning").alias("reasoning"), "error", *USAGE)
    return numbered(stash(read, "answers"), ["bank"], ["idx_new", "idx_old"], "ord")  # decisions are taken in one order; its rows are stored already


def compress_texts(rows: DataFrame, open_port: Callable[[], CompressPort], ledger: Ledger, text: str = "content", rate: float = 0.8, tries: int = 3, **how) -> DataFrame:
    """``rows`` with ``compressed``, ok and error, by a compression port through the ledger: a second run compresses what failed or is new. Blank texts stay and are not sent; what failed, or came back empty, stays as it was."""

    def opened() -> ChatPort:
        port = open_port()
        return lambda t: port(t, rate)

    sent = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", F.col(text))
    got = ledger.ask(rows.withColumn("prompt", sent), f"compress-{rate}", opened, tries=tries, accept=lambda t: t is not None, **how)
    done = F.when(F.col("ok") & (F.col("response") != ""), F.col("response")).otherwise(F.col(text))
    blank = F.col("prompt").isNull()
    return got.select(*rows.columns, done.alias("compressed"), (F.col("ok") | blank).alias("ok"), F.when(blank, "").otherwise(F.col("error")).alias("error"))


def run_update(memories: DataFrame, open_port: Callable[[], ChatPort], folder: str, method: str = "content", ledger: Ledger | None = None, **how) -> dict[str, int]:
    """Decide, apply and write ``memories``, ``decisions`` and ``report`` (a row a bank) below ``folder``; counts observed while these are written, without another pass."""
    decisions = decide(memories, open_port, method=method, ledger=ledger, **how)
    made, kept = Observation("decisions"), Observation("memories")
    decisions.observe(made, F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("error") != "").alias("errors"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens")).write.mode("overwrite").parquet(f"{folder}/decisions")
    after = U.apply_dimensions(memories, decisions) if method == "dimension" else U.apply_decisions(memories, decisions)
    after.observe(kept, F.count(F.lit(1)).alias("memories"), F.count_if(F.col("origin") == "added").alias("added")).write.mode("overwrite").parquet(f"{folder}/memories")
    U.update_rows(memories, decisions, memories.sparkSession.read.parquet(f"{folder}/memories")).write.mode("overwrite").parquet(f"{folder}/report")
    return {**made.get, **kept.get}
