"""Prompt templates in our own words. Placeholders in braces are filled by columns; any template can be replaced by the caller."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from recallforge.functions.text import clean

EXTRACT = """You keep a memory of a conversation. Below are {COUNT} messages, each with its time and number.{OVERLAP_RULE}
Write JSON {"memories": [{"source_id": number of the message, "content": one self-contained sentence,
"dimension": {"memory_type": "fact" or "episodic" or "profile", "time": "", "location": "", "reason": "", "purpose": "", "keywords": []}}]}.

{DIALOGUE}"""
OVERLAP_RULE = " The first {N} were handled before and only give context; begin with number {NEXT}."
QUERY = """Describe what must be found to answer the question, as JSON {"query_anchor": "", "need_assistant_context": false,
"dimension": {"target_memory_type": [], "time": "", "location": "", "keywords": []}, "answer_dim": "content"}.
A time is a date (YYYY, YYYY-MM or YYYY-MM-DD) after on, before, after or around, or "between A and B".

Question ({DATE}): {QUESTION}"""
ANSWER = """Answer from these memories only.

{MEMORIES}

Question ({DATE}): {QUESTION}
Write a line that begins with "Reasoning:" and then a line that begins with "Answer:"."""
JUDGE = """Question: {QUESTION}
Expected: {GOLD}
Given: {ANSWER}
Does the given answer say what is expected? Reply with JSON {"label": "CORRECT"} or {"label": "WRONG"}."""
DECIDE = """Two memories may be about the same thing.
Newer ({TIME_NEW}): {NEW}
Older ({TIME_OLD}): {OLD}
Reply with JSON {"decision": "MERGE" or "SUPERSEDE" or "KEEP_BOTH", "merged_content": "", "reasoning": ""}."""

DECIDE_DIMENSION = """Two memories of the kind {TYPE} may be about the same thing.
Newer, told {TIME_NEW}: {NEW}
 it happened: {WHEN_NEW}; keywords: {KEYWORDS_NEW}; reason: {REASON_NEW}; purpose: {PURPOSE_NEW}
Older, told {TIME_OLD}: {OLD}
 it happened: {WHEN_OLD}; keywords: {KEYWORDS_OLD}; reason: {REASON_OLD}; purpose: {PURPOSE_OLD}
Reply with JSON {"decision": "MERGE" or "SUPERSEDE" or "KEEP_BOTH", "merged_content": "", "merged_dimension": {"memory_type": "", "time": "",
"location": "", "keywords": [], "reason": "", "purpose": ""}, "reasoning": ""}; leave empty what stays as the newer has it."""


def fill(template: str, **columns: Column) -> Column:
    """The template with each {NAME} replaced by a column; null and blank values become ``[unknown]`` for DATE and empty else."""
    out = F.lit(template)
    for name, c in columns.items():
        value = clean(c)
        if name == "DATE":
            value = F.when(value == "", F.lit("[unknown]")).otherwise(value)
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def load(spark: SparkSession, path: str | None, default: str) -> str:
    """The template in a text file that Spark can read; ``default`` without a path or for a blank file."""
    if not path:
        return default
    text = spark.read.text(path, wholetext=True).first()
    return text["value"] if text and (text["value"] or "").strip() else default
