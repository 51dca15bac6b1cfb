"""Column functions that read model output: JSON fragments, answers, labels, decisions, dialogue lines."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from recallforge.functions.text import clean, clean_json, joined, unique_strings

_FENCE = r"(?is)^```(?:json)?\s*|\s*```$"
#: Decision labels in the order in which they are looked for.
DECISIONS = ("MERGE", "SUPERSEDE", "KEEP_BOTH")


def _valid(x: Column) -> Column:
    """``x`` where it is one whole JSON value: the parser alone would pass over what follows the first."""
    return F.when(F.try_parse_json(x).isNotNull() & (F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))) == 1), x)


def json_lenient(x: Column) -> Column:
    """The text if it is JSON, else from its first { to its last } if that is, else ``{}``."""
    t = clean(x)
    return F.coalesce(_valid(t), _valid(F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit(""))), F.lit("{}"))


@F.pandas_udf(StringType())
def _scan_json(texts: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def first(text: str | None) -> str | None:
        for i, c in enumerate(text or ""):
            if c in "{[":
                try:
                    return json.dumps(decoder.raw_decode(text, i)[0], ensure_ascii=False)
                except ValueError:
                    pass
        return None

    return texts.map(first)


def json_strict(x: Column) -> Column:
    """The text without code fences if it is JSON, else the first JSON object or array that starts in it, else null.

    Only texts that are not JSON as they stand reach Python, in Arrow batches.
    """
    bare = clean(F.regexp_replace(clean(x), _FENCE, ""))
    return F.coalesce(_valid(bare), _scan_json(F.when(_valid(bare).isNull(), bare)))


def message_content(response: Column) -> Column:
    """Text of the first choice of a chat response, empty where there is none."""
    return F.coalesce(F.get_json_object(response, "$.choices[0].message.content"), F.lit(""))


def usage(response: Column) -> Column:
    """Token counts of a chat response, 0 where absent."""
    return F.struct(*[F.coalesce(F.try_to_number(F.get_json_object(response, f"$.usage.{n}"), F.lit("999999999")).cast("int"), F.lit(0)).alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")])


def _last_line(text: Column, label: str) -> Column:
    """What follows the first colon of the last line that begins with ``label``."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda s: s.rlike(rf"(?i)^\s*{label}:"))
    return F.when(F.size(lines) > 0, clean(F.regexp_extract(F.try_element_at(lines, F.lit(-1)), r"(?s)^[^:]*:(.*)$", 1)))


def parse_answer(x: Column) -> Column:
    """struct(answer, reasoning) by the last lines so labelled; without an answer line the whole text is the answer."""
    t = clean(x)
    return F.struct(F.coalesce(_last_line(t, "answer"), t).alias("answer"), F.coalesce(_last_line(t, "reasoning"), F.lit("")).alias("reasoning"))


def parse_thinking_answer(x: Column) -> Column:
    """``parse_answer`` of what follows a closed thinking part; an unclosed one leaves an empty answer."""
    t = clean(x)
    opened, closed = F.instr(t, "<think>"), F.instr(t, "</think>")
    after = F.regexp_replace(t, r"(?s)^.*?</think>", "")
    rest = F.when(closed > 0, after).when(opened > 0, F.lit("")).otherwise(t)
    return parse_answer(rest)


def parse_judge_label(x: Column) -> Column:
    """CORRECT or WRONG from a JSON label or as the first such word, else empty."""
    t = clean(x)
    from_json = F.upper(clean(F.get_json_object(_valid(t), "$.label")))
    word = F.upper(F.regexp_extract(t, r"(?i)\b(CORRECT|WRONG)\b", 1))
    return F.when(from_json.isin("CORRECT", "WRONG"), from_json).otherwise(word)


def parse_decision(x: Column) -> Column:
    """MERGE, SUPERSEDE or KEEP_BOTH from JSON, fenced JSON, a JSON part, or the first label found; KEEP_BOTH if none."""
    t = clean(x)
    fenced = F.nullif(F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    part = F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit(""))
    body = F.coalesce(_valid(t), _valid(F.trim(fenced)), _valid(part))
    named = F.upper(clean(F.get_json_object(body, "$.decision")))
    seen = F.lit(None).cast("string")
    for d in reversed(DECISIONS):
        seen = F.when(F.contains(F.upper(t), F.lit(d)), F.lit(d)).otherwise(seen)
    return F.coalesce(F.when(named.isin(*DECISIONS), named), F.when(body.isNull(), seen), F.lit("KEEP_BOTH"))


def parsed_query(x: Column) -> Column:
    """Normalised query from its JSON: anchor, types, time, location, keywords, answer field, flag, mode."""
    get = lambda p: F.get_json_object(x, p)
    strings = lambda p: unique_strings(F.coalesce(F.from_json(get(p), "array<string>"), F.when(clean_json(get(p)) != "", F.array(get(p)))), fold_case=True)
    return F.struct(
        clean_json(get("$.query_anchor")).alias("anchor"), F.filter(F.transform(strings("$.dimension.target_memory_type"), F.lower), lambda t: t.isin("fact", "episodic", "profile")).alias("types"),
        clean_json(get("$.dimension.time")).alias("time"), clean_json(get("$.dimension.location")).alias("location"), strings("$.dimension.keywords").alias("keywords"),
        F.coalesce(F.nullif(clean_json(get("$.answer_dim")), F.lit("")), F.lit("content")).alias("answer_field"),
        (clean_json(get("$.need_assistant_context")) != "").alias("need_context"), F.lower(clean_json(get("$.parse_mode"))).alias("mode"),
    )


def bm25_text(parsed: Column) -> Column:
    return joined(" ", parsed["anchor"], F.array_join(parsed["keywords"], " "))


def dialogue_times(x: Column, any_speaker: bool = False) -> Column:
    """Array of struct(source_id, time) of the lines ``[time, Day] n.User: ...``; of a number that comes twice the later line counts."""
    who = r"[^:\n]+" if any_speaker else "User"
    pattern = rf"^\[([^,\]]+),[^\]]*\]\s*([0-9]+)\.{who}:"
    lines = F.filter(F.split(F.coalesce(x, F.lit("")), "\n"), lambda s: s.rlike(pattern))
    pairs = F.transform(lines, lambda s: F.struct(F.regexp_extract(s, pattern, 2).cast("int").alias("source_id"), clean(F.regexp_extract(s, pattern, 1)).alias("time")))
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["source_id"] == p["source_id"]))


def build_prompt(template: Column, dialogue: Column, n: Column, overlap: Column, rule: str) -> Column:
    """Placeholders of a template filled; the overlap rule stands only where there is an overlap."""
    note = F.when(overlap > 0, F.replace(F.replace(F.lit(rule), F.lit("{N}"), overlap.cast("string")), F.lit("{NEXT}"), (overlap + 1).cast("string"))).otherwise(F.lit(""))
    return F.replace(F.replace(F.replace(template, F.lit("{DIALOGUE}"), dialogue), F.lit("{COUNT}"), n.cast("string")), F.lit("{OVERLAP_RULE}"), note)
