"""Queries of segmentation, compression statistics and extraction, over the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallforge.functions import parsing as P
from recallforge.functions.text import iso
from recallforge.operators import segment as G
from recallforge.sources.shared import numbered
from recallforge.plans.fixtures import ISO_TS, SQL_MESSAGES, messages
from recallforge.plans.scalars import PROMPT, RULE
from recallforge.ports import compress_offline

WINDOW, OVERLAP = 15, 3


def _user(spark, d):
    return G.number_messages(messages(spark, d))


def _windows(spark, d):
    return G.sliding_windows(_user(spark, d), WINDOW, OVERLAP)


def flatten_messages(spark, d):
    return _user(spark, d).select("sample", "session", F.col("global_idx").cast("int"), F.col("local_idx").cast("int"), iso(F.col("ts")).alias("ts"), F.date_format("ts", "EEE").alias("weekday"), "content")


def flatten_turns(spark, d):
    """All roles, sessions by number."""
    return G.number_messages(messages(spark, d), None).select("sample", "session", F.col("global_idx").cast("int"), F.col("local_idx").cast("int"), iso(F.col("ts")).alias("ts"), "speaker", "content")


FLATTEN = f"with {SQL_MESSAGES} select sample, session, global_idx::int as global_idx, local_idx::int as local_idx, {ISO_TS} as ts, strftime(ts, '%a') as weekday, content from um"
TURNS = f"""with {SQL_MESSAGES}, n as (select *, row_number() over (partition by sample, session_pos order by turn) as local_idx, row_number() over (partition by sample order by session_pos, turn) as global_idx from msgs),
t as (select *, session_start + to_milliseconds(500 * (local_idx - 1)) as ts from n) select sample, session, global_idx::int as global_idx, local_idx::int as local_idx, {ISO_TS} as ts, role as speaker, content from t"""


def sliding_windows(spark, d):
    return _windows(spark, d).select("sample", "window_index", "pos", "global_idx", "message_count", "overlap_count")


SLIDING = f"with {SQL_MESSAGES} select sample, window_index::int as window_index, pos::int as pos, global_idx::int as global_idx, message_count::int as message_count, overlap_count::int as overlap_count from wn"


def window_text(spark, d):
    w = G.window_texts(_windows(spark, d))
    return w.select("sample", "window_index", "message_count", "overlap_count", "start_idx", "end_idx", iso(F.col("start_ts")).alias("start_ts"), iso(F.col("end_ts")).alias("end_ts"), F.md5("text").alias("text_md5"))


_TEXT = f"string_agg('[' || {ISO_TS} || ', ' || strftime(ts, '%a') || '] ' || pos || '.User: ' || content, chr(10) order by pos)"
WINDOW_TEXT = f"""with {SQL_MESSAGES}, t as (select sample, window_index, min(message_count)::int as message_count, min(overlap_count)::int as overlap_count, min(global_idx)::int as start_idx, max(global_idx)::int as end_idx, min({ISO_TS}) as start_ts, max({ISO_TS}) as end_ts, md5({_TEXT}) as text_md5 from wn group by 1, 2)
select sample, window_index::int as window_index, message_count, overlap_count, start_idx, end_idx, start_ts, end_ts, text_md5 from t"""


def assistant_reply_lead(spark, d):
    return G.assistant_replies(messages(spark, d)).select("sample", "session", "turn", F.md5("reply").alias("reply_md5"))


LEAD = f"""with {SQL_MESSAGES}, n as (select *, lead(role) over w as nr, lead(content) over w as nc from msgs window w as (partition by sample, session_pos order by turn))
select sample, session, turn, md5(case when nr = 'assistant' then trim(nc) else '' end) as reply_md5 from n where role = 'user'"""


def assistant_reply_index(spark, d):
    x = G.reply_index(_windows(spark, d), G.assistant_replies(messages(spark, d)))
    return x.select("sample", "uid", "source_id", "global_idx", "session", "local_idx", F.md5("reply").alias("reply_md5"))


REPLY_INDEX = f"""with {SQL_MESSAGES}, n as (select *, lead(role) over w as nr, lead(content) over w as nc from msgs window w as (partition by sample, session_pos order by turn))
select wn.sample, printf('w%04du%02d', wn.window_index, wn.pos) as uid, wn.pos::int as source_id, wn.global_idx::int as global_idx, wn.session, wn.local_idx::int as local_idx, md5(case when n.nr = 'assistant' then trim(n.nc) else '' end) as reply_md5
from wn join n on n.sample = wn.sample and n.session_pos = wn.session_pos and n.turn = wn.turn"""


def _compressed(spark, d):
    return G.compression_stats(_windows(spark, d).withColumn("compressed", compress_offline(F.col("content"))))


def compression_window_stats(spark, d):
    return _compressed(spark, d).where(F.col("window_index").isNotNull()).select("sample", "window_index", "messages", "changed", "original_chars", "compressed_chars", F.round("ratio", 9).alias("ratio"))


def compression_record_rollup(spark, d):
    return _compressed(spark, d).where(F.col("window_index").isNull()).select("sample", "windows", "messages", "changed", "original_chars", "compressed_chars", F.round("ratio", 9).alias("ratio"))


_COMP = "array_to_string(list_filter(string_split(content, ' '), lambda w, i: i % 5 <> 0), ' ')"
_CSTATS = f"count(*) as messages, count(*) filter (where content <> {_COMP}) as changed, sum(length(content))::bigint as original_chars, sum(length({_COMP}))::bigint as compressed_chars, round(case when sum(length(content)) = 0 then 1.0::double else sum(length({_COMP}))::double / sum(length(content)) end, 9) as ratio"
COMP_WINDOW = f"with {SQL_MESSAGES} select sample, window_index::int as window_index, {_CSTATS} from wn group by 1, 2"
COMP_RECORD = f"with {SQL_MESSAGES} select sample, count(distinct window_index) as windows, {_CSTATS} from wn group by 1"


def _entries(spark, d):
    """Stand-ins for extracted entries: one for every place, some without content or with a source that is no number."""
    w = _windows(spark, d)
    source = F.when(F.col("global_idx") % 11 == 0, F.lit("x")).otherwise(F.col("pos").cast("string"))
    content = F.when(F.col("global_idx") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" m"), F.col("global_idx").cast("string")))
    return w.select("sample", "window_index", source.alias("source_id"), content.alias("content"))


def normalize_memories(spark, d):
    return G.normalize_memories(_entries(spark, d), _windows(spark, d)).select("sample", "window_index", F.col("source_pos").alias("source_id"), "content", "source_time", "session", F.col("local_idx").cast("int"))


_ENTRIES = "e as (select sample, window_index, pos, case when global_idx % 11 = 0 then 'x' else pos::varchar end as source_id, case when global_idx % 7 = 0 then '' else 'm' || global_idx end as content, ts, session, local_idx from wn)"
NORMALIZE_MEM = f"with {SQL_MESSAGES}, {_ENTRIES} select sample, window_index::int as window_index, pos::int as source_id, content, {ISO_TS} as source_time, session, local_idx::int as local_idx from e where content <> '' and source_id <> 'x'"


def prompt_build(spark, d):
    w = G.window_texts(_windows(spark, d))
    return w.select("sample", "window_index", F.md5(P.build_prompt(F.lit(PROMPT), F.col("text"), F.col("message_count"), F.col("overlap_count"), RULE)).alias("prompt_md5"))


PROMPT_SQL = f"""with {SQL_MESSAGES}, t as (select sample, window_index, min(message_count) as n, min(overlap_count) as o, {_TEXT} as text from wn group by 1, 2)
select sample, window_index::int as window_index, md5('Read ' || n || ' messages.' || case when o > 0 then ' The first ' || o || ' were seen before; begin with ' || (o + 1) || '.' else '' end || chr(10) || text) as prompt_md5 from t"""


def extract_summary(spark, d):
    """By sample: windows that gave entries with content and a source, windows without, and entries."""
    w = _windows(spark, d).select("sample", "window_index").distinct()
    n = G.normalize_memories(_entries(spark, d), _windows(spark, d)).groupBy("sample", "window_index").count()
    return w.join(n, ["sample", "window_index"], "left").groupBy("sample").agg(F.count_if(F.col("count") > 0).alias("ok_count"), F.count_if(F.col("count").isNull()).alias("error_count"), F.coalesce(F.sum("count"), F.lit(0)).alias("memory_count"))


SUMMARY = f"""with {SQL_MESSAGES}, {_ENTRIES}, c as (select sample, window_index, count(*) filter (where global_idx % 7 <> 0 and global_idx % 11 <> 0) as n from wn group by 1, 2)
select sample, count(*) filter (where n > 0) as ok_count, count(*) filter (where n = 0) as error_count, sum(n)::bigint as memory_count from c group by 1"""


def shard_assign(spark, d):
    """Samples dealt over four shards by their place in the sorted list."""
    c = numbered(messages(spark, d).select("session").distinct(), [], ["session"], "n")
    return c.select("session", F.pmod(F.col("n") - 1, F.lit(4)).cast("int").alias("shard"))


SHARD = "select session, ((row_number() over (order by session) - 1) % 4)::int as shard from (select distinct printf('session_%04d', conv_id) as session from conversations)"

QUERIES = {
    "flatten_messages": (flatten_messages, FLATTEN), "flatten_turns": (flatten_turns, TURNS), "sliding_windows": (sliding_windows, SLIDING), "window_text": (window_text, WINDOW_TEXT),
    "assistant_reply_lead": (assistant_reply_lead, LEAD), "assistant_reply_index": (assistant_reply_index, REPLY_INDEX), "compression_window_stats": (compression_window_stats, COMP_WINDOW),
    "compression_record_rollup": (compression_record_rollup, COMP_RECORD), "normalize_memories": (normalize_memories, NORMALIZE_MEM), "prompt_build": (prompt_build, PROMPT_SQL), "extract_summary": (extract_summary, SUMMARY), "shard_assign": (shard_assign, SHARD),
}
