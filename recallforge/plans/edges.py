"""Queries of sources, discovery, times, chat answers and dimension-aware upkeep, over whole tables of the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from recallforge.functions import parsing as P
from recallforge.functions.text import iso, memory_type, slugify, unique_strings
from recallforge.operators import segment as G
from recallforge.operators import upkeep as U
from recallforge.plans import prompts
from recallforge.plans.fixtures import SQL_MEM, SQL_MESSAGES, memories, messages, quote, table
from recallforge.plans.upkeep import _DEC, _AFTER, _decisions
from recallforge.ports import EchoChat, TokenCountEmbedder, chat, embed
from recallforge.sources import discover as D
from recallforge.sources import jsonio as J
from recallforge.sources.shared import new_folder


def scratch(spark: SparkSession) -> str:
    """A new folder of this application, deleted at its exit."""
    return new_folder(spark)


#: Ids whose documents share a memory file.
IDS_A_FILE = 5_000


def load_records(spark, d):
    """Documents written as memory files and read back: banks ``de`` and ``en`` have files of their own and a window that must not count, the others have windows only. A file holds the documents of ``IDS_A_FILE`` ids."""
    root = scratch(spark)
    docs = table(spark, d, "documents").withColumn("w", F.col("doc_id") % 3)
    entry = F.struct(F.col("doc_id").alias("order"), F.col("doc_id").cast("string").alias("source_id"), F.when(F.col("doc_id") % 5 != 0, F.lit("2024-02-03T04:05:06")).alias("source_time"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, F.col("w").cast("string")).alias("window_index"), F.struct(F.when(F.col("doc_id") % 4 == 0, F.lit("fact")).alias("memory_type"), F.col("source").alias("reason")).alias("dimension"))
    chunk = F.floor(F.col("doc_id") / IDS_A_FILE).alias("chunk")
    sorted_list = lambda by: docs.groupBy(*by, chunk).agg(F.sort_array(F.collect_list(entry)).alias("memories"))
    # Names of files follow the order of ranges, then of rows.
    in_order = lambda df, by: df.repartitionByRange(64, *by, "chunk").sortWithinPartitions(*by, "chunk").drop("chunk").write.option("maxRecordsPerFile", 1)
    files = sorted_list(["lang", "w"]).withColumn("window", F.concat(F.lit("window_"), F.col("w").cast("string")))
    in_order(files.drop("w").withColumnRenamed("lang", "bank"), ["bank", "window"]).partitionBy("bank", "window").json(f"{root}/all")
    in_order(sorted_list(["lang"]).where("lang in ('de', 'en')").withColumnRenamed("lang", "bank"), ["bank"]).mode("append").partitionBy("bank").json(f"{root}/all")
    got = J.read_memories(spark, f"{root}/all")
    return got.select(F.regexp_replace("bank", "^bank=", "").alias("bank"), "record_idx", F.regexp_replace("boundary_id", "^window=", "").alias("boundary_id"), F.md5("content").alias("content_md5"), "memory_type", "reason", F.col("source_time").isNotNull().alias("timed"), "source_id")


LOAD = """with d as (select *, doc_id % 3 as w, lang in ('de', 'en') as own from documents),
n as (select *, row_number() over (partition by lang, case when own then 0 else w end order by doc_id) - 1 as pos, row_number() over (partition by lang order by case when own then 0 else w end, doc_id) - 1 as idx from d)
select lang as bank, idx::int as record_idx, case when doc_id % 2 = 0 then w::varchar when own then 'all_memories' else 'window_' || w end || '_' || printf('%04d', pos) as boundary_id, md5(trim(text)) as content_md5,
 case when doc_id % 4 = 0 then 'fact' else 'other' end as memory_type, source as reason, doc_id % 5 <> 0 as timed, doc_id::varchar as source_id from n"""


def _paths(spark, d):
    """Paths of a run, made from documents: summaries two and one folder deep, windows, replies, parsed queries."""
    x = table(spark, d, "documents")
    name = F.element_at(F.array(*[F.lit(n) for n in ("summary.json", "window_0003.json", "window_0003_assistant_replies.json", "parsed.json", "s/out.json")]), (F.col("doc_id") % 5 + 1).cast("int"))
    inner = F.when(F.col("doc_id") % 15 == 0, F.lit("")).otherwise(F.concat(F.lit("r"), (F.col("doc_id") % 40).cast("string"), F.lit("/")))
    return x.select(F.concat("lang", F.lit("/"), inner, name).alias("path"))


_PATHS = "p as (select lang || '/' || case when doc_id % 15 = 0 then '' else 'r' || (doc_id % 40) || '/' end || ['summary.json', 'window_0003.json', 'window_0003_assistant_replies.json', 'parsed.json', 's/out.json'][doc_id % 5 + 1] as path from documents), q as (select path, string_split(path, '/') as a from p)"


def record_dirs(spark, d):
    kinds = [D.record_dirs(_paths(spark, d), k).select(F.lit(k).alias("kind"), "record", "conv") for k in ("also", "if_none", "never")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


DIRS = f"""with {_PATHS}, s as (select distinct len(a) as n, array_to_string(a[1:len(a) - 1], '/') as record, a[1] as conv from q where a[-1] = 'summary.json' and len(a) in (2, 3))
select 'also' as kind, record, conv from s union all select 'if_none', record, conv from s where n = (select max(n) from s) union all select 'never', record, conv from s where n = 3"""


def window_paths(spark, d):
    return D.window_paths(_paths(spark, d).distinct())


WPATHS = f"with {_PATHS} select distinct path, array_to_string(a[1:len(a) - 1], '/') as record, 3::int as \"window\" from q where a[-1] = 'window_0003.json'"


def query_items(spark, d):
    return D.query_items(_paths(spark, d).distinct())


ITEMS = f"with {_PATHS} select distinct a[1] as conv, a[2] as sample, path from q where len(a) = 3 and a[3] = 'parsed.json'"


def result_dirs(spark, d):
    return D.result_dirs(_paths(spark, d))


RESULTS = f"with {_PATHS} select distinct a[1] as question_type, a[2] as method, a[3] as sample from q where len(a) > 3"


def question_rows(spark, d):
    """Every document as an array of an object and a bare string."""
    x = table(spark, d, "documents").select("doc_id", F.to_json(F.array(F.to_json(F.struct(F.col("text").alias("question"))), F.col("text"))).alias("text"))
    return D.question_rows(x).select("doc_id", F.col("index").cast("int").alias("index"), F.md5("question").alias("question_md5"))


QROWS = "select doc_id, i::int as index, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as question_md5 from documents, (values (0), (1)) t(i)"


def conversation_groups(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.col("lang"), F.lit(" é/"), F.col("source"))).alias("question_id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("question_type"), F.col("text").alias("question"), F.when(F.col("doc_id") % 7 == 0, F.col("source")).alias("file_type"))
    return D.grouped_questions(x).select("index", "conv", "sample_id", F.md5("question").alias("question_md5"))


GROUPS = """select doc_id as index, case when doc_id % 7 = 0 and source is not null then source when doc_id % 2 = 0 then lang else 'unknown' end as conv,
 printf('%04d', doc_id) || '_' || case when doc_id % 3 <> 0 and source is not null then lang || '_' || source else 'row_' || doc_id end as sample_id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as question_md5 from documents"""


def _items(spark, d):
    """Ten items of conversations as sessions; ids only for the first half of them, each id twice."""
    c = messages(spark, d).groupBy("sample", "session_pos").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    s = c.select("sample", F.struct("session_pos", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("s")).alias("z"))
    one = s.groupBy("sample").agg(F.sort_array(F.collect_list("z")).alias("zs"))
    ids = F.transform(F.slice("zs", F.lit(1), F.ceil(F.size("zs") / 2).cast("int")), lambda z, i: F.concat(F.lit("id"), F.floor(i / 2).cast("string")))
    dates = F.transform("zs", lambda z, i: F.when(i % 4 != 3, F.date_format(F.lit("2023-01-01 10:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), i), "yyyy/MM/dd (EEE) HH:mm")).otherwise("no date"))
    return one.select(F.col("sample").cast("string").alias("question_id"), F.transform("zs", lambda z: z["s"]).alias("haystack_sessions"), ids.alias("haystack_session_ids"), dates.alias("haystack_dates"))


_ITEMS = """ss as (select sample, session_pos, row_number() over (partition by sample order by session_pos) - 1 as i, count(*) over (partition by sample) as n, k from (select conv_id % 10 as sample, conv_id as session_pos, count(*) as k from conversations group by 1, 2)),
si as (select *, case when i < ceil(n / 2.0) then 'id' || (i // 2) end as sid from ss)"""


def session_map_last_wins(spark, d):
    return G.session_map(_items(spark, d)).select("sample", "session", F.size("messages").alias("n"), F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "\n")).alias("text_md5"))


SMAP = f"""with {_ITEMS}, l as (select * from si where sid is not null qualify row_number() over (partition by sample, sid order by i desc) = 1)
select l.sample::varchar as sample, sid as session, min(k)::int as n, md5(string_agg(text, chr(10) order by turn)) as text_md5 from l join conversations c on c.conv_id = l.session_pos group by 1, 2"""


def flatten_nested_histories(spark, d):
    x = G.number_messages(G.flatten_histories(_items(spark, d)))
    return x.select("sample", "session", F.col("global_idx").cast("int"), F.col("local_idx").cast("int"), iso(F.col("ts")).alias("ts"), F.md5("content").alias("content_md5"))


NESTED = f"""with {_ITEMS}, m as (select si.sample, si.i, coalesce(sid, printf('session_%04d', si.i + 1)) as session, timestamp '2023-01-01 10:00:00' + to_hours(si.i) as st, c.turn, c.text from si join conversations c on c.conv_id = si.session_pos where si.i % 4 <> 3 and lower(c.role) = 'user'),
n as (select *, row_number() over (partition by sample, i order by turn) as local_idx, row_number() over (partition by sample order by i, turn) as global_idx from m)
select sample::varchar as sample, session, global_idx::int as global_idx, local_idx::int as local_idx, case when local_idx % 2 = 1 then strftime(st + to_milliseconds(500 * (local_idx - 1)), '%Y-%m-%dT%H:%M:%S') else strftime(st + to_milliseconds(500 * (local_idx - 1)), '%Y-%m-%dT%H:%M:%S.%f') end as ts, md5(text) as content_md5 from n"""


def parse_session_times(spark, d):
    """Order dates as session times (every fifth without its weekday) and event times as spoken ones."""
    o = table(spark, d, "orders").select(F.lit("session").alias("kind"), F.col("o_orderkey").alias("id"), G.session_time(F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy/MM/dd (EEE) HH:mm")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd HH:mm"))).alias("t"))
    spoken = F.concat(F.date_format("ts", "h:mm"), F.lit(" "), F.lower(F.date_format("ts", "a")), F.lit(" on "), F.date_format("ts", "d MMMM, yyyy"))
    e = table(spark, d, "events").select(F.lit("spoken").alias("kind"), F.col("event_id").alias("id"), G.spoken_time(spoken).alias("t"))
    return o.unionByName(e).select("kind", "id", iso(F.col("t")).alias("t"))


TIMES = """select 'session' as kind, o_orderkey as id, case when o_orderkey % 5 <> 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:00') end as t from orders
union all select 'spoken', event_id, strftime(ts, '%Y-%m-%dT%H:%M:00') from events"""


def source_time_formats(spark, d):
    """Event times in four formats in turn, and in one that is none."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "dd.MM.yyyy")
    text = F.element_at(F.array(*[F.date_format("ts", f) for f in forms]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", iso(U.source_time(text)).alias("t"))


SOURCE_TIMES = "select event_id, case event_id % 5 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S') when 2 then strftime(ts, '%Y-%m-%dT%H:%M:00') when 3 then strftime(ts, '%Y-%m-%dT00:00:00') end as t from events"


def windows_not_clamped(spark, d):
    w = G.sliding_windows(G.number_messages(messages(spark, d)), 15, G.overlap_of(15), clamp=False)
    return w.select("sample", "window_index", "pos", "global_idx", "message_count", "overlap_count")


UNCLAMPED = f"with {SQL_MESSAGES} select sample, window_index::int as window_index, pos::int as pos, global_idx::int as global_idx, message_count::int as message_count, case when window_index = 0 then 0 else 3 end::int as overlap_count from wn"


def json_strict(spark, d):
    """Answers round a JSON object: bare, fenced, within prose, after a brace that opens nothing, and none."""
    body = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("source").alias("s")))
    ways = [body, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("Here it is: "), body, F.lit(" done")), F.concat(F.lit("{ not so "), body), F.lit("nothing here")]
    x = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*ways), (F.col("doc_id") % 5 + 1).cast("int")).alias("x"))
    j = P.json_strict(F.col("x"))
    return x.select("doc_id", F.get_json_object(j, "$.id").cast("long").alias("id"), F.get_json_object(j, "$.s").alias("s"))


STRICT = "select doc_id, case when doc_id % 5 < 4 then doc_id end as id, case when doc_id % 5 < 4 then source end as s from documents"


def chat_responses(spark, d):
    """Replies of a chat service made from benchmark items: content and token counts, some without."""
    b = table(spark, d, "benchmark")
    reply = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"), F.when(F.col("item_id") % 3 != 0, F.struct(F.length("text").alias("prompt_tokens"), F.lit(7).alias("completion_tokens"), (F.length("text") + 7).alias("total_tokens"))).alias("usage")))
    x = b.select("item_id", F.when(F.col("item_id") % 5 != 0, reply).otherwise("{}").alias("r"))
    return x.select("item_id", F.md5(P.message_content(F.col("r"))).alias("content_md5"), P.usage(F.col("r")).alias("u")).select("item_id", "content_md5", "u.*")


RESPONSES = """select item_id, md5(case when item_id % 5 <> 0 then text else '' end) as content_md5, case when item_id % 5 <> 0 and item_id % 3 <> 0 then length(text) else 0 end::int as prompt_tokens,
 case when item_id % 5 <> 0 and item_id % 3 <> 0 then 7 else 0 end::int as completion_tokens, case when item_id % 5 <> 0 and item_id % 3 <> 0 then length(text) + 7 else 0 end::int as total_tokens from benchmark"""


def chat_port(spark, d):
    """Every benchmark item asked of a port that answers by the prompt's length; answers without a label are not accepted."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("prompt"))
    got = chat(b, lambda: EchoChat(lambda p: ("CORRECT" if len(p) % 2 else "WRONG") if len(p) % 3 else "no label"), tries=2, accept=lambda t: t != "no label", pause=lambda a: 0.0)
    return got.select("item_id", "response", "ok", "error", "prompt_key")


PORT = "select item_id, case when length(text) % 3 = 0 then '' when length(text) % 2 = 1 then 'CORRECT' else 'WRONG' end as response, length(text) % 3 <> 0 as ok, case when length(text) % 3 = 0 then 'answer not accepted' else '' end as error, sha256(text) as prompt_key from benchmark"


def embed_unit(spark, d):
    """Length of every unit vector and its first part, in thousandths."""
    x = embed(table(spark, d, "documents").select("doc_id", "text"), TokenCountEmbedder)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return x.select("doc_id", F.round(norm, 3).alias("norm"), F.round(F.col("embedding")[0].cast("double"), 3).alias("first"))


EMBED = """with v as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents), c as (select doc_id, list_transform(range(0, 32), lambda b: len(list_filter(t, lambda x: (7 * len(x) + 3 * ascii(x) + ascii(right(x, 1))) % 32 = b))::double) as c from v),
n as (select doc_id, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) as n from c) select doc_id, case when n > 0 then 1.0 else 0.0 end::double as norm, case when n > 0 then round(c[1] / n, 3) else 0.0 end::double as first from n"""


def answer_prompts(spark, d):
    b = table(spark, d, "benchmark")
    p = prompts.fill(prompts.ANSWER, MEMORIES=F.col("text"), DATE=F.when(F.col("item_id") % 2 == 0, F.lit("2024-05-06")), QUESTION=F.concat(F.lit("What of "), F.col("item_id").cast("string"), F.lit("?")))
    return b.select("item_id", F.md5(p).alias("prompt_md5"))


PROMPTS = f"select item_id, md5(replace(replace(replace({quote(prompts.ANSWER)}, '{{MEMORIES}}', trim(text)), '{{DATE}}', case when item_id % 2 = 0 then '2024-05-06' else '[unknown]' end), '{{QUESTION}}', 'What of ' || item_id || '?')) as prompt_md5 from benchmark"


def newest_files(spark, d):
    x = table(spark, d, "documents").select("lang", (F.col("doc_id") % 3 + F.when(F.col("lang") == "en", 1).otherwise(0)).alias("level"), F.format_string("%s/%08d", F.coalesce("source", F.lit("")), F.col("doc_id")).alias("path"))
    return J.newest(x, ["lang"])


NEWEST = "select lang, (doc_id % 3 + (lang = 'en')::int)::bigint as level, coalesce(source, '') || '/' || printf('%08d', doc_id) as path from documents qualify row_number() over (partition by lang order by level, path desc) = 1"


def replies_last_wins(spark, d):
    m = messages(spark, d).groupBy("sample", "session", "turn").agg(F.max(F.md5("content")).alias("reply"))
    later = m.where("turn % 2 = 0").withColumn("reply", F.concat(F.lit("later "), F.col("reply")))
    return J.last_wins([m, later], ["sample", "session", "turn"])


LAST = "select conv_id % 10 as sample, printf('session_%04d', conv_id) as session, turn, case when turn % 2 = 0 then 'later ' else '' end || max(md5(text)) as reply from conversations group by 1, 2, 3, conv_id"


def questions_limited(spark, d):
    """Turns of a conversation as its questions; two of each that are not of category 1."""
    q = F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("question"), F.lit("").alias("answer"), F.when(F.col("turn") % 4 != 3, F.col("turn") % 4).cast("int").alias("category"))))
    items = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("sample")).agg(F.transform(q, lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer"), x["category"].alias("category"))).alias("qa"))
    return J.questions_of(items, exclude=(1,), per_item=2).select("sample", F.col("pos").cast("int").alias("pos"), F.md5("question").alias("question_md5"), "category")


LIMITED = """with q as (select conv_id as sample, row_number() over (partition by conv_id order by turn, text) - 1 as pos, text, case when turn % 4 <> 3 then turn % 4 end::int as category from conversations)
select sample, pos::int as pos, md5(text) as question_md5, category from q where category is null or category <> 1 qualify row_number() over (partition by sample order by pos) <= 2"""


def banks_by_prefix(spark, d):
    x = table(spark, d, "documents").select(F.concat(F.element_at(F.array(F.lit("MERGE_"), F.lit("README"), F.lit(""), F.lit("x")), (F.col("doc_id") % 4 + 1).cast("int")), F.col("lang")).alias("bank"), "doc_id")
    return J.banks_of(x)


BANKS = "select case when doc_id % 4 = 2 then '' else 'x' end || lang as bank, doc_id from documents where doc_id % 4 >= 2"


def text_functions(spark, d):
    """Slugs, cleaned unique tokens and memory types over whole tables."""
    x = table(spark, d, "pages").select(F.col("page_id").alias("id"), slugify(F.col("url")).alias("slug"), F.array_join(unique_strings(F.split("url", "[/.]"), fold_case=True), "|").alias("parts"), memory_type(F.element_at(F.array(*[F.lit(t) for t in (" Fact", "EPISODIC ", "profile", "else")]), (F.col("page_id") % 4 + 1).cast("int"))).alias("kind"))
    return x


TEXTS = """with p as (select *, regexp_replace(regexp_replace(trim(url), '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') as s, list_filter(regexp_split_to_array(url, '[/.]'), lambda x: trim(x) <> '') as a from pages)
select page_id as id, case when s = '' then 'unknown' else s end as slug, array_to_string(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i), '|') as parts, ['fact', 'episodic', 'profile', ''][page_id % 4 + 1] as kind from p"""


def _with_dimension(spark, d):
    x = _decisions(spark, d)
    text = lambda c, on: F.when(on, F.lit(c)).otherwise("").alias
    even = F.col("ord") % 2 == 0
    parts = F.struct(text("profile", even)("memory_type"), text("2024", ~even)("time"), F.lit(None).cast("string").alias("location"), F.lit("0").alias("reason"), text("to learn", even)("purpose"), F.when(even, F.array(F.lit("new"))).otherwise(F.array().cast("array<string>")).alias("keywords"))
    return x.withColumn("merged_dimension", F.when(F.col("ord") % 3 != 0, parts))


def apply_decisions_dimension(spark, d):
    x = U.apply_dimensions(memories(spark, d), _with_dimension(spark, d))
    return x.select("bank", "seq", "origin", "idx", F.md5("content").alias("content_md5"), "memory_type", "time", "location", "reason", "purpose", F.array_join("keywords", " ").alias("keywords"))


APPLY_DIM = f"""with recursive {SQL_MEM}, {_DEC}, {_AFTER}
select af.bank, seq, origin, af.idx, md5(af.content) as content_md5, case when origin = 'added' and seq % 3 <> 0 and seq % 2 = 0 then 'profile' else memory_type end as memory_type, case when origin = 'added' and seq % 3 <> 0 and seq % 2 = 1 then '2024' else '' end as time, '' as location, reason,
 case when origin = 'added' and seq % 3 <> 0 and seq % 2 = 0 then 'to learn' else '' end as purpose, case when origin = 'added' and seq % 3 <> 0 and seq % 2 = 0 then 'new' else array_to_string(keywords, ' ') end as keywords from af join mem on mem.bank = af.bank and mem.idx = af.idx"""


def update_action_histogram(spark, d):
    return U.action_histogram(_decisions(spark, d).withColumn("total_tokens", F.when(F.col("ord") % 2 == 0, F.col("ord").cast("long"))))


HISTOGRAM = f"with recursive {SQL_MEM}, {_DEC} select case when decision in ('MERGE', 'SUPERSEDE') then decision else 'KEEP_BOTH' end as action, count(*) as n, coalesce(sum(case when ord % 2 = 0 then ord end), 0)::bigint as total_tokens from ds group by 1"

QUERIES = {
    "load_records": (load_records, LOAD), "record_dirs": (record_dirs, DIRS), "window_paths": (window_paths, WPATHS), "query_items": (query_items, ITEMS), "result_dirs": (result_dirs, RESULTS), "question_rows": (question_rows, QROWS),
    "conversation_groups": (conversation_groups, GROUPS), "session_map_last_wins": (session_map_last_wins, SMAP), "flatten_nested_histories": (flatten_nested_histories, NESTED), "parse_session_times": (parse_session_times, TIMES),
    "source_time_formats": (source_time_formats, SOURCE_TIMES), "windows_not_clamped": (windows_not_clamped, UNCLAMPED), "json_strict": (json_strict, STRICT), "chat_responses": (chat_responses, RESPONSES), "chat_port": (chat_port, PORT),
    "embed_unit": (embed_unit, EMBED), "answer_prompts": (answer_prompts, PROMPTS), "newest_files": (newest_files, NEWEST), "replies_last_wins": (replies_last_wins, LAST), "questions_limited": (questions_limited, LIMITED), "banks_by_prefix": (banks_by_prefix, BANKS),
    "text_functions": (text_functions, TEXTS), "apply_decisions_dimension": (apply_decisions_dimension, APPLY_DIM), "update_action_histogram": (update_action_histogram, HISTOGRAM),
}
