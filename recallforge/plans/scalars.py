"""Queries of the scalar functions over whole tables; where these have no such texts, each document fills one of several forms with all its tokens and with a date made from its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallforge.functions import parsing as P
from recallforge.functions import text as T
from recallforge.functions import timespan as S
from recallforge.plans.fixtures import SQL_MEM, memories, quote, table

WORDS = [(1, "Hello, World! 42 {W}"), (2, "  für {W} Ökologie "), (3, "a__b--c"), (4, "///"), (5, ""), (6, None), (7, "__x__"), (8, "multi-session QA/1"), (9, "tab\tand\nline")]
LISTS = [(1, "A|{W}|a |A|b|{W} "), (2, " |{W}|X|x|x "), (3, ""), (4, "one"), (5, "Ab|aB|cd|CD|cd")]
QUESTIONS = [(1, "What  is \"{W}\" ?"), (2, "'Quoted'  {W} , right !"), (3, "plain"), (4, ""), (5, "A ; B : C ."), (6, "TAB\there ?")]
FRAGMENTS = [(1, '{"a": "{W}"}'), (2, 'Sure: {"a": "{W}"} done'), (3, "no json"), (4, ""), (5, None), (6, '{"a": "{W}"'), (7, 'x {"a": "1"} y {"a": "2"} z'), (8, '  {"a": "w", "b": [1, 2]}  ')]
ANSWERS = [(1, "Reasoning: because {W}\nAnswer: 42 {W}"), (2, "just {W}"), (3, "Answer: a\nanswer: b: c"), (4, "  ANSWER:   spaced  "), (5, ""), (6, "Reasoning: r1\nReasoning: r2"), (7, None)]
THINKING = [(1, "<think>{W}</think>\nAnswer: 7 {W}"), (2, "<think>never closed {W} Answer: 3"), (3, "Answer: plain"), (4, "<think>a</think>free text"), (5, "")]
LABELS = [(1, '{"label": "correct"}'), (2, "{W} The answer is CORRECT. {W}"), (3, "incorrect {W}"), (4, "wrong, then correct"), (5, ""), (6, '{"label": "WRONG"}'), (7, '{"label": "maybe"}'), (8, None), (9, "Label: Correct")]
DECISIONS = [(1, '{"decision": "MERGE"}'), (2, '```json\n{"decision": "supersede"}\n```'), (3, 'I say {"decision": "KEEP_BOTH"} {W}'), (4, "we should merge {W}"), (5, "SUPERSEDE rather than MERGE"), (6, "{W}"), (7, ""), (8, '{"decision": "DELETE"}'), (9, "keep_both")]
SPANS = [(1, "{Y}-{M}-{D}"), (2, "2023-02-{D}"), (3, "{Y}-{M}"), (4, "2024-02"), (5, "{Y}"), (6, "2023-13"), (7, "2023-{M}-{D}T13:22:01"), (8, "{Y}-06-{D}T13:22:01Z"), (9, "2023-06-{D} 13:22"), (10, "{W}"), (11, ""), (12, None), (13, "2023-06-25T13:22:01.5"), (14, "2023-01/2023-02")]
CONSTRAINTS = [(1, "on {Y}-{M}-{D}"), (2, "BEFORE {Y}"), (3, "after {Y}-{M}"), (4, "around 2023-{M}-25"), (5, "between {Y}-{M} and 2023-03-{D}"), (6, "{Y}-02"), (7, "around {Y}"), (8, "on someday"), (9, "between x and 2023"), (10, ""), (11, "around 2023-06-25T10:00:00")]
PARSED = [
    (1, '{"query_anchor": " Trip to {W} ", "need_assistant_context": true, "dimension": {"target_memory_type": ["fact", "Fact", "x"], "time": "on 2023", "location": " Rome ", "keywords": ["Pizza", "{W}", "pizza ", "{W}"]}, "answer_dim": "location"}'),
    (2, '{"query_anchor": "b", "dimension": {"target_memory_type": [], "keywords": []}}'), (3, "{}"), (4, '{"dimension": {"keywords": ["", " a ", "A"]}, "parse_mode": "RRF"}'),
]
DIALOGUES = [(1, "[2023-06-25T13:22:00, Sun] 1.User: {W}\n[2023-06-25T13:23:00, Sun] 2.User: there"), (2, "[2023-01-01T00:00:00, Sun] 1.User: a\n[2023-01-02T00:00:00, Mon] 1.User: b"), (3, "no lines"), (4, ""), (5, "[2023-01-01T00:00:00, Sun] 3.Ann: other")]
PROMPT = "Read {COUNT} messages.{OVERLAP_RULE}\n{DIALOGUE}"
RULE = " The first {N} were seen before; begin with {NEXT}."
QA = [
    (1, '[{"question": "{W}", "answer": "a", "category": 1}, {"question": "q2", "category": 5}, {"question": "q3"}]'), (2, "[]"), (3, '[{"question": "q4", "answer": "7", "category": 2}, {"question": "q5", "category": 5}]'),
]



def _varied(spark, d, forms):
    """(id, x): each document in the form whose place is its id modulo their number; {W} stands for its tokens, {Y}, {M} and {D} for numbers from its id, some of them no months or days."""
    t = table(spark, d, "documents")
    x = F.element_at(F.array(*[F.lit(v).cast("string") for _, v in forms]), (F.col("doc_id") % len(forms) + 1).cast("int"))
    number = lambda n, plus, width: F.lpad((F.col("doc_id") % n + plus).cast("string"), width, "0")
    for name, c in (("{W}", F.array_join(T.tokens(F.col("text")), " ")), ("{Y}", number(40, 1990, 4)), ("{M}", number(14, 0, 2)), ("{D}", number(33, 0, 2))):
        x = F.replace(x, F.lit(name), c)
    return t.select(F.col("doc_id").cast("int").alias("id"), x.alias("x"))


def _varied_sql(forms, name="t"):
    x = f"[{', '.join(quote(v) for _, v in forms)}][doc_id % {len(forms)} + 1]"
    for of, c in (("{W}", "array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ')"), ("{Y}", "(doc_id % 40 + 1990)::varchar"), ("{M}", "lpad((doc_id % 14)::varchar, 2, '0')"), ("{D}", "lpad((doc_id % 33)::varchar, 2, '0')")):
        x = f"replace({x}, '{of}', {c})"
    return f"(select doc_id as id, {x} as x from documents) {name}"


WS = r"'[ \t\n\r\f\x0B]'"
_CLEAN = "trim(coalesce({0}, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_LIT_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def tokenize(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


TOKENIZE = "select doc_id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_distinct, md5(array_to_string(t, ' ')) as tokens_md5 from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as t from documents)"


def slugify(spark, d):
    return _varied(spark, d, WORDS).select("id", T.slugify(F.col("x")).alias("slug"))


SLUGIFY = f"select id::int as id, case when s = '' then 'unknown' else s end as slug from (select id, trim(regexp_replace({_CLEAN.format('x')}, '[^a-zA-Z0-9_-]+', '_', 'g'), '_') as s from {_varied_sql(WORDS)})"


def truncate_text(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.truncate(F.col("text")).alias("t"))
    return t.select("doc_id", F.char_length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


TRUNCATE = """select doc_id, length(t)::bigint as n_chars, md5(t) as text_md5 from (select doc_id, case when length(text) > 8000
 then text[:500] || chr(10) || '...' || chr(10) || text[((length(text) - 200) // 2 + 1)::bigint:((length(text) - 200) // 2 + 200)::bigint] || chr(10) || '...' || chr(10) || text[-300:] else coalesce(text, '') end as t from documents)"""


def unique_strings_ci(spark, d):
    return _varied(spark, d, LISTS).select("id", F.array_join(T.unique_strings(F.split("x", r"\|"), True), "|").alias("folded"), F.array_join(T.unique_strings(F.split("x", r"\|")), "|").alias("exact"))


UNIQUE = f"""with p as (select id, generate_subscripts(string_split(x, '|'), 1) as pos, trim(unnest(string_split(x, '|'))) as s from {_varied_sql(LISTS)}),
k as (select id, pos, s, row_number() over (partition by id, lower(s) order by pos) as rf, row_number() over (partition by id, s order by pos) as re from p where s <> '')
select v.id::int as id, coalesce(string_agg(s, '|' order by pos) filter (where rf = 1), '') as folded, coalesce(string_agg(s, '|' order by pos) filter (where re = 1), '') as exact from {_varied_sql(LISTS, "v")} left join k using (id) group by v.id"""


def approx_token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.approx_tokens(F.col("text")).cast("long").alias("n"))


APPROX = "select doc_id, greatest(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')), length(coalesce(text, '')) // 3)::bigint as n from documents"


def normalize_content(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_content(F.col("text"))).alias("key"))


NORMALIZE = "select doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))) as key from documents"


def normalize_question(spark, d):
    return _varied(spark, d, QUESTIONS).select("id", T.normalize_question(F.col("x")).alias("norm"))


_NORMQ = "trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g')), '[\"''‘’“”`]', '', 'g'), '\\s+([?.!,;:])', '\\1', 'g'))"
NORMQ = f"select id::int as id, {_NORMQ.format('x')} as norm from {_varied_sql(QUESTIONS)}"


def content_key(spark, d):
    m = memories(spark, d)
    return m.select("record_idx", T.content_key(F.col("content"), F.concat_ws("|", "bank", F.col("record_idx").cast("string"))).alias("key"))


CONTENT_KEY = f"with {SQL_MEM} select record_idx, md5(case when c <> '' then c else bank || '|' || record_idx end) as key from (select *, lower({_CLEAN.format('content')}) as c from mem)"


def json_fragment_lenient(spark, d):
    v = _varied(spark, d, FRAGMENTS).withColumn("j", P.json_lenient(F.col("x")))
    return v.select("id", (F.col("j") == "{}").alias("empty"), F.coalesce(F.get_json_object("j", "$.a"), F.lit("")).alias("a"))


FRAGMENT = f"""select id::int as id, j = '{{}}' as empty, coalesce(json_extract_string(j, '$.a'), '') as a from (select id, case when json_valid({_CLEAN.format("x")}) and {_CLEAN.format("x")} <> '' then {_CLEAN.format("x")}
 when json_valid(regexp_extract(x, '(?s)\\{{.*\\}}')) and regexp_extract(x, '(?s)\\{{.*\\}}') <> '' then regexp_extract(x, '(?s)\\{{.*\\}}') else '{{}}' end as j from {_varied_sql(FRAGMENTS)})"""


def parse_answer(spark, d):
    return _varied(spark, d, ANSWERS).withColumn("p", P.parse_answer(F.col("x"))).select("id", "p.answer", "p.reasoning")


def _answer_sql(source: str) -> str:
    last = lambda label: f"trim(regexp_extract(list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '(?i)^\\s*{label}:'))[-1], '^[^:]*:(.*)$', 1))"
    return f"select id::int as id, coalesce({last('answer')}, x) as answer, coalesce({last('reasoning')}, '') as reasoning from ({source})"


ANSWER = _answer_sql(f"select id, {_CLEAN.format('x')} as x from {_varied_sql(ANSWERS)}")


def parse_thinking_answer(spark, d):
    return _varied(spark, d, THINKING).withColumn("p", P.parse_thinking_answer(F.col("x"))).select("id", "p.answer", "p.reasoning")


THINK = _answer_sql(f"select id, {_CLEAN.format('y')} as x from (select id, case when contains(x, '</think>') then regexp_replace(x, '(?s)^.*?</think>', '') when contains(x, '<think>') then '' else x end as y from {_varied_sql(THINKING)})")


def parse_judge_label(spark, d):
    return _varied(spark, d, LABELS).select("id", P.parse_judge_label(F.col("x")).alias("label"))


LABEL = f"""select id::int as id, case when upper(l) in ('CORRECT', 'WRONG') then upper(l) else upper(coalesce(regexp_extract(x, '(?i)\\b(CORRECT|WRONG)\\b', 1), '')) end as label
 from (select id, x, case when json_valid(x) then json_extract_string(x, '$.label') end as l from {_varied_sql(LABELS)})"""


def parse_decision(spark, d):
    return _varied(spark, d, DECISIONS).select("id", P.parse_decision(F.col("x")).alias("decision"))


DECISION = f"""with v as (select id, x, coalesce(case when x <> '' and json_valid(x) then x end, case when x like '%{{%' and json_valid(regexp_extract(x, '(?s)\\{{.*\\}}')) then regexp_extract(x, '(?s)\\{{.*\\}}') end) as j from {_varied_sql(DECISIONS)})
select id::int as id, case when upper(json_extract_string(j, '$.decision')) in ('MERGE', 'SUPERSEDE', 'KEEP_BOTH') then upper(json_extract_string(j, '$.decision'))
 when j is not null then 'KEEP_BOTH' when contains(upper(x), 'MERGE') then 'MERGE' when contains(upper(x), 'SUPERSEDE') then 'SUPERSEDE' else 'KEEP_BOTH' end as decision from v"""


def parse_time_span(spark, d):
    v = _varied(spark, d, SPANS).withColumn("s", S.parse_time_span(F.col("x")))
    return v.select("id", _ts("s.start").alias("span_start"), _ts("s.end").alias("span_end"), "s.granularity")


def _span_sql(c: str) -> tuple[str, str, str]:
    """(start, end, granularity) of a text as SQL."""
    end = lambda t: f"({t} + interval 1 day - interval 1 microsecond)"
    day, month, year = f"try_cast({c} as timestamp)", f"try_cast({c} || '-01' as timestamp)", f"try_cast({c} || '-01-01' as timestamp)"
    stamp = f"try_cast(regexp_replace({c}, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$', '') as timestamp)"
    is_ = lambda p: f"regexp_matches({c}, '{p}')"
    d, m, y, p = is_("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), is_("^[0-9]{4}-(0[1-9]|1[0-2])$"), is_("^[0-9]{4}$"), is_("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$")
    start = f"case when {d} then {day} when {m} then {month} when {y} then {year} when {p} then {stamp} end"
    stop = f"case when {d} then {end(day)} when {m} then {end(f'last_day({month})::timestamp')} when {y} then {end(f'last_day({year} + interval 11 month)::timestamp')} when {p} then {stamp} end"
    grain = f"case when ({start}) is null then null when {d} then 'day' when {m} then 'month' when {y} then 'year' else 'datetime' end"
    return start, stop, grain


_S = _span_sql("x")
SPAN = f"select id::int as id, {_LIT_TS.format(f'({_S[0]})')} as span_start, {_LIT_TS.format(f'({_S[1]})')} as span_end, {_S[2]} as granularity from {_varied_sql(SPANS)}"


def parse_time_constraint(spark, d):
    v = _varied(spark, d, CONSTRAINTS).withColumn("c", S.parse_time_constraint(F.col("x")))
    return v.select("id", "c.op", _ts("c.start").alias("c_start"), _ts("c.end").alias("c_end"), "c.granularity")


_A, _B, _C = _span_sql("a"), _span_sql("b"), _span_sql("c")
CONSTRAINT = f"""with v as (select id, x, regexp_matches(x, '(?i)^between\\s+(.+?)\\s+and\\s+(.+)$') as two, regexp_extract(x, '(?i)^between\\s+(.+?)\\s+and\\s+(.+)$', 1) as a, regexp_extract(x, '(?i)^between\\s+(.+?)\\s+and\\s+(.+)$', 2) as b,
 case when regexp_matches(x, '(?i)^(on|before|after|around)\\s+(.+)$') then lower(regexp_extract(x, '(?i)^(on|before|after|around)\\s+(.+)$', 1)) else 'on' end as o,
 case when regexp_matches(x, '(?i)^(on|before|after|around)\\s+(.+)$') then regexp_extract(x, '(?i)^(on|before|after|around)\\s+(.+)$', 2) else x end as c from {_varied_sql(CONSTRAINTS)}),
s as (select id, two, o, {_A[0]} as a0, {_A[2]} as ag, {_B[1]} as b1, {_B[2]} as bg, {_C[0]} as c0, {_C[1]} as c1, {_C[2]} as cg from v),
r as (select id, case when two then case when a0 is not null and b1 is not null then 'between' end when c0 is not null then o end as op, *, case cg when 'day' then 3 when 'month' then 31 when 'year' then 366 else 1 end as n from s)
select id::int as id, op, {_LIT_TS.format("case when op = 'between' then a0 when op = 'before' then null when op = 'after' then c1 when op = 'around' then c0 - to_days(n::int) when op = 'on' then c0 end")} as c_start,
 {_LIT_TS.format("case when op = 'between' then b1 when op = 'before' then c0 when op = 'after' then null when op = 'around' then c1 + to_days(n::int) when op = 'on' then c1 end")} as c_end,
 case when op = 'between' then case when list_position(['datetime', 'day', 'month', 'year'], ag) >= list_position(['datetime', 'day', 'month', 'year'], bg) then ag else bg end when op is not null then cg end as granularity from r"""


def parsed_query_normalize(spark, d):
    v = _varied(spark, d, PARSED).withColumn("p", P.parsed_query(F.col("x")))
    return v.select("id", "p.anchor", F.array_join("p.types", "|").alias("types"), "p.time", "p.location", F.array_join("p.keywords", "|").alias("keywords"), "p.answer_field", "p.need_context", "p.mode", P.bm25_text(F.col("p")).alias("bm25_text"))


def _ci_sql(path: str) -> str:
    xs = f"list_filter(list_transform(coalesce(json_extract_string(x, '{path}[*]'), []), lambda s: trim(s)), lambda s: s <> '')"
    return f"list_filter({xs}, lambda s, i: list_position(list_transform({xs}, lambda t: lower(t)), lower(s)) = i)"


_GET = "trim(coalesce(json_extract_string(x, '{0}'), ''))"
PARSEDQ = f"""select id::int as id, anchor, types, time, location, keywords, answer_field, need_context, mode, array_to_string(list_filter([anchor, replace(keywords, '|', ' ')], lambda s: s <> ''), ' ') as bm25_text from (
select id, {_GET.format("$.query_anchor")} as anchor, array_to_string(list_filter(list_transform({_ci_sql("$.dimension.target_memory_type")}, lambda t: lower(t)), lambda t: t in ('fact', 'episodic', 'profile')), '|') as types,
 {_GET.format("$.dimension.time")} as time, {_GET.format("$.dimension.location")} as location, array_to_string({_ci_sql("$.dimension.keywords")}, '|') as keywords,
 case when {_GET.format("$.answer_dim")} = '' then 'content' else {_GET.format("$.answer_dim")} end as answer_field, {_GET.format("$.need_assistant_context")} not in ('', 'false') as need_context, lower({_GET.format("$.parse_mode")}) as mode from {_varied_sql(PARSED)})"""


def dialogue_time_index(spark, d):
    v = _varied(spark, d, DIALOGUES).select("id", F.explode(P.dialogue_times(F.col("x"))).alias("p"))
    return v.select("id", "p.source_id", "p.time")


_LINE = "^\\[([^,\\]]+),[^\\]]*\\]\\s*([0-9]+)[.]User:"
DIALOGUE = f"""select id::int as id, source_id, time from (select id, regexp_extract(l, '{_LINE}', 2)::int as source_id, trim(regexp_extract(l, '{_LINE}', 1)) as time, row_number() over (partition by id, regexp_extract(l, '{_LINE}', 2)::int order by pos desc) as rn
 from (select id, unnest(string_split(x, chr(10))) as l, generate_subscripts(string_split(x, chr(10)), 1) as pos from {_varied_sql(DIALOGUES)}) where regexp_matches(l, '{_LINE}')) where rn = 1"""


def qa_category_filter(spark, d):
    v = _varied(spark, d, QA).select("id", F.posexplode(F.from_json("x", "array<struct<question:string,answer:string,category:int>>")).alias("pos", "q"))
    return v.where(F.col("q.category").isNull() | (F.col("q.category") != 5)).select("id", "pos", "q.question", "q.category")


QA_SQL = f"""select id::int as id, pos::int as pos, json_extract_string(q, '$.question') as question, json_extract_string(q, '$.category')::int as category from (select id, unnest(json_extract(x, '$[*]')) as q, unnest(range(0, json_array_length(x)::bigint)) as pos from {_varied_sql(QA)})
 where coalesce(json_extract_string(q, '$.category'), '') <> '5'"""


def resume_anti_join(spark, d):
    """Documents not yet labelled: what a resumed run has left to do."""
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


RESUME = "select doc_id, lang from documents where doc_id not in (select doc_id from labels)"

QUERIES = {
    "tokenize": (tokenize, TOKENIZE), "slugify": (slugify, SLUGIFY), "truncate_text": (truncate_text, TRUNCATE), "unique_strings_ci": (unique_strings_ci, UNIQUE), "approx_token_count": (approx_token_count, APPROX),
    "normalize_content": (normalize_content, NORMALIZE), "normalize_question": (normalize_question, NORMQ), "content_key": (content_key, CONTENT_KEY), "json_fragment_lenient": (json_fragment_lenient, FRAGMENT),
    "parse_answer": (parse_answer, ANSWER), "parse_thinking_answer": (parse_thinking_answer, THINK), "parse_judge_label": (parse_judge_label, LABEL), "parse_decision": (parse_decision, DECISION),
    "parse_time_span": (parse_time_span, SPAN), "parse_time_constraint": (parse_time_constraint, CONSTRAINT), "parsed_query_normalize": (parsed_query_normalize, PARSEDQ),
    "dialogue_time_index": (dialogue_time_index, DIALOGUE), "qa_category_filter": (qa_category_filter, QA_SQL), "resume_anti_join": (resume_anti_join, RESUME),
}
