"""Queries of the retrieval routes, time predicates and fusion, over documents as memories and benchmark items as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.functions.text import normalize_content, token_set
from recallforge.operators import retrieve as R
from recallforge.plans.fixtures import SQL_MEM, SQL_MESSAGES, SQL_Q, SQL_TC, SQL_VECTORS, TC_MEETS, anchor_vectors, bank, bank_index, queries, text_vectors, vector_queries, vectors
from recallforge.sources.shared import side, stash

K = 15


def _r(c="score"):
    return F.round(c, 9).alias(c)


def bm25_index_stats(spark, d):
    """From the stored index: a row of postings is a term in a shard."""
    x = bank_index(spark, d)
    terms = x.frequency.groupBy("bank").agg(F.count(F.lit(1)).alias("terms"))
    sizes = x.postings.groupBy("bank").agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, v: s + v)).alias("tokens"), F.max(F.array_max("tops")).alias("max_tf"))
    return x.stats.join(terms, "bank").join(sizes, "bank").select("bank", "n", F.round("avgdl", 9).alias("avgdl"), "terms", "tokens", "max_tf")


_DOC = "content || ' | ' || reason || case when len(keywords) > 0 then ' | ' || array_to_string(keywords, ' ') else '' end"
_BM = f"""dt as (select bank, record_idx, regexp_extract_all(lower({_DOC}), '[a-z0-9]+') as t from mem),
po as (select bank, record_idx, len(t) as dl, unnest(t) as term from dt),
tf as (select bank, record_idx, dl, term, count(*) as tf from po group by all),
st as (select bank, count(*) as n, avg(len(t)) as avgdl from dt group by 1)"""
BM_STATS = f"with {SQL_MEM}, {_BM} select st.bank, n, round(avgdl, 9) as avgdl, terms, tokens, max_tf from st join (select bank, count(distinct term) as terms, sum(tf)::bigint as tokens, max(tf) as max_tf from tf group by 1) using (bank)"
_SCORES = f"""{_BM}, qt as (select query_id, bank, unnest(list_distinct(regexp_extract_all(lower(anchor || ' ' || array_to_string(keywords, ' ')), '[a-z0-9]+'))) as term from q),
df as (select bank, term, count(*) as df from tf group by 1, 2),
sc as (select query_id, tf.bank, record_idx, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / (avgdl + 1e-12)) + 1e-12)) as score
 from tf join df using (bank, term) join st using (bank) join qt using (bank, term) group by 1, 2, 3)"""


def bm25_scores(spark, d):
    return R.bm25_scores(bank(spark, d), queries(spark, d)).select("query_id", "bank", "record_idx", _r())


BM_SCORES = f"with {SQL_MEM}, {SQL_Q}, {_SCORES} select query_id, bank, record_idx, round(score, 9) as score from sc"


def bm25_topk(spark, d):
    return R.search_bm25(bank(spark, d), queries(spark, d), K, index=bank_index(spark, d)).select("query_id", "bank", "record_idx", "rank", _r())


_TOP = "qualify row_number() over (partition by query_id, bank order by score desc, record_idx) <= {k}"
_RANK = "row_number() over (partition by query_id, bank order by score desc, record_idx)::int as rank"
_BM_ALL = "bm as (select q.query_id, mem.bank, mem.record_idx, round(coalesce(score, 0), 9) as score from mem join q using (bank) left join sc on sc.query_id = q.query_id and sc.bank = mem.bank and sc.record_idx = mem.record_idx)"
BM_TOPK = f"with {SQL_MEM}, {SQL_Q}, {_SCORES}, {_BM_ALL} select query_id, bank, record_idx, {_RANK}, score from bm {_TOP.format(k=K)}"


def cosine_similarity(spark, d):
    return R.cosines(vectors(spark, d), vector_queries(spark, d)).select("query_id", "record_idx", _r("similarity"))


_V = "v as (select label::varchar as bank, vec_id as record_idx, embedding::double[] as e from embeddings)"
COSINE = f"with {_V} select a.record_idx as query_id, b.record_idx, round(list_cosine_similarity(a.e, b.e), 9) as similarity from v a join v b using (bank) where a.record_idx % 50 = 0"


def dense_topk(spark, d):
    return R.search_dense(vectors(spark, d), vector_queries(spark, d), 10).select("query_id", "record_idx", "rank", _r())


def dense_dot_topk(spark, d):
    return R.search_dense(vectors(spark, d), vector_queries(spark, d), 40, unit=True).select("query_id", "record_idx", "rank", _r())


def _dense_sql(f, k):
    return f"with {_V}, s as (select a.record_idx as query_id, a.bank, b.record_idx, round({f}(a.e, b.e), 9) as score from v a join v b using (bank) where a.record_idx % 50 = 0) select query_id, record_idx, {_RANK}, score from s {_TOP.format(k=k)}"


def _counts(spark, d):
    full = bank(spark, d).select("bank", "record_idx", R.full_text().alias("full"))
    q = queries(spark, d).withColumn("wanted", token_set(F.array_join("keywords", " ")))
    return R.part_counts(full, q, {"phrase": F.transform("keywords", F.lower)}, {"token": F.col("wanted")}).join(q.select("query_id", "bank", F.size("keywords").alias("phrases"), F.size("wanted").alias("tokens")), ["query_id", "bank"])


def keyword_phrase_score(spark, d):
    return _counts(spark, d).where("n_phrase > 0").select("query_id", "bank", "record_idx", F.round(F.col("n_phrase") / F.col("phrases"), 9).alias("score"))


def keyword_token_overlap(spark, d):
    return _counts(spark, d).where("n_token > 0").select("query_id", "bank", "record_idx", F.round(F.col("n_token") / F.col("tokens"), 9).alias("score"))


def answer_field_score(spark, d):
    """Six fields in turn, one blank and one not known."""
    q = queries(spark, d)
    field = F.element_at(F.array(*[F.lit(x) for x in (" ", "location", "Reason", "keywords", "time", "other")]), (F.col("query_id") % 6 + 1).cast("int"))
    return R.answer_field_score(bank(spark, d), q.select("query_id", "bank", field.alias("answer_field")))


FIELD = f"with {SQL_MEM}, {SQL_Q} select query_id, bank, record_idx, case query_id % 6 when 0 then (trim(content) <> '')::int when 2 then (trim(coalesce(reason, '')) <> '')::int when 3 then (len(mem.keywords) > 0)::int when 4 then (source_time is not null)::int else 0 end::double as score from mem join q using (bank)"


def dense_text_topk(spark, d):
    return R.search_dense(text_vectors(spark, d), anchor_vectors(spark, d), K).select("query_id", "bank", "record_idx", "rank", _r())


DENSE_TEXT = f"with {SQL_MEM}, {SQL_Q}, {SQL_VECTORS} select query_id, bank, record_idx, {_RANK}, score from ds {_TOP.format(k=K)}"


_FULL = "lower(array_to_string(list_filter([trim(content), array_to_string(keywords, ' '), reason, array_to_string(keywords, ' ')], lambda s: s <> ''), ' | '))"
_PARTS = f"""mf as (select *, {_FULL} as ftext from mem), mt as (select *, list_distinct(regexp_extract_all(ftext, '[a-z0-9]+')) as have from mf),
qw as (select *, list_distinct(regexp_extract_all(array_to_string(keywords, ' '), '[a-z0-9]+')) as wanted, list_distinct(regexp_extract_all(lower(anchor), '[a-z0-9]+')) as aw from q),
x as (select qw.query_id, mt.bank, record_idx, memory_type, source_time, ftext, have, types, qw.location, qw.keywords as kw, wanted, aw, qw.time,
 case when len(qw.keywords) > 0 then len(list_filter(qw.keywords, lambda k: contains(ftext, k)))::double / len(qw.keywords) else 0 end as phrase,
 case when len(wanted) > 0 then len(list_intersect(wanted, have))::double / len(wanted) else 0 end as token from mt join qw using (bank))"""
PHRASE = f"with {SQL_MEM}, {SQL_Q}, {_PARTS} select query_id, bank, record_idx, round(phrase, 9) as score from x where phrase > 0"
TOKEN = f"with {SQL_MEM}, {SQL_Q}, {_PARTS} select query_id, bank, record_idx, round(token, 9) as score from x where token > 0"
_STRUCT = f"""{SQL_TC}, {_PARTS}, y as (select x.*, op is not null as timed, case when op is not null and ({TC_MEETS}) then 1.0::double else 0 end as tm,
 case when len(types) > 0 and list_contains(types, memory_type) then 1.0::double else 0 end as ty, case when location <> '' and contains(ftext, lower(location)) then 1.0::double else 0 end as lc from x left join tc using (query_id, bank)),
sx as (select query_id, bank, record_idx, ty, tm, lc, phrase, token, coalesce((0.15::double * ty + 0.3::double * tm + 0.2::double * lc + 0.15::double * phrase + 0.15::double * token) / nullif(
 case when len(types) > 0 then 0.15::double else 0 end + case when timed then 0.3::double else 0 end + case when location <> '' then 0.2::double else 0 end + case when len(kw) > 0 then 0.15::double else 0 end + case when len(wanted) > 0 then 0.15::double else 0 end, 0), 0) as raw from y),
ss as (select query_id, bank, record_idx, ty, tm, lc, phrase, token, round(raw, 9) as score from sx)"""


def structured_score(spark, d):
    return R.structured_scores(bank(spark, d), queries(spark, d)).select("query_id", "bank", "record_idx", "type_score", "time_score", "location_score", "phrase_score", "token_score", _r()).where("score > 0")


STRUCT = f"with {SQL_MEM}, {SQL_Q}, {_STRUCT} select query_id, bank, record_idx, ty as type_score, tm as time_score, lc as location_score, round(phrase, 9) as phrase_score, round(token, 9) as token_score, score from ss where score > 0"


def structured_topk(spark, d):
    return R.search_structured(bank(spark, d), queries(spark, d), K).select("query_id", "bank", "record_idx", "rank", _r())


STRUCT_TOPK = f"with {SQL_MEM}, {SQL_Q}, {_STRUCT} select query_id, bank, record_idx, {_RANK}, score from ss {_TOP.format(k=K)}"
_LEXFULL = "lower(array_to_string(list_filter([trim(content), array_to_string(keywords, ' '), strftime(source_time, '%Y-%m-%dT%H:%M:%S'), reason], lambda s: s <> ''), ' | '))"
_LEX = f"""lf as (select *, {_LEXFULL} as ftext from mem), lt as (select *, list_distinct(regexp_extract_all(ftext, '[a-z0-9]+')) as have from lf),
lq as (select *, list_distinct(regexp_extract_all(array_to_string(keywords, ' '), '[a-z0-9]+')) as wanted, list_distinct(regexp_extract_all(lower(anchor), '[a-z0-9]+')) as aw from q),
ls as (select lq.query_id, lt.bank, record_idx, round(0.15::double * list_contains(types, memory_type)::int + 0.2::double * (lq.time <> '' and contains(ftext, lower(lq.time)))::int + 0.1::double * (location <> '' and contains(ftext, lower(location)))::int
 + 0.2::double * case when len(lq.keywords) > 0 then len(list_filter(lq.keywords, lambda k: contains(ftext, k)))::double / len(lq.keywords) else 0 end
 + 0.15::double * case when len(wanted) > 0 then len(list_intersect(wanted, have))::double / len(wanted) else 0 end + 0.2::double * case when len(aw) > 0 then len(list_intersect(aw, have))::double / len(aw) else 0 end, 9) as score from lt join lq using (bank))"""


def structured_lexical_score(spark, d):
    return R.lexical_scores(bank(spark, d), queries(spark, d)).select("query_id", "bank", "record_idx", _r()).where("score > 0")


def structured_lexical_topk(spark, d):
    return R.search_lexical(bank(spark, d), queries(spark, d), 40).select("query_id", "bank", "record_idx", "rank", _r())


LEX_SCORE = f"with {SQL_MEM}, {SQL_Q}, {_LEX} select query_id, bank, record_idx, score from ls where score > 0"
LEX_TOPK = f"with {SQL_MEM}, {SQL_Q}, {_LEX} select query_id, bank, record_idx, {_RANK}, score from ls {_TOP.format(k=40)}"


def time_constraint_match(spark, d):
    return R.time_matches(bank(spark, d), queries(spark, d)).select("query_id", "bank", "record_idx", "score")


def time_constraint_filter(spark, d):
    return R.time_hits(bank(spark, d), queries(spark, d)).groupBy("query_id", "bank").agg(F.count(F.lit(1)).alias("n"), F.min("record_idx").alias("first"), F.max("record_idx").alias("last"))


TC_MATCH = f"with {SQL_MEM}, {SQL_Q}, {SQL_TC} select query_id, bank, record_idx, case when {TC_MEETS} then 1.0::double else 0.0::double end as score from mem join tc using (bank)"
TC_FILTER = f"with {SQL_MEM}, {SQL_Q}, {SQL_TC} select query_id, bank, count(*) as n, min(record_idx) as first, max(record_idx) as last from mem join tc using (bank) where {TC_MEETS} group by 1, 2"


def _routes(spark, d, asked=None, names=("bm25", "structured", "dense")):
    """Ranked lists of the routes ``names`` with their contents, for the queries ``asked`` (default all). The lists are stored and meet the records where these lie: contents are not shuffled."""
    m, q = bank(spark, d), queries(spark, d) if asked is None else asked
    search = {
        "bm25": lambda: R.search_bm25(m, q, K, index=bank_index(spark, d)), "structured": lambda: R.search_structured(m, q, K),
        "dense": lambda: R.search_dense(text_vectors(spark, d), anchor_vectors(spark, d, q), K),
    }
    rows = [search[n]().select("query_id", "bank", F.lit(n).alias("route"), "rank", _r(), "record_idx") for n in names]
    lists = stash(reduce(DataFrame.unionByName, rows), "lists")
    return m.select("bank", "record_idx", "content").join(side(lists), ["bank", "record_idx"])


_ROUTES = f"""{_SCORES}, {_BM_ALL}, {_STRUCT}, {SQL_VECTORS},
rt as (select 'bm25' as route, query_id, bank, record_idx, {_RANK}, score from bm {_TOP.format(k=K)}
 union all select 'structured', query_id, bank, record_idx, {_RANK}, score from ss {_TOP.format(k=K)} union all select 'dense', query_id, bank, record_idx, {_RANK}, score from ds {_TOP.format(k=K)}),
rc as (select rt.*, content from rt join mem using (bank, record_idx))"""


def _fused_columns(x):
    return x.select("query_id", "bank", "position", "record_idx", "method", "method_rank", "score", F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["method"], s["rank"].cast("string"))), ",").alias("sources"))


def _fusion_sql(order, key, where="true", cap=0):
    o = f"list_position({order!r}, route)"
    return f"""with {SQL_MEM}, {SQL_Q}, {_ROUTES}, k as (select *, {o} as ro, {key} as key from rc where list_contains({order!r}, route) and {where}),
f as (select *, row_number() over (partition by query_id, bank, key order by ro, rank) as rn, string_agg(route || ':' || rank, ',' order by ro, rank) over (partition by query_id, bank, key order by ro, rank rows between unbounded preceding and unbounded following) as sources from k),
p as (select *, row_number() over (partition by query_id, bank order by ro, rank)::int as position from f where rn = 1)
select query_id, bank, position, record_idx, route as method, rank as method_rank, score, sources from p {f'where position <= {cap}' if cap else ''}"""


def fusion_content_dedup(spark, d):
    return _fused_columns(R.fuse(_routes(spark, d), ["bm25", "structured", "dense"]))


FUSION = _fusion_sql(["bm25", "structured", "dense"], "lower(trim(content))")


def merge_three_routes(spark, d):
    return _fused_columns(R.fuse(_routes(spark, d), ["structured", "dense", "bm25"], normalize_content(F.col("content")), 20, True))


def merge_two_routes(spark, d):
    return _fused_columns(R.fuse(_routes(spark, d, names=("bm25", "dense")), ["dense", "bm25"], normalize_content(F.col("content")), 0, True))


_NORM = "trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))"
THREE = _fusion_sql(["structured", "dense", "bm25"], _NORM, f"{_NORM} <> ''", 20)
TWO = _fusion_sql(["dense", "bm25"], _NORM, f"{_NORM} <> ''")


def merge_route_counts(spark, d):
    return R.fuse(_routes(spark, d), ["structured", "dense", "bm25"], normalize_content(F.col("content")), 0, True).groupBy("query_id", "bank", "method").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.size("sources")).cast("long").alias("inputs"))


ROUTE_COUNTS = f"select query_id, bank, method, count(*) as kept, sum(len(string_split(sources, ',')))::bigint as inputs from ({_fusion_sql(['structured', 'dense', 'bm25'], _NORM)}) group by all"


def route_dispatch(spark, d):
    """Each query by its mode: five modes in turn."""
    modes = F.element_at(F.array(*[F.lit(x) for x in ("", "rrf", "hybrid_legacy", "raw", "other")]), (F.col("query_id") % 5 + 1).cast("int"))
    q = queries(spark, d).withColumn("route", R.route_of(modes))
    m = bank(spark, d)
    take = lambda r: q.where(F.col("route") == r)
    fused = R.fuse(_routes(spark, d, take("fused")), ["bm25", "structured", "dense"])
    parts = [R.search_bm25(m, take("bm25"), K, index=bank_index(spark, d)).withColumn("route", F.lit("bm25")), R.search_structured(m, take("structured"), K).withColumn("route", F.lit("structured")), R.search_dense(text_vectors(spark, d), anchor_vectors(spark, d, take("dense")), K).withColumn("route", F.lit("dense")), fused.withColumnRenamed("position", "rank").withColumn("route", F.lit("fused"))]
    out = [p.select("query_id", "bank", "route", "rank", "record_idx") for p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


DISPATCH = f"""select query_id, bank, 'fused' as route, position as rank, record_idx from ({FUSION}) where query_id % 5 = 1
union all select * from (with {SQL_MEM}, {SQL_Q}, {_ROUTES} select query_id, bank, route, rank, record_idx from rt where (query_id % 5 in (0, 4) and route = 'structured') or (query_id % 5 = 2 and route = 'dense') or (query_id % 5 = 3 and route = 'bm25'))"""


def format_memories(spark, d):
    m = bank(spark, d).select("bank", "record_idx", "content", "reason", "purpose", F.date_format("source_time", "yyyy-MM-dd'T'HH:mm:ss").alias("source_time"))
    lists = stash(R.search_bm25(bank(spark, d), queries(spark, d), 5, index=bank_index(spark, d)).select("query_id", "bank", "record_idx", "rank"), "lists")
    top = m.join(side(lists), ["bank", "record_idx"])
    every = queries(spark, d).select("query_id", "bank").join(top, ["query_id", "bank"], "left")
    return R.format_memories(every, ["query_id", "bank"]).select("query_id", "bank", F.md5("memories").alias("memories_md5"))


FORMAT = f"""with {SQL_MEM}, {SQL_Q}, {_SCORES}, {_BM_ALL}, r as (select query_id, bank, record_idx, {_RANK}, score from bm {_TOP.format(k=5)}),
b as (select query_id, bank, rank, '[' || rank || ']' || chr(10) || 'time: ' || strftime(source_time, '%Y-%m-%dT%H:%M:%S') || case when content <> '' then chr(10) || 'content: ' || content else '' end || case when reason <> '' then chr(10) || 'reason: ' || reason else '' end as block from r join mem using (bank, record_idx))
select q.query_id, q.bank, md5(coalesce(string_agg(block, chr(10) || chr(10) order by rank), '[No retrieved memories]')) as memories_md5 from q left join b on b.query_id = q.query_id and b.bank = q.bank group by 1, 2"""


def attach_assistant_context(spark, d):
    """Records of a window place, some unknown, with the assistant's reply there."""
    from recallforge.operators import segment as G
    from recallforge.plans.segments import _windows
    from recallforge.plans.fixtures import messages

    index = G.reply_index(_windows(spark, d), G.assistant_replies(messages(spark, d)))
    at = F.regexp_extract("uid", r"w(\d+)u", 1).cast("int")
    boundary = F.concat(at.cast("string"), F.lit("_"), F.format_string("%04d", F.col("source_id")))
    places = index.select("sample", boundary.alias("boundary_id"), at.alias("window_index"), "source_id")
    ranked = index.select("sample", F.when(F.col("global_idx") % 9 == 0, F.concat(boundary, F.lit("x"))).otherwise(boundary).alias("boundary_id"), "global_idx")
    return R.attach_context(ranked, places, index).select("sample", "boundary_id", "global_idx", "uid", "source_id", F.md5("assistant_reply").alias("reply_md5"))


ATTACH = f"""with {SQL_MESSAGES}, n as (select *, lead(role) over w as nr, lead(content) over w as nc from msgs window w as (partition by sample, session_pos order by turn)),
i as (select wn.*, case when n.nr = 'assistant' then trim(n.nc) else '' end as reply from wn join n on n.sample = wn.sample and n.session_pos = wn.session_pos and n.turn = wn.turn)
select sample, window_index || '_' || printf('%04d', pos) || case when global_idx % 9 = 0 then 'x' else '' end as boundary_id, global_idx::int as global_idx, case when global_idx % 9 = 0 then '' else printf('w%04du%02d', window_index, pos) end as uid,
 case when global_idx % 9 = 0 then 0 else pos end::int as source_id, md5(case when global_idx % 9 = 0 then '' else reply end) as reply_md5 from i"""

QUERIES = {
    "bm25_index_stats": (bm25_index_stats, BM_STATS), "bm25_scores": (bm25_scores, BM_SCORES), "bm25_topk": (bm25_topk, BM_TOPK), "cosine_similarity": (cosine_similarity, COSINE), "dense_topk": (dense_topk, _dense_sql("list_cosine_similarity", 10)),
    "dense_dot_topk": (dense_dot_topk, _dense_sql("list_dot_product", 40)), "keyword_phrase_score": (keyword_phrase_score, PHRASE), "keyword_token_overlap": (keyword_token_overlap, TOKEN), "structured_score": (structured_score, STRUCT),
    "structured_topk": (structured_topk, STRUCT_TOPK), "structured_lexical_score": (structured_lexical_score, LEX_SCORE), "structured_lexical_topk": (structured_lexical_topk, LEX_TOPK), "time_constraint_match": (time_constraint_match, TC_MATCH),
    "time_constraint_filter": (time_constraint_filter, TC_FILTER), "fusion_content_dedup": (fusion_content_dedup, FUSION), "merge_three_routes": (merge_three_routes, THREE), "merge_two_routes": (merge_two_routes, TWO),
    "answer_field_score": (answer_field_score, FIELD), "dense_text_topk": (dense_text_topk, DENSE_TEXT), "merge_route_counts": (merge_route_counts, ROUTE_COUNTS), "route_dispatch": (route_dispatch, DISPATCH), "format_memories": (format_memories, FORMAT), "attach_assistant_context": (attach_assistant_context, ATTACH),
}
