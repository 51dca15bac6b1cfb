"""Queries of bank upkeep, gold lookup and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallforge.operators import judge as J
from recallforge.operators import tiles as T
from recallforge.operators import upkeep as U
from recallforge.plans.fixtures import SQL_MEM, bank, table, vectors
from recallforge.plans.scalars import _NORMQ
from recallforge.sources.shared import numbered, stash


def pairwise_similarity_join(spark, d):
    return T.similar_pairs(vectors(spark, d), 0.3).select("bank", "i", "j", F.round("similarity", 9).alias("similarity"))


_VEC = "v as (select label::varchar as bank, vec_id as idx, embedding::double[] as e from embeddings)"
PAIRWISE = f"with {_VEC} select a.bank, a.idx as i, b.idx as j, round(list_cosine_similarity(a.e, b.e), 9) as similarity from v a join v b on a.bank = b.bank and a.idx < b.idx where list_cosine_similarity(a.e, b.e) >= 0.3"


def pairwise_stats(spark, d):
    v = vectors(spark, d)
    return U.pair_stats(v, T.similar_pairs(v, 0.3))


PAIR_STATS = f"with {_VEC}, h as (select a.bank from v a join v b on a.bank = b.bank and a.idx < b.idx where list_cosine_similarity(a.e, b.e) >= 0.3) select v.bank, count(*) as n, (count(*) * (count(*) - 1) // 2)::bigint as pairs_checked, coalesce(min(hits), 0)::bigint as hits from v left join (select bank, count(*) as hits from h group by 1) using (bank) group by v.bank"


def keyword_jaccard_pairs(spark, d):
    return U.keyword_pairs(bank(spark, d), 0.3, ("bank",)).select("bank", "i", "j", F.round("jaccard", 9).alias("jaccard"))


def _pairs_sql(block, least):
    same = " and ".join(f"a.{c} = b.{c}" for c in block)
    return f"k as (select {', '.join(block)}, idx, keywords as kw, source_time from mem where len(keywords) > 0), jp as (select {', '.join('a.' + c for c in block)}, a.idx as i, b.idx as j, a.source_time as time_i, b.source_time as time_j, len(list_intersect(a.kw, b.kw))::double / len(list_distinct(a.kw || b.kw)) as jaccard from k a join k b on {same} and a.idx < b.idx where len(list_intersect(a.kw, b.kw))::double / len(list_distinct(a.kw || b.kw)) >= {least})"


JACCARD = f"with {SQL_MEM}, {_pairs_sql(['bank'], 0.3)} select bank, i, j, round(jaccard, 9) as jaccard from jp"


def _blocked(spark, d):
    return U.blocked_pairs(bank(spark, d), 0.1, 0.7)


def blocked_conflict_pairs(spark, d):
    return _blocked(spark, d).select("bank", "memory_type", "idx_new", "idx_old", F.round("jaccard", 9).alias("jaccard"), F.round("similarity", 9).alias("similarity"))


_BLOCKED = f"""{_pairs_sql(["bank", "memory_type"], 0.1)}, ids as (select i as idx from jp union select j from jp),
tf as (select idx, t, count(*)::double as f from (select idx, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) as t from mem where idx in (select idx from ids)) group by 1, 2),
nm as (select idx, sqrt(sum(f * f)) as norm from tf group by 1),
dp as (select i, j, sum(a.f * b.f) as d from jp join tf a on a.idx = i join tf b on b.idx = j and b.t = a.t group by 1, 2),
bp as (select jp.*, coalesce(d / (x.norm * y.norm), 0) as similarity from jp left join dp using (i, j) left join nm x on x.idx = i left join nm y on y.idx = j),
bc as (select *, case when time_j > time_i then j else i end as idx_new, case when time_j > time_i then i else j end as idx_old from bp where similarity >= 0.7)"""
BLOCKED = f"with {SQL_MEM}, {_BLOCKED} select bank, memory_type, idx_new, idx_old, round(jaccard, 9) as jaccard, round(similarity, 9) as similarity from bc"


def blocked_conflict_stats(spark, d):
    m = bank(spark, d)
    cand = stash(U.count_cosine(m, U.keyword_pairs(m, 0.1)), "pairs")
    s = cand.groupBy("bank").agg(F.count(F.lit(1)).alias("keyword_candidates"), F.count_if(F.col("similarity") >= 0.7).alias("pairs_to_llm"))
    n = m.groupBy("bank").agg(F.count(F.lit(1)).alias("n"))
    e = cand.select("bank", F.explode(F.array("i", "j")).alias("x")).groupBy("bank").agg(F.count_distinct("x").alias("embedding_count"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return n.join(s, "bank", "left").join(e, "bank", "left").select("bank", "n", z("keyword_candidates"), z("embedding_count"), z("pairs_to_llm"), F.lit(0).cast("long").alias("time_filtered"))


BLOCKED_STATS = f"""with {SQL_MEM}, {_BLOCKED} select m.bank, n, coalesce(c, 0)::bigint as keyword_candidates, coalesce(e, 0)::bigint as embedding_count, coalesce(p, 0)::bigint as pairs_to_llm, 0::bigint as time_filtered
from (select bank, count(*) as n from mem group by 1) m left join (select bank, count(*) as c, count(*) filter (where similarity >= 0.7) as p from bp group by 1) using (bank)
left join (select bank, count(distinct x) as e from (select bank, i as x from bp union all select bank, j from bp) group by 1) using (bank)"""


def time_order_pairs(spark, d):
    """Neighbouring records of a bank, every fifth without a time."""
    m = bank(spark, d).select("bank", "idx", F.when(F.col("idx") % 5 != 0, F.col("source_time")).alias("t"))
    w = Window.partitionBy("bank").orderBy("idx")
    p = m.select("bank", F.col("idx").alias("i"), F.col("t").alias("time_i"), F.lead("idx").over(w).alias("j"), F.lead("t").over(w).alias("time_j")).where("j is not null")
    return U.order_pairs(p).select("bank", "i", "j", "idx_new", "idx_old")


TIME_ORDER = f"""with {SQL_MEM}, m as (select bank, idx, case when idx % 5 <> 0 then source_time end as t from mem), p as (select bank, idx as i, t as ti, lead(idx) over w as j, lead(t) over w as tj from m window w as (partition by bank order by idx))
select bank, i, j, case when tj > ti then j else i end as idx_new, case when tj > ti then i else j end as idx_old from p where j is not null"""


def _decisions(spark, d):
    """Stored decisions over keyword pairs: an action by the sum of the two ids, some of them unknown, some merges with a text."""
    p = stash(U.keyword_pairs(bank(spark, d), 0.3, ("bank",)).select("bank", F.col("j").alias("idx_new"), F.col("i").alias("idx_old")), "pairs")
    s = F.col("idx_new") + F.col("idx_old")
    action = F.element_at(F.array(*[F.lit(x) for x in ("MERGE", "SUPERSEDE", "KEEP_BOTH", "MERGE", "OTHER")]), (s % 5 + 1).cast("int"))
    text = F.when(s % 2 == 0, F.concat(F.lit("merged "), F.col("idx_new").cast("string"), F.lit("+"), F.col("idx_old").cast("string"))).otherwise(F.lit(""))
    return numbered(p, ["bank"], ["idx_new", "idx_old"], "ord").select("*", action.alias("decision"), text.alias("merged_content"))  # its rows are stored already


_DEC = f"""{_pairs_sql(["bank"], 0.3)}, ds as (select bank, j as idx_new, i as idx_old, row_number() over (partition by bank order by j, i) as ord, ['MERGE', 'SUPERSEDE', 'KEEP_BOTH', 'MERGE', 'OTHER'][(i + j) % 5 + 1] as decision, case when (i + j) % 2 = 0 then 'merged ' || j || '+' || i else '' end as merged_content from jp),
fold as (select bank, 0::bigint as ord, []::bigint[] as gone, false as done from (select distinct bank from ds)
 union all select ds.bank, ds.ord, case when decision in ('MERGE', 'SUPERSEDE') and not list_contains(gone, idx_new) and not list_contains(gone, idx_old) then list_concat(gone, [idx_new, idx_old]) else gone end,
 decision in ('MERGE', 'SUPERSEDE') and not list_contains(gone, idx_new) and not list_contains(gone, idx_old) from fold join ds on ds.bank = fold.bank and ds.ord = fold.ord + 1),
acted as (select ds.* from ds join fold using (bank, ord) where done)"""
_AFTER = "af as (select bank, idx as seq, 'kept' as origin, idx, content from mem where not exists (select 1 from acted where acted.bank = mem.bank and (mem.idx = idx_new or mem.idx = idx_old)) union all select bank, ord, 'added', idx_new, case when merged_content <> '' then merged_content else content end from acted join mem using (bank) where mem.idx = idx_new)"


def apply_decisions(spark, d):
    return U.apply_decisions(bank(spark, d), _decisions(spark, d)).select("bank", "seq", "origin", "idx", F.md5("content").alias("content_md5"))


APPLY = f"with recursive {SQL_MEM}, {_DEC}, {_AFTER} select bank, seq, origin, idx, md5(content) as content_md5 from af"


def apply_decision_stats(spark, d):
    return U.decision_stats(_decisions(spark, d))


APPLY_STATS = f"with recursive {SQL_MEM}, {_DEC} select bank, count(*) as decisions, count(*) filter (where done and decision = 'MERGE') as merged, count(*) filter (where done and decision = 'SUPERSEDE') as superseded, count(*) filter (where not done) as keep_both from ds join fold using (bank, ord) group by 1"


def update_report(spark, d):
    m = bank(spark, d)
    return U.update_report(m, U.apply_decisions(m, _decisions(spark, d)))


_TOKENS = "greatest(len(list_filter(regexp_split_to_array(coalesce(content, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')), length(coalesce(content, '')) // 3)"
REPORT = f"""with recursive {SQL_MEM}, {_DEC}, {_AFTER}, b as (select count(*) as memories_before, sum({_TOKENS})::bigint as tokens_before from mem where bank in (select bank from mem group by 1 having count(*) > 1)),
a as (select count(*) as memories_after, sum({_TOKENS})::bigint as tokens_after from af where bank in (select bank from mem group by 1 having count(*) > 1))
select *, memories_before - memories_after as reduced, round(100.0::double * (memories_before - memories_after) / greatest(1, memories_before), 2) as compression_rate from b, a"""


def gold_join(spark, d):
    """Questions are the texts of documents, varied in quotes and blanks; every seventh has gold for another question only."""
    q = table(spark, d, "documents").select(F.col("lang").alias("conv"), F.col("doc_id").alias("pos"), F.col("text").alias("question"))
    other = F.when(F.col("pos") % 7 == 0, F.concat(F.lit("other "), "question")).otherwise(F.col("question"))
    gold = q.select("conv", "pos", other.alias("question"), F.concat(F.lit("g"), F.col("pos").cast("string")).alias("gold"))
    asked = q.select("conv", F.col("pos").alias("id"), F.when(F.col("pos") % 2 == 0, F.concat(F.lit('"'), F.replace("question", F.lit(" "), F.lit("  ")), F.lit('" '))).otherwise(F.col("question")).alias("question"))
    return J.gold_join(asked, gold).select("conv", "id", "gold", "status")


GOLD = f"""with q as (select lang as conv, doc_id as pos, text as question from documents), o as (select conv, pos, case when pos % 7 = 0 then 'other ' || question else question end as question from q), g as (select *, 'g' || pos as gold, {_NORMQ.format("question")} as norm from o),
e as (select conv, question, gold from g qualify row_number() over (partition by conv, question order by pos desc) = 1), l as (select conv, norm, gold from g qualify row_number() over (partition by conv, norm order by pos desc) = 1),
a as (select conv, pos as id, case when pos % 2 = 0 then '"' || replace(question, ' ', '  ') || '" ' else question end as question from q)
select a.conv, a.id, coalesce(e.gold, l.gold, '') as gold, case when coalesce(e.gold, l.gold) is null then 'missing_gold' else 'ok' end as status from a left join e on e.conv = a.conv and e.question = a.question left join l on l.conv = a.conv and l.norm = {_NORMQ.format("a.question")}"""


def _judged(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    label = F.when(F.col("quality") == 1, "CORRECT").when(F.col("quality") == 0, "WRONG").otherwise("")
    return j.select("lang", "source", label.alias("label"), F.when(F.col("quality").isNull(), "missing_gold").otherwise("ok").alias("status"), F.coalesce(F.col("toxic").cast("string"), F.lit("UNKNOWN")).alias("category"))


def judge_report_grouping_sets(spark, d):
    return J.accuracy(_judged(spark, d), {"conv": F.col("lang"), "category": F.col("category")})


def judge_accuracy_report(spark, d):
    return J.accuracy(_judged(spark, d), {"question_type": F.col("lang"), "method": F.coalesce("source", F.lit("unknown"))}).drop("missing")


def _report_sql(a, x, b, y, missing=True):
    j = "select lang, source, case quality when 1 then 'CORRECT' when 0 then 'WRONG' else '' end as label, case when quality is null then 'missing_gold' else 'ok' end as status, coalesce(toxic::varchar, 'UNKNOWN') as category from documents left join labels using (doc_id)"
    return f"""with j as ({j}), p as (select *, {x} as a, {y} as b from j), g as (select case when grouping(a, b) = 3 then 'overall' when grouping(a, b) = 1 then '{a}' else '{b}' end as dimension, case when grouping(a, b) = 3 then '' when grouping(a, b) = 1 then a else b end as value,
count(*) as total, count(*) filter (where label = 'CORRECT') as correct, count(*) filter (where status = 'missing_gold') as missing from p group by grouping sets ((), (a), (b)))
select dimension, value, total, correct{", missing" if missing else ""}, correct * 100.0::double / total as accuracy from g"""


QUERIES = {
    "pairwise_similarity_join": (pairwise_similarity_join, PAIRWISE), "pairwise_stats": (pairwise_stats, PAIR_STATS), "keyword_jaccard_pairs": (keyword_jaccard_pairs, JACCARD), "blocked_conflict_pairs": (blocked_conflict_pairs, BLOCKED),
    "blocked_conflict_stats": (blocked_conflict_stats, BLOCKED_STATS), "time_order_pairs": (time_order_pairs, TIME_ORDER), "apply_decisions": (apply_decisions, APPLY), "apply_decision_stats": (apply_decision_stats, APPLY_STATS), "update_report": (update_report, REPORT),
    "gold_join": (gold_join, GOLD), "judge_report_grouping_sets": (judge_report_grouping_sets, _report_sql("conv", "lang", "category", "category")), "judge_accuracy_report": (judge_accuracy_report, _report_sql("question_type", "lang", "method", "coalesce(source, 'unknown')", False)),
}
