"""Views of the driver's tables as messages, memories and queries, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.functions.text import joined, tokens
from recallforge.operators.index import Index, build_index, open_index
from recallforge.operators.retrieve import record_text
from recallforge.ports import TokenCountEmbedder, embed
from recallforge.sources.shared import once, version_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keywords(text):
    long = F.filter(tokens(text), lambda t: F.length(t) >= 7)
    return F.slice(F.array_sort(F.array_distinct(long)), 1, 8)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as message rows: ten samples, a session each conversation, started an hour after the last."""
    c = table(spark, sf_dir, "conversations")
    start = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"))
    return c.select((F.col("conv_id") % 10).alias("sample"), F.format_string("session_%04d", F.col("conv_id")).alias("session"), F.col("conv_id").alias("session_pos"), start.alias("session_start"), "turn", "role", F.col("role").alias("speaker"), F.col("text").alias("content"))


SQL_MESSAGES = """
msgs as (select conv_id % 10 as sample, printf('session_%04d', conv_id) as session, conv_id as session_pos,
  timestamp '2023-01-01' + to_hours(conv_id) as session_start, turn, role, text as content from conversations),
usr as (select *, row_number() over (partition by sample, session_pos order by turn) as local_idx,
  row_number() over (partition by sample order by session_pos, turn) as global_idx from msgs where lower(role) = 'user'),
um as (select *, session_start + to_milliseconds(500 * (local_idx - 1)) as ts from usr),
wn as (select um.*, k as window_index, global_idx - k * 12 as pos, least(15, n - k * 12) as message_count,
  case when k = 0 then 0 else least(3, least(15, n - k * 12)) end as overlap_count
  from um join (select sample, count(*) as n from um group by 1) using (sample), range(0, 1 + (select count(*) from um)) r(k)
  where k <= case when n <= 15 then 0 else ceil((n - 15) / 12.0) end and global_idx > k * 12 and global_idx <= k * 12 + 15)
"""
_ISO = "case when extract('microsecond' from {0}) % 1000000 = 0 then strftime({0}, '%Y-%m-%dT%H:%M:%S') else strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') end"
ISO_TS = _ISO.format("ts")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as memory records, a bank each language."""
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("fact", "episodic", "profile", "other")]), (F.col("doc_id") % 4 + 1).cast("int"))
    time = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))
    return d.select(
        F.col("lang").alias("bank"), F.col("doc_id").alias("record_idx"), F.col("doc_id").alias("idx"), F.col("text").alias("content"), F.col("source").alias("reason"), F.lit("").alias("purpose"),
        F.lit("").alias("location"), F.lit("").alias("time"), kind.alias("memory_type"), _keywords(F.col("text")).alias("keywords"), time.alias("source_time"),
    )


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``memories``, stored at first use as an extraction run stores its records; later queries read it column by column."""
    path = once(spark, "bank", version_of(spark, f"{sf_dir}/documents.parquet"), lambda to: memories(spark, sf_dir).write.parquet(to))
    return spark.read.parquet(path)


def bank_index(spark: SparkSession, sf_dir: str) -> Index:
    """The inverted index of the records' texts, built at first use and shared by all queries of the application."""
    path = once(spark, "bm25", version_of(spark, f"{sf_dir}/documents.parquet"), lambda to: build_index(bank(spark, sf_dir), record_text(), to))
    return open_index(spark, path)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` as queries, each for every bank."""
    b = table(spark, sf_dir, "benchmark")
    times = ("", "on 2024-01-05", "before 2024-01-03", "after 2024-01-20", "around 2024-01", "between 2024-01-02 and 2024-01-04")
    types = F.when(F.col("item_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("item_id") % 3 == 1, F.array(F.lit("fact"))).otherwise(F.array(F.lit("episodic"), F.lit("profile")))
    time = F.element_at(F.array(*[F.lit(t) for t in times]), (F.col("item_id") % 6 + 1).cast("int"))
    place = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Src"), (F.col("item_id") % 20).cast("string"))).otherwise(F.lit(""))
    return b.select(F.col("item_id").alias("query_id"), F.explode(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])).alias("bank"), F.col("text").alias("anchor"), _keywords(F.col("text")).alias("keywords"), time.alias("time"), types.alias("types"), place.alias("location"))


_TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_KW = "list_slice(list_sort(list_distinct(list_filter({0}, lambda x: len(x) >= 7))), 1, 8)"
SQL_MEM = f"""
mem as (select lang as bank, doc_id as record_idx, doc_id as idx, text as content, source as reason,
  ['fact', 'episodic', 'profile', 'other'][doc_id % 4 + 1] as memory_type, {_KW.format(_TOK.format("text"))} as keywords,
  timestamp '2024-01-01' + to_hours(doc_id) as source_time from documents)
"""
SQL_Q = f"""
q as (select item_id as query_id, bank, text as anchor, {_KW.format(_TOK.format("text"))} as keywords,
  ['', 'on 2024-01-05', 'before 2024-01-03', 'after 2024-01-20', 'around 2024-01', 'between 2024-01-02 and 2024-01-04'][item_id % 6 + 1] as time,
  case item_id % 3 when 0 then [] when 1 then ['fact'] else ['episodic', 'profile'] end as types,
  case when item_id % 2 = 0 then 'Src' || (item_id % 20) else '' end as location
  from benchmark, (values ('de'), ('en'), ('es'), ('fr')) t(bank))
"""
# Time constraints of the six query kinds as intervals; null where open.
SQL_TC = """
tc as (select query_id, bank, case query_id % 6 when 1 then 'on' when 2 then 'before' when 3 then 'after' when 4 then 'around' when 5 then 'between' end as op,
  case query_id % 6 when 1 then timestamp '2024-01-05' when 3 then timestamp '2024-01-20 23:59:59.999999' when 4 then timestamp '2024-01-01' - to_days(31) when 5 then timestamp '2024-01-02' end as lo,
  case query_id % 6 when 1 then timestamp '2024-01-05 23:59:59.999999' when 2 then timestamp '2024-01-03' when 4 then timestamp '2024-01-31 23:59:59.999999' + to_days(31) when 5 then timestamp '2024-01-04 23:59:59.999999' end as hi
  from q where query_id % 6 <> 0)
"""
TC_MEETS = "case op when 'before' then source_time < hi when 'after' then source_time > lo else source_time <= hi and source_time >= lo end"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("bank"), F.col("vec_id").alias("record_idx"), F.col("vec_id").alias("idx"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, for its own bank."""
    return vectors(spark, sf_dir).where(F.col("record_idx") % 50 == 0).select(F.col("record_idx").alias("query_id"), "bank", F.col("embedding").alias("vector"))


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a vector of their content, reason and purpose, by the embedding port that SQL can follow; stored at first use."""
    m = bank(spark, sf_dir).select("bank", "record_idx", joined(" ", F.col("content"), F.col("reason"), F.col("purpose")).alias("text"))
    path = once(spark, "vectors", version_of(spark, f"{sf_dir}/documents.parquet"), lambda to: embed(m, TokenCountEmbedder, unit=False).drop("text").write.parquet(to))
    return spark.read.parquet(path)


def anchor_vectors(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """Queries with a vector of their anchor alone."""
    q = (queries(spark, sf_dir) if asked is None else asked).select("query_id", "bank", F.col("anchor").alias("text"))
    return embed(q, TokenCountEmbedder, unit=False).select("query_id", "bank", F.col("embedding").alias("vector"))


_BUCKETS = "list_transform(range(0, 32), lambda b: len(list_filter({0}, lambda t: (7 * len(t) + 3 * ascii(t) + ascii(right(t, 1))) % 32 = b))::double)"
SQL_VECTORS = f"""mv as (select bank, record_idx, {_BUCKETS.format(_TOK.format("content || ' ' || reason"))} as v from mem),
qv as (select query_id, bank, {_BUCKETS.format(_TOK.format("anchor"))} as w from q),
ds as (select query_id, bank, record_idx, round(case when list_sum(v) = 0 or list_sum(w) = 0 then 0 else list_cosine_similarity(v, w) end, 9) as score from mv join qv using (bank))"""


def quote(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


def values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, names)


def sql_values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(quote(v) if v is None or isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(values {body}) t({names})"
