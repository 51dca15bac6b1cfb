"""Line deduplication by distinct-site spread.

A line that stands on many sites is boilerplate. Lines that occur often enough
get a HyperLogLog sketch of their sites, merged by aggregation; where the
estimate is near the threshold, sites are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.llm._common import MAX_BROADCAST_IDS, side, stash

#: Distinct sites from which a line is boilerplate; size of a sketch (its standard error is 1.04 / sqrt(2 ** LG_K)); estimates so near, in standard errors, are counted.
SITES, LG_K, NEAR = 5, 12, 6


def without(line_array: Column, dropped: Column) -> Column:
    """Lines whose numbers (from 0) are not in ``dropped``, joined."""
    numbers = F.array_except(F.transform(line_array, lambda _, i: i), dropped)
    return F.array_join(F.transform(numbers, lambda i: F.get(line_array, i)), "\n")


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(h, g) of the lines of ``lines`` (h, g, site) that stand on at least ``sites`` distinct sites; null sites do not count."""
    often = stash(lines.groupBy("h", "g").count().where(F.col("count") >= sites).drop("count"), "often")
    met = lines.where("site is not null").join(side(often), ["h", "g"])
    sketched = stash(met.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate")), "sketches")
    margin = max(1.0, NEAR * 1.04 / 2 ** (LG_K / 2) * sites)
    near = side(sketched.where(F.abs(F.col("estimate") - sites) <= margin).select("h", "g"))
    exact = lines.where("site is not null").join(near, ["h", "g"]).groupBy("h", "g").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= sites).select("h", "g")
    return sketched.where(F.col("estimate") > sites + margin).select("h", "g").unionByName(exact)


def drop_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES) -> DataFrame:
    """One row for each row of ``docs``: key, text without boilerplate lines, n_lines, n_removed.

    Lines are parted by \\n and compared whole; lines of blanks only are neither
    counted nor removed. Null texts stay null, with no lines; rows that repeat are
    treated each, and count as one site; null sites count as none. An empty table gives an empty
    one; other columns are not read.
    """
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(site).cast("string").alias("site")).withColumn("th", F.xxhash64("text"))
    line = own.where("text is not null").select("id", "th", "site", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    lines = stash(line.select("id", "th", "site", "at", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")), "lines")
    hits = lines.join(side(stash(boilerplate(lines, sites), "boilerplate")), ["h", "g"])
    dropped = stash(hits.groupBy(F.col("id").alias("id2"), F.col("th").alias("th2")).agg(F.collect_set("at").alias("dropped")), "dropped")
    # Texts are not shuffled where the numbers of all dropped lines are few enough to broadcast.
    few = dropped.agg(F.coalesce(F.sum(F.size("dropped") + 2), F.lit(0))).first()[0] <= MAX_BROADCAST_IDS
    met = own.join(F.broadcast(dropped) if few else dropped, F.col("id").eqNullSafe(F.col("id2")) & F.col("th").eqNullSafe(F.col("th2")), "left")
    parts = met.withColumn("lines", F.split("text", "\n", -1))
    full = F.size(F.filter(F.coalesce("lines", F.array().cast("array<string>")), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return parts.select(
        F.col("id").alias(key), F.when(F.col("dropped").isNull(), F.col("text")).otherwise(without(F.col("lines"), F.col("dropped"))).alias(text),
        full.cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op6_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that stand in five or more sources, as counts and the SHA-256 of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = drop_boilerplate(docs.select("doc_id", "text", "source"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = """
with l as (select doc_id, source, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos from documents where text is not null),
f as (select *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') as whole from l),
b as (select line from f where whole group by line having count(distinct source) >= 5),
m as (select f.*, whole and b.line is not null as gone from f left join b using (line)),
a as (select doc_id, count(*) filter (where whole) as n_lines, count(*) filter (where gone) as n_removed, string_agg(line, chr(10) order by pos) filter (where not gone) as kept from m group by doc_id)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents left join a using (doc_id)
"""
