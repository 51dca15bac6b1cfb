"""Corpus pipeline: quality, near-duplicates, benchmark passages, mixing, shards.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; ``run`` applies them to the table ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallforge.llm._common import bucket_count, settle, side, stash, stashed, with_rank
from recallforge.llm.decontaminate import decontaminate
from recallforge.llm.mixing import mix_sources
from recallforge.llm.near_dedup import near_duplicates
from recallforge.llm.quality_classifier import classify
from recallforge.llm.sharding import shard_documents


#: Key of a row within a stage: its id or, where that is null, a hash of the row.
KEY = "__row_id"


def _key(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"], F.xxhash64(docs["text"], docs["lang"], docs["source"]))


def _keyed(docs: DataFrame) -> DataFrame:
    """KEY and text alone, so that no other column can clash with KEY."""
    return docs.select(_key(docs).alias(KEY), "text")


def _without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``lost`` (KEY); a small list of them is broadcast, a large one shuffled."""
    ids = side(stash(lost.select(KEY).distinct(), "lost"))
    return docs.join(ids, _key(docs) == ids[KEY], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects. Null and empty texts are scored like others; rows that repeat go or stay together; no rows give no rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias(KEY), "quality")
    return _without(docs, classify(_keyed(docs), labels, key=KEY).where("predicted = 0"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the least id: sets of two-word shingles at 0.8, as the operator's query has them.

    Null and empty texts are in no group and stay; rows that repeat an id stay together.
    """
    return _without(docs, near_duplicates(_keyed(docs), key=KEY, shingle=2, similar=80).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more is benchmark text. Null and empty texts, and all texts of an empty benchmark, stay."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _without(docs, decontaminate(_keyed(docs), bench, key=KEY).where("contaminated"))


def _mix(docs: DataFrame) -> DataFrame:
    """(__id, __at): the place in the mix, found on ids and sources alone, so the same in every stage that has the same rows; rows that repeat an id stand together."""
    slots = mix_sources(docs.select("doc_id", "source")).groupBy(F.col("doc_id").alias("__id")).agg(F.min(F.struct("slot", "place")).alias("__at"))
    return stash(slots, "slots")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix; texts are shuffled once, for the order."""
    mix = side(_mix(docs))
    placed = docs.join(mix, docs["doc_id"].eqNullSafe(mix["__id"]), "left")
    out = placed.orderBy(mix["__at"]["slot"], mix["__at"]["place"]).select(*[docs[c] for c in docs.columns])
    out._ordered = True  # not yet in files of this order
    return out


def _written(docs: DataFrame) -> DataFrame:
    """(__id, __at): the place of a row in the files it was written to, by their names, then its row there; rows that repeat an id take the first one's. What is not read from files is taken in its order."""
    at = [F.col("doc_id").alias("__id"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        rows = (stash(docs.select("doc_id"), "order") if "_ordered" in docs.__dict__ else docs).select(*at)
    except AnalysisException:  # no files
        rows = stash(docs.select("doc_id"), "order").select(*at)
    rows = stash(rows, "written")
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = rows.groupBy("file").agg(F.max("row").alias("n")).select("file", F.coalesce(F.sum(F.col("n") + 1).over(ahead), F.lit(0)).alias("ahead"))
    placed = rows.join(F.broadcast(files), "file").select("__id", F.struct((F.col("ahead") + F.col("row")).alias("slot"), F.lit(0).alias("place")).alias("__at"))
    return stash(placed.groupBy("__id").agg(F.min("__at").alias("__at")), "places")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every document that is left, and its slot there in the order in which the stage before wrote the documents, so of the mix.

    Ranges of that order are the buckets of the ranks.
    """
    mix = _written(docs)
    top = mix.agg(F.max("__at.slot")).first()[0] or 0
    sharded = stash(shard_documents(docs.select("doc_id", "text")), "sharded")
    placed = sharded.join(side(mix), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    buckets = bucket_count(sharded.count())
    part = F.floor(F.col("__at.slot") * buckets / (top + 1))
    order = [F.col("__at.slot"), F.col("__at.place"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return with_rank(placed.drop("slot"), ["shard"], order, "slot", deal=part, buckets=buckets).select(*sharded.columns)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: A trained model and components of links are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = stashed()
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs, name, before)  # what the stage stored on its way goes
    return docs
