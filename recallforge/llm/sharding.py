"""Sharding by balanced label propagation.

Documents that share a hub (here: equal texts) are linked. Every round each hub
votes, by bytes, for the shards its documents are in, and documents move to the
shard with most votes that still has room. Moves into a shard are admitted in an
order that keeps a hub together, up to the shard's quota, so a hub larger than a
shard fills one and goes on in the next. Unlinked documents then fill all shards
up to the same number of bytes: those of a notable part of a shard one by one, the
largest first, and the many small ones by their running sum.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallforge.llm._common import side, stash, with_rank

#: Parts of an admission order: hubs by hash, then parts of a hub.
LEVELS, PARTS = 512, 16
#: Rows of over this part of a shard are placed one by one; there are no more than that many a shard.
LARGE = 256


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), at + 1)


def propagate(linked: DataFrame, quota: int, shards: int, rounds: int) -> DataFrame:
    """Move rows (size, hub, shard) towards the shards of their hubs' rows; no shard takes in more than its quota allows."""
    for turn in range(rounds):
        load = {r["shard"]: r["load"] for r in linked.groupBy("shard").agg(F.sum("size").alias("load")).collect()}  # ``shards`` rows
        room = [max(0, quota - load.get(s, 0)) for s in range(shards)]
        room = [r if r * PARTS >= quota else 0 for r in room]  # a shard with less than a part's room is full, so that what a large hub has left goes on elsewhere
        votes = stash(linked.groupBy("hub", "shard").agg(F.sum("size").alias("votes")), "votes")  # far fewer than rows: broadcast if so few as that is safe, so that a large hub is not one task
        best = votes.where(_pick(room, F.col("shard")) > 0).groupBy("hub").agg(F.max(F.struct("votes", (-F.col("shard")).alias("minus"))).alias("best"))
        gain = (F.col("best.votes") > F.col("votes")) | ((F.col("best.votes") == F.col("votes")) & (-F.col("best.minus") < F.col("shard")))
        moves = linked.join(side(votes), ["hub", "shard"]).join(side(best), "hub", "left")
        moves = moves.withColumn("target", F.when(gain, -F.col("best.minus"))).drop("votes", "best")
        level = F.pmod(F.xxhash64("hub", F.lit(turn)), F.lit(LEVELS)).cast("int")
        moves = stash(moves.withColumn("level", level * PARTS + F.pmod(F.xxhash64("id", "hub"), F.lit(PARTS)).cast("int")), "moves")
        asked = moves.where("target is not null").groupBy("target", "level").agg(F.sum("size").alias("asked"))
        sums = asked.withColumn("sum", F.sum("asked").over(Window.partitionBy("target").orderBy("level")))
        admitted = sums.where(F.col("sum") <= _pick(room, F.col("target"))).select("target", "level", F.lit(True).alias("yes"))
        linked = stash(moves.join(admitted, ["target", "level"], "left").select("id", "size", "crc", "hub", F.when(F.col("yes"), F.col("target")).otherwise(F.col("shard")).alias("shard")), "moved")
        if moves.where("target is not null").limit(1).count() == 0:
            break
    return linked


def level(loads: list[int], more: int) -> int:
    """Least common height up to which ``more`` fills ``loads``; loads beyond it get nothing."""
    under = 0
    for n, load in enumerate(sorted(loads)):
        if n and n * load >= under + more:
            return -(-(under + more) // n)
        under += load
    return -(-(under + more) // len(loads))


def largest_first(rows: list[tuple], sizes: list[int], loads: list[int]) -> list[tuple]:
    """The rows with their shard, each into the one with the least load when it is its turn; ``loads`` are brought up to date."""
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    out = []
    for size, row in sorted(zip(sizes, rows, strict=True), key=lambda x: -x[0]):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
        loads[s] += size
        out.append((*row, s))
    return out


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, rounds: int = 4) -> DataFrame:
    """One row for each row of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: the sums of ``size`` (UTF-8 bytes of the text, none for null, plus
    8) of any two shards differ by no more than a small part of a shard (``LARGE``) unless single documents are larger than a shard. Rows with equal
    texts are linked and share a shard as far as the quotas allow; null texts are
    linked with nothing, empty ones with each other. ``slot`` is gapless from 0 in
    each shard; ``grown_shard`` is null under this law. Rows that repeat and null
    keys are rows like others; an empty table gives an empty one; other columns
    are not read.
    """
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    bare = F.coalesce("text", F.lit(""))
    hub = F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(1), "text"))
    base = stash(own.select("id", (F.octet_length(bare) + 8).cast("long").alias("size"), F.crc32(bare.cast("binary")).alias("crc"), hub.alias("hub"), F.xxhash64("text").alias("other")), "sizes")
    total = base.agg(F.sum("size")).first()[0] or 0
    quota = -(-total // shards)
    groups = base.where("hub is not null").groupBy("hub", "other", "size").count().where("count > 1").drop("count")
    first = F.pmod(F.xxhash64("id", "crc"), F.lit(shards)).cast("int")
    linked = stash(base.join(groups, ["hub", "other", "size"], "left_semi").select("id", "size", "crc", "hub", first.alias("shard")), "linked")
    linked = propagate(linked, quota, shards, rounds)
    # What stands beyond an even share of a shard leaves it again and fills up others, along with the unlinked rows.
    deal = F.xxhash64("hub", F.pmod(F.xxhash64("id"), F.lit(8)))
    placed = stash(with_rank(linked, ["shard"], [F.col("hub"), F.col("id"), F.col("crc")], "ahead", size="size", deal=deal), "placed")
    keep = F.col("ahead") + F.col("size") <= quota
    stay = placed.where(keep).select("id", "size", "crc", "shard")
    load = {r["shard"]: r["load"] for r in stay.groupBy("shard").agg(F.sum("size").alias("load")).collect()}
    single = base.join(groups, ["hub", "other", "size"], "left_anti").select("id", "size", "crc")
    loose = stash(single.unionByName(placed.where(~keep).select("id", "size", "crc")), "loose")
    loads = [load.get(s, 0) for s in range(shards)]
    large = F.col("size") * LARGE > quota
    rows = loose.where(large).orderBy("id", "crc").collect()  # at most shards * LARGE, as their sizes add up to no more than the total
    kind = ", ".join(f"{c} {t}" for c, t in loose.dtypes)
    heavy = docs.sparkSession.createDataFrame(largest_first([tuple(r) for r in rows], [r["size"] for r in rows], loads), f"{kind}, shard int")
    height = level(loads, loose.where(~large).agg(F.sum("size")).first()[0] or 0)
    ends, at = [], 0
    for s in range(shards):
        at += max(0, height - loads[s])
        ends.append(at)
    filled = with_rank(loose.where(~large), [], [F.col("id"), F.col("size"), F.col("crc")], "ahead", size="size")
    middle = F.col("ahead") + F.col("size") / 2
    shard = sum((F.when(middle >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    every = stash(stay.unionByName(heavy).unionByName(filled.select("id", "size", "crc", shard.cast("int").alias("shard"))), "shards")
    out = with_rank(every, ["shard"], [F.col("id"), F.col("crc"), F.col("size")], "slot")
    return out.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of nearly equal bytes, equal texts together as far as the quotas allow."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
