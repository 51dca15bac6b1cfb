"""Trie of conversation prefixes out of mergeable partial tries.

A prefix of d turns is told by the exclusive or of 128-bit hashes of (place, role,
text), so prefixes of any length come from sums over blocks and a node knows its
parent's key. Conversations are dealt into parts by ranges of their ids; each part
gives a table of its own nodes, and tables of ``FAN`` parts at a time are merged by
node key until one is left. Lists of ends stay in pieces, one a part, and are only
streamed. The rollup goes up the paths: every node belongs to its least member, whose
nodes are the tail of its path; sums run up these tails, and the whole of a
tail is handed to the nodes above it by the same tree of merges.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallforge.llm._common import bucket_count, side, small_batches, stash

#: Partial tries merged into one in a round.
FAN = 64
#: Conversations of one partial trie, so a list of ends in one row has about as many ids.
PART = 1_000
#: Turns of one conversation that are summed in one group.
BLOCK = 128

_PLACED = "conv_id long, part int, at long, a long, b long, size long"
_PLACED_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int64())])


def _place(batches):
    """Number the rows of each conversation within a sorted partition."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        at = []
        for c in batch.column(0).to_pylist():
            n = n + 1 if c == last else 0
            last = c
            at.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64()), *[batch.column(i) for i in (1, 2, 3)]], schema=_PLACED_ARROW)


def ordered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, r, a, b, size): turns numbered from 0 by ``turn`` (null first), two hashes of role and text, UTF-8 bytes of the text.

    Turns of equal ``turn`` are in the order of role, then text; texts are shuffled for these alone.
    Rows are sorted over ranges of (conversation, turn), so a conversation of any length is spread.
    """
    t = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.select("conv_id", "turn", "role", "text", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"), F.octet_length("text").cast("long").alias("size"))
    ties = t.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("c", "t")
    tied = t.join(side(ties), (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left").withColumn("tie", F.when(F.col("c").isNotNull(), F.col("text")))
    order = ["conv_id", F.asc_nulls_first("turn"), "role"]
    dealt = tied.select("conv_id", "turn", "role", "tie", "a", "b", "size").repartitionByRange(*order, F.left("tie", F.lit(32))).sortWithinPartitions(*order, "tie")
    placed = stash(dealt.select("conv_id", "a", "b", "size").mapInArrow(_place, _PLACED), "placed")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.sum("n").over(before)).where("ahead is not null").drop("n")
    return placed.join(side(ahead), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("ahead", F.lit(0))).alias("r"), "a", "b", "size")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with turns of the first of their five: (conversations, turns).

    ``turns`` as of ``ordered_turns``. With h = crc32(decimal id) % 9, conversation c is the first h turns of
    c - c % 5 (floor) and its own after its first h. Conversations: (conv_id, total); turns: (conv_id, d, a, b, size), d from 1.
    """
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = counts.select("conv_id", "n", (F.col("conv_id") - F.pmod("conv_id", F.lit(5))).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h"))
    convs = convs.join(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left")
    convs = stash(convs.select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("k"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own")), "convs")
    first = turns.where("r < 8 and pmod(conv_id, 5) = 0").withColumnRenamed("conv_id", "base")
    shared = convs.where("h > 0").join(first, "base").where("r < h").select("conv_id", (F.col("r") + 1).alias("d"), "a", "b", "size")
    own = turns.join(convs, "conv_id").where("r >= h").select("conv_id", (F.col("r") - F.col("h") + F.col("k") + 1).alias("d"), "a", "b", "size")
    return convs.select("conv_id", (F.col("k") + F.col("own")).alias("total")), shared.unionByName(own)


def _merged(tables: DataFrame, key: list[str], sums: list[Column], parts: int) -> DataFrame:
    """Node tables of ``parts`` parts (column ``part``) merged by ``key``, ``FAN`` parts at a time; ``sums`` name their columns as they found them."""
    while True:
        tables = tables.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part", *key).agg(*sums)
        parts = -(-parts // FAN)
        if parts <= 1:
            return tables.drop("part")


_KEY = ["ka", "kb"]


def _paths(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, int]:
    """Every prefix of every conversation: (conv_id, part, d, ka, kb, pa, pb, size, last), and the number of parts."""
    parts = bucket_count(convs.count(), PART, 1)
    dealt = stash(convs.repartitionByRange(parts, "conv_id").withColumn("part", F.spark_partition_id()), "parts")
    root = dealt.select("conv_id", F.lit(0).cast("long").alias("d"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "size")])
    mark = lambda c, s: F.xxhash64(F.lit(s), "d", "a", "b").alias(c)
    rows = root.unionByName(turns.select("conv_id", "d", mark("a", 3), mark("b", 4), "size")).withColumn("block", F.floor(F.col("d") / BLOCK).cast("long"))
    totals = rows.join(side(dealt.where(F.col("total") >= BLOCK).select("conv_id")), "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = side(totals.select("conv_id", "block", F.bit_xor("a").over(earlier).alias("ca"), F.bit_xor("b").over(earlier).alias("cb")).where("block > 0"))
    up = Window.partitionBy("conv_id", "block").orderBy("d")
    summed = rows.select("*", F.bit_xor("a").over(up).alias("xa"), F.bit_xor("b").over(up).alias("xb")).join(carried, ["conv_id", "block"], "left")
    key = lambda x, c: F.col(x).bitwiseXOR(F.coalesce(c, F.lit(0)))
    keyed = summed.select("conv_id", "d", "a", "b", "size", key("xa", "ca").alias("ka"), key("xb", "cb").alias("kb"))
    found = keyed.join(dealt, "conv_id").select("conv_id", "part", "d", "ka", "kb", F.col("ka").bitwiseXOR(F.col("a")).alias("pa"), F.col("kb").bitwiseXOR(F.col("b")).alias("pb"), "size", (F.col("d") == F.col("total")).alias("last"))
    return stash(found, "paths"), max(parts, 1 + (dealt.agg(F.max("part")).first()[0] or 0))


_ENDS = "ka long, kb long, n_ends long, ends_sha256 string"
_ENDS_ARROW = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("n_ends", pa.int64()), ("ends_sha256", pa.string())])


def _digest(batches):
    """SHA-256 of the pieces of each key, comma-joined as they come; one piece in memory at a time."""
    last, sha, n = None, None, 0
    for batch in batches:
        out = []
        for ka, kb, size, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (ka, kb) == last:
                sha.update(b",")
            else:
                if last:
                    out.append((*last, n, sha.hexdigest()))
                last, sha, n = (ka, kb), hashlib.sha256(), 0
            sha.update(piece.encode())
            n += size
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, _ENDS_ARROW, strict=True)], schema=_ENDS_ARROW)
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*last, n, sha.hexdigest()), _ENDS_ARROW, strict=True)], schema=_ENDS_ARROW)


def ends(paths: DataFrame) -> DataFrame:
    """(ka, kb, n_ends, ends_sha256): conversations that end at a node, their decimal ids ascending. A part's list is a piece; parts are ranges of ids, so pieces in the order of parts are the whole list."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = paths.where("last").groupBy("part", *_KEY).agg(F.count(F.lit(1)).alias("n"), ids.alias("piece"))
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "part").select(*_KEY, "n", "piece").mapInArrow(_digest, _ENDS)


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations, the root included.

    ``convs``: (conv_id, total), ids distinct; ``turns``: (conv_id, d, a, b, size) with d from 1 to total without gaps.
    Rows: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256.
    A conversation without turns is a member of the root alone; without conversations there are no nodes, and no root.
    """
    small_batches(convs.sparkSession)
    paths, parts = _paths(convs, turns)
    found = paths.select("part", *_KEY, "pa", "pb", F.col("d").alias("depth"), "conv_id", F.lit(1).cast("long").alias("n_convs"), "size")
    nodes = stash(_merged(found, [*_KEY], [F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("size").alias("size")], parts), "nodes")
    below = nodes.where("depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count(F.lit(1)).alias("n_children"))
    own = nodes.join(below, _KEY, "left").select(*_KEY, "pa", "pb", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    own = stash(own, "own")
    # Up the tail that a conversation owns: blocks from below, the rest of the tail carried over.
    tail = own.withColumn("block", F.floor(F.col("depth") / BLOCK).cast("long"))
    blocks = tail.groupBy("conv_id", "block").agg(F.sum("saved").alias("s"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = side(blocks.select("conv_id", "block", F.sum("s").over(later).alias("later")).where("later is not null"))
    up = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = tail.select("*", F.sum("saved").over(up).alias("own_saved")).join(carried, ["conv_id", "block"], "left")
    owners = stash(own.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("tail_saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")), "owners")
    # To the nodes above the tail: each gets the whole of it.
    above = paths.join(owners.where("top > 0 and (tail_saved > 0 or leaf > 0)"), "conv_id").where("d < top").select("part", *_KEY, "tail_saved", "leaf")
    handed = _merged(above, _KEY, [F.sum("tail_saved").alias("tail_saved"), F.sum("leaf").alias("leaf")], parts)
    parents = nodes.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.lit(0).alias("at"))
    rolled = summed.join(owners.select("conv_id", F.col("leaf").alias("own_leaf")), "conv_id").join(handed, _KEY, "left").join(ends(paths), _KEY, "left")
    rolled = rolled.join(parents, ["pa", "pb"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rolled.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"),
        (F.col("own_leaf") + zero("leaf")).alias("n_leaves"), (F.col("own_saved") + zero("later") + zero("tail_saved")).alias("saved_tokens"), zero("n_ends").alias("n_ends"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11_partial_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations. Null roles and texts are empty; rows without a conv_id belong to none and are left out; an empty table has no nodes."""
    convs, turns = rebuild(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))
    return trie(convs, turns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
