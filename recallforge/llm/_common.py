"""Plumbing shared by the training-data operators: stored cuts, size-checked fetches, ranks and components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ids (8 bytes each) up to which a fetch broadcasts them; beyond it the fetch shuffles.
MAX_BROADCAST_IDS = 1_000_000

_ROOTS: dict[str, str] = {}
_MADE: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``; where that is unset a temporary one, but only if all runs on one machine (else ValueError)."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            top = tempfile.mkdtemp(prefix="recallforge-")
        _ROOTS[app] = f"{top.rstrip('/')}/recallforge-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_drop_root, spark, _ROOTS[app])
    return _ROOTS[app]


def _drop_root(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back.

    Lost executors cost nothing that was stashed; re-reading is columnar.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    _MADE.append(path)
    return out


def stashed() -> set[str]:
    """What is stashed so far, to be kept by a later ``settle``."""
    return set(_MADE)


def settle(df: DataFrame, label: str, keep: set[str]) -> DataFrame:
    """``stash``, and delete all that was stashed before but ``keep``: for results that need nothing else of what led to them."""
    led = [p for p in _MADE if p not in keep]
    out = stash(df, label)
    for path in led:
        _drop_root(df.sparkSession, path)
        _MADE.remove(path)
    return out


def forget(*stashed: DataFrame) -> None:
    """Delete stashed tables that no plan to come reads."""
    for df in stashed:
        _drop_root(df.sparkSession, df._stashed)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of one Arrow batch, so that very long texts cannot fill a Python worker. All operators set the same bound, so their order does not matter."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")


def rows_of(df: DataFrame, ids: DataFrame, key: str, limit: int = MAX_BROADCAST_IDS) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``ids`` (one column ``key``, distinct).

    Up to ``limit`` ids, counted first, are broadcast so that the wide side is not
    shuffled; more ids take a shuffled semi-join.
    """
    side = F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids
    return df.join(side, key, "left_semi")


def with_rank(df: DataFrame, key: list[str], order: list[Column], out: str, size: str | None = None, deal: Column | None = None, buckets: int | None = None) -> DataFrame:
    """Gapless rank (from 0) of rows within ``key``, or with ``size`` the sum of the sizes ahead, without sorting a key in one task.

    Rows of a key are dealt over hash buckets (of their order columns, or by
    ``deal``); totals of buckets give offsets, a window counts on within a bucket.
    The order is (bucket, order): fixed for given rows and bucket count, and
    pseudo-random like a shuffle. Nulls in ``key`` are a key of their own.
    """
    if buckets is None:
        buckets = bucket_count(df.count())
    each = F.col(size) if size else F.lit(1)
    names = [f"__k{i}" for i in range(len(key))]
    b = df.withColumn("__bucket", F.pmod(F.xxhash64(*order) if deal is None else deal, F.lit(buckets)).cast("int"))
    counts = b.groupBy(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], F.col("__bucket").alias("__kb")).agg(F.sum(each).alias("__n"))
    ahead = Window.partitionBy(*(names or [F.lit(0)])).orderBy("__kb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    cond = F.col("__bucket") == F.col("__kb")
    for k, n in zip(key, names, strict=True):
        cond = cond & F.col(k).eqNullSafe(F.col(n))
    within = Window.partitionBy(*key, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = b.withColumn("__to", F.sum(each).over(within) - each).join(offsets, cond)
    return got.withColumn(out, (F.col("__off") + F.col("__to")).cast("long")).drop("__bucket", "__to", "__off", "__kb", *names)


def bucket_count(rows: int, per_bucket: int = 5_000, least: int = 128) -> int:
    """Buckets of about ``per_bucket`` rows: grows with the data. With ``least`` buckets a key that holds a third of all rows is cut finely too."""
    return max(least, -(-rows // per_bucket))


def side(df: DataFrame, limit: int = MAX_BROADCAST_IDS) -> DataFrame:
    """``df`` (a few longs a row) marked for broadcast if it has at most ``limit`` rows, which is counted; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (long ``a``, ``b``): rows (id, component), component the least id.

    Every round each node takes its least neighbour (itself, if it is less), these
    pointers are followed to their ends, and what is left are the edges between
    different ends: at most half of the nodes, so rounds are few and ever smaller, in
    any order of ids. The least id of a component always points to itself. It ends when no
    edge is left. Tables of earlier rounds are deleted.
    """
    left = stash(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while True:
        both = left.union(left.select("b", "a"))
        ends = stash(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "ends")
        while True:
            known = side(ends).select(F.col("id").alias("at"), F.col("label").alias("next"))
            further = stash(ends.join(known, F.col("label") == F.col("at")).select("id", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "ends")
            done = further.where("moved").limit(1).count() == 0
            forget(ends)
            ends = further
            if done:
                break
        to = side(ends)
        fresh = stash(left.join(to.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("label").alias("y")), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if labels is None:
            new = stash(ends.select("id", "label"), "labels")
        else:
            new = stash(labels.join(to.select(F.col("id").alias("at"), F.col("label").alias("next")), F.col("label") == F.col("at"), "left").select("id", F.coalesce("next", "label").alias("label")), "labels")
            forget(labels)
        forget(left, ends)
        labels, left = new, fresh
        if left.limit(1).count() == 0:
            forget(left)
            return labels.select("id", F.col("label").alias("component"))


def joined_components(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``groups`` (id, component) of a graph with more ``edges``: only the groups that these touch are looked at again."""
    known = side(groups)
    a = known.select(F.col("id").alias("a"), F.col("component").alias("x"))
    b = known.select(F.col("id").alias("b"), F.col("component").alias("y"))
    between = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    merged = components(stash(between, "between"))
    moved = groups.join(side(merged.select(F.col("id").alias("component"), F.col("component").alias("to"))), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    added = merged.join(known.select("id"), "id", "left_anti")
    return stash(moved.unionByName(added), "groups")
