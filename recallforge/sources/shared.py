"""Tables kept below ``spark.checkpoint.dir`` while the application runs: cut lineage, results that several queries read."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows (a few numbers each) up to which ``side`` broadcasts.
MAX_SIDE = 1_000_000

_ROOTS: dict[str, str] = {}
_KEPT: dict[tuple[str, str], str] = {}


def _drop(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application below spark.checkpoint.dir; where that is unset a temporary one, on one machine only. It is deleted at exit."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            top = tempfile.mkdtemp(prefix="recallforge-")
        _ROOTS[app] = f"{top.rstrip('/')}/recallforge-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_drop, spark, _ROOTS[app])
    return _ROOTS[app]


def new_folder(spark: SparkSession, label: str = "files") -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written as Parquet and read back, so that lost executors repeat nothing ahead of it."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stashed tables that no plan to come reads."""
    for t in tables:
        _drop(t.sparkSession, t._stashed)


def side(df: DataFrame, limit: int = MAX_SIDE) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, which is counted; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of one Arrow batch, so that a Python worker's memory depends neither on the length of texts nor on the rows of a partition."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")


def numbered(df: DataFrame, key: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with the place (from 1) of each row among those of its ``key``, in ``order``, without sorting a key in one task: rows are sorted over ranges, and what lies in earlier ranges is added."""
    # The id of a row says the range it is in (from bit 33 on) and its place there; rows are shuffled and sorted once.
    dealt = stash(df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    parts = dealt.groupBy(*key, part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy(*key or [F.lit(0)]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ahead = parts.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("__part").alias("__p"), (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__ahead"))
    same = part == F.col("__p")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return dealt.join(side(stash(ahead, "ahead")), same).withColumn(out, (F.col("__at") + F.col("__ahead")).cast("long")).select(*df.columns, out)


def version_of(spark: SparkSession, path: str) -> str:
    """Changes whenever files of a Parquet table do: paths, sizes and times of all of them."""
    f = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return f"{path}:{f.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64('*'))).first()}"


def once(spark: SparkSession, name: str, version: str, build: Callable[[str], None]) -> str:
    """The folder that ``build`` filled for this name and version, built at first use in this application."""
    key = (spark.sparkContext.applicationId, f"{name}:{version}")
    if key not in _KEPT:
        path = new_folder(spark, name)
        build(path)
        _KEPT[key] = path
    return _KEPT[key]
