"""Ledger of the model calls of runs: what was asked, under which configuration, with what result. It makes jobs resumable.

A table of rows (run, step, key, config, status, attempt, response, error, prompt_tokens, completion_tokens,
total_tokens, at), only ever appended to. A key that is ok under a configuration is not asked again, by no run; equal
prompts are asked once. A task that is lost repeats its own calls alone, as rows count from the commit of their append.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallforge.ports import ChatPort, chat

SCHEMA = "run string, step string, key string, config string, status string, attempt int, response string, error string, prompt_tokens long, completion_tokens long, total_tokens long, at timestamp"
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")


def config_hash(config: dict) -> str:
    """One name for equal configurations, in whatever order their parts are given."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


class Ledger:
    def __init__(self, spark: SparkSession, path: str, run: str, config: dict | None = None):
        self.spark, self.path, self.run, self.config = spark, path, run, config_hash(config or {})

    def rows(self) -> DataFrame:
        """All rows; a ledger that nothing was written to yet is empty."""
        empty = self.spark.createDataFrame([], SCHEMA)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return empty
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def latest(self, step: str) -> DataFrame:
        """The row that counts of each key of a step under this configuration: an ok one, else the last attempt. A repeated append changes nothing."""
        best = Window.partitionBy("key").orderBy((F.col("status") == "ok").desc(), F.col("attempt").desc(), "run", "response")
        own = self.rows().where((F.col("step") == step) & (F.col("config") == self.config))
        return own.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")

    def ask(self, rows: DataFrame, step: str, open_port: Callable[[], ChatPort], prompt: str = "prompt", **how) -> DataFrame:
        """``rows`` with response, ok, error, prompt_key and usage, all out of the ledger, after asking for the prompts that have no ok row. ``how`` goes to ``chat``. A null prompt is never asked: not ok, error ``no prompt``."""
        key = F.sha2(F.col(prompt), 256)
        asked = rows.where(F.col(prompt).isNotNull()).select(key.alias("key"), F.col(prompt).alias("prompt")).dropDuplicates(["key"])
        known = self.latest(step)
        left = asked.join(known.where("status = 'ok'").select("key"), "key", "left_anti").join(known.select("key", F.col("attempt").alias("before")), "key", "left")
        got = chat(left, open_port, **how)
        new = got.select(F.lit(self.run).alias("run"), F.lit(step).alias("step"), "key", F.lit(self.config).alias("config"), F.when(F.col("ok"), "ok").otherwise("failed").alias("status"), (F.coalesce("before", F.lit(0)) + 1).alias("attempt"), "response", "error", *[F.col(c).cast("long").alias(c) for c in USAGE], F.current_timestamp().alias("at"))
        new.write.mode("append").parquet(self.path)
        done = self.latest(step).select(F.col("key").alias("prompt_key"), "response", (F.col("status") == "ok").alias("ok"), "error", *USAGE)
        out = rows.withColumn("prompt_key", key).join(done, "prompt_key", "left")
        return out.select(*rows.columns, "response", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("error", F.lit("no prompt")).alias("error"), "prompt_key", *[F.coalesce(c, F.lit(0)).alias(c) for c in USAGE])

    def status(self) -> DataFrame:
        """By step under this configuration: keys, ok, failed, calls in all runs and their tokens."""
        own = self.rows().where(F.col("config") == self.config)
        by_key = own.groupBy("step", "key").agg(F.max((F.col("status") == "ok").cast("int")).alias("ok"), F.max("attempt").alias("calls"), F.sum("total_tokens").alias("total_tokens"))
        return by_key.groupBy("step").agg(F.count(F.lit(1)).alias("keys"), F.sum("ok").cast("long").alias("ok"), F.count_if(F.col("ok") == 0).alias("failed"), F.sum("calls").cast("long").alias("calls"), F.sum("total_tokens").cast("long").alias("total_tokens"))

    def failures(self, step: str) -> DataFrame:
        """(key, attempt, error) of what is not ok yet."""
        return self.latest(step).where("status <> 'ok'").select("key", "attempt", "error")
