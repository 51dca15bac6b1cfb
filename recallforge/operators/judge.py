"""Gold lookup and accuracy reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallforge.functions.text import clean, normalize_question


def _last(gold: DataFrame, key: str) -> DataFrame:
    """The last gold row (by pos) of each (conv, key)."""
    w = Window.partitionBy("conv", key).orderBy(F.col("pos").desc())
    return gold.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("conv", key, "gold")


def gold_join(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Answers (conv, question, ...) with the gold of the same conversation: by exact question, else by normalised question, else status missing_gold."""
    g = gold.withColumn("norm", normalize_question(F.col("question")))
    exact = _last(g, "question").withColumnRenamed("gold", "exact_gold")
    loose = _last(g, "norm").withColumnRenamed("gold", "norm_gold")
    out = answers.withColumn("norm", normalize_question(F.col("question"))).join(exact, ["conv", "question"], "left").join(loose, ["conv", "norm"], "left")
    found = F.coalesce("exact_gold", "norm_gold")
    return out.withColumn("gold", F.coalesce(found, F.lit(""))).withColumn("status", F.when(found.isNull(), "missing_gold").otherwise("ok")).drop("exact_gold", "norm_gold", "norm")


def accuracy(rows: DataFrame, sets: dict[str, Column]) -> DataFrame:
    """Rows (dimension, value, total, correct, missing, accuracy): overall and by each of ``sets``, in one GROUPING SETS aggregate.

    ``label`` counts as correct if CORRECT; missing gold and blank labels stay in the totals.
    """
    names = list(sets)
    made = rows.select(*[v.alias(k) for k, v in sets.items()], F.upper(clean(F.col("label"))).alias("label"), "status")
    got = made.groupingSets([[], *[[F.col(n)] for n in names]], *[F.col(n) for n in names]).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == "CORRECT").alias("correct"), F.count_if(F.col("status") == "missing_gold").alias("missing"),
    )
    whole = 2 ** len(names) - 1
    ids = {n: whole - 2 ** (len(names) - 1 - i) for i, n in enumerate(names)}
    dimension, value = F.lit("overall"), F.lit("")
    for n, i in ids.items():
        dimension, value = F.when(F.col("gid") == i, n).otherwise(dimension), F.when(F.col("gid") == i, F.col(n)).otherwise(value)
    return got.select(dimension.alias("dimension"), value.alias("value"), "total", "correct", "missing", F.coalesce(F.col("correct") * F.lit(100.0).cast("double") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)).alias("accuracy"))


def markdown(report: DataFrame) -> str:
    """The report, a few rows by construction, as a Markdown table."""
    rows = report.orderBy("dimension", "value").collect()
    return "\n".join(["| dimension | value | total | correct | accuracy |", "|---|---|---|---|---|", *[f"| {r['dimension']} | {r['value']} | {r['total']} | {r['correct']} | {r['accuracy']:.2f} |" for r in rows]])
