"""Accuracy report of judged answers: ``python -m recallforge.report JUDGED [COLUMN...]`` prints it as Markdown.

JUDGED is a Parquet folder with label and status; COLUMNs are its dimensions (default conv and category).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from recallforge.operators import judge as J


def report(spark: SparkSession, judged: str, dimensions: list[str]) -> str:
    rows = spark.read.parquet(judged)
    return J.markdown(J.accuracy(rows, {c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in dimensions}))


def main(argv: list[str] | None = None) -> None:
    read = argparse.ArgumentParser(description="Accuracy of judged answers")
    read.add_argument("judged")
    read.add_argument("dimensions", nargs="*", default=["conv", "category"])
    a = read.parse_args(argv)
    print(report(SparkSession.builder.getOrCreate(), a.judged, a.dimensions))


if __name__ == "__main__":
    main()
