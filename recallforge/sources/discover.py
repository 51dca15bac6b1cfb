"""Discovery of records, windows, queries and results among the paths of a run: operators on a table of paths.

``list_files`` makes that table from a folder; ``path`` is relative to the folder, parted by ``/``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.functions.text import clean, slugify


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path")
    return files.select(F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", "").alias("path"))


def _part(i: int) -> Column:
    return F.get(F.split("path", "/"), F.lit(i))


def _depth() -> Column:
    return F.size(F.split("path", "/"))


def record_dirs(paths: DataFrame, flat: str = "if_none") -> DataFrame:
    """(record, conv) of folders with a summary.json two folders deep, and one deep: ``also``, only ``if_none`` is two deep, or ``never``."""
    found = paths.where(F.element_at(F.split("path", "/"), -1) == "summary.json").withColumn("depth", _depth()).where(F.col("depth").isin(2, 3))
    if flat == "never":
        found = found.where("depth = 3")
    elif flat == "if_none":
        deepest = found.agg(F.max("depth").alias("deepest"))
        found = found.join(F.broadcast(deepest), F.col("depth") == F.col("deepest"))  # one row
    return found.select(F.regexp_replace("path", "/summary[.]json$", "").alias("record"), _part(0).alias("conv")).distinct()


def window_paths(paths: DataFrame, replies: bool = False) -> DataFrame:
    """(path, record, window) of window_*.json files; files of assistant replies only if asked for."""
    name = F.element_at(F.split("path", "/"), -1)
    found = paths.where(name.rlike(r"^window_.*\.json$"))
    if not replies:
        found = found.where(~F.contains(name, F.lit("_assistant_replies")))
    return found.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("record"), F.regexp_extract(name, r"^window_(\d+)", 1).cast("int").alias("window"))


def query_items(paths: DataFrame, name: str = "parsed.json") -> DataFrame:
    """(conv, sample, path) of <conv>/<sample>/<name>."""
    return paths.where((_depth() == 3) & (_part(2) == name)).select(_part(0).alias("conv"), _part(1).alias("sample"), "path")


def result_dirs(paths: DataFrame) -> DataFrame:
    """(question_type, method, sample) of folders three deep that hold something."""
    return paths.where(_depth() > 3).select(_part(0).alias("question_type"), _part(1).alias("method"), _part(2).alias("sample")).distinct()


def question_rows(texts: DataFrame, text: str = "text") -> DataFrame:
    """The rows of JSON arrays of questions: columns of ``texts`` but the text, index, question; a row that is no object is itself the question."""
    rows = texts.select(*[c for c in texts.columns if c != text], F.posexplode(F.from_json(text, "array<string>")).alias("index", "row"))
    bare = F.when(F.col("row").startswith("{"), F.get_json_object("row", "$.question")).otherwise(F.col("row"))
    return rows.withColumn("question", clean(bare)).drop("row")


def grouped_questions(items: DataFrame, index: str = "index") -> DataFrame:
    """Items (index, question_id, question_type, question, file_type) with conv (the type of the file, else the row's, else unknown) and sample_id ``NNNN_slug``, the slug of the id or of ``row_<index>``."""
    kind = F.coalesce(F.nullif(clean(F.col("file_type")), F.lit("")), F.nullif(clean(F.col("question_type")), F.lit("")), F.lit("unknown"))
    named = F.coalesce(F.nullif(clean(F.col("question_id")), F.lit("")), F.concat(F.lit("row_"), F.col(index).cast("string")))
    return items.select(index, kind.alias("conv"), F.concat(F.format_string("%04d", F.col(index)), F.lit("_"), slugify(named)).alias("sample_id"), clean(F.col("question")).alias("question"))
