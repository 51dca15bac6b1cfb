"""JSON in and out: both shapes of source data, memory files, resumable tables.

Inside the engine tables are Parquet; JSON is read and written at its edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallforge.functions.text import clean, clean_json

HISTORY_SCHEMA = "question_id string, question_type string, question string, question_date string, answer string, haystack_sessions array<array<struct<role:string,content:string>>>, haystack_dates array<string>, haystack_session_ids array<string>"
CONVERSATION_SCHEMA = "sample_id string, conversation string, qa array<struct<question:string,answer:string,category:int>>"
MEMORY_SCHEMA = "memories array<struct<source_id:string,source_time:string,session_id:string,content:string,window_index:string,window_dir:string,dimension:struct<memory_type:string,time:string,location:string,reason:string,purpose:string,keywords:array<string>>>>"


def read_histories(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Single-user items of files in a folder (or one file), with the question type from the file name after its first ``__``."""
    rows = spark.read.schema(HISTORY_SCHEMA).option("multiLine", True).option("pathGlobFilter", glob).json(path)
    return rows.withColumn("question_type", F.coalesce("question_type", F.nullif(F.regexp_extract(F.col("_metadata.file_name"), r"^.*?__(.*)\.json$", 1), F.lit(""))))


def read_conversations(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Multi-speaker items; ``conversation`` stays JSON text, as its keys differ from item to item. ``question_type`` is the name of the folder."""
    rows = spark.read.schema(CONVERSATION_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path)
    return rows.withColumn("sample", F.col("sample_id")).withColumn("question_type", F.try_element_at(F.split(F.col("_metadata.file_path"), "/"), F.lit(-2)))


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """Records of banks below ``path``, with bank (the folder), record_idx and boundary_id ``<window>_<index in its folder's list>``.

    A bank's own file (all_memories.json, any *.json in the bank's folder) holds all of it; only banks without one are
    read from the files in their window folders, windows in the order of their names. Files hold ``{"memories": [...]}`` or
    a bare list, and several files of one folder are one list, in the order of their names, so that no file need be large: a file is a row. The window is window_dir, else window_index, 0 included, else all_memories or the window folder.
    """
    root = path.rstrip("/") + "/"
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    parts = F.split(F.substring_index(F.col("_metadata.file_path"), root, -1), "/")
    files = text.select("value", F.col("_metadata.file_path").alias("path"), F.size(parts).alias("depth"), F.get(parts, F.lit(0)).alias("bank"), F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise("all_memories").alias("window")).where("depth in (2, 3)")
    least = files.groupBy("bank").agg(F.min("depth").alias("least"))
    chosen = files.join(least, "bank").where("depth = least")
    listed = F.when(F.trim("value").startswith("["), F.concat(F.lit('{"memories":'), F.col("value"), F.lit("}"))).otherwise(F.col("value"))
    m = chosen.select("bank", "window", "path", F.posexplode(F.from_json(listed, MEMORY_SCHEMA)["memories"]).alias("in_file", "m")).select("bank", "window", "path", "in_file", "m.*")
    d = F.col("dimension")
    window = F.coalesce(F.nullif(clean(F.col("window_dir")), F.lit("")), F.nullif(clean(F.col("window_index")), F.lit("")), F.col("window"))
    sizes = m.groupBy("bank", "window", "path").agg(F.count(F.lit(1)).alias("n"))
    ahead = lambda *by: Window.partitionBy(*by).orderBy("window", "path").rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  # a row a file
    offsets = sizes.select("bank", "window", "path", *[F.coalesce(F.sum("n").over(ahead(*by)), F.lit(0)).alias(c) for c, by in (("offset", ["bank"]), ("in_window", ["bank", "window"]))])
    numbered = m.join(offsets, ["bank", "window", "path"]).withColumn("record_idx", (F.col("offset") + F.col("in_file")).cast("int")).withColumn("at", (F.col("in_window") + F.col("in_file")).cast("int"))
    return numbered.select(
        "bank", "record_idx", F.format_string("%s_%04d", window, F.col("at")).alias("boundary_id"), clean(F.col("content")).alias("content"), F.coalesce(F.nullif(clean_json(d["memory_type"]), F.lit("")), F.lit("other")).alias("memory_type"),
        *[clean_json(d[c]).alias(c) for c in ("time", "location", "reason", "purpose")], F.coalesce(d["keywords"], F.array().cast("array<string>")).alias("keywords"), F.try_to_timestamp("source_time").cast("timestamp_ntz").alias("source_time"), "source_id", "session_id",
    )


def newest(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Of candidates (level, path, ...) for a key the one of the least level, there the last path."""
    w = Window.partitionBy(*key).orderBy("level", F.col("path").desc())
    return candidates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def to_do(inputs: DataFrame, done: DataFrame, key: list[str], ok: Column | None = None) -> DataFrame:
    """What a resumed run has left: inputs without a row in ``done`` (that is ``ok``)."""
    finished = done if ok is None else done.where(ok)
    return inputs.join(finished.select(*key).distinct(), key, "left_anti")


def present(inputs: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Inputs whose key is among ``found``, such as samples that have an input file; each once, however often it is found."""
    return inputs.join(found.select(*key), key, "left_semi")


def top_records(keys: DataFrame, lists: DataFrame, key: list[str], n: int, record: str) -> DataFrame:
    """The first ``n`` records, of schema ``record``, of each key's JSON list (column ``value``), with ``rank`` from 1; one row with a null rank for a key without.

    A missing, broken or cut-off list, and JSON that is no list, count as empty, which ``corrupt`` tells (null where there is no list at all).
    """
    good = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("[")
    read = lists.select(*key, F.coalesce(~good, F.lit(True)).alias("corrupt"), F.when(good, F.from_json("value", f"array<{record}>")).alias("r"))
    rows = read.select(*key, "corrupt", F.posexplode_outer(F.slice(F.coalesce("r", F.array().cast(f"array<{record}>")), 1, n)).alias("at", "record"))
    return keys.join(rows, key, "left").select(*keys.columns, (F.col("at") + 1).alias("rank"), "record", "corrupt")


def write_json(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """One JSON object a row; timestamps with a blank between date and time, null fields kept."""
    w = df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").option("ignoreNullFields", False)
    (w.partitionBy(*partition) if partition else w).json(path)


def append_manifest(spark: SparkSession, path: str, run: str, step: str, counts: dict[str, int]) -> None:
    """One row of a run's manifest."""
    items = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(int(v)).cast("long")) for k, v in counts.items()])) if counts else F.create_map().cast("map<string,bigint>")
    spark.range(1).select(F.lit(run).alias("run"), F.lit(step).alias("step"), F.current_timestamp().alias("at"), items.alias("counts")).write.mode("append").parquet(path)


def append_failures(rows: DataFrame, path: str, run: str, step: str, key: list[str]) -> None:
    """The rows that are not ok, with their key and error, appended to a run's table of failures."""
    failed = rows.where(~F.col("ok")).select(F.lit(run).alias("run"), F.lit(step).alias("step"), F.current_timestamp().alias("at"), F.to_json(F.struct(*key)).alias("key"), "error")
    failed.write.mode("append").parquet(path)


def write_texts(rows: DataFrame, path: str, text: str, by: list[str]) -> None:
    """One text a row (prompts, dialogues, raw answers) as text files, a folder for each value of ``by``."""
    rows.select(*by, F.coalesce(F.col(text), F.lit("")).alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def questions_of(items: DataFrame, exclude: tuple[int, ...] = (), per_item: int = 0) -> DataFrame:
    """Questions of conversation items (sample, qa): their place before the filter, categories not in ``exclude`` (a null category stays), the first ``per_item`` of each (0: all)."""
    q = items.select("sample", F.posexplode("qa").alias("pos", "q")).select("sample", "pos", "q.*")
    if exclude:
        q = q.where(F.col("category").isNull() | ~F.col("category").isin(*exclude))
    if per_item:
        q = q.withColumn("__n", F.row_number().over(Window.partitionBy("sample").orderBy("pos"))).where(F.col("__n") <= per_item).drop("__n")
    return q


def banks_of(files: DataFrame, skip: tuple[str, ...] = ("MERGE", "README")) -> DataFrame:
    """Banks by folder name, without those whose name begins with one of ``skip``."""
    for s in skip:
        files = files.where(~F.col("bank").startswith(s))
    return files


def last_wins(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of tables; of rows with one key the one of the later table stays."""
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("__level", F.lit(-i))
        rows = p if rows is None else rows.unionByName(p)
    w = Window.partitionBy(*key).orderBy("__level")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__level")
