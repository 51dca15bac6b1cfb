"""Flattening of chat histories and count-based sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallforge.functions.text import clean, iso


def session_time(x: Column) -> Column:
    """``2023/06/25 (Sun) 13:22`` as a timestamp; the weekday must stand there but is not checked. Else null."""
    t = clean(x)
    return F.when(t.rlike(r"^\S+ \([A-Za-z]{3}\) \S+$"), F.try_to_timestamp(F.regexp_replace(t, r" \([A-Za-z]{3}\)", ""), F.lit("yyyy/MM/dd HH:mm")).cast("timestamp_ntz"))


def spoken_time(x: Column) -> Column:
    """``8:56 pm on 20 July, 2023`` as a timestamp; else null."""
    t = F.regexp_replace(F.regexp_replace(clean(x), "(?i) am on ", " AM on "), "(?i) pm on ", " PM on ")
    return F.try_to_timestamp(t, F.lit("h:mm a 'on' d MMMM, yyyy")).cast("timestamp_ntz")


def overlap_of(window: int, overlap: int = -1, ratio: float = 0.2) -> int:
    """The overlap, or where it is negative ``window * ratio`` rounded half to even, within 0 and window - 1."""
    return min(max(overlap if overlap >= 0 else round(window * ratio), 0), window - 1)


def number_messages(messages: DataFrame, role: str | None = "user") -> DataFrame:
    """Rows (sample, session, session_pos, session_start, turn, role, speaker, content) of one role, numbered from 1 in the session and the sample and stamped half a second apart.

    Sessions without a start are left out. A session's rows are one window partition; the sample's
    numbers come from session counts, so a long history is not sorted in one task.
    """
    kept = messages.where(F.col("session_start").isNotNull())
    if role is not None:
        kept = kept.where(F.lower(clean(F.coalesce("role", "speaker"))) == role)
    by_session = Window.partitionBy("sample", "session_pos").orderBy("turn")
    local = kept.withColumn("local_idx", F.row_number().over(by_session))
    sizes = local.groupBy("sample", "session_pos").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("sample").orderBy("session_pos").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("sample", "session_pos", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    out = local.join(offsets, ["sample", "session_pos"]).withColumn("global_idx", (F.col("offset") + F.col("local_idx")).cast("int")).drop("offset")
    half = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("local_idx") - 1) * F.lit(0.5).cast("decimal(18,6)"))
    return out.withColumn("ts", (F.col("session_start") + half).cast("timestamp_ntz"))


def flatten_histories(items: DataFrame) -> DataFrame:
    """Items with haystack_sessions, haystack_dates and haystack_session_ids as message rows for ``number_messages``; a missing session id is ``session_%04d``."""
    zipped = F.arrays_zip(F.col("haystack_sessions").alias("s"), F.col("haystack_dates").alias("d"), F.col("haystack_session_ids").alias("i"))
    sessions = items.select(F.col("question_id").alias("sample"), F.posexplode(zipped).alias("session_pos", "z"))
    turns = sessions.select("sample", "session_pos", "z.d", "z.i", F.posexplode("z.s").alias("turn", "m"))
    session = F.coalesce(F.nullif(clean(F.col("i")), F.lit("")), F.format_string("session_%04d", F.col("session_pos") + 1))
    return turns.select("sample", session.alias("session"), "session_pos", session_time(F.col("d")).alias("session_start"), "turn", F.col("m.role").alias("role"), F.lit(None).cast("string").alias("speaker"), F.col("m.content").alias("content"))


def session_map(items: DataFrame) -> DataFrame:
    """(sample, session, messages) of items with haystack_sessions and haystack_session_ids: of an id that comes twice the last; sessions without an id are left out."""
    pairs = F.arrays_zip(F.col("haystack_session_ids").alias("i"), F.col("haystack_sessions").alias("s"))
    both = F.least(F.size("haystack_session_ids"), F.size("haystack_sessions"))
    rows = items.select(F.col("question_id").alias("sample"), F.posexplode(F.slice(pairs, F.lit(1), F.greatest(both, F.lit(0)))).alias("at", "z"))
    return rows.groupBy("sample", F.col("z.i").alias("session")).agg(F.max_by("z.s", "at").alias("messages"))


def flatten_conversations(items: DataFrame) -> DataFrame:
    """Items with a JSON ``conversation`` of keys session_<n> and session_<n>_date_time as message rows, sessions by number."""
    entries = items.select("sample", F.explode(F.from_json("conversation", "map<string,string>")).alias("k", "v"))
    number = F.regexp_extract("k", r"^session_(\d+)$", 1)
    sessions = entries.where(number != "").select("sample", number.cast("int").alias("session_pos"), F.from_json("v", "array<struct<speaker:string,text:string>>").alias("turns"))
    dates = entries.where(F.col("k").rlike(r"^session_\d+_date_time$")).select("sample", F.regexp_extract("k", r"(\d+)", 1).cast("int").alias("session_pos"), spoken_time(F.col("v")).alias("session_start"))
    turns = sessions.join(dates, ["sample", "session_pos"]).select("sample", F.concat(F.lit("session_"), "session_pos").alias("session"), "session_pos", "session_start", F.posexplode("turns").alias("turn", "m"))
    return turns.select("sample", "session", "session_pos", "session_start", "turn", F.lit(None).cast("string").alias("role"), F.col("m.speaker").alias("speaker"), F.col("m.text").alias("content"))


def sliding_windows(messages: DataFrame, window: int = 25, overlap: int = 5, clamp: bool = True) -> DataFrame:
    """Rows of ``number_messages`` once for each count window they are in: with window_index, pos (from 1), overlap_count, message_count.

    Window k begins at message k * step + 1; windows end with the first that reaches the last message.
    ``overlap_count`` is 0 in the first window, else the overlap, at most the window's size if ``clamp``.
    """
    step = max(1, window - overlap)
    sizes = messages.groupBy("sample").agg(F.count(F.lit(1)).alias("total"))
    g = F.col("global_idx") - 1
    last = F.when(F.col("total") <= window, 0).otherwise(F.ceil((F.col("total") - window) / step))
    first = F.greatest(F.lit(0), F.ceil((g - window + 1) / step))
    rows = messages.join(sizes, "sample").withColumn("window_index", F.explode(F.sequence(first.cast("int"), F.greatest(first, F.least(F.floor(g / step), last)).cast("int"))))
    rows = rows.where((F.col("window_index") * step <= g) & (F.col("window_index") <= last))
    pos = (F.col("global_idx") - F.col("window_index") * step).cast("int")
    count = F.least(F.lit(window), F.col("total") - F.col("window_index") * step).cast("int")
    over = F.when(F.col("window_index") == 0, 0).otherwise(F.least(F.lit(overlap), count) if clamp else F.lit(overlap))
    return rows.withColumn("pos", pos).withColumn("message_count", count).withColumn("overlap_count", over.cast("int")).drop("total")


def window_texts(windows: DataFrame, speaker: bool = False) -> DataFrame:
    """One row a window: bounds, counts and the text with a line ``[time, Day] i.User: content`` for each message."""
    name = F.col("speaker") if speaker else F.lit("User")
    line = F.concat(F.lit("["), iso(F.col("ts")), F.lit(", "), F.date_format("ts", "EEE"), F.lit("] "), F.col("pos").cast("string"), F.lit("."), name, F.lit(": "), F.col("content"))
    rows = F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))  # ``window`` rows at most
    return windows.groupBy("sample", "window_index").agg(
        F.first("message_count").alias("message_count"), F.first("overlap_count").alias("overlap_count"), F.min("global_idx").alias("start_idx"), F.max("global_idx").alias("end_idx"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"),
    )


def assistant_replies(messages: DataFrame) -> DataFrame:
    """User rows of all roles' rows with ``reply``: the content of the next row if that is the assistant's, else empty."""
    by = Window.partitionBy("sample", "session_pos").orderBy("turn")
    nxt = messages.withColumn("next_role", F.lower(clean(F.lead("role").over(by)))).withColumn("next_content", F.lead("content").over(by))
    reply = F.when(F.col("next_role") == "assistant", clean(F.col("next_content"))).otherwise(F.lit(""))
    return nxt.where(F.lower(clean(F.col("role"))) == "user").withColumn("reply", reply).drop("next_role", "next_content")


def reply_index(windows: DataFrame, replies: DataFrame) -> DataFrame:
    """(sample, uid, source_id, global_idx, session, local_idx, reply) with uid w<window>u<place>, for each window row."""
    uid = F.format_string("w%04du%02d", F.col("window_index"), F.col("pos"))
    own = windows.select("sample", "session_pos", "turn", uid.alias("uid"), F.col("pos").alias("source_id"), "global_idx", "session", "local_idx")
    return own.join(replies.select("sample", "session_pos", "turn", "reply"), ["sample", "session_pos", "turn"], "left").withColumn("reply", F.coalesce("reply", F.lit(""))).drop("session_pos", "turn")


def compression_stats(windows: DataFrame, compressed: str = "compressed") -> DataFrame:
    """Lengths by (sample, window_index), and by sample on the row whose window_index is null: messages, changed ones, original and compressed characters, their ratio."""
    a, b = F.char_length("content"), F.char_length(compressed)
    out = windows.rollup("sample", "window_index").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("content") != F.col(compressed)).alias("changed"), F.sum(a).alias("original_chars"), F.sum(b).alias("compressed_chars"), F.count_distinct("window_index").alias("windows"),
    ).where(F.col("sample").isNotNull())
    return out.withColumn("ratio", F.when(F.col("original_chars") == 0, 1.0).otherwise(F.col("compressed_chars") / F.col("original_chars")))


def normalize_memories(entries: DataFrame, windows: DataFrame, keep_any_source: bool = False) -> DataFrame:
    """Extracted entries (sample, window_index, source_id, content, ...) with the time and session of the message they came from, by place in the window.

    Entries with empty content go; without ``keep_any_source`` those whose source is no number too.
    """
    places = windows.select("sample", "window_index", F.col("pos").alias("source_pos"), iso(F.col("ts")).alias("source_time"), "session", "local_idx")
    kept = entries.withColumn("content", clean(F.col("content"))).where(F.col("content") != "").withColumn("source_pos", F.expr("try_cast(source_id as int)"))
    if not keep_any_source:
        kept = kept.where(F.col("source_pos").isNotNull())
    return kept.join(places, ["sample", "window_index", "source_pos"], "left").withColumn("source_time", F.coalesce("source_time", F.lit("")))
