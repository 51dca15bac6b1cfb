"""Column functions over text: cleaning, tokens, keys, truncation and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Memory types; anything else is the empty type.
MEMORY_TYPES = ("fact", "episodic", "profile")


def clean(x: Column) -> Column:
    """Trim all Unicode blanks; null becomes the empty string."""
    return F.coalesce(F.regexp_replace(x.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def clean_json(x: Column) -> Column:
    """``clean`` of a JSON scalar held as text: the falsy values 0, 0.0, false, null, [] and {} count as empty."""
    c = clean(x)
    return F.when(c.isin("0", "0.0", "false", "null", "[]", "{}"), F.lit("")).otherwise(c)


def tokens(x: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def token_set(x: Column) -> Column:
    return F.array_distinct(tokens(x))


def slugify(x: Column) -> Column:
    """Letters, digits, _ and - stay; other runs become one _; the edges lose theirs; nothing left gives ``unknown``."""
    s = F.regexp_replace(F.regexp_replace(clean(x), "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def truncate(x: Column, threshold: int = 8000, head: int = 500, middle: int = 200, tail: int = 300, keep_if_zero: bool = True) -> Column:
    """Texts over ``threshold`` characters become their head, centre and tail, parted by a line of dots.

    Where head, middle and tail are all 0, the text stays (``keep_if_zero``) or becomes empty.
    """
    text = F.coalesce(x, F.lit(""))
    n = F.char_length(text)
    if head + middle + tail <= 0:
        short = text if keep_if_zero else F.lit("")
    else:
        start = F.floor((n - middle) / 2).cast("int") + 1
        parts = [F.left(text, F.lit(head)) if head > 0 else None, F.substring(text, start, F.lit(middle)) if middle > 0 else None, F.right(text, F.lit(tail)) if tail > 0 else None]
        short = F.concat_ws("\n...\n", *[F.nullif(p, F.lit("")) for p in parts if p is not None])
    return F.when(n > threshold, short).otherwise(text)


def unique_strings(xs: Column, fold_case: bool = False) -> Column:
    """Cleaned non-empty strings of an array, the first of each; with ``fold_case`` the first spelling of each."""
    kept = F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), clean), lambda s: s != "")
    if not fold_case:
        return F.array_distinct(kept)
    folded = F.transform(kept, F.lower)
    return F.filter(kept, lambda s, i: F.array_position(folded, F.lower(s)) == i + 1)


def memory_type(x: Column) -> Column:
    t = F.lower(clean(x))
    return F.when(t.isin(*MEMORY_TYPES), t).otherwise(F.lit(""))


def joined(sep: str, *parts: Column) -> Column:
    """The non-empty cleaned parts, joined."""
    return F.concat_ws(sep, *[F.nullif(clean(p), F.lit("")) for p in parts])


def searchable_text(content: Column, reason: Column, purpose: Column, keywords: Column) -> Column:
    return joined(" | ", content, reason, purpose, F.array_join(keywords, " "))


def approx_tokens(x: Column) -> Column:
    """The larger of blank-parted words and a third of the characters."""
    words = F.size(F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.greatest(words, F.floor(F.char_length(F.coalesce(x, F.lit(""))) / 3).cast("int"))


def normalize_content(x: Column) -> Column:
    """Lower case, runs of blanks as one, none at the edges."""
    return clean(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\s+", " "))


def normalize_question(x: Column) -> Column:
    """``normalize_content`` without quotes and without blanks ahead of punctuation."""
    bare = F.regexp_replace(normalize_content(x), "[\"'‘’“”`]", "")
    return F.trim(F.regexp_replace(bare, r"\s+([?.!,;:])", "$1"))


def content_key(content: Column, fallback: Column) -> Column:
    """MD5 of the lower-cased cleaned content, of ``fallback`` where that is empty."""
    c = F.lower(clean(content))
    return F.md5(F.when(c != "", c).otherwise(fallback))


def iso(ts: Column) -> Column:
    """ISO text with seconds, and six digits more only where there are microseconds."""
    micro = F.date_format(ts, "SSSSSS") != "000000"
    return F.when(micro, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
