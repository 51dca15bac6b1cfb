"""Licence scans by a positional index of rare licence words.

The words of licence notices that stand in a text are its postings. Of these
a file's words of highest IDF (over all files) are looked up; a template is a candidate where
at least ``VOTES`` of them stand at its relative places, and it is found where every
word of its mandatory key phrases stands in its place too. Base phrases are found by the
same intersection of relative places over all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallforge.llm._common import side, stash

#: Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Label, words of a public notice, phrases of it that must be there.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0", "except in compliance with the license")),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("terms of the gnu general public license", "published by the free software foundation")),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license", "published by the free software foundation")),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license", "published by the free software foundation")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("subject to the terms of the mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international license",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0 international license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("licensed under cc by nc 4 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
)
#: Letters from which on a word of a template is indexed, looked-up words of a file, and how many of them must agree (all that a shorter template has).
LETTERS, RAREST, VOTES = 5, 12, 3

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Put after the words of a text, at the place that counts them; no word looks like it.
_END = "."


def _indexed(words: list[str], letters: int) -> list[tuple[int, str]]:
    return [(i, w) for i, w in enumerate(words) if len(w) >= letters]


def _key_places(text: str, phrases: tuple[str, ...]) -> set[int]:
    words, out = text.split(), set()
    for phrase in phrases:
        p = phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
        out |= set(range(at, at + len(p)))
    return out


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(f"({WORD})"), F.lit(1))


def _doc(right: DataFrame) -> tuple[DataFrame, Column]:
    """``right`` with its keys renamed, and the condition that joins it to (doc, h)."""
    return right.withColumnRenamed("doc", "doc_r").withColumnRenamed("h", "h_r"), F.col("doc").eqNullSafe(F.col("doc_r")) & (F.col("h") == F.col("h_r"))


def postings(docs: DataFrame, vocabulary: list[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, h, at, word) of the words of ``vocabulary`` in each text, and one row ``.`` for each row of ``docs`` whose ``at`` is its number of words. ``h`` is a hash of the text: rows of one id may have different texts."""
    known = docs.sparkSession.createDataFrame([(w,) for w in [*vocabulary, _END]], "word string")
    own = docs.select(F.col(doc).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.array_append(split_words(F.col(text)), F.lit(_END)).alias("w"))
    return own.select("doc", "h", F.posexplode("w").alias("at", "word")).join(F.broadcast(known), "word").select("doc", "h", F.col("at").cast("long").alias("at"), "word")


def _bits(place: str = "i") -> Column:
    return F.bit_or(F.expr(f"shiftleft(1L, {place})"))


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text", base=BASE, templates=TEMPLATES, letters: int = LETTERS, rarest: int = RAREST, votes: int = VOTES) -> tuple[DataFrame, DataFrame]:
    """(files, places). Files: (doc, h, n_words) for each row of ``docs``. Places, a row each: (doc, h, label, base, start, share), where
    ``start`` is the word at which a base phrase or a template starts and ``share`` the part of its words that stand in their places (1 for base phrases).

    Null and empty texts have no words; rows that repeat have the same places, listed once; an empty table has none.
    Base phrases have up to 62 words. A template that starts before the first word of a text has a negative start.
    """
    spark = docs.sparkSession
    indexed = {t: _indexed(text.split(), letters) for t, (_, text, _) in enumerate(templates)}
    template_words = sorted({w for ws in indexed.values() for _, w in ws})
    vocabulary = sorted({*template_words, *(w for p, _ in base for w in p.split())})
    all_words = stash(postings(docs, vocabulary, doc, text), "postings")
    files, marks = all_words.where(F.col("word") == _END).select("doc", "h", F.col("at").alias("n_words")), all_words.where(F.col("word") != _END)

    phrase = spark.createDataFrame([(w, label, i, len(p.split()), n) for n, (p, label) in enumerate(base) for i, w in enumerate(p.split())], "word string, label string, i int, size int, phrase int")
    met = marks.join(F.broadcast(phrase), "word").groupBy("doc", "h", "phrase", "label", "size", (F.col("at") - F.col("i")).alias("start")).agg(_bits().alias("bits"))
    plain = met.where(F.bit_count("bits") == F.col("size")).select("doc", "h", "label", F.lit(True).alias("base"), "start", F.lit(1.0).alias("share"))

    # The words of highest IDF of each file: least document frequency, ties by the word.
    rows = spark.createDataFrame([(w,) for w in template_words], "word string")
    held = stash(marks.join(F.broadcast(rows), "word").select("doc", "h", "word").distinct(), "held")
    frequency = held.groupBy("word").agg(F.count(F.lit(1)).alias("df"))  # at most as many rows as the templates have words
    order = Window.partitionBy("doc", "h").orderBy("df", "word")
    chosen = held.join(F.broadcast(frequency), "word").withColumn("n", F.row_number().over(order)).where(F.col("n") <= rarest).select(F.col("doc").alias("doc_r"), F.col("h").alias("h_r"), F.col("word").alias("looked"))
    looked = marks.join(chosen, F.col("doc").eqNullSafe(F.col("doc_r")) & (F.col("h") == F.col("h_r")) & (F.col("word") == F.col("looked")), "left_semi")
    index = spark.createDataFrame([(w, t, i, n, min(votes, len(ws))) for t, ws in indexed.items() for n, (i, w) in enumerate(ws)], "word string, template int, i int, n int, least int")
    agreed = looked.join(F.broadcast(index), "word").groupBy("doc", "h", "template", "least", (F.col("at") - F.col("i")).alias("start")).agg(_bits("n").alias("bits"))
    candidates = stash(agreed.where(F.bit_count("bits") >= F.col("least")).select("doc", "h", "template", "start"), "candidates")

    # Every word of a candidate is looked for in its place; only files with candidates are read again.
    whole = [(t, i, w, i in _key_places(text, keys)) for t, (_, text, keys) in enumerate(templates) for i, w in enumerate(text.split())]
    about = spark.createDataFrame([(t, label, len(text.split()), len(_key_places(text, keys))) for t, (label, text, keys) in enumerate(templates)], "template int, label string, size int, keys int")
    wanted = candidates.join(F.broadcast(spark.createDataFrame(whole, "template int, i int, word string, key boolean")), "template").select(F.col("doc").alias("doc_r"), F.col("h").alias("h_r"), (F.col("start") + F.col("i")).alias("at_r"), F.col("word").alias("word_r"), "template", "start", "i", "key")
    ids, same = _doc(candidates.select("doc", "h").distinct())
    texts = docs.select(F.col(doc).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("t")).join(side(ids), same, "left_semi")
    words = texts.select("doc", "h", F.posexplode(split_words(F.col("t"))).alias("at", "word"))
    there = words.join(wanted, F.col("doc").eqNullSafe(F.col("doc_r")) & (F.col("h") == F.col("h_r")) & (F.col("at") == F.col("at_r")) & (F.col("word") == F.col("word_r")))
    counted = there.select("doc", "h", "template", "start", "i", "key").distinct().groupBy("doc", "h", "template", "start").agg(F.count(F.lit(1)).alias("n"), F.count_if("key").alias("n_keys"))
    found = counted.join(F.broadcast(about), "template").where(F.col("n_keys") == F.col("keys")).select("doc", "h", "label", F.lit(False).alias("base"), "start", (F.col("n") / F.col("size")).alias("share"))
    return files, stash(plain.unionByName(found), "places")


def op13_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of all documents: the contract's columns out of ``scan``; ``score`` is the largest share of a place, 0 without one. Nulls and empty texts have no words and no labels."""
    files, places = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.col("base")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  # as many as there are labels
    found = places.groupBy("doc", "h").agg(F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"), names(F.when(base, F.col("label"))).alias("base_labels"), names(F.col("label")).alias("labels"), F.max("share").alias("score"))
    hits, same = _doc(found)
    return files.join(side(hits), same, "left").select(F.col("doc").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in rows)


def _sql() -> str:
    cut = [(t, label, i, w, len(w) >= LETTERS, i in _key_places(text, keys)) for t, (label, text, keys) in enumerate(TEMPLATES) for i, w in enumerate(text.split())]
    phrases = [(n, label, i, w, len(p.split())) for n, (p, label) in enumerate(BASE) for i, w in enumerate(p.split())]
    return f"""with tw(t, label, i, w, indexed, key) as (values {_values(cut)}), bw(p, label, i, w, size) as (values {_values(phrases)}),
d as (select doc_id, coalesce(text, '') as x from documents), dw as (select doc_id, x, regexp_extract_all(translate(x, '{_UPPER}', '{_LOWER}'), '{WORD}') as ws from d),
u as (select distinct doc_id, x, unnest(ws) as w, unnest(range(0, len(ws))) as pos from dw),
bp as (select doc_id, x, label, pos - i as start from u join bw using (w) group by doc_id, x, p, label, size, pos - i having count(*) = any_value(size)),
held as (select distinct doc_id, x, w from u where w in (select w from tw where indexed)), fr as (select w, count(*) as df from held group by 1),
ch as (select doc_id, x, w from held join fr using (w) qualify row_number() over (partition by doc_id, x order by df, w) <= {RAREST}),
ca as (select u.doc_id, u.x, t, pos - i as start from u join ch on ch.doc_id is not distinct from u.doc_id and ch.x = u.x and ch.w = u.w join tw on tw.w = u.w and indexed group by u.doc_id, u.x, t, pos - i having count(*) >= least({VOTES}, (select count(*) from tw z where z.t = tw.t and z.indexed))),
pl as (select ca.doc_id, ca.x, label, false as base, start, count(*)::double / (select count(*) from tw z where z.t = ca.t) as share from ca join tw on tw.t = ca.t join u on u.doc_id is not distinct from ca.doc_id and u.x = ca.x and u.pos = start + i and u.w = tw.w
 group by ca.doc_id, ca.x, ca.t, label, start having count(*) filter (where key) = (select count(*) from tw z where z.t = ca.t and z.key) union all select doc_id, x, label, true, start, 1.0::double from bp),
fd as (select doc_id, x, count(*) filter (where base) as n_base, min(start) filter (where base) as first_word, max(start) filter (where base) as last_word, string_agg(distinct label, ',' order by label) filter (where base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score from pl group by 1, 2)
select dw.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from dw left join fd on fd.doc_id is not distinct from dw.doc_id and fd.x = dw.x"""


OP13_SQL = _sql()
