"""Benchmark decontamination by winnowing.

Of every run of ``window`` words, the ``k``-gram with the least hash is its
fingerprint. Two texts that share such a run share its fingerprint, so a join of
fingerprints finds every shared span of that length. A hit is extended to the
windows around it: each that has the fingerprint is told by the hash of all its
words, and a join of these, with their places, gives the words that are hit. Test
items shorter than a window count whole; the fingerprint of one is its own least
``k``-gram, or all of it where it is shorter still. No text leaves its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.llm import _kernel as K
from recallforge.llm._common import side, small_batches, stash

WINDOW, GRAM = 13, 5
#: Distinct test fingerprints (8 bytes each) up to which they are broadcast as a filter of the training side; beyond it the fingerprints of texts, at most ``k`` a word, are joined.
MAX_BROADCAST_PRINTS = 2_000_000


def windows(bounds: np.ndarray, sums: np.ndarray, k: int, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, text, first word, fingerprint, hash) of all runs of these lengths that lie in one text of a slice; first words count from the slice's start."""
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for n in lengths:
        count, gram = len(of) - n + 1, min(k, n)
        if count <= 0:
            continue
        inside = np.flatnonzero(of[:count] == of[n - 1 :])
        grams = K.grams(sums, gram)
        yield n, of[inside], inside, grams[K.sliding_argmin(grams, n - gram + 1)[inside]], K.grams(sums, n)[inside]


def _cut(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bounds, sums) of the slices of a column of texts."""
    for lo, hi, data, offsets in K.slices(column):
        data = K.LOWER[data]
        starts, ends, bounds = K.words(data, offsets, K.STRICT)
        yield lo, hi, bounds, K.gram_sums(K.cut_hash(K.byte_sums(data), starts, ends))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _item_windows(window: int, k: int):
    """A row for each window of an item."""

    def run(batches):
        for batch in batches:
            for lo, _, bounds, sums in _cut(batch.column(1)):
                size = np.minimum(np.diff(bounds), window)
                for n, of, _, prints, hashes in windows(bounds, sums, k, list(range(1, window + 1))):
                    own = size[of] == n
                    item = batch.column(0).take(pa.array(of[own] + lo))
                    yield pa.RecordBatch.from_arrays([item, pa.array(np.full(len(item), n)), _long(prints[own]), _long(hashes[own])], names=["item", "n", "print", "hash"])

    return run


def _among(prints: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``prints`` are in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(prints), bool)
    return known[np.minimum(np.searchsorted(known, prints), len(known) - 1)] == prints


def _prints(k: int, lengths: list[int]):
    """All distinct fingerprints of each text."""

    def run(batches):
        for batch in batches:
            for lo, hi, bounds, sums in _cut(batch.column(1)):
                found = [(of, prints) for _, of, _, prints, _ in windows(bounds, sums, k, lengths)]
                of, prints = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in ((0, np.int64), (1, K.U64)))
                order = np.lexsort((prints, of))
                of, prints = of[order], prints[order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (prints[1:] != prints[:-1])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[new], np.arange(hi - lo + 1)), pa.int32()), _long(prints[new]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["th", "prints"])

    return run


def _doc_windows(k: int, lengths: list[int], known):
    """Words of each text, and the windows whose fingerprint is known: to all texts by the broadcast ``known``, else to each by its own third column."""

    def run(batches):
        for batch in batches:
            for lo, hi, bounds, sums in _cut(batch.column(1)):
                own = [np.zeros((0, 4), np.int64)]
                shared = None if known is not None else [np.sort(np.array(x.as_py() or [], np.int64).view(K.U64)) for x in batch.column(2).slice(lo, hi - lo)]
                for n, of, first, prints, hashes in windows(bounds, sums, k, lengths):
                    if known is not None:
                        hit = _among(prints, known.value)
                    else:
                        edges = np.searchsorted(of, np.arange(hi - lo + 1))
                        hit = np.concatenate([_among(prints[a:b], s) for a, b, s in zip(edges[:-1], edges[1:], shared, strict=True)])
                    own.append(np.stack([of[hit], first[hit] - bounds[of[hit]], np.full(hit.sum(), n), hashes[hit].view(np.int64)], axis=1))
                rows = np.concatenate(own)
                rows = rows[np.argsort(rows[:, 0], kind="stable")]
                spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in (1, 2, 3)], names=["first", "n", "hash"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[:, 0], np.arange(hi - lo + 1)), pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds).astype(np.int64)), lists], names=["doc", "n_words", "spans"])

    return run


def _covered(spans: Column) -> Column:
    """Words in any of the (first, n), which are sorted."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))

    def add(a: Column, s: Column) -> Column:
        end = s["first"] + s["n"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["sum"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["first"]))).alias("sum"))

    return F.aggregate(spans, zero, add)["sum"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = GRAM, most: int = MAX_BROADCAST_PRINTS) -> DataFrame:
    """One row for each row of ``docs``: key, n_words, n_hit, n_items, items_sha256, items (ids as strings), contaminated.

    A word is hit inside any occurrence of a window of an item; a text is
    contaminated if n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have
    no words and are clean; null and empty items have no window. Rows that repeat,
    or have no key, are judged each; items that repeat an id count once, those
    without an id hit words but are not counted. Empty tables give no rows,
    an empty benchmark no hits. Other columns, whatever their names, are not read.
    Windows are told by 64-bit hashes of their words. ``most``: distinct
    fingerprints of items up to which they are broadcast; the result is the same beyond it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tests = benchmark.select(F.col(item).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    kind, item_kind = dict(own.dtypes)["doc"], dict(tests.dtypes)["item"]
    index = stash(tests.mapInArrow(_item_windows(window, k), f"item {item_kind}, n long, print long, hash long").distinct(), "items")
    lengths = sorted(r["n"] for r in index.select("n").distinct().collect())  # up to ``window``
    prints = index.select("print").distinct()
    spans = f"doc {kind}, n_words long, spans array<struct<first:long,n:long,hash:long>>"
    if prints.limit(most + 1).count() <= most:
        known = spark.sparkContext.broadcast(np.sort(prints.toArrow().column(0).to_numpy().view(K.U64)))
        scanned = own.mapInArrow(_doc_windows(k, lengths, known), spans)
    else:
        placed = own.withColumn("th", F.xxhash64("text"))
        of_texts = placed.select("th", "text").mapInArrow(_prints(k, lengths), "th long, prints array<long>").select("th", F.explode("prints").alias("print")).distinct()
        shared = stash(of_texts.join(prints, "print", "left_semi").groupBy("th").agg(F.collect_set("print").alias("prints")), "shared")  # bounded by a text's length
        scanned = placed.join(shared, "th", "left").select("doc", "text", "prints").mapInArrow(_doc_windows(k, lengths, None), spans)
    scanned = stash(scanned.withColumn("row", F.monotonically_increasing_id()), "windows")
    near = scanned.where(F.size("spans") > 0).select("row", F.inline("spans"))
    hits = stash(near.join(side(index.select("hash").distinct()), "hash", "left_semi"), "hits")
    covered = hits.groupBy("row").agg(_covered(F.sort_array(F.collect_list(F.struct("first", "n")))).alias("n_hit"))  # bounded by a text's length
    named = hits.select("row", "hash").distinct().join(side(index.select("hash", "item").distinct()), "hash").select("row", F.col("item").cast("string").alias("item")).distinct()
    named = named.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    rows = hits.select("row").distinct()
    clean = scanned.join(side(rows), "row", "left_anti").select("doc", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    hit = scanned.select("row", "doc", "n_words").join(side(rows), "row", "left_semi").join(covered, "row").join(named, "row").select("doc", "n_words", "n_hit", "items")
    every = clean.unionByName(hit).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    return every.select(F.col("doc").alias(key), "n_words", "n_hit", "n_items", "items_sha256", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words inside 13-word windows of benchmark items, and the items that these belong to."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs.select("doc_id", "text"), bench.select("item_id", "text")).drop("items")


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
b as (select item_id, {_WORDS.format("coalesce(text, '')")} as w from benchmark),
bw as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as g
       from (select item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as i from b where len(w) > 0)),
ns as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns where len(w) >= n)),
m as (select doc_id, i, n, item_id from dw join bw using (n, g)),
hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from (select distinct doc_id, i, n from m)) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, item_id::varchar as x from m) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""
