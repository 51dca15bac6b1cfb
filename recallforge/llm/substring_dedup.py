"""Substring deduplication: MinHash banding of paragraphs, and of the passages inside and across them.

Paragraphs (lines of a text) of enough words are MinHashed over their word
shingles. Bands are tuned so that a pair at the threshold collides in some band
with at least the wanted recall. Paragraphs that collide are confirmed by exact
Jaccard similarity; components of confirmed links (equal paragraphs are one node)
keep their first paragraph and lose the others.

A passage need not fill a line. Blocks of ``BLOCK`` words stand wherever the
MinHash of ``SPREAD`` consecutive grams of ``ANCHOR`` words lies, in any line or
across lines. Two texts with an equal passage of ``BLOCK + SPREAD - 1`` words have
such a MinHash, and so a block, in common. A block that small leaves no room for
edits at the threshold, so blocks are joined by the hash of all their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.llm import _kernel as K
from recallforge.llm._common import MAX_BROADCAST_IDS, forget, rows_of, side, small_batches, stash
from recallforge.llm.pivots import PARITY, linked, parity

SHINGLE, SIMILAR, MIN_WORDS, RECALL = 5, 80, 20, 0.999
#: Words of a block; grams among which its place is chosen; words of such a gram. Equal passages of 51 words share a block.
BLOCK, SPREAD, ANCHOR = 36, 16, 5
#: Hot blocks are looked for in one of SAMPLE rows: those in HOT of them, and in one of RARE rows, at least.
SAMPLE, HOT, RARE = 64, 16, 5_000


def tune(similar: int, recall: float, rows: int = 3) -> tuple[int, int]:
    """(bands, rows of a band): the fewest bands of ``rows`` with which pairs of ``similar`` per cent collide with probability ``recall``."""
    match = (similar / 100) ** rows
    return int(np.ceil(np.log(1 - recall) / np.log(1 - match))), rows


class Words:
    """Words of a slice of texts, with the sums from which the hash of any run of them comes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.ends_of_lines = np.flatnonzero(data == 10)
        data = K.LOWER[data]
        self.offsets, self.size = offsets, len(data)
        self.starts, self.stops, self.bounds = K.words(data, offsets, K.BLANK)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        self.sums = K.gram_sums(K.cut_hash(K.byte_sums(data), self.starts, self.stops))

    def hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return K.mix((self.sums[hi] - self.sums[lo]) * K._GRAMS.get(len(self.sums))[1][lo] + (hi - lo).astype(K.U64))


def paragraphs(w: Words, shingle: int, least: int, bands: int, rows: int):
    """(text, start, end, sequence hash, distinct shingles, parity sketches, band keys) of the lines of a slice with ``least`` words; a line ends behind its newline."""
    line = np.searchsorted(w.ends_of_lines, w.starts)
    new = np.ones(len(w.starts), bool)
    new[1:] = (w.text[1:] != w.text[:-1]) | (line[1:] != line[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(w.starts))
    keep = hi - lo >= max(least, shingle)
    lo, hi = lo[keep], hi[keep]
    runs = K.grams(w.sums, shingle)
    size = hi - lo - shingle + 1
    at = np.cumsum(size) - size
    own = runs[np.repeat(lo - at, size) + np.arange(size.sum())] if len(lo) else runs[:0]
    distinct, marks = np.zeros(len(lo), np.int64), np.zeros((len(lo), PARITY), np.int64)
    for p, (a, n) in enumerate(zip(at, size, strict=True)):
        part = np.unique(own[a : a + n])
        distinct[p], marks[p] = len(part), parity(part)
    keys = np.zeros((len(lo), bands), K.U64)
    if len(lo):
        odd = K.multipliers(bands * rows, 23)
        for b in range(bands):
            for r in range(rows):
                keys[:, b] = K.mix(keys[:, b] + np.minimum.reduceat(own * odd[b * rows + r], at) + K.U64(b + 1))
    text, line = w.text[lo], line[lo]
    before = np.concatenate([[0], w.ends_of_lines + 1])[line] if len(lo) else lo
    after = np.concatenate([w.ends_of_lines + 1, [w.size]])[line] if len(lo) else lo
    start = np.maximum(before, w.offsets[text]) - w.offsets[text]
    end = np.minimum(after, w.offsets[text + 1]) - w.offsets[text]
    return text, start, end, w.hashes(lo, hi), distinct, marks, keys


def blocks(w: Words, block: int, spread: int, anchor: int):
    """(text, start, end, hash, places) of the blocks of a slice; equal blocks that overlap, as in text that repeats itself, are one run from the first start to the last end."""
    grams = K.grams(w.sums, anchor)
    n = len(w.starts) - (spread + anchor - 1) + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(K.U64), none
    inside = w.text[:n] == w.text[spread + anchor - 2 :]
    lo = np.unique(K.sliding_argmin(grams, spread)[inside])
    lo = lo[lo + block <= w.bounds[w.text[lo] + 1]]
    whole = w.hashes(lo, lo + block)
    order = np.lexsort((lo, whole, w.text[lo]))
    at, same = lo[order], whole[order]
    new = np.ones(len(at), bool)
    new[1:] = (w.text[at[1:]] != w.text[at[:-1]]) | (same[1:] != same[:-1]) | (at[1:] >= at[:-1] + block)
    first = np.flatnonzero(new)
    places = np.diff(np.append(first, len(at)))
    by_place = np.argsort(at[first])
    first, places = first[by_place], places[by_place]
    lo, last = at[first], at[first + places - 1]
    text = w.text[lo]
    return text, w.starts[lo] - w.offsets[text], w.stops[last + block - 1] - w.offsets[text], same[first], places


def _list(values: np.ndarray, bounds: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _scan(shingle, least, bands, rows, block, spread, anchor):
    """A row for each paragraph, and for each text with blocks a row with all of them."""

    def run(batches):
        for batch in batches:
            for first, _, data, offsets in K.slices(batch.column(1), 1 << 19):
                w = Words(data, offsets)
                text, start, end, whole, distinct, marks, keys = paragraphs(w, shingle, least, bands, rows)
                of, b_start, b_end, b_hash, b_n = blocks(w, block, spread, anchor)
                owners, places = np.unique(of, return_index=True)
                p, q = len(text), len(owners)
                none = pa.nulls
                at = pa.array(first + np.concatenate([text, owners]))
                part = np.append(places, len(of))
                wide = lambda x: pa.concat_arrays([_list(x.ravel().view(np.int64), np.arange(0, x.size + 1, x.shape[1]), pa.int64()), none(q, pa.list_(pa.int64()))])  # noqa: E731, B023
                flat = lambda x: pa.concat_arrays([pa.array(x, pa.int64()), none(q, pa.int64())])  # noqa: E731, B023
                many = lambda x, kind: pa.concat_arrays([none(p, pa.list_(kind)), _list(x, part, kind)])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(2).take(at), flat(start), flat(end), flat(whole.view(np.int64)), flat(distinct), wide(marks), wide(keys), many(b_hash.view(np.int64), pa.int64()), many(b_start, pa.int64()), many(b_end, pa.int64()), many(b_n, pa.int64())],
                    names=["id", "dk", "lo", "hi", "node", "n", "marks", "bands", "b_hash", "b_lo", "b_hi", "b_n"],
                )

    return run


def _confirm(shingle: int, similar: int):
    def one(line: bytes) -> np.ndarray:
        data = np.frombuffer(line, np.uint8)
        return next(K.shingle_sets(data, np.array([0, len(data)]), shingle))

    def run(batches):
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = one(ta.as_py()), one(tb.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= similar * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _without(batches):
    """Texts without the bytes of their spans."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw, at, kept = text.as_py().encode(), 0, []
            for s in sorted(spans, key=lambda x: x["lo"]):
                kept.append(raw[at : max(at, s["lo"])])
                at = max(at, s["hi"])
            out.append(b"".join([*kept, raw[at:]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), *[batch.column(i) for i in range(3, batch.num_columns)]], names=["id", "text", *batch.schema.names[3:]])


def _united(spans: Column) -> Column:
    """Sorted spans (lo, hi) with those that touch made one."""
    last = lambda done: F.try_element_at(done, F.lit(-1))

    def add(done: Column, s: Column) -> Column:
        touches = F.coalesce(last(done)["hi"] >= s["lo"], F.lit(False))
        one = F.struct(last(done)["lo"].alias("lo"), F.greatest(last(done)["hi"], s["hi"]).alias("hi"))
        return F.when(touches, F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), one)).otherwise(F.array_append(done, s))

    return F.aggregate(spans, F.array().cast("array<struct<lo:bigint,hi:bigint>>"), add)


def _passages(found: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(dk, lo, hi, n, line, lost) of the blocks that stand in several rows, and what was stored for it.

    A row has one entry for a run of equal blocks that overlap, so its entries of one
    hash are bounded by its words over those of a block, however it repeats itself. All blocks are shuffled once, by hash, and counted and joined where they are.
    Blocks of many rows are told in a sample of the rows (one of ``SAMPLE``, a hot
    block is in ``HOT`` of these and in a row of ``RARE`` at least); these are counted before a shuffle and
    not dealt out, so that no task has all rows of one. Which blocks are in the sample
    does not alter the result. Hot blocks are at most ``RARE`` times the blocks of a mean row.
    """
    some = found.where("b_hash is not null")
    sample = some.where(F.pmod(F.xxhash64("dk", F.lit(7)), F.lit(SAMPLE)) == 0)
    least = max(HOT, sample.count() // RARE)
    hot = stash(sample.select(F.explode(F.array_distinct("b_hash")).alias("hash")).groupBy("hash").count().where(F.col("count") >= least).select("hash"), "hot")
    every = some.select("id", "dk", F.explode(F.arrays_zip("b_hash", "b_lo", "b_hi", "b_n")).alias("b")).select("id", "dk", F.col("b.b_hash").alias("hash"), F.col("b.b_lo").alias("lo"), F.col("b.b_hi").alias("hi"), F.col("b.b_n").alias("n"))

    def kept(blocks: DataFrame) -> DataFrame:
        first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "dk"))
        return blocks.groupBy("hash").agg(first.alias("first"), F.min("dk").alias("low"), F.max("dk").alias("high")).where("low <> high").select("hash", F.col("first.dk").alias("kept"))

    few = side(hot)
    dealt = every.join(few, "hash", "left_anti").repartition("hash")
    often = every.join(few, "hash", "left_semi")
    known = stash(kept(often), "often")
    hits = dealt.join(kept(dealt), "hash").unionByName(often.join(side(known), "hash"))
    return hits.select("dk", "lo", "hi", "n", F.lit(False).alias("line"), (F.col("dk") != F.col("kept")).alias("lost")), [hot, known]


def drop_near_paragraphs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: int = SIMILAR, least: int = MIN_WORDS, recall: float = RECALL,
    block: int = BLOCK, spread: int = SPREAD, anchor: int = ANCHOR,
) -> DataFrame:
    """One row for each row of ``docs``: key, text without repeats, n_linked, n_removed, n_passages.

    Words are runs of non-blanks, A-Z lower-cased. ``n_linked``: paragraphs of
    ``least`` words with a near-copy (100 * intersection >= ``similar`` * union)
    anywhere else, ``n_removed``: those of them that go, with the newline behind
    them. Of each component of paragraphs the one with the least (key, place)
    stays. ``n_passages``: places of blocks that stand in another row too; their words stay in
    the row with the least key and go from the others. Where keys are equal, the
    row with the lesser hash of key and text counts as first; null keys come last.
    Null and empty texts stay as they are; rows that repeat (key and text) count as
    one and keep and lose the same; an empty table gives an empty one; other columns
    are not read. Paragraphs and blocks are told by 64-bit hashes of their words.
    One text at a time is held in memory, with arrays of about twenty times its size.
    """
    small_batches(docs.sparkSession)
    bands, rows = tune(similar, recall)
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    own = own.withColumn("dk", F.xxhash64("id", F.xxhash64("text")))
    kind = dict(own.dtypes)["id"]
    found = stash(own.where("text is not null").select("id", "text", "dk").mapInArrow(
        _scan(shingle, least, bands, rows, block, spread, anchor),
        f"id {kind}, dk long, lo long, hi long, node long, n long, marks array<long>, bands array<long>, b_hash array<long>, b_lo array<long>, b_hi array<long>, b_n array<long>",
    ), "paragraphs")
    lines = found.where("node is not null")
    place = F.struct("dk", "lo")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "dk", "lo", "hi"))
    nodes = stash(lines.groupBy("node").agg(first.alias("first"), F.min(place).alias("low"), F.max(place).alias("high"), F.first("n").alias("n"), F.first("marks").alias("marks"), F.first("bands").alias("bands")), "nodes")
    keys = nodes.select(F.explode("bands").alias("key"), F.col("node").alias("id"))

    def fetch(pairs: DataFrame) -> DataFrame:
        ids = stash(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ids")
        where = stash(nodes.join(side(ids), "node", "left_semi").select("node", "first.dk", "first.lo", "first.hi"), "where")
        texts = rows_of(own, where.select("dk").distinct(), "dk").dropDuplicates(["dk"])
        cut = F.substring(F.col("text").cast("binary"), (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
        got = stash(texts.join(where, "dk").select("node", cut.alias("line")), "lines")
        both = pairs.join(got.select(F.col("node").alias("a"), F.col("line").alias("ta")), "a").join(got.select(F.col("node").alias("b"), F.col("line").alias("tb")), "b")
        return both.select("a", "b", "ta", "tb").mapInArrow(_confirm(shingle, similar), "a long, b long")

    groups = linked(keys, nodes.select(F.col("node").alias("id"), "n", "marks"), similar, fetch, few_keys=True)
    placed = nodes.join(side(groups), nodes["node"] == groups["id"], "left").select("node", "first", "low", "high", F.coalesce("component", "node").alias("component"))
    several = placed.groupBy("component").agg(F.min("first").alias("kept"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("component", "kept")
    near = stash(placed.select("node", "component").join(several, "component").select("node", F.struct("kept.dk", "kept.lo").alias("kept")), "near")
    events = lines.select("dk", "lo", "hi", "node").join(side(near), "node").select("dk", "lo", "hi", F.lit(1).cast("long").alias("n"), F.lit(True).alias("line"), (place != F.col("kept")).alias("lost"))
    passages, made = _passages(found)
    one = F.struct("lo", "hi", "n", "line", "lost")
    count = lambda keep: F.aggregate(F.filter("all", keep), F.lit(0).cast("long"), lambda done, x: done + x["n"])
    spans = _united(F.sort_array(F.transform(F.filter("all", lambda x: x["lost"]), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))))
    marks = stash(events.unionByName(passages).groupBy("dk").agg(F.collect_set(one).alias("all")).select(  # bounded by a text's length
        "dk", count(lambda x: x["line"]).alias("n_linked"), count(lambda x: x["line"] & x["lost"]).alias("n_removed"), count(lambda x: ~x["line"]).alias("n_passages"), spans.alias("spans"),
    ), "marks")
    forget(found, near, *made)
    names = ("n_linked", "n_removed", "n_passages")
    # Texts are not shuffled where the list of those with repeats, or of their spans (16 bytes each), is small enough to broadcast.
    hit = side(marks.select("dk"))
    few = marks.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0] <= MAX_BROADCAST_IDS
    clean = own.join(hit, "dk", "left_anti").select("id", "text", *[F.lit(0).cast("long").alias(c) for c in names])
    met = own.join(F.broadcast(marks), "dk") if few else own.join(hit, "dk", "left_semi").join(marks, "dk")
    cut = met.select("id", "text", "spans", *names).mapInArrow(_without, f"id {kind}, text string, n_linked long, n_removed long, n_passages long")
    return clean.unionByName(cut).select(F.col("id").alias(key), F.col("text").alias(text), *names)


def op7_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without near-copies of paragraphs of 20 or more words and without passages that repeat across documents, as counts and the SHA-256 of what is kept."""
    kept = drop_near_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_linked", "n_removed", "n_passages", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
