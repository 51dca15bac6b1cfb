"""MinHash near-duplicates by a multi-index Hamming join.

A signature has ``CHUNKS`` chunks of ``WIDTH`` b-bit MinHash symbols. Two
signatures that differ in at most ``2 * CHUNKS - 1`` symbols agree, by the
pigeonhole principle, in all but at most one symbol of some chunk. Every chunk
is therefore indexed once for each symbol left out (the one allowed error), and
equal keys give every pair within that distance, and most pairs beyond it: at a
Jaccard similarity of 0.8 no chunk agrees so far with a probability of 1.1e-7.
Candidates whose signatures differ in more symbols than all but 1e-9 of similar
pairs are left out; all others are confirmed on full shingle sets.

Equal sets are collapsed to one representative first; keys are searched by
pivots (see that module), within that bound.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.llm import _kernel as K
from recallforge.llm._common import rows_of, small_batches, stash
from recallforge.llm.pivots import PARITY, linked, parity

CHUNKS, WIDTH = 12, 5
SYMBOLS = CHUNKS * WIDTH
_ODD = K.multipliers(SYMBOLS)
_LANES = -(-SYMBOLS // 8)


def _sign(n: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in K.slices(batch.column(1)):
                size, low, high, signs, marks = [], [], [], np.zeros((hi - lo, SYMBOLS), np.uint16), np.zeros((hi - lo, _LANES + PARITY), np.int64)
                for t, own in enumerate(K.shingle_sets(data, offsets, n)):
                    size.append(len(own))
                    low.append(int(own.sum(dtype=K.U64)))
                    high.append(int(K.mix(own ^ K.U64(0xA5A5A5A55A5A5A5A)).sum(dtype=K.U64)))
                    if len(own):
                        signs[t] = K.minhash(own, _ODD) & K.U64(0xFFFF)
                        marks[t, _LANES:] = parity(own)
                low_bytes = np.zeros((hi - lo, _LANES * 8), np.uint8)
                low_bytes[:, :SYMBOLS] = signs.astype(np.uint8)
                marks[:, :_LANES] = low_bytes.view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, marks.size + 1, marks.shape[1]), pa.int32()), pa.array(marks.ravel()))
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * SYMBOLS), hi - lo, [None, pa.py_buffer(signs.tobytes())])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(np.array(low, K.U64).view(np.int64)), pa.array(np.array(high, K.U64).view(np.int64)), flat.cast(pa.binary()), lists], names=["id", "n", "low", "high", "sign", "marks"])

    return run


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint16).reshape(len(column), SYMBOLS)


def _keys(batches):
    """(key, id): for each chunk and each symbol left out of it, a key of the others."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            signs = np.frombuffer(b"".join(x.as_py() for x in part.column(1)), np.uint16).astype(K.U64).reshape(-1, CHUNKS, WIDTH)
            keys = np.zeros((len(signs), CHUNKS, WIDTH), K.U64)
            for left in range(WIDTH):
                packed = np.zeros(signs.shape[:2], K.U64)
                for j in range(WIDTH):
                    if j != left:
                        packed = K.mix(packed + signs[:, :, j] + K.U64(0x9E3779B97F4A7C15))
                keys[:, :, left] = packed + (np.arange(CHUNKS, dtype=K.U64) * K.U64(WIDTH) + K.U64(left)) * K.U64(0xD6E8FEB86659FD93)
            yield pa.RecordBatch.from_arrays([pa.array(K.mix(keys).reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(part.column(0)), SYMBOLS))], names=["key", "id"])


def distance(x: Column, y: Column) -> Column:
    """Number of byte lanes (low bytes of symbols, eight to a long) that differ between two marks: never more than the symbols that differ."""

    def differing(i: int) -> Column:
        # A half byte plus 15 sets the bit above it unless it is 0. The difference stands twice in this, not more: a condition too long is not compiled.
        z, half = x[i].bitwiseXOR(y[i]), F.lit(0x0F0F0F0F0F0F0F0F)
        above = (z.bitwiseAND(half) + half).bitwiseOR(F.shiftrightunsigned(z, 4).bitwiseAND(half) + half)
        return F.bit_count(above.bitwiseAND(F.lit(0x1010101010101010)))

    return reduce(lambda a, b: a + b, [differing(i) for i in range(_LANES)])


def most(similar: int, miss: float = 1e-9) -> int:
    """The least number of symbols beyond which signatures of a pair of that similarity differ with a probability of ``miss`` at most (binomial law)."""
    p, k, beyond = 1 - similar / 100, SYMBOLS, 0.0
    while k and (beyond := beyond + math.comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k)) <= miss:
        k -= 1
    return k


def _confirm(n: int, similar: int):
    """Pairs of texts whose full shingle sets have 100 * intersection >= similar * union."""

    def one(text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return next(K.shingle_sets(data, np.array([0, len(data)]), n))

    def run(batches):
        last, kept = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, kept = a, one(ta.as_py() or "")
                other = one(tb.as_py() or "")
                both = len(np.intersect1d(kept, other, assume_unique=True))
                keep.append(both > 0 and 100 * both >= similar * (len(kept) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def groups_of(docs: DataFrame, signs: DataFrame, shingle: int = 2, similar: int = 80) -> DataFrame:
    """(id, component) by confirmed links between the rows of ``signs`` (id, n, sign, marks).

    ``docs`` has (id, text) of every row of ``signs``.
    """
    keys = signs.select("id", "sign").mapInArrow(_keys, "key long, id long")

    def confirm(pairs: DataFrame) -> DataFrame:
        texts = rows_of(docs, stash(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids"), "id")
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return both.select("a", "b", "ta", "tb").mapInArrow(_confirm(shingle, similar), "a long, b long")

    return linked(keys, signs.select("id", "n", "marks"), similar, confirm, lambda x, y: distance(x, y) <= most(similar), _LANES)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 2, similar: int = 80) -> DataFrame:
    """One row for each row of ``docs``: key, n_shingles, component_id, kept.

    Words are runs of non-blanks, A-Z lower-cased; a text's set has its distinct
    ``shingle``-word shingles, with fewer words the whole sequence as one. Texts
    without words (null and empty ones too) have an empty set and are linked with
    nothing, not even each other. ``key`` is an integer; equal rows get equal
    results. Rows with a null key are in no component: component_id is null and
    they are kept. An empty table gives an empty one; other columns are not read.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = stash(own.mapInArrow(_sign(shingle), "id long, n long, low long, high long, sign binary, marks array<long>"), "signs")
    whole = signed.where("n > 0 and id is not null")
    classes = stash(whole.groupBy("n", "low", "high").agg(F.min("id").alias("rep")), "classes")
    reps = stash(whole.join(classes.select(F.col("rep").alias("id"), "n", "low", "high"), ["id", "n", "low", "high"], "left_semi").dropDuplicates(["id"]).select("id", "n", "sign", "marks"), "reps")
    groups = groups_of(own, reps, shingle, similar)
    merged = classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("n", "low", "high", F.coalesce("component", "rep").alias("component"))
    out = signed.drop("sign", "marks").join(merged, ["n", "low", "high"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op3_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of two-word shingles, its component at 0.8 and whether it is the one that stays."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
