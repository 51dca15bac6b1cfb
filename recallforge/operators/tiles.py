"""Exact threshold join of vectors by tiles: matrix products of block pairs that the triangle inequality cannot rule out."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.sources.shared import stash

#: Vectors of a block at most, about; a tile holds two blocks and their products.
TILE = 1_024
#: Vectors to which all angles are measured.
PIVOTS = 8

_BLOCKED = "bank string, near int, slice int, idx long, unit array<double>, angles array<double>"
_PAIR = "bank string, i long, j long, similarity double"
_PAIR_ARROW = pa.schema([("bank", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("similarity", pa.float64())])


def _rows(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    lists = column.to_pylist()
    return np.array(lists, float).reshape(len(lists), -1)


def _angles(pivots: np.ndarray, width: float):
    """Unit vectors with their angles to the pivots, the nearest pivot and the slice of ``width`` of the angle to it; a vector of length 0 or null stays 0."""

    def run(batches):
        for batch in batches:
            n = pivots.shape[1]
            x = np.array([v or [0.0] * n for v in batch.column(2).to_pylist()], float).reshape(batch.num_rows, n)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
            a = np.arccos(np.clip(x @ pivots.T, -1, 1))
            near = a.argmin(axis=1)
            cut = (a[np.arange(len(a)), near] // width).astype(np.int32)
            cols = [batch.column(0), pa.array(near, pa.int32()), pa.array(cut), batch.column(1), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(a), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["bank", "near", "slice", "idx", "unit", "angles"])

    return run


def blocked(vectors: DataFrame, threshold: float, tile: int = TILE, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(vectors, pairs): vectors (bank, block, idx, unit) dealt into blocks near the same pivot and at like angles to it; pairs (bank, p, q, n_p, n_q) of
    blocks, p <= q, that may hold a pair of cosine >= ``threshold``. Two vectors that near differ by no more than its angle in their angles to any
    pivot, so block pairs whose intervals lie farther apart are left out.
    """
    own = vectors.select(F.col("bank").cast("string").alias("bank"), F.col("idx").cast("long").alias("idx"), F.col("embedding").cast("array<double>").alias("embedding"))
    reach = math.acos(max(-1.0, min(1.0, threshold))) if threshold > 0 else math.pi
    some = own.where("embedding is not null and exists(embedding, v -> v <> 0)").orderBy(F.xxhash64("bank", "idx"), "bank", "idx").limit(pivots).select("embedding").collect()  # a few vectors, whatever the table
    p = np.array([r[0] for r in some] or [[1.0]], float)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    at = own.mapInArrow(_angles(p, max(reach / 2, 1e-3)), _BLOCKED)
    at = stash(at, "angles")
    chunks = at.groupBy("bank", "near", "slice").agg(F.ceil(F.count(F.lit(1)) / tile).alias("chunks"))
    block = F.concat_ws(".", "near", "slice", F.pmod(F.xxhash64("idx"), "chunks"))
    dealt = stash(at.join(chunks, ["bank", "near", "slice"]).select("bank", block.alias("block"), "idx", "unit", "angles"), "blocks")
    ends = [f(F.col("angles")[i]).alias(f"{n}{i}") for i in range(len(p)) for n, f in (("lo", F.min), ("hi", F.max))]
    b = dealt.groupBy("bank", "block").agg(F.count(F.lit(1)).alias("n"), *ends)
    left, right = b.select(*[F.col(c).alias(f"l_{c}") for c in b.columns]), b.select(*[F.col(c).alias(f"r_{c}") for c in b.columns])
    close = (F.col("l_bank") == F.col("r_bank")) & (F.col("l_block") <= F.col("r_block"))
    for i in range(len(p)):
        close = close & (F.col(f"l_lo{i}") - F.col(f"r_hi{i}") <= reach + 1e-7) & (F.col(f"r_lo{i}") - F.col(f"l_hi{i}") <= reach + 1e-7)
    pairs = left.join(right, close).select(F.col("l_bank").alias("bank"), F.col("l_block").alias("p"), F.col("r_block").alias("q"), F.col("l_n").alias("n_p"), F.col("r_n").alias("n_q"))
    return dealt.drop("angles"), stash(pairs, "pairs")


def _product(threshold: float):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        bank, p, q = (k.as_py() for k in key)
        other = left if p == q else right
        a, b = np.array(left.column("idx").to_pylist()), np.array(other.column("idx").to_pylist())
        if not len(a) or not len(b):
            return _PAIR_ARROW.empty_table()
        x = _rows(left.column("unit"))
        s = x @ (x if p == q else _rows(other.column("unit"))).T
        r, c = np.nonzero(s >= threshold)
        if p == q:
            keep = a[r] < b[c]
            r, c = r[keep], c[keep]
        i, j = np.minimum(a[r], b[c]), np.maximum(a[r], b[c])
        return pa.Table.from_arrays([pa.array([bank] * len(r), pa.string()), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(s[r, c])], schema=_PAIR_ARROW)

    return run


def similar_pairs(vectors: DataFrame, threshold: float = 0.85, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """All pairs i < j of a bank with cosine >= ``threshold``, of (bank, idx, embedding): (bank, i, j, similarity). A task holds one tile at a time; vectors of length 0 have cosine 0 with all."""
    dealt, pairs = blocked(vectors, threshold, tile, pivots)
    left = dealt.join(pairs.select("bank", F.col("p").alias("block"), "q"), ["bank", "block"]).select("bank", F.col("block").alias("p"), "q", "idx", "unit")
    right = dealt.join(pairs.where("p <> q").select("bank", F.col("q").alias("block"), "p"), ["bank", "block"]).select(F.col("bank").alias("bank"), "p", F.col("block").alias("q"), F.col("idx").alias("idx"), F.col("unit").alias("unit"))
    return left.groupBy("bank", "p", "q").cogroup(right.groupBy("bank", "p", "q")).applyInArrow(_product(threshold), _PAIR)


def pairs_tested(pairs: DataFrame) -> DataFrame:
    """(bank, tested): how many pairs of vectors the tiles of ``blocked`` multiply."""
    n = F.when(F.col("p") == F.col("q"), F.col("n_p") * (F.col("n_p") - 1) / 2).otherwise(F.col("n_p") * F.col("n_q"))
    return pairs.groupBy("bank").agg(F.sum(n.cast("long")).alias("tested"))
