"""Inverted index of a record table, stored once, and top-k search with block maxima.

Records of a bank are dealt over shards of up to ``SHARD`` rows, as tasks read them, in which they stand in the order of
their lengths; a row of ``postings`` is a term in a shard. Its postings are cut into blocks of
``BLOCK`` neighbouring slots with the largest term count and the least length in each: whatever the
parameters of the score, no record of a block scores more. Shards are searched in parallel. In a shard a query scores its most promising
blocks first and stops when no other block can reach its k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.functions.text import tokens
from recallforge.sources.shared import side, small_batches

SHARD, BLOCK = 1_024, 2
#: Tokens at which a shard is closed, so that long records make no large one.
SHARD_TOKENS = 1_000_000
#: Query terms up to which their weights go to the executors; beyond it ``search_index`` takes the queries in so many groups.
MAX_TERMS = 2_000_000


class Index(NamedTuple):
    #: (bank, shard, slot, record_idx, dl).
    records: DataFrame
    #: (bank, shard, term, df, blocks, tops, shortest, counts, slots, tfs); df counts the records of the shard.
    postings: DataFrame
    #: (bank, term, df).
    frequency: DataFrame
    #: (bank, n, avgdl): records without tokens count too.
    stats: DataFrame


def _shard(own: pa.Table, number: int, block: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its records in one row without a term, then a row a term."""
    lengths = pa.compute.list_value_length(own.column(2)).to_numpy()
    dl = lengths.astype(np.int32)
    order = np.lexsort((own.column(1).to_numpy(), dl))
    slot_of = np.empty(len(order), np.int64)
    slot_of[order] = np.arange(len(order))
    ids, dl = own.column(1).take(pa.array(order)).combine_chunks(), dl[order]
    words = pa.chunked_array([c.flatten() for c in own.column(2).chunks], pa.string()).combine_chunks().dictionary_encode()
    found, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(dl) + np.repeat(slot_of, lengths), return_counts=True)
    term, slot = np.divmod(found, len(dl))
    # A block begins where the term or the number of the block changes, a term where the term changes.
    first = np.flatnonzero(np.diff(term * (len(dl) // block + 1) + slot // block, prepend=-1))
    terms = np.flatnonzero(np.diff(term, prepend=-1))
    to = lambda cuts, n: pa.array(np.append(cuts, n), pa.int32())
    many = lambda x, cuts: pa.ListArray.from_arrays(to(cuts, len(x)), pa.array(x.astype(np.int32)))
    starts = np.searchsorted(first, terms)
    tops, least = (f.reduceat(x, first) if len(first) else x[:0] for f, x in ((np.maximum, tf), (np.minimum, dl[slot])))
    per_block = [many(x, starts) for x in (slot[first] // block, tops, least, np.diff(np.append(first, len(slot))))]
    columns = [words.dictionary, pa.array(np.diff(np.append(terms, len(slot))), pa.int32()), *per_block, many(slot, terms), many(tf, terms)]
    for none in (True, False):
        n = 1 if none else len(terms)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(dl)], pa.int32()), x) for x in (ids, pa.array(dl))] if none else [pa.nulls(n, pa.list_(ids.type)), pa.nulls(n, pa.list_(pa.int32()))]
        bank = own.column(0).take(pa.array(np.zeros(n, np.int64))).combine_chunks()
        yield pa.RecordBatch.from_arrays([bank, pa.array(np.full(n, number)), *([pa.nulls(1, c.type) for c in columns] if none else columns), *lists], names=_SHARD_COLUMNS)


_SHARD_COLUMNS = ["bank", "shard", "term", "df", "blocks", "tops", "shortest", "counts", "slots", "tfs", "ids", "dls"]


def _deal(shard: int, block: int):
    """Shards of the records (bank, record_idx, t) of a task: in each bank up to ``shard`` records, or fewer that have ``SHARD_TOKENS`` tokens."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        open_: dict = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for bank in rows.column(0).unique():
                part = rows.filter(pa.compute.equal(rows.column(0), bank))
                while part.num_rows:
                    held, n, size = open_.pop(bank.as_py(), ([], 0, 0))
                    total = size + np.cumsum(pa.compute.list_value_length(part.column(2)).to_numpy().astype(np.int64))
                    take = min(shard - n, 1 + int(np.searchsorted(total, SHARD_TOKENS)), part.num_rows)
                    held, n, size, part = [*held, part.slice(0, take)], n + take, int(total[take - 1]), part.slice(take)
                    if n >= shard or size >= SHARD_TOKENS:
                        yield from _shard(pa.concat_tables(held), number, block)
                        number += 1
                    else:
                        open_[bank.as_py()] = held, n, size
        for held, *_ in open_.values():
            yield from _shard(pa.concat_tables(held), number, block)
            number += 1

    return run


def build_index(records: DataFrame, text: Column, path: str, shard: int = SHARD, block: int = BLOCK) -> None:
    """Store the index of ``text`` over ``records`` (bank, record_idx, ...) below ``path``. Tasks make shards of the records that they read, so neither texts nor tokens are shuffled or sorted by Spark; a task holds one shard a bank."""
    spark = records.sparkSession
    small_batches(spark)
    own = records.where("bank is not null").select("bank", "record_idx", tokens(text).alias("t"))
    own = own.coalesce(1 + records.count() // (2 * shard))  # some full shards a task
    kind = dict(own.dtypes)
    lists = "blocks array<int>, tops array<int>, shortest array<int>, counts array<int>, slots array<int>, tfs array<int>"
    own.mapInArrow(_deal(shard, block), f"bank {kind['bank']}, shard long, term string, df int, {lists}, ids array<{kind['record_idx']}>, dls array<int>").write.parquet(f"{path}/shards")
    x = spark.read.parquet(f"{path}/shards")
    x.where("term is not null").groupBy("bank", "term").agg(F.sum("df").alias("df")).write.parquet(f"{path}/frequency")
    lengths = x.where("term is null").select("bank", F.explode("dls").alias("dl"))
    lengths.groupBy("bank").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).write.parquet(f"{path}/stats")


def open_index(spark: SparkSession, path: str) -> Index:
    read = lambda n: spark.read.parquet(f"{path}/{n}")
    records = read("shards").where("term is null").select("bank", "shard", F.posexplode(F.arrays_zip("ids", "dls")).alias("slot", "r")).select("bank", "shard", "slot", F.col("r.ids").alias("record_idx"), F.col("r.dls").alias("dl"))
    return Index(records, read("shards").where("term is not null").drop("ids", "dls"), read("frequency"), read("stats"))


def tf_rows(index: Index, wanted: DataFrame | None = None) -> DataFrame:
    """(bank, record_idx, term, tf, dl) of all postings, or of those of ``wanted`` (bank, term; distinct) alone."""
    p = index.postings if wanted is None else index.postings.join(side(wanted), ["bank", "term"], "left_semi")
    flat = p.select("bank", "shard", "term", F.explode(F.arrays_zip("slots", "tfs")).alias("e")).select("bank", "shard", "term", F.col("e.slots").alias("slot"), F.col("e.tfs").alias("tf"))
    return flat.join(index.records.select("bank", "shard", "slot", "record_idx", "dl"), ["bank", "shard", "slot"]).select("bank", "record_idx", "term", "tf", "dl")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from starts[i] on, sizes[i] of them, one after the other."""
    total = int(sizes.sum())
    jump = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return np.arange(total) + jump


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    a = column.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(a).to_numpy(zero_copy_only=False)))).astype(np.int64)


class _Bank(NamedTuple):
    avgdl: float
    ids: np.ndarray
    #: By term: its idf and the places, in ``ids``, of the queries that hold it.
    terms: dict[str, tuple[float, np.ndarray]]


_SCORED = "query_id long, bank string, record_idx long, score double, scored long"
_SCORED_ARROW = pa.schema([("query_id", pa.int64()), ("bank", pa.string()), ("record_idx", pa.int64()), ("score", pa.float64()), ("scored", pa.int64())])


def _search_shard(known, k: int, k1: float, b: float):
    """Top ``k`` of each query of one shard; ``scored`` is how many records of the shard the query has scored."""

    def part(tf, dl, avgdl):
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (avgdl + 1e-12)) + 1e-12)

    def run(key, postings: pa.Table, records: pa.Table) -> pa.Table:
        bank: _Bank = known.value.get(key[0].as_py())
        if bank is None or not postings.num_rows:
            return _SCORED_ARROW.empty_table()
        slot_of, length = records.column("slot").to_numpy(), records.column("dl").to_numpy()
        ids, dl = np.zeros(len(slot_of), np.int64), np.zeros(len(slot_of), np.int64)
        ids[slot_of], dl[slot_of] = records.column("record_idx").to_numpy(), length
        terms = postings.column("term").to_pylist()
        idf = np.array([bank.terms[t][0] for t in terms])
        blocks, at_block = _flat(postings.column("blocks"))
        sizes = _flat(postings.column("counts"))[0].astype(np.int64)
        of_block = np.repeat(np.arange(len(terms)), np.diff(at_block))
        bound = idf[of_block] * part(_flat(postings.column("tops"))[0], _flat(postings.column("shortest"))[0], bank.avgdl)
        slots, tfs = _flat(postings.column("slots"))[0], _flat(postings.column("tfs"))[0]
        gain = np.repeat(idf[of_block], sizes) * part(tfs, dl[slots], bank.avgdl)
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        holders = [bank.terms[t][1] for t in terms]
        asked, which = np.concatenate(holders), np.repeat(np.arange(len(terms)), [len(h) for h in holders])
        order = np.argsort(asked, kind="stable")
        asked, which = asked[order], which[order]
        edges = np.flatnonzero(np.diff(asked, prepend=-1, append=-1))
        out = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own = which[lo:hi]
            rows = _ranges(at_block[own], np.diff(at_block)[own])
            limits = np.bincount(blocks[rows], weights=bound[rows])
            queue = np.argsort(-limits, kind="stable")
            score, least, done, step = np.zeros(len(ids)), -1.0, 0, 2
            while done < len(queue) and limits[queue[done]] > 0 and limits[queue[done]] >= least - 2e-9:
                chosen = np.zeros(len(limits), bool)
                chosen[queue[done : done + step]] = True
                some = rows[chosen[blocks[rows]]]
                at = _ranges(first[some], sizes[some])
                score += np.bincount(slots[at], weights=gain[at], minlength=len(ids))
                done, step = done + step, step * 2
                hits = np.flatnonzero(score > 0)
                if len(hits) >= k:
                    least = np.partition(score[hits], len(hits) - k)[len(hits) - k]
            hits = np.flatnonzero(score > 0)
            best = hits[np.lexsort((ids[hits], -np.round(score[hits], 9)))][:k]
            out.append((np.full(len(best), bank.ids[asked[lo]]), ids[best], score[best], np.full(len(best), len(hits))))
        q, r, s, n = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(q, pa.int64()), pa.array([key[0].as_py()] * len(q), pa.string()), pa.array(r, pa.int64()), pa.array(s), pa.array(n, pa.int64())], schema=_SCORED_ARROW)

    return run


def _known(weights: pa.Table) -> dict[str, _Bank]:
    rows = {c: weights.column(c).to_pylist() for c in ("bank", "query_id", "term", "idf", "avgdl")}
    out: dict[str, tuple] = {}
    for bank, q, term, idf, avgdl in zip(*rows.values(), strict=True):
        _, places, terms = out.setdefault(bank, (avgdl, {}, {}))
        terms.setdefault(term, (idf, []))[1].append(places.setdefault(q, len(places)))
    return {b: _Bank(avgdl, np.array(list(places)), {t: (idf, np.array(at)) for t, (idf, at) in terms.items()}) for b, (avgdl, places, terms) in out.items()}


def search_index(index: Index, terms: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, most: int = MAX_TERMS) -> DataFrame:
    """(query_id, bank, record_idx, score, scored): the best ``k`` of every shard by BM25 for ``terms`` (query_id, bank, term; distinct), which hold the best ``k`` of all.

    Only postings of query terms leave the scan. Weights of up to ``most`` query terms, counted, are broadcast; of more, the queries are dealt into groups and the shards searched for one group after the other.
    """
    spark = terms.sparkSession
    weights = terms.join(index.frequency, ["bank", "term"]).join(side(index.stats), "bank")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = weights.select(F.col("bank").cast("string").alias("bank"), F.col("query_id").cast("long").alias("query_id"), "term", idf.alias("idf"), "avgdl")
    groups = 1 + weights.count() // most
    found = []
    for g in range(groups):
        own = weights if groups == 1 else weights.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        known = spark.sparkContext.broadcast(_known(own.toArrow()))
        wanted = index.postings.join(side(own.select("bank", "term").distinct()), ["bank", "term"], "left_semi")
        by = wanted.groupBy("bank", "shard").cogroup(index.records.select("bank", "shard", "slot", "record_idx", "dl").groupBy("bank", "shard"))
        found.append(by.applyInArrow(_search_shard(known, k, k1, b), _SCORED))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
