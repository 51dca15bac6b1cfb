"""Removal of repeated byte strings by a difference-cover suffix sort.

A full suffix array has a row for every byte of the corpus, and only the order
of suffixes with a common prefix of ``length`` bytes matters here. So suffixes
are first dealt out by a sample of their own bytes: of every window of
``length`` bytes, the ``gram`` with the least hash is its anchor, and equal
windows have equal anchors. Runs of windows with one anchor are named by their
whole text; names that come twice are repeats as they stand, and anchors with
one name only hold no repeat. What is left are anchors with several names: the
texts of such a group are sorted by the difference cover modulo 3 (sort the
triples at two of three places, recurse on their names, merge the rest) and
adjacent suffixes are compared in their first ``length`` bytes. Groups too
large for one task are counted by window hash instead, in a Spark aggregate.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.llm import _kernel as K
from recallforge.llm._common import forget, rows_of, side, small_batches, stash

LENGTH, GRAM = 200, 64
#: Distinct names of an anchor up to which its texts are sorted in one task.
SORTED_TOGETHER = 1_000
_PLACE = 20  # bits of a place within a slice


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every ``w`` consecutive ones, from running minima of blocks."""
    n = len(x) - w + 1
    y = np.concatenate([x, np.full(-len(x) % w, np.iinfo(np.uint64).max, K.U64)]).reshape(-1, w)
    ahead, back = np.minimum.accumulate(y, axis=1).ravel(), np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(anchor, name, text, start, count) of the runs of windows with one anchor; at most 2 ** _PLACE bytes."""
    sums, at = K.byte_sums(data), np.arange(len(data) - gram + 1)
    hashes = K.cut_hash(sums, at, at + gram)
    low = K.U64((1 << _PLACE) - 1)
    own = (_sliding_min((hashes & ~low) | at.astype(K.U64), length - gram + 1) & low).astype(np.int64)
    windows = np.arange(len(own))
    text = np.searchsorted(offsets, windows, "right") - 1
    inside = windows + length <= offsets[text + 1]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(own))
    start, end = start[inside[start]], end[inside[start]]
    place = own[start]
    name = K.mix(K.cut_hash(sums, start, end + length - 1) + (place - start).astype(K.U64) * K.U64(0x9E3779B97F4A7C15))
    return hashes[place], name, text[start], start - offsets[text[start]], end - start


def _anchors(length: int, gram: int):
    most = (1 << _PLACE) - length

    def run(batches):
        for batch in batches:
            for lo, _, data, offsets in K.slices(batch.column(1), most // 2):
                for cut in range(0, max(1, len(data)), most):  # one very long text goes in parts that share length - 1 bytes
                    part = data[cut : cut + most + length - 1]
                    if len(part) < length:
                        continue
                    bounds = offsets if len(data) <= most else np.array([0, len(part)])
                    anchor, name, text, start, count = anchor_runs(part, bounds, length, gram)
                    rows = pa.array(lo + text)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(name.view(np.int64)), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(start + cut), pa.array(count)], names=["anchor", "name", "id", "th", "lo", "n"])

    return run


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffix array of positive whole numbers by the difference cover {1, 2} modulo 3."""
    n = len(codes)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: codes[i:].tolist()), np.int64)
    x = np.concatenate([codes.astype(np.int64), [0, 0, 0]])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a triple of ends parts the two halves of the names
    sample = np.concatenate([one, two])
    names = _names(x[sample], x[sample + 1], x[sample + 2])
    if names.max() + 1 == len(sample):
        order = np.argsort(names)
    else:
        order = suffix_array(names + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    wide = len(sample) + 2
    pair = lambda i: x[i] * wide + rank[i + 1]
    zero = zero[np.argsort(pair(zero), kind="stable")]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    # A suffix at 0 modulo 3 is told from one at 1 by its first number and the rank after it, from one at 2 by two numbers and a rank.
    ahead = np.searchsorted(pair(first), pair(zero))
    both, other = _names_two(x, rank, second, zero, wide)
    ahead += np.searchsorted(both, other)
    out = np.empty(n, np.int64)
    at = ahead + np.arange(len(zero))
    free = np.ones(n, bool)
    free[at] = False
    out[at], out[free] = zero, sampled
    return out


def _dense(*parts: np.ndarray) -> np.ndarray:
    """Ranks (equal for equal) of tuples, first part first."""
    rank = parts[0]
    for p in parts[1:]:
        span = int(p.max()) + 1
        if int(rank.max()) > (2**62) // span:
            rank = np.unique(rank, return_inverse=True)[1]
        rank = rank * span + p
    return rank


def _names(*parts: np.ndarray) -> np.ndarray:
    return np.unique(_dense(*parts), return_inverse=True)[1]


def _names_two(x, rank, second, zero, wide):
    i = np.concatenate([second, zero])
    key = _dense(x[i], x[i + 1], rank[i + 2])
    return key[: len(second)], key[len(second) :]


def repeated_windows(pieces: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each piece the windows (by start) whose bytes are those of another window of the pieces: neighbours in the suffix array agree in ``length`` bytes."""
    ends = np.cumsum([len(p) + 1 for p in pieces])
    flat = np.zeros(ends[-1], np.uint8)
    codes = np.empty(ends[-1], np.int64)
    for k, (p, e) in enumerate(zip(pieces, ends, strict=True)):
        flat[e - 1 - len(p) : e - 1] = p
        codes[e - 1 - len(p) : e - 1] = p.astype(np.int64) + len(pieces) + 1
        codes[e - 1] = k + 1  # each its own end, so no prefix goes on into the next piece
    order = suffix_array(codes)
    left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - 1 - np.arange(ends[-1])
    order = order[left[order] >= length]
    found = np.zeros(ends[-1], bool)
    if len(order) > 1:
        prefix = K.cut_hash(K.byte_sums(flat), order, order + length)
        same = prefix[1:] == prefix[:-1]
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
    return [np.flatnonzero(found[e - 1 - len(p) : e - 1]) for p, e in zip(pieces, ends, strict=True)]


_SPAN = "id {0}, th long, lo long, hi long"


def _spans(ids, ths, los, runs, length, schema):
    """Byte spans of windows: runs of starts, each ``length`` bytes beyond the last."""
    out = []
    for i, t, lo, at in zip(ids, ths, los, runs, strict=True):
        if len(at):
            part = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
            out += [(i, t, lo + int(p[0]), lo + int(p[-1]) + length) for p in part]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)], schema=schema)


def _cut(batches):
    """The pieces of a text that are asked for."""
    for batch in batches:
        rows = []
        for i, t, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            raw = text.as_py().encode()
            rows += [(i, t, a["anchor"], a["single"], a["lo"], raw[a["lo"] : a["lo"] + a["size"]]) for a in asked]
            if sum(len(r[5]) for r in rows[-len(asked) :]) > 1 << 20:
                yield _piece_batch(rows, batch.column(0).type)
                rows = []
        yield _piece_batch(rows, batch.column(0).type)


def _piece_batch(rows, kind):
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], names=["id", "th", "anchor", "single", "lo", "piece"])


def _sort_groups(length: int, most: int = 1 << 19):
    """Groups of pieces, together as rows come sorted by anchor, are sorted about ``most`` bytes at a time."""

    def run(batches):
        held, size, schema = [], 0, None

        def flush(rows):
            runs = repeated_windows([np.frombuffer(r[5], np.uint8) for r in rows], length) if rows else []
            keep = [k for k, r in enumerate(rows) if r[3]]
            return _spans([rows[k][0] for k in keep], [rows[k][1] for k in keep], [rows[k][4] for k in keep], [runs[k] for k in keep], length, schema)

        for batch in batches:
            schema = pa.schema([("id", batch.column(0).type), ("th", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > most and row[2] != held[-1][2]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush(held)

    return run


def _window_hashes(length: int):
    def run(batches):
        for batch in batches:
            ids, ths, los, hashes, singles = [], [], [], [], []
            for k, raw in enumerate(batch.column(5)):
                data = np.frombuffer(raw.as_py(), np.uint8)
                at = np.arange(len(data) - length + 1)
                hashes.append(K.cut_hash(K.byte_sums(data), at, at + length))
                los.append(at + batch.column(4)[k].as_py())
                ids.append(np.full(len(at), k))
            rows = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))
            flat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), batch.column(3).take(rows), pa.array(flat(los, np.int64)), pa.array(flat(hashes, K.U64).view(np.int64))], names=["id", "th", "single", "lo", "hash"])

    return run


def _remove(batches):
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            raw = text.as_py().encode()
            lo, hi = np.asarray(spans.values.field(0)), np.asarray(spans.values.field(1))
            order = np.argsort(lo, kind="stable")
            lo, reach = lo[order], np.maximum.accumulate(hi[order])
            new = np.ones(len(lo), bool)
            new[1:] = lo[1:] > reach[:-1]
            first = lo[new]
            last = reach[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]
            kept = b"".join(raw[a:b] for a, b in zip([0, *last.tolist()], [*first.tolist(), len(raw)], strict=True))
            rows.append((len(raw), len(raw) - len(kept), len(first), kept))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in cols[3]], pa.string()), pa.array(cols[3], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, list[DataFrame]]:
    """Spans, and the stored tables they are read from (to be forgotten once the spans are). Spans are (id, th, lo, hi): byte spans whose every byte is in a ``length``-byte string that starts elsewhere too; spans of a text may overlap. ``th`` is the xxhash64 of the text."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th")).where((F.octet_length("text") >= length) & F.col("id").isNotNull())
    kind = dict(own.dtypes)["id"]
    runs = stash(own.select("id", "text", "th").mapInArrow(_anchors(length, gram), f"anchor long, name long, id {kind}, th long, lo long, n long"), "anchors")
    named = runs.groupBy("anchor", "name").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "th", "lo", "n")).alias("rep"))
    named = stash(named.join(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("all")).where("all > 1").select("anchor"), "anchor", "left_semi"), "names")
    full = runs.join(named.where("c > 1").select("anchor", "name"), ["anchor", "name"], "left_semi").select("id", "th", "lo", (F.col("lo") + F.col("n") + (length - 1)).alias("hi"))
    groups = named.groupBy("anchor").agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("c") == 1).alias("singles")).where("names > 1 and singles > 0").select("anchor", (F.col("names") > SORTED_TOGETHER).alias("hot"))
    asked = named.join(groups, "anchor").select("rep.id", "rep.th", F.struct("anchor", (F.col("c") == 1).alias("single"), F.col("rep.lo").alias("lo"), (F.col("rep.n") + (length - 1)).alias("size"), "hot").alias("a"))
    lists = stash(asked.groupBy("id", "th").agg(F.collect_list("a").alias("asked")), "asked")  # no more than a text has runs
    needed = rows_of(own, lists.select("id").distinct(), "id").join(lists, ["id", "th"])
    pieces = lambda hot: needed.select("id", "th", "text", F.filter("asked", lambda a: a["hot"] == hot).alias("asked")).where(F.size("asked") > 0).mapInArrow(_cut, f"id {kind}, th long, anchor long, single boolean, lo long, piece binary")
    cold = pieces(False).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_groups(length), _SPAN.format(kind))
    windows = stash(pieces(True).mapInArrow(_window_hashes(length), f"id {kind}, th long, single boolean, lo long, hash long"), "windows")
    twice = windows.groupBy("hash").count().where("count > 1").select("hash")
    hot = windows.where("single").join(twice, "hash", "left_semi").select("id", "th", "lo", (F.col("lo") + length).alias("hi"))
    return full.unionByName(cold).unionByName(hot), [runs, named, lists, windows]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: what is left, null where nothing was removed).

    Every byte in a ``length``-byte string that also starts anywhere else goes, in
    all its places. Null is the empty text; texts shorter than ``length`` keep all.
    Rows that repeat repeat each other's texts; rows without a key are looked at by
    none and keep all; an empty table gives an empty one; other columns are not read. Strings are told by 64-bit hashes.
    """
    own = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    kind = dict(own.dtypes)["id"]
    spans, temporary = repeated_spans(docs, key, text, length)
    lists = stash(spans.distinct().groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")  # bounded by a text's length
    forget(*temporary)
    marks = side(lists.select("id", "th"))  # texts that lose nothing are not shuffled where this list is small enough to broadcast
    whole = own.join(marks, ["id", "th"], "left_anti").select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    hit = own.join(marks, ["id", "th"], "left_semi").join(lists, ["id", "th"])
    cut = hit.select("id", "text", "spans").mapInArrow(_remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return whole.unionByName(cut).withColumnRenamed("id", key)


def op5_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the bytes it loses to 200-byte strings that stand elsewhere too, and the digest of what is left."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept")
