"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are cut into blocks. In the ideal, fluid mix every source
that is left gets its weight's share of every slot, and sources leave it as they run
out. Block k of a source may not be placed before the slot in which the ideal begins
it and not after the one in which the ideal ends it; earliest deadline first places
one block a slot within these windows. So every source is, at every slot of the
whole run, within one block of the ideal, also after others have run out.

While the same sources are left, windows repeat after a period of slots. Only one
period and the slots around a source's end are made on the driver, and every row
finds its slot by arithmetic in joins with the table of these. Weights are taken as
they are, however far apart, and any number of sources up to ``MAX_SOURCES`` is
scheduled. The size of blocks is the caller's and does not change with the table; a caller
with very long periods may ask for as many rows a block as keep ``MAX_STEPS`` slots on the driver.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.llm._common import bucket_count, side, stash, with_rank

#: Sum of the default weights of up to 100 sources.
MAX_PERIOD = 10_000
#: Slots made on the driver, about, at most, where ``rows_a_block`` chooses the size of blocks.
MAX_STEPS = 500_000
#: Sources scheduled on their own, and groups for those beyond.
MAX_SOURCES, POOLS = 100_000, 100


class Ideal:
    """The fluid mix of sources with so many blocks and positive weights."""

    def __init__(self, blocks: list[int], weights: list[int]):
        self.blocks, self.weights = blocks, weights
        self.ends = sorted(range(len(blocks)), key=lambda s: (Fraction(blocks[s], weights[s]), s))
        self.gone, self.left = [0], [sum(weights)]  # blocks of the sources that have run out, weights of the others, after each end
        for s in self.ends:
            self.gone.append(self.gone[-1] + blocks[s])
            self.left.append(self.left[-1] - weights[s])
        self.by = [0]  # common divisor of the weights of the sources that are left
        for s in reversed(self.ends):
            self.by.append(math.gcd(self.by[-1], weights[s]))
        self.by.reverse()
        self.at = [0] * len(blocks)

    def slot(self, s: int, k: int) -> tuple[int, int]:
        """Floor and ceiling of the slot at which the ideal has mixed in ``k`` blocks of source ``s``; to be asked for rising ``k``."""
        j, w = self.at[s], self.weights[s]
        ended = lambda e: e <= len(self.ends) and self.blocks[self.ends[e - 1]] * w < k * self.weights[self.ends[e - 1]]
        step = 1
        while ended(j + step):  # ever longer steps, then shorter ones
            j, step = j + step, 2 * step
        while step := step // 2:
            if ended(j + step):
                j += step
        self.at[s] = j
        x = self.left[j] * k
        return self.gone[j] + x // w, self.gone[j] - (-x // w)

    def pieces(self) -> list[tuple[int, int, int, int]]:
        """(first slot, last slot, sources gone, period) of the times in which the same sources are left."""
        out, start = [], Fraction(0)
        for j, s in enumerate(self.ends):
            end = self.gone[j] + self.left[j] * Fraction(self.blocks[s], self.weights[s])
            if end > start:
                out.append((math.ceil(start), math.floor(end), j, self.left[j] // self.by[j]))
            start = end
        return out

    def steps(self) -> int:
        """About as many slots as are made one by one: the whole piece, or some periods of it."""
        return sum(min(last - first, 5 * period) for first, last, _, period in self.pieces())


def place(blocks: list[int], weights: list[int]) -> list[tuple[list[int], int]]:
    """Runs (source of each slot, how often): the whole schedule, in order."""
    ideal, total, out, order, slot = Ideal(blocks, weights), sum(blocks), [], [], 0
    placed, ready, waiting = [0] * len(blocks), [], []

    def wait(s: int, k: int) -> None:
        if k < blocks[s]:
            release = ideal.slot(s, k)[0]
            heapq.heappush(waiting, (release, s, k, ideal.slot(s, k + 1)[1]))

    for s in range(len(blocks)):
        wait(s, 0)
    pieces = iter(ideal.pieces())
    first, last, gone, period = next(pieces, (0, 0, 0, 1))
    mark: tuple[int, list[int]] | None = None
    while slot < total:
        while slot >= last and (following := next(pieces, None)):
            (first, last, gone, period), mark = following, None
        if slot >= first and slot + 2 * period <= last and (mark is None or slot == mark[0] + period):
            step = [0] * len(blocks)
            for s in ideal.ends[gone:]:
                step[s] = weights[s] // ideal.by[gone]
            times = (last - slot) // period - 2
            if mark and times > 0 and all(p == q + d for p, q, d in zip(placed, mark[1], step, strict=True)):
                out += [(order, 1), (order[-period:], times)]
                order, slot, placed = [], slot + times * period, [p + times * d for p, d in zip(placed, step, strict=True)]
                ready = [(d + times * period, s, k + times * step[s]) for d, s, k in ready]
                waiting = [(r + times * period, s, k + times * step[s], d + times * period) for r, s, k, d in waiting]
                mark = None
            else:
                mark = (slot, list(placed))
        while waiting and waiting[0][0] <= slot:
            _, s, k, deadline = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, k))
        _, s, k = heapq.heappop(ready)
        order.append(s)
        placed[s] += 1
        slot += 1
        wait(s, k + 1)
    return [*out, (order, 1)]


def _turns(blocks: list[int], weights: list[int]) -> Iterator[list[int]]:
    """The sources with a weight, then those without."""
    for weighty in (True, False):
        if own := [s for s, w in enumerate(weights) if bool(w) == weighty and blocks[s]]:
            yield own


def rows_a_block(rows: list[int], weights: list[int], block_rows: int, most: int = MAX_STEPS) -> int:
    """``block_rows``, or more if the schedule of such blocks took over ``most`` slots on the driver: then so many that there are no more blocks than that."""
    blocks = [-(-r // block_rows) for r in rows]
    if sum(blocks) <= most or sum(Ideal([blocks[s] for s in own], [weights[s] or 1 for s in own]).steps() for own in _turns(blocks, weights)) <= most:
        return block_rows
    return max(block_rows, -(-sum(rows) // max(1, most - len(rows))))


def schedule(blocks: list[int], weights: list[int]) -> list[dict]:
    """Pieces (source, first, end, each, start, period, offsets): block first + j of the source stands at start + (j // each) * period + offsets[j % each].

    Sources of weight 0 follow after all others, in equal shares.
    """
    done, slot, out = [0] * len(blocks), 0, []
    for own in _turns(blocks, weights):
        for order, times in place([blocks[s] for s in own], [weights[s] or 1 for s in own]):
            offsets: dict[int, list[int]] = {}
            for at, s in enumerate(order):
                offsets.setdefault(own[s], []).append(at)
            for s, o in offsets.items():
                out.append({"source": s, "first": done[s], "end": done[s] + times * len(o), "each": len(o), "start": slot, "period": len(order), "offsets": o})
                done[s] += times * len(o)
            slot += times * len(order)
    return out


def tempered(counts: list[int], power: float = 0.5, total: int | None = None) -> list[int]:
    """Whole weights in proportion to count ** power, 1 at least, of about ``total`` together; by default ``MAX_PERIOD``, or 100 a source if that is more."""
    raw = [c**power for c in counts]
    whole, share = sum(raw), total or max(MAX_PERIOD, 100 * len(counts))
    return [max(1, round(share * r / whole)) for r in raw]


def _units(counts: DataFrame, weights: dict[str | None, int] | None, source: str, power: float, own: int, pools: int) -> DataFrame:
    """For each source (__s) its share and its unit (JSON): the ``own`` sources with most rows (named ones first) are units of their own, the others are dealt over ``pools`` by hash."""
    named = F.col(source).isin(*[n for n in weights if n is not None]) if weights else F.lit(False)
    first = counts.orderBy(named.desc_nulls_last(), F.col("count").desc(), source).limit(own).select(F.col(source).alias("__f"), F.lit(True).alias("__alone"))
    marked = counts.join(first, F.col(source).eqNullSafe(F.col("__f")), "left")
    pool = F.concat(F.lit("pool "), F.pmod(F.xxhash64(F.coalesce(F.col(source), F.lit(""))), F.lit(pools)).cast("string"))
    alone = F.coalesce("__alone", F.lit(False))
    unit = F.struct(F.when(alone, F.col(source)).alias("source"), F.when(~alone, pool).alias("pool"))
    return marked.select(F.col(source).alias("__s"), F.col("count").alias("__count"), alone.alias("__own"), F.round(F.pow("count", F.lit(power)), 6).cast("decimal(28,6)").alias("__share"), F.to_json(unit).alias("__unit"))


def _tables(spark: SparkSession, names: list, kind: str, blocks: list[int], weights: list[int]) -> tuple[DataFrame, DataFrame]:
    """The schedule: pieces (one a run of a source), and for each cell of a piece (numbered on from its __base) the offset of its slot. Both are bounded by ``MAX_STEPS``, not by the data."""
    pieces, cells, base = [], [], 0
    for p in schedule(blocks, weights):
        pieces.append((names[p["source"]], base, p["first"], p["end"], p["each"], p["start"], p["period"]))
        cells += [(base + lo, p["offsets"][lo : lo + 1_000]) for lo in range(0, p["each"], 1_000)]
        base += p["each"]
    runs = spark.createDataFrame(pieces, f"__of {kind}, __base long, __first long, __end long, __each long, __start long, __period long", verifySchema=False)
    offsets = spark.createDataFrame(cells, "lo long, offsets array<long>", verifySchema=False).select("lo", F.posexplode("offsets")).select((F.col("lo") + F.col("pos")).alias("__cell"), F.col("col").alias("__offset"))
    return side(stash(runs, "schedule"), 2 * MAX_STEPS), side(stash(offsets, "schedule"), 2 * MAX_STEPS)


def mix_sources(docs: DataFrame, weights: dict[str | None, int] | None = None, key: str = "doc_id", source: str = "source", block_rows: int | None = 16, power: float = 0.5, own: int = MAX_SOURCES, pools: int = POOLS) -> DataFrame:
    """``docs`` with the columns slot (of the row's block, gapless from 0), place (of the row in its block) and block (number within the source).

    Every row is kept. ``weights``: whole numbers by source, met exactly; sources not named have
    weight 0 and follow after the others in equal shares; by default weights go with
    the row counts to the ``power``. Blocks have ``block_rows`` rows, however large the
    table is; None leaves their size to ``rows_a_block``, for weights far apart or very many sources over very many rows;
    every source is within one block of its share at every slot. A null
    source is a source. Of more than ``own`` sources the largest are scheduled
    on their own and the others in ``pools`` groups by hash, each with the weight of
    its sources together; block is then the number within the group. Rows of a
    source are taken in an order made by hash of key. Rows that repeat
    are kept; an empty table gives an empty one. Columns of ``docs`` named slot,
    place or block are replaced.
    """
    docs = docs.drop("slot", "place", "block")
    counts = stash(docs.groupBy(source).count(), "counts")
    ranked = with_rank(docs, [source], [F.col(key)], "__rank")
    pooled = counts.count() > own
    if pooled:
        unit, units = "__unit", stash(_units(counts, weights, source, power, own, pools), "units")
        met = ranked.join(side(units), F.col(source).eqNullSafe(F.col("__s")))
        # In a group rows go by turn: those of a source have turns evenly over its share of the group.
        turned = met.withColumn("__turn", F.when(F.col("__own"), F.lit(0.0)).otherwise((F.col("__rank") + 1) / F.col("__share").cast("double"))).drop("__s", "__count", "__share", "__own")
        most = units.where("not __own").agg(F.max(F.col("__count") / F.col("__share").cast("double"))).first()[0] or 1.0
        buckets = bucket_count(units.agg(F.sum("__count")).first()[0])
        deal = F.when(F.col("__turn") > 0, F.floor(F.col("__turn") / most * (buckets - 1))).otherwise(F.floor(F.col("__rank") / 5_000) % buckets)
        order = [F.col("__turn"), F.col(source), F.col("__rank")]
        turned = with_rank(turned.withColumn("__was", F.col("__rank")), ["__unit"], order, "__in_unit", deal=deal, buckets=buckets)
        ranked = turned.withColumn("__rank", F.when(F.col("__turn") > 0, F.col("__in_unit")).otherwise(F.col("__was"))).drop("__was", "__in_unit", "__turn")
        counted = [(r[0], r[1], float(r[2])) for r in units.groupBy(unit).agg(F.sum("__count"), F.sum("__share")).collect()]  # own + pools rows at most
    else:
        unit = source
        counted = [(r[0], r[1], r[1] ** power) for r in counts.collect()]  # own rows at most
    counted.sort(key=lambda r: (r[0] is not None, r[0] or ""))
    names = [r[0] for r in counted]
    of = [None if "pool" in (one := json.loads(n)) else (one.get("source"),) for n in names] if pooled else [(n,) for n in names]
    given = tempered([r[2] for r in counted], 1.0) if weights is None else [weights.get(n[0], 0) if n else 0 for n in of]
    if block_rows is None:
        block_rows = rows_a_block([r[1] for r in counted], given, 16)
    pieces, cells = _tables(docs.sparkSession, names, dict(ranked.dtypes)[unit], [-(-r[1] // block_rows) for r in counted], given)
    ranked = ranked.withColumn("block", F.floor(F.col("__rank") / block_rows).cast("long"))
    met = ranked.join(pieces, F.col(unit).eqNullSafe(F.col("__of")) & (F.col("block") >= F.col("__first")) & (F.col("block") < F.col("__end")))
    met = met.withColumn("__j", F.col("block") - F.col("__first")).withColumn("__cell", F.col("__base") + F.col("__j") % F.col("__each")).join(cells, "__cell")
    slot = F.col("__start") + F.floor(F.col("__j") / F.col("__each")).cast("long") * F.col("__period") + F.col("__offset")
    return met.withColumn("slot", slot).withColumn("place", F.col("__rank") % block_rows).drop("__rank", "__unit", "__j", "__cell", "__offset", *pieces.columns)


def op10_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix: weights by the square root of a source's rows, blocks of 16."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix_sources(docs).select("doc_id", "source", "block", "slot", "place")
