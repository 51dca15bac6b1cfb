"""Components of links among rows that share index keys, without all pairs of a key.

The rows of a key are first compared with a pivot, its least row: a row with the
pivot of its largest key, then with those of other keys that are still in other
components, then with further pivots in keys with many rows that are still in
different components. In keys whose rows remain in different components, rows of
different components are paired, those beside the largest component of a key
with all its rows; bounds that lose no link keep all but likely
pairs from leaving the join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallforge.llm._common import components, joined_components, side, stash

#: 64-bit words of a parity sketch; open rows of a key up to which they are paired in one task.
PARITY, SLICE = 8, 500
#: Further pivots of a key in a round, and components of a key up to which it has none.
PIVOTS, WIDE = 4, 32


def parity(hashes: np.ndarray) -> np.ndarray:
    """Sketch of a set of hashes: each flips one of 64 * PARITY bits, so sketches differ in no more bits than sets do in elements."""
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity_bits(x: Column, y: Column, at: int = 0) -> Column:
    """Bits in which two sketches differ that stand at ``at`` in arrays of longs."""
    return reduce(lambda a, b: a + b, [F.bit_count(x[at + i].bitwiseXOR(y[at + i])) for i in range(PARITY)])


def linked(keys: DataFrame, marks: DataFrame, similar: int, confirm: Callable[[DataFrame], DataFrame], near: Callable[[Column, Column], Column] | None = None, at: int = 0, few_keys: bool = False) -> DataFrame:
    """(id, component) by all links that ``confirm`` lets pass of rows (key, id) with a key in common; rows without any link may be left out.

    ``marks`` has (id, n, marks) of every row: the size of its set and an array of
    longs with a parity sketch at ``at``. Similar sets differ in size and in
    elements by so much at most, and so do their sketches; ``near`` is another
    condition on two arrays of marks. With ``few_keys`` (some ten a row) rows carry
    their open keys to the last pairing, where a pair is made in the least key that
    it shares, not once in each of them.
    """

    def likely(x: str, y: str) -> Column:
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        a, b = F.col(f"{x}.marks"), F.col(f"{y}.marks")
        bound = (100 * F.least(n, m) >= similar * F.greatest(n, m)) & ((100 + similar) * parity_bits(a, b, at) <= (100 - similar) * (n + m))
        return bound if near is None else bound & near(a, b)

    def compared(stars: DataFrame) -> DataFrame:
        met = stars.where("a <> b").distinct().join(marks.alias("x"), F.col("a") == F.col("x.id")).join(marks.alias("y"), F.col("b") == F.col("y.id"))
        return stash(confirm(stash(met.where(likely("x", "y")).select("a", "b"), "pairs")), "links")

    dealt = keys.repartition("key")  # counted and joined where it is: one shuffle of all keys
    pivots = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("pivot")).where("c > 1")
    members = stash(dealt.join(pivots, "key").select("key", "id", "pivot", "c"), "members")
    marks = stash(marks.join(side(stash(members.select("id").distinct(), "ids")), "id", "left_semi"), "marks")  # most rows share no key
    # First every row with the pivot of its largest key only, as rows of one group share most keys; then with pivots of other keys that are in other components.
    largest = members.groupBy("id").agg(F.max(F.struct("c", "pivot")).alias("m")).select(F.col("m.pivot").alias("a"), F.col("id").alias("b"))
    known = components(compared(largest))
    own = side(known.select("id", F.col("component").alias("of_id")))
    of_pivot = side(known.select(F.col("id").alias("pivot"), F.col("component").alias("of_pivot")))
    apart = members.join(own, "id", "left").join(of_pivot, "pivot", "left").where(F.coalesce("of_id", "id") != F.coalesce("of_pivot", "pivot"))
    groups = joined_components(known, compared(apart.select(F.col("pivot").alias("a"), F.col("id").alias("b"))))
    others = members.where("id <> pivot").select("key", "id")

    def open_in(groups: DataFrame) -> DataFrame:
        """(key, id, label) of keys whose rows are in different components."""
        rest = others.join(side(groups), "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
        still = rest.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("key")
        return stash(rest.join(still, "key", "left_semi"), "rest")

    def main_of(rest: DataFrame) -> DataFrame:
        """(key, main, parts, main_rows, rows): the component with most rows of a key; its rows need no comparison among themselves."""
        sizes = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
        best = F.max(F.struct("n", "label"))
        each = sizes.groupBy("key").agg(best.alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("rows"))
        return stash(each.select("key", F.col("m.label").alias("main"), "parts", F.col("m.n").alias("main_rows"), "rows"), "main")

    # Rows with many links to others of their key, none to its pivot, need a few more pivots, not all pairs: rounds of them, as long as each closes a tenth of what is apart.
    # In a round a row beside the main component meets the pivots of one key, that with most components apart, as rows of one group share most keys.
    rest = open_in(groups)
    before, turn = None, 0
    while True:
        main = main_of(rest)
        size = main.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]
        wide = main.where(F.col("parts") > WIDE)
        if before and 10 * size > 9 * before or wide.limit(1).count() == 0:
            break
        within = rest.join(wide, "key")
        slot = F.pmod(F.xxhash64("label", F.lit(turn)), F.lit(PIVOTS))
        chosen = within.groupBy("key", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "label")).alias("p"))
        minor = stash(within.where("label <> main").groupBy("id", "label").agg(F.max(F.struct("parts", "key")).alias("m")).select("id", "label", F.col("m.key").alias("key")), "minor")
        stars = minor.join(chosen.select("key", F.col("p.id").alias("a"), F.col("p.label").alias("of")), "key").where("label <> of").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
        groups = joined_components(groups, compared(stars))
        rest, before, turn = open_in(groups), size, turn + 1
    # Rows beside the main component of a key meet all its rows. Both are cut into slices by hash of the row; each pair of slices is a key of its own, so that no task has all pairs of a key.
    cuts = main.select("key", "main", *[F.greatest(F.ceil(n / SLICE), F.lit(1)).cast("int").alias(c) for n, c in ((F.col("rows"), "cuts"), (F.col("rows") - F.col("main_rows"), "minor_cuts"))])
    opened = rest.join(cuts, "key").join(marks, "id")
    open_rows = stash(opened.join(rest.groupBy("id").agg(F.collect_set("key").alias("keys")), "id") if few_keys else opened, "open")
    cut = lambda c: F.pmod(F.xxhash64("id"), c).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    x = open_rows.where("label <> main").select("*", cut("minor_cuts").alias("slice"), every("cuts").alias("other")).alias("x")
    y = open_rows.select("*", cut("cuts").alias("slice"), every("minor_cuts").alias("other")).alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.slice") == F.col("y.other")) & (F.col("x.other") == F.col("y.slice"))
    once = (F.col("y.label") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    least = F.col("x.key") == F.array_min(F.array_intersect("x.keys", "y.keys")) if few_keys else F.lit(True)
    more = x.join(y, met & (F.col("x.label") != F.col("y.label")) & once & likely("x", "y") & least)
    pairs = more.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    later = stash(confirm(stash(pairs if few_keys else pairs.distinct(), "pairs")), "links")
    return joined_components(groups, later)
